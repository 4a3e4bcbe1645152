import re

from hypothesis import given, settings
from hypothesis import strategies as st

from pactlens.fixed import noise as N
from pactlens.functions import cleaning as CL
from pactlens.functions import layout as L
from pactlens.functions import text as T


def test_clean_text_rules(one):
    cases = {
        "a  b\n\nc d": "a b c d",
        "price: 5€ & 7$ [x]": "price: 5 7 x",
        "wait..... now....": "wait... now...",
        "aaaa bbbbb aaab ____ zzz": "a b aaab _ zzz",
        "a---- b ---c -- d": "a--- b ---c -- d",
        "x ____y": "x  y",
        "": "",
    }
    assert one(CL.clean_text, list(cases)) == list(cases.values())
    assert one(CL.clean_text, [None]) == [""]


def test_repeated_letter_words_are_whole_words_only(one):
    assert one(CL.clean_text, ["aaaa éaaaa aaaab 11111"]) == ["a a aaaab 1"]


def test_substrings_through_chunks(spark):
    from pyspark.sql import functions as F

    text = "".join(chr(0x1F600 + i % 50) if i % 7 == 0 else chr(97 + i % 26) for i in range(3 * T.CHUNK + 100)).replace("c", "\n")
    cases = [(0, 5), (0, 0), (T.CHUNK - 1, 1), (T.CHUNK - 1, 2), (T.CHUNK, 3), (T.CHUNK - 10, 2 * T.CHUNK + 30), (len(text) - 4, 4), (len(text), 0), (5, len(text))]
    df = spark.createDataFrame([(text, s, n) for s, n in cases], "text string, s int, n int")
    got = [r[0] for r in df.select(T.substring_of(T.chunks_of(F.col("text")), F.col("s"), F.col("n"))).collect()]
    assert got == [text[s:s + n] for s, n in cases]


def test_whitespace_classes(one):
    assert one(T.normalize_whitespace, ["﻿ a  b \t c　"]) == ["a b c"]
    assert one(T.strip, ["  x \x0b\f"]) == ["x"]


WIDE = "[" + T.WHITESPACE_CHARS + "]"


def test_normalize_against_python(one):
    texts = []

    @settings(max_examples=200, deadline=None, database=None)
    @given(st.text(alphabet=" \t\n\r\x0b  ﻿ab.é", max_size=30))
    def collect(t):
        texts.append(t)

    collect()
    expected = [re.sub(WIDE + "+", " ", t).strip(T.WHITESPACE_CHARS) for t in texts]
    assert one(T.normalize_whitespace, texts) == expected


def test_any_pattern_equals_any_of_the_patterns(one):
    patterns = [p for group in N.NOISE_PATTERNS.values() for p in group]
    lines = [
        "e-Stamp", "estamp", "EStamps", "mumbai", "page 3", "PAGE", "12", " 12 ", "[ 7 ]", "draft copy", "a   b", "a  b", "----", "-----",
        "pan no: X1", "PAN NO", "sub registrar", "notarised", "witnessed by", "|", "||", "plain words", "confidential", "state ofx", "state of x",
    ]
    single = [one(lambda t, p=p: t.rlike(T.pattern(*p)), lines) for p in patterns]
    assert one(lambda t: t.rlike(T.any_pattern(patterns)), lines) == [any(col) for col in zip(*single, strict=True)]


def test_any_word(one):
    words = N.LAYOUT_INDICATORS
    lines = ["the PARTY", "parties", "term", "terms", "leas", "LEASE", "", "witnesset", "hereBY!"]
    expected = [any(w in line.lower() for w in words) for line in lines]
    assert one(lambda t: t.rlike(T.any_word(words)), lines) == expected


def test_sections(one):
    text = "intro line\nThis agreement starts\nmore text\n\nskipped\nrent is due\nPAGE 4\nrent again\nlast"
    assert one(CL.contract_sections, [text]) == [["This agreement starts\nmore text", "rent is due", "rent again\nlast"]]
    assert one(CL.contract_sections, ["", "no words here"]) == [[], []]


def test_section_keeps_the_lines_after_its_first_keyword_only(one):
    assert one(CL.contract_sections, ["plain\nlease\nplain"]) == [["lease\nplain"]]


def test_noise_filter_falls_back_when_little_is_left(one):
    short = "The lease. e-stamp DRAFT"
    assert one(CL.filter_document_noise, [short, "", None]) == ["The lease. DRAFT", "", ""]
    long = "This lease agreement between landlord and tenant sets rent, notice and deposit. " * 2 + "DRAFT COPY"
    assert one(CL.filter_document_noise, [long]) == [(long.replace("DRAFT COPY", "")).strip()]


def test_watermark_words_are_removed_inside_clauses(one):
    assert one(CL.remove_boilerplate, ["All confidential data"]) == ["All   data"]


def test_ocr_artifacts(one):
    assert one(CL.remove_ocr_artifacts, ["a||b ____ c------d.....e   f\x07"]) == ["ab cde f"]


def test_noise_findings_are_stateless(one):
    found = one(CL.noise_findings, ["draft DRAFT draft draft e-stamp"])[0]
    rows = {r["pattern"]: r for r in found}
    assert rows["DRAFT"]["matches"] == 4 and rows["DRAFT"]["examples"] == ["draft", "DRAFT", "draft"]
    assert rows["e-?stamp"]["chars"] == 7


def test_literals_are_looked_up_in_bytes(one):
    words = ["termination", "copy", "||", "_____", "e-stamp", "aa", "é"]
    texts = ["", None, "mination", "xtermination", "terminatio", "co py copy", "|_____|", "____", "||", "E-STAMP e-stam", "a", "baa", "è é", "é"]
    for w in words:
        assert one(lambda c, w=w: T.holds(c.cast("binary"), w), texts) == [None if t is None else w in t for t in texts]
    assert T.rare_tail("termination") == "mination" and T.rare_tail("copy") == "copy" and T.rare_tail("aa") == "aa"


def test_words_are_looked_up_until_enough_are_found(one):
    words = [f"w{k}x" for k in range(12)]
    texts = ["", "w1x w1x", "w0x w11x", "w0x w10x w11x", "w0xw1xw2x", " ".join(words)]
    assert one(lambda c: T.fewer_contained(c, words, 3), texts) == [True, True, True, False, False, False]
    assert one(lambda c: T.fewer_contained(c, [], 1), ["w0x"]) == [True]


def test_whitespace_of_all_kinds_is_trimmed(one):
    texts = [f"{a}{b}x{a} y{b}{a}" for a in T.WHITESPACE_CHARS for b in " " + T.WHITESPACE_CHARS[-3:]] + [T.WHITESPACE_CHARS, " \x1c\x85 x\x85"]
    blank = re.compile(f"[{re.escape(T.WHITESPACE_CHARS)}]+")
    assert one(T.normalize_whitespace, texts) == [blank.sub(" ", t).strip(" ") for t in texts]


def test_sections_break_at_each_noise_pattern(one):
    """Lines are marked as by all patterns at once; a literal that stands in one line marks no other."""
    lines = ["The tenant pays rent.", "STAMP PAPER", "page 3", "PAGE  3  of 9", "Government", "\u00a0", "7", "a [ 3 ] b", "[x]", "a||b", "lease\x02x", "e-stamp", "stamp", "Landlord   x", "PAN NO: 7", "the pan no"]
    noise = T.any_pattern([p for group in N.NOISE_PATTERNS.values() for p in group])
    marked = one(lambda c: (T.strip(c) == "") | c.rlike(noise), lines)
    assert 5 < sum(marked) < len(lines) - 3
    runs = re.split("\x01", "\n".join("\x01" if m else line for line, m in zip(lines, marked, strict=True)))
    keyword = re.compile("|".join(N.CONTRACT_KEYWORDS), re.I)
    want = []
    for run in runs:
        kept = [line for line in run.split("\n") if line]
        first = next((k for k, line in enumerate(kept) if keyword.search(line)), None)
        want += [] if first is None else ["\n".join(kept[first:])]
    assert one(CL.contract_sections, ["\n".join(lines)]) == [want]


def test_word_count_counts_edge_blanks(one):
    assert one(CL.word_count, ["a b", " a b ", ""]) == [2, 4, 1]


def test_postprocess(one):
    assert one(CL.postprocess_ocr_text, ["a | b ___ c", "abc", "ab\n cd"]) == ["a   b   c", "", "ab cd"]


def test_structure_header_footer_and_start(one):
    head = ["INDIA NON JUDICIAL", "STAMP PAPER no: 12", "x", "y"]
    body = ["filler"] * 4 + ["The lease starts"] + ["text"] * 10
    foot = ["Page 3"]
    lines = head + body + foot
    s = one(L.document_structure, ["\n".join(lines)])[0]
    n = len(lines)
    assert s["has_header"] and s["has_footer"] and s["has_table"]
    assert s["contract_start"] == 8
    assert s["body_start"] == max(int(n * 0.25), 6) and s["body_end"] == int(n * 0.95)
    empty = one(L.document_structure, ["no signal"])[0]
    assert (empty["contract_start"], empty["body_start"], empty["body_end"]) == (-1, 0, 1)


def brute_conservative(text):
    words, seen, out = N.LAYOUT_INDICATORS, 0, []
    stops = [re.compile(p, re.I) for p, _ in N.BODY_STOP_PATTERNS]
    for line in text.split("\n"):
        seen += any(w in line.lower() for w in words)
        noisy = any(p.search(line) for p in stops)
        if seen and not noisy and len(line.strip()) > 10:
            out.append(line)
        if seen > 5 and noisy:
            break
    return "\n".join(out)


def test_conservative_body_against_brute_force(one):
    texts = []
    pool = ["the lease runs long", "rent", "plain line here", "page 7 of it", "government of x", "", "party and party two", "short"]

    @settings(max_examples=150, deadline=None, database=None)
    @given(st.lists(st.sampled_from(pool), max_size=25))
    def collect(lines):
        texts.append("\n".join(lines))

    collect()
    assert one(L.conservative_body, texts) == [brute_conservative(t) for t in texts]


def test_body_noise_drops_stamp_lines_but_keeps_contract_capitals(one):
    text = "NAME OF OFFICER\nLEASE DEED FORM\nshort\nThis is an ordinary line.\n12/03/2021\nSerial No: 7 then Serial No: 8 follows"
    assert one(L.filter_body_noise, [text]) == ["LEASE DEED FORM\nThis is an ordinary line.\n then Serial No: 8 follows"]


def test_layout_filter_short_text_uses_the_whole(one):
    text = "Some words\nThe lease begins in May\nand ends in June next year"
    assert one(L.filter_layout_noise, [text, "", None]) == ["The lease begins in May\nand ends in June next year", "", ""]
