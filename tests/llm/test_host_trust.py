"""URL rules and trust of hosts against plain Python: rules one by one, PageRank as a matrix."""

import re

import numpy as np
import pytest

from pactlens.llm import host_trust as ht

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    return host.translate(LOWER), re.split(r"[?#]", rest[len(host):], maxsplit=1)[0]


def rule_of(host, path, rules):
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return min(fits, key=lambda r: (-len(r.text), r.text)) if fits else None


def direct(rows, rules=ht.RULES):
    seen = [(page, *parts(url), html or "") for page, url, html in rows]
    by = [rule_of(h, p, rules) for _, h, p, _ in seen]
    weights, hosts = {}, {h for _, h, _, _ in seen if h}
    for _, h, _, html in seen:
        for dst in {parts("x:" + u[u.index("//") :])[0] for u in re.findall(ht.LINK, html)}:
            if dst:
                hosts.add(dst)
            if h and dst and h != dst:
                weights[h, dst] = weights.get((h, dst), 0) + 1
    ties = set()
    for h in list(hosts):
        labels = h.split(".")
        if not re.fullmatch(r"[0-9.:]+", h):
            for k in range(len(labels) - 2):
                ties.add((".".join(labels[k:]), ".".join(labels[k + 1 :])))
    for a, b in ties:
        for e in ((a, b), (b, a)):
            weights[e] = weights.get(e, 0) + ht.DOMAIN_WEIGHT
    names = sorted(hosts | {x for e in weights for x in e})
    at = {h: k for k, h in enumerate(names)}
    m = np.zeros((len(names), len(names)))
    for (a, b), w in weights.items():
        m[at[a], at[b]] = w
    along = m / np.maximum(m.sum(axis=1, keepdims=True), 1e-300)
    back = m.T / np.maximum(m.sum(axis=0)[:, None], 1e-300)
    good, bad = np.zeros(len(names)), np.zeros(len(names))
    for h in hosts:
        if set(re.split("[.-]", h)) & set(ht.BLOCKED_WORDS):
            bad[at[h]] = 1.0
    for h in {h for _, h, _, _ in seen if h}:
        of = [r for (_, x, _, _), r in zip(seen, by, strict=True) if x == h]
        good[at[h]] = sum(r is not None and r.allow for r in of) / len(of)
        bad[at[h]] = bad[at[h]] or sum(r is not None and not r.allow for r in of) / len(of)
    keep = 1 - ht.DAMPING
    t, d = keep * good, keep * bad
    for _ in range(ht.STEPS):
        t, d = keep * good + ht.DAMPING * t @ along, keep * bad + ht.DAMPING * d @ back
    out = []
    for (page, h, p, _), r in zip(seen, by, strict=True):
        trust, distrust = (t[at[h]], d[at[h]]) if h else (None, None)
        verdict = ("allow" if r.allow else "block") if r else "block" if h and distrust >= ht.BLOCK_AT and distrust > trust else "allow"
        out.append((page, h, p, r.text if r else None, verdict, trust, distrust))
    return sorted(out, key=str)


def check(df, rows, rules=ht.RULES):
    got = [tuple(r) for r in ht.judge_pages(df, rules).collect()]
    want = direct(rows, rules)
    assert sorted((g[:5] for g in got), key=str) == sorted((w[:5] for w in want), key=str)
    ranks = {g[1]: g[5:] for g in got}
    for _, h, _, _, _, trust, distrust in want:
        assert ranks[h] == (None, None) if trust is None else ranks[h] == pytest.approx((trust, distrust), abs=2e-9)
    return {g[1]: g[4] for g in got}


@pytest.fixture(scope="module")
def linked():
    """Pages that link to other hosts: a farm that links to blocked hosts, a host that good ones link to, and a chain."""
    rows = [(k, f"http://farm{k % 3}.com/x/{k}", f'<a href="https://cheap-pills.biz/{k}">a</a> <A HREF=//casino-win.biz>b</A> <a class=c href=\'/own\'>c</a>') for k in range(12)]
    rows += [(100 + k, f"https://a{k}.example.net/en/{k}?q#f", '<a href="http://Good.com/p">x</a><a href="http://good.com/q">y</a><a href="#z">z</a>') for k in range(6)]
    rows += [(200, "http://good.com/p", '<a href="http://farm0.com/">f</a>'), (201, "http://linker.com/", "<a\nhref='http://farm1.com/a'>"), (202, "http://far.com/", "<a href=http://linker.com>")]
    return rows


def test_links_spread_trust_and_distrust(spark, linked):
    df = spark.createDataFrame(linked, "page_id long, url string, html string").repartition(3)
    verdicts = check(df, linked)
    assert verdicts["farm0.com"] == verdicts["farm1.com"] == "block" and verdicts["good.com"] == "allow" and verdicts["far.com"] == "allow"


def test_odd_rows(spark):
    rows = [
        (1, None, None), (1, None, None), (2, "", ""), (3, "no scheme example.net/en/", "x"), (4, "://", "<a href=''>"), (5, "http://EXAMPLE.net", None),
        (6, "http://example.net/en/", None), (7, "http://x.EXAMPLE.NET/en/a?b#c", ""), (8, "http://example.net/EN/", ""), (9, "http://notexample.com/de/", ""),
        (10, "http://example.com/de/x", ""), (11, "a://b://c/d", ""), (12, "http://h\nost/a\nb?c", ""), (13, "http://1.2.3.4:80/de/", ""), (14, "http://org/fr/", ""),
        (None, "http://é.ÉÉ.example.com/de/é", "<a href=\"http://É.com/\">"), (15, "http://net/", ""), (16, "http://.net/", ""), (17, "http://a..net/", ""),
        (18, "http://" + "long." * 300 + "com/x", ""), (19, "http://example.com/" + "p" * 100_000, "<a href='//'>" * 1000), (6, "http://example.net/en/", None),
    ]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, host string, n long").repartition(3)
    check(df, rows)
    assert ht.judge_pages(df.filter("false")).count() == 0


def test_ties_of_rules_and_many_rules(spark, linked):
    rules = [ht.Rule("com", "/x/", True), ht.Rule("farm0.com", "/", False), ht.Rule("farm1.com", "/", True), ht.Rule("m", "/xx/xx/", False), ht.Rule("com", "/x/1", False)]
    rows = linked + [(300, "http://b.m/xx/xx/", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    many = rules + [ht.Rule(f"h{k}.info", "/", False) for k in range(ht.BROADCAST_RULES)]
    check(df, rows, many)
    assert ht.rules_of_hosts(df.select(ht.host_of(df["url"]).alias("host")), []).count() == 0


def test_given_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    check(pages, [(r["page_id"], r["url"], r["html"]) for r in pages.select("page_id", "url", "html").collect()])


def test_edges_of_a_hub_are_dealt(spark):
    """A host with more edges than a part holds passes on the same shares."""
    edges = spark.createDataFrame([("hub", f"h{k}", 1.0) for k in range(50)] + [(f"h{k}", "hub", 2.0) for k in range(20)], "src string, dst string, weight double")
    seeds = spark.createDataFrame([("hub", 1.0, 0.0), ("h7", 0.0, 1.0)], "host string, good double, bad double")
    one, many = (sorted(map(tuple, ht.propagate(seeds, edges, steps=4, part_edges=n).collect())) for n in (1000, 3))
    assert one == many and len(one) == 51
    assert max(r["part"] for r in ht.moves_of(edges, 3)[0].collect()) > 10
