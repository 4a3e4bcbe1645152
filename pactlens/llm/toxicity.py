"""Toxicity by weak supervision.

Many weak voters look at a text: words and word beginnings of a mined lexicon, each with the rate from which it votes, and surface
patterns.  A generative label model estimates by expectation-maximisation how accurate each voter is and how voters go together; the
given labels are one more noisy voter.  Correlated voters share their weight.  A linear classifier is trained on the posterior labels and
scores every whole text.

Learning reads a bounded sample of labelled rows (TRAIN_ROWS); a lexicon entry is chosen only where it explains toxic rows that earlier
entries don't.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactlens.llm.arrow import mapped
from pactlens.llm.common import fresh, materialize
from pactlens.llm.training import TRAIN_ROWS, held_out, training_rows

LETTERS = re.compile(r"[^\W\d_]+")
#: Lengths of word beginnings; entries that are looked at closely; entries of the lexicon; documents that an entry must explain.
BEGINNINGS, LOOKED_AT, ENTRIES, LEAST_NEW = (3, 4, 5, 6), 400, 48, 4
THRESHOLD = 0.3
#: An entry is taken while it explains rows that fewer than so many entries explain.
DEPTH = 3
#: One voter of its own: any of these common insults.
SEEDS = (
    "idiot idiots moron morons stupid scum loser losers clown trash pathetic worthless disgusting dumb filthy vermin jerk fool garbage ugly "
    "imbecile bastard creep freak parasite"
).split()
#: Characters that vote by their rate per word.
PATTERNS = {"shout": "!", "symbols": "#*$%&|<>", "question": "?"}


def entries_of(words: list[str]) -> set[str]:
    """Lexicon candidates of a text: its words, and their beginnings marked by a star."""
    distinct = set(words)
    return distinct.union(*({f"{w[:k]}*" for w in distinct if len(w) > k} for k in BEGINNINGS)) if distinct else distinct


def spread(text: str) -> tuple[str, int]:
    """The lower-case words between double spaces, which makes counting of ' word ' and ' beginning' exact, and their number."""
    words = LETTERS.findall(text.lower())
    return f" {'  '.join(words)} ", len(words)


def rates(text: str, entries: list[str] | tuple[str, ...]) -> list[float]:
    """Of each entry, then the seeds together, then each pattern, the occurrences per word."""
    line, n = spread(text)
    per = 1.0 / max(n, 1)
    out = [line.count(f" {e[:-1]}" if e.endswith("*") else f" {e} ") * per for e in entries]
    out.append(sum(line.count(f" {e} ") for e in SEEDS) * per)
    return out + [sum(text.count(c) for c in p) * per for p in PATTERNS.values()]


@dataclass(frozen=True)
class Model:
    entries: tuple[str, ...] = ()
    limits: tuple[float, ...] = ()  # from which rate an entry, the seeds or a pattern vote
    weights: tuple[float, ...] = ()  # of votes, of rates in units of their limit, and the constant
    accuracies: tuple[float, ...] = ()
    correlated: tuple[int, ...] = ()  # voters that go together with each one, itself included

    def scores(self, texts: list[str]) -> np.ndarray:
        if not self.weights or not texts:
            return np.zeros(len(texts))
        x = features(np.array([rates(t, self.entries) for t in texts]), np.array(self.limits))
        return sigmoid(x @ np.array(self.weights))


def features(r: np.ndarray, limits: np.ndarray) -> np.ndarray:
    share = r / limits
    return np.concatenate([(share >= 1).astype(float), np.minimum(share, 2.0), np.ones((len(r), 1))], axis=1)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def _candidates(rows: DataFrame, most: int) -> list[str]:
    """The entries with the highest weight of evidence, over the rows to learn from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("entry", pa.string()), ("y", pa.int32()), ("n", pa.int64())])
        for batch in batches:
            seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True):
                seen[int(y > 0)].update(entries_of(LETTERS.findall((text or "").lower())))
                seen[int(y > 0)][""] += 1
            rows = [(e, y, n) for y, c in seen.items() for e, n in c.items()]
            yield pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema) if rows else pa.RecordBatch.from_pydict({f.name: [] for f in schema}, schema)

    counts = rows.select("text", "y").mapInArrow(run, "entry string, y int, n long").groupBy("entry").agg(
        F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("bad"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("good")
    )
    counts = materialize(counts.filter(F.col("bad") >= LEAST_NEW), "entries")
    total = counts.filter(F.col("entry") == "").first()
    if total is None:
        return []
    lift = F.log((F.col("bad") + 0.5) / (total["bad"] + 1.0)) - F.log((F.col("good") + 0.5) / (total["good"] + 1.0))
    best = counts.filter((F.col("entry") != "") & (lift > 0.7)).select("entry", (lift * F.col("bad")).alias("weight"))
    return [r["entry"] for r in best.orderBy(F.desc("weight"), "entry").limit(most).collect()]


def _limit(r: np.ndarray, y: np.ndarray) -> float:
    """The rate from which most is gained by calling a row toxic: toxic rows less twice the clean ones."""
    by = np.argsort(-r, kind="stable")
    r, gain = r[by], np.cumsum(np.where(y[by] > 0, 1.0, -2.0))
    ends = np.append(r[1:] != r[:-1], True) & (r > 0)
    if not ends.any() or gain[ends].max() <= 0:
        return np.inf
    k = np.flatnonzero(ends)[np.argmax(gain[ends])]
    return float((r[k] + (r[k + 1] if k + 1 < len(r) else 0.0)) / 2) or float(r[k])


def choose(r: np.ndarray, y: np.ndarray, most: int, least: int) -> tuple[list[int], list[float]]:
    """Columns taken one after another, each for the toxic rows that it explains and fewer than DEPTH before it did."""
    limits = np.array([_limit(r[:, j], y) for j in range(r.shape[1])])
    votes = r >= limits
    value = np.where(y > 0, 1, -1).astype(np.int8)[:, None] * votes
    explained = np.zeros(len(y), int)
    taken: list[int] = []
    while len(taken) < most and r.shape[1]:
        gain = value[explained < DEPTH].sum(axis=0, dtype=np.int64)
        j = int(np.argmax(gain))
        if gain[j] < least:
            break
        taken.append(j)
        both, either = (votes & votes[:, [j]]).sum(axis=0), (votes | votes[:, [j]]).sum(axis=0)
        value[:, both > 0.8 * either] = 0  # it and its like
        explained += votes[:, j]
    return taken, [float(limits[j]) for j in taken]


def label_model(votes: np.ndarray, labels: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posterior of each row, accuracy of each voter, number of voters correlated with each) by expectation-maximisation.

    A voter votes or keeps silent, with one rate for toxic and one for clean rows; the labels are the last voter.  A voter's correlated
    companions are those whose votes go together (over 0.5) among toxic rows, and its evidence counts as its share of the group.  Among
    clean rows hardly any voter votes, and the few toxic rows that are labelled clean would make all of them look alike.
    """
    v = np.concatenate([votes.astype(float), labels[:, None].astype(float)], axis=1)
    p = labels.astype(float) * 0.9 + 0.05
    groups = np.ones(v.shape[1])
    on1 = on0 = np.full(v.shape[1], 0.5)
    for _ in range(rounds):
        w1, w0 = p.sum() + 2.0, (1 - p).sum() + 2.0
        on1, on0 = (p @ v + 1.0) / w1, ((1 - p) @ v + 1.0) / w0
        c = v - on1
        cov = (c * p[:, None]).T @ c / max(p.sum(), 1.0)
        sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
        groups = np.maximum((cov / np.outer(sd, sd) > 0.5).sum(axis=1), 1)
        yes, no = np.log(on1 / on0), np.log((1 - on1) / (1 - on0))
        logit = np.log(w1 / w0) + (v * yes + (1 - v) * no) @ (1.0 / groups)
        p = sigmoid(logit)
    accuracy = (on1 * p.mean() + (1 - on0) * (1 - p.mean()))
    return p, accuracy, groups


def fit_linear(x: np.ndarray, p: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Logistic weights for soft labels by Newton's method; the constant (last column) isn't shrunk."""
    w = np.zeros(x.shape[1])
    shrink = np.full(x.shape[1], ridge)
    shrink[-1] = 1e-6
    for _ in range(rounds):
        s = sigmoid(x @ w)
        hessian = (x * (s * (1 - s))[:, None]).T @ x + np.diag(shrink)
        step = np.linalg.solve(hessian, x.T @ (s - p) + shrink * w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Without labelled rows of both kinds the model scores every text 0."""
    known = materialize(training_rows(docs, labels, "toxic", rows), "toxicity-training")
    found = _candidates(known, LOOKED_AT)

    def make():
        def work(batch: pa.RecordBatch) -> dict[str, list]:
            return {"r": [np.array(rates(t or "", found), np.float32).tobytes() for t in batch.column("text").to_pylist()]}

        return work

    sample = mapped(known, make, "r binary", keep=["doc_id", "y"]).orderBy("doc_id").collect()  # at most `rows` rows of some 1.6 KB
    y = np.array([x["y"] for x in sample], int)
    if not len(y) or y.min() == y.max():
        return Model()
    r = np.frombuffer(b"".join([x["r"] for x in sample]), np.float32).reshape(len(y), -1)
    del sample
    taken, limits = choose(r[:, : len(found)], y, ENTRIES, LEAST_NEW)
    columns = taken + list(range(len(found), r.shape[1]))
    some = [r[:, j][r[:, j] > 0] for j in columns[len(taken) :]]
    # the seeds vote wherever they occur, a pattern where its rate is high
    others = [float(x.min() if k == 0 else np.quantile(x, 0.9)) if len(x) else 1.0 for k, x in enumerate(some)]
    r, all_limits = r[:, columns].astype(float), np.array(limits + others)
    posterior, accuracy, groups = label_model(r >= all_limits, y)
    weights = fit_linear(features(r, all_limits), posterior)
    return Model(tuple(found[j] for j in taken), tuple(all_limits), tuple(weights), tuple(accuracy), tuple(int(g) for g in groups))


def with_scores(docs: DataFrame, model: Model, name: str) -> DataFrame:
    """The rows of `docs` with a score of their whole text under `name`."""

    def make():
        def work(batch: pa.RecordBatch) -> dict[str, list]:
            return {name: model.scores([t or "" for t in batch.column("text").to_pylist()])}

        return work

    return mapped(docs, make, f"`{name}` double")


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    A missing or empty text has no votes and gets the score of such a text.  Rows are scored one by one: ties and repeated rows have equal
    scores, a missing doc_id stays missing and isn't held out, further columns don't matter, and an empty table gives an empty result.
    """
    model = train(docs, labels)
    scored = with_scores(docs.select(docs["doc_id"], docs["text"].alias("text")), model, "score")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The input rows that aren't predicted toxic, with all their columns."""
    name = fresh(docs, "toxicity_score")
    return with_scores(docs, train(docs, labels), name).filter(F.col(name) < threshold).drop(name)
