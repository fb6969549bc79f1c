"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or abstain on every document. Votes are counted by pattern over the
whole corpus (at most 3^labellers patterns), expectation-maximisation estimates how often each labeller gives each
vote for good and for bad documents, and every pattern gets a posterior. The posteriors of a bounded sample (at
most `most` documents, those with the smallest hash of doc_id) then train a logistic scorer over hashed word
shapes, words and binned statistics; the scorer judges every document. No given labels are used.

Null text is an empty text: every labeller abstains, and the score is the scorer's for a text without words.
Without documents, or where EM sees one kind of pattern only, the scorer is constant and keeps everything.
Rows with equal doc_id are judged one by one (the sample has at most `most` rows, too); other columns are ignored by
score() and kept by keep_good(). Empty input: no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, small_batches, texts, whole_text
from .textstats import FEATURES, statistics

#: Labellers: statistic, bad beyond, good within; a negative sign turns both round. Between the two they abstain.
LABELLERS = (
    ("symbol_rate", 1, 0.2, 0.03),
    ("mark_rate", 1, 0.15, 0.08),
    ("upper_rate", 1, 0.5, 0.15),
    ("bang_rate", 1, 0.25, 0.05),
    ("repeat_rate", 1, 0.45, 0.2),
    ("dup_line_rate", 1, 0.4, 0.25),
    ("distinct_rate", -1, 0.2, 0.45),
    ("ends_rate", -1, 0.4, 0.9),
)
#: Of texts with fewer words, only the labellers of symbols and capitals speak.
SHORT = 20
BITS = 18
KEEP_FROM = 0.5
#: Where the statistics are cut into bins for the scorer.
EDGES = (0.01, 0.03, 0.06, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.65, 0.8, 1.5)
BINNED = tuple(FEATURES.index(f) for f in ("symbol_rate", "dup_line_rate", "repeat_rate", "upper_rate", "digit_rate", "mark_rate", "bang_rate", "ends_rate", "distinct_rate"))
_SHAPE = bytes(ord("A") if 65 <= i < 91 else ord("a") if 97 <= i < 123 or i >= 128 else ord("0") if 48 <= i < 58 else i for i in range(256))


def votes(values: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    """Documents x labellers: 1 good, 0 bad, -1 none."""
    out = np.full((len(values), len(LABELLERS)), -1, np.int8)
    for j, (name, sign, bad, good) in enumerate(LABELLERS):
        v = sign * values[:, FEATURES.index(name)]
        out[v <= sign * good, j] = 1
        out[v > sign * bad, j] = 0
    out[n_words == 0] = -1
    out[np.ix_(n_words < SHORT, [n not in ("symbol_rate", "upper_rate", "bang_rate") for n, *_ in LABELLERS])] = -1
    return out


def expect_maximise(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of good for each vote pattern, and each labeller's vote rates by class (2 x labellers x 3)."""
    seen = np.stack([patterns == v for v in (-1, 0, 1)], 2).astype(float)  # patterns x labellers x vote
    bad, good = (patterns == 0).sum(1), (patterns == 1).sum(1)
    post = np.where(bad > 0, 0.1, np.where(good > 0, 0.9, 0.5))  # a heuristic speaks up for a reason
    weight = counts.astype(float)
    for _ in range(rounds):
        rates, prior = [], []
        for p in (1 - post, post):
            w = weight * p
            r = np.einsum("p,pjv->jv", w, seen) + 0.5
            rates.append(r / r.sum(1, keepdims=True))
            prior.append(w.sum() + 1)
        said = [np.log(q) + np.einsum("pjv,jv->p", seen, np.log(r)) for q, r in zip(prior, rates, strict=True)]
        new = 1 / (1 + np.exp(np.clip(said[0] - said[1], -50, 50)))
        done = np.abs(new - post).max() < 1e-6
        post = new
        if done:
            break
    return post, np.array(rates)


def hashed(data: bytes, values: tuple[float, ...]) -> tuple[list[int], list[float]]:
    """Places and weights of a text's features."""
    mask, shift = (1 << BITS) - 1, 1 / max(1, data.count(b" ") + data.count(b"\n") + 1)
    raw = np.frombuffer(data.translate(_SHAPE), np.uint8)
    runs = raw[np.concatenate(([True], raw[1:] != raw[:-1]))].tobytes() if len(raw) else b""
    at, weight = [], []
    for kind, found in ((b"s", Counter(runs.split())), (b"w", Counter(data.lower().split()))):
        seed = zlib.crc32(kind)
        at += [zlib.crc32(w, seed) & mask for w in found]
        weight += [c * shift for c in found.values()]
    for j in BINNED:
        at.append(zlib.crc32(b"%d:%d" % (j, sum(values[j] > e for e in EDGES))) & mask)
        weight.append(1.0)
    return at, weight


def _train(at: pa.ChunkedArray, weight: pa.ChunkedArray, target: np.ndarray, share: np.ndarray, rounds: int = 80) -> np.ndarray:
    """Logistic regression on soft targets, full-batch AdaGrad; the last weight is the bias."""
    row = np.repeat(np.arange(len(at), dtype=np.int32), pc.list_value_length(at).to_numpy())
    col, val = pc.list_flatten(at).to_numpy(), pc.list_flatten(weight).to_numpy()
    used, col = np.unique(col, return_inverse=True)
    w, past = np.zeros(len(used) + 1), np.full(len(used) + 1, 1e-8)
    for _ in range(rounds):
        m = np.bincount(row, w[col] * val, len(at)) + w[-1]
        g = share * (1 / (1 + np.exp(-m)) - target)
        grad = np.append(np.bincount(col, g[row] * val, len(used)), g.sum()) + 1e-6 * w
        past += grad**2
        w -= 0.5 * grad / np.sqrt(past)
    full = np.zeros((1 << BITS) + 1, np.float32)
    full[used], full[-1] = w[:-1], w[-1]
    return full


def _rows(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text("text").alias("text"))


def vote_counts(docs: DataFrame) -> DataFrame:
    """votes (a string of +, - and .), n: how often each pattern of votes occurs."""
    return _voted(docs).groupBy("votes").agg(F.count("*").alias("n"))


def _voted(docs: DataFrame) -> DataFrame:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            counts, values = zip(*map(statistics, texts(b.column(1))), strict=True)
            v = votes(np.array(values), np.array(counts)[:, 0])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(["".join(".-+"[x + 1] for x in r) for r in v.tolist()])], names=["doc_id", "votes"])

    return _rows(docs).mapInArrow(run, "doc_id long, votes string")


class Scorer:
    """What training leaves: weights of 2^BITS places and a bias, and the posteriors by vote pattern."""

    def __init__(self, weights: np.ndarray | None, posterior: dict[str, float], rates: np.ndarray | None):
        self.weights, self.posterior, self.rates = weights, posterior, rates

    def score(self, data: bytes, values: tuple[float, ...]) -> float:
        if self.weights is None:
            return 1.0
        at, weight = hashed(data, values)
        return float(1 / (1 + np.exp(-np.clip(self.weights[at] @ np.array(weight) + self.weights[-1], -50, 50))))


def train(docs: DataFrame, most: int = 4000) -> Scorer:
    found = [(r["votes"], r["n"]) for r in vote_counts(docs).collect()]  # at most 3 ** len(LABELLERS)
    found.sort()
    if not found:
        return Scorer(None, {}, None)
    patterns = np.array([[".-+".index(c) - 1 for c in v] for v, _ in found])
    post, rates = expect_maximise(patterns, np.array([n for _, n in found]))
    posterior = {v: float(p) for (v, _), p in zip(found, post, strict=True)}
    sample = docs.orderBy(F.xxhash64("doc_id"), "doc_id").select("doc_id").where("doc_id is not null").limit(most)
    got = _rows(docs.select("doc_id", "text").join(F.broadcast(sample.distinct()), "doc_id", "left_semi"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            data = texts(b.column(1))
            counts, values = zip(*map(statistics, data), strict=True)
            v = votes(np.array(values), np.array(counts)[:, 0])
            at, weight = zip(*map(hashed, data, values), strict=True)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(["".join(".-+"[x + 1] for x in r) for r in v.tolist()]), pa.array(at, pa.list_(pa.int32())), pa.array(weight, pa.list_(pa.float32()))], names=["doc_id", "votes", "at", "weight"])

    rows = got.mapInArrow(run, "doc_id long, votes string, at array<int>, weight array<float>")
    # an id may stand on any number of rows: the bound is one of rows
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "votes").limit(most).toArrow().sort_by([("doc_id", "ascending"), ("votes", "ascending")])
    target = np.array([posterior.get(v, 0.5) for v in rows["votes"].to_pylist()])
    if not len(target) or target.min() > 0.5 or target.max() < 0.5:
        return Scorer(None, posterior, rates)
    # both kinds weigh the same in training
    share = np.where(target >= 0.5, 1 / max(1, (target >= 0.5).sum()), 1 / max(1, (target < 0.5).sum())) * len(target) / 2
    return Scorer(_train(rows["at"], rows["weight"], target, share), posterior, rates)


def score(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """doc_id, votes, posterior (of the votes), score, kept."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)  # 2^BITS weights, whatever the input

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            data = texts(b.column(1))
            counts, values = zip(*map(statistics, data), strict=True)
            v = ["".join(".-+"[x + 1] for x in r) for r in votes(np.array(values), np.array(counts)[:, 0]).tolist()]
            s = np.array([shared.value.score(d, f) for d, f in zip(data, values, strict=True)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(v), pa.array([shared.value.posterior.get(x, 0.5) for x in v]), pa.array(s), pa.array(s >= KEEP_FROM)], names=["doc_id", "votes", "posterior", "score", "kept"])

    return _rows(docs).mapInArrow(run, "doc_id long, votes string, posterior double, score double, kept boolean")


def keep_good(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """The rows of docs that the scorer keeps, all columns as they are."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(scorer)
    names = docs.columns
    where = names.index("text")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, column=where):
            kept = [shared.value.score(d, statistics(d)[1]) >= KEEP_FROM for d in texts(b.column(where))]
            yield b.filter(pa.array(kept))

    return docs.mapInArrow(run, docs.schema)
