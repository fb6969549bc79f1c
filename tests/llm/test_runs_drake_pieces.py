"""Periodic runs, adaptive-bound clustering and SentencePiece against plain versions and the library."""

import hashlib
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blastradius.llm import drake, queries, runs, sentencepieces

from test_llm import EDGE, SCHEMA, SF


@pytest.fixture(scope="module")
def edge(spark):
    rows = spark.createDataFrame(EDGE, SCHEMA)
    return rows.withColumns({c: F.lit("clash") for c in ("start", "runs", "ids", "x", "cluster", "n", "length")}).repartition(3)


@pytest.fixture(scope="module")
def model():
    with open(queries.tokenizer_path("piece_bpe_32k.model"), "rb") as f:
        return f.read()


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


# 11. periodic runs


def plain_runs(ws, least=12):
    """Every period tried on its own: stretches of words equal to the one a period further on."""
    n, out = len(ws), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if ws[i] != ws[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and ws[j] == ws[j + q]:
                j += 1
            size, some = j - i + q, ws[i : j + q]
            if size >= max(least, 2 * q) and not any(some[d:] == some[: size - d] for d in range(1, q)):
                out.append((i, size, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_digest(doc_id, text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(ws), 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        ws = [ws[i] if i < a else ws[a + (i - a) % p] for i in range(n)]
    found = plain_runs(ws)
    dropped = {i for s, size, q in found for i in range(s + q, s + size)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None,) * 3
    milli = 1000 * best[1] // best[2] if found else None
    return (doc_id, len(found), *best, milli, sha("".join(f"{s},{size},{q}\n" for s, size, q in found)), sha(" ".join(w for i, w in enumerate(ws) if i not in dropped)))


def test_op11(spark, edge):
    order = lambda rows: sorted(map(tuple, rows), key=repr)
    assert order(runs.digests(edge).collect()) == order(plain_digest(i, t) for i, t, *_ in EDGE)
    assert runs.digests(edge.limit(0)).collect() == []
    told = {i: (found, kept) for i, found, kept in runs.collapse(edge.where("doc_id in (6, 10)")).collect()}
    assert [tuple(r) for r in told[6][0]] == [(0, 240, 4)] and told[6][1] == "one two three four" and told[10][1] == "1"


def test_op11_query(spark):
    """The registered query, over every text that the plain version (its time is quadratic) can try: those of up to 500 words."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    small = {r.doc_id: r.text for r in docs.collect() if len((r.text or "").split()) <= 500}
    got = {r.doc_id: tuple(r) for r in queries.op11_periodic_runs(spark, SF).collect()}
    assert len(got) == docs.count() and len(small) > 100 and sum(r[1] for r in got.values()) > 0
    assert {i: got[i] for i in small} == {i: plain_digest(i, t) for i, t in small.items()}


@pytest.mark.parametrize("wide", [1, 3, 8])
def test_op11_random(monkeypatch, wide):
    """Few letters, periodic parts and Fibonacci words; several texts together share no class."""
    monkeypatch.setattr(runs, "WIDE", wide)
    r = random.Random(wide)
    fib = [["a"], ["a", "b"]]
    while len(fib[-1]) < 80:
        fib.append(fib[-1] + fib[-2])
    for _ in range(300):
        cut = []
        for _ in range(r.randrange(1, 4)):
            n = r.randrange(0, 60)
            ws = [str(r.randrange(r.choice([1, 2, 3]))) for _ in range(n)]
            if r.random() < 0.5 and n > 4:
                a, p = r.randrange(n), 1 + r.randrange(n // 2)
                ws = [ws[i] if i < a else ws[a + (i - a) % p] for i in range(n)]
            cut.append([w.encode() for w in (fib[-1] if r.random() < 0.1 else ws)])
        least = r.choice([2, 4, 12])
        got, stays = runs.detect(cut, least)
        want = [plain_runs(ws, least) for ws in cut]
        assert [[tuple(x) for x in g.tolist()] for g in got] == want
        dropped = [{i for s, size, q in w for i in range(s + q, s + size)} for w in want]
        assert stays.tolist() == [i not in d for ws, d in zip(cut, dropped, strict=True) for i in range(len(ws))]


def test_op11_touches_few_positions():
    """Of a text of one word every length costs one position, not all."""
    got, stays = runs.detect([[b"a"] * 50_000], 12)
    assert got[0].tolist() == [[0, 50_000, 1]] and stays.sum() == 1


# 12. clustering


def plain_clusters(rows, k, rounds, width):
    kept = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and np.isfinite(x) for x in v)]
    places = [x for _, x in sorted(kept, key=lambda r: (sha(f"3:{'' if r[0] is None else r[0]}"), r[1]))[:k]]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    assign = lambda: [min((square(x, c), j) for j, c in enumerate(places)) for _, x in kept]
    for _ in range(rounds):
        near = assign()
        for j in range(len(places)):
            if own := [x for (_, x), (_, c) in zip(kept, near, strict=True) if c == j]:
                places[j] = [sum(xs) // len(own) for xs in zip(*own, strict=True)]
    near = assign()
    inertia = [sum(d for d, c in near if c == j) for j in range(len(places))]
    return [(i, c, d, inertia[c], sum(inertia), sha(",".join(map(str, places[c])))) for (i, _), (d, c) in zip(kept, near, strict=True)]


VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType()))])


@pytest.mark.parametrize("k", [1, 2, 5, 8, 30])
def test_op12_random(spark, k):
    """Ties on a coarse grid, repeated rows and ids, null ids, vectors that are left out, clashing columns, a hot cluster."""
    r = random.Random(k)
    rows = [(r.choice([None, *range(40)]), [r.choice([-2.0, 0.0, 0.5, 1.0, 3.0]) for _ in range(4)]) for _ in range(300)]
    rows += [(7, [0.25] * 4)] * 150 + [(1, None), (2, []), (3, [1.0] * 3), (4, [None, 1.0, 1.0, 1.0]), (5, [float("nan"), 0.0, 0.0, 0.0]), (6, [float("inf"), 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, VECTORS).withColumns({c: F.lit("clash") for c in ("x", "cluster", "distance", "n", "centroid", "upper")}).repartition(3)
    order = lambda found: sorted(map(tuple, found), key=repr)
    assert order(drake.digests(df, k=k, width=4).collect()) == order(plain_clusters(rows, k, 10, 4))


def test_op12_few_and_none(spark):
    df = spark.createDataFrame([(1, [1.0] * 4), (2, [2.0] * 4)], VECTORS)
    assert {r.vec_id: r.distance for r in drake.digests(df, width=4).collect()} == {1: 0, 2: 0}
    assert drake.digests(df.limit(0), width=4).collect() == []
    assert drake.digests(df.where("vec_id = 1"), width=4).columns == drake.digests(df.limit(0), width=4).columns


def test_op12_bounds_spare_distances(spark):
    """On separate groups most distances are never computed."""
    r = random.Random(2)
    rows = [(i, [float(i % 8 == j) * 8 + r.random() for j in range(8)]) for i in range(800)]
    found = drake.cluster(spark.createDataFrame(rows, VECTORS), width=8)
    assert found.agg(F.avg("computed")).first()[0] < 0.5 * 8 * 11


def test_op12_bounds_hold():
    """After moves of centroids, every lower bound is below the exact distance, every upper one above."""
    rng = np.random.default_rng(4)
    x, places = rng.integers(-500, 500, (200, 6)), rng.integers(-500, 500, (9, 6))
    s = drake.Bounds(x, 9)
    s.assign(places)
    for _ in range(12):
        moved = places + rng.integers(-30, 31, places.shape)
        s.move(np.sqrt(drake.squares(moved, places).astype(float)))
        places = moved
        s.assign(places)
        d = np.stack([drake.squares(x, c) for c in places], 1)
        assert (s.cluster == d.argmin(1)).all()
        exact = np.sqrt(d.astype(float))
        at = np.arange(200)
        assert (s.upper >= exact[at, s.cluster]).all() and (s.lower <= exact[at[:, None], s.near]).all()
        listed = np.zeros(d.shape, bool)
        listed[at, s.cluster] = True
        listed[at[:, None], s.near] = True
        assert (s.rest <= np.where(listed, np.inf, exact).min(1)).all()


def test_op12_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS FROM '{SF}/embeddings.parquet'")
    got = queries.op12_drake_clusters(spark, SF)
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({queries.ORACLE_SQL['op12_drake_clusters']})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) == 500


# 13. SentencePiece


def test_op13(spark, edge, model):
    """Every batch of the tables and of the edge rows is held against the library in the job itself."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = sentencepieces.encode_digests(docs, model, check=True)
    assert sorted(got.collect()) == sorted(queries.op13_sentencepiece_encode_decode(spark, SF).collect())
    coded = sentencepieces.encode(edge, model, check=True).collect()
    assert sorted((repr(r.doc_id), r.decoded) for r in coded) == sorted((repr(i), t or "") for i, t, *_ in EDGE)
    assert sentencepieces.encode(edge.limit(0), model).collect() == []
    back = sentencepieces.decode(sentencepieces.encode(docs, model), model)
    assert {r.doc_id: r.text for r in back.collect()} == {r.doc_id: r.text or "" for r in docs.collect()}
    with pytest.raises(Exception, match="differs from the library"):
        sentencepieces.hold_against_library(sentencepieces.Pieces(model).library, ["a"], [(b"", b"")])


def test_op13_random(model):
    coder, r = sentencepieces.Coder(model), random.Random(3)
    library = coder.pieces.library
    letters = "ab  ▁\t\n\r.,<s>/é́日本ﬁ①​\0�\U0001f600'0x0A\x85　\U0010ffff"
    some = ["".join(r.choice(letters) for _ in range(r.randrange(14))) for _ in range(4000)]
    sentencepieces.hold_against_library(library, some, [coder.code(t) for t in some])
    for _ in range(4000):
        ids = [r.choice([r.randrange(259), 28705, 264, 259, r.randrange(32_000)]) for _ in range(r.randrange(8))]
        assert coder.pieces.text(ids) == library.decode(ids)


def test_op13_cuts_hold_no_piece(model):
    p = sentencepieces.Pieces(model)
    for piece in p.id:
        assert p.cut(piece) == [piece]
    assert p.cut("▁a.\n▁▁b") == ["▁a", ".", "\n", "▁▁b"] and p.cut("") == []


def test_op13_forgets(model, monkeypatch):
    monkeypatch.setattr(sentencepieces, "REMEMBERED", 3)
    coder = sentencepieces.Coder(model)
    some = [f"word{i} and more" for i in range(20)]
    sentencepieces.hold_against_library(coder.pieces.library, some, [coder.code(t) for t in some])
    assert len(coder.known) < 12


# what the operators leave behind


def test_scratch_is_one_threads_own(spark):
    """Two queries at once: the end of one's scratch() leaves the other's tables."""
    from concurrent.futures import ThreadPoolExecutor

    from blastradius.llm.common import scratch, stash

    def one(_):
        with scratch(spark) as keep:
            first = stash(spark.range(20), "first")
            second, path = keep(first.where("id < 9"), "second")
            assert first.count() == 20
        return second.count(), path

    with ThreadPoolExecutor(4) as pool:
        found = list(pool.map(one, range(8)))
    assert [n for n, _ in found] == [9] * 8 and len({p for _, p in found}) == 8


def test_scratch_deletes_what_it_does_not_keep(spark):
    from blastradius.llm.common import scratch, stash

    with scratch(spark):
        gone = stash(spark.range(3), "gone")
        path = gone.inputFiles()[0].removeprefix("file://")
        assert os.path.exists(path)
    assert not os.path.exists(path)
