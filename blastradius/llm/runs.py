"""Periodic runs of words, by Crochemore's partition refinement.

Positions of a text are held in classes of equal factors: those of length l+1 come from those of length l. Where two
neighbouring members of a class lie exactly l apart, the text has a square of that period there (a primitive one, since
a shorter period would put another member between them). Squares of one period at consecutive positions are one run.

The first WIDE lengths, at which most positions are alive, are refined for all texts of an Arrow batch at once with numpy. A position
whose factor occurs once in its text is in no class from then on. What is left (repeated passages and periodic parts)
is refined by the smaller half: when a class is split, all its parts but the largest split the classes before them, so that a
position is touched only as often as its part can be halved, n log n times in all. A list through the members
of each class gives neighbours; each new distance waits in a bucket until the length has come to it.

Null text has no words. A null doc_id takes part in no edit. Rows with equal doc_id are independent, repeated rows give
repeated results, other columns are ignored whatever their names, and an empty table gives no rows. Texts are read whole, in memory in proportion to one
batch (a single text may exceed BATCH). Bytes that are not UTF-8 are kept as they are.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, compress, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from .common import batches, small_batches, texts, whole_text

#: Factor lengths that are refined in numpy, all texts of a batch at once.
WIDE = 8
#: Bytes of text refined together.
BATCH = 2 << 20
#: A run has at least so many words, and two periods.
LEAST = 12


def squares(words: np.ndarray, ends: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """(positions, period) of all primitive squares. words: ids, no id in two texts; ends: where the text of a position ends."""
    found = []
    alive, kind = np.arange(len(words)), words.astype(np.int64)
    for length in range(1, WIDE + 1):
        # classes of factors of this length, members in order of position
        order = np.argsort(kind, kind="stable")
        alive, kind = alive[order], kind[order]
        same = kind[1:] == kind[:-1]
        found.append((alive[:-1][same & (np.diff(alive) == length)], length))
        many, starts = np.zeros(len(kind), bool), np.ones(len(kind), bool)
        many[1:] |= same
        many[:-1] |= same
        starts[1:] = ~same
        alive, kind = alive[many], np.cumsum(starts)[many]
        if length == WIDE or not len(alive):
            break
        # a longer factor is a factor and the one a word further on, if that is in a class as well
        of = np.zeros(len(words) + 1, np.int64)
        of[alive] = kind
        alive = np.sort(alive)
        on = of[alive + 1] > 0
        alive = alive[on]
        kind = of[alive] * (len(words) + 1) + of[alive + 1]
    return found + (_refine(alive, kind, ends, WIDE) if len(alive) else [])


def _refine(alive: np.ndarray, kind: np.ndarray, ends: np.ndarray, length: int) -> list[tuple[np.ndarray, int]]:
    """Squares of periods above `length`, from its classes: members of one are consecutive in alive, in order of position."""
    ends = ends.tolist()
    order = alive.tolist()
    cls = dict(zip(order, kind.tolist(), strict=True))
    head, size, after, before = {}, {}, {}, {}
    waiting: dict[int, list[int]] = defaultdict(list)
    last = None
    for p in order:
        c = cls[p]
        if c not in head:
            head[c], size[c], last = p, 1, None
        else:
            size[c] += 1
        if last is not None:
            after[last] = p
            if p - last > length and p + p - last <= ends[p]:
                waiting[p - last].append(last)
        before[p], after[p] = last, None
        last = p
    new = count(max(size) + 1).__next__
    # at first every class splits those before it; a position in no class is one of its own
    groups = defaultdict(list)
    for p in sorted(order):
        n = p + 1
        groups[cls[n] if n in cls else -n].append(n)
    split, found = list(groups.values()), []
    while split:
        parts: dict[int, list[int]] = defaultdict(list)  # of a class: the classes split off
        members: dict[int, list[int]] = {}
        for group in split:
            touched = defaultdict(list)
            for n in group:
                c = cls.get(n - 1)
                if c is not None:
                    touched[c].append(n - 1)
            for c, some in touched.items():
                if len(some) == size[c]:
                    continue  # all that is left of it
                made, previous = new(), None
                members[made] = some
                parts[c].append(made)
                head[made], size[made] = some[0], len(some)
                size[c] -= len(some)
                for p in some:
                    a, b = before[p], after[p]
                    if a is None:
                        head[c] = b
                    else:
                        after[a] = b
                    if b is not None:
                        before[b] = a
                        if a is not None and b - a > length and b + b - a <= ends[b]:
                            waiting[b - a].append(a)
                    cls[p] = made
                    before[p], after[p] = previous, None
                    if previous is not None:
                        after[previous] = p
                        if p - previous > length and p + p - previous <= ends[p]:
                            waiting[p - previous].append(previous)
                    previous = p
        length += 1
        split = []
        for c, made in parts.items():
            kinds = [c, *made]
            largest = max(kinds, key=size.__getitem__)
            for k in kinds:
                some = members.get(k)
                if k != largest and some is None:
                    some, p = [], head[k]
                    while p is not None:
                        some.append(p)
                        p = after[p]
                if k != largest:
                    split.append(some)
                if size[k] == 1:
                    del cls[head[k]]  # in no class from now on
        starts = sorted({p for p in waiting.pop(length, ()) if p in cls and after[p] == p + length})
        if starts:
            found.append((np.array(starts), length))
    return found


def find_runs(words: np.ndarray, ends: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, length, period of all maximal runs of at least `least` words, by start, then period."""
    found = squares(words, ends)
    at = np.concatenate([p for p, _ in found])
    period = np.repeat([q for _, q in found], [len(p) for p, _ in found])
    order = np.lexsort((at, period))
    at, period = at[order], period[order]
    first = np.ones(len(at), bool)
    first[1:] = (np.diff(at) != 1) | (np.diff(period) != 0)
    head = np.flatnonzero(first)
    tail = np.append(head, len(at))[1:] - 1
    start, period, length = at[head], period[head], at[tail] - at[head] + 2 * period[head]
    long = length >= least
    start, length, period = start[long], length[long], period[long]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def made_periodic(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """Of one text in ten, by checksum of its id, the words from some place on are made periodic: known runs for the registered query."""
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    n = len(words)
    if h is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def detect(cut: list[list[bytes]], least: int = LEAST) -> tuple[list[np.ndarray], np.ndarray]:
    """Of several texts' words: each one's runs (rows of start, length, period), and of all words whether they stay when each run keeps its first period only."""
    size = np.array([len(w) for w in cut], np.int64)
    ends = np.cumsum(size)
    begins = ends - size
    number: dict[bytes, int] = defaultdict(count().__next__)
    ids = np.fromiter(map(number.__getitem__, chain.from_iterable(cut)), np.int64, int(size.sum()))
    start, length, period = find_runs(np.repeat(np.arange(len(cut)), size) * (len(number) + 1) + ids, np.repeat(ends, size), least)
    change = np.zeros(len(ids) + 1, np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, start + length, -1)
    text = np.searchsorted(ends, start, side="right")
    rows = np.stack([start - begins[text], length, period], 1)
    return np.split(rows, np.searchsorted(text, np.arange(1, len(cut)))), np.cumsum(change)[:-1] == 0


def _told(runs: np.ndarray) -> tuple:
    """n_runs, then start, length, period and exponent of the longest run, and the digest of all."""
    digest = hashlib.sha256(b"".join(b"%d,%d,%d\n" % tuple(r) for r in runs.tolist())).hexdigest()
    if not len(runs):
        return 0, None, None, None, None, digest
    start, length, period = min(runs.tolist(), key=lambda r: (-r[1], r[0], r[2]))
    return len(runs), start, length, period, 1000 * length // period, digest


def _mapped(df: DataFrame, schema: pa.Schema, row, edit, least: int, id_col: str, text_col: str) -> DataFrame:
    small_batches(df.sparkSession)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, BATCH):
            cut = [t.split() for t in texts(b.column(1))]  # bytes split at exactly the six ASCII blanks
            if edit:
                cut = [edit(i, ws) for i, ws in zip(b.column(0).to_pylist(), cut, strict=True)]
            runs, stays = detect(cut, least)
            stays, at, out = stays.tolist(), 0, []
            for ws, found in zip(cut, runs, strict=True):
                kept = b" ".join(compress(ws, stays[at : at + len(ws)]) if len(found) else ws)
                at += len(ws)
                out.append(row(found, kept))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), list(schema)[1:], strict=True))], schema=schema)

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    return rows.mapInArrow(run, from_arrow_schema(schema))


def collapse(df: DataFrame, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, runs (array of start, length, period, in words), collapsed: the words that stay, joined by a blank."""
    run = pa.struct([pa.field(n, pa.int64()) for n in ("start", "length", "period")])
    schema = pa.schema([("doc_id", pa.int64()), ("runs", pa.list_(run)), ("collapsed", pa.string())])
    names = ("start", "length", "period")
    return _mapped(df, schema, lambda found, kept: ([dict(zip(names, r, strict=True)) for r in found.tolist()], kept.decode("utf-8", "replace")), None, least, id_col, text_col)


def digests(df: DataFrame, edit=made_periodic, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_runs, start, length, period, exponent_milli (of the longest run), runs_sha256, collapsed_sha256, after the edit of (doc_id, words)."""
    numbers = [(n, pa.int64()) for n in ("doc_id", "n_runs", "start", "length", "period", "exponent_milli")]
    schema = pa.schema([*numbers, ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())])
    return _mapped(df, schema, lambda found, kept: (*_told(found), hashlib.sha256(kept).hexdigest()), edit, least, id_col, text_col)
