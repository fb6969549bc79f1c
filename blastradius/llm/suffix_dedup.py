"""Exact removal of repeated byte strings by prefix-free parsing.

Parsing. A rolling hash is taken of every W-byte string; in every window of LENGTH bytes the smallest hash (the last
of equals) is the window's trigger. Windows with one trigger are a run, and the bytes that they span are the trigger's
phrase. Equal windows have equal triggers at equal places, so windows are compared among phrases of one trigger only,
and no phrase has to be compared with another trigger's.

Dictionary and parse. The dictionary holds the distinct phrases of every trigger string, each with the place in the
corpus where it comes first; the parse is each document's sequence of phrases, computed anew where it is needed.
 - A trigger string of one document and one phrase has no window in common with others.
 - A trigger string with one phrase (copies of a longer passage): every window repeats but those of its first place.
 - A trigger string with several phrases is contested: its dictionary is put into suffix order. A suffix that starts
   k bytes before the trigger is a suffix of what precedes the trigger, followed by what the parse goes on with. So two
   suffix arrays are enough for all k: one of the phrases from the trigger on (the parse's continuation), one of what
   precedes the trigger, read backwards (the dictionary's suffixes). Neighbours' common prefixes give each suffix a
   pair of ranks, and suffixes with equal pairs are equal to LENGTH bytes: neighbours in corpus order. Of each such
   group the first place stays.
 A trigger string with more than FEW phrases is too large to be put in order at once: there each suffix of the dictionary
 is a row under two 64-bit hashes of its LENGTH bytes, and minima are merged before they are shuffled.
The result of a phrase is one number: a bit for each of its windows (at most 64) that is the first of its kind.

Order: smaller doc_id (null first), rows that share a doc_id by the hash of their text, then smaller start. Rows equal
in both are one document: what goes from one goes from all. Null text is empty. Texts below LENGTH bytes lose nothing.
Long texts are read in blocks of bounded memory. Other columns, and their names, don't matter. Empty input: no rows.

Skew: in each batch of texts a trigger string sends at most two rows, however many documents have it (what the batch
itself shows to be repeated or contested is not asked again), so that a string of every third document is a small
share of all rows. Documents get lists bounded by their own length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BATCH_BYTES, batches, small_batches, stash, whole_text

LENGTH = 100
#: Width of a trigger: at most 64 windows share one, as many as a mask has bits.
W = 37
BLOCK = 1 << 20
#: Phrases of one trigger that are put in order together.
FEW = 2000
NULL_ID = -(2**63)
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_LOW = np.uint64((1 << 22) - 1)  # places in a block, below the bits that are compared
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _rolling(which: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2^64."""
    if which not in _powers:
        found = []
        for r in (_ODD[which], pow(_ODD[which], -1, 2**64)):
            p = np.full(BLOCK + 2 * LENGTH, r, np.uint64)
            p[0] = 1
            found.append(np.multiply.accumulate(p))
        _powers[which] = tuple(found)
    return _powers[which]


def _sums(raw: np.ndarray, which: int = 0) -> np.ndarray:
    """Prefix sums whose differences are polynomial hashes."""
    s = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _rolling(which)[0][: len(raw)], out=s[1:])
    return s


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _windows_at(s: np.ndarray, at: np.ndarray, which: int = 0) -> np.ndarray:
    """Hashes of the LENGTH bytes at these places of a block."""
    return (s[at + LENGTH] - s[at]) * _rolling(which)[1][at]


def parse(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every phrase of the texts that raw holds one after another (each up to its end), in order: the trigger's
    hash, the phrase's hash (both signed), the first and the last window that it owns, the trigger's place."""
    n = len(raw) - LENGTH + 1
    keys, heads, tails, firsts, lasts, places = ([] for _ in range(6))
    for lo in range(0, max(n, 0), BLOCK):
        hi = min(lo + BLOCK, n)
        piece = raw[lo : hi + LENGTH - 1]
        s = _sums(piece)
        h = _mixed((s[W:] - s[:-W]) * _rolling(0)[1][: len(piece) - W + 1])
        m = (h & ~_LOW) | (_LOW - np.arange(len(h), dtype=np.uint64))  # of equal hashes the last one is the smallest
        span, need = 1, LENGTH - W + 1
        while 2 * span <= need:
            m = np.minimum(m[:-span], m[span:])
            span *= 2
        if need > span:
            m = np.minimum(m[: len(m) - (need - span)], m[need - span :])
        inside = np.ones(len(m), bool)  # windows that lie in one text
        near = ends[(ends > lo) & (ends < hi + LENGTH)]
        cut = (near[:, None] - np.arange(1, LENGTH) - lo).ravel()
        inside[cut[(cut >= 0) & (cut < len(m))]] = False
        own = np.flatnonzero(inside)
        if not len(own):
            continue
        trigger = (_LOW - (m[own] & _LOW)).astype(np.int64)
        new = np.flatnonzero(np.concatenate(([True], trigger[1:] != trigger[:-1])))
        first, last, trigger = own[new], own[np.append(new[1:], len(own)) - 1], trigger[new]
        head, tail = _windows_at(s, first), _windows_at(s, last)
        if places and places[-1][-1] == trigger[0] + lo:  # the run goes on from the block before
            lasts[-1][-1], tails[-1][-1] = last[0] + lo, tail[0]
            first, last, trigger, head, tail = first[1:], last[1:], trigger[1:], head[1:], tail[1:]
            if not len(first):
                continue
        for found, x in ((keys, h[trigger]), (heads, head), (tails, tail), (firsts, first + lo), (lasts, last + lo), (places, trigger + lo)):
            found.append(x)
    if not keys:
        return (np.zeros(0, np.int64),) * 5
    key, head, tail, first, last, place = map(np.concatenate, (keys, heads, tails, firsts, lasts, places))
    # a phrase is less than two windows long: its first and its last one hold all of it
    shape = ((last - first) * LENGTH + (place - first)).astype(np.uint64)
    phrase = _mixed(_mixed(head + np.uint64(1)) + _mixed(tail ^ np.uint64(0x5851F42D4C957F2D)) * np.uint64(3) + shape)
    return key.view(np.int64), phrase.view(np.int64), first, last, place


def _joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column one after another, and where each value ends."""
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at[1:] - at[0]


def _runs(*columns: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The order of rows by these columns, the first one leading, and for each column where, in that order, it or one before it changes."""
    order = np.lexsort(columns[::-1])
    changed, out = np.zeros(len(order), bool), []
    changed[:1] = True
    for c in columns:
        c = c[order]
        changed = changed | np.concatenate(([True], c[1:] != c[:-1]))[: len(c)]
        out.append(changed)
    return order, out


def _lists(rows: np.ndarray, keys: np.ndarray, n: int) -> pa.ListArray:
    """For each of n rows the array of its keys."""
    order = np.argsort(rows, kind="stable")
    at = np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=n)))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(keys[order]))


def _rows(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)
    text = whole_text("text")
    return docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc"), F.xxhash64(text).alias("h"), text.alias("text"))


ASKED = ["route", "doc", "h", "phrase", "repeated", "contested"]


def _ask(rows: DataFrame) -> DataFrame:
    """Rows to be asked about: route (the trigger's hash), doc, h, phrase. And for each document with any, the keys of
    which its batch shows that they repeat, or that they are contested (phrase is null, route spreads documents)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, BATCH_BYTES, 2):
            raw, ends = _joined(b.column(2))
            doc, h = (np.asarray(b.column(i)) for i in (0, 1))
            key, phrase, first, _, _ = parse(raw, ends)
            if not len(key):
                continue
            row = np.searchsorted(ends, first, side="right")
            order, (new_key, new_phrase, _, new_doc) = _runs(key, phrase, doc[row], h[row])
            at = order[new_doc]  # one for each key, phrase and document
            new_key, new_phrase = new_key[new_doc], new_phrase[new_doc]
            group = np.cumsum(new_key) - 1
            several = np.bincount(group, weights=new_phrase)[group] > 1
            # the first document of a key; where it has several phrases, the first of the second phrase, too
            nth = np.cumsum(new_phrase) - np.cumsum(new_phrase)[new_key][group]
            second = new_phrase & (nth == 1)
            asks = np.sort(at[new_key | second])  # documents one after another
            n, none = len(asks), pa.nulls(len(asks), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(key[asks]), pa.array(doc[row[asks]]), pa.array(h[row[asks]]), pa.array(phrase[asks]), none, none], names=ASKED)
            known = np.unique(row[at[several | ~new_key]])
            if not (n := len(known)):
                continue
            parts = []
            for pick in (~several & ~new_key, several):
                parts.append(_lists(np.searchsorted(known, row[at[pick]]), key[at[pick]], n))
            route = _mixed(doc[known].view(np.uint64) ^ _mixed(h[known].view(np.uint64))).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(route), pa.array(doc[known]), pa.array(h[known]), pa.nulls(n, pa.int64()), *parts], names=ASKED)

    return rows.select("doc", "h", "text").mapInArrow(run, "route long, doc long, h long, phrase long, repeated array<long>, contested array<long>")


def _settle(asked: DataFrame) -> DataFrame:
    """doc, h, repeated, contested: the keys whose phrase an earlier document has, and those with several phrases.
    Keys that need nothing (one document, or first here) don't appear."""
    told = F.col("phrase").isNull()
    w = Window.partitionBy("route", told)
    met = asked.withColumns({
        "__p": F.min("phrase").over(w), "__q": F.max("phrase").over(w), "__first": F.min(F.struct("doc", "h")).over(w),
    })
    several, later = F.col("__p") != F.col("__q"), F.col("__first") < F.struct("doc", "h")
    met = met.where(told | several | later)
    pick = lambda test, name: F.concat(F.collect_list(F.when(~told & test, F.col("route"))), F.flatten(F.collect_list(F.when(told, F.col(name))))).alias(name)
    return met.groupBy("doc", "h").agg(pick(later & ~several, "repeated"), pick(several, "contested"))


ENTRY = ["key", "phrase", "doc", "h", "start", "at", "body"]


def _entries(rows: DataFrame) -> DataFrame:
    """The dictionary of contested triggers: key, phrase, at (the trigger's place in the phrase), body, and the document,
    text hash and place where the phrase comes first. Equal phrases of a batch of texts are one row; those of several
    batches stay rows, of which all but the first hold no window that is the first of its kind."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, BATCH_BYTES, 2):
            wanted = np.unique(np.asarray(b.column(3).flatten()))  # contested for one document is contested for all
            if not len(wanted):
                continue
            raw, ends = _joined(b.column(2))
            doc, h = (np.asarray(b.column(i)) for i in (0, 1))
            key, phrase, first, last, place = parse(raw, ends)
            mine = np.flatnonzero(np.isin(key, wanted))
            row = np.searchsorted(ends, first[mine], side="right")
            # of equal phrases the first place; positions grow with the place in a text
            order, (_, new, *_) = _runs(key[mine], phrase[mine], doc[row], h[row], place[mine])
            mine, row = mine[order[new]], row[order[new]]
            size = last[mine] - first[mine] + LENGTH
            at = np.repeat(first[mine] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
            body = pa.BinaryArray.from_buffers(pa.binary(), len(mine), [None, pa.py_buffer(np.concatenate(([0], np.cumsum(size))).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(raw[at]))])
            start = place[mine] - np.concatenate(([0], ends[:-1]))[row]
            cols = [key[mine], phrase[mine], doc[row], h[row], start, (place - first)[mine].astype(np.int32)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, cols), body], names=ENTRY)

    # doc_id and repeated come along unused, so that both readers of the joined texts share one shuffle
    return rows.select("doc", "h", "text", "contested", "repeated", "doc_id").mapInArrow(run, "key long, phrase long, doc long, h long, start long, at int, body binary")


def _matrix(raw: np.ndarray, start: np.ndarray, size: np.ndarray, width: int, step: int) -> np.ndarray:
    """Rows of `width` bytes read from each start on, forwards or backwards, zeros beyond size."""
    k = np.arange(width)
    at = start[:, None] + step * k
    return np.where(k < size[:, None], raw[np.clip(at, 0, len(raw) - 1)], 0).astype(np.uint8)


def _ordered(group: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows of bytes within their groups, and each one's common prefix with the one before (-1: none before)."""
    words = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    words[:, : rows.shape[1]] = rows
    words = words.view(">u8").astype(np.uint64)
    order = np.lexsort((*words.T[::-1], group))
    differ = rows[order[1:]] != rows[order[:-1]]
    common = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
    common[group[order[1:]] != group[order[:-1]]] = -1
    return order, np.concatenate(([-1], common))


def first_windows(group: np.ndarray, raw: np.ndarray, ends: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each phrase (the bytes of raw up to its end; its trigger is at `at`) a mask of the windows that no phrase of
    its group before it has: bit k is the window that starts k bytes before the trigger. Phrases come in corpus order."""
    start = np.concatenate(([0], ends[:-1]))
    size = ends - start
    after, before = size - at, at
    right, common = _ordered(group, _matrix(raw, start + at, after, LENGTH, 1))
    left, shared = _ordered(group, _matrix(raw, start + at - 1, before, LENGTH - W, -1))
    masks, cl, cr = np.zeros(len(group), np.uint64), np.zeros(len(group), np.int64), np.zeros(len(group), np.int64)
    for k in range(LENGTH - W + 1):
        own = np.flatnonzero((before >= k) & (after >= LENGTH - k))
        if len(own):
            cl[left], cr[right] = np.cumsum(shared < k), np.cumsum(common < LENGTH - k)
            _, firsts = np.unique(cl[own] * (len(group) + 1) + cr[own], return_index=True)
            masks[own[firsts]] |= np.uint64(1 << k)
    return masks


MASKS = "doc long, h long, key long, phrase long, mask long"


def _masks(entries: DataFrame) -> DataFrame:
    """doc, h, key, phrase, mask: of the phrases with windows that are the first of their kind, at their first place."""

    def order(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            sizes = np.asarray(b.column(1).value_lengths()).astype(np.int64)
            edges = np.unique(np.concatenate(([0], np.flatnonzero(np.diff((np.cumsum(sizes) - sizes) // 20_000)) + 1, [b.num_rows])))
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                key, entry = np.asarray(b.column(0))[lo:hi], b.column(1).slice(lo, hi - lo).flatten()
                doc, h, start, phrase, at = (np.asarray(entry.field(i)) for i in range(5))
                group = np.repeat(np.arange(hi - lo), sizes[lo:hi])
                by = np.lexsort((start, h, doc))
                raw, ends = _joined(entry.field(5).take(pa.array(by)))
                mask = first_windows(group[by], raw, ends, at[by].astype(np.int64))
                some = np.flatnonzero(mask)
                out = [c[by[some]] for c in (doc, h, key[group], phrase)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, out), pa.array(mask[some].view(np.int64))], names=["doc", "h", "key", "phrase", "mask"])

    def single(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, 1 << 19, 6):
            raw, ends = _joined(b.column(6))
            at = np.asarray(b.column(5)).astype(np.int64)
            start = np.concatenate(([0], ends[:-1]))
            n = ends - start - LENGTH + 1
            entry = np.repeat(np.arange(len(n)), n)
            inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            place = start[entry] + inner
            hashes = [_mixed(_windows_at(_sums(raw, i), place, i)).view(np.int64) for i in (0, 1)]
            cols = [np.asarray(b.column(i))[entry] for i in range(5)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, hashes), *map(pa.array, cols), pa.array((at[entry] - inner).astype(np.int32))], names=["a", "b", "key", "phrase", "doc", "h", "start", "k"])

    # one shuffle by trigger serves all that follows
    counted = entries.withColumn("n", F.count("*").over(Window.partitionBy("key")))
    few = counted.where(F.col("n") <= FEW).groupBy("key").agg(F.collect_list(F.struct("doc", "h", "start", "phrase", "at", "body")).alias("entries"))
    few = few.mapInArrow(order, MASKS)
    each = counted.where(F.col("n") > FEW).select("key", "phrase", "doc", "h", "start", "at", "body").mapInArrow(single, "a long, b long, key long, phrase long, doc long, h long, start long, k int")
    each = each.groupBy("a", "b").agg(F.min(F.struct("doc", "h", "start", "key", "phrase", "k")).alias("x")).select("x.*")
    each = each.groupBy("doc", "h", "key", "phrase").agg(F.bit_or(F.expr("shiftleft(1L, k)")).alias("mask"))
    return few.unionByName(each)


def _found(row: np.ndarray, key: np.ndarray, lists: pa.ListArray) -> np.ndarray:
    """Whether each key is in its row's list."""
    at, values = _flat(lists)
    names = np.unique(values)
    if not len(names):
        return np.zeros(len(key), bool)
    code = np.searchsorted(names, key)
    code[code == len(names)] = 0
    there = names[code] == key
    have = at * len(names) + np.searchsorted(names, values)
    return there & np.isin(row * len(names) + code, have)


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Of all lists' values: their row and themselves."""
    sizes = np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64)
    return np.repeat(np.arange(len(lists)), sizes), lists.flatten()


def removed(raw: np.ndarray, ends: np.ndarray, repeated: pa.ListArray, contested: pa.ListArray, masks: pa.ListArray) -> np.ndarray:
    """Whether each byte of the texts goes."""
    key, phrase, first, last, place = parse(raw, ends)
    edge = np.zeros(len(raw) + 1, np.int32)  # +1 where a covered stretch starts, -1 where it ends
    row = np.searchsorted(ends, first, side="right")
    order, (_, _, new) = _runs(row, key, phrase)  # lexsort is stable: of equal phrases of a text the first one leads
    again = np.ones(len(key), bool)
    again[order[new]] = False
    look = np.isin(key, np.unique(np.asarray(contested.flatten())))
    whole = again | look | _found(row, key, repeated)
    at, entry = _flat(masks)
    if len(at):
        have = {t[:3]: t[3] for t in zip(at.tolist(), *(entry.field(i).to_pylist() for i in range(3)), strict=True)}
        for i in np.flatnonzero(look & ~again).tolist():
            mask = have.get((int(row[i]), int(key[i]), int(phrase[i])))
            if mask is None:
                continue
            whole[i] = False
            k = place[i] - np.arange(first[i], last[i] + 1)
            gone = first[i] + np.flatnonzero(np.right_shift(np.uint64(mask & (2**64 - 1)), k.astype(np.uint64)) & np.uint64(1) == 0)
            edge[gone] += 1
            edge[gone + LENGTH] -= 1
    np.add.at(edge, first[whole], 1)
    np.add.at(edge, last[whole] + LENGTH, -1)
    return np.cumsum(edge[:-1]) > 0


def remove_repeats(docs: DataFrame, digest: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, and kept (the remaining bytes) or, for digest, kept_sha256."""
    lists = stash(_settle(_ask(_rows(docs))), "repeats-keys")
    # texts are shuffled once: the dictionary and the result read that shuffle
    rows = _rows(docs).join(lists, ["doc", "h"], "left").select("doc", "h", "text", "contested", "repeated", "doc_id")
    masks = _masks(_entries(rows)).groupBy("doc", "h").agg(F.collect_list(F.struct("key", "phrase", "mask")).alias("masks"))
    joined = rows.join(masks, ["doc", "h"], "left").select("doc_id", "text", "repeated", "contested", "masks")
    last, kind = ("kept_sha256", "string") if digest else ("kept", "binary")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, BATCH_BYTES, 1):
            raw, ends = _joined(b.column(1))
            gone = removed(raw, ends, b.column(2), b.column(3), b.column(4))
            starts = np.concatenate(([0], ends[:-1]))
            fresh = gone.copy()  # the first byte of each removed run
            fresh[1:] &= ~gone[:-1]
            inner = starts[(starts > 0) & (starts < len(raw))]
            fresh[inner] = gone[inner]
            counts = [np.concatenate(([0], np.cumsum(x, dtype=np.int64))) for x in (gone, fresh)]
            n_removed, n_spans = (c[ends] - c[starts] for c in counts)
            kept = []
            for lo, hi, n in zip(starts.tolist(), ends.tolist(), n_removed.tolist(), strict=True):
                left = raw[lo:hi] if not n else raw[lo:hi][~gone[lo:hi]]
                kept.append(hashlib.sha256(left).hexdigest() if digest else left.tobytes())
            cols = [pa.array(ends - starts), pa.array(n_removed), pa.array(n_spans), pa.array(kept, pa.string() if digest else pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["doc_id", "n_bytes", "n_removed", "n_spans", last])

    return joined.mapInArrow(run, f"doc_id long, n_bytes long, n_removed long, n_spans long, {last} {kind}")


#: DuckDB: every string of LENGTH bytes as hexadecimal digits, told apart by hash; what is not the first of its kind goes.
ORACLE = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
n AS (SELECT doc_id, h, len(h) // 2 AS n_bytes FROM d),
w AS (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS nth FROM (SELECT doc_id, s, hash(substr(h, 2 * s - 1, 200)) AS k FROM n, range(1, n_bytes - 98) r(s))),
g AS (SELECT doc_id, s, CASE WHEN s - lag(s) OVER (PARTITION BY doc_id ORDER BY s) <= 100 THEN 0 ELSE 1 END AS fresh FROM w WHERE nth > 1),
i AS (SELECT doc_id, s, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS span FROM g),
p AS (SELECT doc_id, span, min(s) AS a, max(s) + 99 AS b FROM i GROUP BY 1, 2),
q AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS upto FROM p),
c AS (SELECT doc_id, sum(b - a + 1)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * upto + 1, 2 * (a - upto - 1)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept FROM q JOIN n USING (doc_id) GROUP BY 1)
SELECT n.doc_id, n_bytes::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM n LEFT JOIN c ON c.doc_id = n.doc_id
"""
