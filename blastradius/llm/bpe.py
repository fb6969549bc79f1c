"""Byte-level BPE by forced-boundary splitting.

A byte pair that occurs inside no vocabulary token can never be joined by a merge, so a cut between its two bytes
is certain. Of those cuts this operator takes the ones between a non-blank byte and a blank byte: there the
pre-tokeniser starts anew as well, since none of its pieces goes on from a non-blank into a blank. The fragments
(mostly one word with its leading blank) are encoded independently, each distinct one once per worker, and the
token ids are concatenated. A pair that some token does hold is never cut; a vocabulary with many of them gets
longer fragments, down to whole texts, and the result is the same.

Null text is an empty text (no tokens). Very long texts are handled like any other, in memory in proportion to
one text. Rows with equal doc_id are independent; other columns are ignored.
"""

from __future__ import annotations

import gc
import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, small_batches, texts, valid, whole_text

BLANKS = b" \n\r\t\x0b\x0c"
#: Distinct fragments that a worker remembers.
REMEMBERED = 350_000


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for the 256 bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def token_bytes(vocabulary: dict[str, int], added: dict[str, int]) -> list[bytes]:
    at = byte_alphabet()
    out = [b""] * (max([*vocabulary.values(), *added.values()]) + 1)
    for token, i in vocabulary.items():
        out[i] = bytes(at[c] for c in token) if all(c in at for c in token) else token.encode()
    for token, i in added.items():
        out[i] = token.encode()
    return out


def inner_pairs(tokens: list[bytes]) -> np.ndarray:
    """[x, y]: whether some token holds byte y right after byte x."""
    seen = np.zeros((256, 256), bool)
    data = np.frombuffer(b"".join(tokens), np.uint8)
    last = np.cumsum([len(t) for t in tokens if t]) - 1
    inside = np.ones(len(data), bool)
    inside[last] = False
    at = np.flatnonzero(inside)
    seen[data[at], data[at + 1]] = True
    return seen


def splitter(seen: np.ndarray):
    """A function that cuts UTF-8 bytes between a non-blank byte and a blank one wherever no token holds that pair."""
    inside = lambda xs: b"[" + b"".join(b"\\x%02x" % x for x in xs) + b"]"
    blank, other = inside(BLANKS), b"[^" + inside(BLANKS)[1:]
    held = {b: [x for x in range(256) if x not in BLANKS and seen[x, b]] for b in BLANKS}
    joined = b"|".join(b"(?<=%b)\\x%02x" % (inside(xs), b) for b, xs in held.items() if xs)
    more = b"(?:(?:%b)%b*%b*)*" % (joined, blank, other) if joined else b""
    return re.compile(b"%b*%b+%b|%b+" % (blank, other, more, blank)).findall


class Coder:
    """Encodes and decodes texts with one tokenizer file's content (JSON of the tokenizers library)."""

    def __init__(self, content: str):
        from tokenizers import Tokenizer

        said = json.loads(content)
        added = {x["content"]: x["id"] for x in said.get("added_tokens", [])}
        self.tokenizer = Tokenizer.from_str(content)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokens = token_bytes(said["model"]["vocab"], added)
        seen = inner_pairs(self.tokens)
        self.split = splitter(seen)
        self.held = {b: bytes(x for x in range(256) if seen[x, b]) for b in BLANKS}
        self.length = np.array([len(t) for t in self.tokens], np.int64)
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}  # fragment -> place in the two lists
        self.ids: list[bytes] = []
        self.texts: list[bytes] = []

    def learn(self, new: list[bytes]) -> None:
        """Encode fragments that are not known yet.

        Those that start with a blank go to the tokenizer in short strings of several (its time grows faster than a string), since its tokens cannot cross the
        certain cuts between them; token lengths then tell where each fragment's ids end.
        """
        apart, strings, size = [], [[]], 0
        for f in new:
            if f[0] not in self.held or f[-1] in BLANKS or (strings[-1] and strings[-1][-1][-1] in self.held[f[0]]):
                apart.append(f)
            else:
                strings[-1].append(f)
                size += len(f)
                if size > 300:
                    strings, size = [*strings, []], 0
        strings += [[f] for f in apart]
        strings = [x for x in strings if x]
        for some, e in zip(strings, self.tokenizer.encode_batch_fast([b"".join(x).decode() for x in strings], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, np.int64)
            ends = np.searchsorted(np.cumsum(self.length[ids]), np.cumsum([len(f) for f in some])) + 1
            coded, lo = ids.astype("<u4"), 0
            for f, hi in zip(some, ends.tolist(), strict=True):
                self.known[f] = len(self.ids)
                self.ids.append(coded[lo:hi].tobytes())
                self.texts.append(b"".join([self.tokens[i] for i in e.ids[lo:hi]]) if hi - lo > 1 else self.tokens[ids[lo]])
                lo = hi

    def code(self, some: list[bytes]) -> list[tuple[bytes, bytes]]:
        """Of each text the ids as little-endian 32-bit integers, and the decoded text in UTF-8."""
        cut = [self.split(t) for t in some]
        every = set().union(*cut)
        new = every - self.known.keys()
        if len(self.known) + len(new) > REMEMBERED:
            self.forget()
            new = every
        self.learn(list(new))
        place, ids, text = self.known.__getitem__, self.ids.__getitem__, self.texts.__getitem__
        out = []
        for fragments in cut:
            at = list(map(place, fragments))
            out.append((b"".join(map(ids, at)), b"".join(map(text, at))))
        return out


def _coder(shared, kept: list) -> Coder:
    if not kept:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the executor's cores are Spark's to deal out
        kept.append(Coder(shared.value))
    return kept[0]


def _mapped(df: DataFrame, content: str, schema: str, row, id_col: str, text_col: str) -> DataFrame:
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(content)  # one vocabulary file, whatever the input

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list = []
        gc.disable()  # hundreds of thousands of remembered fragments, no cycles
        try:
            for b in batches(it):
                coder = _coder(shared, kept)
                cols = list(zip(*(row(*x) for x in coder.code([valid(t) for t in texts(b.column(1))])), strict=True))
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, f.type) for c, f in zip(cols, fields, strict=True))], names=["doc_id", *(f.name for f in fields)])
        finally:  # the worker goes on with other tasks
            kept.clear()
            gc.enable()

    kinds = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
    fields = [pa.field(n, kinds[k]) for n, k in (x.split(" ", 1) for x in schema.split(", "))]
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id long, {schema}")


def encode(df: DataFrame, content: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array<int>), decoded: the real tokens and the round trip."""
    return _mapped(df, content, "ids array<int>, decoded string", lambda ids, text: (np.frombuffer(ids, "<u4").astype(np.int32), text.decode()), id_col, text_col)


def encode_digests(df: DataFrame, content: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: the digests, made where the tokens are."""
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return _mapped(df, content, "n_tokens long, ids_sha256 string, decoded_sha256 string", lambda ids, text: (len(ids) // 4, sha(ids), sha(text)), id_col, text_col)


def encode_all(df: DataFrame, content: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids, ids_sha256, decoded_sha256: tokens and digests in one pass."""
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return _mapped(df, content, "n_tokens long, ids array<int>, ids_sha256 string, decoded_sha256 string", lambda ids, text: (len(ids) // 4, np.frombuffer(ids, "<u4").astype(np.int32), sha(ids), sha(text)), id_col, text_col)


def decode(df: DataFrame, content: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text of rows with token ids."""
    shared = df.sparkSession.sparkContext.broadcast(content)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        said = json.loads(shared.value)
        tokens = token_bytes(said["model"]["vocab"], {x["content"]: x["id"] for x in said.get("added_tokens", [])})
        for b in it:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([b"".join(tokens[i] for i in ids or []).decode("utf-8", "replace") for ids in b.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col)).mapInArrow(run, "doc_id long, text string")
