"""SentencePiece encoding and decoding for merge-type (BPE) models, by a score-ordered agenda.

A text, normalised as the model says, starts as its characters. The agenda holds every adjacent pair of symbols whose
concatenation is a piece, best score first, then leftmost. The first pair is merged, and the pairs that the new symbol
makes with its neighbours enter the agenda; an entry whose symbols have changed since is passed over. What is no piece in the end is
spelt in byte pieces.

Two characters that stand side by side inside no piece are never merged, so a text is cut there and every distinct
fragment is encoded once by a worker (it remembers at most REMEMBERED, then starts anew). That changes no result, only how often an
agenda is run. The sentencepiece library reads the model file and normalises; it encodes nothing here, and the tests
hold every batch against it. `check=True` does the same within the job and raises where the two differ.

Null text is an empty text (begin and end ids only). Texts of any length are encoded whole, in memory in proportion to
one text. Bytes that are not UTF-8 count as replacement characters. Rows with equal or null doc_id are independent;
other columns are ignored, whatever their names; an empty table gives no rows. Null ids decode to an empty text.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, small_batches, texts, valid, whole_text

#: Stands for a blank inside pieces.
BLANK = "▁"
#: Distinct fragments that a worker remembers.
REMEMBERED = 350_000


class Pieces:
    """A model file's pieces, and what they say about where texts can be cut."""

    def __init__(self, model: bytes):
        from sentencepiece import SentencePieceProcessor

        self.library = sp = SentencePieceProcessor(model_proto=model)
        every = range(sp.get_piece_size())
        if any(sp.is_unused(i) for i in every) or sum(map(sp.is_byte, every)) != 256:
            raise ValueError("a model with byte pieces and without unused ones is needed")
        self.names = [sp.id_to_piece(i) for i in every]
        self.silent = {i for i in every if sp.is_control(i)}
        self.unknown = {i for i in every if sp.is_unknown(i)}
        self.byte = {i: int(self.names[i][3:5], 16) for i in every if sp.is_byte(i)}
        self.byte_id = {b: i for i, b in self.byte.items()}
        self.begin, self.end = sp.bos_id(), sp.eos_id()
        self.id = {p: i for i, p in enumerate(self.names) if i not in self.silent and i not in self.unknown and i not in self.byte}
        self.cost = {p: -sp.get_score(i) for p, i in self.id.items()}
        self.prefixed = sp.normalize("x").startswith(BLANK)
        alphabet = sorted({c for p in self.id for c in p})
        self.letter = np.zeros(0x110000, np.int32)  # 0: in no piece
        self.letter[[ord(c) for c in alphabet]] = np.arange(1, len(alphabet) + 1)
        self.joined = np.zeros((len(alphabet) + 1, len(alphabet) + 1), bool)
        inside = [(a, b) for p in self.id for a, b in zip(p, p[1:], strict=False)]
        left, right = (self.letter[[ord(x[i]) for x in inside]] for i in (0, 1))
        self.joined[left, right] = True

    def cut(self, text: str) -> list[str]:
        """Fragments of a normalised text, cut between characters that no piece holds side by side."""
        at = self.letter[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
        edges = (np.flatnonzero(~self.joined[at[:-1], at[1:]]) + 1).tolist()
        return [text[a:b] for a, b in zip([0, *edges], [*edges, len(text)], strict=True)] if text else []

    def merge(self, text: str) -> list[str]:
        """The agenda, run to its end over one fragment."""
        cost, symbols, n = self.cost, list(text), len(text)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = [(cost[p], i, p) for i in range(n - 1) if (p := text[i : i + 2]) in cost]
        heapify(agenda)
        while agenda:
            _, i, piece = heappop(agenda)
            j = after[i]
            if not symbols[i] or j >= n or symbols[i] + symbols[j] != piece:
                continue  # one of the two has been merged with another
            symbols[i], symbols[j] = piece, ""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (p := piece + symbols[k]) in cost:
                    heappush(agenda, (cost[p], i, p))
            h = before[i]
            if h >= 0 and (p := symbols[h] + piece) in cost:
                heappush(agenda, (cost[p], h, p))
        return [s for s in symbols if s]

    def ids(self, fragment: str) -> list[int]:
        out = []
        for s in self.merge(fragment):
            i = self.id.get(s)
            out += [i] if i is not None else [self.byte_id[b] for b in s.encode()]
        return out

    def text(self, ids: list[int]) -> str:
        """Decoded text; the blank that normalising puts before a text is taken away again."""
        out, spelt, first = [], bytearray(), self.prefixed
        for i in ids:
            if i in self.byte:
                spelt.append(self.byte[i])
                continue
            if spelt:
                out.append(_spelt(spelt))
                spelt.clear()
                first = False
            if i in self.silent:
                continue
            piece = self.names[i] if i not in self.unknown else " ⁇ "
            out.append(piece[1:] if first and piece[0] == BLANK else piece)
            first = False
        return "".join([*out, _spelt(spelt)]).replace(BLANK, " ")


def _spelt(some: bytearray) -> str:
    """Text of byte pieces: every byte that is part of no character becomes a replacement character of its own."""
    out, at = [], 0
    while at < len(some):
        try:
            out.append(some[at:].decode())
            break
        except UnicodeDecodeError as e:
            out += [some[at : at + e.start].decode(), "\ufffd"]
            at += e.start + 1
    return "".join(out)


class Coder:
    """Encodes many texts, each distinct fragment once."""

    def __init__(self, model: bytes):
        self.pieces = Pieces(model)
        self.known: dict[str, tuple[bytes, bytes]] = {}

    def learn(self, fragment: str) -> tuple[bytes, bytes]:
        p = self.pieces
        ids = p.ids(fragment)
        spelt = b"".join(bytes([p.byte[i]]) if i in p.byte else p.names[i].encode() for i in ids)
        out = self.known[fragment] = np.array(ids, "<u4").tobytes(), spelt.replace(BLANK.encode(), b" ")
        return out

    def code(self, text: str) -> tuple[bytes, bytes]:
        """The ids as little-endian 32-bit integers with begin and end, and the decoded text in UTF-8."""
        p, known = self.pieces, self.known
        if len(known) > REMEMBERED:
            known.clear()
        found = [known.get(f) or self.learn(f) for f in p.cut(p.library.normalize(text))]
        ids = b"".join([np.uint32(p.begin).tobytes(), *[x for x, _ in found], np.uint32(p.end).tobytes()])
        said = b"".join([x for _, x in found])
        return ids, said[1:] if p.prefixed and said[:1] == b" " else said


def _sha(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()


def _mapped(df: DataFrame, model: bytes, schema: str, row, id_col: str, text_col: str, check: bool) -> DataFrame:
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)  # one model file, whatever the input
    kinds = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
    fields = [pa.field(n, kinds[k]) for n, k in (x.split(" ", 1) for x in schema.split(", "))]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = None
        gc.disable()  # hundreds of thousands of remembered fragments, no cycles
        try:
            for b in batches(it):
                coder = coder or Coder(shared.value)
                some = [valid(t).decode() for t in texts(b.column(1))]
                coded = [coder.code(t) for t in some]
                if check:
                    hold_against_library(coder.pieces.library, some, coded)
                cols = zip(*(row(*x) for x in coded), strict=True)
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, f.type) for c, f in zip(cols, fields, strict=True))], names=["doc_id", *(f.name for f in fields)])
        finally:  # the worker goes on with other tasks
            coder = None
            gc.enable()

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id long, {schema}")


def hold_against_library(library, some: list[str], coded: list[tuple[bytes, bytes]]) -> None:
    """Raises unless the library gives the same ids and the same decoded texts for a whole batch."""
    wanted = library.encode(some, add_bos=True, add_eos=True, num_threads=1)
    for t, (ids, said), want in zip(some, coded, wanted, strict=True):
        if np.frombuffer(ids, "<u4").tolist() != want or said.decode() != library.decode(want):
            raise AssertionError(f"differs from the library: {t[:200]!r}")


def encode(df: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text", check: bool = False) -> DataFrame:
    """doc_id, ids (array<int>, with begin and end ids), decoded."""
    return _mapped(df, model, "ids array<int>, decoded string", lambda ids, said: (np.frombuffer(ids, "<u4").astype(np.int32), said.decode()), id_col, text_col, check)


def encode_digests(df: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text", check: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: the digests, made where the tokens are."""
    schema = "n_tokens long, ids_sha256 string, decoded_sha256 string"
    return _mapped(df, model, schema, lambda ids, said: (len(ids) // 4, _sha(ids), _sha(said)), id_col, text_col, check)


def decode(df: DataFrame, model: bytes, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text of rows with token ids."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(shared.value)
        for b in it:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([pieces.text(ids or []) for ids in b.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, text string")
