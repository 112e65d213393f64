"""Encoding and decoding with a SentencePiece vocabulary as a unigram model.

The best sequence of pieces is found by Viterbi over a double-array trie of the pieces,
each with a log score. A character that no piece holds becomes its UTF-8 bytes' pieces
where the vocabulary has them, else the unknown piece. Decoding joins pieces, turns byte
pieces back into bytes and whitespace markers into blanks.
"""

from __future__ import annotations

import math
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .double_array import DoubleArray
from .shared import small_batches, valid

MARK = "▁"
#: Types of pieces in the file.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = range(1, 7)
UNKNOWN_PENALTY = 10.0
#: The type of a model whose scores are log probabilities.
UNIGRAM = 1
#: Chunks of text, and bytes of them and their ids, remembered by a worker process at most.
MOST_CHUNKS, MOST_BYTES = 800_000, 128 << 20
#: What an entry takes beside its characters and ids.
_ENTRY = 160


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of a protocol-buffer message's fields."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
        else:
            size = number() if kind == 2 else 8 if kind == 1 else 4
            yield key >> 3, data[at : at + size]
            at += size


def read_model(path: str) -> tuple[list[tuple[str, int]], list[float] | None, bool]:
    """The pieces of a model file with their types, their log scores if it is a unigram model, and whether a blank is put before a text.

    A model that changes texts before it cuts them is refused, since that isn't carried out here.
    """
    pieces, scores, kind, normalizer = [], [], UNIGRAM, {}
    with open(path, "rb") as f:
        for field, value in _fields(f.read()):
            if field == 1:
                piece = dict(_fields(value))
                pieces.append((piece[1].decode(), piece.get(3, NORMAL)))
                scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
            elif field == 2:
                kind = dict(_fields(value)).get(3, UNIGRAM)
            elif field == 3:
                normalizer = dict(_fields(value))
    if normalizer.get(2) or normalizer.get(4, 1):
        raise ValueError(f"{path} asks for normalized texts")
    return pieces, scores if kind == UNIGRAM else None, bool(normalizer.get(3, 1))


def rank_scores(pieces: list[tuple[str, int]]) -> list[float]:
    """Log scores by Zipf's law: the pieces stand in the order of their frequency in the file."""
    out, rank = [], 0
    for _, kind in pieces:
        out.append(-math.log(rank + 2) if kind in (NORMAL, USER_DEFINED) else 0.0)
        rank += kind in (NORMAL, USER_DEFINED)
    return out


class Unigram:
    """A model of pieces (text and type by id) and log scores."""

    def __init__(self, pieces: list[tuple[str, int]], scores: list[float] | None = None, prefix: bool = True, most: int = MOST_CHUNKS, most_bytes: int = MOST_BYTES) -> None:
        self.pieces, self.scores, self.prefix = pieces, scores or rank_scores(pieces), prefix
        self.trie = DoubleArray({p.encode(): i for i, (p, kind) in enumerate(pieces) if kind in (NORMAL, USER_DEFINED)})
        self.unknown = next((i for i, (_, kind) in enumerate(pieces) if kind == UNKNOWN), 0)
        self.bytes = {int(p[3:5], 16): i for i, (p, kind) in enumerate(pieces) if kind == BYTE}
        self.unknown_score = min((s for s, (_, kind) in zip(self.scores, pieces, strict=True) if kind == NORMAL), default=0.0) - UNKNOWN_PENALTY
        self.kind = np.dtype("<u2" if len(pieces) <= 1 << 16 else "<u4")
        made = {BYTE: lambda p: bytes([int(p[3:5], 16)]), CONTROL: lambda p: b"", UNKNOWN: lambda p: " ⁇ ".encode()}
        self.text_of = [made.get(kind, lambda p: p.replace(MARK, " ").encode())(p) for p, kind in pieces]
        # a text falls apart at blanks if no piece holds a marker behind another character, and at line feeds if no piece holds one
        plain = [p for p, kind in pieces if kind in (NORMAL, USER_DEFINED)]
        self.by_blank = not any(MARK in p.lstrip(MARK) for p in plain)
        self.by_line = not any("\n" in p for p in plain)
        self.most, self.most_bytes = max(1, most // 2), most_bytes // 2
        self.young: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}
        self.held = 0  # bytes of the young ones

    def viterbi(self, chunk: str) -> list[int]:
        """The pieces of greatest score in sum; of equal ones the longer last piece."""
        data = chunk.encode("utf-8", "replace")
        n = len(data)
        base, check, value, scores = self.trie.base, self.trie.check, self.trie.value, self.scores
        best, source, piece = [0.0] + [-math.inf] * n, [-1] * (n + 1), [-1] * (n + 1)
        at = 0
        while at < n:
            first = data[at]
            width = 1 if first < 128 else 2 if first < 224 else 3 if first < 240 else 4
            score, state, single = best[at], 0, False
            for end in range(at, n):
                following = base[state] + data[end] + 1
                if check[following] != state:
                    break
                state = following
                if (i := value[state]) >= 0:
                    end += 1
                    if end - at == width:
                        single = True
                    if score + scores[i] > best[end]:
                        best[end], source[end], piece[end] = score + scores[i], at, i
            if not single and score + self.unknown_score > best[at + width]:
                best[at + width], source[at + width], piece[at + width] = score + self.unknown_score, at, -1
            at += width
        out: list[int] = []
        at = n
        while at > 0:
            start = source[at]
            if piece[at] >= 0:
                out.append(piece[at])
            elif self.bytes:
                out += [self.bytes[b] for b in reversed(data[start:at])]
            elif not out or out[-1] != self.unknown or piece[at] >= 0:
                out.append(self.unknown)
            at = start
        return out[::-1]

    def chunks(self, text: str) -> list[str]:
        """Parts of the marked text that are encoded on their own; a blank entry is nothing."""
        if self.by_blank and "  " not in text and MARK not in text and text[0] != " ":
            text = (MARK * self.prefix + text).replace(" ", f" {MARK}")
            return (text.replace("\n", " \n ") if self.by_line else text).split(" ")
        text = (MARK * self.prefix + text).replace(" ", MARK)
        return re.findall(f"{MARK}*[^{MARK}]+|{MARK}+", text) if self.by_blank else [text]

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of a text; a null or empty text has none."""
        if not text:
            return np.zeros(0, self.kind)
        found = self.chunks(text)
        try:
            return np.frombuffer(b"".join(map(self.young.__getitem__, found)), self.kind)
        except KeyError:
            if len(self.young) > self.most or self.held > self.most_bytes:
                self.old, self.young, self.held = self.young, {"": b""}, 0
            young, old = self.young, self.old
            for chunk in set(found):
                if chunk not in young:
                    known = old.get(chunk)
                    young[chunk] = ids = np.array(self.viterbi(chunk), self.kind).tobytes() if known is None else known
                    self.held += _ENTRY + 4 * len(chunk) + len(ids)
            return np.frombuffer(b"".join(map(young.__getitem__, found)), self.kind)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters."""
        out = b"".join(map(self.text_of.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return out[1:] if self.prefix and out[:1] == " " else out


@lru_cache(maxsize=2)
def unigram(path: str) -> Unigram:
    return Unigram(*read_model(path))


def encode_documents(docs: DataFrame, model_path: str) -> DataFrame:
    """docs (doc_id, text) to doc_id, ids (array of int), n_bytes (byte pieces among them), decoded (the ids' text), one row for each row.

    Null and empty texts have no ids and decode to the empty text. Repeated rows give repeated rows; other columns
    are not read; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = unigram(model_path)
        is_byte = np.zeros(len(model.pieces), bool)
        is_byte[list(model.bytes.values())] = True
        for b in batches:
            ids = [model.encode(t) for t in b.column(1).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            flat = np.concatenate([*ids, np.zeros(0, model.kind)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.ListArray.from_arrays(offsets, flat), pa.array([int(is_byte[x].sum()) for x in ids], pa.int64()), pa.array([model.decode(x) for x in ids], pa.string())],
                names=["doc_id", "ids", "n_bytes", "decoded"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), valid("text").alias("text")).mapInArrow(run, "doc_id long, ids array<int>, n_bytes long, decoded string")
