"""Packing documents into sequences, in order, by dynamic programming over cut places.

A stretch of documents is one run of ids. It may be cut where a document ends (free),
where a sentence or line ends (a small penalty), and, only in stretches longer than a sequence
that hold neither, at fixed distances (a larger penalty). The cheapest cuts under padding plus penalties plus a cost
for each sequence follow from

    best[j] = penalty[j] + cost + min over i of (best[i] + padding(place[j] - place[i]))

As padding is `width` less the length, the minimum is that of best[i] + place[i] over a
sliding window, which a queue of ascending values yields in constant time. Lengths that
need no padding though short (powers of two) are looked up by place besides.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import parts, small_batches, valid
from .word_ids import word_ids


@dataclass(frozen=True)
class PackingCosts:
    """In tokens of padding: a cut at a sentence's end, elsewhere in a document, and one more sequence.

    every: distance of the places for cuts in a stretch without a boundary that is longer than a sequence; unpadded: shorter lengths that need no padding.
    """

    sentence: int = 8
    elsewhere: int = 64
    sequence: int = 64
    every: int = 512
    unpadded: tuple[int, ...] = (256, 512, 1024, 2048)


def with_hard_places(places: np.ndarray, penalties: np.ndarray, width: int, costs: PackingCosts) -> tuple[np.ndarray, np.ndarray]:
    """Places for cuts are added, every costs.every ids, where two boundaries lie further apart than width."""
    gaps = np.diff(places, prepend=0)
    wide = np.flatnonzero(gaps > width)
    if not len(wide):
        return places, penalties
    more = np.concatenate([np.arange(places[i] - gaps[i] + costs.every, places[i], costs.every) for i in wide.tolist()])
    places, penalties = np.concatenate([places, more]), np.concatenate([penalties, np.full(len(more), costs.elsewhere)])
    order = np.argsort(places, kind="stable")
    return places[order], penalties[order]


def best_cuts(places: Sequence[int] | np.ndarray, penalties: Sequence[int] | np.ndarray, width: int, costs: PackingCosts) -> tuple[list[int], int]:
    """The cuts (each the end of a sequence, the last place included) of least cost, and that cost.

    places ascend from above 0, no two neighbours further apart than width; the last is the end of the ids.
    """
    at = np.concatenate([[0], np.asarray(places, np.int64)])
    place, n = at.tolist(), len(at)
    penalty = [0, *np.asarray(penalties).tolist()]
    index = np.full(place[-1] + 1, -1, np.int32)
    index[at] = np.arange(n)
    exact: dict[int, list[int]] = {}
    for size in costs.unpadded:
        if size < width:
            first = int(np.searchsorted(at, size))
            before = index[at[first:] - size]
            hits = np.flatnonzero(before >= 0)
            for j, i in zip((hits + first).tolist(), before[hits].tolist(), strict=True):
                exact.setdefault(j, []).append(i)
    best, source = [0] * n, [0] * n
    queue: deque[tuple[int, int, int]] = deque([(0, 0, 0)])  # best[i] + place[i], place[i], i: ascending in all three
    push, pop, shift = queue.append, queue.pop, queue.popleft
    for j in range(1, n):
        p = place[j]
        floor = p - width
        while queue[0][1] < floor:
            shift()
        key, _, i = queue[0]
        cost = key + width - p
        if j in exact:
            for other in exact[j]:
                if best[other] < cost:
                    cost, i = best[other], other
        cost += penalty[j] + costs.sequence
        best[j], source[j] = cost, i
        key = cost + p
        while queue and queue[-1][0] >= key:
            pop()
        push((key, p, j))
    cuts, j = [], n - 1
    while j:
        cuts.append(place[j])
        j = source[j]
    return cuts[::-1], best[-1]


class _Run:
    """Documents that wait to be cut; the first may have lost its beginning to sequences already out."""

    def __init__(self, width: int, costs: PackingCosts) -> None:
        self.width, self.costs = width, replace(costs, every=min(costs.every, width))  # a place to cut within each width
        self.docs: list[tuple[int | None, np.ndarray, np.ndarray, int]] = []  # id, ids, sentence ends, ids gone before
        self.n = 0

    def add(self, doc_id: int | None, ids: np.ndarray, ends: np.ndarray) -> None:
        self.docs.append((doc_id, ids, ends, 0))
        self.n += len(ids)

    def cut(self, last: bool) -> Iterator[list[tuple[int | None, int, np.ndarray, int]]]:
        """Sequences as lists of pieces (id, start, ids, ids of the document). Unless this is the last call, what
        lies in the last few sequences' range is left waiting, so that it is cut together with what comes next."""
        if not self.docs:
            return
        costs, places, penalties, starts, at = self.costs, [], [], [], 0
        for _, ids, ends, gone in self.docs:
            inner = ends[(ends > gone) & (ends < len(ids))] - gone + at
            starts.append(at)
            at += len(ids) - gone
            places += [inner, [at]]
            penalties += [np.full(len(inner), costs.sentence), [0]]
        where, penalty = with_hard_places(np.concatenate(places).astype(np.int64), np.concatenate(penalties), self.width, costs)
        cuts, _ = best_cuts(where, penalty, self.width, costs)
        if not last:
            cuts = [c for c in cuts if c <= at - 4 * self.width]
        begin, k = 0, 0
        for end in cuts:
            pieces, a = [], begin
            while a < end:
                doc_id, ids, _, gone = self.docs[k]
                stop = starts[k] + len(ids) - gone
                b = min(end, stop)
                pieces.append((doc_id, a - starts[k] + gone, ids[a - starts[k] + gone : b - starts[k] + gone], len(ids)))
                a = b
                k += b == stop
            yield pieces
            begin = end
        rest = self.docs[k:]
        if rest and cuts:
            doc_id, ids, ends, gone = rest[0]
            rest[0] = (doc_id, ids, ends, gone + max(0, begin - starts[k]))
        self.docs = rest
        self.n = at - begin


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int, width: int = 4096, costs: PackingCosts = PackingCosts(), block: int = 1 << 20) -> DataFrame:  # noqa: B008
    """docs (doc_id, text) to pieces: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    Documents are taken in ascending order of doc_id (null ids first, equal ids by their texts' hashes), dealt to
    tasks by ranges of it; a sequence never crosses such a range, so each task pads one sequence more at most.
    Each id lies in exactly one piece; sequence_id ascends with the documents, and offset runs without gaps. Null
    and empty texts are the end id alone; repeated rows are documents like others; an empty table gives no rows;
    other columns are not read. A task holds about `block` ids, or one document if that is longer.
    """
    small_batches(docs.sparkSession)
    schema = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store, waiting = word_ids(tokenizer_path), _Run(width, costs)
        sequence = TaskContext.get().partitionId() << 40
        end = np.array([end_id], store.kind)

        def out(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal sequence
            rows = []
            for pieces in waiting.cut(last):
                offset = 0
                for doc_id, start, ids, total in pieces:
                    rows.append((doc_id, start, len(ids), ids.astype("<u4").tobytes(), total, sequence, offset))
                    offset += len(ids)
                sequence += 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for b in batches:
            for doc_id, (ids, ends) in zip(b.column(0).to_pylist(), store.bounded(b.column(1).to_pylist()), strict=True):
                waiting.add(doc_id, np.concatenate([ids, end]), ends)
                if waiting.n >= block:
                    yield from out(False)
        yield from out(True)

    return (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), valid("text").alias("text"))
        .withColumns({"tie": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
        .repartitionByRange(parts(docs.sparkSession), "doc_id", "tie", "row")
        .sortWithinPartitions("doc_id", "tie", "row")
        .select("doc_id", "text")
        .mapInArrow(run, schema)
    )
