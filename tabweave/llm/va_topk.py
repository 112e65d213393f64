"""Exact top-k search by inner product over a vector-approximation file.

Vectors are stored twice, in blocks: exactly, as rows of doubles, and as cells, one byte for each component (where it lies
between the block's least and largest value of that component). A search scans the cells of a block for bounds of every
score, then reads exact vectors in the order of their upper bounds, until no bound left reaches the k-th best score known.

Components are whole numbers of any size, floor(scale * x). Bounds are doubles: numbers beyond 2^450 are scaled by a power
of two for each block, and a margin that follows from the numbers' sizes makes up for rounding, so no bound is too tight.
Scores are exact: 64-bit integers where sums can't leave them, else integers without a limit.

Queries come in blocks too. A task takes one block of queries and a range of vector blocks, which
it reads from a list in the shared folder; a query's best rows of each range are merged at the end.
No rows are paired by a join.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import new_folder, parts, small_batches
from .token_files import _opened

#: Bytes of a block's exact vectors and of a query block's; queries of a block; pairs that are bounded at a time.
BLOCK_BYTES, QUERY_BYTES, QUERY_BLOCK, SCAN_PAIRS = 64 << 20, 16 << 20, 4096, 1 << 21
#: The last cell of a component.
CELLS = 255
#: Exact vectors that a query reads at a time, in the order of their bounds.
STEP = 16
#: Whole numbers below this lie within 64 bits with their sign.
_LONG = 1 << 63
_TOO_LARGE = "a score doesn't fit 64 bits; use a smaller scale"
#: Binary digits of scaled numbers, so that a product of two stays a double.
_DIGITS = 450


def finite_vectors(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By dimension: the rows that hold a vector without null or non-finite components, and the vectors."""
    column = column.cast(pa.list_(pa.float64()))
    sizes = np.asarray(column.value_lengths().fill_null(-1))
    values = np.asarray(column.flatten().fill_null(np.nan), float)
    ends = np.cumsum(np.maximum(sizes, 0))
    out = {}
    for width in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == width)
        x = values[(ends[rows] - width)[:, None] + np.arange(width)]
        good = np.isfinite(x).all(1)
        out[width] = rows[good], x[good]
    return out


def scaled(x: np.ndarray, scale: int, power: int | None = None) -> tuple[np.ndarray, int]:
    """floor(scale * x) over 2 to a power, as doubles; the least power, if none is given, that leaves them _DIGITS."""
    with np.errstate(over="ignore"):
        whole = np.floor(scale * x)
    beyond = ~np.isfinite(whole)  # so large that the product is whole
    if power is None:
        power = max(0, int(np.frexp(np.abs(x).max(initial=0))[1]) + scale.bit_length() - _DIGITS)
    return np.where(beyond, scale * np.ldexp(x, -power), np.ldexp(np.where(beyond, 0, whole), -power)), power


def whole_numbers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) without loss: 64-bit integers, or Python's where one doesn't fit."""
    with np.errstate(over="ignore"):
        whole = np.floor(scale * x)
    if (np.abs(whole) < 2.0**62).all():
        return whole.astype(np.int64)
    return np.array([int(w) if np.isfinite(w) else scale * int(v) for w, v in zip(whole.flat, x.flat, strict=True)], object).reshape(x.shape)


def _largest(x: np.ndarray) -> int:
    return max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))


def products(vectors: np.ndarray, query: np.ndarray) -> list[int]:
    """Exact inner products of whole numbers."""
    if _largest(vectors) * _largest(query) * vectors.shape[1] >= _LONG:
        vectors, query = vectors.astype(object), query.astype(object)
    return (vectors @ query).tolist()


def at_most(score: int, power: int) -> float:
    """A double that is no more than score / 2^power."""
    part = score >> power
    try:
        found = float(part)
    except OverflowError:
        return np.finfo(float).max if part > 0 else -np.inf
    return float(np.nextafter(found, -np.inf)) if abs(part) >> 53 else found


def _write(df: DataFrame, folder: str, kind: str, block: Callable[[int], int] | None, scale: int) -> list:
    """Blocks of df (vec_id, embedding) as files, of `block` rows (by width) or BLOCK_BYTES; one row for each file: path, rows, width.
    Files of tasks that failed are never listed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        done: list[tuple[str, int, int]] = []

        def flush(width: int) -> None:
            ids, x = (np.concatenate(v) for v in zip(*held.pop(width), strict=True))
            order = np.argsort(ids, kind="stable")
            ids, x = ids[order], x[order]
            path = f"{folder}/{kind}-{uuid.uuid4().hex}"
            with _opened(f"{path}.exact", "w") as out:
                out.write(x.astype("<f8").tobytes())
            y, power = scaled(x, scale)
            low = y.min(0)
            unit = (y.max(0) - low) / CELLS
            cells = np.minimum((y - low) / np.where(unit > 0, unit, 1), CELLS)
            with _opened(f"{path}.cells", "w") as out:
                out.write(np.array([power], "<i8").tobytes() + ids.astype("<i8").tobytes())
                out.write(low.astype("<f8").tobytes() + unit.astype("<f8").tobytes() + cells.astype(np.uint8).tobytes())
            done.append((path, len(ids), width))

        for b in batches:
            ids = np.asarray(b.column(0))
            for width, (rows, x) in finite_vectors(b.column(1)).items():
                most = block(width) if block else max(256, BLOCK_BYTES // (8 * width))
                for at in range(0, len(rows), most):
                    held.setdefault(width, []).append((ids[rows[at : at + most]], x[at : at + most]))
                    if sum(len(i) for i, _ in held[width]) >= most:
                        flush(width)
        for width in list(held):
            if sum(len(i) for i, _ in held[width]):
                flush(width)
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in ((0, pa.string()), (1, pa.int64()), (2, pa.int64()))], names=["path", "rows", "width"])

    return df.mapInArrow(run, "path string, rows long, width long").orderBy("path").collect()


class VectorBlock:
    """One block's cells, and its exact vectors on demand."""

    def __init__(self, path: str, rows: int, width: int) -> None:
        with _opened(f"{path}.cells", "r") as f:
            data = f.read()
        head, real = np.frombuffer(data, "<i8", rows + 1), np.frombuffer(data, "<f8", 2 * width, offset=8 * (rows + 1))
        self.power, self.ids, self.low, self.unit = int(head[0]), head[1:], real[:width], real[width:]
        self.cells = np.frombuffer(data, np.uint8, rows * width, offset=8 * (rows + 1 + 2 * width)).reshape(rows, width)
        self.path, self.rows, self.width = path, rows, width

    def exact(self, rows: np.ndarray) -> np.ndarray:
        """The exact vectors of ascending rows, read in runs."""
        out, size = np.empty((len(rows), self.width), "<f8"), 8 * self.width
        cuts = np.flatnonzero(np.diff(rows) > 8) + 1
        with _opened(f"{self.path}.exact", "r") as f:
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(rows)], strict=True):
                if b > a:
                    first, last = int(rows[a]), int(rows[b - 1])
                    got = np.frombuffer(f.read_at((last - first + 1) * size, first * size), "<f8").reshape(-1, self.width)
                    out[a:b] = got[rows[a:b] - first]
        return out

    def bounds(self, queries: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and the largest score, over 2 to both powers, that each scaled query can have with each vector, given its cell."""
        base = (queries * self.unit) @ cells.T.astype(float) + (queries @ self.low)[:, None]
        # what rounding can add up to: some units in the last place of every part of a sum
        sizes = np.abs(self.low) + (CELLS + 2) * self.unit
        margin = (np.abs(queries) @ sizes)[:, None] * ((self.width + 64) * 2.0**-50) + 2.0**-900
        return base + (np.minimum(queries, 0) @ self.unit)[:, None] - margin, base + (np.maximum(queries, 0) @ self.unit)[:, None] + margin


class Queries:
    """A block of queries: whole numbers, and doubles scaled for bounds."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, scale: int) -> None:
        self.ids, self.scale, self.whole = ids, scale, whole_numbers(x, scale)
        self.scaled, self.power = scaled(x, scale)


def search_block(block: VectorBlock, asked: Queries, best: list[list[tuple[int, int]]], k: int) -> int:
    """Brings `best` (for each query its k pairs of score and id, best first) up to date; returns how many exact vectors were read."""
    scan = min(4096, max(64, SCAN_PAIRS // max(1, len(asked.ids))))
    return sum(_scan(block, at, min(at + scan, block.rows), asked, best, k) for at in range(0, block.rows, scan))


def _scan(block: VectorBlock, first: int, last: int, asked: Queries, best: list[list[tuple[int, int]]], k: int) -> int:
    """The same for the block's rows first to last."""
    ids, power = block.ids[first:last], block.power + asked.power
    lower, upper = block.bounds(asked.scaled, block.cells[first:last])
    own = ids[None, :] == asked.ids[:, None]
    lower[own], upper[own] = -np.inf, -np.inf
    floor = np.array([at_most(b[k - 1][0], power) if len(b) >= k else -np.inf for b in best], float)
    if len(ids) > k:
        floor = np.maximum(floor, -np.partition(-lower, k - 1, 1)[:, k - 1])
    # only vectors whose upper bound reaches the k-th lower bound, in the order of their upper bounds
    todo = []
    for i in range(len(asked.ids)):
        rows = np.flatnonzero((upper[i] >= floor[i]) & ~own[i])
        todo.append(rows[np.argsort(-upper[i, rows], kind="stable")])
    read, live, at = 0, [i for i in range(len(asked.ids)) if len(todo[i])], 0
    while live:
        wanted = np.unique(np.concatenate([todo[i][at : at + STEP] for i in live]))
        vectors = whole_numbers(block.exact(wanted + first), asked.scale)
        read += len(wanted)
        left = []
        for i in live:
            rows = todo[i][at : at + STEP]
            scores = products(vectors[np.searchsorted(wanted, rows)], asked.whole[i])
            best[i] = sorted(best[i] + list(zip(scores, ids[rows].tolist(), strict=True)), key=lambda x: (-x[0], x[1]))[:k]
            # a vector that only ties may still win by its smaller id
            if at + STEP < len(todo[i]) and (len(best[i]) < k or upper[i, todo[i][at + STEP]] >= at_most(best[i][k - 1][0], power)):
                left.append(i)
        live, at = left, at + STEP
    return read


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, block: int | None = None, query_block: int | None = None) -> DataFrame:
    """For each query (vec_id, embedding) its k vectors (vec_id, embedding) of highest inner product: query_id, rank, vec_id, score.

    Components become floor(scale * x), of any size. Ties go to the smaller id; rows with the query's own id are not its
    neighbours. Null ids, null or empty vectors, null or non-finite components take
    no part, nor do vectors of another length than the query's. Scores are 64-bit; one of the k best that isn't is an
    error. A query that is repeated is answered as often as it stands there; repeated vectors are separate
    neighbours. Other columns are not read; an empty table gives no rows.

    The driver gets one row for each file of about BLOCK_BYTES; tasks read the list of their range from the shared folder.
    All cells are read once for each block of queries (QUERY_BLOCK of them, or QUERY_BYTES), so exact search of many
    queries is bound by arithmetic, width times queries times vectors, rather than by reading.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    folder, n = new_folder(spark, "vectors"), parts(spark)
    slim = lambda df: df.where("vec_id IS NOT NULL AND embedding IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    files = _write(slim(vectors).repartition(n), folder, "v", block and (lambda width: block), scale)
    in_block = lambda width: query_block or min(QUERY_BLOCK, max(64, QUERY_BYTES // (8 * width)))
    asked = _write(slim(queries).repartition(n), folder, "q", in_block, scale)
    schema = "query_id long, query_row long, vec_id long, score long"
    ranges = max(1, min(len(files), -(-4 * n // max(1, len(asked)))))
    out = "query_id long, rank int, vec_id long, score long"
    if not asked or not files:
        return spark.createDataFrame([], out)
    for r in range(ranges):
        with _opened(f"{folder}/range-{r}", "w") as f:
            f.write(json.dumps([(x.path, x.rows, x.width) for x in files[r::ranges]]).encode())
    tasks = [(i, q.path, q.rows, q.width, r) for i, q in enumerate(asked) for r in range(ranges)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, path, rows, width, r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                mine = VectorBlock(path, rows, width)
                asking = Queries(mine.ids, mine.exact(np.arange(rows)), scale)
                best: list[list[tuple[int, int]]] = [[] for _ in range(rows)]
                with _opened(f"{folder}/range-{r}", "r") as f:
                    listed = json.loads(f.read())
                for other in listed:
                    if other[2] == width:
                        search_block(VectorBlock(*other), asking, best, k)
                found = [(q, (i << 32) + j, v, s) for j, (q, pairs) in enumerate(zip(mine.ids.tolist(), best, strict=True)) for s, v in pairs]
                if any(s >= _LONG for *_, s in found):
                    raise OverflowError(_TOO_LARGE)
                found = [(q, row, v, s if s >= -_LONG else None) for q, row, v, s in found]  # an error only if it is among the k best of all ranges
                yield pa.RecordBatch.from_arrays([pa.array([f[c] for f in found], pa.int64()) for c in range(4)], names=["query_id", "query_row", "vec_id", "score"])

    spread = spark.createDataFrame(tasks, "queries long, path string, rows long, width long, range long").repartitionByRange(min(len(tasks), 4 * n), "queries", "range")
    best = spread.mapInArrow(run, schema)
    order = Window.partitionBy("query_id", "query_row").orderBy(F.desc_nulls_last("score"), "vec_id")
    best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", F.when(F.col("score").isNull(), F.raise_error(F.lit(_TOO_LARGE)).cast("long")).otherwise(F.col("score")).alias("score"))
