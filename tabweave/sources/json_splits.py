"""JSON arrays of any size, taken apart by byte ranges.

Whether a byte stands within a string, and how deep, depends on all that comes before. A range tells what it changes in
either case: whether it leaves a string open that wasn't, and by how much the depth grows if it begins outside or inside of
one. Prefix sums over the ranges alone settle where each begins. Then every range cuts what it holds at the commas of the
array's own depth, and the few elements that reach over a range's end are put together from their parts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabweave.session import scratch

#: Keys under which an object holds its rows, in the order in which they are tried.
WRAPPERS = ("data", "items", "rows", "results", "records", "value")
RANGE_BYTES = 16 << 20
#: How far a key or a run of backslashes before a byte is looked for.
BACK = 4096
_QUOTE, _BACKSLASH, _COMMA = b'"\\,'
_KEY = re.compile(rb'"((?:[^"\\]|\\.)*)"\s*:\s*\Z', re.DOTALL)
_WHOLE, _HEAD, _MIDDLE, _TAIL = range(4)


class Json(NamedTuple):
    """What a file holds: `array`, `lines`, `object` or `scalar`; regions: the arrays to read, each (key, begin, end) within its brackets."""

    path: str
    shape: str
    regions: list[tuple[str, int, int]]


def opened(uri: str):
    from pyarrow import fs

    where, path = fs.FileSystem.from_uri(uri)
    return where.open_input_file(path)


def quotes_and_steps(data: bytes, before: bytes) -> tuple[np.ndarray, np.ndarray]:
    """For each byte: whether it is a quote that opens or closes a string, and +1 or -1 for a bracket. before: what precedes the bytes."""
    b = np.frombuffer(data, np.uint8)
    quotes = b == _QUOTE
    if len(b) and (_BACKSLASH in data or before.endswith(b"\\")):
        first = len(before) - len(before.rstrip(b"\\"))
        at = np.flatnonzero(quotes)
        # the last byte before each quote that is no backslash; what lies between are the backslashes that may escape it
        last = np.maximum.accumulate(np.where(b == _BACKSLASH, -1, np.arange(len(b))))
        other = np.where(at > 0, last[at - 1], -1)
        quotes[at[np.where(other >= 0, at - 1 - other, at + first) % 2 == 1]] = False
    steps = ((b == 123) | (b == 91)).astype(np.int8) - ((b == 125) | (b == 93)).astype(np.int8)
    return quotes, steps


def _read(file, begin: int, end: int) -> tuple[bytes, bytes]:
    """The bytes of a range, and some before it; a byte order mark is blank."""
    first = max(0, begin - BACK)
    data = file.read_at(end - first, first)
    if not first and begin < 3 and (mark := file.read_at(3, 0)) == b"\xef\xbb\xbf":
        data = b" " * min(len(mark), len(data)) + data[3:]
    return data[begin - first :], data[: begin - first]


def _levels(data: bytes, before: bytes, inside: bool, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For each byte: whether it stands outside of strings (quotes do not), and the depth behind it."""
    quotes, steps = quotes_and_steps(data, before)
    within = (np.cumsum(quotes) + inside) % 2 == 1
    outside = ~within & ~quotes
    return outside, depth + np.cumsum(np.where(outside, steps, 0), dtype=np.int64)


def _key_before(data: bytes, before: bytes, at: int) -> str | None:
    """The key whose value begins at a place."""
    near = data[at - BACK : at] if at >= BACK else (before + data[:at])[-BACK:]
    if not near.rstrip(b" \t\r\n").endswith(b":"):
        return None
    m = _KEY.search(near)
    return m[1].decode("utf-8", "replace") if m else None


def _spread(ranges: DataFrame, files: Sequence[tuple[str, int]], size: int) -> DataFrame:
    """Ranges in order over tasks of at least RANGE_BYTES, or a few for each core where that makes more."""
    count, total = sum(-(-length // size) for _, length in files), sum(length for _, length in files)
    tasks = max(-(-total // RANGE_BYTES), 4 * ranges.sparkSession.sparkContext.defaultParallelism)
    return ranges.repartitionByRange(max(1, min(count, tasks, 100_000)), "path", "begin")


def _ranges(spark: SparkSession, files: Sequence[tuple[str, int]], size: int) -> DataFrame:
    """(path, begin, end) of all ranges."""
    df = spark.createDataFrame(list(files), "path string, length long").select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(size).cast("long"))).alias("begin"))
    return _spread(df.select("path", "begin", F.least(F.col("begin") + size, F.col("length")).alias("end")), files, size)


def _starts(spark: SparkSession, files: Sequence[tuple[str, int]], size: int) -> DataFrame:
    """(path, begin, end, inside, depth): where each range begins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, begin, end in zip(*(c.to_pylist() for c in b.columns), strict=True):
                with opened(path) as file:
                    data, before = _read(file, begin, end)
                quotes, steps = quotes_and_steps(data, before)
                within = np.cumsum(quotes) % 2 == 1
                out, into = int(steps[~within & ~quotes].sum(dtype=np.int64)), int(steps[within & ~quotes].sum(dtype=np.int64))
                yield pa.RecordBatch.from_pylist([{"path": path, "begin": begin, "end": end, "odd": int(quotes.sum() % 2), "grows": out, "grows_inside": into}])

    told = _ranges(spark, files, size).mapInArrow(run, "path string, begin long, end long, odd long, grows long, grows_inside long")
    before = Window.partitionBy("path").orderBy("begin").rowsBetween(Window.unboundedPreceding, -1)
    told = told.withColumn("inside", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1)
    told = told.withColumn("by", F.when(F.col("inside"), F.col("grows_inside")).otherwise(F.col("grows")))
    folder = f"{scratch(spark, 'ranges')}/t"
    told.select("path", "begin", "end", "inside", F.coalesce(F.sum("by").over(before), F.lit(0)).alias("depth")).write.parquet(folder)
    return _spread(spark.read.parquet(folder), files, size)


def _landmarks(starts: DataFrame) -> DataFrame:
    """(path, at, what): the first byte that isn't blank (`first`, with its character), where the root ends (`end`), what
    follows it (`next`), arrays under a wrapper's key in a root object (`open`) and the ends of arrays at their depth (`close`).
    Of ends of the root and of arrays, those that a range's own other landmarks may refer to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, begin, end, inside, depth in zip(*(c.to_pylist() for c in b.columns), strict=True):
                with opened(path) as file:
                    data, before = _read(file, begin, end)
                outside, levels = _levels(data, before, inside, depth)
                raw, found = np.frombuffer(data, np.uint8), []
                blank = np.isin(raw, (32, 9, 10, 13))
                if len(at := np.flatnonzero(~blank)):
                    found.append((begin + int(at[0]), "first", chr(raw[at[0]])))
                closes = outside & ((raw == 125) | (raw == 93))
                if len(ends := np.flatnonzero(closes & (levels == 0))):
                    found.append((begin + int(ends[0]), "end", ""))
                behind = ~blank & (levels - np.where(outside & ((raw == 123) | (raw == 91)), 1, 0) == 0) & ~closes & (outside | (raw == _QUOTE))
                if len(at := np.flatnonzero(behind)):
                    later = at[at > ends[0]] if len(ends) else at
                    found += [(begin + i, "next", chr(raw[i])) for i in {*at[:1].tolist(), *later[:1].tolist()}]
                shut = np.flatnonzero(closes & (raw == 93) & (levels == 1))
                named = {i: key for i in np.flatnonzero(outside & (raw == 91) & (levels == 2)).tolist() if (key := _key_before(data, before, i)) in WRAPPERS}
                found += [(begin + i, "open", key) for i, key in named.items()]
                found += [(begin + int(i), "close", "") for i in {*shut[:1].tolist(), *(int(j) for i in named for j in shut[np.searchsorted(shut, i) :][:1])}]
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(found), pa.string()), pa.array([f[0] for f in found], pa.int64()), *(pa.array([f[k] for f in found], pa.string()) for k in (1, 2))], names=["path", "at", "what", "text"])

    return starts.mapInArrow(run, "path string, at long, what string, text string")


def shapes(starts: DataFrame, files: Sequence[tuple[str, int]]) -> list[Json]:
    """What each file holds; the driver gets a row for each, and the landmarks of the arrays that a root object holds."""
    spark = starts.sparkSession
    folder = f"{scratch(spark, 'landmarks')}/t"
    _landmarks(starts).write.parquet(folder)
    marks, what, at = spark.read.parquet(folder), F.col("what"), F.col("at")
    told = marks.groupBy("path").agg(F.min(F.when(what == "first", F.struct("at", "text"))).alias("first"), F.min(F.when(what == "end", at)).alias("end"))
    placed = marks.join(told.select("path", "end", F.col("first.text").alias("root")), "path").where("root = '{'")
    behind = placed.where((what == "next") & (at > F.col("end"))).groupBy("path").agg(F.min(F.struct("at", "text")).alias("next"))
    seen = {r.path: r for r in told.join(behind, "path", "left").collect()}
    here: dict[str, list] = {}
    if any(r.first and r.first.text == "{" for r in seen.values()):
        opens = placed.where((what == "open") & (F.col("end").isNull() | (at < F.col("end"))))
        closes = placed.where(what == "close").join(opens.select("path").distinct(), "path", "left_semi")
        for r in opens.unionByName(closes).select("path", "at", "what", "text").collect():
            here.setdefault(r.path, []).append((r.at, r.what, r.text))
    out = []
    for path, _ in files:
        r = seen.get(path)
        first, end = (r.first or (0, ""), r.end) if r else ((0, ""), None)
        if first[1] not in ("[", "{"):
            out.append(Json(path, "scalar", []))
        elif first[1] == "[":
            out.append(Json(path, "array", [("array", first[0] + 1, end if end is not None else 1 << 62)]))
        elif end is not None and r.next and r.next.text == "{":
            out.append(Json(path, "lines", []))
        else:
            own = sorted(here.get(path, []))
            regions = [(text, at + 1, next((c for c, what, _ in own if what == "close" and c > at), 1 << 62)) for at, what, text in own if what == "open"]
            key = next((w for w in WRAPPERS if any(k == w for k, _, _ in regions)), None)
            out.append(Json(path, "object", [r for r in regions if r[0] == key]))
    return out


def _elements(starts: DataFrame, found: Sequence[Json]) -> DataFrame:
    """(path, region, at, kind, text): elements of arrays, each by its parts in a range."""
    regions = {f.path: [(b, e) for _, b, e in f.regions] for f in found if f.regions}
    depth_of = {f.path: 1 if f.shape == "array" else 2 for f in found}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, begin, end, inside, depth in zip(*(c.to_pylist() for c in b.columns), strict=True):
                own = [(k, max(x, begin), min(y, end), y) for k, (x, y) in enumerate(regions.get(path, ())) if x < end and y > begin]
                if not own:
                    continue
                with opened(path) as file:
                    data, before = _read(file, begin, end)
                outside, levels = _levels(data, before, inside, depth)
                cuts = np.flatnonzero(outside & (np.frombuffer(data, np.uint8) == _COMMA) & (levels == depth_of[path])) + begin
                rows: list[tuple] = []
                held = 0
                for k, x, y, last in own:
                    inner = cuts[(cuts >= x) & (cuts < y)].tolist()
                    starts_here, ends_here = x > begin or x == regions[path][k][0], y == last
                    edges = [x, *(c + 1 for c in inner)]
                    for i, (a, z) in enumerate(zip(edges, [*inner, y], strict=True)):
                        opens, shuts = i > 0 or starts_here, i < len(inner) or ends_here
                        kind = (_WHOLE if shuts else _TAIL) if opens else _HEAD if shuts else _MIDDLE
                        rows.append((path, k, a, kind, data[a - begin : z - begin]))
                        held += z - a
                        if held > 1 << 22:
                            yield _batch(rows)
                            rows, held = [], 0
                if rows:
                    yield _batch(rows)

    return starts.where(F.col("path").isin(*regions) if len(regions) < 100 else F.lit(True)).mapInArrow(run, "path string, region int, at long, kind int, text binary")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["path", "region", "at", "kind", "text"])


def elements(starts: DataFrame, found: Sequence[Json]) -> DataFrame:
    """(path, at, value): every element of the arrays, on one line, and where it begins in its file."""
    spark = starts.sparkSession
    folder = f"{scratch(spark, 'elements')}/t"
    _elements(starts, found).write.parquet(folder)
    parts = spark.read.parquet(folder)
    whole = parts.where(F.col("kind") == _WHOLE).select("path", "at", "text")
    # parts of an element belong to the last one before them that has a beginning
    of = F.last(F.when(F.col("kind") == _TAIL, F.col("at")), ignorenulls=True).over(Window.partitionBy("path", "region").orderBy("at"))
    pieces = parts.where(F.col("kind") != _WHOLE).withColumn("of", of).groupBy("path", "region", "of")
    joined = pieces.agg(F.array_sort(F.collect_list(F.struct("at", F.hex("text").alias("text")))).alias("p")).select("path", F.col("of").alias("at"), F.unhex(F.array_join("p.text", "")).alias("text"))
    value = F.btrim(F.translate(F.make_valid_utf8(F.col("text").cast("string")), "\n\r", "  "), F.lit(" \t"))
    return whole.unionByName(joined).select("path", "at", value.alias("value")).where("value <> ''")


def read_arrays(spark: SparkSession, files: Sequence[tuple[str, int]], size: int = RANGE_BYTES) -> tuple[list[Json], DataFrame]:
    """What files (path, bytes) hold, and the elements of their arrays."""
    starts = _starts(spark, files, size)
    found = shapes(starts, files)
    return found, elements(starts, found)
