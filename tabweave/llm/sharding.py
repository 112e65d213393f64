"""Shards of near-equal bytes for groups that must stay whole, by Karmarkar-Karp differencing.

Groups are rows of equal text. A group with at least one `items`-th of all bytes, or of all rows, is an item of its own.
The other groups are differenced within the tasks that hold them: chunk by chunk into partitions of `bundles` parts, and
these partitions again into one for each task, so every task leaves bundles of near-equal bytes. Bundles and large groups
are then differenced into shards on the driver, so no group is dealt by chance.

The driver gets two times `items` large groups at most, and for each task so many bundles as make about `items` in all
(or one for each shard, if that is more). Rows themselves never meet in one place: a row learns its shard from its
group's bundle, and its slot from counts of small cells.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import parts, valid, written

ITEMS = 1 << 14
#: Groups that a task differences at a time.
CHUNK = 2048


def difference(sizes: Sequence[int], shards: int) -> list[int]:
    """The shard of each item: combine() of partitions that hold one item each."""
    if not len(sizes):
        return []
    start = np.zeros((len(sizes), shards), np.int64)
    start[:, 0] = sizes
    return combine(start)[0][:, 0].tolist()


def combine(partitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Partial partitions (a row of sums each) into one: where each row's parts go, and the sums.

    The two of largest spread are combined again and again, the fullest part of one with the emptiest of the other,
    until one is left.
    """
    n, k = partitions.shape
    order = np.argsort(-partitions, axis=1, kind="stable")
    sums = [*np.take_along_axis(partitions, order, 1)]  # in descending order
    # what became of a partition: itself (-1), or the two that it is made of and, for each of its parts, the part of either
    made: list[tuple[int, int, np.ndarray, np.ndarray] | None] = [None] * n
    heap = [(int(s[-1] - s[0]), i) for i, s in enumerate(sums)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        both = sums[a] + sums[b][::-1]
        by = np.argsort(-both, kind="stable")
        made.append((a, b, by, k - 1 - by))
        sums.append(both[by])
        sums[a] = sums[b] = None
        heapq.heappush(heap, (int(sums[-1][-1] - sums[-1][0]), len(sums) - 1))
    out, top = np.empty((n, k), np.int64), heap[0][1]
    stack = [(top, np.arange(k))]  # a partition, and where each of its parts goes
    while stack:
        at, to = stack.pop()
        if made[at] is None:
            out[at, order[at]] = to
            continue
        a, b, of_a, of_b = made[at]
        for child, of in ((a, of_a), (b, of_b)):
            down = np.empty(k, np.int64)
            down[of] = to
            stack.append((child, down))
    return out, sums[top]


def bundled(sizes: np.ndarray, bundles: int, chunk: int = CHUNK) -> np.ndarray:
    """The bundle of each item, by differencing chunks and then the chunks' partitions; memory beyond the items is a chunk's."""
    inside, totals = [], []
    for at in range(0, len(sizes), chunk):
        start = np.zeros((len(sizes[at : at + chunk]), bundles), np.int64)
        start[:, 0] = sizes[at : at + chunk]
        where, total = combine(start)
        inside.append(where[:, 0])
        totals.append(total)
    if not inside:
        return np.zeros(0, np.int64)
    outside = combine(np.array(totals))[0]
    return np.concatenate([outside[i][w] for i, w in enumerate(inside)])


def _in_tasks(groups: DataFrame, bundles: int) -> DataFrame:
    """groups (group_key, bytes) to (group_key, task, bundle, bytes). A task holds its groups' keys and sizes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = [(b.column(0), np.asarray(b.column(1))) for b in batches if b.num_rows]
        if not held:
            return
        found, at = bundled(np.concatenate([s for _, s in held]), bundles), 0
        task = TaskContext.get().partitionId()
        for keys, sizes in held:
            n = len(sizes)
            yield pa.RecordBatch.from_arrays([keys, pa.array(np.full(n, task)), pa.array(found[at : at + n]), pa.array(sizes)], names=["group_key", "task", "bundle", "bytes"])
            at += n

    return groups.select("group_key", "bytes").mapInArrow(run, "group_key binary, task long, bundle long, bytes long")


def shard_documents(docs: DataFrame, shards: int = 16, items: int = ITEMS) -> DataFrame:
    """docs (doc_id, text) to (doc_id, size, text_crc32, shard, slot), one row for each row.

    size: UTF-8 bytes of the text plus 1. Rows of equal text, null and empty texts alike, share a shard, so a
    group larger than a shard's share makes its shard larger. slot numbers a shard's rows without gaps from 0.
    Repeated rows are rows like others; null ids are kept; an empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    text = F.coalesce(valid("text"), F.lit("")).cast("binary")
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.unhex(F.md5(text)).alias("group_key"),
    )
    rows = written(rows, "sizes")
    groups = written(rows.groupBy("group_key").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")), "groups")
    total = groups.agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n")).first()
    large = (F.col("bytes") >= max(1, (total.bytes or 0) // items)) | (F.col("n") >= max(2, (total.n or 0) // items))
    alone = groups.where(large).select("group_key", "bytes").collect()  # two times `items` at most, as each has an items-th of the bytes or rows
    bundles = max(shards, min(256, items // parts(spark)))
    small = written(_in_tasks(groups.where(~large).repartition(parts(spark), "group_key"), bundles), "bundled-groups")
    bundle_sizes = small.groupBy("task", "bundle").agg(F.sum("bytes").alias("bytes")).collect()  # `bundles` for each task
    found = [(r.bytes, None, r.task, r.bundle) for r in bundle_sizes] + [(r.bytes, bytes(r.group_key), None, None) for r in alone]
    found.sort(key=lambda x: (-x[0], x[1] or b"", x[2] or 0, x[3] or 0))
    placed = list(zip(found, difference([x[0] for x in found], shards), strict=True))
    of_bundle = spark.createDataFrame([(x[2], x[3], s) for x, s in placed if x[1] is None], "task long, bundle long, bundle_shard int")
    of_alone = spark.createDataFrame([(x[1], s) for x, s in placed if x[1] is not None], "group_key binary, alone_shard int")
    # both of a size known above; the rows of groups that aren't alone are dealt by their group, none of which is large
    rows = rows.join(F.broadcast(of_alone), "group_key", "left")
    own = ("row", "doc_id", "size", "text_crc32", "shard")
    rest = rows.where("alone_shard IS NULL").join(small.join(F.broadcast(of_bundle), ["task", "bundle"]).select("group_key", F.col("bundle_shard").alias("shard")), "group_key").select(*own)
    rows = rows.where("alone_shard IS NOT NULL").withColumn("shard", F.col("alone_shard")).select(*own).union(rest)
    # a cell is a part of a shard small enough to be numbered in one task; cells start where the counts of those before end
    cells = max(64, parts(spark))
    rows = written(rows.withColumn("cell", F.pmod(F.xxhash64("row"), F.lit(cells)).cast("int")), "sharded")
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("shard", "cell").agg(F.count("*").alias("n")).select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    numbered = rows.withColumn("place", F.row_number().over(Window.partitionBy("shard", "cell").orderBy("row")) - 1)
    return numbered.join(F.broadcast(starts), ["shard", "cell"]).select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("place")).cast("long").alias("slot"))  # shards times cells rows
