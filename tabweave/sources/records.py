"""Records of delimited files, read in splits although a quoted cell may hold line feeds.

Where a split begins, it isn't known whether a quoted cell is open there. So each split first tells what becomes of either
case: a line, and with it a run of lines, is a function of two states, and functions are composed in any grouping. From
these the state at every split's beginning follows by prefixes over the splits alone, and how many records begin in each.
Then all splits are read at once: lines that belong together are joined within a split, and the few records that reach over
a split's end are put together from their parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabweave.session import scratch

#: Characters of a record.
MAX_RECORD = 1_000_000
#: Splits whose numbers are sent to every task.
_FEW_SPLITS = 100_000
_WHOLE, _HEAD, _MIDDLE, _TAIL = range(4)


def ends_open(line: str, is_open: bool, delimiter: str) -> bool:
    """Whether a quoted cell is open behind a line, given whether one is before it.

    A quote opens a cell where it is the first character but for blanks; within, two of them stand for one; what
    follows the closing quote up to the delimiter is part of the cell.
    """
    at, n = 0, len(line)
    while True:
        if is_open:
            at = line.find('"', at)
            if at < 0:
                return True
            if line.startswith('""', at):
                at += 2
                continue
            is_open = False
        else:
            while at < n and line[at] in " \t" and line[at] != delimiter:
                at += 1
            if at < n and line[at] == '"':
                is_open, at = True, at + 1
                continue
        at = line.find(delimiter, at)
        if at < 0:
            return False
        at += 1


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, block, split: a number for both, value) for each line, in the order of the scan."""
    text = spark.read.option("lineSep", "\n").text(path)
    at = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
    return text.select(at[0].alias("path"), at[1].alias("block"), F.xxhash64(*at).alias("split"), "value")


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    """A batch cut where a split ends."""
    splits, begin = batch.column("split"), 0
    cuts = [] if len(splits) < 2 else pc.indices_nonzero(pc.not_equal(splits[1:], splits[:-1])).to_pylist()
    for end in (*(c + 1 for c in cuts), len(splits)):
        if end > begin:
            yield splits[begin].as_py(), batch.slice(begin, end - begin)
        begin = end


def _is_blank(line: str) -> bool:
    return not line.strip(" \t\r﻿")


def _told(lines: DataFrame, delimiter: str) -> DataFrame:
    """For each split: from_closed and from_open (whether a cell is open behind it, either way), and for both cases how many
    records that aren't blank begin in it (n_closed, n_open)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, states, counts = None, [False, True], [0, 0]

        def told() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((now, *states, *counts), kinds, strict=True)], names=["split", "from_closed", "from_open", "n_closed", "n_open"])

        for b in batches:
            for split, rows in _runs(b):
                if split != now:
                    if now is not None:
                        yield told()
                    now, states, counts = split, [False, True], [0, 0]
                values = rows.column("value")
                for line, quoted in zip(values.to_pylist(), pc.match_substring(values, '"').to_pylist(), strict=True):
                    blank = not quoted and _is_blank(line)
                    for k in (0, 1):
                        counts[k] += not states[k] and not blank
                        if quoted:
                            states[k] = ends_open(line, states[k], delimiter)
        if now is not None:
            yield told()

    found = lines.select("split", F.make_valid_utf8("value").alias("value")).mapInArrow(run, "split long, from_closed boolean, from_open boolean, n_closed long, n_open long")
    return found


def split_states(spark: SparkSession, path: str | list[str], delimiter: str) -> DataFrame:
    """(path, block, split, is_open, n, start): whether a cell is open where a split begins, how many records begin in it, and
    how many in its file before it.

    A function of two states keeps them, swaps them, or is constant: the state at a place is that of the last constant before
    it, turned over by each swap since.
    """
    lines = _lines(spark, path)
    places = lines.select("path", "block", "split").distinct()
    found = _told(lines, delimiter).join(places, "split")
    order = Window.partitionBy("path").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    constant = F.col("from_closed") == F.col("from_open")
    found = found.withColumn("swaps", F.sum(F.when(~constant & F.col("from_closed"), 1).otherwise(0)).over(order))
    last = F.last(F.when(constant, F.struct("from_closed", "swaps")), ignorenulls=True).over(before)
    found = found.withColumn("last", last).withColumn("swapped", F.coalesce(F.lag("swaps").over(order), F.lit(0)) - F.coalesce(F.col("last.swaps"), F.lit(0)))
    found = found.withColumn("is_open", (F.coalesce(F.col("last.from_closed"), F.lit(False)).cast("int") + F.col("swapped")) % 2 == 1)
    n = F.when(F.col("is_open"), F.col("n_open")).otherwise(F.col("n_closed"))
    found = found.withColumn("n", n)
    return found.select("path", "block", "split", "is_open", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))


def _joined(lines: DataFrame, open_splits: list[int], delimiter: str, most: int) -> DataFrame:
    """(path, block, split, kind, place, value): records, each by the lines that it has in a split. place: of a record among those that begin there."""
    opened = spark_set(lines.sparkSession, open_splits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, is_open, parts, held, place, where, inherited = None, False, [], 0, 0, None, False
        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string())
            made = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["path", "block", "split", "kind", "place", "value"])
            out.clear()
            return made

        def end(kind: int) -> None:
            nonlocal parts, held, place
            text = "\n".join(parts)
            if kind in (_HEAD, _MIDDLE):
                out.append((*where, now, kind, -1, text))
            elif kind == _TAIL or not _is_blank(text):
                out.append((*where, now, kind, place, text))
                place += 1
            parts, held = [], 0

        def leave() -> None:
            """What is open at a split's end."""
            if parts:
                end(_MIDDLE if inherited else _TAIL)

        size = 0
        for b in batches:
            for split, rows in _runs(b):
                if split != now:
                    if now is not None:
                        leave()
                    now, where = split, (rows.column("path")[0].as_py(), rows.column("block")[0].as_py())
                    inherited = is_open = split in opened.value
                    parts, held, place = [], 0, 0
                values = rows.column("value")
                for line, quoted in zip(values.to_pylist(), pc.match_substring(values, '"').to_pylist(), strict=True):
                    if quoted:
                        is_open = ends_open(line, is_open, delimiter)
                    parts.append(line)
                    held += len(line) + 1
                    if held > most + 2:
                        raise ValueError(f"a record of over {most} characters in {where[0]}, in the split at {where[1]}")
                    if not is_open:
                        size += held
                        end(_HEAD if inherited else _WHOLE)
                        inherited = False
                        if size > 1 << 22:
                            yield batch()
                            size = 0
        if now is not None:
            leave()
        if out:
            yield batch()

    return lines.select("path", "block", "split", F.make_valid_utf8("value").alias("value")).mapInArrow(run, "path string, block long, split long, kind int, place long, value string")


def spark_set(spark: SparkSession, values: list[int]):
    """A set that tasks look things up in."""
    return spark.sparkContext.broadcast(frozenset(values))


def records(spark: SparkSession, path: str | list[str], delimiter: str = ",", most: int = MAX_RECORD) -> DataFrame:
    """(path, place, value) for each record that isn't blank: its place in its file from 0, and its text.

    The driver holds the numbers of the splits that begin within a quoted cell, as it does all splits of a scan. A record of
    more than `most` characters is an error, since a quote that never closes would make one of the rest of a file.
    """
    states = f"{scratch(spark, 'splits')}/t"
    split_states(spark, path, delimiter).write.parquet(states)
    states = spark.read.parquet(states)
    # with few splits no row leaves its task, so rows stay in the order of the file
    starts = states.select("split", "start") if states.count() > _FEW_SPLITS else F.broadcast(states.select("split", "start"))
    opened = [r.split for r in states.where("is_open").select("split").collect()]
    target = f"{scratch(spark, 'records')}/t"
    if opened:
        _joined(_lines(spark, path), opened, delimiter, most).write.parquet(target)
        joined = spark.read.parquet(target)
        # a part's record began in the last split before it that has a tail; parts of one record are few
        pieces = joined.where(F.col("kind") != _WHOLE)
        began = F.last(F.when(F.col("kind") == _TAIL, F.struct("split", "place")), ignorenulls=True).over(Window.partitionBy("path").orderBy("block", "kind"))
        pieces = pieces.withColumn("of", began).groupBy("path", "of").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "kind", "value"))), lambda x: x["value"]), "\n").alias("value"))
        too_long = F.when(F.char_length("value") > most, F.raise_error(F.concat(F.lit(f"a record of over {most} characters in "), F.col("path"))).cast("string")).otherwise(F.col("value"))
        whole = joined.where(F.col("kind") == _WHOLE).select("path", "split", "place", "value").unionByName(pieces.select("path", "of.split", "of.place", too_long.alias("value")))
    else:
        whole = _joined(_lines(spark, path), [], delimiter, most).where(F.col("kind").isin(_WHOLE, _TAIL)).select("path", "split", "place", "value")
    text: Column = F.regexp_replace(F.col("value"), "^﻿|\r\\z", "")
    return whole.join(starts, "split").select("path", (F.col("start") + F.col("place")).alias("place"), text.alias("value"))
