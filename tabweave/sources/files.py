"""Files as tables: CSV and TSV, JSON of several shapes, Parquet, folders; columns get normalized names."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabweave.functions.normalize import distinct_names
from tabweave.operators.filters import column
from tabweave.operators.order_page import ROW
from tabweave.session import scratch
from tabweave.sources.json_splits import RANGE_BYTES, opened, read_arrays
from tabweave.sources.records import MAX_RECORD, ends_open, records

#: The name under which SQL finds a source.
SOURCE_VIEW = "__agent_src__"
DELIMITERS = (",", ";", "|", "\t")
MAX_FILE_BYTES = 50 << 20


def _path(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def extension(path: str) -> str:
    return path.rstrip("/").rpartition(".")[2].lower()


def sniff_delimiter(text: str) -> str:
    """The delimiter that divides the most lines into the same number of parts, more than one; else a comma. Quoted cells aren't looked into."""
    lines = [x for x in re.sub(r'"(?:[^"]|"")*"', "", text).splitlines()[:50] if x.strip()]
    best, most = ",", (0, 0)
    for d in DELIMITERS:
        counts = [x.count(d) for x in lines]
        if counts and counts[0]:
            found = (sum(c == counts[0] for c in counts), counts[0])
            best, most = (d, found) if found > most else (best, most)
    return best


def _named(df: DataFrame) -> DataFrame:
    return df.toDF(*distinct_names(df.columns))


#: Bytes of a file's beginning that are looked at.
HEAD_BYTES = 1 << 16


def first_file(spark: SparkSession, path: str | list[str]) -> str | None:
    """The first file by name, of those that a path, a pattern, a folder or several of these stand for, that isn't empty."""
    found = []
    for one in [path] if isinstance(path, str) else path:
        fs, where = _path(spark, one)
        for status in fs.globStatus(where) or []:
            files = fs.listFiles(status.getPath(), True) if status.isDirectory() else None
            while files is not None and files.hasNext():
                file = files.next()
                if file.getLen() and file.getPath().getName()[:1] not in "_.":
                    found.append(file.getPath().toString())
            if files is None and status.getLen():
                found.append(status.getPath().toString())
    return min(found, default=None)


def head_text(spark: SparkSession, file: str, size: int = HEAD_BYTES) -> str:
    """The beginning of a file, unpacked if its name says that it is packed, without a byte order mark."""
    fs, where = _path(spark, file)
    codec = spark._jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(spark._jsc.hadoopConfiguration()).getCodec(where)
    stream = fs.open(where)
    try:
        bounded = spark._jvm.org.apache.commons.io.input.BoundedInputStream(codec.createInputStream(stream) if codec else stream, size)
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(bounded)).decode("utf-8", "replace").removeprefix("\ufeff")
    finally:
        stream.close()


def header_cells(text: str, delimiter: str) -> list[str]:
    """The cells of the first record of a file's beginning that isn't blank."""
    held: list[str] = []
    is_open = False
    for line in text.split("\n"):
        if not held and not line.strip():
            continue
        held.append(line.rstrip("\r"))
        is_open = ends_open(line, is_open, delimiter)
        if not is_open:
            break
    return split_line("\n".join(held), delimiter)


def read_delimited(spark: SparkSession, path: str | list[str], delimiter: str | None = None, multi_line: bool | None = None, strict: bool = False, schema: T.StructType | None = None) -> DataFrame:
    """A CSV or TSV file with a header line, as texts; blank and missing cells are empty texts, not nulls.

    Without a delimiter a .tsv file's is the tab, and that of others is told by the file's beginning. Columns get the
    header's names, normalized and made distinct. Short and long rows are tolerated unless `strict`. With `multi_line` a
    quoted cell may hold line feeds, and splits are read as in `records`; None looks for a line with half a pair of quotes
    first. A record of more than MAX_RECORD characters is an error then.
    """
    one = first_file(spark, path)
    if one is None:
        return spark.createDataFrame([], schema or "column_1 string")
    head = head_text(spark, one)
    delimiter = delimiter or ("\t" if extension(one) == "tsv" else sniff_delimiter(head))
    if schema is None:
        cells = header_cells(head, delimiter)
        if len(head) >= HEAD_BYTES // 4 and ends_open(head.rpartition("\n")[0], False, delimiter):
            cells = header_cells(head_text(spark, one, MAX_RECORD), delimiter)
        schema = T.StructType([T.StructField(n, T.StringType()) for n in distinct_names(cells)])
    options = {"sep": delimiter, "escape": '"', "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true", "mode": "FAILFAST" if strict else "PERMISSIVE"}
    if multi_line is None:
        open_quote = (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))) % 2 == 1
        multi_line = spark.read.text(path).where(open_quote).limit(1).count() > 0
    if not multi_line:
        return spark.read.options(**options).option("header", True).schema(schema).csv(path).fillna("")
    rows = records(spark, path, delimiter).where("place > 0")
    texts = T.StructType([T.StructField(f.name, T.StringType()) for f in schema])
    kinds = ", ".join(f"`{f.name}` STRING" for f in texts)
    return rows.select(F.from_csv("value", kinds, options).alias("r")).select(*(F.col(f"r.`{f.name}`").cast(f.dataType).alias(f.name) for f in schema)).fillna("")


def with_row_index(df: DataFrame) -> DataFrame:
    """df, read from files, with a row's place in file order as ROW: without gaps, whatever the splits."""
    marked = df.select("*", F.col("_metadata.file_path").alias("__p"), F.col("_metadata.file_block_start").alias("__b"), F.monotonically_increasing_id().alias("__i"))
    blocks = marked.groupBy("__p", "__b").agg(F.min("__i").alias("__low"), F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__p", "__b").rowsBetween(Window.unboundedPreceding, -1)  # a row for each split; Spark broadcasts them if they are few
    starts = blocks.select("__p", "__b", "__low", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    return marked.join(starts, ["__p", "__b"]).withColumn(ROW, F.col("__start") + F.col("__i") - F.col("__low")).drop("__p", "__b", "__i", "__low", "__start")


def read_lines_range(spark: SparkSession, path: str, from_line: int = 1, to_line: int | None = None, delimiter: str = ",") -> DataFrame:
    """Lines from_line (the header) to to_line of a delimited file, counted from 1; cells can't hold line feeds."""
    lines = with_row_index(spark.read.text(path))
    kept = lines.where(F.col(ROW) >= from_line - 1)
    if to_line is not None:
        kept = kept.where(F.col(ROW) < to_line)
    first = kept.orderBy(ROW).limit(1).first()
    if first is None:
        return spark.createDataFrame([], "column_1 string")
    options = {"sep": delimiter, "escape": '"', "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"}
    names = distinct_names(split_line(first.value.lstrip("﻿"), delimiter))
    body = kept.where((F.col(ROW) > from_line - 1) & (F.trim("value") != "")).select(F.from_csv("value", ", ".join(f"`{n}` STRING" for n in names), options).alias("r"), ROW)
    return body.select("r.*", ROW).fillna("")


def line_cells(line: Column, n: int, delimiter: str = ",") -> Column:
    """The same for a column of lines: an array of n trimmed texts, those that a line doesn't have empty."""
    options = {"sep": delimiter, "escape": '"', "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true", "emptyValue": "", "nullValue": ""}
    cells = F.from_csv(line, ", ".join(f"c{i} STRING" for i in range(n)), options)
    return F.array(*(F.coalesce(cells[f"c{i}"], F.lit("")) for i in range(n)))


def split_line(line: str, delimiter: str = ",") -> list[str]:
    """The trimmed cells of one line; quotes hold delimiters, and two of them stand for one."""
    import csv

    return [c.strip() for c in next(csv.reader([line], delimiter=delimiter, skipinitialspace=True), [])]


def json_shape(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> str:
    """`array`, `lines`, `scalar`, `object`, or the key of an object's rows."""
    files = files_below(spark, path)
    found = read_arrays(spark, files, range_bytes)[0] if files else []
    return next((f.regions[0][0] if f.shape == "object" and f.regions else f.shape for f in found), "scalar")


def files_below(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(whole path, bytes) of a file, of what a pattern names, or of a folder's files, by name; hidden and empty ones are left out."""
    fs, where = _path(spark, path)
    out = []
    for status in fs.globStatus(where) or []:
        if not status.isDirectory():
            out.append((status.getPath().toString(), status.getLen()))
            continue
        files = fs.listFiles(status.getPath(), True)
        while files.hasNext():
            file = files.next()
            if file.getPath().getName()[:1] not in "_.":
                out.append((file.getPath().toString(), file.getLen()))
    return sorted((_uri(p), n) for p, n in out if n)


def _uri(path: str) -> str:
    return path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file:///") else path


def read_json(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The rows of a JSON file, or of a folder's: of a root array, of an array under a known key, of lines, or one for an object;
    a scalar has none.

    A .jsonl file is read by lines without a look at it. Arrays are taken apart by ranges of bytes, whatever stands on a line,
    into lines in the shared folder; elements that aren't objects become rows of one column, `value`. An object without rows
    of its own is read by one task.
    """
    if extension(path) == "jsonl":
        return _named(spark.read.json(path))
    files = files_below(spark, path)
    if not files:
        return spark.createDataFrame([], "value string")
    found, held = read_arrays(spark, files, range_bytes)
    lines = [f.path for f in found if f.shape == "lines"]
    if any(f.regions for f in found):
        folder = f"{scratch(spark, 'json')}/t"
        held.select(F.when(F.col("value").startswith("{"), F.col("value")).otherwise(F.concat(F.lit('{"value": '), "value", F.lit("}"))).alias("value")).write.text(folder)
        lines.append(folder)
    out = spark.read.json(lines) if lines else None
    if objects := [f.path for f in found if f.shape == "object" and not f.regions]:
        rows = spark.read.option("multiLine", True).json(objects)
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return spark.createDataFrame([], "value string") if out is None else _named(out)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return _named(spark.read.parquet(path))


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """A file by its extension."""
    from tabweave.sources.xlsx import read_xlsx

    kind = extension(path)
    readers = {"csv": read_delimited, "tsv": read_delimited, "txt": read_delimited, "json": read_json, "jsonl": read_json, "parquet": read_parquet, "xlsx": read_xlsx}
    if kind not in readers:
        raise ValueError(f"no reader for .{kind}")
    return readers[kind](spark, path)


def collect_files(spark: SparkSession, folder: str, extensions: Sequence[str]) -> DataFrame:
    """(path, size, changed) of all files below a folder with one of the extensions, but for names that begin with . or ~."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(extensions) + "}").load(folder)
    files = listed.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("changed"))  # contents aren't read
    return files.where(~F.element_at(F.split("path", "/"), -1).rlike("^[.~]"))


def too_large(spark: SparkSession, path: str, most: int = MAX_FILE_BYTES) -> bool:
    fs, where = _path(spark, path)
    return fs.getContentSummary(where).getLength() > most


#: Bytes of a file that make a leaf of its signature, and leaves or nodes that make a node.
SIGNATURE_BLOCK, SIGNATURE_FANOUT = 4 << 20, 256


def signature(spark: SparkSession, path: str, task_blocks: int = 16) -> str:
    """Changes when the content of a file, or of a folder's files, does: a tree of hashes over blocks of fixed size.

    Blocks are hashed by tasks, `task_blocks` at a time, and combined in order, level by level, so a file of any size has a
    hash of its content, whatever the tasks. Names and lengths of files are part of it. The driver gets one hash.
    """
    files = files_below(spark, path)
    step = SIGNATURE_BLOCK * task_blocks
    root = _uri(_qualified(spark, path)).rstrip("/")
    spans = [(k, p, p.removeprefix(root).lstrip("/"), n, at) for k, (p, n) in enumerate(files) for at in range(0, n, step)]
    if not spans:
        return "sha:" + hashlib.sha256(b"").hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, p, n, at in zip(*(b.column(c).to_pylist() for c in ("file", "path", "size", "at")), strict=True):
                with opened(p) as file:
                    places = list(range(at, min(at + step, n), SIGNATURE_BLOCK))
                    hashes = [hashlib.sha256(file.read_at(min(SIGNATURE_BLOCK, n - x), x)).hexdigest() for x in places]
                yield pa.RecordBatch.from_pydict({"file": pa.array([k] * len(places), pa.int64()), "place": pa.array([x // SIGNATURE_BLOCK for x in places], pa.int64()), "sha": hashes})

    df = spark.createDataFrame(spans, "file long, path string, name string, size long, at long").repartitionByRange(min(len(spans), 100_000), "file", "at")
    nodes = df.mapInArrow(run, "file long, place long, sha string")
    hashed = lambda c: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda x: x["sha"]), ""), 256).alias("sha")

    def combined(nodes: DataFrame, most: int, *keys: str) -> DataFrame:
        while most > 1:
            nodes = nodes.groupBy(*keys, F.floor(F.col("place") / SIGNATURE_FANOUT).alias("place")).agg(hashed(F.struct("place", "sha")))
            most = -(-most // SIGNATURE_FANOUT)
        return nodes

    whole = combined(nodes, -(-max(n for _, n in files) // SIGNATURE_BLOCK), "file")
    named = df.where("at = 0").select("file", "name", "size").join(whole.drop("place"), "file")
    leaves = named.select(F.col("file").alias("place"), F.sha2(F.concat_ws(":", F.octet_length("name").cast("string"), "name", F.col("size").cast("string"), "sha"), 256).alias("sha"))
    return "sha:" + combined(leaves, len(files)).first().sha


def _qualified(spark: SparkSession, path: str) -> str:
    fs, where = _path(spark, path)
    return where.makeQualified(fs.getUri(), fs.getWorkingDirectory()).toString()


def register(df: DataFrame, view: str = SOURCE_VIEW) -> str:
    df.createOrReplaceTempView(view)
    return view
