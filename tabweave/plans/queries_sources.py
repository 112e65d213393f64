"""Queries for sources: tables are written in a format to the shared folder and read back by the library's readers."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabweave.operators.order_page import ROW
from tabweave.operators.sampling import all_texts
from tabweave.plans.inputs import CELLS_SQL, cells, table
from tabweave.session import scratch
from tabweave.sources.files import DELIMITERS, collect_files, line_cells, read_any, read_delimited, read_json, read_lines_range, read_parquet, signature, too_large, with_row_index
from tabweave.streaming.folder_watch import changes, on_new_files, poll, stream_folder

_KEPT = ["k", "vendor", "cost", "placed", "region"]
_FILLED = "coalesce(k, '') AS k, coalesce(trim(vendor), '') AS vendor, coalesce(trim(cost), '') AS cost, coalesce(placed, '') AS placed, region"


def _delimited(sep: str, ending: str, multi_line: bool = True):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        folder = scratch(spark, "delimited")
        cells(spark, sf_dir).select(*_KEPT).write.mode("overwrite").option("header", True).option("sep", sep).option("escape", '"').csv(f"{folder}/t.{ending}")
        return read_delimited(spark, f"{folder}/t.{ending}", sep, multi_line)

    return run


def quoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells with delimiters, quotes and line feeds."""
    folder = scratch(spark, "quoted")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit('say "'), F.regexp_replace(F.trim("text"), r"\s+$", ""), F.lit('", twice')).alias("Text Cell"))
    rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{folder}/q.csv")
    return read_delimited(spark, f"{folder}/q.csv").select("doc_id", F.md5("text_cell").alias("digest"))


def row_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row numbers of one file read in splits."""
    folder = scratch(spark, "places")
    cells(spark, sf_dir).select("k").repartition(1).sort("k").write.mode("overwrite").text(f"{folder}/t")
    df = with_row_index(spark.read.text(f"{folder}/t"))
    return df.select(F.col("value").alias("k"), F.col(ROW).alias("place"))


def lines_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "lines")
    rows = table(spark, sf_dir, "nation").orderBy("n_nationkey").select(F.concat_ws(",", "n_nationkey", "n_name", "n_regionkey").alias("value"))
    head = spark.createDataFrame([("a banner, of two cells",), ("Key,Name,Region Key",)], "value string")
    head.withColumn("i", F.lit(0)).union(rows.withColumn("i", F.lit(1))).coalesce(1).sortWithinPartitions("i").select("value").write.mode("overwrite").text(f"{folder}/t")
    return read_lines_range(spark, f"{folder}/t", 2, 12).drop(ROW)


def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "json")
    cells(spark, sf_dir).select("k", "vendor", "qty").repartition(1).write.mode("overwrite").json(f"{folder}/t")
    file = collect_files(spark, f"{folder}/t", ["json"]).first().path
    return read_json(spark, file).select("k", "vendor", "qty")


def _json(wrap):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        folder = scratch(spark, "json")
        rows = [r.asDict() for r in table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()]
        text = json.dumps(wrap(rows), indent=1)
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/t")
        file = collect_files(spark, f"{folder}/t", ["txt"]).first().path
        return read_json(spark, file).selectExpr("CAST(n_nationkey AS INT) AS n_nationkey", "n_name", "CAST(n_regionkey AS INT) AS n_regionkey")

    return run


def json_array_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as a folder of arrays, thousands of elements on a line, read by ranges of 64 KiB."""
    folder = scratch(spark, "json")
    rows = table(spark, sf_dir, "lineitem").select(F.to_json(F.struct("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.concat(F.lit('a "]},\\ '), "l_returnflag").alias("note"))).alias("value"))

    def arrays(batches):
        import pyarrow as pa

        mark = "["
        for b in batches:
            yield pa.RecordBatch.from_pydict({"value": [mark + ", ".join(b.column(0).to_pylist())]})
            mark = ", "
        yield pa.RecordBatch.from_pydict({"value": ["]" if mark == ", " else "[]"]})

    rows.mapInArrow(arrays, "value string").write.text(f"{folder}/t")
    return read_json(spark, f"{folder}/t", 1 << 16).select("l_orderkey", "l_partkey", "l_suppkey", F.col("l_linenumber").cast("int").alias("l_linenumber"), "note")


def json_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "json")
    table(spark, sf_dir, "nation").select(F.max("n_nationkey").cast("string").alias("value")).coalesce(1).write.mode("overwrite").text(f"{folder}/t")
    return read_json(spark, collect_files(spark, f"{folder}/t", ["txt"]).first().path)


def json_long_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines in a .json file whose first one is far longer than the others."""
    folder = scratch(spark, "json")
    df = table(spark, sf_dir, "nation").select("n_nationkey", F.when(F.col("n_nationkey") == 0, F.repeat(F.lit("a {[ "), F.lit(20_000))).otherwise(F.col("n_name")).alias("n_name"))
    df.coalesce(1).sortWithinPartitions("n_nationkey").write.mode("overwrite").json(f"{folder}/t")
    return read_json(spark, collect_files(spark, f"{folder}/t", ["json"]).first().path).select(F.col("n_nationkey").cast("int").alias("n_nationkey"), F.length("n_name").alias("size"))


def json_wrapper_behind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A wrapper's array behind a long field, and one of less standing before it; an array of numbers."""
    folder = scratch(spark, "json")
    rows = [r.asDict() for r in table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()]
    for name, held in (("a", {"note": "x]}, " * 50_000, "value": [1, 2], "items": rows}), ("b", [r["n_nationkey"] for r in rows])):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.json")
        out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
        out.write(bytearray(json.dumps(held).encode()))
        out.close()
    a, b = (read_json(spark, f"{folder}/{n}.json") for n in "ab")
    return a.join(b, a.n_nationkey == b.value).selectExpr("CAST(value AS INT) AS value", "n_name")


def _put(spark: SparkSession, path: str, data: bytes) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    out.write(bytearray(data))
    out.close()


def _lines(df: DataFrame, path: str, *head: str) -> None:
    """Rows of (key, value) as a file of lines in the order of the key, below a few first ones."""
    spark = df.sparkSession
    _put(spark, path, "".join(f"{x}\n" for x in [*head, *(r.value for r in df.orderBy("key").collect())]).encode())


def ragged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations of each region as a file, some rows short and some long: filled and cut, or refused."""
    folder = scratch(spark, "ragged")
    cells_of = F.concat_ws(",", F.col("n_nationkey"), F.when(F.col("n_nationkey") % 7 != 3, F.col("n_name")), F.when(F.col("n_nationkey") % 7 != 3, F.col("n_regionkey")), F.when(F.col("n_nationkey") % 11 == 2, F.lit("more")))
    df = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), "n_regionkey", cells_of.alias("value"))
    out = None
    for (region,) in sorted(df.select("n_regionkey").distinct().collect()):
        path = f"{folder}/{region}.csv"
        _lines(df.where(F.col("n_regionkey") == region), path, "key,name,region")
        try:
            read_delimited(spark, path, strict=True).write.format("noop").mode("overwrite").save()
            refused = False
        except Exception as e:
            if "MALFORMED" not in str(e).upper():
                raise
            refused = True
        own = read_delimited(spark, path).withColumn("refused", F.lit(refused))
        out = own if out is None else out.union(own)
    return out


def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations of each region as a file: which are beyond a cap, and whether a signature tells files apart by one character."""
    folder = scratch(spark, "sizes")
    df = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), "n_regionkey", F.col("n_name").alias("value"))
    rows = []
    for (region,) in sorted(df.select("n_regionkey").distinct().collect()):
        path = f"{folder}/{region}.txt"
        _lines(df.where(F.col("n_regionkey") == region), path)
        first = signature(spark, path)
        same = first == signature(spark, path)
        _lines(df.where(F.col("n_regionkey") == region).withColumn("value", F.concat(F.lit("~"), F.expr("substring(value, 2)"))), path)
        rows.append((region, too_large(spark, path, 50), same, first != signature(spark, path)))
    return spark.createDataFrame(rows, "region int, too_large boolean, stable boolean, told_apart boolean")


def watch_polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What polls of a folder tell: nothing of what was there, then what has come, changed and gone."""
    folder = scratch(spark, "polled")
    for name in ("old.csv", "gone.csv", "same.csv"):
        _put(spark, f"{folder}/in/{name}", b"a")
    found = [(0, r.path, r.change) for r in poll(spark, f"{folder}/in", f"{folder}/state", stable_seconds=0).collect()]
    _put(spark, f"{folder}/in/old.csv", b"ab")
    _put(spark, f"{folder}/in/new.json", b"{}")
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/in/gone.csv")
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, False)
    found += [(k, r.path, r.change) for k, wait in ((1, 1000), (2, 0), (3, 0)) for r in poll(spark, f"{folder}/in", f"{folder}/state", stable_seconds=wait).collect()]
    return spark.createDataFrame([(k, p.rpartition("/")[2], c) for k, p, c in found], "poll int, file string, change string")


def parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_parquet(spark, f"{sf_dir}/events.parquet").select("event_id", "event_type", "value")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_texts(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus"))


def workbook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cover sheet, then a table under a banner."""
    from tabweave.sources.xlsx import write_xlsx

    rows = [[r.n_nationkey, r.n_name, None, r.n_regionkey, True] for r in table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()]
    data = write_xlsx({"Cover": [["How to read this"], [None], ["see sheet two"]], "Data": [["banner"], ["Nation Key", "nationName", "Note", "Region Key", "Active"], *rows]})
    folder = scratch(spark, "workbook")
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/nations.xlsx")
    out = fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).create(fs_path)
    out.write(bytearray(data))
    out.close()
    return read_any(spark, f"{folder}/nations.xlsx")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each nation, below its region: those of two endings, but not hidden ones."""
    folder = scratch(spark, "files")
    for r in table(spark, sf_dir, "nation").collect():
        name = ("", ".", "~", "", "")[r.n_nationkey % 5] + r.n_name.lower() + (".csv", ".json", ".txt")[r.n_nationkey % 3]
        _put(spark, f"{folder}/{r.n_regionkey}/{name}", r.n_name.encode())
    return collect_files(spark, folder, ["csv", "json"]).select(F.element_at(F.split("path", "/"), -1).alias("file"), "size")


def watched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that a stream has taken from a folder, some of its files before and some after it stopped."""
    folder = scratch(spark, "watched")
    rows = cells(spark, sf_dir).select("k", "vendor", "cost")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in rows.columns])
    for part in (0, 1):
        rows.where(F.pmod(F.hash("k"), F.lit(2)) == part).write.mode("append").option("header", True).csv(f"{folder}/in")
        query = on_new_files(stream_folder(spark, f"{folder}/in", schema), f"{folder}/checkpoint", lambda df, i: df.write.mode("append").parquet(f"{folder}/out"))
        query.awaitTermination()
    out = spark.read.parquet(f"{folder}/out")
    return out.groupBy(F.coalesce("vendor", F.lit("")).alias("vendor")).agg(F.count(F.lit(1)).alias("n"))


def changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations before and after some left, some came and some grew, as if they were files."""
    df = table(spark, sf_dir, "nation")
    before = df.where("n_nationkey < 20").selectExpr("n_name AS path", "CAST(n_nationkey AS LONG) AS size", "TIMESTAMP '2024-01-01' AS changed")
    after = df.where("n_nationkey >= 5").selectExpr("n_name AS path", "CAST(n_nationkey + CASE WHEN n_nationkey % 3 = 0 THEN 1 ELSE 0 END AS LONG) AS size", "TIMESTAMP '2024-01-01' AS changed")
    return changes(before, after)


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file whose header names each nation's region, so that most names repeat; a column for each nation, with its name."""
    folder = scratch(spark, "headers")
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).orderBy("n_nationkey").collect()
    _put(spark, f"{folder}/h.csv", (",".join(f"In {r.r_name}" for r in rows) + "\n" + ",".join(r.n_name for r in rows) + "\n").encode())
    df = read_any(spark, f"{folder}/h.csv")
    return df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).alias("cell")) for c in df.columns))).alias("x")).select("x.*")


def sniffed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations in files of each delimiter, read without being told which; names hold the others."""
    folder, out = scratch(spark, "sniffed"), None
    df = table(spark, sf_dir, "nation")
    for k, d in enumerate(DELIMITERS):
        name = F.concat(F.lit('"a, b; c | '), "n_name", F.lit('"'))
        _lines(df.select(F.col("n_nationkey").alias("key"), F.concat_ws(d, "n_nationkey", name, "n_regionkey").alias("value")), f"{folder}/{k}.csv", d.join(("key", "name", "region")))
        own = read_any(spark, f"{folder}/{k}.csv").withColumn("file", F.lit(k))
        out = own if out is None else out.union(own)
    return out


def lines_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of quoted and padded cells, each taken apart by itself."""
    df = table(spark, sf_dir, "nation")
    line = F.concat(F.col("n_nationkey").cast("string"), F.lit(' , "say ""'), "n_name", F.lit('"", twice" ,, '), F.col("n_regionkey").cast("string"))
    return df.select("n_nationkey", line_cells(line, 4).alias("c")).select("n_nationkey", *(F.get("c", F.lit(i)).alias(f"c{i}") for i in range(4)))


_NATION = "SELECT n_nationkey, n_name, n_regionkey FROM nation"
ENTRIES = {
    "source_csv": (_delimited(",", "csv"), f"WITH {CELLS_SQL} SELECT {_FILLED} FROM c"),
    "source_csv_split": (_delimited(",", "csv", False), f"WITH {CELLS_SQL} SELECT {_FILLED} FROM c"),
    "source_tsv": (_delimited("\t", "tsv"), f"WITH {CELLS_SQL} SELECT {_FILLED} FROM c"),
    "source_csv_semicolon": (_delimited(";", "csv"), f"WITH {CELLS_SQL} SELECT {_FILLED} FROM c"),
    "source_csv_quoted": (quoted, "SELECT CAST(doc_id AS VARCHAR) AS doc_id, md5('say \"' || regexp_replace(trim(text), '\\s+$', '') || '\", twice') AS digest FROM documents"),
    "source_row_index": (row_places, f"WITH {CELLS_SQL} SELECT k, CAST(row_number() OVER (ORDER BY k) - 1 AS BIGINT) AS place FROM c"),
    "source_lines_range": (lines_range, "SELECT CAST(n_nationkey AS VARCHAR) AS key, n_name AS name, CAST(n_regionkey AS VARCHAR) AS region_key FROM nation WHERE n_nationkey < 10"),
    "source_json_lines": (json_lines, f"WITH {CELLS_SQL} SELECT k, vendor, qty FROM c"),
    "source_json_array": (_json(lambda rows: rows), _NATION),
    "source_json_wrapped": (_json(lambda rows: {"count": len(rows), "nested": {"data": [1]}, "results": rows}), _NATION),
    "source_json_object": (_json(lambda rows: rows[3]), f"{_NATION} ORDER BY n_nationkey LIMIT 1 OFFSET 3"),
    "source_json_long_first": (json_long_first, "SELECT n_nationkey, CAST(CASE WHEN n_nationkey = 0 THEN 100000 ELSE length(n_name) END AS INTEGER) AS size FROM nation"),
    "source_json_wrapper_behind": (json_wrapper_behind, "SELECT n_nationkey AS value, n_name FROM nation"),
    "source_ragged": (
        ragged,
        """
WITH n AS (SELECT *, n_nationkey % 7 = 3 OR n_nationkey % 11 = 2 AS odd FROM nation),
c AS (SELECT *, [CAST(n_nationkey AS VARCHAR)] || CASE WHEN n_nationkey % 7 <> 3 THEN [n_name, CAST(n_regionkey AS VARCHAR)] ELSE [] END || CASE WHEN n_nationkey % 11 = 2 THEN ['more'] ELSE [] END AS cells FROM n)
SELECT cells[1] AS key, coalesce(cells[2], '') AS name, coalesce(cells[3], '') AS region, bool_or(odd) OVER (PARTITION BY n_regionkey) AS refused FROM c""",
    ),
    "source_size_cap": (sizes, "SELECT n_regionkey AS region, sum(strlen(n_name) + 1) > 50 AS too_large, TRUE AS stable, TRUE AS told_apart FROM nation GROUP BY 1"),
    "folder_polls": (watch_polls, "SELECT * FROM (VALUES (1, 'gone.csv', 'removed'), (2, 'new.json', 'added'), (2, 'old.csv', 'changed')) t(poll, file, change)"),
    "source_json_ranges": (json_array_large, "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, 'a \"]},\\ ' || l_returnflag AS note FROM lineitem"),
    "source_json_scalar": (json_scalar, "SELECT '' AS value WHERE FALSE"),
    "source_parquet": (parquet, "SELECT event_id, event_type, value FROM events"),
    "source_all_texts": (texts, "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CASE WHEN o_totalprice = floor(o_totalprice) THEN CAST(CAST(o_totalprice AS BIGINT) AS VARCHAR) ELSE CAST(o_totalprice AS VARCHAR) END AS o_totalprice, o_orderstatus FROM orders"),
    "source_workbook": (workbook, "SELECT CAST(n_nationkey AS VARCHAR) AS nation_key, n_name AS nation_name, CAST(NULL AS VARCHAR) AS note, CAST(n_regionkey AS VARCHAR) AS region_key, 'true' AS active FROM nation"),
    "source_folder": (files, "SELECT lower(n_name) || ['.csv', '.json'][n_nationkey % 3 + 1] AS file, CAST(strlen(n_name) AS BIGINT) AS size FROM nation WHERE n_nationkey % 3 < 2 AND n_nationkey % 5 NOT IN (1, 2)"),
    "stream_new_files": (watched, f"WITH {CELLS_SQL} SELECT trim(coalesce(vendor, '')) AS vendor, count(*) AS n FROM c GROUP BY 1"),
    "folder_changes": (
        changed,
        "SELECT n_name AS path, CASE WHEN n_nationkey < 5 THEN 'removed' WHEN n_nationkey >= 20 THEN 'added' ELSE 'changed' END AS change FROM nation WHERE n_nationkey < 5 OR n_nationkey >= 20 OR n_nationkey % 3 = 0",
    ),
    "header_names": (
        headers,
        "SELECT 'in_' || lower(replace(r_name, ' ', '_')) || CASE WHEN k > 1 THEN '_' || CAST(k - 1 AS VARCHAR) ELSE '' END AS name, n_name AS cell FROM (SELECT r_name, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS k FROM nation JOIN region ON n_regionkey = r_regionkey)",
    ),
    "source_sniffing": (sniffed, "SELECT CAST(n_nationkey AS VARCHAR) AS key, 'a, b; c | ' || n_name AS name, CAST(n_regionkey AS VARCHAR) AS region, CAST(f AS INTEGER) AS file FROM nation, range(4) t(f)"),
    "source_line_split": (lines_split, "SELECT n_nationkey, CAST(n_nationkey AS VARCHAR) AS c0, 'say \"' || n_name || '\", twice' AS c1, '' AS c2, CAST(n_regionkey AS VARCHAR) AS c3 FROM nation"),
}
