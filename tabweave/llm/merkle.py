"""A Merkle manifest of documents, and for every document the proof that leads from its leaf to the root.

A source's leaves stand in the order of their ids; while several nodes remain, every FANOUT consecutive ones become their
hash. What is left, the source's subroot, is a leaf of the tree over all sources, which ends in the root.

The work is dealt out in aligned chunks of FANOUT ** CHUNK_LEVELS leaves of a source. A chunk makes its own subtree. Then
come rounds of a butterfly exchange: in round r a group of FANOUT aligned runs of FANOUT ** r chunks swap their subtrees'
roots, a chunk with those that stand at the same place of the other runs, and each hashes their parent for itself. So every
chunk comes to hold its siblings on all levels, and no level is handed down from above. The last run of a level may be
short; its chunks then send to several places of the other runs. Once a source is whole, its chunks swap subroots with
other sources' chunks in the same way. A round moves at most FANOUT small rows for each chunk, none of them through the
driver, and is written to the shared folder.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import in_order, parts, small_batches, written

FANOUT = 16
#: A chunk has FANOUT to this power of leaves, which a task holds at a time.
CHUNK_LEVELS = 3
PROOF = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
_PATH = "array<struct<at:int,others:string>>"
_CHARS = 64


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def field(value: Column) -> Column:
    """`-` for null, else the value's UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(*values: Column) -> Column:
    """The digest of a row, in hex."""
    return F.sha2(F.concat(*map(field, values)).cast("binary"), 256)


def _height(n: int) -> int:
    levels = 0
    while n > 1:
        n, levels = -(-n // FANOUT), levels + 1
    return levels


def _levels(nodes: list[str], count: int) -> list[list[str]]:
    """A chunk's runs on each level, joined, from the leaves up; the last entry is the top node alone."""
    out = []
    for _ in range(count):
        runs = ["".join(nodes[i : i + FANOUT]) for i in range(0, len(nodes), FANOUT)]
        out.append(runs)
        nodes = [_hash(run) for run in runs]
    return [*out, nodes]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one (source_no, chunk) after the other, of rows sorted by these."""
    held: list[pa.RecordBatch] = []
    key = None
    for b in batches:
        keys = list(zip(b.column("source_no").to_pylist(), b.column("chunk").to_pylist(), strict=True))
        begin = 0
        for i, k in enumerate(keys):
            if k != key:
                if i > begin:
                    held.append(b.slice(begin, i - begin))
                if held:
                    yield pa.Table.from_batches(held)
                held, begin, key = [], i, k
        if len(keys) > begin:
            held.append(b.slice(begin))
    if held:
        yield pa.Table.from_batches(held)


def _own_levels(n_rows: int, chunk_levels: int) -> int:
    """Levels within a chunk: all of a source that is one chunk, else chunk_levels even where a node is alone."""
    return min(_height(n_rows), chunk_levels)


def _chunk_roots(placed: DataFrame, chunk_levels: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _chunks(batches):
            n = rows.column("n_rows")[0].as_py()
            top = _levels([x.hex() for x in rows.column("leaf").to_pylist()], _own_levels(n, chunk_levels))[-1][0]
            yield pa.RecordBatch.from_pylist([{"source_no": rows.column("source_no")[0].as_py(), "n_rows": n, "chunk": rows.column("chunk")[0].as_py(), "root": top}])

    dealt = placed.select("source_no", "chunk", "pos", "n_rows", "leaf").repartition(parts(placed.sparkSession), "source_no", "chunk").sortWithinPartitions("source_no", "chunk", "pos")
    return dealt.mapInArrow(run, "source_no long, n_rows long, chunk long, root string")


def _receivers(at: Column, count: Column, unit: int) -> Column:
    """To which places the one at `at` of `count` sends in the round whose runs have `unit` places: itself, and in each other
    run of its group those of the same place within the run, or, from a short run, of places that agree modulo its length."""
    run, low = F.floor(at / unit), at % unit
    first = F.floor(run / FANOUT) * FANOUT
    size = lambda r: F.least(F.lit(unit).cast("long"), count - r * unit)

    def of(r: Column) -> Column:
        begin, end = r * unit + low, r * unit + size(r) - 1
        return F.when(r == run, F.array(at)).when(begin <= end, F.sequence(begin, end, size(run))).otherwise(F.array().cast("array<long>"))

    return F.flatten(F.transform(F.sequence(first, F.least(first + FANOUT - 1, F.floor((count - 1) / unit))), of))


def _met(sent: DataFrame, place: str, unit: int) -> DataFrame:
    """Of the roots sent to each chunk (its own among them, with all that it holds) their parent, and its siblings' digests."""
    runs = F.array_sort(F.collect_list(F.struct("at", "root")))
    met = sent.groupBy("source_no", "chunk").agg(runs.alias("runs"), F.first("own", ignorenulls=True).alias("own"))
    digests = lambda nodes: F.array_join(F.transform(nodes, lambda x: x["root"]), "")
    at = F.floor(F.col(place) / unit) % FANOUT
    step = F.struct(at.cast("int").alias("at"), digests(F.filter("runs", lambda x: x["at"] != at)).alias("others"))
    return met.select("source_no", "chunk", "own.n_rows", "own.n_chunks", "own.subroot", F.sha2(digests("runs").cast("binary"), 256).alias("root"), F.concat("own.path", F.array(step)).cast(_PATH).alias("path"))


def _within_source(state: DataFrame, unit: int) -> DataFrame:
    """A round among the chunks of each source that has more than `unit` of them."""
    going = state.where(F.col("n_chunks") > unit)
    sent = going.select("*", F.explode(_receivers(F.col("chunk"), F.col("n_chunks"), unit)).alias("to"))
    sent = sent.select("source_no", F.col("to").alias("chunk"), (F.floor(F.col("chunk") / unit) % FANOUT).alias("at"), "root", F.when(F.col("to") == F.col("chunk"), F.struct("n_rows", "n_chunks", "subroot", "path")).alias("own"))
    return state.where(F.col("n_chunks") <= unit).unionByName(_met(sent, "chunk", unit))


def _among_sources(state: DataFrame, sources: DataFrame, n_sources: int, unit: int) -> DataFrame:
    """A round among sources: a chunk sends its source's node to chunks of the others that agree with it modulo its source's count."""
    sent = state.select("*", F.explode(_receivers(F.col("source_no"), F.lit(n_sources).cast("long"), unit)).alias("to"))
    sent = sent.join(sources.select(F.col("source_no").alias("to"), F.col("n_chunks").alias("to_chunks")), "to")
    own = F.col("to") == F.col("source_no")
    to_chunks = F.when(own, F.array("chunk")).when(F.col("chunk") < F.col("to_chunks"), F.sequence(F.col("chunk"), F.col("to_chunks") - 1, F.col("n_chunks"))).otherwise(F.array().cast("array<long>"))
    sent = sent.select(F.col("to").alias("source_no"), F.explode(to_chunks).alias("chunk"), (F.floor(F.col("source_no") / unit) % FANOUT).alias("at"), "root", F.when(own, F.struct("n_rows", "n_chunks", "subroot", "path")).alias("own"))
    return _met(sent, "source_no", unit)


def _placed(leaves: DataFrame, chunk_levels: int) -> tuple[DataFrame, DataFrame]:
    """Every leaf with its source's number, its place there and its chunk; and the sources with their numbers and counts."""
    source = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("-"))  # null first, then by bytes
    rows = leaves.select(F.col("doc_id").cast("long").alias("doc_id"), source.alias("source"), F.unhex("leaf").alias("leaf"), F.unhex("claim").alias("claim"))
    rows = in_order(written(rows, "leaves"), "leaf-order", "source", "doc_id", "leaf")
    found = written(rows.groupBy("part", "source").agg(F.min("at").alias("first"), F.count("*").alias("n")), "segments")
    sources = found.groupBy("source").agg(F.min("part").alias("home"), F.sum("n").alias("n_rows"))
    homes = sources.groupBy("home").count().collect()  # a row for each partition at most
    before, base = 0, []
    for home, n in sorted(homes):
        base.append((home, before))
        before += n
    base_rows = F.broadcast(leaves.sparkSession.createDataFrame(base, "home int, base long"))
    number = F.col("base") + F.row_number().over(Window.partitionBy("home").orderBy("source")) - 1
    width = FANOUT**chunk_levels
    sources = written(sources.join(base_rows, "home").select("source", number.alias("source_no"), "n_rows", F.ceil(F.col("n_rows") / width).alias("n_chunks")), "sources")
    start = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = found.withColumn("start", start - F.col("first")).join(sources, "source").select("part", "source", "start", "source_no", "n_rows")
    placed = rows.join(starts, ["part", "source"]).withColumn("pos", F.col("start") + F.col("at"))
    return written(placed.select("source_no", F.floor(F.col("pos") / width).alias("chunk"), "pos", "n_rows", "doc_id", "leaf", "claim"), "placed"), sources


def _proved(batches: Iterator[pa.RecordBatch], chunk_levels: int) -> Iterator[pa.RecordBatch]:
    """Rows of PROOF from the rows of chunks, the first of each being what the exchange has left there."""
    for rows in _chunks(batches):
        root, subroot, n = (rows.column(c)[0].as_py() for c in ("root", "subroot", "n_rows"))
        path = [(_CHARS * x["at"], x["others"]) for x in rows.column("path")[0].as_py()]
        above = "".join(others for _, others in path).encode()
        leaves = [x.hex() for x in rows.column("leaf").slice(1).to_pylist()]
        claims = [x and x.hex() for x in rows.column("claim").slice(1).to_pylist()]
        levels = _levels(leaves, _own_levels(n, chunk_levels))[:-1]
        proofs, folded = [], []
        for i, (leaf, claim) in enumerate(zip(leaves, claims, strict=True)):
            node, proof, k = claim or leaf, hashlib.sha256(), i
            for runs in levels:
                k, at = divmod(k, FANOUT)
                run, at = runs[k], at * _CHARS
                left, right = run[:at], run[at + _CHARS :]
                proof.update((left + right).encode())
                node = _hash(left + node + right)
            proof.update(above)
            for at, others in path:
                node = _hash(others[:at] + node + others[at:])
            proofs.append(proof.hexdigest())
            folded.append(node)
        yield pa.RecordBatch.from_arrays(
            [rows.column("doc_id").slice(1).combine_chunks(), pa.array(leaves), pa.array([subroot] * len(leaves)), pa.array([root] * len(leaves)), pa.array(proofs), pa.array(folded), pa.array([x == root for x in folded])],
            names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
        )


def prove(leaves: DataFrame, chunk_levels: int = CHUNK_LEVELS) -> DataFrame:
    """leaves (doc_id, source, leaf, claim) to rows of PROOF, one for each.

    `claim` is a digest whose place the leaf's is said to be, null for the leaf itself; it is folded with the leaf's
    siblings, and verified if that gives the root. Sources come by their UTF-8 bytes, null first; within one, null ids come
    first, and rows of one id by their leaves, so repeated rows are leaves of their own. A source's name may be empty.
    An empty table has no rows and no root; other columns are not read.
    """
    spark = leaves.sparkSession
    small_batches(spark)
    placed, sources = _placed(leaves, chunk_levels)
    most, n_sources = sources.agg(F.max("n_chunks"), F.count("*")).first()
    state = _chunk_roots(placed, chunk_levels).join(sources.select("source_no", "n_chunks"), "source_no")
    state = written(state.select("source_no", "chunk", "n_rows", "n_chunks", F.lit(None).cast("string").alias("subroot"), "root", F.array().cast(_PATH).alias("path")), "chunks")
    for r in range(_height(most or 0)):
        state = written(_within_source(state, FANOUT**r), "swapped")
    state = state.withColumn("subroot", F.col("root"))
    for r in range(_height(n_sources)):
        state = written(_among_sources(state, sources, n_sources, FANOUT**r), "swapped")
    none = lambda kind: F.lit(None).cast(kind)
    held = state.select("source_no", "chunk", F.lit(-1).cast("long").alias("pos"), "n_rows", none("long").alias("doc_id"), none("binary").alias("leaf"), none("binary").alias("claim"), "root", "subroot", "path")
    rows = placed.select(*held.columns[:7], none("string").alias("root"), none("string").alias("subroot"), none(_PATH).alias("path")).unionByName(held)
    dealt = rows.repartition(parts(spark), "source_no", "chunk").sortWithinPartitions("source_no", "chunk", "pos")
    return dealt.mapInArrow(lambda batches: _proved(batches, chunk_levels), PROOF)
