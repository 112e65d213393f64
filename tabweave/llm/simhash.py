"""SimHash near-duplicates: fingerprints, pigeonring candidates, components.

A fingerprint of 64 bits is cut into a ring of `radius + 1` segments. If two
fingerprints differ in at most `radius` bits, then from some segment onwards every
chain of k consecutive segments has at most k * radius / (radius + 1) differing bits,
which is k - 1 in whole bits (the pigeonring principle). So fingerprints meet where a
first segment is equal, and a pair is compared in full only if all chains from there
keep within their budgets.

A first segment that more than `light` fingerprints share is refined by the same principle:
its fingerprints may differ only in the bits that vary among them, so these bits are cut into a
ring of segments of their own. The fingerprints meet again where one of these is equal too, and so
on until few share what is equal, or vary in no more than `radius` bits. Every turn settles a
share of the bits that vary, so no bucket stays crowded, and no pair is lost on the way.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import small_batches, valid, written

SHINGLE, RADIUS, SEED = 3, 2, 42
#: Fingerprints that share a first segment are compared pair by pair up to this number.
LIGHT = 64


def fingerprint(text: bytes | None, words: int = SHINGLE, seed: int = SEED) -> int:
    """The fingerprint of a UTF-8 text, unsigned."""
    from xxhash import xxh64_intdigest

    found = (text or b"").lower().split()  # of bytes: A-Z, and the six ASCII blanks
    if not found:
        return 0
    if len(found) < words:
        return xxh64_intdigest(b" ".join(found), seed)
    n = len(found) - words + 1
    return of_hashes(np.fromiter(map(xxh64_intdigest, map(b" ".join, zip(*(found[i:] for i in range(words)), strict=False)), repeat(seed)), "<u8", n))


def of_hashes(hashes: np.ndarray) -> int:
    """The fingerprint of shingles' hashes: the bits that over half of them have."""
    n, counts = len(hashes), np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        part = hashes[at : at + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """docs (doc_id, text) to (doc_id, fp: the fingerprint as a signed long). Null texts are empty."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(x, words, seed) for x in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(found, np.uint64).view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), valid("text").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def ring(radius: int = RADIUS, bits: int = (1 << 64) - 1) -> list[int]:
    """The bit masks of the segments into which `bits` are cut, unsigned; all of about the same width."""
    own, m, at, out = [i for i in range(64) if bits >> i & 1], radius + 1, 0, []
    for i in range(m):
        width = len(own) // m + (i < len(own) % m)
        out.append(sum(1 << k for k in own[at : at + width]))
        at += width
    return out


def _starts(radius: int, vary: int) -> list[tuple[int, list[int]]]:
    """For each segment of the bits that vary: what is equal where it is, and the longer chains from it onwards, as masks."""
    masks, out = ring(radius, vary), []
    for i in range(len(masks)):
        chains, seen = [], 0
        for m in (*masks[i:], *masks[:i]):
            seen |= m
            chains.append(_signed(seen))
        out.append((_signed(~vary & (1 << 64) - 1 | masks[i]), chains[1:-1]))
    return out


def _rings(crowded: DataFrame, radius: int) -> DataFrame:
    """The bits that vary (v) in crowded buckets, each once, to (v, fixed, chains) for each segment they are cut into."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(v, *x) for v in b.column(0).to_pylist() for x in _starts(radius, v & (1 << 64) - 1)]
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["v", "fixed", "chains"])

    return crowded.select("v").distinct().mapInArrow(run, "v long, fixed long, chains array<long>")


def links(distinct: DataFrame, radius: int = RADIUS, light: int = LIGHT, rows: int | None = None) -> DataFrame:
    """distinct (fp: long, no repeats; about so many rows) to all pairs (a, b), a < b, that lie within `radius` of one another; pairs may repeat."""
    whole = [F.struct(F.lit(f).alias("fixed"), F.array(*map(F.lit, chains)).cast("array<long>").alias("chains")) for f, chains in _starts(radius, (1 << 64) - 1)]
    held, out = distinct.select("fp", F.explode(F.array(*whole)).alias("m")).select("fp", "m.*"), None
    while True:
        keyed = held.select("fp", F.xxhash64("fixed", "chains").alias("node"), F.col("fp").bitwiseAND(F.col("fixed")).alias("s"), "chains")
        shared = keyed.groupBy("node", "s").agg(F.count("*").alias("n"), F.bit_or("fp").bitwiseXOR(F.bit_and("fp")).alias("v")).where("n > 1")
        keyed = written(keyed.join(shared, ["node", "s"]), "segments", rows and rows * (radius + 1))
        slim = (F.col("n") <= light) | (F.bit_count("v") <= radius)
        few = keyed.where(slim)
        a, b = few.select("node", "s", "chains", F.col("fp").alias("a")), few.select("node", "s", F.col("fp").alias("b"))
        x = F.col("a").bitwiseXOR(F.col("b"))
        within = F.bit_count(x) <= radius
        for k in range(2, radius + 1):
            within = (F.bit_count(x.bitwiseAND(F.get("chains", F.lit(k - 2)))) <= k - 1) & within
        found = a.join(b, ["node", "s"]).where((F.col("a") < F.col("b")) & within).select("a", "b")
        out = found if out is None else out.union(found)
        crowded = keyed.where(~slim).select("fp", "v")
        if not crowded.limit(1).count():
            return out
        # the same bits may be equal in a bucket reached in several ways
        held = crowded.join(_rings(crowded, radius), "v").select("fp", "fixed", "chains").distinct()


def near_duplicates(docs: DataFrame, words: int = SHINGLE, seed: int = SEED, radius: int = RADIUS, light: int = LIGHT) -> DataFrame:
    """docs (doc_id, text) to (doc_id, fp, root, component_id), one row for each row of docs.

    Documents are linked if their fingerprints differ in at most `radius` bits; root is the component's
    smallest fingerprint, component_id the smallest doc_id reachable (null only where every id of the
    component is null). Null and blank texts have fingerprint zero. Repeated rows give repeated rows.
    Other columns are not read; an empty table gives no rows.
    """
    found = written(fingerprints(docs, words, seed), "fingerprints")
    distinct = written(found.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints")
    roots = written(components(links(distinct.select("fp"), radius, light)), "roots").select(F.col("node").alias("fp"), "root")
    linked = distinct.join(roots, "fp")
    first = linked.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = linked.join(first, "root").select("fp", "root", "component_id")
    named = distinct.join(named, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("component_id", "first_id").alias("component_id"))
    return found.join(written(named, "components"), "fp").select("doc_id", "fp", "root", "component_id")


def keep_one(docs: DataFrame, classes: Callable[[DataFrame], DataFrame] = near_duplicates, fingerprint_of: Callable[[bytes | None], int] = fingerprint) -> DataFrame:
    """One row of docs (doc_id, text and any others) for each component, with all its columns: that of the smallest doc_id.

    Of several rows with that id one stays. A component without any id keeps one of its rows. `classes` gives what
    near_duplicates gives, `fingerprint_of` the fp that a text has there. Null and empty texts are alike, texts are read
    whole, an empty table stays empty; other columns may hold nulls and have any names.
    """
    found = written(classes(docs), "classes")
    chosen = found.where("doc_id <=> component_id").select(F.col("doc_id").alias("kept_id"), "fp", "root")
    several = written(found.groupBy(F.col("doc_id").alias("kept_id")).count().where("count > 1 OR kept_id IS NULL").select("kept_id"), "repeated-ids", found.count())
    # the columns of docs stand within a row, so their names meet no others
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("row_id"), F.coalesce(valid("text"), F.lit("")).alias("row_text"))
    single = chosen.join(several, "kept_id", "left_anti").where("kept_id IS NOT NULL").select("kept_id")
    out = rows.join(single, F.col("row_id") == F.col("kept_id"), "left_semi").select("row.*")
    if several.limit(1).count():
        # an id doesn't tell these rows apart, so they are chosen by id and text
        again = chosen.join(several, chosen.kept_id.eqNullSafe(several.kept_id), "left_semi").distinct()
        repeated = rows.join(several, F.col("row_id").eqNullSafe(F.col("kept_id")), "left_semi")
        keyed = repeated.join(_by_text(repeated, fingerprint_of), "row_text")
        keyed = keyed.join(again, F.col("row_id").eqNullSafe(F.col("kept_id")) & (F.col("row_fp") == F.col("fp"))).dropDuplicates(["root"])
        out = out.union(keyed.select("row.*"))
    return out


def _by_text(rows: DataFrame, fingerprint_of: Callable[[bytes | None], int]) -> DataFrame:
    """Each distinct row_text of rows with its fingerprint, row_fp."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint_of(x) for x in batch.column(0).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(found, np.uint64).view(np.int64))], names=["row_text", "row_fp"])

    return rows.select("row_text").distinct().mapInArrow(run, "row_text string, row_fp long")


def hex_fingerprint(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
