"""Near copies by exact Jaccard similarity of five-word shingles; candidates from SimHash pigeonring and banded MinHash.

Rows of equal shingles are one class. Classes whose SimHash fingerprints lie within RADIUS bits are candidates, found by
pigeonring as in `simhash`. That alone can't do: at a similarity of 0.8 about ten of 64 bits differ, and a radius that
leaves no such pair out cuts the ring into segments too short to tell unrelated texts apart. So classes that share a band
of ROWS least hashes are candidates too (a pair at 0.8 shares none of BANDS with a probability of 1.2 in a million).

Candidates are first held against each other by parity sketches: every shingle turns over one of SKETCH bits, so what two
classes share cancels out, and the bits in which their sketches differ are no more than the shingles that only one of
them has. If that is too many for the similarity, the pair can't reach it. A candidate that is left is a link only if its
shingles are counted and reach the similarity.

A band's bucket of more than `light` classes is first compared with one of its classes alone, that which lies in the most
crowded buckets and so is likely to be the family's origin. Classes of such buckets that are still apart may be unrelated
but for a passage that very many share, as pages of one template are, so they aren't compared pair by pair: an exact
similarity join finds those that are near. Shingles are ordered by how many of these classes hold them, rarest first. Of
s and t shingles, s no more than t, a pair at the similarity shares at least 8/9 of s and 4/5 of t, so one of the first
s - 8/9 s + 1 of the one is among the first t - 4/5 t + 1 of the other (prefix filters), and where the first one that
they share stands, enough must be left behind it (positional filter). What is theirs alone comes first in the order, so
pages of a template meet only where their own parts are alike. The components are those of all candidate pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .components import components
from .shared import ROW_BYTES, files_for, parts, small_batches, valid, written
from .simhash import keep_one
from .simhash import links as ring_links
from .simhash import of_hashes

SHINGLE, SEED = 5, 42
#: Least similarity of near copies, as a fraction.
LEAST = (4, 5)
BANDS, ROWS = 45, 6
#: Fingerprints within so many bits are candidates.
RADIUS = 2
#: Bits of a parity sketch, of 64 a word.
SKETCH = 1024
#: Buckets up to this size are compared pair by pair.
LIGHT = 16
#: About the bytes that a shingle more makes a text longer.
WORD_BYTES = 6
#: So many pairs of one class are dealt out together.
DEALT = 64
_RNG = np.random.default_rng(SEED)
_FACTORS = _RNG.integers(0, 1 << 31, BANDS * ROWS, np.uint32) * np.uint32(2) + np.uint32(1)
_TERMS = _RNG.integers(0, 1 << 32, BANDS * ROWS, np.uint32)


def shingles(text: bytes | None, words: int = SHINGLE) -> np.ndarray:
    """The distinct shingles' hashes, ascending. A shorter text is one shingle, a blank or null one has none."""
    from xxhash import xxh64_intdigest

    found = (text or b"").lower().split()  # of bytes: A-Z, and the six ASCII blanks
    if not found:
        return np.zeros(0, np.uint64)
    n = max(1, len(found) - words + 1)
    parts = zip(*(found[i : i + n] for i in range(words)), strict=True) if len(found) >= words else [found]
    return np.unique(np.fromiter(map(xxh64_intdigest, map(b" ".join, parts), repeat(SEED)), np.uint64, n))


def class_of(text: bytes | None) -> int:
    """A hash of all shingles, unsigned; zero for none."""
    return _class(shingles(text))


def _class(found: np.ndarray) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(found.tobytes(), SEED) if len(found) else 0


def sketch(found: np.ndarray) -> list[int]:
    """The parity sketch of shingles' hashes, as signed words of 64 bits."""
    odd = np.bincount((found % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view("<i8").tolist()


def bands(found: np.ndarray) -> list[int]:
    """A signed hash for each band; none for no shingles."""
    from xxhash import xxh64_intdigest

    if not len(found):
        return []
    short, least = (found >> np.uint64(32)).astype(np.uint32)[:, None], np.full(BANDS * ROWS, (1 << 32) - 1, np.uint32)
    for at in range(0, len(short), 512):
        np.minimum(least, (short[at : at + 512] * _FACTORS + _TERMS).min(0), out=least)
    made = [xxh64_intdigest(row.tobytes(), i) for i, row in enumerate(least.reshape(BANDS, ROWS))]
    return np.array(made, np.uint64).view(np.int64).tolist()


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """The Jaccard similarity is LEAST or more, in whole numbers."""
    p, q = LEAST
    if q * min(len(a), len(b)) < p * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return q * both >= p * (len(a) + len(b) - both)


def _classes(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(x) for x in batch.column(2).cast(pa.binary()).to_pylist()]
            fps, sims = (np.array([of(x) for x in found], np.uint64).view(np.int64) for of in (_class, of_hashes))
            own = [pa.array(fps), pa.array(sims), pa.array([len(x) for x in found], pa.int64()), *(pa.array([of(x) for x in found], pa.list_(pa.int64())) for of in (bands, sketch))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *own, batch.column(2)], names=["row", "doc_id", "fp", "sim", "size", "bands", "sketch", "text"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), valid("text").alias("text"))
    return rows.mapInArrow(run, "row long, doc_id long, fp long, sim long, size long, bands array<long>, sketch array<long>, text string")


def _verified(pairs: DataFrame, texts: DataFrame, rows: int | None, held_bytes: int | None) -> DataFrame:
    """pairs (a, b, n: about how many pairs share an a; none twice) to those that are alike. texts: one (fp, text) for each
    class, of about held_bytes; rows: of a table of all bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            kept = []
            for a, b, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).cast(pa.binary()).to_pylist(), strict=True):
                if b is None:  # a's own text, before those to compare it with
                    held = shingles(text)
                elif alike(held, shingles(text)):
                    kept.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in kept], pa.int64()) for i in (0, 1)], names=["a", "b"])

    dealt = written(pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / DEALT)).alias("deal")), "pairs", rows)
    ids = dealt.select(F.col("a").alias("fp")).union(dealt.select("b")).distinct()
    needed = written(texts.join(ids, "fp", "left_semi"), "texts", held_bytes and held_bytes // ROW_BYTES)
    left = dealt.select("a", "deal").distinct().join(needed.withColumnRenamed("fp", "a"), "a").select("a", "deal", F.lit(None).cast("long").alias("b"), "text")
    right = dealt.join(needed.withColumnRenamed("fp", "b"), "b").select("a", "deal", "b", "text")
    both = left.union(right).repartition(parts(pairs.sparkSession), "a", "deal").sortWithinPartitions("a", "deal", F.asc_nulls_first("b"))
    return written(both.mapInArrow(run, "a long, b long"), "alike", held_bytes and held_bytes // ROW_BYTES)


def _near_in_size(p: Column, q: Column) -> Column:
    """The sizes alone leave the similarity within reach."""
    return LEAST[1] * F.least(p, q) >= LEAST[0] * F.greatest(p, q)


def _near_in_sketch(p: Column, q: Column, x: Column, y: Column) -> Column:
    """So do the sketches x and y. Of p and q shingles a pair at the similarity has at most these that only one side has."""
    differ = sum((F.bit_count(F.get(x, F.lit(i)).bitwiseXOR(F.get(y, F.lit(i)))) for i in range(SKETCH // 64)), F.lit(0))
    return sum(LEAST) * differ <= (LEAST[1] - LEAST[0]) * (p + q)


def _within_reach(pairs: DataFrame, heads: DataFrame) -> DataFrame:
    """pairs (a, p, b, q, n), each once, but for those that sizes or sketches rule out."""
    once = pairs.where(_near_in_size(F.col("p"), F.col("q"))).groupBy("a", "p", "b", "q").agg(F.max("n").alias("n"))
    a, b = (heads.select(F.col("fp").alias(x), F.col("sketch").alias(f"{x}_sketch")) for x in "ab")
    both = once.join(a, "a").join(b, "b")
    return both.where(_near_in_sketch(F.col("p"), F.col("q"), F.col("a_sketch"), F.col("b_sketch"))).select("a", "b", "n")


def _near_fingerprints(heads: DataFrame, n: int | None) -> DataFrame:
    """heads (fp, size, sim) to candidates (a, p, b, q, n): one class of each fingerprint with its others, and with those of fingerprints near by."""
    first = written(heads.groupBy("sim").agg(F.min(F.struct("fp", "size")).alias("lead"), F.count("*").alias("n")), "fingerprints", n)
    same = heads.join(first.where("n > 1"), "sim").where("fp <> lead.fp").select(F.col("lead.fp").alias("a"), F.col("lead.size").alias("p"), F.col("fp").alias("b"), F.col("size").alias("q"), "n")
    one, two = (first.select(F.col("sim").alias(x), F.col("lead").alias(f"{x}_lead")) for x in "ab")
    near = ring_links(first.select(F.col("sim").alias("fp")), RADIUS, rows=n).distinct().join(one, "a").join(two, "b")
    return same.union(near.select(F.col("a_lead.fp").alias("a"), F.col("a_lead.size").alias("p"), F.col("b_lead.fp").alias("b"), F.col("b_lead.size").alias("q"), F.lit(1).cast("long").alias("n")))


def links(heads: DataFrame, texts: DataFrame, light: int = LIGHT, n: int | None = None, held_bytes: int | None = None) -> DataFrame:
    """heads (fp, size: its shingles, sim, bands, sketch) and texts (fp, text), one row for each class, to edges (a, b) whose components are those of all verified candidates.

    n, held_bytes: about how many classes there are, and bytes of their texts; tables between steps get files accordingly.
    """
    rows = n and n * BANDS
    keyed = heads.select("fp", "size", F.explode("bands").alias("s"))
    shared = keyed.groupBy("s").agg(F.count("*").alias("n")).where("n > 1")
    keyed = written(keyed.join(shared, "s"), "buckets", rows)
    few = keyed.where(F.col("n") <= light)
    few = few.select("s", "n", F.col("fp").alias("a"), F.col("size").alias("p")).join(few.select("s", F.col("fp").alias("b"), F.col("size").alias("q")), "s").where("a < b").drop("s")
    crowded = keyed.where(F.col("n") > light)
    crowded = written(crowded.join(crowded.groupBy("fp").agg(F.count("*").alias("many")), "fp"), "crowded", rows)
    leads = crowded.groupBy("s").agg(F.max_by(F.struct("fp", "size"), F.struct("many", F.xxhash64("fp", "s"))).alias("lead"))
    stars = crowded.join(leads, "s").where("fp <> lead.fp").select("n", F.col("lead.fp").alias("a"), F.col("lead.size").alias("p"), F.col("fp").alias("b"), F.col("size").alias("q"))
    candidates = few.unionByName(stars).unionByName(_near_fingerprints(heads, n))
    out = _verified(_within_reach(candidates, heads), texts, rows, held_bytes)
    if not crowded.limit(1).count():
        return out
    roots = components(out, rows).select(F.col("node").alias("fp"), "root")
    crowded = written(crowded.join(roots, "fp", "left").select("s", "fp", "size", F.coalesce("root", "fp").alias("c")), "crowded-components", rows)
    apart = crowded.groupBy("s").agg(F.min("c").alias("one"), F.max("c").alias("other")).where("one <> other").select("s")
    classes = written(crowded.join(apart, "s", "left_semi").select("fp", "size", "c").distinct(), "apart", n)
    near = _within_reach(near_by_rare_shingles(classes, texts).withColumn("n", F.lit(1)), heads).drop("n")
    near = written(near, "apart-pairs", rows)
    return out.union(_verified(near.join(near.groupBy("a").agg(F.count("*").alias("n")), "a").select("a", "b", "n"), texts, rows, held_bytes))


def _least(share: Column, p: int, q: int) -> Column:
    """p q-ths of a whole number, rounded up."""
    return F.floor((p * share + (q - 1)) / q)


def near_by_rare_shingles(classes: DataFrame, texts: DataFrame) -> DataFrame:
    """classes (fp, size, c) to all pairs (a, p, b, q) of different c, with their sizes, that can be alike, each once: those
    with a shared shingle in both prefixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for fp, size, c, text in zip(*(b.column(k).to_pylist() for k in range(3)), b.column(3).cast(pa.binary()).to_pylist(), strict=True):
                found = shingles(text).view(np.int64)
                for at in range(0, len(found), 1 << 16):
                    part = pa.array(found[at : at + (1 << 16)])
                    yield pa.RecordBatch.from_arrays([pa.array([x] * len(part), pa.int64()) for x in (fp, size, c)] + [part], names=["fp", "size", "c", "shingle"])

    least, most = LEAST
    rows = classes.agg(F.sum("size")).first()[0] or 0
    held = written(texts.join(classes, "fp").select("fp", "size", "c", "text").mapInArrow(run, "fp long, size long, c long, shingle long"), "apart-shingles", rows)
    # shingles of one class alone stand first in its order, so they needn't be dealt out to know the places of the others
    often = held.groupBy("shingle").agg(F.count("*").alias("often")).where("often > 1")
    placed = held.join(often, "shingle")
    own = Window.partitionBy("fp")
    at = F.row_number().over(own.orderBy("often", "shingle")) + F.col("size") - F.count("*").over(own)
    placed = placed.select("fp", "size", "c", "shingle", at.alias("at")).where(F.col("at") <= F.col("size") - _least(F.col("size"), least, most) + 1)
    placed = placed.withColumn("early", F.col("at") <= F.col("size") - _least(F.col("size"), 2 * least, least + most) + 1)
    # pairs within a component aren't needed; of any other pair one side is outside the shingle's largest component
    by_component = placed.groupBy("shingle", "c").agg(F.count("*").alias("m"))
    largest = by_component.groupBy("shingle").agg(F.max_by("c", F.struct("m", "c")).alias("largest"), F.count("*").alias("several")).where("several > 1")
    placed = written(placed.join(largest.select("shingle", "largest"), "shingle"), "prefixes", rows)
    x = placed.where("c <> largest").select("shingle", *(F.col(k).alias(f"x_{k}") for k in ("fp", "size", "c", "at", "early")))
    y = placed.select("shingle", *(F.col(k).alias(f"y_{k}") for k in ("fp", "size", "c", "at", "early")))
    smaller = F.struct("x_size", "x_fp") < F.struct("y_size", "y_fp")
    left = F.least(F.col("x_size") - F.col("x_at"), F.col("y_size") - F.col("y_at")) + 1
    met = x.join(y, "shingle").where((F.col("x_c") != F.col("y_c")) & F.when(smaller, F.col("x_early")).otherwise(F.col("y_early")) & _near_in_size(F.col("x_size"), F.col("y_size")) & ((least + most) * left >= least * (F.col("x_size") + F.col("y_size"))))
    pair = lambda p, q: F.struct(F.col(f"{p}_fp").alias("a"), F.col(f"{p}_size").alias("p"), F.col(f"{q}_fp").alias("b"), F.col(f"{q}_size").alias("q"))
    return met.select(F.when(F.col("x_fp") < F.col("y_fp"), pair("x", "y")).otherwise(pair("y", "x")).alias("pair")).select("pair.*").distinct()


def near_copies(docs: DataFrame, light: int = LIGHT) -> DataFrame:
    """docs (doc_id, text) to (doc_id, fp: the class, root, component_id), one row for each row, as of near_duplicates.

    Rows of equal shingles, repeated rows among them, are one class; null and blank texts are one of their own; a text of
    fewer than five words is one shingle; texts are read whole. Null ids are kept; an empty table gives no rows; other
    columns are not read.
    """
    found = written(_classes(docs), "shingle-classes")
    distinct = written(found.groupBy("fp").agg(F.min("row").alias("row"), F.min("doc_id").alias("first_id")), "distinct-classes", found.count())
    n = distinct.count()
    one = found.join(distinct.select("row"), "row", "left_semi")
    heads = written(one.select("fp", "size", "sim", "bands", "sketch"), "heads", n * (BANDS + SKETCH // 64) // 3)
    held_bytes = WORD_BYTES * (heads.agg(F.sum("size")).first()[0] or 0) or None
    roots = written(components(links(heads, one.select("fp", "text"), light, n, held_bytes), n or None), "roots", n).select(F.col("node").alias("fp"), "root")
    linked = distinct.select("fp", "first_id").join(roots, "fp")
    first = linked.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = linked.join(first, "root").select("fp", "root", "component_id")
    named = distinct.select("fp", "first_id").join(named, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("component_id", "first_id").alias("component_id"))
    return found.select("doc_id", "fp").join(written(named, "components", n), "fp").select("doc_id", "fp", "root", "component_id").coalesce(files_for(found.count()))


def keep_one_copy(docs: DataFrame) -> DataFrame:
    """One row of docs for each component of near copies, with all its columns, chosen as by keep_one; null, blank and long
    texts, repeated rows and null ids are treated as in near_copies. Other columns may hold nulls and have any names."""
    return keep_one(docs, near_copies, class_of)
