"""A mix of sources to target weights: which documents it takes, how often, and how much of the one at the edge.

Sizes are words. Targets follow from weights and stop at `most` times a source's size. A source's words to take are so many
whole copies of it and a rest, so the budgets of its copies are nested: at most one is neither all of the source nor
nothing. The rest is taken from the documents of the smallest hashes. Where it ends is found without a sort: words are
summed by source and bucket of the hash's next ten bits, the bucket in which the budget runs out is the only one that is
looked at again, by the next ten bits, until it holds one document. That one is taken in part, so a source's words are its
target, rounded. Hashes follow from id and text; rows that agree in both are told apart by their places, which matters to
nothing but which of equal rows is taken.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import numbered, valid, written

WORD = r"[^\x20\x09-\x0D]+"
#: Bits of a hash and of a row's place, and those that a round looks at.
HASH_BITS, PLACE_BITS, STEP = 60, 60, 10


def words_in(text: Column) -> Column:
    """The number of words of a text; null: 0."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def hashed(doc_id: Column, text: Column) -> Column:
    """60 bits that follow from a document alone."""
    whole = F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), F.coalesce(text.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(whole.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def targets(sources: DataFrame, share: float, most: int) -> DataFrame:
    """sources (source_size, weight) with `target`: all sizes times `share`, dealt out by weight; what is above `most` times a
    source's size goes to the others by weight, until none is above.

    The rate for each unit of weight is found by Newton's method from below: the sum of capped targets is concave in it.
    """
    size, weight = F.col("source_size"), F.col("weight")
    total = sources.agg(F.sum(size)).first()[0] or 0
    wanted, rate, full = share * total, 0.0, -1
    while True:
        capped = most * size <= rate * weight if full >= 0 else F.lit(False)
        n, held, left = sources.agg(F.count_if(capped), F.sum(F.when(capped, most * size)), F.sum(F.when(~capped, weight))).first()
        if n == full:
            break
        full, rate = n, (wanted - (held or 0)) / left if left else float("inf")
    return sources.withColumn("target", F.least((most * size).cast("double"), F.lit(rate) * weight))


def _digit(round_no: int) -> Column:
    """The bits that a round looks at: those of the hash from the top, then those of the place."""
    rounds = HASH_BITS // STEP
    name, left = ("hash", HASH_BITS - STEP * (round_no + 1)) if round_no < rounds else ("row", PLACE_BITS - STEP * (round_no + 1 - rounds))
    return F.shiftright(name, left).bitwiseAND((1 << STEP) - 1)


def _edges(sized: DataFrame, rests: DataFrame) -> DataFrame:
    """For each source with a rest (source, rest) the document at which it runs out: its hash and row, and how many of its words are taken."""
    name = sized.select("source", "hash", "row", "size").where("size > 0").join(rests.select("source"), "source")
    left, round_no = rests, 0
    while True:
        bucket = _digit(round_no).alias("digit")
        sums = name.groupBy("source", bucket).agg(F.sum("size").alias("words"), F.count("*").alias("n"))
        before = F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("digit").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        over = sums.withColumn("before", before).join(left, "source").where("before <= rest AND rest < before + words")
        left = written(over.select("source", "digit", (F.col("rest") - F.col("before")).alias("rest"), "n"), "edge")
        inside = name.withColumn("digit", bucket).join(left.select("source", "digit"), ["source", "digit"]).drop("digit")
        if (left.agg(F.max("n")).first()[0] or 1) == 1:
            return inside.join(left.select("source", "rest"), "source").select("source", F.col("hash").alias("edge_hash"), F.col("row").alias("edge_row"), F.col("rest").alias("edge_words"))
        name, left, round_no = written(inside, "inside-edge"), left.select("source", "rest"), round_no + 1


def mix_documents(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: int = 2, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """docs (doc_id, source, text, and what `keep` names) to (doc, size, source_size, target, taken), one row for each row.

    doc holds the columns of `keep`. Sources by code point, null last, have the weights in turn, over and over. `taken` is the
    number of words that the mix takes of a document, repeats counted: whole copies, and less than one copy more of the
    document at a source's edge. A null text has no words, and what has none is never taken; null ids and empty names of
    sources are like others; of repeated rows each is counted, and which of them is taken is one for all that can be seen.
    Weights are above zero; if `share` is more than `most`, all targets are `most` times their sources' sizes. An empty table
    has no rows. Other columns are not read.
    """
    source = F.coalesce(F.concat(F.lit("0"), F.col("source").cast("string")), F.lit("1"))  # null last
    sized = written(docs.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("doc"), source.alias("source"), words_in(valid("text")).alias("size"), hashed(F.col("doc_id"), valid("text")).alias("hash"), F.monotonically_increasing_id().alias("row")), "sized")
    sources = numbered(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "source-sizes", "source")
    in_turn = F.get(F.array(*(F.lit(float(w)) for w in weights)), (F.col("number") % len(weights)).cast("int"))
    sources = written(targets(sources.withColumn("weight", in_turn), share, most), "targets")
    words = F.floor(F.col("target") + 0.5)
    budgets = sources.select("source", "source_size", "target", F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size"))).otherwise(0).alias("copies"), words.alias("words"))
    rests = budgets.select("source", (F.col("words") - F.col("copies") * F.col("source_size")).alias("rest")).where("rest > 0")
    edges = written(_edges(sized, rests), "edges")
    more = F.when((F.col("hash") < F.col("edge_hash")) | ((F.col("hash") == F.col("edge_hash")) & (F.col("row") < F.col("edge_row"))), F.col("size")).when(F.col("row") == F.col("edge_row"), F.col("edge_words")).otherwise(0)
    both = budgets.join(edges, "source", "left")
    return sized.join(both, "source").select("doc", "size", "source_size", "target", (F.col("copies") * F.col("size") + more).alias("taken"))


def drawn_texts(mixed: DataFrame) -> DataFrame:
    """The rows of a mix that kept `text`: (doc, copy, words), a row for each copy taken, copies from 0; of a last copy in part, its first words."""
    words = F.filter(F.split(F.coalesce(F.col("doc.text"), F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    copies = mixed.where("taken > 0").select("doc", "size", "taken", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("taken") - 1) / F.col("size")))).alias("copy"))
    length = F.least(F.col("size"), F.col("taken") - F.col("copy") * F.col("size"))
    return copies.select("doc", "copy", F.slice(words, F.lit(1), length.cast("int")).alias("words"))
