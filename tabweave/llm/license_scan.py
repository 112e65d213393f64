"""Licence scans: fixed phrases, and an exact set-similarity join of text blocks with licence templates.

Tokens are pairs of consecutive words. A template is found in a block if the block holds at least `threshold`
of the template's distinct tokens. Tokens are ordered by how many
documents hold them, rarest first. A template of n tokens that needs an overlap of o must share one of its
n - o + 1 rarest tokens with a block, and that token is among the block's m - o + 1 rarest of m (prefix filters);
the block must hold o of the templates' tokens (length filter); and from where the shared token stands in both
orders, enough tokens must be left behind it (positional filter). What is left is verified. No pair is missed.

Templates of related licences share most of their tokens, so one text can reach the threshold of several. Where the
phrases that tell a template from its relatives are not all there, it gives way to a relative that was found in the same
block with all of its own; where there is none, as in a misspelt notice, it stays.

Every step is a DataFrame operation. A text is split into words once: what is kept of it are the phrases' counts
and the places of words that begin a template's token, a few hundredths of the text, in a written table. The
templates are a parameter, so their tokens, the frequencies of these and the prefix index are as small as they are.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .license_texts import TEMPLATES, Template
from .shared import valid, written

GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases and the label of each.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
THRESHOLD = 0.85
#: Templates that share so much of the smaller one's tokens are related.
RELATED = 0.5
#: Templates of up to so many words are looked for in short blocks, longer ones in long blocks.
SHORT = 32


def words_of(text: Column) -> Column:
    """The words of a text without nulls, with A to Z in small letters.

    Spark's lower case reaches beyond ASCII, which only matters where a letter becomes an ASCII one; the Kelvin sign is
    the only one that does alone, so another letter takes its place.
    """
    return F.filter(F.split(F.lower(F.replace(text, F.lit("K"), F.lit("κ"))), GAPS), lambda w: w != "")


def plain_words(text: str) -> list[str]:
    """The same for a template."""
    return [w for w in re.split(GAPS, re.sub("[A-Z]+", lambda m: m[0].lower(), text)) if w]


class Sought(NamedTuple):
    """A template by its tokens; step: the words after which its blocks begin, half of a block; kin: the places of related
    templates that have telling phrases."""

    label: str
    tokens: tuple[str, ...]
    must: tuple[str, ...]
    need: int
    step: int
    kin: tuple[int, ...]


def tokens_of(words: Sequence[str]) -> list[str]:
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:], strict=False)))


def sought(templates: Sequence[Template], threshold: float) -> list[Sought]:
    """Templates need two words at least. The blocks of all short and those of all long ones are alike."""
    sizes = [len(plain_words(t.text)) for t in templates]
    if min(sizes, default=2) < 2:
        raise ValueError("a template needs two words")
    short, long = max((n for n in sizes if n <= SHORT), default=0), max(sizes, default=0)
    out = []
    for t, n in zip(templates, sizes, strict=True):
        tokens = tokens_of(plain_words(t.text))
        must = [x for p in t.must for x in tokens_of(plain_words(p))]
        if set(must) - set(tokens):
            raise ValueError(f"what tells {t.label} from others isn't in it")
        out.append(Sought(t.label, tuple(tokens), tuple(must), math.ceil(threshold * len(tokens) - 1e-9), short if n <= SHORT else long, ()))
    near = lambda a, b: len({*a.tokens} & {*b.tokens}) >= RELATED * min(len(a.tokens), len(b.tokens))
    return [a._replace(kin=tuple(i for i, b in enumerate(out) if b is not a and b.must and near(a, b))) for a in out]


def _spaced(words: Column) -> Column:
    """' a b c '; for no words two blanks."""
    return F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))


def _phrase(norm: Column, n_words: Column, phrase: str) -> tuple[Column, Column, Column]:
    """Places, first and last start of a phrase in ' a b c '; what is between two places is cut out and its words are counted."""
    there = F.contains(norm, F.lit(f" {phrase} "))
    between = F.when(there, F.split(norm, f"(?<= ){re.escape(phrase).replace(chr(92) + ' ', ' ')}(?= )"))
    count = lambda x: F.char_length(x) - F.char_length(F.replace(x, F.lit(" "), F.lit(""))) - 1
    last = n_words - count(F.element_at(between, -1)) - len(phrase.split())
    return F.coalesce(F.size(between) - 1, F.lit(0)), count(F.element_at(between, 1)), last


def _inline(spark: SparkSession, rows: Sequence[tuple], names: str) -> DataFrame:
    """A small table of literals."""

    def lit(v: object) -> str:
        if isinstance(v, (list, tuple)):
            return f"array({', '.join(map(lit, v))})" if v else "cast(array() AS array<int>)"
        return f"'{v}'" if isinstance(v, str) else str(v)

    return spark.sql(f"SELECT * FROM VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)} AS t({names})")


def _scanned(docs: DataFrame, phrases: Mapping[str, str], tokens: Sequence[str]) -> DataFrame:
    """One row for each row of docs: row (a number of its own), doc_id, n_words, n_base, first_word, last_word, base_set, found (places and tokens)."""
    text = F.coalesce(valid("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(F.array(words_of(text))).alias("words"))  # generated, so computed once
    n_words = F.size("words").cast("long")
    begins = sorted({t.partition(" ")[0] for t in tokens})
    places = F.filter(F.transform("words", lambda w, i: F.when(w.isin(*begins), i)), lambda i: i.isNotNull())
    rows = rows.select("doc_id", n_words.alias("n_words"), _spaced(F.col("words")).alias("norm"), F.transform(places, lambda i: F.struct(i.alias("at"), F.concat_ws(" ", F.get("words", i), F.get("words", i + 1)).alias("token"))).alias("pairs"))
    hits = {p: _phrase(F.col("norm"), F.col("n_words"), p) for p in phrases}
    labels: dict[str, Column] = {}
    for p, label in phrases.items():
        labels[label] = labels.get(label, F.lit(False)) | (hits[p][0] > 0)
    none = F.lit(None).cast("long")
    return rows.select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        "n_words",
        sum((x[0] for x in hits.values()), F.lit(0)).cast("long").alias("n_base"),
        F.least(none, none, *(x[1].cast("long") for x in hits.values())).alias("first_word"),
        F.greatest(none, none, *(x[2].cast("long") for x in hits.values())).alias("last_word"),
        F.array_compact(F.array(*(F.when(labels[x], F.lit(x)) for x in sorted(labels)))).cast("array<string>").alias("base_set"),
        F.filter("pairs", lambda x: x["token"].isin(*tokens)).alias("found"),
    )


def _prefixes(templates: Sequence[Sought], rank: Mapping[str, int]) -> Iterator[tuple]:
    """The prefix index: token, place in the template's order, the template's number, label, need, step, ranks, those of its telling phrases, kin."""
    for k, t in enumerate(templates):
        ranks = sorted(rank[x] for x in t.tokens)
        for i, r in enumerate(ranks[: len(ranks) - t.need + 1]):
            yield r, i, k, t.label, t.need, t.step, ranks, [rank[x] for x in t.must], t.kin


def scan_licenses(docs: DataFrame, phrases: Mapping[str, str] = PHRASES, templates: Sequence[Template] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """docs (doc_id, text) to, for each row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, template, containment.

    n_base counts all places of the phrases, first_word and last_word are the smallest and the largest word at
    which one starts (null without any). labels holds base_labels and those of templates found. template is the label
    of the template of the largest containment (of several the last by name; null without any), containment that share, else 0.
    score is 1 with a phrase, else the containment. Null texts have no words, texts of any length are read whole; rows that
    are repeated get the same result each; null ids are kept; other columns are not read; an empty table gives no rows.

    Blocks are all runs of twice a step's words that start at a multiple of the step, which is the longest of the short
    templates or of the long ones. So a template that stands in one piece lies within a block wherever it starts.
    """
    spark = docs.sparkSession
    wanted = sought(templates, threshold)
    vocabulary = sorted({x for t in wanted for x in t.tokens})
    rows = written(_scanned(docs, phrases, vocabulary), "license-tokens")
    none = F.array().cast("array<string>")
    result = (
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base_set", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base_set", F.coalesce("more", none))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best.share", F.lit(0.0))).alias("score"),
        F.col("best.label").alias("template"),
        F.coalesce("best.share", F.lit(0.0)).alias("containment"),
    )
    if not wanted:
        return rows.select("*", none.alias("more"), F.lit(None).cast("struct<share: double, label: string>").alias("best")).select(*result)
    # the driver gets one row for each of the templates' tokens
    often = {r.token: r.n for r in rows.select(F.explode(F.array_distinct("found.token")).alias("token")).groupBy("token").agg(F.count("*").alias("n")).collect()}
    order = sorted(vocabulary, key=lambda x: (often.get(x, 0), x))
    rank = {x: i for i, x in enumerate(order)}
    ranks = _inline(spark, list(rank.items()), "token, rank")
    prefixes = _inline(spark, list(_prefixes(wanted, rank)), "rank, i, template, label, need, step, ranks, must, kin")
    least = {step: min(t.need for t in wanted if t.step == step) for step in {t.step for t in wanted}}

    places = rows.where(F.size("found") >= min(least.values())).select("row", "n_words", F.explode("found").alias("f")).select("row", "n_words", "f.at", "f.token")
    places = places.join(F.broadcast(ranks), "token")  # as small as the templates, like the prefixes below
    blocks = None
    for step, need in sorted(least.items()):
        k = F.floor(F.col("at") / step)
        # a pair of words lies in the block that begins before it, and in the one before that unless its second word lies beyond
        of = F.when(F.col("at") % step == step - 1, F.array(k)).otherwise(F.array(k, k - 1))
        own = places.select("row", F.lit(step).alias("step"), F.explode(of).alias("block"), "rank").where("block >= 0")
        own = own.groupBy("row", "step", "block").agg(F.sort_array(F.collect_set("rank")).alias("held")).where(F.size("held") >= need)
        blocks = own if blocks is None else blocks.union(own)
    size, total = F.size("held"), F.size("ranks")
    met = blocks.select("*", F.posexplode("held").alias("j", "rank")).join(F.broadcast(prefixes), ["rank", "step"])
    met = met.where((F.col("j") <= size - F.col("need")) & (F.least(total - F.col("i"), size - F.col("j")) + F.least("i", "j") >= F.col("need")))
    overlap = F.size(F.array_intersect("ranks", "held"))
    told = F.size(F.array_except("must", "held")) == 0
    sure = met.where(overlap >= F.col("need")).select("row", "step", "block", F.struct("template", "label", (overlap / total).alias("share"), told.alias("told"), "kin").alias("hit"))
    # a block has a hit for each template at most
    sure = sure.groupBy("row", "step", "block").agg(F.collect_set("hit").alias("hits"))
    stays = lambda x: x["told"] | ~F.exists("hits", lambda y: y["told"] & F.array_contains(x["kin"], y["template"]))
    sure = sure.select("row", F.explode(F.filter("hits", stays)).alias("hit")).groupBy("row").agg(F.collect_set("hit.label").alias("more"), F.max(F.struct("hit.share", "hit.label")).alias("best"))
    return rows.join(sure, "row", "left").select(*result)
