"""Quality rules: counts of a text, and a table of thresholds compiled into one projection.

Everything is a built-in Spark expression. A text's words are split once; arrays that are
used again are bound to a lambda's variable, so that no step computes them anew per element.
Windows of words are equal if their 64-bit hashes are, which isn't verified: two different windows
of a text of a million words share one with a probability of about one in 40 million.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import valid

BLANKS = r"[\x20\x09-\x0D]+"
#: A word of two capitals or more and no small letter.
CAPITALS = r"^(?:[^\p{Ll}]*\p{Lu}){2}[^\p{Ll}]*$"
# Common words of English, French, Spanish and German.
STOP_WORDS = (
    "a an and are as at be by for from in is it of on or that the this to was with "
    "au avec dans de des du elle en est et la le les par pas pour que qui sur un une "
    "al como con del el las los no para por se su una y "
    "als auch auf das dem den der die ein eine für im ist mit nicht sich und von zu"
)


class Rule(NamedTuple):
    """A text fails if the feature is under `least` or over `most`."""

    feature: str
    least: float | None = None
    most: float | None = None


#: The table: length, word length, symbols, stop words, capitals, and repeats of lines and of windows of words.
RULES = (
    Rule("n_words", least=20),
    Rule("mean_word_chars", least=2, most=15),
    Rule("symbols_per_word", most=0.1),
    Rule("stop_word_share", least=0.02),
    Rule("capital_word_share", most=0.6),
    Rule("echo_word_share", most=0.2),
    Rule("dup_line_share", most=0.4),
    Rule("repeat_word_share", most=0.3),
    Rule("pipe_word_share", most=0.2),
)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words_of(text: Column) -> Column:
    """The words `[^\\x20\\x09-\\x0D]+` of a text without nulls."""
    return F.filter(F.split(text, BLANKS), lambda w: w != "")


def _windows(hashes: Column, size: int) -> Column:
    """A hash for each `size` (a power of two) consecutive entries, by doubling."""
    if size == 1:
        return hashes
    half = size // 2
    return _let(_windows(hashes, half), lambda h: F.transform(F.slice(h, 1, F.greatest(F.size(h) - half, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(h, i + half))))


def repeated_words(words: Column, window: int = 8) -> Column:
    """Words that lie in a window found twice or more, the first one included."""

    def covered(hashes: Column) -> Column:
        placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        found = _let(placed, lambda s: F.filter(F.transform(s, lambda x, k: F.when((F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]), x["i"])), lambda i: i.isNotNull()))
        return _let(F.sort_array(found), lambda at: F.aggregate(F.transform(at, lambda i, k: F.least(F.coalesce(F.get(at, k + 1) - i, F.lit(window)), F.lit(window))), F.lit(0), lambda a, b: a + b))

    hashes = _windows(F.transform(words, lambda w: F.xxhash64(w)), window)
    return _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h))).cast("long")


def features(text: Column, words: Column) -> dict[str, Column]:
    """Counts by name; text has no nulls, words are its words."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.char_length(F.array_join(words, "")).cast("long"),
        "n_symbols": (F.char_length(text) - F.char_length(F.regexp_replace(text, "[#*$%&|<>]+", ""))).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeated_words(words),
        "n_stop_words": F.size(F.filter(words, lambda w: F.lower(w).isin(*STOP_WORDS.split()))).cast("long"),
        "n_capital_words": F.size(F.filter(words, lambda w: w.rlike(CAPITALS))).cast("long"),
        "n_echo_words": _let(words, lambda ws: F.size(F.filter(ws, lambda w, i: w == F.get(ws, i - 1)))).cast("long"),
        "n_pipe_words": F.size(F.filter(words, lambda w: w == "|")).cast("long"),
    }


#: Shares by name, of the counts above.
RATIOS: dict[str, tuple[str, str]] = {
    "mean_word_chars": ("word_chars", "n_words"),
    "symbols_per_word": ("n_symbols", "n_words"),
    "stop_word_share": ("n_stop_words", "n_words"),
    "capital_word_share": ("n_capital_words", "n_words"),
    "echo_word_share": ("n_echo_words", "n_words"),
    "pipe_word_share": ("n_pipe_words", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_word_share": ("n_repeat_words", "n_words"),
}


def compile_rules(rules: Sequence[Rule], counts: dict[str, Column]) -> Column:
    """One boolean column: the counts satisfy every rule. A ratio of nothing is zero."""
    passed = F.lit(True)
    for rule in rules:
        if rule.feature in RATIOS:
            of, by = RATIOS[rule.feature]
            value = F.coalesce(F.try_divide(counts[of].cast("double"), counts[by].cast("double")), F.lit(0.0))
        else:
            value = counts[rule.feature]
        if rule.least is not None:
            passed = passed & (value >= rule.least)
        if rule.most is not None:
            passed = passed & (value <= rule.most)
    return passed


def base_failed(counts: dict[str, Column]) -> Column:
    return (counts["n_words"] < 20) | (100 * counts["n_repeat_words"] > 30 * counts["n_words"])


def quality(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """docs (text and any other columns) with a struct column `quality`: the counts, base_failed and kept.

    Null texts have no words and are not kept; an empty table stays empty; every row gets its own
    verdict, so ties and repeats don't matter. A column named `quality` that docs has is replaced.
    """
    text = F.coalesce(valid("text"), F.lit(""))
    held = docs.withColumn("quality", F.struct(text.alias("t"), words_of(text).alias("w")))
    counts = features(F.col("quality.t"), F.col("quality.w"))
    # a generated column: a filter on the verdict isn't moved below it, where it would compute the counts once for each use
    held = held.withColumn("quality", F.explode(F.array(F.struct(*(c.alias(k) for k, c in counts.items())))))
    counts = {k: F.col(f"quality.{k}") for k in counts}
    failed = base_failed(counts)
    return held.withColumn("quality", F.struct(*(c.alias(k) for k, c in counts.items()), failed.alias("base_failed"), (~failed & compile_rules(rules, counts)).alias("kept")))


def keep_good(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The rows of docs (text and any other columns) that the rules keep, with all their columns.

    A text of another type is read as a string, a null one has no words and goes; repeated rows stay or go together; an
    empty table stays empty. Other columns may hold nulls and have any names.
    """
    own = [F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("text"))
    return quality(rows, rules).where("quality.kept").select(*own)
