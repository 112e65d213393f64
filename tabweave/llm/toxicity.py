"""Toxicity by gradient-boosted trees over dense features of a text, with isotonic calibration.

The features: densities of a lexicon, of second-person words and of lexicon words close
to one, capitals, punctuation, digits, and words written with digits or symbols inside.
The lexicon has two halves: a short list that is always there, and words and word
beginnings learnt from the labelled sample, which carry it over to other languages. For
the calibration, lexicon and trees are both learnt without the fold that they then score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import Isotonic, Trees, fit_isotonic, fit_trees
from .shared import parts, small_batches, valid, written

#: Labelled rows that a model is fitted on at most: those whose doc_id has the smallest hashes.
SAMPLE_ROWS = 16_000
THRESHOLD = 0.3

# Insults, and words that address someone, in English, German, French and Spanish.
INSULTS = frozenset("clown crétin disgusting dumb dumm estúpido fool idiot idiota idiote imbécil jerk loser moron pathetic scum stupid stupide tonto trash trottel worthless".split())
SECOND_PERSON = frozenset("dein deine dich dir du euch eure ihr te ti toi ton tu tú usted ustedes vos vosotros votre vous you your yours yourself".split())

_WORD = re.compile(r"[^\W\d_]+")
_MASKED = re.compile(r"[0-9@$!|]?[^\W\d_]+(?:[0-9@$*!|]+[^\W\d_]+)+")
_PLAIN = str.maketrans("0134578@$!|", "oieastbasil", "*")
#: Words so far apart are close; word beginnings of these lengths are terms, and whole words of up to so many letters.
_NEAR, _STEMS, _LONGEST = 5, (6, 5, 4), 24
FEATURES = ("log_words", "lexicon_per_word", "log_lexicon", "distinct_lexicon", "weight_per_word", "largest_weight", "fixed_per_word", "near_second_person", "second_person_per_word", "capitals", "exclaims", "punctuation", "masked_per_word", "masked_lexicon", "digits")


@dataclass
class Lexicon:
    """Learnt terms (a trailing * marks a word beginning) with weight and the toxic documents behind each."""

    terms: dict[str, tuple[float, int]] = field(default_factory=dict)
    least: int = 0

    def __post_init__(self) -> None:
        self.starts = {t[:4] for t in self.terms} | {t[:4] for t in INSULTS}

    def find(self, word: str, spare: int) -> tuple[str, float] | None:
        """The term that the word falls under; terms with no more than `spare` documents don't count."""
        for term in (word, *(f"{word[:k]}*" for k in _STEMS if len(word) > k)):
            if (known := self.terms.get(term)) and known[1] > spare:
                return term, known[0]
        return (word, 3.0) if word in INSULTS else None


def features(text: str | None, *lexicons: tuple[Lexicon, bool]) -> list[list[float]]:
    """A text's features by each lexicon. With `True` beside it the text is toxic and among those the lexicon was
    learnt from, so a term needs one document more."""
    text = text or ""
    low = text.lower()
    words = _WORD.findall(low)
    n = max(1, len(words))
    addressed = [i for i, w in enumerate(words) if w in SECOND_PERSON]
    places = np.array(addressed)
    masked = [m.translate(_PLAIN) for m in _MASKED.findall(low)]
    raw = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
    letters, size = max(1, int(raw[65:91].sum() + raw[97:123].sum())), max(1, int(raw.sum()))
    shares = (
        len(addressed) / n,
        int(raw[65:91].sum()) / letters,
        int(raw[33] + raw[63]) / size,
        int(raw[33:48].sum() + raw[58:65].sum() + raw[91:97].sum() + raw[123:127].sum()) / size,
        len(masked) / n,
    )
    out = []
    for lexicon, own in lexicons:
        spare, starts, hits = lexicon.least if own else 0, lexicon.starts, []
        for i, w in enumerate(words):
            if w[:4] in starts and (hit := lexicon.find(w, spare)):
                hits.append((i, w, *hit))
        close = 0
        if hits and addressed:
            at = np.array([h[0] for h in hits])
            k = np.searchsorted(places, at)
            close = int(((np.abs(at - places[np.minimum(k, len(places) - 1)]) <= _NEAR) | (np.abs(at - places[np.maximum(k - 1, 0)]) <= _NEAR)).sum())
        out.append(
            [
                math.log1p(len(words)),
                len(hits) / n,
                math.log1p(len(hits)),
                float(len({h[2] for h in hits})),
                sum(h[3] for h in hits) / n,
                max((h[3] for h in hits), default=0.0),
                sum(h[1] in INSULTS for h in hits) / n,
                close / n,
                *shares,
                float(sum(lexicon.find(m, spare) is not None for m in masked)),
                int(raw[48:58].sum()) / size,
            ]
        )
    return out


def _terms(text: str | None) -> set[str]:
    out: set[str] = set()
    for w in set(_WORD.findall((text or "").lower())):
        if len(w) <= _LONGEST:
            out.add(w)
        out.update(f"{w[:k]}*" for k in _STEMS if len(w) > k)
    return out


def _kin(text: str | None) -> int:
    """The smallest hash of three words in a row: mostly alike for near copies, so that these count once."""
    from xxhash import xxh64_intdigest

    w = (text or "").lower().split()
    return min((xxh64_intdigest(" ".join(x)) for x in zip(w, w[1:], w[2:], strict=False)), default=xxh64_intdigest(" ".join(w))) >> 1


def _lexicon(toxic: dict[str, int], other: dict[str, int], least_log_odds: float = 2.5) -> Lexicon:
    """The terms far commoner in toxic texts, by how many of either kind hold them; "" counts the texts."""
    n_toxic, n_other = toxic.get("", 0), other.get("", 0)
    least = _least(n_toxic)
    terms: dict[str, tuple[float, int]] = {}
    commonest: Counter[str] = Counter()
    for term, k in toxic.items():
        for size in _STEMS if not term.endswith("*") else ():
            commonest[term[:size]] = max(commonest[term[:size]], k)
    for term, k in toxic.items():
        if not term or k <= least:
            continue
        odds = math.log((k + 0.5) / (n_toxic + 1)) - math.log((other.get(term, 0) + 0.5) / (n_other + 1))
        if odds >= least_log_odds and (not term.endswith("*") or k >= 1.3 * commonest.get(term[:-1], 0)):  # else one word makes up the beginning
            terms[term] = (odds, k)
    return Lexicon(terms, least + 1)


def _least(n_toxic: int) -> int:
    return max(3, math.ceil(0.004 * n_toxic))


def learn_lexicons(sample: DataFrame, folds: int = 1) -> list[Lexicon]:
    """From sample (text, toxic): the lexicon of all its texts, and for each fold that of the texts outside it.

    Toxic texts that are mostly alike count once; they share a fold. The driver holds terms of the bounded sample's
    toxic rows only, those that enough texts hold.
    """
    names = [f"n{k}" for k in range(folds)]

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(t, k) for text in b.column(0).to_pylist() for k in [_kin(text)] for t in ["", *_terms(text)]]
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in found], pa.string()), pa.array([k for _, k in found], pa.int64())], names=["term", "kin"])

    toxic = sample.where("toxic = 1").select("text").mapInArrow(seen, "term string, kin long").distinct()
    counts = written(toxic.groupBy("term").agg(F.count("*").alias("n"), *(F.count_if(F.col("kin") % folds == k).alias(n) for k, n in enumerate(names))), "toxic-terms")
    total = counts.where("term = ''").first()
    if not total:
        return [Lexicon()] * (folds + 1)
    least = min(_least(total.n - total[n]) for n in names) if folds > 1 else _least(total.n)
    with_term = {r.term: r for r in counts.where((F.col("n") > least) | (F.col("term") == "")).collect()}
    wanted = set(with_term)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[tuple[str, int]] = Counter()
        for b in batches:
            for text in b.column(0).to_pylist():
                k = _kin(text) % folds
                found.update((t, k) for t in ("", *(_terms(text) & wanted)))
        yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in found], pa.string()), pa.array([k for _, k in found], pa.int64()), pa.array(list(found.values()), pa.int64())], names=["term", "fold", "n"])

    rest = sample.where("toxic = 0").select("text").mapInArrow(counted, "term string, fold long, n long").groupBy("term", "fold").agg(F.sum("n").alias("n")).collect()
    other: list[Counter[str]] = [Counter() for _ in range(folds + 1)]
    for r in rest:
        for k in range(folds + 1):
            if k == folds or k != r.fold:
                other[k][r.term] += r.n
    made = [_lexicon({t: r.n for t, r in with_term.items()}, other[folds])]
    if folds > 1:
        made += [_lexicon({t: r.n - r[n] for t, r in with_term.items()}, other[k]) for k, n in enumerate(names)]
    return made


@dataclass
class ToxicityModel:
    lexicon: Lexicon
    trees: Trees
    calibration: Isotonic

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        raw = self.trees.raw(np.array([features(t, (self.lexicon, False))[0] for t in texts]))
        # a little of the raw score keeps the order within a pooled block
        return np.clip(0.999 * self.calibration(raw) + 0.001 / (1 + np.exp(-np.clip(raw, -40, 40))), 0, 1)


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, folds: int = 3) -> ToxicityModel:
    """From docs (doc_id, text) and labels (doc_id, toxic); a document labelled twice is toxic if one label says so.

    Rows with a null id, label or no document take no part. Without labels of both kinds the
    model has no trees, and its score is the labels' own share. At most `sample_rows` labelled
    rows are used, those of the smallest hashes of doc_id. Texts that are mostly alike share a fold.
    """
    spark = docs.sparkSession
    small_batches(spark)
    chosen = labels.select(F.col("doc_id").cast("long").alias("label_id"), F.col("toxic").cast("int").alias("toxic")).where("label_id IS NOT NULL AND toxic IN (0, 1)")
    chosen = chosen.groupBy("label_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("label_id"), "label_id").limit(sample_rows)
    text = docs.select(F.col("doc_id").cast("long").alias("label_id"), valid("text").alias("text"))
    sample = text.join(F.broadcast(chosen), "label_id").select("label_id", "text", "toxic")  # bounded by sample_rows
    sample = written(sample, "labelled-sample").repartition(parts(spark))
    lexicons = learn_lexicons(sample, folds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, own = [], []
            for t, y in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                fold = _kin(t) % folds
                rows.append(features(t, (lexicons[0], y == 1), *((x, y == 1 and k != fold) for k, x in enumerate(lexicons[1:]))))
                own.append(fold)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(pa.list_(pa.float64()))), b.column(2), pa.array(own, pa.int64())], names=["label_id", "x", "toxic", "fold"])

    found = sample.mapInArrow(run, "label_id long, x array<array<double>>, toxic int, fold long").orderBy(F.xxhash64("label_id"), "label_id", "x").limit(sample_rows).collect()
    if not found:
        return ToxicityModel(lexicons[0], Trees(-40.0, 1), Isotonic(np.zeros(1), np.zeros(1)))
    x, y, fold = np.array([r.x for r in found]), np.array([float(r.toxic) for r in found]), np.array([r.fold for r in found])
    if y.min() == y.max():
        return ToxicityModel(lexicons[0], Trees(-40.0, 1), Isotonic(np.zeros(1), y[:1]))
    held = np.zeros(len(y))
    for k in range(folds):
        own = x[:, k + 1] if folds > 1 else x[:, 0]
        held[fold == k] = fit_trees(own[fold != k], y[fold != k]).raw(own[fold == k])
    return ToxicityModel(lexicons[0], fit_trees(x[:, 0], y), fit_isotonic(held, y))


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """docs (doc_id, text) to (doc_id, score: 0 to 1), one row for each row.

    Null texts are empty, null ids stay null, whole texts are read however long; repeated rows give repeated rows, an empty
    table gives none; other columns are not read.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.scores(b.column(1).to_pylist()), pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), valid("text").alias("text")).mapInArrow(run, "doc_id long, score double")


def drop_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs (text and any other columns) that score below the threshold, with all their columns.

    A text of another type is read as a string, a null one as empty, one that isn't UTF-8 as shared.valid reads it; each row is judged on its own, so repeated rows
    stay or go together; an empty table stays empty. Other columns may hold nulls and have any names.
    """
    small_batches(docs.sparkSession)
    at = len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(model.scores(b.column(at).to_pylist()) < threshold)).select(list(range(at)))

    numbered = docs.toDF(*(f"c{i}" for i in range(at)))  # a name may hold a dot
    own = numbered.withColumn("read", valid(f"c{docs.columns.index('text')}"))
    return own.mapInArrow(run, numbered.schema).toDF(*docs.columns)
