"""Rows whose values stand in the wrong columns: found by their profiles, put right or set aside.

Every row is scored by expressions of literals, in the JVM. Rows that aren't aligned are tried in shifted and swapped
arrangements, many rows at a time: each distinct value of a batch is classified once and scored against all profiles, so the
scores of all cells in all columns are one array, and an arrangement's score is a sum of its entries. `check_row` says the
same of a single row.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabweave.functions.classify import PATTERNS, TYPES, classify_value, strip
from tabweave.functions.scalars import trimmed
from tabweave.operators.filters import column
from tabweave.operators.profile import Profile, score_trimmed

ALIGNED, IMPROVEMENT, APPLY, SOFT_IMPROVEMENT = 0.65, 0.20, 0.70, 0.05
PROBLEM, CRITICAL = 0.3, 0.2


@dataclass(frozen=True)
class RealignOptions:
    aligned: float = ALIGNED
    improvement: float = IMPROVEMENT
    apply: float = APPLY
    max_shift: int = 3
    swaps: bool = True
    swap_candidates: int = 6
    swap_rounds: int = 3


def score_text(value: str | None, p: Profile) -> float:
    """The score of one cell, as profile.score has it."""
    text = strip(value or "")
    if not text:
        return 0.7 if p.null_rate >= 0.05 else 0.3
    kind, found = classify_value(text)
    pair = {kind, p.primary_type}
    fits = kind == p.primary_type or p.primary_type == "mixed" or pair in ({"integer", "number"}, {"date", "datetime"})
    out = 0.7 if fits else 0.5 if p.primary_type == "string" else 0.1
    if p.enum_values:
        out = max(out, 0.95) if text in p.enum_values else min(out, 0.1 if len(p.enum_values) <= 10 else 0.3)
    if p.patterns:
        share = sum(x in found for x in p.patterns) / len(p.patterns)
        out = max(out, 0.9) if share >= 0.8 else min(out, 0.2) if share == 0 else out
    if p.numeric_range and kind in ("integer", "number"):
        low, high = p.numeric_range
        span = (high - low) or abs(high) or 1.0
        if not low - span * 100 <= float(text) <= high + span * 100:
            out = min(out, 0.4)
    return out


def mismatch(value: str | None, p: Profile) -> str:
    """Why a cell doesn't fit."""
    if value is None or value == "":
        return f"empty, though {p.null_rate:.2f} of the column is"
    reasons = []
    if p.enum_values and strip(value) not in p.enum_values:
        more = ", ..." if len(p.enum_values) > 5 else ""
        reasons.append(f'"{value[:60]}" is none of {", ".join(p.enum_values[:5])}{more}')
    if p.patterns:
        reasons.append(f"expected {' or '.join(p.patterns)}")
    return "; ".join(reasons) or f"not of type {p.primary_type}"


class _Search:
    """Arrangements of one row: for each column the place its value comes from (-1: none)."""

    def __init__(self, values: Sequence[str | None], profiles: Sequence[Profile | None], score_of) -> None:
        self.values, self.profiles, self.score_of = values, profiles, score_of
        self.scored = [i for i, p in enumerate(profiles) if p is not None]

    def cell(self, at: int, source: int) -> float:
        return self.score_of(at, self.values[source] if 0 <= source < len(self.values) else None)

    def total(self, places: Sequence[int]) -> float:
        if not self.scored:
            return 0.5 if self.values else 1.0
        out = 0.0
        for i in self.scored:  # from left to right, as the expression adds
            out += self.cell(i, places[i])
        return out / len(self.scored)

    def problems(self, places: Sequence[int]) -> list[tuple[int, float]]:
        found = [(i, self.cell(i, places[i])) for i in self.scored]
        return [(i, s) for i, s in found if s < PROBLEM]


def check_row(values: Sequence[str | None], columns: Sequence[str], profiles: Sequence[Profile | None], options: RealignOptions, score_of=None) -> dict:
    """The verdict on a row: kind (aligned, realigned or quarantine), scores, shift, pivot, swaps, the places values come from, and the worst reasons."""
    n = len(values)
    search = _Search(values, profiles, score_of or (lambda i, v: score_text(v, profiles[i])))
    start = list(range(n))
    original, problems = search.total(start), search.problems(start)
    critical = any(s < CRITICAL for _, s in problems)
    verdict = {"kind": "aligned", "original_score": original, "new_score": original, "shift": 0, "pivot": 0, "swaps": [], "places": start, "suspected": False, "reason": None}
    if original >= options.aligned and not critical:
        return verdict
    pivots = [0]
    if problems:
        first = problems[0][0]
        pivots += [p for p in range(max(0, first - 2), min(n - 1, first + 1) + 1) if p]
    best, shift, pivot, places, swaps = original, 0, 0, start, []
    for p in pivots:
        for s in (x for k in range(1, options.max_shift + 1) for x in (-k, k)):
            moved = start[:p] + [i + s if 0 <= i + s < n else -1 for i in range(p, n)]
            if (value := search.total(moved)) > best:
                best, shift, pivot, places = value, s, p, moved
    if options.swaps:
        current, value = list(places), best
        for _ in range(options.swap_rounds):
            worst = [i for i, _ in sorted(search.problems(current), key=lambda x: x[1])[: options.swap_candidates]]
            found, pair = value, None
            for x in range(len(worst)):
                for y in range(x + 1, len(worst)):
                    tried = list(current)
                    tried[worst[x]], tried[worst[y]] = tried[worst[y]], tried[worst[x]]
                    if (v := search.total(tried)) > found:
                        found, pair = v, (worst[x], worst[y])
            if pair is None or found - value < options.improvement / 4:
                break
            a, b = pair
            current[a], current[b] = current[b], current[a]
            swaps.append((columns[a], columns[b]))
            value = found
        if swaps and value > best:
            best, places = value, current
        else:
            swaps = []
    changed = shift != 0 or bool(swaps)
    gain = best - original
    fixed = changed and critical and not any(s < CRITICAL for _, s in search.problems(places))
    verdict |= {"new_score": best, "shift": shift, "pivot": pivot, "swaps": swaps}
    verdict["reason"] = " | ".join(f"{columns[i]}: {mismatch(values[i], profiles[i])}" for i, _ in problems[:3])
    if changed and best >= options.apply and (gain >= options.improvement or (fixed and gain >= SOFT_IMPROVEMENT)):
        return verdict | {"kind": "realigned", "places": places}
    return verdict | {"kind": "quarantine", "suspected": changed and gain >= options.improvement}


#: Entries of an array of scores that are held at a time.
_ENTRIES = 1 << 22


@lru_cache(maxsize=200_000)
def _classified(text: str) -> tuple[str, frozenset[str], float]:
    kind, found = classify_value(text)
    return kind, found, float(text) if kind in ("integer", "number") else 0.0


def score_values(values: Sequence[str | None], profiles: Sequence[Profile | None]) -> np.ndarray:
    """score_text of each value (rows) against each profile (columns; 0 without one)."""
    texts = [strip(v or "") for v in values]
    known = [_classified(t) for t in texts]
    blank = np.array([not t for t in texts], bool)
    kinds = np.array([TYPES.index(k) for k, _, _ in known], int)
    bits = np.array([[p in found for p in PATTERNS] for _, found, _ in known], bool).reshape(len(texts), len(PATTERNS))
    numbers = np.array([x for _, _, x in known], float)
    numeric = np.isin(kinds, [TYPES.index("integer"), TYPES.index("number")])
    related = {"integer": ("number",), "number": ("integer",), "date": ("datetime",), "datetime": ("date",)}
    scores = np.zeros((len(texts), len(profiles)))
    for i, p in enumerate(profiles):
        if p is None:
            continue
        fits = np.ones(len(texts), bool) if p.primary_type == "mixed" else np.isin(kinds, [TYPES.index(k) for k in (p.primary_type, *related.get(p.primary_type, ()))])
        out = np.where(fits, 0.7, 0.5 if p.primary_type == "string" else 0.1)
        if p.enum_values:
            members = frozenset(p.enum_values)
            inside = np.array([t in members for t in texts], bool)
            out = np.where(inside, np.maximum(out, 0.95), np.minimum(out, 0.1 if len(p.enum_values) <= 10 else 0.3))
        if p.patterns:
            held = bits[:, [PATTERNS.index(x) for x in p.patterns]].sum(1)
            out = np.where(held / len(p.patterns) >= 0.8, np.maximum(out, 0.9), np.where(held == 0, np.minimum(out, 0.2), out))
        if p.numeric_range:
            low, high = p.numeric_range
            span = (high - low) or abs(high) or 1.0
            out = np.where(numeric & ~((low - span * 100 <= numbers) & (numbers <= high + span * 100)), np.minimum(out, 0.4), out)
        scores[:, i] = np.where(blank, 0.7 if p.null_rate >= 0.05 else 0.3, out)
    return scores


class _Rows:
    """Arrangements of many rows; scores[row, column, place] is that of the value at a place in a column, the last place being none."""

    def __init__(self, scores: np.ndarray, scored: Sequence[int]) -> None:
        self.scores, self.scored = scores, list(scored)

    def cells(self, rows: np.ndarray, places: np.ndarray) -> np.ndarray:
        return self.scores[rows[:, None], np.arange(places.shape[1])[None, :], places]

    def total(self, cells: np.ndarray) -> np.ndarray:
        """From left to right, as the expression adds."""
        out = np.zeros(len(cells))
        for i in self.scored:
            out += cells[:, i]
        return out / len(self.scored)


def check_rows(cells: Sequence[Sequence[str | None]], columns: Sequence[str], profiles: Sequence[Profile | None], options: RealignOptions) -> dict[str, np.ndarray | list]:
    """check_row for many rows, whose cells come column by column: the verdict's fields as arrays, and for each row the places its values come from (-1: none)."""
    n, rows = len(columns), len(cells[0]) if cells else 0
    flat = pa.chunked_array([pa.array(c, pa.string()) for c in cells]).combine_chunks().dictionary_encode()
    distinct = score_values([*flat.dictionary.to_pylist(), None], profiles)  # the last stands for null
    codes = np.asarray(flat.indices.fill_null(len(flat.dictionary))).reshape(n, rows).T
    parts = []
    step = max(64, _ENTRIES // (n * (n + 1)))
    for at in range(0, rows, step):
        own = codes[at : at + step]
        scores = np.empty((len(own), n, n + 1))
        for i in range(n):
            scores[:, i, :n] = distinct[own, i]
            scores[:, i, n] = distinct[-1, i]
        parts.append(_verdicts(scores, [i for i, p in enumerate(profiles) if p is not None], n, options))
    found = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]} if parts else _verdicts(np.empty((0, n, n + 1)), [0], n, options)
    reason_of = lru_cache(maxsize=100_000)(lambda i, v: f"{columns[i]}: {mismatch(v, profiles[i])}")
    problems = found.pop("problems")
    worst = {int(r): [] for r in np.flatnonzero(found["kind"] != 0)}
    for r, i in zip(*(x.tolist() for x in np.nonzero(problems)), strict=True):
        if r in worst and len(worst[r]) < 3:
            worst[r].append(reason_of(i, cells[i][r]))
    swaps = [[[columns[a], columns[b]] for a, b in pairs if a >= 0] for pairs in found.pop("swaps").tolist()]
    kinds = np.array(["aligned", "realigned", "quarantine"])[found.pop("kind")]
    return found | {"kind": kinds, "swaps": swaps, "reason": [" | ".join(worst[r]) if r in worst else None for r in range(rows)]}


def _verdicts(scores: np.ndarray, scored: Sequence[int], n: int, options: RealignOptions) -> dict[str, np.ndarray]:
    count = len(scores)
    search, everything = _Rows(scores, scored), np.arange(count)
    profiled = np.zeros(n, bool)
    profiled[list(scored)] = True
    start = np.tile(np.arange(n), (count, 1))
    held = search.cells(everything, start)
    original = search.total(held)
    problems = (held < PROBLEM) & profiled
    critical = ((held < CRITICAL) & profiled).any(1)
    open_ = ~((original >= options.aligned) & ~critical)
    first = np.where(problems.any(1), problems.argmax(1), n + 10)
    best, shift, pivot, places = original.copy(), np.zeros(count, int), np.zeros(count, int), start.copy()
    # pivots come in ascending order, 0 among them, so the first best one is kept
    for p in range(n):
        near = open_ if p == 0 else open_ & (first - 2 <= p) & (p <= first + 1)
        rows = np.flatnonzero(near)
        if not len(rows):
            continue
        for s in (x for k in range(1, options.max_shift + 1) for x in (-k, k)):
            moved = np.array([*range(p), *(i + s if 0 <= i + s < n else n for i in range(p, n))])
            value = search.total(scores[rows[:, None], np.arange(n)[None, :], moved[None, :]])
            better = value > best[rows]
            at = rows[better]
            best[at], shift[at], pivot[at], places[at] = value[better], s, p, moved
    swaps = np.full((count, max(1, options.swap_rounds), 2), -1)
    if options.swaps:
        current, value, live = places.copy(), best.copy(), np.flatnonzero(open_)
        for k in range(options.swap_rounds):
            if not len(live):
                break
            now = search.cells(live, current[live])
            bad = (now < PROBLEM) & profiled
            order = np.argsort(np.where(bad, now, np.inf), axis=1, kind="stable")[:, : options.swap_candidates]
            there = np.take_along_axis(bad, order, 1)
            found, pair = value[live].copy(), np.full((len(live), 2), -1)
            for x in range(order.shape[1]):
                for y in range(x + 1, order.shape[1]):
                    rows = np.flatnonzero(there[:, x] & there[:, y])
                    if not len(rows):
                        continue
                    a, b, at = order[rows, x], order[rows, y], live[rows]
                    tried = now[rows].copy()
                    tried[np.arange(len(rows)), a] = scores[at, a, current[at, b]]
                    tried[np.arange(len(rows)), b] = scores[at, b, current[at, a]]
                    total = search.total(tried)
                    better = total > found[rows]
                    found[rows[better]] = total[better]
                    pair[rows[better]] = np.stack([a[better], b[better]], 1)
            goes_on = (pair[:, 0] >= 0) & ~(found - value[live] < options.improvement / 4)
            live, pair, found = live[goes_on], pair[goes_on], found[goes_on]
            a, b = pair[:, 0], pair[:, 1]
            current[live, a], current[live, b] = current[live, b], current[live, a]
            swaps[live, k] = pair
            value[live] = found
        better = (swaps[:, 0, 0] >= 0) & (value > best)
        best[better], places[better] = value[better], current[better]
        swaps[~better] = -1
    swapped = swaps[:, 0, 0] >= 0
    changed = (shift != 0) | swapped
    gain = best - original
    fixed = changed & critical & ~((search.cells(everything, places) < CRITICAL) & profiled).any(1)
    right = changed & (best >= options.apply) & ((gain >= options.improvement) | (fixed & (gain >= SOFT_IMPROVEMENT)))
    kind = np.where(~open_, 0, np.where(right, 1, 2))
    places = np.where((kind == 1)[:, None], places, start)
    return {"kind": kind, "original_score": original, "new_score": best, "shift": shift, "pivot": pivot, "swaps": swaps, "suspected": (kind == 2) & changed & (gain >= options.improvement), "places": np.where(places == n, -1, places), "problems": problems}


VERDICT = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("original_score", T.DoubleType()),
        T.StructField("new_score", T.DoubleType()),
        T.StructField("shift", T.IntegerType()),
        T.StructField("pivot", T.IntegerType()),
        T.StructField("swaps", T.ArrayType(T.ArrayType(T.StringType()))),
        T.StructField("suspected", T.BooleanType()),
        T.StructField("reason", T.StringType()),
    ]
)


def _with_trimmed(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """df with an array __cells of the columns' texts without outer blanks: generated, so that it is computed once."""
    return df.withColumn("__cells", F.explode(F.array(F.array(*(trimmed(column(c)) for c in columns)))))


def row_score(columns: Sequence[str], profiles: Mapping[str, Profile], shift: int = 0) -> Column:
    """The scores, over __cells, of columns with a profile, each for the cell `shift` places on."""
    none = F.lit(None).cast("string")
    cell = lambda i: F.get("__cells", F.lit(i)) if 0 <= i < len(columns) else none
    return F.array(*(score_trimmed(cell(i + shift), profiles[c]) for i, c in enumerate(columns) if c in profiles))


def _mean(scores: Column, n: int) -> Column:
    """From left to right, as _Search adds."""
    total = F.lit(0.0)
    for i in range(n):
        total = total + F.get(scores, F.lit(i))
    return total / n


def _telling(profiles: Mapping[str, Profile], columns: Sequence[str]) -> dict[str, Profile]:
    """Profiles of these columns without what says nothing about a place: a number of seven digits or more reads as a phone's,
    and in a column of numbers of which most are so long a shorter one stands where it belongs, too."""
    kept = {c: p for c, p in profiles.items() if c in columns}
    return {c: replace(p, patterns=tuple(x for x in p.patterns if x != "isPhone")) if p.primary_type in ("integer", "number") else p for c, p in kept.items()}


def realign(df: DataFrame, columns: Sequence[str], profiles: Mapping[str, Profile], options: RealignOptions = RealignOptions(), quarantine: str = "keep") -> DataFrame:  # noqa: B008
    """df, whose `columns` are texts, with those columns put right and a struct column __verdict.

    quarantine: `keep` leaves rows that can't be put right as they are, `drop` leaves them out, `mark` adds
    __quarantine_reason. Without profiles every row is aligned. Other columns stay.
    """
    if quarantine not in ("keep", "drop", "mark"):
        raise ValueError(f"unknown quarantine mode: {quarantine}")
    profiles = _telling(profiles, columns)
    if profiles:
        # generated too, so that the filters below use the scores instead of computing them again
        held = _with_trimmed(df, columns).withColumn("__scores", F.explode(F.array(row_score(columns, profiles)))).drop("__cells")
        score = F.struct(_mean(F.col("__scores"), len(profiles)).alias("mean"), F.array_min("__scores").alias("least"))
        marked = held.withColumn("__score", score).drop("__scores")
    else:
        marked = df.withColumn("__score", F.struct(F.lit(0.5).alias("mean"), F.lit(1.0).alias("least")))
    kinds = {f.name: f.dataType for f in VERDICT.fields}
    s = F.col("__score.mean")
    whole = {"kind": F.lit("aligned"), "original_score": s, "new_score": s, "shift": F.lit(0), "pivot": F.lit(0), "swaps": F.array(), "suspected": F.lit(False), "reason": F.lit(None)}
    verdict = F.struct(*(c.cast(kinds[k]).alias(k) for k, c in whole.items()))
    if not profiles:
        out = marked.withColumn("__verdict", verdict).drop("__score")
    else:
        # all rows pass by in one go, so that they are read and scored once; those that fit stay as they are
        fine = (s >= options.aligned) & (F.col("__score.least") >= CRITICAL)
        ready = marked.select(*(column(c) for c in df.columns), verdict.alias("__verdict"), fine.alias("__fine"))
        schema = T.StructType(ready.schema.fields[:-1])
        places, own, names = [df.columns.index(c) for c in columns], [profiles.get(c) for c in columns], list(columns)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                odd = pc.invert(b.column(b.num_columns - 1))
                b = b.select(list(range(b.num_columns - 1)))
                rest = b.filter(odd)
                if rest.num_rows < b.num_rows:
                    yield b.filter(pc.invert(odd))
                if not rest.num_rows:
                    continue
                cells = [rest.column(i).to_pylist() for i in places]
                found = check_rows(cells, names, own, options)
                arrays, at = list(rest.columns), found.pop("places")
                for k, i in enumerate(places):
                    if (at[:, k] != k).any():
                        arrays[i] = pa.array([cells[x][r] if x >= 0 else None for r, x in enumerate(at[:, k].tolist())], pa.string())
                rows = [found[f.name] if isinstance(found[f.name], list) else found[f.name].tolist() for f in VERDICT.fields]
                arrays[-1] = pa.StructArray.from_arrays([pa.array(x, _arrow(f.dataType)) for x, f in zip(rows, VERDICT.fields, strict=True)], fields=list(b.schema.field(b.num_columns - 1).type))
                yield pa.RecordBatch.from_arrays(arrays, schema=b.schema)

        out = ready.mapInArrow(run, schema)
    if quarantine == "drop":
        out = out.where("__verdict.kind <> 'quarantine'")
    if quarantine == "mark":
        out = out.withColumn("__quarantine_reason", F.when(F.col("__verdict.kind") == "quarantine", F.col("__verdict.reason")))
    return out


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def summarize(realigned: DataFrame) -> DataFrame:
    """One row of counts: total, aligned, realigned (by shift, by swap, by both), quarantined, suspected_shift. `examples` gives rows of a kind."""
    v = F.col("__verdict")
    moved, shifted, swapped = v["kind"] == "realigned", v["shift"] != 0, F.size(v["swaps"]) > 0
    count = lambda c, n: F.count_if(c).alias(n)
    return realigned.agg(
        F.count(F.lit(1)).alias("total"),
        count(v["kind"] == "aligned", "aligned"),
        count(moved, "realigned"),
        count(moved & shifted & ~swapped, "shift_only"),
        count(moved & ~shifted & swapped, "swap_only"),
        count(moved & shifted & swapped, "shift_plus_swap"),
        count(v["kind"] == "quarantine", "quarantined"),
        count(v["suspected"], "suspected_shift"),
    )


def examples(realigned: DataFrame, key: str, kind: str = "realigned", most: int = 5) -> DataFrame:
    """The first few rows of a kind, by key, with their verdicts."""
    return realigned.where(F.col("__verdict.kind") == kind).orderBy(column(key)).limit(most).select(column(key), "__verdict.*")


def fit_shares(df: DataFrame, columns: Sequence[str], profiles: Mapping[str, Profile], threshold: float = 0.65) -> DataFrame:
    """One row: the share of rows whose cells fit their own profiles, and for each shift by one the share that fits better so."""
    profiles = _telling(profiles, columns)
    if not profiles:
        return df.agg(F.lit(1.0).alias("own_fit"), F.lit(0.0).alias("shift_left"), F.lit(0.0).alias("shift_right"))
    scores = F.struct(*(row_score(columns, profiles, s).alias(n) for n, s in (("own", 0), ("left", -1), ("right", 1))))
    held = _with_trimmed(df, columns).select(F.explode(F.array(scores)).alias("s"))
    own, left, right = (_mean(F.col(f"s.{n}"), len(profiles)) for n in ("own", "left", "right"))
    return held.agg(F.avg((own >= threshold).cast("double")).alias("own_fit"), F.avg((left > own).cast("double")).alias("shift_left"), F.avg((right > own).cast("double")).alias("shift_right"))
