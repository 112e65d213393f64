"""Requests and how they are answered: filters, aggregation, order, page and projection as one logical plan, or SQL over a source."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import cached_property
from threading import Lock

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabweave import __version__
from tabweave.functions.scalars import WHOLE, dirty_cast, trimmed
from tabweave.operators.aggregate import AggregationSpec, Order, aggregated, counters, must_decline
from tabweave.operators.filters import Filter, apply_filters, column, prepared, schema_of
from tabweave.operators.order_page import ROW, page, sort_problem, top_page
from tabweave.operators.profile import Profile
from tabweave.operators.project import coerced_page, select_present
from tabweave.operators.realign import realign, summarize
from tabweave.sources.files import SOURCE_VIEW, register

CONTRACT_VERSION = 2


@dataclass(frozen=True)
class Request:
    """A query on one source. `aggregation` leaves out projection and paging; `sql` and `detail_sql` are run over the source's view."""

    filters: Sequence[Filter] = ()
    columns: Sequence[str] = ()
    aggregation: AggregationSpec | None = None
    order: Sequence[Order] = ()
    limit: int | None = None
    offset: int | None = None
    sql: str | None = None
    detail_sql: str | None = None
    expected_signature: str | None = None
    proof: SelfCheck | None = None
    ties: Sequence[str] = (ROW,)


@dataclass
class Result:
    """data is lazy; total_rows and diagnostics are counted when they are first asked for.

    diagnostics always holds signature, signature_mismatch and order_field_absent; for an aggregation its counters,
    must_decline (a source that can hold nulls has one among its groups, which another reader may call otherwise) and
    verified (the request's proof is clean, and was made for this shape and signature); for an ordered page whether a value
    of the order doesn't sort alike everywhere.
    """

    data: DataFrame
    aggregation_applied: bool = False
    signature: str | None = None
    signature_mismatch: bool = False
    order_field_absent: bool = False
    _total: Callable[[], int] = field(default=lambda: -1, repr=False)
    _counters: Callable[[], dict] = field(default=dict, repr=False)
    contract_version: int = CONTRACT_VERSION
    agent_version: str = __version__

    @cached_property
    def total_rows(self) -> int:
        return self._total()

    @cached_property
    def diagnostics(self) -> dict:
        return {"signature": self.signature, "signature_mismatch": self.signature_mismatch, "order_field_absent": self.order_field_absent} | self._counters()

    @property
    def columns(self) -> list[tuple[str, str]]:
        return self.data.dtypes


def answer(df: DataFrame, request: Request, signature: str | None = None, source: str = "") -> Result:
    """The answer to a request on a source, whose file's name is `source`. A signature other than the expected one gives no rows, and so does an order by
    a field that no row has; both are flagged."""
    if request.expected_signature is not None and request.expected_signature != signature:
        return Result(df.where(F.lit(False)), signature=signature, signature_mismatch=True)
    if request.sql or request.detail_sql:
        out = run_sql(df, request.sql or request.detail_sql)
        out = coerced_page(out) if request.detail_sql and not request.sql else out
        return Result(out, signature=signature, _total=out.count)
    if request.aggregation:
        held, keep = prepared(df, request.filters)
        out = aggregated(held.where(keep), request.aggregation)

        def told() -> dict:
            found = counters(held, keep, request.aggregation).first().asDict()
            proof = request.proof
            verified = proof is not None and proof.clean and proof.shape == shape_of(request) and proof.signature == signature
            return found | {"must_decline": must_decline(source, found["null_group_rows"]), "verified": verified}

        return Result(out, True, signature, _total=out.count, _counters=told)
    kept = apply_filters(df, request.filters)
    if not request.order:
        paged = page(kept, request.limit, request.offset, request.ties)
        return Result(select_present(paged, request.columns) if request.columns else paged, signature=signature, _total=kept.count)
    if any(o.field not in schema_of(df) for o in request.order):
        return Result(df.where(F.lit(False)), signature=signature, order_field_absent=True, _total=kept.count)
    paged = top_page(kept, request.order, request.limit, request.offset, request.ties)
    unsafe = lambda: {"unsafe_sort_value": sort_problem(kept, request.order).first().unsafe_value}
    return Result(select_present(paged, request.columns) if request.columns else paged, signature=signature, _total=kept.count, _counters=unsafe)


_VIEW = Lock()


def run_sql(df: DataFrame, sql: str, view: str = SOURCE_VIEW) -> DataFrame:
    """SQL over the source as a view. The statement is resolved before another source can take the view's name."""
    with _VIEW:
        register(df, view)
        return df.sparkSession.sql(sql)


@dataclass(frozen=True)
class SelfCheck:
    """Whether an aggregate would be the same by other rules: misplaced rows among what it reads, the same groups by plain
    casts, and cells whose leading number isn't their plain cast. It holds for requests of its shape on its source alone."""

    realignment_clean: bool
    aggregate_verified: bool
    dirty_casts: int
    realigned: int
    suspected: int
    total: int
    shape: str = ""
    signature: str | None = None

    @property
    def clean(self) -> bool:
        return self.realignment_clean and self.aggregate_verified


#: Filters whose values are alternatives, in any order.
_ANY_OF = ("equals", "notEquals", "contains", "notContains", "startsWith", "notStartsWith", "endsWith", "notEndsWith")


def shape_of(request: Request) -> str:
    """A digest of what a request asks for, whatever the order in which it says so: filters, groups, truncations and
    measures, order and limit. Requests of different measures never share one."""
    spec = request.aggregation
    parts = {
        "filters": sorted(json.dumps([f.operator, f.column, sorted(map(str, f.values)) if f.operator in _ANY_OF else list(map(str, f.values)), None if f.value_map is None else repr(f.value_map)]) for f in request.filters),
        "groups": [sorted(spec.group_by), spec.null_group] if spec else [],
        "truncations": sorted(spec.date_truncs.items()) if spec else [],
        "measures": sorted(json.dumps([a.type, a.column, a.distinct, a.alias]) for a in spec.aggregations) if spec else [],
        "order": [[o.field, o.descending] for o in (spec.order_by if spec else request.order)],
        "limit": spec.limit if spec else [request.limit, request.offset],
        "columns": list(request.columns),
        "sql": [request.sql, request.detail_sql],
    }
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()


def self_check(df: DataFrame, request: Request, profiles: Mapping[str, Profile], signature: str | None = None) -> SelfCheck:
    """Of a request with an aggregation, on a source of texts. Rows are counted as misplaced by their profiles; the driver gets counts."""
    spec = request.aggregation
    held, keep = prepared(df, request.filters)
    kept = held.where(keep)
    measured = sorted({a.column for a in spec.aggregations if a.type in ("sum", "avg", "min", "max") and a.column in df.columns})
    texts = [c for c in measured if dict(df.dtypes)[c] == "string"]
    # the same request on cells that are cast as a whole
    cast = kept.withColumns({c: F.when(trimmed(column(c)).rlike(WHOLE), trimmed(column(c)).try_cast("double")) for c in texts})
    same = agree(df.sparkSession, aggregated(kept, spec), aggregated(cast, spec))
    dirty = kept.agg(*(F.count_if(dirty_cast(column(c))).alias(c) for c in texts)).first() if texts else ()
    read = [c for c in df.columns if c in profiles]
    s = summarize(realign(df, read, profiles)).first() if read else None
    moved, suspected, total = (s.realigned, s.suspected_shift, s.total) if s else (0, 0, 0)
    return SelfCheck(moved + suspected == 0, same, sum(dirty), moved, suspected, total, shape_of(request), signature)


def fingerprint(df: DataFrame) -> tuple:
    """A digest of all rows, repeats included, whatever their order: their count, and sums and the parity of two hashes of each."""
    plain = [F.when(F.col(f"`{c}`") == 0, F.lit(0).cast(t)).otherwise(F.col(f"`{c}`")) if t in ("double", "float") else F.col(f"`{c}`") for c, t in df.dtypes]
    # what is null is told from what isn't, which a hash of values alone passes over
    held = [F.struct(x.isNull().alias("n"), x.alias("v")) for x in plain]
    one, two = F.xxhash64(*held), F.xxhash64(F.lit("other"), *held)
    return tuple(df.agg(F.count(F.lit(1)), F.sum(one.cast("decimal(20)")), F.bit_xor(one), F.sum(two.cast("decimal(20)"))).first())


def agree(spark: SparkSession, a: DataFrame, b: DataFrame) -> bool:
    """Whether two plans give the same rows, repeats included: by one aggregate over each."""
    return fingerprint(a) == fingerprint(b.select(*((column(c) if t == "void" else column(c).cast(t)).alias(c) for c, t in a.dtypes)))
