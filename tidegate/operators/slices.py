"""Order-dependent computations per key that never put a whole key into one task.

A plain ``Window.partitionBy(key)`` sends every row of a key to one task, so one hot
key (a third of all rows, say) would hold up the job.  Here rows are grouped by
(key, time slice); what a slice needs to know about the earlier slices of its key is
computed from one pre-aggregated row per (key, slice), whose number per key is bounded
by the time span divided by the slice width.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegate.functions import moments
from tidegate.functions.scalars import DAY, HOUR, MICROS, micros, slice_id

# slice widths in seconds; each divides the ones before it
LADDER = [DAY, 6 * HOUR, HOUR, 600, 60, 10, 1]
# rows of one (key, slice) that one task sorts with ease
TARGET_ROWS = 4_000_000
# rows around an event, on average, up to which a frame is added up row by row
FRAME_ROWS = 64
# sums that are subtracted from each other; exact for amounts below 1e29
EXACT = "decimal(38,9)"


@dataclass(frozen=True)
class Running:
    """A running aggregate: ``sum`` or ``max`` of ``value`` over the rows so far."""

    value: Column
    how: str = "sum"
    exclusive: bool = False


def _aggregate(how: str, value: Column) -> Column:
    return {"sum": F.sum, "max": F.max}[how](value)


def _merge(how: str, left: Column, right: Column) -> Column:
    if how == "sum":
        return F.when(left.isNull(), right).when(right.isNull(), left).otherwise(left + right)
    return F.when(left.isNull(), right).when(right.isNull(), left).otherwise(
        F.when(left >= right, left).otherwise(right)
    )


def add_slice(df: DataFrame, ts: str, seconds: int, name: str = "_slice") -> DataFrame:
    return df.withColumn(name, slice_id(micros(ts), seconds))


def fit_slice(
    df: DataFrame, key: Sequence[str], ts: str, widest: int = DAY, target_rows: int = TARGET_ROWS,
) -> int:
    """The widest slice, at most ``widest`` seconds, that holds at most ``target_rows`` of a key.

    Only the layout of the work depends on it, never a result.  A try is one grouped count with
    map-side combine over two columns; data without hot keys needs one.  Where even a second of
    a key holds more, no slice is small enough and the caller's tasks spill.
    """
    widths = [w for w in LADDER if w <= widest]
    times = df.select(*key, ts).filter(F.col(ts).isNotNull())
    for width in widths:
        largest = (
            add_slice(times, ts, width).groupBy(*key, "_slice").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
        )
        if largest is None or largest <= target_rows:
            return width
    return widths[-1]


def running(
    df: DataFrame,
    key: Sequence[str],
    ts: str,
    row_id: str,
    aggregates: Mapping[str, Running],
    slice_seconds: int | None = None,
    descending: bool = False,
) -> DataFrame:
    """Running aggregates per key in (ts, row_id) order, skew-safe.

    Equal to a window ``partitionBy(key).orderBy(ts, row_id)`` from the first row to the
    current one (or the one before, if exclusive).  ``max`` of a struct that starts with
    (ts, row_id) and is exclusive gives the previous row.
    """
    key = list(key)
    sliced = add_slice(df, ts, slice_seconds or fit_slice(df, key, ts))
    order = [F.desc(ts), F.desc(row_id)] if descending else [F.asc(ts), F.asc(row_id)]
    before = Window.partitionBy(*key).orderBy(F.desc("_slice") if descending else F.asc("_slice"))
    before = before.rowsBetween(Window.unboundedPreceding, -1)

    per_slice = sliced.groupBy(*key, "_slice").agg(
        *[_aggregate(a.how, a.value).alias(f"_part_{n}") for n, a in aggregates.items()]
    )
    prior = per_slice.select(
        *key,
        "_slice",
        *[_aggregate(a.how, F.col(f"_part_{n}")).over(before).alias(f"_prior_{n}")
          for n, a in aggregates.items()],
    )
    within = Window.partitionBy(*key, "_slice").orderBy(*order)
    # rows without a time or key are kept; they meet their own group only
    on = " AND ".join(f"s.{c} <=> p.{c}" for c in [*key, "_slice"])
    joined = sliced.alias("s").join(prior.alias("p"), F.expr(on), "inner").select(
        "s.*", *[f"p._prior_{n}" for n in aggregates])
    out = {}
    for name, a in aggregates.items():
        frame = within.rowsBetween(Window.unboundedPreceding, -1 if a.exclusive else 0)
        out[name] = _merge(a.how, _aggregate(a.how, a.value).over(frame), F.col(f"_prior_{name}"))
    return joined.withColumns(out).drop("_slice", *[f"_prior_{n}" for n in aggregates])


def with_previous(
    df: DataFrame,
    key: Sequence[str],
    ts: str,
    row_id: str,
    columns: Sequence[str] = (),
    name: str = "_prev",
    slice_seconds: int | None = None,
) -> DataFrame:
    """Attach the previous row of the key as a struct (ts, row_id, columns...)."""
    value = F.struct(F.col(ts), F.col(row_id), *[F.col(c) for c in columns])
    return running(
        df, key, ts, row_id, {name: Running(value, "max", exclusive=True)}, slice_seconds
    )


def sparse(df: DataFrame, key: Sequence[str], ts: str, widest: int, frame_rows: int = FRAME_ROWS, target_rows: int = TARGET_ROWS) -> bool:
    """Whether frames of ``widest`` seconds hold few rows, and no key more than a task sorts with ease.

    Rows are counted per (key, cell of that width), with map-side combine; the sum of squares over the
    number of rows is what a row finds in its own cell on average, and a frame meets two cells.
    """
    cells = add_slice(df.select(*key, ts), ts, widest).groupBy(*key, "_slice").agg(F.count(F.lit(1)).alias("n"))
    per_key = cells.groupBy(*key).agg(F.sum("n").alias("n"), F.sum(F.col("n").cast("double") * F.col("n")).alias("met"))
    row = per_key.agg(F.max("n").alias("most"), F.sum("n").alias("n"), F.sum("met").alias("met")).first()
    return row["n"] is None or (row["most"] <= target_rows and row["met"] <= frame_rows * row["n"])


def by_frames(
    events: DataFrame, keys: list[str], ts: str, measures: Mapping[str, str], windows: Mapping[str, int],
    pairs: Sequence[tuple[str, str]], spread: Mapping[str, tuple[str, Sequence[str]]],
) -> DataFrame:
    """``trailing`` for sparse keys: one shuffle and one sort, each frame added up row by row from its own rows."""
    rows = events.selectExpr(
        "*", *[f"cast({v} AS double) AS _m_{m}" for m, v in measures.items()],
        *[f"cast({v} AS double) AS _v_{x}" for x, (v, _) in spread.items()], f"unix_micros({ts}) AS _us")
    frame = {w: f"(PARTITION BY {', '.join(keys)} ORDER BY _us RANGE BETWEEN {s * MICROS}L PRECEDING AND CURRENT ROW)" for w, s in windows.items()}
    return rows.selectExpr(
        *keys, *[c for c in events.columns if c not in keys],
        *[f"coalesce(stddev_samp(_v_{x}) OVER {frame[w]}, 0D) AS {x}_std_{w}" for x, (_, ws) in spread.items() for w in ws],
        *[f"coalesce(sum(_m_{m}) OVER {frame[w]}, 0D) AS {m}_{w}" for m, w in pairs],
    )


def slice_sql(micros_sql: str, seconds: int) -> str:
    """SQL twin of ``slice_id``."""
    return f"(({micros_sql}) - pmod({micros_sql}, {seconds * MICROS}L)) DIV {seconds * MICROS}L"


def trailing(
    events: DataFrame,
    key: Sequence[str],
    ts: str,
    measures: Mapping[str, str],
    windows: Mapping[str, int],
    slice_seconds: int | None = None,
    wanted: Mapping[str, Sequence[str]] | None = None,
    row_id: str | None = None,
    marks: Mapping[str, str] | None = None,
    steps: Sequence[Sequence[str]] = (),
    carried: Mapping[str, str] | None = None,
    after: Sequence[str] = (),
    spread: Mapping[str, tuple[str, Sequence[str]]] | None = None,
) -> DataFrame:
    """Sums over ``[ts - w, ts]`` at each event, for several windows in one shuffle and one sort.

    ``measures`` are SQL texts; adds ``{measure}_{window}`` (for the windows in ``wanted``,
    else for all).  Both bounds are inclusive and rows with equal time count each other, as in
    ``RANGE BETWEEN w PRECEDING AND CURRENT ROW``.  Each window must be a multiple of the
    slice.  The sum is made of three parts: the event's own slice up to the event, the whole
    slices in between (one pre-aggregated row each), and the end of the slice in which the
    window starts.  For the last part every event also enters the slice ``w`` later as a
    narrow "expiring" row, where it still counts for events that come no later than its own
    time plus ``w``.  Own slice and expiring rows are only ever added up; the slices in
    between are differences of exact decimal sums, so a large amount leaves no trace in the
    windows after it.

    More can be computed while the rows of a (key, slice) are together.  ``steps`` are SQL
    columns, evaluated step by step in a window text ``{rows}`` that is ordered by time and
    ``row_id``: ``_role`` is -1 on events and the index of the window on expiring rows,
    ``_row`` holds the event's columns, ``marks`` are SQL columns that expiring rows have too
    (steps meet expiring rows only where there are marks).
    ``carried`` names aggregates of which each slice gets the maximum over earlier slices.
    ``after`` are SQL columns over all of these and the sums' parts.

    ``spread`` maps a name to (SQL text, windows) and adds ``{name}_std_{window}``, the sample
    standard deviation.  Its parts are states (number, mean, squared deviations), which are
    merged and never subtracted; see ``whole_slices`` for the slices in between.

    Where keys are sparse (``sparse``: few rows in a frame, no key too large for a task) slices would
    hold a row or less and only multiply the rows: frames are then added up directly (``by_frames``).
    """
    keys, carried, marks = list(key), dict(carried or {}), dict(marks or {})
    spread = {x: (v, list(ws)) for x, (v, ws) in (spread or {}).items()}
    use = {m: list((wanted or {}).get(m, windows)) for m in measures}
    pairs = [(m, w) for m in measures for w in use[m]]
    if not (slice_seconds or steps or carried or after or marks) and sparse(events, keys, ts, max(windows.values())):
        return by_frames(events, keys, ts, measures, windows, pairs, spread)
    width = slice_seconds or fit_slice(events, keys, ts, min(windows.values()))
    for name, seconds in windows.items():
        if seconds % width:
            raise ValueError(f"window {name} is no multiple of the {width} s slice")
    role = {w: i for i, w in enumerate(windows)}
    base = events.selectExpr(
        "*", *[f"cast({v} AS double) AS _m_{m}" for m, v in measures.items()],
        *[f"cast({v} AS double) AS _v_{x}" for x, (v, _) in spread.items()],
        *[f"{v} AS {n}" for n, v in marks.items()], f"{row_id or 'NULL'} AS _id", f"unix_micros({ts}) AS _us",
    ).selectExpr("*", f"{slice_sql('_us', width)} AS _slice")

    # one row per event and one per window it expires from
    shifts = ", ".join(f"named_struct('role', {i}, 'by', {windows[w]}L)" for w, i in role.items())
    payload = [c for c in events.columns if c not in keys]
    rows = base.selectExpr(
        "*", f"explode(array(named_struct('role', -1, 'by', 0L), {shifts})) AS _step"
    ).selectExpr(
        *keys, "_step.role AS _role", f"_us + _step.by * {MICROS}L AS _us", f"_slice + _step.by DIV {width}L AS _slice", "_id",
        *[f"_m_{m}" for m in measures], *[f"_v_{x}" for x in spread], *marks, f"CASE WHEN _step.role = -1 THEN struct({', '.join(payload)}) END AS _row",
    )
    part = f"PARTITION BY {', '.join(keys)}, _slice"
    by_time = f"{part} ORDER BY _us RANGE BETWEEN UNBOUNDED PRECEDING AND"
    # rows that have not expired are those at or after the event, added up from the end of the slice
    late = f"{part} ORDER BY _us DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    spreads = [(x, w) for x, (_, ws) in spread.items() for w in ws]

    def states(x: str, r: int, window: str, name: str) -> list[str]:
        value = f"CASE WHEN _role = {r} THEN _v_{x} END"
        return [f"count({value}) OVER ({window}) AS {name}_n", f"avg({value}) OVER ({window}) AS {name}_mean",
                f"var_pop({value}) OVER ({window}) * count({value}) OVER ({window}) AS {name}_m2"]

    local = rows.selectExpr(
        "*",
        *[f"coalesce(sum(CASE WHEN _role = {role[w]} THEN _m_{m} END) OVER ({late}), 0D) AS _head_{m}_{w}" for m, w in pairs],
        *[e for x, w in spreads for e in states(x, role[w], late, f"_at_head_{x}_{w}")],
    )
    # expiring rows go before the rows grow wide and are sorted again, unless steps read them through their marks
    local = local if marks else local.filter("_role = -1")
    # windows by (time, id) come before those by time, which their sort also serves
    for step in steps:
        local = local.selectExpr("*", *[e.replace("{rows}", f"{part} ORDER BY _us, _id") for e in step])
    local = local.selectExpr(
        "*",
        *[f"coalesce(sum(CASE WHEN _role = -1 THEN _m_{m} END) OVER ({by_time} CURRENT ROW), 0D) AS _own_{m}" for m in measures],
        *[e for x in spread for e in states(x, -1, f"{by_time} CURRENT ROW", f"_at_own_{x}")],
    ).filter("_role = -1")

    # slices wholly inside a window lie between its first one and the event's own
    whole = {w: s // width for w, s in windows.items() if s // width >= 2}
    middle = [(m, w) for m, w in pairs if w in whole]
    if middle or carried:
        by_key = f"PARTITION BY {', '.join(keys)} ORDER BY _slice"
        per_slice = base.groupBy(*keys, "_slice").agg(
            *[F.expr(f"sum(cast(_m_{m} AS {EXACT})) AS _m_{m}") for m in measures], *[F.expr(f"{e} AS {n}") for n, e in carried.items()]
        )
        local = local.join(
            per_slice.selectExpr(
                *keys, "_slice",
                # the exact difference of two growing frames, which unlike a sliding one costs O(1) per row
                *[f"cast(coalesce(sum(_m_{m}) OVER ({by_key} RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - coalesce("
                  f"sum(_m_{m}) OVER ({by_key} RANGE BETWEEN UNBOUNDED PRECEDING AND {whole[w]} PRECEDING), 0) AS double) AS _mid_{m}_{w}"
                  for m, w in middle],
                *[f"max({n}) OVER ({by_key} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS {n}" for n in carried],
            ),
            [*keys, "_slice"], "inner",
        )
    inner = [(x, w) for x, w in spreads if w in whole]
    if inner:
        per_slice = base.groupBy(*keys, "_slice").agg(
            *[F.expr(f"{e} AS _at_{x}_{c}") for x in spread for c, e in zip(("n", "mean", "m2"), moments.state(f"_v_{x}"))])
        local = local.join(whole_slices(per_slice, keys, [(x, w, whole[w] - 1) for x, w in inner]), [*keys, "_slice"], "inner")
    parts = {
        (x, w): [tuple(f"{p}_{c}" for c in ("n", "mean", "m2")) for p in
                 (f"_at_own_{x}", f"_at_head_{x}_{w}", *([f"_pre_{x}_{w}", f"_suf_{x}_{w}"] if (x, w) in inner else []))]
        for x, w in spreads
    }
    local = local.selectExpr("*", *[
        f"{e} AS _all_{c}_{x}_{w}" for (x, w), p in parts.items() for c, e in zip(("n", "mean"), moments.merged(p))])
    return local.selectExpr(
        *keys, *[f"_row.{c} AS {c}" for c in payload],
        *[f"{moments.std(f'_all_n_{x}_{w}', moments.merged_m2(p, f'_all_mean_{x}_{w}'))} AS {x}_std_{w}" for (x, w), p in parts.items()],
        *[f"_own_{m} + _head_{m}_{w}" + (f" + _mid_{m}_{w}" if (m, w) in middle else "") + f" AS {m}_{w}" for m, w in pairs],
        *after,
    )


def whole_slices(per_slice: DataFrame, keys: list[str], wanted: Sequence[tuple[str, str, int]]) -> DataFrame:
    """States of the m slices before each slice, as two parts: ``_pre_{x}_{w}`` and ``_suf_{x}_{w}``.

    States cannot be taken away again, so a window that slides over m slices is made of two runs
    that only grow.  Slices are grouped m at a time; m slices in a row hold exactly one group
    border, so they are the end of one group and the beginning of the next, both of which are
    running states within their group.  Cost per slice does not depend on m.
    """
    by_key = f"PARTITION BY {', '.join(keys)} ORDER BY _slice"
    out, kept = per_slice, [*keys, "_slice"]
    for x, w, m in wanted:
        state = tuple(f"_at_{x}_{c}" for c in ("n", "mean", "m2"))
        out = out.selectExpr("*", f"_slice - pmod(_slice, {m}L) AS _group")
        for side, order in (("pre", "ASC"), ("suf", "DESC")):
            for step in moments.running(*state, f"PARTITION BY {', '.join([*keys, '_group'])} ORDER BY _slice {order}"):
                out = out.selectExpr("*", *step)
            out = out.selectExpr("*", f"struct(_slice AS at, _rn AS n, _rmean AS mean, _rm2 AS m2) AS _{side}").drop("_bn", "_bsum", "_rn", "_rmean", "_inc", "_rm2")
        # the slice before this one, and the first one that the window reaches
        out = out.selectExpr("*", f"lag(_pre) OVER ({by_key}) AS _l", f"lead(_suf) OVER ({by_key}) AS _next", f"_slice - 1 - pmod(_slice - 1, {m}L) AS _border")
        out = out.selectExpr("*", f"coalesce(last(_next) OVER ({by_key} RANGE BETWEEN UNBOUNDED PRECEDING AND {m + 1} PRECEDING), "
                                  f"first(_suf) OVER ({by_key} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS _f")
        out = out.selectExpr(
            "*", *[f"CASE WHEN _l.at >= _border THEN _l.{c} END AS _pre_{x}_{w}_{c}" for c in ("n", "mean", "m2")],
            *[f"CASE WHEN _f.at < _border AND _f.at >= _slice - {m} THEN _f.{c} END AS _suf_{x}_{w}_{c}" for c in ("n", "mean", "m2")],
        ).drop("_group", "_pre", "_suf", "_l", "_next", "_border", "_f")
        kept += [f"_{side}_{x}_{w}_{c}" for side in ("pre", "suf") for c in ("n", "mean", "m2")]
    return out.select(*kept)
