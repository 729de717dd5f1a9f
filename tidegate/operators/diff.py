"""Schema diff: contract versions against each other, for any number of datasets at once.

Base and target columns meet in one full outer join on (pair, column name); each rule is an
expression that yields a change row or null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.functions.scalars import SAFE_WIDENINGS, normalize_type
from tidegate.operators.slices import with_previous

CHANGE_COLUMNS = ["column", "change_type", "old_value", "new_value", "severity", "description"]


def _change(cond: str, column: str, change_type: str, old: str, new: str, severity: str, text: str) -> str:
    """SQL: a change struct where the condition holds, else null.  All parts are SQL texts."""
    return (
        f"CASE WHEN {cond} THEN named_struct('column', cast({column} AS string), 'change_type', {change_type}, "
        f"'old_value', cast({old} AS string), 'new_value', cast({new} AS string), 'severity', {severity}, 'description', {text}) END"
    )


def widening_sql(old: str, new: str) -> str:
    pairs = ", ".join(f"'{a}>{b}'" for a, b in SAFE_WIDENINGS)
    return f"concat({old}, '>', {new}) IN ({pairs})"


def type_change_sql(old: str, new: str) -> tuple[str, str]:
    """(severity, text) of a change between two normalised types."""
    wide = widening_sql(old, new)
    kind = (
        f"CASE WHEN {wide} THEN 'widening' WHEN {old} IN ('float', 'numeric') AND {new} = 'integer' THEN 'narrowing, fractions are lost' "
        f"WHEN {old} = 'bigint' AND {new} = 'integer' THEN 'narrowing, large values overflow' ELSE 'incompatible types' END"
    )
    return f"CASE WHEN {wide} THEN 'SAFE' ELSE 'BREAKING' END", f"concat('type ', {old}, ' to ', {new}, ': ', {kind})"


def schema_diff(
    base: DataFrame, target: DataFrame, pair: Sequence[str] = ("dataset",), live: bool = False
) -> DataFrame:
    """Change rows of every pair that has a base and a target.

    ``live`` says the target was inferred from data: it declares no enums, constraints or
    uniqueness, and seeing no nulls is not a promise, so those rules (and tightening of
    nullability) are left out.
    """
    pair = list(pair)
    fields = ("version", "description", "freshness_sla_minutes", "constraint_texts")
    roots = base.selectExpr(*pair, *[f"{c} AS b_{c}" for c in fields]).join(
        target.selectExpr(*pair, *[f"{c} AS t_{c}" for c in fields]), pair, "inner"
    )
    head = [*pair, "b_version AS from_version", "t_version AS to_version"]
    keep = [*pair, "from_version", "to_version"]

    # -- document level -------------------------------------------------------------
    b_desc, t_desc = "trim(coalesce(b_description, ''))", "trim(coalesce(t_description, ''))"
    b_sla, t_sla = "b_freshness_sla_minutes", "t_freshness_sla_minutes"
    root_rules = [
        _change(f"{b_desc} != '' AND {t_desc} != '' AND {b_desc} != {t_desc}", "'(root)'", "'DESCRIPTION_CHANGED'", b_desc, t_desc,
                "'SAFE'", "'description edited'"),
        _change(f"{t_sla} < {b_sla}", "'(root)'", "'SLA_CHANGED'", b_sla, t_sla, "'WARNING'", "'freshness SLA is stricter'"),
        _change(f"{t_sla} > {b_sla}", "'(root)'", "'SLA_CHANGED'", b_sla, t_sla, "'SAFE'", "'freshness SLA is looser'"),
    ]
    changes = f"array_compact(array({', '.join(root_rules)}))"
    if not live:
        def texts(kind: str, one: str, other: str, old: str, new: str, note: str) -> str:
            row = _change("true", "'(constraints)'", f"'{kind}'", old, new, "'WARNING'", f"'{note}'")
            return (f"transform(coalesce(array_except({one}_constraint_texts, {other}_constraint_texts), "
                    f"cast(array() AS array<string>)), x -> {row})")

        changes = (
            f"concat({changes}, {texts('CONSTRAINT_ADDED', 't', 'b', 'NULL', 'x', 'constraint added')}, "
            f"{texts('CONSTRAINT_REMOVED', 'b', 't', 'x', 'NULL', 'constraint removed')})"
        )
    root_rows = roots.selectExpr(*head, f"inline({changes})")

    # -- column level ---------------------------------------------------------------
    def columns(side: DataFrame, tag: str) -> DataFrame:
        return side.selectExpr(*pair, "explode(columns) AS c").select(
            *pair, F.col("c.name").alias("name"), F.col("c").alias(tag), normalize_type("c.type").alias(f"{tag}_type")
        )

    matched = (
        columns(base, "b").join(columns(target, "t"), [*pair, "name"], "full_outer")
        .join(roots.selectExpr(*head), pair, "inner")
        .selectExpr(
            "*", "b IS NOT NULL AND t IS NOT NULL AS common",
            *[f"coalesce({x}.nullable, true) AS {x}_null" for x in "bt"],
            *[f"coalesce({x}.unique, false) AS {x}_uniq" for x in "bt"],
            *[f"trim(coalesce({x}.description, '')) AS {x}_desc" for x in "bt"],
            *[f"coalesce({x}.allowed_values, cast(array() AS array<string>)) AS {x}_enum" for x in "bt"],
        )
        .selectExpr(
            "*", "array_sort(array_except(t_enum, b_enum)) AS more", "array_sort(array_except(b_enum, t_enum)) AS fewer"
        )
    )
    severity, explanation = type_change_sql("b_type", "t_type")
    t_kind, b_kind = "coalesce(t.type, 'string')", "coalesce(b.type, 'string')"
    b_list, t_list = "array_join(array_sort(b_enum), ',')", "array_join(array_sort(t_enum), ',')"
    rules = [
        _change("b IS NULL AND t_null", "name", "'COLUMN_ADDED'", "NULL", t_kind, "'SAFE'", "'nullable column added'"),
        _change("b IS NULL AND NOT t_null", "name", "'COLUMN_ADDED'", "NULL", t_kind, "'WARNING'", "'column added that producers must fill'"),
        _change("t IS NULL", "name", "'COLUMN_REMOVED'", b_kind, "NULL", "'BREAKING'", "'column removed'"),
        _change("common AND b_type != t_type", "name", "'TYPE_CHANGED'", "b.type", "t.type", severity, explanation),
        _change("common AND NOT b_null AND t_null", "name", "'NULLABILITY_CHANGED'", "b_null", "t_null", "'SAFE'", "'nulls are now allowed'"),
        _change("common AND b_desc != '' AND t_desc != '' AND b_desc != t_desc", "name", "'DESCRIPTION_CHANGED'", "b_desc", "t_desc",
                "'SAFE'", "'description edited'"),
    ]
    for bound, tighter in (("min", "t.min > b.min"), ("max", "t.max < b.max")):
        differs = f"common AND b.{bound} != t.{bound}"
        rules.append(_change(f"{differs} AND {tighter}", "name", "'RANGE_TIGHTENED'", f"b.{bound}", f"t.{bound}", "'WARNING'", f"'{bound} tightened'"))
        rules.append(_change(f"{differs} AND NOT ({tighter})", "name", "'RANGE_EXPANDED'", f"b.{bound}", f"t.{bound}", "'SAFE'", f"'{bound} relaxed'"))
    if not live:
        rules += [
            _change("common AND b_null AND NOT t_null", "name", "'NULLABILITY_CHANGED'", "b_null", "t_null", "'BREAKING'",
                    "'nulls are no longer allowed'"),
            _change("common AND NOT b_uniq AND t_uniq", "name", "'UNIQUE_CHANGED'", "b_uniq", "t_uniq", "'BREAKING'", "'values must now be unique'"),
            _change("common AND b_uniq AND NOT t_uniq", "name", "'UNIQUE_CHANGED'", "b_uniq", "t_uniq", "'SAFE'", "'values may now repeat'"),
            _change("common AND size(more) > 0", "name", "'ENUM_VALUE_ADDED'", b_list, t_list, "'SAFE'",
                    "concat('values added: ', array_join(more, ','))"),
            _change("common AND size(fewer) > 0", "name", "'ENUM_VALUE_REMOVED'", b_list, t_list, "'BREAKING'",
                    "concat('values removed: ', array_join(fewer, ','))"),
        ]
    column_rows = matched.selectExpr(*keep, f"inline(array_compact(array({', '.join(rules)})))")

    # -- rename: exactly one column gone and one new, of the same type ------------------
    renamed = matched.filter("b IS NULL OR t IS NULL").groupBy(*keep).agg(*[F.expr(e) for e in (
        "count_if(t IS NULL) AS gone", "count_if(b IS NULL) AS new",
        "max(CASE WHEN t IS NULL THEN name END) AS old_name", "max(CASE WHEN b IS NULL THEN name END) AS new_name",
        "max(CASE WHEN t IS NULL THEN b_type END) AS old_type", "max(CASE WHEN b IS NULL THEN t_type END) AS new_type",
    )]).filter("gone = 1 AND new = 1 AND old_type = new_type")
    rename = _change("true", "new_name", "'COLUMN_RENAMED'", "old_name", "new_name", "'BREAKING'", "'looks like a rename'")
    rename_rows = renamed.selectExpr(*keep, f"inline(array({rename}))")
    return root_rows.unionByName(column_rows).unionByName(rename_rows)


def diff_summary(changes: DataFrame, keys: Sequence[str] = ("dataset", "from_version", "to_version")) -> DataFrame:
    """Counts per severity, the highest severity, and what to do with the change."""
    def n(s: str) -> Column:
        return F.count_if(F.col("severity") == s)

    breaking, warning = n("BREAKING"), n("WARNING")
    return changes.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_changes"),
        breaking.alias("breaking_count"),
        warning.alias("warning_count"),
        n("SAFE").alias("safe_count"),
        F.when(breaking > 0, "BREAKING").when(warning > 0, "WARNING").otherwise("SAFE").alias("classification"),
        (breaking > 0).alias("is_breaking"),
        F.when(breaking > 0, "BLOCK MERGE").when(warning > 0, "APPROVE WITH WARNING").otherwise("APPROVE")
        .alias("recommendation"),
    )


def diff_versions(registry: DataFrame, requests: DataFrame) -> DataFrame:
    """Diff requested version pairs (request_id, dataset, from_version, to_version).

    A request that names an unknown dataset or version, or the same version twice, gives
    one row with change_type ERROR instead of failing the others.
    """
    docs = registry.select("dataset", "version", F.struct(*[F.col(c) for c in registry.columns]).alias("doc"))
    known = registry.select("dataset").distinct().withColumn("_known", F.lit(True))

    def version_of(column: str, tag: str) -> DataFrame:
        return docs.select("dataset", F.col("version").alias(column), F.col("doc").alias(tag))

    r = (
        requests.join(known, "dataset", "left")
        .join(version_of("from_version", "_b"), ["dataset", "from_version"], "left")
        .join(version_of("to_version", "_t"), ["dataset", "to_version"], "left")
    )
    problem = (
        F.when(F.col("_known").isNull(), "unknown dataset")
        .when(F.col("_b").isNull(), "unknown base version")
        .when(F.col("_t").isNull(), "unknown target version")
        .when(F.col("from_version") == F.col("to_version"), "same version")
    )
    good = r.filter(problem.isNull())
    changes = schema_diff(
        good.select("request_id", "_b.*"), good.select("request_id", "_t.*"), ("request_id", "dataset")
    )
    errors = r.filter(problem.isNotNull()).select(
        "request_id", "dataset", "from_version", "to_version",
        F.lit("(request)").alias("column"), F.lit("ERROR").alias("change_type"),
        F.lit(None).cast("string").alias("old_value"), F.lit(None).cast("string").alias("new_value"),
        F.lit("ERROR").alias("severity"), problem.alias("description"),
    )
    return changes.unionByName(errors)


def diff_history(registry: DataFrame) -> DataFrame:
    """Diff of every version with the one registered before it, for all datasets."""
    order = registry.select("dataset", "registered_at", "contract_id")
    steps = with_previous(order, ["dataset"], "registered_at", "contract_id").filter("_prev IS NOT NULL")
    pairs = steps.select(
        F.col("contract_id").alias("target_id"), F.col("_prev.contract_id").alias("base_id")
    )
    base = registry.join(pairs, F.col("contract_id") == F.col("base_id"), "inner")
    target = registry.join(pairs, F.col("contract_id") == F.col("target_id"), "inner")
    return schema_diff(base, target, ("target_id", "dataset")).drop("target_id")
