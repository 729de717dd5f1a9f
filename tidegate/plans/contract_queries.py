"""Registered queries: contract registry, schema diff, change gate, feature definitions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegate.operators import catalog as cat
from tidegate.operators import contracts, diff, gate, quality
from tidegate.plans import table_contracts as docs
from tidegate.plans.quality_queries import CHECKS
from tidegate.plans.registry import query, r
from tidegate.session import stage_table
from tidegate.sources import derived
from tidegate.sources import tables as t
from tidegate.sources.contracts import contracts_frame
from tidegate.sources.introspect import live_contract

# The two versions of every derived contract, column by column, and their documents.
COLS = """
p AS (SELECT p_partkey AS pk, p_size AS sz, p_brand AS brand, p_type AS ptype, p_partkey // 20 AS d,
        'c_' || (p_partkey % 20) AS slot, ['integer','numeric','string','timestamp','float'] AS cycle FROM part),
b AS (SELECT 'ds_' || d AS dataset, d, pk, slot AS name, cycle[sz % 5 + 1] AS type, sz % 2 = 0 AS nullable, sz % 10 = 0 AS uniq, 'text' AS descr,
        CASE WHEN cycle[sz % 5 + 1] = 'string' THEN [brand, ptype] END AS vals, CAST(sz AS DOUBLE) AS lo FROM p WHERE pk % 37 <> 0),
t AS (SELECT 'ds_' || d AS dataset, d, pk, CASE WHEN pk % 97 = 0 THEN 'r_' || (pk % 20) ELSE slot END AS name,
        cycle[(CASE WHEN pk % 13 = 0 THEN sz + 1 ELSE sz END) % 5 + 1] AS type, (sz % 2 = 0) <> (pk % 17 = 0) AS nullable,
        (sz % 10 = 0) <> (pk % 19 = 0) AS uniq, CASE WHEN pk % 11 = 0 THEN 'edited' ELSE 'text' END AS descr,
        CASE WHEN cycle[sz % 5 + 1] = 'string' THEN CASE WHEN pk % 7 = 0 THEN [brand, 'extra'] ELSE [brand, ptype] END END AS vals,
        sz + CASE WHEN pk % 23 = 0 THEN 1.0 WHEN pk % 29 = 0 THEN -1.0 ELSE 0.0 END AS lo FROM p WHERE pk % 31 <> 0),
roots AS (SELECT DISTINCT 'ds_' || d AS dataset, d FROM p)"""

WIDENING = "(b_type || '>' || t_type) IN ('integer>bigint','integer>numeric','integer>float','bigint>numeric','float>numeric')"
CHANGES = f"""{COLS},
m AS (SELECT coalesce(b.dataset, t.dataset) AS dataset, coalesce(b.name, t.name) AS name, b.pk IS NOT NULL AS has_b, t.pk IS NOT NULL AS has_t,
   b.type AS b_type, t.type AS t_type, b.nullable AS b_null, t.nullable AS t_null, b.uniq AS b_uniq, t.uniq AS t_uniq,
   b.descr AS b_descr, t.descr AS t_descr, coalesce(b.vals, []) AS b_vals, coalesce(t.vals, []) AS t_vals, b.lo AS b_lo, t.lo AS t_lo
   FROM b FULL OUTER JOIN t ON b.dataset = t.dataset AND b.name = t.name),
changes AS (
  SELECT dataset, '(root)' AS col, 'DESCRIPTION_CHANGED' AS change_type, 'SAFE' AS severity FROM roots WHERE d % 5 = 0
  UNION ALL SELECT dataset, '(root)', 'SLA_CHANGED', 'WARNING' FROM roots WHERE d % 3 = 0
  UNION ALL SELECT dataset, '(root)', 'SLA_CHANGED', 'SAFE' FROM roots WHERE d % 3 = 1
  UNION ALL SELECT dataset, '(constraints)', 'CONSTRAINT_ADDED', 'WARNING' FROM roots WHERE d % 4 = 0
  UNION ALL SELECT dataset, '(constraints)', 'CONSTRAINT_REMOVED', 'WARNING' FROM roots WHERE d % 4 = 0
  UNION ALL SELECT dataset, name, 'COLUMN_ADDED', CASE WHEN t_null THEN 'SAFE' ELSE 'WARNING' END FROM m WHERE NOT has_b
  UNION ALL SELECT dataset, name, 'COLUMN_REMOVED', 'BREAKING' FROM m WHERE NOT has_t
  UNION ALL SELECT dataset, name, 'TYPE_CHANGED', CASE WHEN {WIDENING} THEN 'SAFE' ELSE 'BREAKING' END FROM m WHERE has_b AND has_t AND b_type <> t_type
  UNION ALL SELECT dataset, name, 'NULLABILITY_CHANGED', CASE WHEN b_null THEN 'BREAKING' ELSE 'SAFE' END FROM m WHERE has_b AND has_t AND b_null <> t_null
  UNION ALL SELECT dataset, name, 'UNIQUE_CHANGED', CASE WHEN t_uniq THEN 'BREAKING' ELSE 'SAFE' END FROM m WHERE has_b AND has_t AND b_uniq <> t_uniq
  UNION ALL SELECT dataset, name, 'DESCRIPTION_CHANGED', 'SAFE' FROM m WHERE has_b AND has_t AND b_descr <> t_descr
  UNION ALL SELECT dataset, name, 'ENUM_VALUE_ADDED', 'SAFE' FROM m WHERE has_b AND has_t AND NOT list_has_all(b_vals, t_vals)
  UNION ALL SELECT dataset, name, 'ENUM_VALUE_REMOVED', 'BREAKING' FROM m WHERE has_b AND has_t AND NOT list_has_all(t_vals, b_vals)
  UNION ALL SELECT dataset, name, CASE WHEN t_lo > b_lo THEN 'RANGE_TIGHTENED' ELSE 'RANGE_EXPANDED' END, CASE WHEN t_lo > b_lo THEN 'WARNING' ELSE 'SAFE' END
    FROM m WHERE has_b AND has_t AND b_lo <> t_lo
  UNION ALL SELECT dataset, max(name) FILTER (NOT has_b), 'COLUMN_RENAMED', 'BREAKING' FROM m WHERE NOT (has_b AND has_t) GROUP BY dataset
    HAVING count(*) FILTER (NOT has_b) = 1 AND count(*) FILTER (NOT has_t) = 1 AND max(t_type) FILTER (NOT has_b) = max(b_type) FILTER (NOT has_t))"""

SUMMARY = """
summed AS (SELECT dataset, count(*) AS total_changes, count(*) FILTER (severity = 'BREAKING') AS breaking_count,
  count(*) FILTER (severity = 'WARNING') AS warning_count, count(*) FILTER (severity = 'SAFE') AS safe_count FROM changes GROUP BY dataset)"""


def versions(spark, sf):
    both = derived.contract_versions(spark, sf)
    return both.filter("version = 'v1'"), both.filter("version = 'v2'")


CHANGE_ROWS = "SELECT dataset, col AS \"column\", change_type, severity FROM changes"


@query("schema_diff", f"WITH {CHANGES} {CHANGE_ROWS}")
def schema_diff(spark, sf):
    """All changes between the two versions of every contract."""
    base, target = versions(spark, sf)
    return diff.schema_diff(base, target).select("dataset", "column", "change_type", "severity")


@query("schema_diff_history", f"WITH {CHANGES} {CHANGE_ROWS}")
def schema_diff_history(spark, sf):
    """The same changes, found by pairing every version with the one registered before it."""
    return diff.diff_history(derived.contract_versions(spark, sf)).select("dataset", "column", "change_type", "severity")


@query("schema_diff_summary", f"""WITH {CHANGES}, {SUMMARY}
SELECT dataset, 'v1' AS from_version, 'v2' AS to_version, total_changes, breaking_count, warning_count, safe_count,
  CASE WHEN breaking_count > 0 THEN 'BREAKING' WHEN warning_count > 0 THEN 'WARNING' ELSE 'SAFE' END AS classification, breaking_count > 0 AS is_breaking,
  CASE WHEN breaking_count > 0 THEN 'BLOCK MERGE' WHEN warning_count > 0 THEN 'APPROVE WITH WARNING' ELSE 'APPROVE' END AS recommendation FROM summed""")
def schema_diff_summary(spark, sf):
    base, target = versions(spark, sf)
    return diff.diff_summary(diff.schema_diff(base, target))


@query("column_set_changes", f"""WITH {CHANGES}
SELECT dataset, name AS "column", CASE WHEN NOT has_b THEN 'added' WHEN NOT has_t THEN 'removed' ELSE 'common' END AS membership FROM m""")
def column_set_changes(spark, sf):
    """Added, removed and common columns by a full outer match on names."""
    base, target = (contracts.contract_columns(x).select("dataset", "name") for x in versions(spark, sf))
    b, c = base.withColumn("_b", F.lit(1)), target.withColumn("_t", F.lit(1))
    return b.join(c, ["dataset", "name"], "full_outer").select(
        "dataset", F.col("name").alias("column"),
        F.when(F.col("_b").isNull(), "added").when(F.col("_t").isNull(), "removed").otherwise("common").alias("membership"),
    )


@query("diff_requests", f"""WITH {CHANGES},
req AS (SELECT 'req_' || d AS request_id, CASE WHEN d % 6 = 5 THEN 'none_' || d ELSE dataset END AS dataset, dataset AS real,
  CASE WHEN d % 6 = 4 THEN 'v9' ELSE 'v1' END AS f, CASE WHEN d % 6 = 3 THEN 'v1' WHEN d % 6 = 2 THEN 'v8' ELSE 'v2' END AS g FROM roots)
SELECT request_id, r.dataset, col AS "column", change_type, severity FROM req r JOIN changes c ON r.dataset = c.dataset WHERE f = 'v1' AND g = 'v2'
UNION ALL SELECT request_id, dataset, '(request)', 'ERROR', 'ERROR' FROM req WHERE NOT (f = 'v1' AND g = 'v2') OR dataset <> real""")
def diff_requests(spark, sf):
    """Requested comparisons; unknown datasets, unknown versions and equal versions give error rows."""
    registry = derived.contract_versions(spark, sf)
    d = F.floor(F.col("contract_id") / 2)
    requests = registry.filter("version = 'v1'").select(
        F.concat(F.lit("req_"), d.cast("string")).alias("request_id"),
        F.when(d % 6 == 5, F.concat(F.lit("none_"), d.cast("string"))).otherwise(F.col("dataset")).alias("dataset"),
        F.when(d % 6 == 4, "v9").otherwise("v1").alias("from_version"),
        F.when(d % 6 == 3, "v1").when(d % 6 == 2, "v8").otherwise("v2").alias("to_version"),
    )
    return diff.diff_versions(registry, requests).select("request_id", "dataset", "column", "change_type", "severity")


@query("live_schema_diff", """
SELECT 'o_clerk' AS "column", 'COLUMN_REMOVED' AS change_type, 'BREAKING' AS severity
UNION ALL SELECT 'o_orderkey', 'TYPE_CHANGED', 'SAFE' UNION ALL SELECT 'o_custkey', 'TYPE_CHANGED', 'SAFE'
UNION ALL SELECT 'o_orderkey', 'NULLABILITY_CHANGED', 'SAFE' FROM orders WHERE o_orderkey IS NULL GROUP BY 1""")
def live_schema_diff(spark, sf):
    """A contract against the physical schema and observed nulls of the live table."""
    live = live_contract(t.table(spark, sf, "orders"), "orders", scan_nulls=True)
    return diff.schema_diff(contracts_frame(spark, [docs.ORDERS]), live, live=True).select("column", "change_type", "severity")


ERRORS = """n AS (SELECT dataset, d, row_number() OVER (PARTITION BY dataset ORDER BY pk) - 1 AS i, name, type, lo, vals FROM b),
s AS (SELECT *, i + d AS k, CASE WHEN (i + d) % 41 = 0 THEN 'c_0' ELSE name END AS nm FROM n),
errs AS (
  SELECT dataset, count(*) AS errors FROM (
    SELECT dataset FROM roots WHERE d % 10 = 9
    UNION ALL SELECT dataset FROM roots WHERE d % 10 = 9
    UNION ALL SELECT dataset FROM roots WHERE d % 9 = 4
    UNION ALL SELECT dataset FROM roots WHERE d % 7 = 3
    UNION ALL SELECT dataset FROM roots WHERE d % 8 = 5
    UNION ALL SELECT dataset FROM (SELECT dataset, row_number() OVER (PARTITION BY dataset, nm ORDER BY i) AS seen FROM s) WHERE seen > 1
    UNION ALL SELECT dataset FROM s WHERE k % 43 = 0
    UNION ALL SELECT dataset FROM s WHERE k % 47 = 0
    UNION ALL SELECT dataset FROM s WHERE k % 53 = 0
    UNION ALL SELECT dataset FROM s WHERE (CASE WHEN k % 29 = 0 THEN 1000.0 ELSE lo END) > 100.0)
  GROUP BY dataset)"""

GATE = f"""{CHANGES}, {SUMMARY},
verdicts AS (SELECT r.dataset, coalesce(breaking_count, 0) AS breaking_count, coalesce(warning_count, 0) AS warning_count,
  CASE WHEN r.d % 10 = 7 THEN 1 ELSE coalesce(safe_count, 0) END AS safe_count0, r.d FROM roots r LEFT JOIN summed s ON r.dataset = s.dataset),
gated AS (SELECT dataset, CASE WHEN d % 10 = 7 THEN 0 ELSE breaking_count END AS breaking_count,
  CASE WHEN d % 10 = 7 THEN 0 ELSE warning_count END AS warning_count, safe_count0 AS safe_count FROM verdicts),
v AS (SELECT *, CASE WHEN breaking_count > 0 THEN 'BREAKING' WHEN warning_count > 0 THEN 'WARNING' ELSE 'SAFE' END AS verdict FROM gated)"""


def gated(spark, sf):
    base, target = versions(spark, sf)
    # every tenth contract is new: it has no first version
    known = base.filter(F.floor(F.col("contract_id") / 2) % 10 != 7)
    return gate.gate_verdicts(known, target)


@query("gate_verdicts", f"WITH {GATE} SELECT dataset, true AS contract_valid, breaking_count, warning_count, safe_count, verdict, verdict <> 'BREAKING' AS can_merge FROM v")
def gate_verdicts(spark, sf):
    """One merge verdict per changed contract."""
    return gated(spark, sf).drop("quality_score")


@query("gate_summary", f"""WITH {GATE}
SELECT count(*) AS total_contracts, count(*) FILTER (verdict = 'BREAKING') AS contracts_breaking, count(*) FILTER (verdict = 'WARNING') AS contracts_warning,
  count(*) FILTER (verdict = 'SAFE') AS contracts_safe, CAST(sum(breaking_count) AS BIGINT) AS total_breaking_changes,
  CAST(sum(warning_count) AS BIGINT) AS total_warning_changes, CAST(sum(safe_count) AS BIGINT) AS total_safe_changes,
  CASE WHEN count(*) FILTER (verdict = 'BREAKING') > 0 THEN 'BREAKING' WHEN count(*) FILTER (verdict = 'WARNING') > 0 THEN 'WARNING' ELSE 'SAFE' END AS verdict,
  count(*) FILTER (verdict = 'BREAKING') = 0 AS can_merge, CAST(count(*) FILTER (verdict = 'BREAKING') > 0 AS BIGINT) AS exit_code FROM v""")
def gate_summary(spark, sf):
    return gate.gate_summary(gated(spark, sf))


SPOILT = "d % 10 = 9 OR d % 9 = 4 OR d % 7 = 3 OR d % 8 = 5"
SCORED = f"""{CHANGES}, {SUMMARY}, {ERRORS}, {CHECKS},
scores AS (SELECT dataset, quality_score FROM qruns QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY ts DESC, run_id DESC) = 1),
x AS (SELECT dataset, d, {SPOILT} AS spoilt FROM roots),
g AS (SELECT x.dataset, NOT spoilt AS contract_valid, quality_score, CASE WHEN spoilt THEN errors WHEN d % 10 = 7 THEN 0 ELSE coalesce(breaking_count, 0) END AS breaking_count,
  CASE WHEN spoilt OR d % 10 = 7 THEN 0 ELSE coalesce(warning_count, 0) END AS warning_count, CASE WHEN spoilt THEN 0 WHEN d % 10 = 7 THEN 1 ELSE coalesce(safe_count, 0) END AS safe_count
  FROM x LEFT JOIN summed USING (dataset) LEFT JOIN errs USING (dataset) LEFT JOIN scores USING (dataset)),
v AS (SELECT *, CASE WHEN breaking_count > 0 OR coalesce(quality_score < 70, false) THEN 'BREAKING' WHEN warning_count > 0 THEN 'WARNING' ELSE 'SAFE' END AS verdict FROM g)"""


def gated_with_quality(spark, sf):
    """Verdicts where some targets have structure errors and the datasets' latest quality scores count."""
    base, target = versions(spark, sf)
    number = F.floor(F.col("contract_id") / 2)
    spoilt = F.expr(SPOILT.replace("d %", "floor(contract_id / 2) %"))
    target = target.filter(~spoilt).unionByName(derived.broken_contracts(spark, sf).filter(spoilt))
    scores = quality.latest_runs(derived.quality_runs(spark, sf)).select("dataset", "quality_score")
    return gate.gate_verdicts(base.filter(number % 10 != 7), target, scores)


@query("gate_with_quality", f"""WITH {SCORED}
SELECT dataset, contract_valid, breaking_count, warning_count, safe_count, {r("coalesce(quality_score, -1)")} AS quality_score, verdict, verdict <> 'BREAKING' AS can_merge FROM v""")
def gate_with_quality(spark, sf):
    """Merge verdicts with structure errors in a third of the targets, and a floor on the latest quality score."""
    return gated_with_quality(spark, sf).withColumn("quality_score", F.coalesce("quality_score", F.lit(-1.0)))


@query("gate_override", f"""WITH {SCORED},
o AS (SELECT unnest([false, true]) AS allow_breaking)
SELECT allow_breaking, count(*) AS total_contracts, count(*) FILTER (verdict = 'BREAKING') AS contracts_breaking, count(*) FILTER (verdict = 'WARNING') AS contracts_warning,
  count(*) FILTER (verdict = 'SAFE') AS contracts_safe, CAST(sum(breaking_count) AS BIGINT) AS total_breaking_changes,
  CASE WHEN count(*) FILTER (verdict = 'BREAKING') > 0 AND NOT allow_breaking THEN 'BREAKING' WHEN count(*) FILTER (verdict = 'WARNING') > 0 THEN 'WARNING' ELSE 'SAFE' END AS verdict,
  count(*) FILTER (verdict = 'BREAKING') = 0 OR allow_breaking AS can_merge, CAST(count(*) FILTER (verdict = 'BREAKING') > 0 AND NOT allow_breaking AS BIGINT) AS exit_code
FROM v, o GROUP BY allow_breaking""")
def gate_override(spark, sf):
    """The roll-up of the same change as it is, and with breaking changes allowed."""
    verdicts = stage_table(gated_with_quality(spark, sf), "verdicts")
    sides = [gate.gate_summary(verdicts, allowed).withColumn("allow_breaking", F.lit(allowed)) for allowed in (False, True)]
    return sides[0].unionByName(sides[1]).select(
        "allow_breaking", "total_contracts", "contracts_breaking", "contracts_warning", "contracts_safe", "total_breaking_changes",
        "verdict", "can_merge", F.col("exit_code").cast("bigint").alias("exit_code"))


# -- validation and the registry ------------------------------------------------------------

@query("contract_validation", f"""WITH {COLS}, {ERRORS}
SELECT r.dataset, coalesce(errors, 0) AS errors, errors IS NULL AS is_valid FROM roots r LEFT JOIN errs USING (dataset)""")
def contract_validation(spark, sf):
    """Number of structure errors per contract of a set with planted errors."""
    checked = contracts.validate_contracts(derived.broken_contracts(spark, sf))
    return checked.select("dataset", F.size("errors").cast("bigint").alias("errors"), "is_valid")


@query("contract_registration", f"""WITH {COLS}
SELECT dataset, 'v1' AS version, CASE WHEN d % 3 = 0 THEN 'DUPLICATE' ELSE 'REGISTERED' END AS outcome FROM roots
UNION ALL SELECT dataset, 'v2', 'REGISTERED' FROM roots""")
def contract_registration(spark, sf):
    """Registering both versions where a third of the first ones exists already."""
    incoming = derived.contract_versions(spark, sf)
    existing = incoming.filter((F.col("version") == "v1") & (F.floor(F.col("contract_id") / 2) % 3 == 0))
    return contracts.register(incoming, existing).select("dataset", "version", "outcome")


LISTED = f"""{COLS},
n AS (SELECT 'v1' AS version, dataset, count(*) AS k FROM b GROUP BY dataset UNION ALL SELECT 'v2', dataset, count(*) FROM t GROUP BY dataset),
reg AS (SELECT r.dataset, r.d, version, k, 'team_' || (d % 5) AS owner, CASE WHEN d % 4 = 3 THEN 'DRAFT' ELSE 'ACTIVE' END AS status
  FROM roots r JOIN n USING (dataset))"""


@query("list_contracts", f"WITH {LISTED} SELECT dataset, version, owner, status, k AS column_count FROM reg WHERE owner = 'team_2' AND status = 'ACTIVE'")
def list_contracts(spark, sf):
    rows = contracts.list_contracts(derived.contract_versions(spark, sf), owner="team_2", status="ACTIVE")
    return rows.select("dataset", "version", "owner", "status", F.col("column_count").cast("bigint"))


@query("latest_contracts", f"WITH {LISTED} SELECT dataset, version, k AS column_count FROM reg WHERE version = 'v2'")
def latest_contracts(spark, sf):
    """The last registered version of every dataset."""
    rows = contracts.latest_versions(derived.contract_versions(spark, sf))
    return rows.select("dataset", "version", F.size("columns").cast("bigint").alias("column_count"))


@query("get_contract", f"WITH {LISTED} SELECT dataset, version, owner FROM reg WHERE dataset = 'ds_3' AND version = 'v2'")
def get_contract(spark, sf):
    return contracts.get_contract(derived.contract_versions(spark, sf), "ds_3").select("dataset", "version", "owner")


@query("contract_version_history", f"WITH {LISTED} SELECT dataset, version, k AS column_count FROM reg WHERE dataset = 'ds_4'")
def contract_version_history(spark, sf):
    rows = contracts.version_history(derived.contract_versions(spark, sf), "ds_4")
    return rows.select("dataset", "version", F.size("columns").cast("bigint").alias("column_count"))


@query("registry_totals", f"WITH {LISTED} SELECT version, count(*) AS contracts, count(DISTINCT dataset) AS datasets FROM reg GROUP BY version")
def registry_totals(spark, sf):
    return contracts.registry_totals(derived.contract_versions(spark, sf))


# -- feature definitions --------------------------------------------------------------------

@query("feature_definitions_upsert", """SELECT 'feature_' || (p_partkey // 4) AS name, arg_max(p_type, p_partkey) AS feature_group,
  arg_max(p_brand, p_partkey) AS entity, CAST(arg_max(p_size, p_partkey) AS BIGINT) AS freshness_sla_minutes, max(p_partkey) AS updated_at FROM part GROUP BY 1""")
def feature_definitions_upsert(spark, sf):
    """The registry after successive definitions of the same features."""
    rows = derived.feature_definitions(spark, sf)
    old = rows.filter(F.col("updated_at") % 4 < 2)
    return cat.upsert_definitions(old, rows.filter(F.col("updated_at") % 4 >= 2))


@query("feature_groups", "SELECT p_type AS feature_group, p_brand AS entity, count(*) AS features FROM part GROUP BY 1, 2")
def feature_groups(spark, sf):
    return cat.feature_groups(derived.feature_definitions(spark, sf))


@query("list_features", "SELECT 'feature_' || (p_partkey // 4) AS name, p_partkey AS updated_at FROM part WHERE p_type = 'SMALL' AND p_brand = 'Brand#4'")
def list_features(spark, sf):
    """Definitions of one group and entity."""
    return cat.list_features(derived.feature_definitions(spark, sf), "Brand#4", "SMALL").select("name", "updated_at")
