"""Registered queries: target candidates (T1-T8) over the long column
profile of several driver tables (catalog scale: windows per table)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import targets as TG
from ..operators.profile import profile_columns_df
from ..session import cut_lineage
from ..sources.tables import load_table
from .registry import query
from .sqlgen import profile_columns_sql, q

CATALOG = ["customer", "part", "orders", "lineitem"]


def catalog_profile(spark, sf):
    """Long profile of several tables. It has one row per column and is read
    several times by the candidate queries, so it is checkpointed once."""
    out = None
    for t in CATALOG:
        p = profile_columns_df(load_table(spark, sf, t), t, with_rows=True)
        out = p if out is None else out.unionByName(p)
    return cut_lineage(out)


_CAT_SQL = "(" + " UNION ALL ".join(
    f"SELECT *, (SELECT CAST(count(*) AS BIGINT) FROM {t}) AS n_rows FROM ({profile_columns_sql(t)})" for t in CATALOG
) + ")"


def _contains_sql(x, words):
    return "(" + " OR ".join(f"contains(lower({x}), {q(w)})" for w in words) + ")"


_IDLIKE = (f"({_contains_sql('name', TG.ID_NAME_PATTERNS)} OR (n_rows > 10 AND unique_count >= n_rows * 0.95))")
_LEAK = _contains_sql("name", TG.LEAKAGE_NAME_PATTERNS)


@query("id_like", "T1, D14", f"SELECT table_name, name AS column, {_IDLIKE} AS is_id_like FROM {_CAT_SQL}")
def q_idlike(spark, sf):
    p = TG.with_flags(catalog_profile(spark, sf))
    return p.select("table_name", F.col("name").alias("column"), "is_id_like")


@query("leakage_names", "T2", f"SELECT table_name, name AS column, {_LEAK} AS is_leakage_risk FROM {_CAT_SQL}")
def q_leak(spark, sf):
    p = TG.with_flags(catalog_profile(spark, sf))
    return p.select("table_name", F.col("name").alias("column"), "is_leakage_risk")


_CAND_SQL = f"""SELECT table_name, "column", confidence, reason, col_type, is_leakage_risk, warning, rank FROM (
  SELECT table_name, name AS column, 0.5 AS confidence,
    column_type || ' column with ' || unique_count || ' unique values' AS reason, column_type AS col_type,
    {_LEAK} AS is_leakage_risk, NULL::VARCHAR AS warning,
    CAST(row_number() OVER (PARTITION BY table_name ORDER BY pos) AS INTEGER) AS rank
  FROM {_CAT_SQL} WHERE NOT {_IDLIKE} AND NOT is_constant) WHERE rank <= 10"""


@query("target_candidates", "T3", _CAND_SQL)
def q_cands(spark, sf):
    return TG.candidate_list(catalog_profile(spark, sf))


def _suggestions(prof):
    """Suggested targets derived from each table's schema: the columns at
    positions 2 and 3, plus one name the table does not have."""
    s = prof.where(F.col("pos").isin(2, 3)).select(
        "table_name", F.col("name").alias("column"), F.lit(0.8).alias("confidence"),
        F.lit("suggested").alias("reason"), (F.col("pos") - 1).cast("int").alias("rank"))
    ghost = prof.select("table_name").distinct().select(
        "table_name", F.lit("no_such_column").alias("column"), F.lit(0.7).alias("confidence"),
        F.lit("suggested").alias("reason"), F.lit(3).alias("rank"))
    return s.unionByName(ghost)


_SUGG_SQL = f"""(SELECT table_name, name AS column, 0.8 AS confidence, 'suggested' AS reason,
  CAST(pos - 1 AS INTEGER) AS rank FROM {_CAT_SQL} WHERE pos IN (2, 3)
 UNION ALL SELECT DISTINCT table_name, 'no_such_column', 0.7, 'suggested', 3 FROM {_CAT_SQL})"""
_VALID_SQL = f"""SELECT s.table_name, s.column, CAST(s.confidence AS DOUBLE) AS confidence, s.reason,
  p.column_type AS col_type, {_LEAK.replace('name', 'p.name')} AS is_leakage_risk,
  CASE WHEN {_LEAK.replace('name', 'p.name')} THEN {q(TG.LEAKAGE_WARNING)} END AS warning, s.rank
FROM {_SUGG_SQL} s JOIN {_CAT_SQL} p ON s.table_name = p.table_name AND s.column = p.name
WHERE NOT {_IDLIKE.replace('name', 'p.name').replace('n_rows', 'p.n_rows').replace('unique_count', 'p.unique_count')}"""


@query("validated_candidates", "T4", _VALID_SQL)
def q_valid(spark, sf):
    prof = catalog_profile(spark, sf)
    return TG.validate_suggestions(_suggestions(prof), prof)


def _fmt0(x):
    return f"CAST(CAST(round_even({x}, 0) AS BIGINT) AS VARCHAR)"


_SUPP_SQL = f"""WITH v AS ({_VALID_SQL}),
have AS (SELECT table_name, count(*) AS have, max(rank) AS last_rank FROM v GROUP BY table_name),
extra AS (
  SELECT p.*, CASE WHEN column_type = 'numeric' THEN 0.4 WHEN unique_count <= 20 THEN 0.3 ELSE 0.2 END AS conf,
    CASE WHEN column_type = 'numeric' AND min IS NOT NULL AND max IS NOT NULL
         THEN 'Numeric column (range: ' || {_fmt0('min')} || ' to ' || {_fmt0('max')} || ')'
         WHEN column_type = 'numeric' THEN 'Numeric column (' || unique_count || ' unique values)'
         ELSE 'Categorical column (' || unique_count || ' categories)' END AS why
  FROM {_CAT_SQL} p WHERE NOT {_IDLIKE} AND NOT is_constant
    AND NOT EXISTS (SELECT 1 FROM v WHERE v.table_name = p.table_name AND v.column = p.name)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY table_name
             ORDER BY CASE WHEN column_type = 'numeric' THEN 0 ELSE 1 END, conf DESC, pos) AS r FROM extra)
SELECT * FROM v
UNION ALL
SELECT x.table_name, x.name, x.conf, x.why, x.column_type, {_LEAK.replace('name', 'x.name')}, NULL::VARCHAR,
  CAST(coalesce(h.last_rank, 0) + x.r AS INTEGER)
FROM ranked x LEFT JOIN have h ON x.table_name = h.table_name WHERE x.r <= 3 - coalesce(h.have, 0)"""


@query("supplemented_candidates", "T5", _SUPP_SQL)
def q_supp(spark, sf):
    prof = catalog_profile(spark, sf)
    return TG.supplement(TG.validate_suggestions(_suggestions(prof), prof), prof)


# Every candidate of every table; tables are split by column type, so that some have one candidate.
@query("accept_gate", "T6", f"""SELECT table_name, CAST(count(*) AS BIGINT) AS n_candidates,
  CASE WHEN count(*) = 1 AND arg_min(confidence, rank) >= 0.95 THEN arg_min("column", rank) END AS chosen_target,
  NOT (count(*) = 1 AND arg_min(confidence, rank) >= 0.95) AS needs_confirmation
FROM (SELECT table_name || '.' || col_type || '.' || length("column") AS table_name, "column", rank,
        CASE WHEN length("column") % 2 = 0 THEN 0.97 ELSE confidence END AS confidence FROM ({_CAND_SQL})) GROUP BY table_name""")
def q_gate(spark, sf):
    c = TG.candidate_list(catalog_profile(spark, sf))
    return TG.accept_gate(c.select(
        F.concat_ws(".", "table_name", "col_type", F.length("column").cast("string")).alias("table_name"), "column", "rank",
        F.when(F.length("column") % 2 == 0, 0.97).otherwise(F.col("confidence")).alias("confidence")))


@query("task_type", "T7", f"""SELECT table_name, name AS column, CASE
  WHEN column_type <> 'numeric' THEN 'classification'
  WHEN unique_count <= 10 THEN 'classification'
  WHEN (CASE WHEN n_rows - missing_count > 0 THEN unique_count / (n_rows - missing_count) ELSE 0.0 END) > 0.5
    THEN 'regression'
  WHEN unique_count > 20 THEN 'regression' ELSE 'classification' END AS task_type FROM {_CAT_SQL}""")
def q_task(spark, sf):
    return TG.task_type(catalog_profile(spark, sf))


@query("task_type_interactive", "T8", f"""SELECT table_name, name AS column, CASE
  WHEN column_type <> 'numeric' THEN 'classification'
  WHEN unique_count <= 10 OR unique_count / greatest(n_rows - missing_count, 1) < 0.05 THEN 'classification'
  ELSE 'regression' END AS task_type FROM {_CAT_SQL}""")
def q_task_i(spark, sf):
    return TG.task_type_interactive(catalog_profile(spark, sf))
