"""SQL text builders for the DuckDB oracle (string assembly only)."""

from __future__ import annotations

from ..functions.numeric import rnd_sql
from ..functions.text import DATETIME_FORMATS, EDGE_SPACE, EMPTY_NAME, MISSING_TOKENS, NUMERIC_GUARD, SNAKE_STEPS
from ..sources.tables import DIRTY_EVENTS_SQL, DIRTY_ORDERS_SQL, duck_sql
from .schemas import TABLE_SCHEMAS, type_family

DUCK_EDGE_SPACE = EDGE_SPACE   # same character class in both engines


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def with_dirty(body: str) -> str:
    """Prefix the dirty views as CTEs (merged with the body's own WITH)."""
    head = (f"WITH dirty_orders AS ({duck_sql(DIRTY_ORDERS_SQL)}),\n"
            f"dirty_events AS ({duck_sql(DIRTY_EVENTS_SQL)})")
    stripped = body.lstrip()
    if stripped[:5].upper() == "WITH ":
        return f"{head},\n{stripped[5:]}"
    return f"{head}\n{body}"


def source(table: str) -> str:
    return table


def trim_sql(c: str) -> str:
    return f"regexp_replace({c}, '{DUCK_EDGE_SPACE}', '', 'g')"


def tokens_sql(c: str) -> str:
    toks = ", ".join(q(t) for t in MISSING_TOKENS)
    return f"CASE WHEN {c} IN ({toks}) THEN NULL ELSE {c} END"


def guarded_double_sql(c: str) -> str:
    return f"CASE WHEN regexp_matches({c}, '{NUMERIC_GUARD}') THEN TRY_CAST(trim({c}) AS DOUBLE) END"


def parse_datetime_sql(c: str) -> str:
    parts = [f"CASE WHEN regexp_matches({c}, '{rx}') THEN try_strptime({c}, '{duck}') END"
             for rx, _spark, duck in DATETIME_FORMATS]
    return f"CAST(coalesce({', '.join(parts)}) AS TIMESTAMP)"


def missing_sql(c: str, t: str) -> str:
    if t in ("double", "float"):
        return f"count_if({c} IS NULL OR isnan({c}))"
    return f"count_if({c} IS NULL)"


def profile_columns_sql(table: str, src: str | None = None) -> str:
    """Oracle for ``profile_columns_df``: one SELECT per column."""
    cols = TABLE_SCHEMAS[table]
    parts = []
    for i, (c, t) in enumerate(cols):
        fam = type_family(t)
        ctype = {"numeric": "numeric", "boolean": "numeric", "datetime": "datetime"}.get(fam, "categorical")
        miss = missing_sql(c, t)
        if fam == "numeric":
            mom = (f"CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, "
                   f"{rnd_sql(f'avg({c})')} AS mean, {rnd_sql(f'stddev_samp({c})')} AS std")
        else:
            mom = "NULL::DOUBLE AS min, NULL::DOUBLE AS max, NULL::DOUBLE AS mean, NULL::DOUBLE AS std"
        hc = f"count(DISTINCT {c}) > 50" if ctype == "categorical" else "NULL::BOOLEAN"
        parts.append(
            f"SELECT {q(table)} AS table_name, CAST({i} AS INTEGER) AS pos, {q(c)} AS name, {q(t)} AS dtype, "
            f"{q(ctype)} AS column_type, CAST({miss} AS BIGINT) AS missing_count, "
            f"CASE WHEN count(*) > 0 THEN {rnd_sql(f'100.0 * {miss} / count(*)', 2)} ELSE 0.0 END AS missing_pct, "
            f"CAST(count(DISTINCT {c}) AS BIGINT) AS unique_count, count(DISTINCT {c}) <= 1 AS is_constant, "
            f"{mom}, {hc} AS high_cardinality FROM {src or table}")
    return "\nUNION ALL\n".join(parts)


def snake_sql(c: str) -> str:
    for pattern, put in SNAKE_STEPS:
        c = f"regexp_replace({c}, {q(pattern)}, {q(put)}, 'g')"
    return f"coalesce(NULLIF(lower({c}), ''), {q(EMPTY_NAME)})"


# Name variants of part.p_name shared by both engines (plain SQL functions that
# Spark and DuckDB evaluate identically on ASCII text).
NAME_VARIANTS = [
    "p_name",
    "replace(p_name, ' ', '_')",
    "upper(replace(p_name, ' ', '-'))",
    "concat(upper(substr(split_part(p_name, ' ', 1), 1, 1)), substr(split_part(p_name, ' ', 1), 2), "
    "upper(substr(split_part(p_name, ' ', 2), 1, 1)), substr(split_part(p_name, ' ', 2), 2))",
    "concat(replace(p_name, ' ', ''), 's')",
    "concat(split_part(p_name, ' ', 2), ' ', split_part(p_name, ' ', 1))",
    "concat(substr(p_name, 1, 3), substr(p_name, 5))",
    "concat('qq ', p_type)",
]
