"""Registered queries: name reconciliation.

Requested names: eight variants (plain, snake, upper-dashed, CamelCase,
squashed plural, swapped words, dropped letter, unrelated) of every part's
``p_name``; known names: the snake forms of the distinct part names;
mapping: upper-case name → snake name. The oracle resolves by brute force
(all pairs), which also checks that the blocked joins miss no pair.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import alnum_key, snake_case
from ..operators import names as N
from ..sources.tables import load_table
from .registry import query
from .sqlgen import NAME_VARIANTS, snake_sql


def _inputs(spark, sf):
    part = load_table(spark, sf, "part")
    req = part.select(F.explode(F.array(*[F.expr(v) for v in NAME_VARIANTS])).alias("requested"))
    known = part.select(F.regexp_replace("p_name", " ", "_").alias("name")).distinct()
    mapping = part.select(F.upper("p_name").alias("original"), F.regexp_replace("p_name", " ", "_").alias("cleaned")) \
        .distinct().withColumn("pos", F.col("original"))
    return req, known, mapping


def _distinct_req(req):
    return req.where(F.col("requested").isNotNull()).distinct()


def _known(known):
    return known.select("name", F.col("name").alias("kord"))


_REQ = "(SELECT DISTINCT unnest([" + ", ".join(NAME_VARIANTS) + "]) AS requested FROM part)"
_KN = "(SELECT DISTINCT replace(p_name, ' ', '_') AS name FROM part)"
_MP = "(SELECT DISTINCT upper(p_name) AS original, replace(p_name, ' ', '_') AS cleaned FROM part)"


def _alnum(x):
    return f"regexp_replace(lower({x}), '[^a-z0-9]', '', 'g')"


def _words(x):
    return (f"list_distinct(string_split_regex(lower(regexp_replace({x}, '([a-z])([A-Z])', '\\1 \\2', 'g')), "
            f"'[_\\s]+'))")


def _chars(x):
    return f"list_distinct(string_split({_alnum(x)}, ''))"


_TIERS = {
    2: f"SELECT r.requested, k.name AS matched, 1.0 AS score, k.name AS kord FROM {_REQ} r JOIN {_KN} k ON r.requested = k.name",
    3: f"SELECT r.requested, k.name AS matched, 1.0 AS score, k.name AS kord FROM {_REQ} r JOIN {_KN} k "
       f"ON {snake_sql('r.requested')} = k.name",
    4: f"SELECT r.requested, k.name AS matched, 1.0 AS score, k.name AS kord FROM {_REQ} r JOIN {_KN} k "
       f"ON replace(replace(lower(r.requested), ' ', '_'), '-', '_') = lower(k.name)",
    6: f"SELECT r.requested, k.name AS matched, 1.0 AS score, k.name AS kord FROM {_REQ} r JOIN {_KN} k "
       f"ON {_alnum('r.requested')} = {_alnum('k.name')}",
    7: f"SELECT r.requested, k.name AS matched, 1.0 AS score, k.name AS kord FROM {_REQ} r, {_KN} k "
       f"WHERE length({_alnum('r.requested')}) > 3 AND length({_alnum('k.name')}) > 3 AND "
       f"(contains({_alnum('r.requested')}, {_alnum('k.name')}) OR contains({_alnum('k.name')}, {_alnum('r.requested')}))",
    8: f"SELECT requested, matched, score, kord FROM (SELECT r.requested, k.name AS matched, k.name AS kord, "
       f"len(list_intersect({_words('r.requested')}, {_words('k.name')})) / "
       f"greatest(len({_words('r.requested')}), len({_words('k.name')})) AS score FROM {_REQ} r, {_KN} k) WHERE score > 0.5",
    9: f"SELECT requested, matched, score, kord FROM (SELECT r.requested, k.name AS matched, k.name AS kord, "
       f"len(list_intersect({_chars('r.requested')}, {_chars('k.name')})) / "
       f"len(list_distinct(list_concat({_chars('r.requested')}, {_chars('k.name')}))) AS score FROM {_REQ} r, {_KN} k "
       f"WHERE length({_alnum('r.requested')}) > 5 AND length({_alnum('k.name')}) > 5) WHERE score > 0.7",
}
_T1 = f"SELECT r.requested, m.cleaned AS matched, 1.0 AS score, m.original AS kord FROM {_REQ} r JOIN {_MP} m ON r.requested = m.original"
_T5 = (f"SELECT r.requested, m.cleaned AS matched, 1.0 AS score, m.original AS kord FROM {_REQ} r JOIN {_MP} m "
       f"ON lower(trim(r.requested)) = lower(trim(m.original)) OR lower(trim(r.requested)) = lower(trim(m.cleaned))")


def _pairs_sql(tier):
    return f"""SELECT requested, matched, CAST(score AS DOUBLE) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY requested ORDER BY score DESC, kord) AS rn FROM ({_TIERS[tier]})) WHERE rn = 1"""


def _pairs(spark, sf, tier):
    req, known, _ = _inputs(spark, sf)
    r, k = _distinct_req(req), _known(known)
    if tier == 2:
        c = N._equi(r, F.col("requested"), k, F.col("name"), 2)
    elif tier == 3:
        c = N._equi(r, snake_case(F.col("requested")), k, F.col("name"), 3)
    elif tier == 4:
        c = N._equi(r, N._ci_key(F.col("requested")), k, F.lower(F.col("name")), 4)
    elif tier == 6:
        c = N._equi(r, alnum_key(F.col("requested")), k, alnum_key(F.col("name")), 6)
    elif tier == 7:
        c = N.containment_candidates(r, k)
    elif tier == 8:
        c = N.word_overlap_candidates(r, k)
    else:
        c = N.char_jaccard_candidates(r, k)
    return c.select("requested", "matched", "score")


@query("name_exact", "N1", _pairs_sql(2))
def q_n_exact(spark, sf):
    return _pairs(spark, sf, 2)


@query("name_snake", "N2", _pairs_sql(3))
def q_n_snake(spark, sf):
    return _pairs(spark, sf, 3)


@query("name_case", "N3", _pairs_sql(4))
def q_n_case(spark, sf):
    return _pairs(spark, sf, 4)


@query("name_alnum", "N4", _pairs_sql(6))
def q_n_alnum(spark, sf):
    return _pairs(spark, sf, 6)


@query("name_contains", "N5", _pairs_sql(7))
def q_n_contains(spark, sf):
    return _pairs(spark, sf, 7)


@query("name_words", "N6", _pairs_sql(8))
def q_n_words(spark, sf):
    return _pairs(spark, sf, 8)


@query("name_jaccard", "N7", _pairs_sql(9))
def q_n_jaccard(spark, sf):
    return _pairs(spark, sf, 9)


def _reconcile_sql():
    parts = [f"SELECT requested, matched, 1 AS tier, score, kord FROM ({_T1})",
             f"SELECT requested, matched, 5 AS tier, score, kord FROM ({_T5})"]
    parts += [f"SELECT requested, matched, {t} AS tier, score, kord FROM ({s})" for t, s in _TIERS.items()]
    cands = " UNION ALL ".join(parts)
    return f"""WITH c AS ({cands}),
best AS (SELECT requested, matched, tier, score FROM (
  SELECT *, row_number() OVER (PARTITION BY requested ORDER BY tier, score DESC, kord) AS rn FROM c) WHERE rn = 1)
SELECT r.requested, coalesce(b.matched, {snake_sql('r.requested')}) AS matched,
  CAST(coalesce(b.tier, 10) AS INTEGER) AS tier, CAST(coalesce(b.score, 0.0) AS DOUBLE) AS score
FROM {_REQ} r LEFT JOIN best b ON r.requested = b.requested"""


@query("reconcile_names", "N1-N8 cascade", _reconcile_sql())
def q_reconcile(spark, sf):
    req, known, mapping = _inputs(spark, sf)
    return N.reconcile_names(req, known, mapping)
