"""A Merkle manifest of a table and the proof of every row against its root.

Leaves are digests of whole rows. Each group of rows (a language, say) has its own tree of runs of
``FAN`` consecutive nodes; the groups' roots, in order of the group, are the leaves of one more tree.
The levels are built bottom up, three at a time, and written as node rows, each with its children's
digests and a link to its parent. One recursive query then climbs from every leaf along those links: each step appends
one run's siblings to the leaf's proof and folds the leaf's digest, tampered or not, into the next
one up.

Positions come from a range sort with counts per partition, so that no group, however large, is
sorted or numbered by one task. Node rows near the root, which every leaf below them meets, are
repeated once per ``SHARE`` leaves and the leaves dealt over the repeats, so no join key is hot.

Defined cases: a null field is hashed as ``-``; a null group is a group and comes first; a null key
comes first in its group and is never tampered with; rows of equal key are ordered by their digest, so repeated
rows are leaves of their own; a lone row is its own root, with the empty proof; an empty table gives
no rows. Columns that are not hashed are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, small, written

#: Nodes in a run, and nodes whose three levels of runs are built together.
FAN, PAGE = 8, 512
#: Leaves that meet one copy of a node row.
SHARE = 512
#: The tree over the groups' roots, and the link of the root.
TOP, NONE = -1, -2
#: Levels of any tree of up to 2^63 leaves, twice.
DEEPEST = 50
ROW_LIMIT = "spark.sql.cteRecursionRowLimit"


def field(c: Column) -> Column:
    """A value as it is hashed: its UTF-8 byte count, a colon and itself, or ``-`` if null."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def row_digest(*fields: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*fields), 256))


def as_hex(digests: Column) -> Column:
    return F.lower(F.hex(digests))


def tampers(key: Column) -> Column:
    """Rows whose key, in decimal, has a CRC-32 that 3 divides."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 0, F.lit(False))


def leaves(docs: DataFrame, columns: list[str], key: str, group: str, text: str) -> DataFrame:
    """``grp``, ``key``, ``digest`` and ``changed``, the tampered row's digest (null: as it was)."""
    plain = {c: field(F.col(c)) for c in columns}
    tampered = {**plain, text: field(ascii_lower(F.col(text)))}
    return docs.select(F.col(group).cast("string").alias("grp"), F.col(key).alias("key"),
                       row_digest(*plain.values()).alias("digest"),
                       F.when(tampers(F.col(key)), row_digest(*tampered.values())).alias("changed"))


def in_order(leaf_rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The leaves, sorted and written by ranges of (group, key, digest), and the places of their groups.

    The first has each row's partition ``part`` and ``row``, which grows with the order. The second has,
    per group and partition, its first ``row`` there, the group's rows in earlier partitions (``start``), its
    ``size`` and its number ``tree``: counts per partition, summed up in order. Equal rows may take each
    other's place."""
    tied = leaf_rows.withColumn("tie", F.monotonically_increasing_id())
    by = [F.col(c).asc_nulls_first() for c in ("grp", "key", "digest", "tie")]
    placed = written(tied.repartitionByRange(*by).sortWithinPartitions(*by).drop("tie")
                     .withColumn("part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id()), "merkle-order")
    counts = placed.groupBy("grp", "part").agg(F.min("row").alias("first_row"), F.count(F.lit(1)).alias("rows"))
    earlier = Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = written(counts.select("grp", "part", "first_row", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("start"),
                                   F.sum("rows").over(Window.partitionBy("grp")).alias("size")), "merkle-starts")
    # groups are numbered by the partition they start in, then by their place there
    first = starts.where("start = 0")
    local = first.select(F.col("grp").alias("of_group"), "part", F.row_number().over(Window.partitionBy("part").orderBy("first_row")).alias("nth"))
    begun = first.groupBy(F.col("part").alias("in_part")).agg(F.count(F.lit(1)).alias("groups"))
    before = begun.select("in_part", F.coalesce(F.sum("groups").over(Window.orderBy("in_part").rowsBetween(   # one row a partition
        Window.unboundedPreceding, -1)), F.lit(0)).alias("groups_before"))
    trees = written(local.join(small(written(before, "merkle-before")), F.col("part") == F.col("in_part"))
                    .select("of_group", (F.col("groups_before") + F.col("nth") - 1).alias("tree")), "merkle-trees")
    places = starts.join(small(trees), F.col("grp").eqNullSafe(F.col("of_group"))).select(
        "of_group", F.col("part").alias("of_part"), "first_row", "start", "size", "tree")
    return placed, written(places, "merkle-places")


def pages(nodes: DataFrame, done: int) -> DataFrame:
    """Three levels over ``nodes`` (tree, size, n, idx, digest; ``n`` nodes on their level, which is ``done``).

    One row per ``PAGE`` nodes in a row: ``l1`` … ``l3`` hold the runs of each level as their children's
    digests, none where the tree has ended, and ``digest`` is the last one's."""
    child = F.struct("idx", "digest")
    page = (nodes.where("n > 1").groupBy("tree", "size", "n", F.expr(f"idx div {PAGE}").alias("page"))
            .agg(F.array_sort(F.collect_list(child)).alias("children"))   # at most PAGE
            .select("tree", "size", "n", "page", F.unhex(F.array_join(F.transform("children", lambda x: as_hex(x["digest"])), "")).alias("d0")))
    run = 32 * FAN
    for k in (1, 2, 3):
        open_ = F.expr(f"ceil(n / {FAN ** (k - 1)}) > 1")
        below = F.col(f"d{k - 1}")
        runs = F.expr(f"transform(sequence(0, cast(ceil(octet_length(d{k - 1}) / {run}) - 1 AS INT)), i -> substring(d{k - 1}, {run} * i + 1, {run}))")
        page = page.withColumn(f"l{k}", F.when(open_, runs).otherwise(F.array().cast("array<binary>")))
        hashed = F.unhex(F.array_join(F.transform(f"l{k}", lambda x: F.sha2(as_hex(x).cast("binary"), 256)), ""))
        page = page.withColumn(f"d{k}", F.when(open_, hashed).otherwise(below))
    return written(page.select("tree", "size", "page", F.expr(f"cast(ceil(n / {PAGE}) AS BIGINT)").alias("n"), "l1", "l2", "l3",
                               F.col("d3").alias("digest"), F.lit(done).alias("done")), "merkle-pages")


def build(nodes: DataFrame, most: int) -> list[DataFrame]:
    """All pages over ``nodes``, bottom up; ``most`` is the largest tree's number of nodes."""
    out = []
    while most > 1:
        out.append(pages(nodes, 3 * len(out)))
        nodes = out[-1].select("tree", "size", "n", F.col("page").alias("idx"), "digest")
        most = -(-most // PAGE)
    return out


def copies(level: Column, size: Column) -> Column:
    """Copies of a node row: one for ``SHARE`` of the leaves it can have below it."""
    return F.ceil(F.least(F.pow(F.lit(float(FAN)), level), size) / SHARE).cast("long")


@dataclass
class Forest:
    """Numbers that a link is computed from: all leaves and trees."""

    leaves: int
    trees: int

    def top_copies(self, level: Column) -> Column:
        """The same for the tree over the trees, where a node has ``FAN ** level`` trees of average size below it."""
        each = self.leaves / max(1, self.trees)
        return F.ceil(F.least(F.pow(F.lit(float(FAN)), level) * each, F.lit(float(self.leaves))) / SHARE).cast("long")

    def link(self, top: bool) -> list[Column]:
        """The place of the run that holds node (tree, level, idx): inside its tree, else in the tree over the trees."""
        root = F.expr(f"ceil(size / pow({FAN}, level)) <= 1")
        up = F.col("level") + 1
        inside = [F.col("tree"), up, F.expr(f"idx div {FAN}"), F.expr(f"idx % {FAN}"), self.top_copies(up) if top else copies(up, F.col("size"))]
        if top or self.trees <= 1:
            beyond = [F.lit(NONE), F.lit(0), F.lit(0), F.lit(0), F.lit(1)]
        else:
            beyond = [F.lit(TOP), F.lit(1), F.expr(f"tree div {FAN}"), F.expr(f"tree % {FAN}"), self.top_copies(F.lit(1))]
        return [F.when(root, b).otherwise(a).cast(t).alias(c) for a, b, (c, t) in zip(inside, beyond, LINK.items())]


#: The columns of a link, with their types.
LINK = {"to_tree": "long", "to_level": "int", "to_idx": "long", "slot": "int", "to_copies": "long"}


def node_rows(some: DataFrame, forest: Forest, top: bool) -> DataFrame:
    """(tree, level, idx, children, copies and the link) of the runs in pages."""
    def level(k: int) -> Column:
        return F.transform(f"l{k}", lambda x, j: F.struct((F.col("done") + k).alias("level"), (F.col("page") * FAN ** (3 - k) + j).alias("idx"), x.alias("children")))
    runs = F.concat(*[level(k) for k in (1, 2, 3)])
    nodes = some.select("tree", "size", F.inline(runs))
    held = forest.top_copies(F.col("level")) if top else copies(F.col("level"), F.col("size"))
    return nodes.select("tree", "level", "idx", "children", held.alias("copies"), *forest.link(top))


@dataclass
class Manifest:
    """``leaves`` (row, key, digest, changed, tree and the link), ``nodes`` (node_rows, written), ``subroots`` (tree, subroot) and
    the root's digest (None without rows)."""

    leaves: DataFrame
    nodes: DataFrame
    subroots: DataFrame
    root: bytes | None


def manifest(docs: DataFrame, columns: list[str], key: str, group: str, text: str) -> Manifest:
    placed, places = in_order(written(leaves(docs, columns, key, group, text), "merkle-leaves"))
    most, forest = 0, Forest(0, 0)
    got = places.where("start = 0").agg(F.max("size"), F.sum("size"), F.count(F.lit(1))).first()
    if got[2]:
        most, forest = got[0], Forest(got[1], got[2])
    rows = placed.join(small(places), F.col("grp").eqNullSafe(F.col("of_group")) & (F.col("part") == F.col("of_part"))).select(
        "row", "key", "digest", "changed", "tree", "size", (F.col("start") + F.col("row") - F.col("first_row")).alias("idx"))
    level0 = rows.withColumn("n", F.col("size"))
    inner = build(level0, most)
    # each group's root is a node of the tree over the groups
    ends = [level0.where("n = 1").select("tree", "digest"), *[x.where("n = 1").select("tree", "digest") for x in inner]]
    subroots = written(reduce(DataFrame.unionByName, ends), "merkle-subroots")
    above = subroots.select(F.lit(TOP).cast("long").alias("tree"), F.lit(forest.trees).cast("long").alias("size"),
                            F.lit(forest.trees).cast("long").alias("n"), F.col("tree").alias("idx"), "digest")
    top = build(above, forest.trees)
    root = (top[-1] if top else above).select("digest").first()   # of at most one row
    parts = [node_rows(x, forest, False) for x in inner] + [node_rows(x, forest, True) for x in top]
    if not parts:   # at most one leaf: no node above it
        parts = [level0.limit(0).select("tree", F.lit(0).alias("level"), "idx", F.col("digest").alias("children"), F.lit(1).cast("long").alias("copies"),
                                        *[F.lit(0).cast(t).alias(c) for c, t in LINK.items()])]
    nodes = written(reduce(DataFrame.unionByName, parts), "merkle-nodes")
    linked = rows.withColumn("level", F.lit(0)).select("row", "key", "digest", "changed", "tree", *forest.link(False))
    return Manifest(linked, nodes, subroots.withColumnRenamed("digest", "subroot"), root[0] if root else None)


CLIMB = f"""
WITH RECURSIVE climb (row, step, folded, to_tree, to_level, to_idx, slot, salt) MAX RECURSION LEVEL {DEEPEST} AS (
  SELECT row, 0, coalesce(changed, digest), to_tree, to_level, CASE WHEN to_tree = {NONE} THEN row ELSE to_idx END, slot, pmod(row, to_copies)
  FROM {{leaves}}
  UNION ALL
  SELECT c.row, c.step + 1,
         unhex(sha2(lower(hex(concat(substring(n.children, 1, 32 * c.slot), c.folded, substring(n.children, 32 * c.slot + 33)))), 256)),
         n.to_tree, n.to_level, CASE WHEN n.to_tree = {NONE} THEN c.row ELSE n.to_idx END, n.slot, pmod(c.row, n.to_copies)
  FROM climb c JOIN {{nodes}} n ON c.to_tree = n.tree AND c.to_level = n.level AND c.to_idx = n.idx AND c.salt = n.salt)
SELECT c.row, c.step, c.folded, concat(substring(n.children, 1, 32 * c.slot), substring(n.children, 32 * c.slot + 33)) AS siblings
FROM climb c LEFT JOIN {{nodes}} n ON c.to_tree = n.tree AND c.to_level = n.level AND c.to_idx = n.idx AND c.salt = n.salt
"""


def proofs(m: Manifest) -> DataFrame:
    """Per leaf: ``key``, ``tree``, ``digest``, the digest of its ``proof`` (the siblings as hex text, bottom up and left to
    right) and ``folded``, written.

    The recursive query gives a row per leaf and level; Spark's default limit on the rows of such a
    query is lifted while it runs."""
    spark = m.nodes.sparkSession
    dealt = m.nodes.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    before = spark.conf.get(ROW_LIMIT)
    spark.conf.set(ROW_LIMIT, "-1")
    try:
        steps = spark.sql(CLIMB, leaves=m.leaves, nodes=dealt)
        own = m.leaves.select("row", F.struct("key", "tree", "digest").alias("leaf"))
        both = steps.unionByName(own, allowMissingColumns=True)
        path = F.array_sort(F.collect_list(F.when(F.col("siblings").isNotNull(), F.struct("step", "siblings"))))   # one a level
        return written(both.groupBy("row").agg(
            F.first("leaf", ignorenulls=True).alias("leaf"), F.max_by("folded", "step").alias("folded"),
            F.array_join(F.transform(path, lambda x: as_hex(x["siblings"])), "").alias("proof"))
            .select("leaf.*", "folded", F.sha2("proof", 256).alias("proof_sha256")), "merkle-proofs")
    finally:
        spark.conf.set(ROW_LIMIT, before)


def verify(docs: DataFrame, columns: list[str], key: str = "doc_id", group: str = "lang", text: str = "text") -> DataFrame:
    """One row per leaf: its key, leaf, subroot and root, the digest of its proof, the root recomputed from
    the row after tampering, and whether that equals the root."""
    m = manifest(docs, columns, key, group, text)
    root = F.lit(m.root).cast("binary")
    subroots = m.subroots.withColumnRenamed("tree", "of_tree")
    return (proofs(m).join(small(subroots), F.col("tree") == F.col("of_tree"))
            .select(F.col("key").alias(key), as_hex(F.col("digest")).alias("leaf"), as_hex(F.col("subroot")).alias("subroot"),
                    as_hex(root).alias("root"), "proof_sha256", as_hex(F.col("folded")).alias("folded_root"),
                    (F.col("folded") == root).alias("verified")))


#: Levels of the SQL below: enough for 8^10 leaves.
SQL_LEVELS = 10


def verify_sql() -> str:
    """``verify`` of documents as DuckDB SQL."""
    def enc(c: str) -> str:
        return f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join([enc("doc_id"), enc("source"), enc("lang"), enc("n_chars"), enc(text)]) + ")"

    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    byte = "list_reduce(list_prepend(xor(c, b), range(8)), lambda v, i: xor(v >> 1, 3988292384 * (v & 1)))"
    crc = ("xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), "
           f"lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: {byte}))")
    ctes = [f"""base AS (SELECT doc_id, lang, {leaf('text')} AS leaf,
      CASE WHEN {crc} % 3 = 0 THEN {leaf(lower)} ELSE {leaf('text')} END AS tampered FROM documents)""",
            """placed AS (SELECT *, row_number() OVER (ORDER BY lang NULLS FIRST, doc_id NULLS FIRST, leaf) AS id,
      row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
      dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree FROM base)""",
            "a0 AS (SELECT tree, idx, leaf AS digest, count(*) OVER (PARTITION BY tree) AS n FROM placed)"]

    def level(name: str, k: int) -> str:
        return f"""{name}{k + 1} AS (SELECT tree, idx // {FAN} AS idx, CASE WHEN n > 1 THEN sha256(string_agg(digest, '' ORDER BY idx))
      ELSE max(digest) END AS digest, (n + {FAN - 1}) // {FAN} AS n FROM {name}{k} GROUP BY tree, idx // {FAN}, n)"""

    def step(name: str, k: int, before: str, key: str) -> str:
        """One level of the climb: siblings appended, the digest folded."""
        return f"""{before}{k + 1} AS (SELECT c.id, c.tree, c.idx // {FAN} AS idx, c.proof || coalesce(string_agg(s.digest, '' ORDER BY s.idx)
        FILTER (s.idx <> c.idx), '') AS proof, CASE WHEN max(s.n) > 1 THEN sha256(string_agg(CASE WHEN s.idx = c.idx THEN c.folded ELSE s.digest END,
        '' ORDER BY s.idx)) ELSE c.folded END AS folded
      FROM {before}{k} c JOIN {name}{k} s ON s.tree = {key} AND s.idx // {FAN} = c.idx // {FAN} GROUP BY c.id, c.tree, c.idx, c.proof, c.folded)"""

    ctes += [level("a", k) for k in range(SQL_LEVELS)]
    ctes.append(f"b0 AS (SELECT -1 AS tree, tree AS idx, digest, count(*) OVER () AS n FROM a{SQL_LEVELS})")
    ctes += [level("b", k) for k in range(SQL_LEVELS)]
    ctes.append("u0 AS (SELECT id, tree, idx, '' AS proof, tampered AS folded FROM placed)")
    ctes += [step("a", k, "u", "c.tree") for k in range(SQL_LEVELS)]
    ctes.append(f"v0 AS (SELECT id, -1 AS tree, tree AS idx, proof, folded FROM u{SQL_LEVELS})")
    ctes += [step("b", k, "v", "c.tree") for k in range(SQL_LEVELS)]
    return "WITH " + ",\n".join(ctes) + f"""
SELECT p.doc_id, p.leaf, s.digest AS subroot, r.digest AS root, sha256(v.proof) AS proof_sha256, v.folded AS folded_root,
  v.folded = r.digest AS verified
FROM placed p JOIN v{SQL_LEVELS} v USING (id) JOIN a{SQL_LEVELS} s ON s.tree = p.tree CROSS JOIN b{SQL_LEVELS} r"""
