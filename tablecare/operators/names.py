"""Name reconciliation (N1-N8) as a Spark job.

``reconcile_names(requested, known, mapping)`` resolves every requested name
against a table of known names with the ten-step cascade below; the lowest
step that hits wins, then the highest score, then the earliest known name.

====  ============================================================  =====================
step  rule                                                          plan
====  ============================================================  =====================
1     requested is a mapping key → mapped value                     equi-join
2     requested equals a known name                                 equi-join
3     snake_case(requested) equals a known name                     equi-join
4     lower, ' '/'-' → '_' equals lower(known)                      equi-join
5     lower/strip equals a mapping key or value → mapped value      equi-join (×2)
6     alphanumeric-only forms equal                                 equi-join
7     one alphanumeric form contains the other (both > 3 chars)     rarest-gram join
8     shared words / larger word count > .5 (best)                  prefix-filtered join
9     character-set Jaccard > .7, both > 5 chars (best)             trie join by group
10    fallback: snake_case if a mapping is given, else unchanged    projection
====  ============================================================  =====================

Every step gives at most one row per requested name, and the cascade passes
on only the names still unresolved, so the fuzzy steps see what the exact ones
left. Before a step joins, the known side is reduced to the earliest name per
key (per text form, word set or letter set), with a partial aggregate, so a
key that many known names share is one row.

Steps 7-9 are non-equi in nature. For containment the shorter form meets the
longer ones at its rarest run of four characters, and pairs that meet are
checked.
Step 8 compares *distinct* word sets by prefix filtering (tokens ordered
rarest-first globally; a pair that passes must share a token among the
``|A| - least overlap + 1`` rarest of both, the least overlap following from
both sizes, which are part of the join key). In step 9 letter sets are 36-bit
masks, dealt into groups by their most frequent letters and joined by walking
two tries with bounds on union and intersection. No cross join, no capped
candidate list.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import alnum_key, edge_trim, snake_case, words
from ..session import cut_lineage, ship

TIER_NAMES = {1: "mapping_exact", 2: "exact", 3: "snake_case", 4: "case_insensitive", 5: "mapping_case_insensitive",
              6: "alphanumeric", 7: "containment", 8: "word_overlap", 9: "char_jaccard", 10: "fallback"}


def _ci_key(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), " ", "_"), "-", "_")


def _earliest(known: DataFrame, key: Column) -> DataFrame:
    """(key, matched, kord): the earliest known name of every key."""
    return (known.select(key.alias("__k"), "name", "kord").groupBy("__k")
            .agg(F.min_by("name", "kord").alias("matched"), F.min("kord").alias("kord")))


def _resolved(df: DataFrame, tier: int) -> DataFrame:
    """Candidates (requested, matched, score, kord) to one row per requested name: the highest score, then the earliest."""
    best = F.min_by(F.struct("matched", "score", "kord"), F.struct((-F.col("score")).alias("s"), "kord")).alias("b")
    return df.groupBy("requested").agg(best).select(
        "requested", F.col("b.matched").alias("matched"), F.lit(tier).alias("tier"),
        F.col("b.score").cast("double").alias("score"), F.col("b.kord").alias("kord"))


def _equi(req: DataFrame, rkey: Column, known: DataFrame, kkey: Column, tier: int) -> DataFrame:
    hits = req.select("requested", rkey.alias("__k")).join(_earliest(known, kkey), "__k")
    return _resolved(hits.withColumn("score", F.lit(1.0)), tier)


#: Characters of a gram: the shortest form that containment looks at.
GRAM = 4


def _grams(form: Column) -> Column:
    """The distinct runs of ``GRAM`` characters of a form that has at least one."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(form) - (GRAM - 1)), lambda i: F.substring(form, i, GRAM)))


def _contained(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """(ik, ok): every form ``ik`` of ``inner`` with the forms ``ok`` of ``outer`` that hold it (or are it).

    All grams of ``ik`` stand in such an ``ok``, so it is enough to meet at the one that the fewest forms of
    ``outer`` hold: ``inner`` gives one row a form, ``outer`` one row a gram, and a pair that meets is checked."""
    held = outer.select("ok", F.explode(_grams(F.col("ok"))).alias("gram"))
    often = held.groupBy("gram").agg(F.count(F.lit(1)).alias("forms"))
    asked = inner.select("ik", F.explode(_grams(F.col("ik"))).alias("gram")).join(often, "gram", "left").withColumn("forms", F.coalesce("forms", F.lit(0)))
    rarest = asked.groupBy("ik").agg(F.min(F.struct("forms", "gram")).alias("r")).where(F.col("r.forms") > 0)
    return rarest.select("ik", F.col("r.gram").alias("gram")).join(held, "gram").where(F.contains("ok", "ik")).select("ik", "ok")


def containment_candidates(req: DataFrame, known: DataFrame) -> DataFrame:
    """Step 7: the earliest known name whose alphanumeric form contains, or is
    contained in, the requested one's (both longer than 3)."""
    r = req.select("requested", alnum_key(F.col("requested")).alias("rk")).where(F.length("rk") >= GRAM)
    k = _earliest(known, alnum_key(F.col("name"))).where(F.length("__k") >= GRAM)
    asked, names = r.select("rk").distinct(), k.select("__k")
    held = _contained(names.withColumnRenamed("__k", "ik"), asked.withColumnRenamed("rk", "ok")).select(F.col("ok").alias("rk"), F.col("ik").alias("__k"))
    within = _contained(asked.withColumnRenamed("rk", "ik"), names.withColumnRenamed("__k", "ok")).select(F.col("ik").alias("rk"), F.col("ok").alias("__k"))
    best = held.unionByName(within).join(k, "__k").groupBy("rk").agg(F.min_by("matched", "kord").alias("matched"), F.min("kord").alias("kord"))
    return _resolved(r.join(best, "rk").select("requested", "matched", "kord", F.lit(1.0).alias("score")), 7)


def _set_pairs(r: DataFrame, k: DataFrame, least: Callable[[Column, Column], Column], ratio: float) -> DataFrame:
    """(rid, kid) of sets that may pass: they share a token among the rarest
    ``size - least(size, partner's size) + 1`` of both, and their sizes lie
    within ``ratio`` of each other. ``r``: (rid, toks), ``k``: (kid, toks),
    both distinct."""
    df = (r.select(F.explode("toks").alias("tok")).unionAll(k.select(F.explode("toks").alias("tok")))
          .groupBy("tok").agg(F.count(F.lit(1)).alias("df")))

    def prefixes(side: DataFrame, id_col: str, mine: str, other: str) -> DataFrame:
        ranked = side.select(id_col, F.explode("toks").alias("tok")).join(df, "tok")
        g = ranked.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("df", "tok"))).alias("t"))
        g = g.withColumn(mine, F.size("t"))
        lo = F.ceil(F.col(mine) * ratio - F.lit(1e-9)).cast("int")
        hi = F.floor(F.col(mine) / ratio + F.lit(1e-9)).cast("int")
        g = g.withColumn(other, F.explode(F.sequence(F.greatest(lo, F.lit(1)), F.greatest(hi, F.lit(1)))))
        n = F.col(mine) - least(F.col(mine), F.col(other)) + 1
        return g.where(n > 0).select(id_col, mine, other, F.explode(F.slice("t", 1, n.cast("int"))).alias("x")).select(
            id_col, mine, other, F.col("x.tok").alias("tok"))
    rp, kp = prefixes(r, "rid", "rs", "ks"), prefixes(k, "kid", "ks", "rs")
    return rp.join(kp, ["tok", "rs", "ks"]).select("rid", "kid").distinct()


def word_overlap_candidates(req: DataFrame, known: DataFrame) -> DataFrame:
    """Step 8: best word-overlap score > .5 (exactly verified)."""
    r = req.select("requested", F.array_sort(words(F.col("requested"))).alias("rid"))
    k = _earliest(known, F.array_sort(words(F.col("name")))).withColumnRenamed("__k", "kid")
    least = lambda a, b: F.floor(F.greatest(a, b) * F.lit(0.5)) + 1  # noqa: E731  overlap > half of the larger
    pairs = _set_pairs(r.select("rid", F.col("rid").alias("toks")).distinct(), k.select("kid", F.col("kid").alias("toks")), least, 0.5)
    score = F.size(F.array_intersect("rid", "kid")) / F.greatest(F.size("rid"), F.size("kid"))
    hits = pairs.withColumn("score", score).where(F.col("score") > 0.5).join(k, "kid")
    return _resolved(r.join(hits, "rid").select("requested", "matched", "score", "kord"), 8)


_SYMBOLS = "abcdefghijklmnopqrstuvwxyz0123456789"


def _letters(key: Column) -> Column:
    return F.array_distinct(F.filter(F.split(key, ""), lambda x: x != ""))


def _mask(letters: Column) -> Column:
    """A bit per letter or digit that occurs."""
    return F.aggregate(letters, F.lit(0).cast("long"),
                       lambda acc, x: acc + F.element_at(F.array(*[F.lit(1 << i).cast("long") for i in range(36)]),
                                                         F.instr(F.lit(_SYMBOLS), x)))


def _letter_sets(df: DataFrame, name: str, id_col: str) -> DataFrame:
    key = alnum_key(F.col(name))
    return df.where(F.length(key) > 5).withColumn("toks", _letters(key)).withColumn(id_col, _mask(F.col("toks")))


#: Letters whose presence deals the known letter sets into groups: at most 2 to that power.
TOP_BITS = 8
#: Pairs of trie nodes looked at together.
NODE_PAIRS = 1 << 18


class LetterTrie:
    """A trie over masks of 36 bits, the first bit at its root. A node on level ``d`` is a prefix of ``d`` bits, with the
    least and greatest number of bits set below it. ``compared`` counts the whole sets that ``similar`` came to."""

    def __init__(self, masks):
        import numpy as np

        masks = np.unique(masks)
        size = np.bitwise_count(masks).astype(np.int64)
        self.prefix, self.least, self.most, self.first, self.compared = [], [], [], [], 0
        for d in range(37):
            head = masks >> np.uint64(36 - d)
            at = np.flatnonzero(np.concatenate(([True], head[1:] != head[:-1])))
            set_ = np.bitwise_count(head[at]).astype(np.int64)
            self.prefix.append(head[at])
            self.least.append(np.minimum.reduceat(size, at) - set_)
            self.most.append(np.maximum.reduceat(size, at) - set_)
            if d:   # where each parent's children begin
                parents = self.prefix[d] >> np.uint64(1)
                self.first.append(np.append(np.searchsorted(parents, self.prefix[d - 1]), len(parents)))

    def similar(self, other: LetterTrie):
        """(mask, other's mask) arrays of the pairs whose common bits are more than .7 of all theirs.

        Both tries are walked together. Two nodes can lead to such a pair only if the common bits of their prefixes and
        as many below as either allows outweigh the bits of both prefixes and at least as many below."""
        import numpy as np

        todo = [(0, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while todo:
            d, a, b = todo.pop()
            x, y = self.prefix[d][a], other.prefix[d][b]
            low, high = np.maximum(self.least[d][a], other.least[d][b]), np.minimum(self.most[d][a], other.most[d][b])
            common, all_ = np.bitwise_count(x & y) + high, np.bitwise_count(x | y) + np.maximum(low, high)
            ok = 10 * common.astype(np.int64) > 7 * all_.astype(np.int64)
            if d == 36:
                self.compared += len(a)
                if ok.any():
                    yield x[ok], y[ok]
                continue
            a, b = a[ok], b[ok]
            a0, a1, b0, b1 = self.first[d][a], self.first[d][a + 1], other.first[d][b], other.first[d][b + 1]
            pairs = [(p, q) for p in (0, 1) for q in (0, 1)]
            left = np.concatenate([a0[(a0 + p < a1) & (b0 + q < b1)] + p for p, q in pairs])
            right = np.concatenate([b0[(a0 + p < a1) & (b0 + q < b1)] + q for p, q in pairs])
            todo += [(d + 1, left[k:k + NODE_PAIRS], right[k:k + NODE_PAIRS]) for k in range(0, len(left), NODE_PAIRS)]


def _trie_join(batches):
    """(rid, kid) of one group after another, whose rows (top, asked, mask) come sorted by group."""
    import numpy as np
    import pyarrow as pa

    def join(rows):
        asked = np.concatenate([r[0] for r in rows])
        mask = np.concatenate([r[1] for r in rows]).astype(np.uint64)
        if asked.any() and not asked.all():
            for x, y in LetterTrie(mask[asked]).similar(LetterTrie(mask[~asked])):
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)), pa.array(y.astype(np.int64))], names=["rid", "kid"])
    held, at = [], None
    for b in batches:
        top, asked, mask = b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(top)) + 1).tolist(), len(top)]
        for i, j in zip(cuts, cuts[1:]):
            if i == j:
                continue
            if held and top[i] != at:
                yield from join(held)
                held = []
            at = top[i]
            held.append((asked[i:j], mask[i:j]))
    if held:
        yield from join(held)


def _by_frequency(masks: DataFrame) -> Callable[[Column], Column]:
    """Moves the bit of the most frequent letter of ``masks`` to the front, and so on; 36 counts come to the driver."""
    counts = masks.agg(*[F.sum(F.shiftright("mask", i).bitwiseAND(1)).alias(f"n{i}") for i in range(36)]).first()
    order = sorted(range(36), key=lambda i: -(counts[f"n{i}"] or 0))

    def moved(c: Column) -> Column:
        bits = [F.shiftleft(F.shiftright(c, i).bitwiseAND(F.lit(1).cast("long")), 35 - place) for place, i in enumerate(order)]
        return reduce(lambda a, b: a.bitwiseOR(b), bits)
    return moved


def _mask_pairs(asked: DataFrame, known: DataFrame) -> DataFrame:
    """(rid, kid): the distinct masks of ``asked`` and of ``known`` (both: mask) whose Jaccard similarity is over .7,
    as places of the bits ordered by frequency.

    The known masks are dealt by their first bits; an asked one goes to the groups whose bits and sizes allow the
    similarity, and each group is joined by walking two tries."""
    spark = known.sparkSession
    ship(spark)
    top, count = F.shiftright("mask", 36 - TOP_BITS), F.bit_count
    groups = known.groupBy(top.alias("top")).agg(F.min(count("mask")).alias("least"), F.max(count("mask")).alias("most")).collect()   # at most 256
    if not groups:
        return spark.createDataFrame([], "rid long, kid long")
    table = F.array(*[F.struct(F.lit(g["top"]).cast("long").alias("top"), F.lit(g["least"]).alias("least"), F.lit(g["most"]).alias("most")) for g in groups])

    def near(g: Column) -> Column:
        mine, all_ = count(top.bitwiseAND(g["top"])), count(top.bitwiseOR(g["top"]))
        below = count("mask") - count(top)
        low = F.greatest(below, g["least"] - count(g["top"]))
        high = F.least(below, g["most"] - count(g["top"]))
        return 10 * (mine + high) > 7 * (all_ + F.greatest(low, high))
    dealt = asked.select(F.explode(F.transform(F.filter(table, near), lambda g: g["top"])).alias("top"), F.lit(True).alias("asked"), "mask")
    rows = known.select(top.alias("top"), F.lit(False).alias("asked"), "mask").unionByName(dealt)
    return rows.repartition("top").sortWithinPartitions("top").mapInArrow(_trie_join, "rid long, kid long")


def char_jaccard_candidates(req: DataFrame, known: DataFrame) -> DataFrame:
    """Step 9: best character-set Jaccard > .7 over alphanumeric forms longer
    than five characters (exact, on the masks)."""
    r = _letter_sets(req, "requested", "rid")
    kn = _letter_sets(known, "name", "kid")
    k = _earliest(kn, F.col("kid"))
    moved = _by_frequency(k.select(F.col("__k").alias("mask")))
    k = k.withColumn("kid", moved(F.col("__k")))
    r = r.select("requested", moved(F.col("rid")).alias("rid"))
    pairs = _mask_pairs(r.select(F.col("rid").alias("mask")).distinct(), k.select(F.col("kid").alias("mask")))
    score = F.bit_count(F.expr("rid & kid")) / F.bit_count(F.expr("rid | kid"))
    hits = pairs.withColumn("score", score).where(F.col("score") > 0.7).join(k, "kid")
    return _resolved(r.join(hits, "rid").select("requested", "matched", "score", "kord"), 9)


def reconcile_names(requested: DataFrame, known: DataFrame, mapping: DataFrame | None = None,
                    requested_col: str = "requested", known_col: str = "name",
                    known_order: str | None = None) -> DataFrame:
    """Resolve each distinct requested name → (requested, matched, tier, score).

    ``known`` holds the known names (``known_order`` gives their order, else
    the name itself); ``mapping`` optionally holds (original, cleaned, pos).
    The unresolved names are checkpointed after the exact steps and after
    containment, so no step recomputes the ones before it."""
    req = (requested.select(F.col(requested_col).alias("requested")).where(F.col("requested").isNotNull()).distinct())
    kn = known.select(F.col(known_col).alias("name"),
                      (F.col(known_order) if known_order else F.col(known_col)).alias("kord")
                      ).where(F.col("name").isNotNull())
    req, kn = cut_lineage(req), cut_lineage(kn)
    kord_type = kn.schema["kord"].dataType.simpleString()
    exact = [
        _equi(req, F.col("requested"), kn, F.col("name"), 2),
        _equi(req, snake_case(F.col("requested")), kn, F.col("name"), 3),
        _equi(req, _ci_key(F.col("requested")), kn, F.lower(F.col("name")), 4),
        _equi(req, alnum_key(F.col("requested")), kn, alnum_key(F.col("name")), 6),
    ]
    if mapping is not None:
        m = mapping.select("original", "cleaned", F.col("pos").cast(kord_type).alias("kord"))
        to = m.select(F.col("cleaned").alias("name"), "kord", "original", "cleaned")
        low = lambda c: F.lower(edge_trim(F.col(c)))
        exact.append(_equi(req, F.col("requested"), to, F.col("original"), 1))
        either = to.select("name", "kord", F.explode(F.array(low("original"), low("cleaned"))).alias("form"))
        exact.append(_equi(req, low("requested"), either, F.col("form"), 5))
    found = cut_lineage(reduce(DataFrame.unionByName, exact).groupBy("requested")
                        .agg(F.min_by(F.struct("matched", "tier", "score"), "tier").alias("b")).select("requested", "b.*"))
    for step in (containment_candidates, word_overlap_candidates, char_jaccard_candidates):
        left = req.join(found.select("requested"), "requested", "left_anti")
        found = cut_lineage(found.unionByName(step(left, kn).select("requested", "matched", "tier", "score")))
    fallback = snake_case(F.col("requested")) if mapping is not None else F.col("requested")
    return (req.join(found, "requested", "left")
            .select("requested", F.coalesce("matched", fallback).alias("matched"),
                    F.coalesce("tier", F.lit(10)).cast("int").alias("tier"),
                    F.coalesce("score", F.lit(0.0)).alias("score")))
