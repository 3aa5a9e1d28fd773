"""Mixing sources to target weights.

Each source gets a token budget by its weight; no budget exceeds ``max_epochs`` times the
source's size, and what is cut off is shared among the others by weight. Every row is taken
``floor(budget / size)`` whole times; what remains of the budget is filled by Efraimidis-
Spirakis sampling without replacement: row keys ``-ln(u) / weight`` with a uniform ``u`` hashed
from the row, taken in ascending order while the running size stays nearest to the budget.

The running sums are never laid out over a source's rows. A row's place is a 62-bit code
(31 bits of the key's uniform transform, then 31 bits that order equal keys), and the cut of
each source is found digit by digit: every pass sums sizes per (source, digit) of the rows that
still share the cut's leading digits, so no task sees more than 65,536 sums of a source however
large or repetitive the source is.

Defined results: a null source is a source, ordered last; a null text has size 0 and is taken
0 words; an empty table gives an empty result; equal rows share a key and are told apart by
their place in the input, so reruns over the same files agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import parted, passing, small, word_count, written

DIGITS = [16, 16, 15, 15]
BITS = 31


def sampling_hash(*identity: Column) -> Column:
    """53 bits from which a row's place is taken; equal rows share them."""
    return F.shiftrightunsigned(F.xxhash64(*identity, F.lit(20_011)), 11)


def tie_hash() -> Column:
    """31 bits that order equal keys, by the row's place in the input."""
    return F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 64 - BITS)


def sampling_code(weight: Column, hashed: Column, tie: Column) -> Column:
    """62-bit place of a row in the weighted random order, from its ``sampling_hash`` and ``tie_hash``."""
    u = (hashed + 1).cast("double") / float(2 ** 53)
    p = -F.expm1(F.log(u) / weight)  # uniform transform of the exponential key; grows with it
    high = F.least(F.floor(p * float(2 ** BITS)), F.lit(2 ** BITS - 1)).cast("long")
    return F.shiftleft(high, BITS) + tie


def source_targets(sizes: DataFrame, weights: list[float], max_epochs: float) -> DataFrame:
    """(source, source_size) to budgets: ``target``, whole ``epochs`` and the ``rest``.

    Works on one row per source. With the sources ordered by cap over weight, the common level
    is found where the caps before it and the weights after it use up the total."""
    by_name = Window.orderBy(F.col("source").isNull(), F.encode(F.col("source"), "UTF-8"))
    place = (F.row_number().over(by_name) - 1) % len(weights)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (place + 1).cast("int"))
    rows = sizes.select("source", "source_size", w.alias("w"), (F.col("source_size") * float(max_epochs)).alias("cap"))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), "source")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy()
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(onward)
    rows = rows.withColumn("level", level).withColumn(
        "level", F.min(F.when(F.col("cap") >= F.col("w") * F.col("level"), F.struct(F.col("cap") / F.col("w"), "level"))).over(whole)["level"])
    target = F.least(F.col("cap"), F.coalesce(F.col("w") * F.col("level"), F.col("cap")))
    rows = rows.select("source", "source_size", target.alias("target"))
    epochs = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")),
                                                      F.lit(int(max_epochs)))).otherwise(0).cast("long")
    return rows.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))


def find_cuts(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """``targets`` with ``cut``: rows whose code is at most it fill the rest of the budget."""
    state = targets.withColumn("prefix", F.lit(0).cast("long")).withColumn("before", F.lit(0.0))
    left = sum(DIGITS)
    for k, digit in enumerate(DIGITS):
        mine = small(state.select(F.col("source").alias("_s"), "prefix", "rest", "before"))
        inside = sized.join(mine, F.col("source").eqNullSafe(F.col("_s"))
                            & (F.shiftrightunsigned("code", left) == F.col("prefix")))
        left -= digit
        sums = (inside.groupBy("source", F.shiftrightunsigned("code", left).alias("next"))
                .agg(F.sum("size").cast("double").alias("sum"), F.first("rest").alias("rest"), F.first("before").alias("base")))
        w = Window.partitionBy("source").orderBy("next").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumn("from", F.col("base") + F.coalesce(F.sum("sum").over(w), F.lit(0.0)))
        over = F.col("from") + F.col("sum") > F.col("rest")
        last = sums.groupBy("source").agg(
            F.min(F.when(over, F.struct("next", "from", "sum"))).alias("at"), F.max("next").alias("end"),
            F.max(F.struct("next", "from")).alias("tail"))
        here = F.coalesce(F.col("at.next"), F.col("tail.next"))
        step = last.select(F.col("source").alias("_s"), here.alias("_prefix"),
                           F.coalesce(F.col("at.from"), F.col("tail.from")).alias("_before"), F.col("at.sum").alias("_sum"))
        state = state.join(step, F.col("source").eqNullSafe(F.col("_s")), "left").select(
            *targets.columns, F.coalesce("_prefix", F.lit(-1)).alias("prefix"), F.coalesce("_before", F.lit(0.0)).alias("before"),
            *([] if left else ["_sum"]))
        state = written(state, f"mix-cut-{k}")
    crossing_fits = F.col("_sum").isNull() | (F.col("before") + F.col("_sum") / 2 <= F.col("rest"))
    return state.select(*targets.columns, F.when(crossing_fits, F.col("prefix")).otherwise(F.col("prefix") - 1).alias("cut"))


def plan_mix(sized: DataFrame, weights: list[float], max_epochs: float) -> DataFrame:
    """Per source: size, target, epochs, rest and cut."""
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    return find_cuts(sized, written(source_targets(sizes, weights, max_epochs), "mix-targets"))


def copies(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """``sized`` with the plan's columns of its source and ``copies``, the times a row is taken."""
    p = small(plan.select(F.col("source").alias("_s"), "source_size", "target", "epochs", "cut"))
    return (sized.join(p, F.col("source").eqNullSafe(F.col("_s")))
            .withColumn("copies", F.col("epochs") + ((F.col("code") <= F.col("cut")) & (F.col("epochs") < F.lit(2 ** 31))).cast("long")))


def weights_of(labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """``_k`` and ``_q``, the mean quality of the labelled keys."""
    return labels.where(F.col("quality").isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.avg("quality").alias("_q"))


def quality_weights(docs: DataFrame, means: DataFrame, key: str = "doc_id") -> DataFrame:
    """``docs`` with ``_weight``: 2 for labelled good, 0.5 for labelled bad, 1 without a label."""
    weight = F.coalesce(F.lit(0.5) + 1.5 * F.col("_q"), F.lit(1.0))
    return docs.join(means, docs[key] == F.col("_k"), "left").withColumn("_weight", weight).drop("_k", "_q")


def mix(docs: DataFrame, labels: DataFrame, weights: list[float] = (1.0, 2.0, 3.0), max_epochs: float = 3.0,
        text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document: key, source, size, source_size, target and taken words.

    The weights repeat over the sources in code point order, the null source last."""
    sized = docs.select(key, "source", word_count(F.col(text)).alias("size"), F.xxhash64(F.col(key), F.col(text)).alias("_u"))
    weighted = quality_weights(sized, weights_of(labels, key), key)
    code = sampling_code(F.col("_weight"), sampling_hash(F.col("_u")), tie_hash())
    sized = written(weighted.select(key, "source", "size", code.alias("code")), "mix-sized")
    return copies(sized, plan_mix(sized, list(weights), max_epochs)).select(
        key, "source", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mix_rows(docs: DataFrame, weights: list[float] = (1.0, 2.0, 3.0), max_epochs: float = 3.0,
             text: str = "text", key: str = "doc_id", labels: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it (rows of size 0: as their source's
    whole epochs say, so never fewer than once if the source is taken whole).

    Rows weigh as their labels say, and the same without ``labels``. They are written once with
    their size and hashes, so that the sizes and the choice are of the same codes. The choice is made
    without the texts; of these, only rows that may be chosen otherwise than if no row had a label
    are shuffled."""
    code = sampling_code(F.lit(1.0), sampling_hash(F.col(key), F.col(text)), tie_hash())
    full = written(docs.select(F.struct(*docs.columns).alias("_row"), F.col("source").alias("source"), word_count(F.col(text)).alias("size"),
                               sampling_hash(F.col(key), F.col(text)).alias("_u"), code.alias("code"),
                               F.monotonically_increasing_id().alias("row_id")), "mix-rows")
    if labels is None:
        chosen = copies(full, plan_mix(full.drop("_row"), list(weights), max_epochs))
    else:
        with passing(docs.sparkSession):
            narrow = full.select(F.col("_row")[key].alias("_key"), "source", "size", "_u", F.col("code").alias("_plain"), "row_id")
            weighted = quality_weights(narrow, small(written(weights_of(labels, key), "mix-labels")), "_key")
            code = sampling_code(F.col("_weight"), F.col("_u"), F.col("_plain").bitwiseAND(F.lit((1 << BITS) - 1)))
            sized = written(weighted.select("source", "size", code.alias("code"), "_plain", "row_id"), "mix-sized")
            plan = written(plan_mix(sized, list(weights), max_epochs), "mix-plan", stays=True)
            other = copies(sized, plan).where((F.col("code") <= F.col("cut")) != (F.col("_plain") <= F.col("cut")))
            other = written(other.select("row_id", F.col("copies").alias("_copies")), "mix-other", stays=True)
        sure, unsure = parted(full, other, "row_id")
        unsure = copies(unsure, plan).join(small(other), "row_id", "left").select("_row", F.coalesce("_copies", "copies").alias("copies"))
        chosen = copies(sure, plan).select("_row", "copies").unionByName(unsure)
    return (chosen.where("copies > 0").select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
            .select("_row.*"))
