"""Quality rules with risk-controlled cutoffs.

Per text a few statistics are counted over the whole text. Each rule rejects a text
whose statistic exceeds a cutoff. Cutoffs are chosen per stratum from a fixed grid:
labelled good texts are the holdout, and a cutoff is admissible only if the exact
(Clopper-Pearson) upper confidence bound of its false-rejection rate stays below
``alpha`` divided by the number of rules. The grid is walked from the loosest cutoff
and the walk ends at the first that fails (fixed-sequence testing, which needs no
correction along the grid); the level ``delta`` is split by Bonferroni over strata and
rules. So with probability ``1 - delta``, in every stratum at once, the rules together
reject at most ``alpha`` of good texts. Among admissible cutoffs, the one that rejects
most labelled bad texts, less ``good_cost`` times its good ones, is taken; a rule without
an admissible cutoff that helps is off in that stratum.

Defined results: a null or empty text has no words and fails the base rule; a null
stratum is a stratum of its own; labels with null quality, and labels without a document,
count nowhere; repeated labels of one document count by their mean (at least 0.5 is good);
without labels, or with too few, all rules are off. Repeated rows are judged one by one.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, passing, small, texts, written

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
UPPER = bytes(range(65, 91))
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper"]
#: Largest number of words whose number is kept between texts in a task.
VOCABULARY = 300_000

#: Cutoffs tried, from the loosest on; a text is rejected if its statistic is larger.
GRID: dict[str, list[float]] = {
    "symbol_ratio": [1.0, 0.7, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.08, 0.06, 0.04, 0.03, 0.02, 0.01],
    "dup_line_share": [0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1, 0.05],
    "upper_share": [0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1],
    "mean_word_length": [30.0, 25.0, 20.0, 18.0, 16.0, 14.0, 13.0, 12.0, 11.0, 10.0, 9.0, 8.0, 7.5, 7.0],
    "word_shortness": [1.0, 0.5, 0.4, 1 / 3, 0.3, 0.28, 0.26, 0.25, 0.24, 0.23, 0.22, 0.21, 0.2],
}


def count_text(text: str, ids: dict[bytes, int]) -> tuple[int, ...]:
    """The counts named in COUNTS, of one whole text."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    if not n:
        return (0,) * len(COUNTS)
    n_symbols = sum(text.count(c) for c in SYMBOLS)
    word_chars = len(text) - sum(text.count(c) for c in SPACES)
    lines = [x for x in data.split(b"\n") if x.strip()]
    repeats = 0
    if n >= 6:
        w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.uint64, n)
        repeats = _repeated(w)
    return (n, word_chars, n_symbols, len(lines) - len(set(lines)), repeats, len(lines),
            len(data) - len(data.translate(None, UPPER)))


def _repeated(w: np.ndarray) -> int:
    """Words inside 5-word windows that occur twice or more, the first included."""
    n = len(w)
    h = w[:-4].copy()
    for k in range(1, 5):
        h ^= h >> np.uint64(29)
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += w[k:n - 4 + k]
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(h), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for k in range(5):
        covered[k:n - 4 + k] |= twice
    return int(covered.sum())


def quality_counts(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``df`` with the columns of COUNTS (long) and ``base_failed``."""
    def make():
        ids: dict[bytes, int] = {}

        def f(batch):
            rows = []
            for part in texts(batch, text):
                if len(ids) > VOCABULARY:
                    ids.clear()
                rows += [count_text(x, ids) for x in part]
            return [list(c) for c in zip(*rows, strict=True)] if rows else [[] for _ in COUNTS]
        return f

    out = arrow_map(df, [T.StructField(c, T.LongType()) for c in COUNTS], make, keep)
    return out.withColumn("base_failed", (F.col("n_words") < 10)
                          | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def statistics() -> dict[str, Column]:
    """The statistic of every rule in GRID; larger is worse."""
    chars = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return {
        "symbol_ratio": F.col("n_symbols") / chars,
        "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)).cast("double"),
        "upper_share": F.col("n_upper") / chars,
        "mean_word_length": F.col("word_chars") / words,
        "word_shortness": words / chars,
    }


def upper_bound(k: int, n: int, delta: float) -> float:
    """Clopper-Pearson: the largest rate under which at most ``k`` of ``n`` has probability ``delta``."""
    if n <= 0 or k >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) for i in range(k + 1)]
    lo, hi = k / n, 1.0
    for _ in range(60):
        p = (lo + hi) / 2
        if p >= 1.0:
            break
        a, b = math.log(p), math.log1p(-p)
        tail = math.fsum(math.exp(c + i * a + (n - i) * b) for i, c in enumerate(logs))
        lo, hi = (p, hi) if tail > delta else (lo, p)
    return hi


def choose(good: np.ndarray, bad: np.ndarray, grid: list[float], alpha: float, delta: float,
           good_cost: float) -> float | None:
    """The cutoff of one rule in one stratum; ``good[i]`` texts exceed exactly ``i`` cutoffs of the grid,
    which are its ``i`` strictest."""
    n = int(good.sum())
    over_good, over_bad = good[::-1].cumsum(), bad[::-1].cumsum()  # place i: texts over the grid's i-th cutoff
    best, gain = None, 0.0
    for i, cut in enumerate(grid):
        k = int(over_good[i])
        if k > alpha * n or upper_bound(k, n, delta) > alpha:
            break
        g = float(over_bad[i]) - good_cost * k
        if g > gain:
            best, gain = cut, g
    return best


def fit_cutoffs(counts: DataFrame, labels: DataFrame, stratum: str = "lang", key: str = "doc_id", *,
                alpha: float = 0.05, delta: float = 0.05, good_cost: float = 5.0) -> DataFrame:
    """One row per stratum with labelled texts: ``stratum`` and a cutoff per rule (null: off).

    Only counts per (stratum, rule, grid cell) leave the executors' aggregation."""
    quality = (labels.where(F.col("quality").isNotNull() & F.col(key).isNotNull())
               .groupBy(F.col(key).alias("_key")).agg((F.avg("quality") >= 0.5).alias("_good")))
    stats = statistics()
    cells = F.array(*[F.struct(F.lit(r).alias("rule"), sum((stats[r] > c).cast("int") for c in g).alias("cell"))
                      for r, g in GRID.items()])
    rows = counts.where(~F.col("base_failed")).select(F.col(key).alias("_key"), F.col(stratum).cast("string").alias("stratum"),
                                                      F.inline(cells))
    hist = written(rows.join(quality, "_key").groupBy("stratum", "rule", "cell").agg(
        F.sum(F.col("_good").cast("long")).alias("good"), F.sum((~F.col("_good")).cast("long")).alias("bad")), "quality-cells")
    strata = max(1, hist.select("stratum").distinct().count())
    level, share = delta / (strata * len(GRID)), alpha / len(GRID)

    def per_stratum(pdf: pd.DataFrame) -> pd.DataFrame:
        out = {"stratum": pdf["stratum"].iloc[0]}
        for r, g in GRID.items():
            counted = np.zeros((2, len(g) + 1), np.int64)
            mine = pdf[pdf["rule"] == r]
            counted[0, mine["cell"]], counted[1, mine["cell"]] = mine["good"], mine["bad"]
            out[r] = choose(counted[0], counted[1], g, share, level, good_cost)
        return pd.DataFrame([out]).astype({r: "float64" for r in GRID})

    schema = "stratum string, " + ", ".join(f"{r} double" for r in GRID)
    return written(hist.groupBy("stratum").applyInPandas(per_stratum, schema), "quality-cutoffs", stays=True)


def apply_cutoffs(counts: DataFrame, cutoffs: DataFrame, stratum: str = "lang") -> DataFrame:
    """``counts`` with ``kept``: not failed by the base rule nor by a rule that is on in its stratum."""
    cut = small(cutoffs.select(F.col("stratum").alias("_stratum"), F.struct(*GRID).alias("_cut")))
    stats = statistics()
    over = [F.coalesce(~F.isnan(F.col(f"_cut.{r}")) & (stats[r] > F.col(f"_cut.{r}")), F.lit(False)) for r in GRID]
    rejected = over[0]
    for o in over[1:]:
        rejected = rejected | o
    return (counts.join(cut, F.col(stratum).cast("string").eqNullSafe(F.col("_stratum")), "left")
            .withColumn("kept", ~F.col("base_failed") & ~rejected).drop("_stratum", "_cut"))


def judge(docs: DataFrame, labels: DataFrame, text: str = "text", stratum: str = "lang", key: str = "doc_id",
          **risk) -> DataFrame:
    """Counts, ``base_failed`` and ``kept`` of every row, without the texts."""
    counts = written(quality_counts(docs.select(key, stratum, text), text, [key, stratum]), "quality-counts")
    return apply_cutoffs(counts, fit_cutoffs(counts, labels, stratum, key, **risk), stratum)


def keep_good(docs: DataFrame, labels: DataFrame, text: str = "text", stratum: str = "lang", key: str = "doc_id",
              **risk) -> DataFrame:
    """The rows that the rules keep, with the columns of ``docs``.

    The cutoffs are fitted from a table of counts; the texts pass once more with their
    counts, so they are neither shuffled nor joined by id."""
    with passing(docs.sparkSession):
        counts = written(quality_counts(docs.select(key, stratum, text), text, [key, stratum]), "quality-counts")
        cutoffs = fit_cutoffs(counts, labels, stratum, key, **risk)
    packed = docs.select(F.struct(*docs.columns).alias("_row"), F.col(text).alias("_text"), F.col(stratum).alias(stratum))
    judged = apply_cutoffs(quality_counts(packed, "_text", ["_row", stratum]), cutoffs, stratum)
    return judged.where("kept").select("_row.*")
