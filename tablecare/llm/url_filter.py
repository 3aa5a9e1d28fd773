"""URL filter: allow and block rules, then host word segmentation and naive Bayes.

A url's host and path are matched against rules; a rule fits a host and its subdomains if the
path starts with the rule's path, and the longest fitting rule decides. Other urls are judged by a
model: names in the host and path are cut into words by a unigram Viterbi segmentation, and a
multinomial naive Bayes model scores the words.

Both models are counted over all urls. A letter run between delimiters counts as a word once per
further site that has it, however many pages that has, and not as a site's own name: a joined name
does not vouch for itself, nor do seeds joined to each other. Training labels are weak: a url with
a word of ``SEEDS`` after segmentation counts as unwanted, and its words, the seeds among them,
teach what stands around them, joined or not. Counts are kept by
a hash of the word in two tables of fixed size (the smaller of the two is taken), so what is sent
to the driver and the executors does not grow with the number of words.

Defined results: a null url, or one without ``://``, has an empty host and path and is judged by
the model, which allows a url without words; ties between rules of one length go to the first in
code point order; scores at the threshold allow.
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, ascii_lower, texts, written

#: Slots of each count table.
SLOTS = 1 << 18
#: Added to every count of the classifier.
SMOOTHING = 0.1
#: Longest word the segmentation forms.
LONGEST = 24
#: Hosts and names whose words a worker keeps.
KEPT = 100_000
#: Words known from the table, at most; those of most sites. A quarter of the slots, so that few names not among them look known.
KNOWN = SLOTS // 4
#: Letters an unseen piece is taken to have at least, so that no seed is cut out of a word and leaves a remainder that is none.
UNSEEN = 6
#: Words of unwanted urls (gambling, pills, adult, trackers, link farms, scams).
SEEDS = (
    "ads", "adserver", "adult", "affiliate", "banner", "bet", "bets", "betting", "bingo", "bonus", "casino", "cheap", "cialis", "clickbait",
    "coupon", "crack", "dating", "deals", "doorway", "escort", "farm", "forex", "free", "gambling", "jackpot", "keygen", "linkfarm", "loan",
    "loans", "lottery", "malware", "payday", "phishing", "pills", "poker", "popup", "porn", "prize", "replica", "roulette", "sex", "slots",
    "spam", "torrent", "track", "tracker", "tracking", "viagra", "warez", "win", "winner", "xxx",
)
_LETTERS = re.compile(r"[^\W\d_]+")
_JOINED_SEEDS = re.compile(f"(?:{'|'.join(SEEDS)}){{2,}}")


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path columns."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return ascii_lower(host), path


def rule_column(rules: list[tuple[str, str]]) -> Column:
    """(rule, verdict) of the longest rule that fits the columns host and path; null if none."""
    out = None
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), [-ord(c) for c in r[1]])):
        host, slash, path = rule.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(slash + path)
        hit = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, hit) if out is None else F.when(fits, hit).otherwise(out)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def _slots(word: str) -> tuple[int, int]:
    h = zlib.crc32(word.encode())
    return h % SLOTS, SLOTS + (h // SLOTS * 2654435761 + h * 40503) % SLOTS


class Words:
    """Unigram Viterbi segmentation with hashed counts."""

    def __init__(self, counts: np.ndarray):
        self.counts, self.kept = counts, {}
        seen = float(counts[:SLOTS].sum())
        self.prior = max(10.0, 1e-5 * seen)  # of a seed
        self.total = seen + self.prior * len(SEEDS)
        self.seeds = frozenset(SEEDS)

    def log_probability(self, word: str) -> float:
        n = float(min(self.counts[s] for s in _slots(word))) if len(word) > 1 else 0.0
        if word in self.seeds:
            n += self.prior
        elif n <= 0 or _JOINED_SEEDS.fullmatch(word):
            return math.log(1.0 / self.total) - 2.3 * max(len(word), UNSEEN)  # unseen: rarer the longer
        return math.log(n / self.total)

    def split(self, name: str) -> list[str]:
        if name not in self.kept:
            if len(self.kept) > KEPT:
                self.kept.clear()
            self.kept[name] = self._viterbi(name)
        return self.kept[name]

    def _viterbi(self, name: str) -> list[str]:
        best, back = [0.0] + [-math.inf] * len(name), [0] * (len(name) + 1)
        for end in range(1, len(name) + 1):
            for start in range(max(0, end - LONGEST), end):
                s = best[start] + self.log_probability(name[start:end])
                if s > best[end]:
                    best[end], back[end] = s, start
        out, end = [], len(name)
        while end:
            out.append(name[back[end]:end])
            end = back[end]
        return out[::-1]


def names_of(host: str, path: str) -> list[str]:
    """Letter runs of a host and a path, lower-cased."""
    return _LETTERS.findall(f"{host} {path}".lower())


def site_of(host: str) -> tuple[str, str]:
    """The registered name a host ends in, and its first label, the site's own name."""
    labels = host.rpartition("@")[2].partition(":")[0].strip(".").split(".")
    n = 3 if len(labels) > 2 and len(labels[-1]) == 2 and len(labels[-2]) <= 3 else 2
    return ".".join(labels[-n:]), labels[-n:][0] if len(labels) > 1 else ""


def vouched(host: str, path: str) -> tuple[str, set[str]]:
    """The site, and the names of a url that count as words of it: all but a site's own name in one run."""
    site, own = site_of(host)
    names = names_of(host, path)
    if len(mine := names_of(own, "")) == 1 and mine[0] in names:
        names.remove(mine[0])
    return site, set(names)


def _unigrams(urls: DataFrame) -> np.ndarray:
    """Per slot, how many sites have a word besides the first; of the KNOWN most widespread words."""
    fields = [T.StructField("seen", T.ArrayType(T.StructType([T.StructField("word", T.LongType()), T.StructField("site", T.LongType())])))]

    def make():
        def f(batch):
            hosts, paths = ([x for p in texts(batch, c) for x in p] for c in ("host", "path"))
            seen = set()
            for h, p in zip(hosts, paths, strict=True):
                site, names = vouched(h, p)
                at = xxhash.xxh3_64_intdigest(site.encode()) >> 1
                seen.update((zlib.crc32(w.encode()), at) for w in names)
            rows = [{"word": w, "site": at} for w, at in seen]
            return [[rows] + [None] * (batch.num_rows - 1) if batch.num_rows else []]
        return f

    sites = arrow_map(urls, fields, make, []).select(F.inline("seen")).distinct()
    words = written(sites.groupBy("word").agg((F.count(F.lit(1)) - 1).alias("n")).where("n > 0"), "url-words")
    size = F.floor(8 * F.log2("n"))
    least, left = 0, KNOWN
    for r in sorted(words.groupBy(size.alias("size")).count().collect(), reverse=True):
        left -= r["count"]
        if left < 0:
            least = r["size"] + 1
            break
    first = F.pmod("word", F.lit(SLOTS))
    second = SLOTS + F.pmod(F.floor(F.col("word") / SLOTS) * 2654435761 + F.col("word") * 40503, F.lit(SLOTS))
    slots = words.where(size >= least).select("n", F.explode(F.array(first, second)).alias("slot"))
    return _collect(slots.groupBy("slot").agg(F.sum("n").alias("n0")), 1)[0]


def _collect(counted: DataFrame, columns: int) -> np.ndarray:
    """(slot, n...) rows, at most 2 x SLOTS, as arrays."""
    out = np.zeros((columns, 2 * SLOTS), np.int64)
    rows = counted.toPandas()
    for c in range(columns):
        out[c, rows["slot"]] = rows[f"n{c}"]
    return out


def _count_slots(urls: DataFrame, words_of, columns: int) -> np.ndarray:
    """Sum over all urls of ``words_of(host, path) -> (column, words)``, per slot."""
    fields = [T.StructField("counts", T.ArrayType(T.StructType([T.StructField("slot", T.IntegerType()), T.StructField("c", T.IntegerType()),
                                                               T.StructField("n", T.LongType())])))]

    def make():
        count = words_of()

        def f(batch):
            hosts, paths = ([x for p in texts(batch, c) for x in p] for c in ("host", "path"))
            sums: dict[tuple[int, int], int] = {}
            for h, p in zip(hosts, paths, strict=True):
                c, words = count(h, p)
                for w in words:
                    for s in _slots(w):
                        sums[s, c] = sums.get((s, c), 0) + 1
            rows = [{"slot": s, "c": c, "n": n} for (s, c), n in sums.items()]
            return [[rows] + [None] * (batch.num_rows - 1) if batch.num_rows else []]
        return f

    counted = arrow_map(urls, fields, make, []).select(F.inline("counts")).groupBy("slot").agg(
        *[F.sum(F.when(F.col("c") == c, F.col("n")).otherwise(0)).alias(f"n{c}") for c in range(columns)])
    return _collect(counted, columns)


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], url: str = "url", least_odds: float = math.log(10.0)) -> DataFrame:
    """``pages`` with host, path, rule, verdict and ``score`` (log odds of unwanted); the model blocks
    above ``least_odds``, ten to one."""
    host, path = url_parts(F.col(url))
    rows = pages.drop("host", "path", "rule", "verdict", "score").withColumn("host", host).withColumn("path", path)
    urls, seeds = rows.select("host", "path"), frozenset(SEEDS)
    sc = pages.sparkSession.sparkContext
    unigrams = sc.broadcast(_unigrams(urls))

    def labelled():
        words = Words(unigrams.value)

        def f(h, p):
            found = [w for n in names_of(h, p) for w in words.split(n)]
            return int(not seeds.isdisjoint(found)), found
        return f

    counts = _count_slots(urls, labelled, 2)
    totals = counts[:, :SLOTS].sum(1)
    used = max(1, int((counts[:, :SLOTS].sum(0) > 0).sum()))
    for w in SEEDS:  # known whether or not the table has them
        for s in _slots(w):
            counts[1, s] += 1
    logs = np.log((counts + SMOOTHING) / (totals + SMOOTHING * used)[:, None])
    model = sc.broadcast(logs[1] - logs[0])

    def make():
        words, odds = Words(unigrams.value), model.value

        def f(batch):
            hosts, paths = ([x for p in texts(batch, c) for x in p] for c in ("host", "path"))
            out = []
            for h, p in zip(hosts, paths, strict=True):
                out.append(sum(min((float(odds[s]) for s in _slots(w)), key=abs) for n in names_of(h, p) for w in words.split(n)))
            return [out]
        return f

    scored = arrow_map(rows, [T.StructField("score", T.DoubleType())], make)
    hit = rule_column(rules)
    verdict = F.coalesce(hit["verdict"], F.when(F.col("score") > least_odds, "block").otherwise("allow"))
    return scored.withColumn("rule", hit["rule"]).withColumn("verdict", verdict)
