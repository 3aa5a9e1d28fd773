"""Ranked lexical search over a length-stratified index.

A document's normaliser ``m`` is a whole number that grows with its length against the average, and a
term's share of its score depends on the document by ``m`` and its count ``tf`` there alone. So the
index groups documents of equal ``m`` into strata and keeps, per term, the documents of a stratum by
``tf``: one division serves all of them. A stratum is cut into blocks of bounded size, one index row
each, so that documents of one length, however many, are built and searched by many tasks.

The most an item can score in a stratum is the sum of its terms' impacts at their highest ``tf`` there.
Each item visits strata in the order of that bound: first the best ones, until they hold ``FIRST * k``
documents; its ``k``-th score so far then rules out every stratum whose bound is lower, and the rest
are visited. Nothing that could be among the ``k`` is left out.

The index may be kept to the terms of the items (``terms_of``). Tasks are told which those are by a
fixed number of hashed bits, so a few other terms may slip in, which no item asks for.

Defined cases: a null or empty text has no terms and is neither counted nor found; every row is a
document and every row of the items an item, whatever its id, so repeated ids give repeated rankings;
equal scores go by ascending id, null first, then by place in the table; an empty table of either
kind gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ship, small, written

#: A term is a maximal run of ASCII letters and digits and of characters beyond ASCII; their UTF-8 bytes say which.
_SPLIT = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
#: Hashed bits that mark the terms to index.
MARKS = 1 << 20
#: Tokens and documents of one block of a stratum.
BLOCK_TOKENS, BLOCK_DOCS = 1 << 20, 4096
#: Documents, in units of k, that an item's first visits cover.
FIRST = 20
#: Term rows of the items that are scored together, and items that share one score table.
ITEM_TERMS, TOGETHER = 100_000, 256
#: Terms sent to Spark in one batch.
BATCH_TERMS = 200_000

DOC_TERMS = T.StructType([T.StructField("id", T.LongType()), T.StructField("n", T.LongType()),
                          T.StructField("terms", T.ArrayType(T.StringType())), T.StructField("tfs", T.ArrayType(T.IntegerType()))])
BLOCK = T.StructType([T.StructField("m", T.LongType()), T.StructField("block", T.LongType()),
                      T.StructField("rows", T.ArrayType(T.LongType())), T.StructField("ids", T.ArrayType(T.LongType())),
                      T.StructField("terms", T.ArrayType(T.StringType())), T.StructField("starts", T.ArrayType(T.IntegerType())),
                      T.StructField("tfs", T.ArrayType(T.IntegerType())), T.StructField("postings", T.ArrayType(T.IntegerType())),
                      T.StructField("top_tfs", T.ArrayType(T.IntegerType()))])
HITS = T.StructType([T.StructField("item", T.LongType()), T.StructField("score", T.LongType()), T.StructField("id", T.LongType()),
                     T.StructField("row", T.LongType())])


def _lists(values: pa.Array, sizes: list[int]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), values)


def count_terms(table: DataFrame, key: str, text: str, marks: np.ndarray | None = None) -> DataFrame:
    """Per row of ``table`` its key as ``id``, the number ``n`` of its terms and its distinct terms with counts:
    all of them, or those whose hash is marked."""
    ship(table.sparkSession)
    marked = None if marks is None else np.packbits(marks).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None if marked is None else np.unpackbits(np.frombuffer(marked, np.uint8)).tobytes()
        ids, ns, sizes, terms, tfs = [], [], [], [], []

        def batch() -> pa.RecordBatch:
            words = pa.array(terms, pa.binary()).cast(pa.string())
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), _lists(words, sizes),
                                               _lists(pa.array(tfs, pa.int32()), sizes)], names=DOC_TERMS.names)
        for b in batches:
            keys = b.column(0)
            for i, raw in enumerate(b.column(1).cast(pa.binary())):
                found = Counter((raw.as_py() or b"").translate(_SPLIT).split())
                n = found.total()
                if held is not None:
                    found = {t: c for t, c in found.items() if held[zlib.crc32(t) % MARKS]}
                ids.append(keys[i].as_py())
                ns.append(n)
                sizes.append(len(found))
                terms.extend(found.keys())
                tfs.extend(found.values())
                if len(terms) >= BATCH_TERMS:
                    yield batch()
                    ids, ns, sizes, terms, tfs = [], [], [], [], []
        if ids:
            yield batch()

    return table.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(run, DOC_TERMS)


def term_marks(terms: DataFrame) -> np.ndarray:
    """The hashed bits of ``term``, at most ``MARKS`` numbers to the driver."""
    hits = terms.select((F.crc32(F.col("term").cast("binary")) % MARKS).cast("int").alias("bit")).distinct().toArrow()
    marks = np.zeros(MARKS, np.uint8)
    marks[hits.column("bit").to_numpy()] = 1
    return marks


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by (m, block), one table a block."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        m, block = b.column(0).to_numpy(), b.column(1).to_numpy()
        cuts = [0, *(np.flatnonzero((np.diff(m) != 0) | (np.diff(block) != 0)) + 1).tolist(), b.num_rows]
        for i, j in zip(cuts, cuts[1:]):
            now = (m[i], block[i])
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(i, j - i))
            last = now
    if held:
        yield pa.Table.from_batches(held)


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in _runs(batches):
        t = t.combine_chunks()
        lists = t.column("terms").combine_chunks()
        doc = np.repeat(np.arange(t.num_rows, dtype=np.int64), lists.value_lengths().to_numpy())
        words = lists.flatten().dictionary_encode()
        tf = t.column("tfs").combine_chunks().flatten().to_numpy()
        names = words.dictionary.to_numpy(zero_copy_only=False)
        rank = np.empty(len(names), np.int64)
        order = np.argsort(names.astype(object), kind="stable")
        rank[order] = np.arange(len(names))
        term = rank[words.indices.to_numpy()] if len(words) else np.zeros(0, np.int64)
        by = np.lexsort((doc, tf, term))
        term, tf, doc = term[by], tf[by], doc[by]
        starts = np.searchsorted(term, np.arange(len(names) + 1))
        tops = tf[starts[1:] - 1] if len(names) else tf[:0]

        def one(values, kind):
            return pa.array([values], pa.list_(kind))
        yield pa.RecordBatch.from_arrays([
            t.column("m").combine_chunks()[:1], t.column("block").combine_chunks()[:1],
            one(t.column("row").to_numpy(), pa.int64()), one(t.column("id").to_pylist(), pa.int64()),
            one(names[order].tolist(), pa.string()), one(starts, pa.int32()), one(tf, pa.int32()), one(doc, pa.int32()), one(tops, pa.int32())],
            names=BLOCK.names)


class Index:
    """A written index: ``blocks`` (one row a block of a stratum), and the corpus statistics."""

    def __init__(self, docs: DataFrame, key: str = "doc_id", text: str = "text", terms_of: DataFrame | None = None):
        marks = None if terms_of is None else term_marks(terms_of)
        counted = count_terms(docs, key, text, marks)
        self.docs = written(counted.withColumn("row", F.monotonically_increasing_id()), "lexical-docs").where("n > 0")
        self.count, total = self.docs.agg(F.count(F.lit(1)), F.sum("n")).first()
        self.total = total or 0
        m = F.lit(50).cast("long") if not self.total else F.expr(f"50L + (50L * n * {self.count}L) div {self.total}L")
        sized = self.docs.withColumn("m", m)
        self.strata = written(sized.groupBy(F.col("m").alias("of_m")).agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("tokens")), "lexical-strata")
        cuts = F.greatest(F.ceil(F.col("docs") / BLOCK_DOCS), F.ceil(F.col("tokens") / BLOCK_TOKENS))
        dealt = (sized.join(small(self.strata), F.col("m") == F.col("of_m"))
                 .select("m", F.pmod(F.xxhash64("row"), cuts.cast("long")).alias("block"), "row", "id", "terms", "tfs"))
        self.blocks = written(dealt.repartition("m", "block").sortWithinPartitions("m", "block").mapInArrow(_build, BLOCK), "lexical-index")
        held = F.expr("transform(terms, (t, i) -> starts[i + 1] - starts[i])").alias("dfs")
        each = self.blocks.select("m", F.inline(F.arrays_zip("terms", "top_tfs", held))) if self.count else None
        spark = docs.sparkSession
        self.terms = written(each.groupBy("m", F.col("terms").alias("term")).agg(F.sum("dfs").alias("df"), F.max("top_tfs").alias("top")), "lexical-terms") \
            if each is not None else spark.createDataFrame([], "m long, term string, df long, top int")

    def weights(self) -> DataFrame:
        """(term, w): whole thousandths of the logarithm of the odds against a document holding the term."""
        odds = (2 * F.lit(self.count).cast("double") + 2) / (2 * F.sum("df").cast("double") + 1)
        return self.terms.groupBy("term").agg(F.floor(F.lit(1000.0) * F.ln(odds)).cast("long").alias("w"))

    def search(self, items: DataFrame, key: str = "item_id", text: str = "text", k: int = 50) -> DataFrame:
        """The ``k`` best documents with a score above 0 for every row of ``items``: key, rank, doc id, score."""
        asked = item_terms(items, key, text)
        weighed = written(asked.join(self.weights(), "term"), "lexical-weights")
        factor = impact("top", "m")
        bounds = (weighed.join(self.terms, "term").groupBy("item", "m").agg(F.sum(F.col("w") * factor).alias("bound"))
                  .where("bound > 0").join(small(self.strata), F.col("m") == F.col("of_m")).drop("of_m"))
        better = Window.partitionBy("item").orderBy(F.col("bound").desc(), "m").rowsBetween(Window.unboundedPreceding, -1)   # one row a stratum
        visits = written(bounds.withColumn("before", F.coalesce(F.sum("docs").over(better), F.lit(0))), "lexical-visits")
        first = self._score(weighed, visits.where(F.col("before") < FIRST * k), k)
        floor = first.groupBy("item").agg(F.count(F.lit(1)).alias("have"), F.min("score").alias("least")).where(F.col("have") >= k)
        rest = (visits.where(F.col("before") >= FIRST * k).join(floor.withColumnRenamed("item", "of_item"), F.col("item") == F.col("of_item"), "left")
                .where(F.col("bound") >= F.coalesce(F.col("least"), F.lit(1))).select(*visits.columns))
        found = first.unionByName(self._score(weighed, rest, k))
        named = asked.select("item", "key").distinct()
        return (best(found, k).join(named, "item")
                .select(F.col("key").alias(key), "rank", F.col("id").alias("doc_id"), "score"))

    def _score(self, weighed: DataFrame, visits: DataFrame, k: int) -> DataFrame:
        """The ``k`` best hits of each item in the strata it visits, written.

        Items are dealt to as many groups as keep one at about ``ITEM_TERMS`` term rows; a group's terms go to the tasks."""
        groups = -(-weighed.count() // ITEM_TERMS)
        out = []
        for g in range(groups):
            def mine(df: DataFrame, g: int = g) -> DataFrame:
                return df.where(F.pmod(F.xxhash64("item"), F.lit(groups)) == g) if groups > 1 else df
            rows = mine(weighed.select("term", "item", "w")).toArrow()
            terms: dict[str, tuple[int, list[int]]] = {}
            for t, i, w in zip(rows["term"].to_pylist(), rows["item"].to_pylist(), rows["w"].to_pylist()):
                terms.setdefault(t, (w, []))[1].append(i)
            wanted = mine(visits).groupBy(F.col("m").alias("of_m")).agg(F.collect_list("item").alias("items"))   # items of one group
            here = self.blocks.join(small(wanted), F.col("m") == F.col("of_m")).drop("of_m")
            out.append(written(best(here.mapInArrow(scorer(terms, k), HITS), k).drop("rank"), "lexical-hits"))
        if not out:
            return weighed.sparkSession.createDataFrame([], HITS)
        found = out[0]
        for x in out[1:]:
            found = found.unionByName(x)
        return found


def impact(tf: str, m: str) -> Column:
    return F.expr(f"(1000000000L * {tf}) div (1000L * {tf} + 20L * {m})")


def best(hits: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of every item; each task keeps its own ``k`` before the shuffle."""
    w = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("id").asc_nulls_first(), "row")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def item_terms(items: DataFrame, key: str, text: str) -> DataFrame:
    """(item, key, term), each term of an item once; ``item`` numbers the rows."""
    counted = written(count_terms(items, key, text).withColumn("item", F.monotonically_increasing_id()), "lexical-items")
    return counted.select("item", F.col("id").alias("key"), F.explode("terms").alias("term"))


def scorer(asked: dict[str, tuple[int, list[int]]], k: int):
    """Scores blocks: per block, one table of scores (items by documents) to which each term adds its impacts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                row = {c: b.column(i)[r] for i, c in enumerate(b.schema.names)}
                names = row["terms"].values.to_pylist()
                starts, tfs, postings = (row[c].values.to_numpy() for c in ("starts", "tfs", "postings"))
                m = row["m"].as_py()
                rows = row["rows"].values.to_numpy()
                ids = row["ids"].values
                order_ids = ids.fill_null(-(1 << 63)).to_numpy()
                present = [(p, *asked[t]) for p, t in enumerate(names) if t in asked]
                wanted = sorted(row["items"].as_py())
                for lo in range(0, len(wanted), TOGETHER):
                    part = wanted[lo:lo + TOGETHER]
                    at = {x: i for i, x in enumerate(part)}
                    scores = np.zeros((len(part), len(rows)), np.int64)
                    for p, w, who in present:
                        mine = [at[x] for x in who if x in at]
                        if not mine:
                            continue
                        cut = slice(starts[p], starts[p + 1])
                        tf = tfs[cut]                       # ascending: one division per count
                        edges = np.flatnonzero(np.diff(tf, prepend=tf[0] - 1))
                        once = np.array([w * (1_000_000_000 * int(x) // (1000 * int(x) + 20 * m)) for x in tf[edges]], np.int64)
                        gain = np.repeat(once, np.diff(np.append(edges, len(tf))))
                        scores[np.ix_(mine, postings[cut])] += gain
                    items, scored, docs = [], [], []
                    for i, x in enumerate(part):
                        s = scores[i]
                        hit = np.flatnonzero(s > 0)
                        if len(hit) > k:
                            least = np.partition(s[hit], len(hit) - k)[len(hit) - k]
                            hit = hit[s[hit] >= least]
                        hit = hit[np.lexsort((rows[hit], order_ids[hit], -s[hit]))][:k]
                        items.append(np.full(len(hit), x, np.int64))
                        scored.append(s[hit])
                        docs.append(hit)
                    pick = np.concatenate(docs)
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(items)), pa.array(np.concatenate(scored)), ids.take(pa.array(pick)),
                                                      pa.array(rows[pick])], names=HITS.names)
    return run


def search(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """``items`` (item_id, text) against all of ``docs`` (doc_id, text), over an index of the items' terms."""
    return Index(docs, terms_of=item_terms(items, "item_id", "text")).search(items, k=k)


def search_sql(k: int = 50) -> str:
    """``search`` as DuckDB SQL."""
    rx = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({lower.format('text')}, '{rx}') AS ts FROM documents),
c AS (SELECT r, doc_id, ts, CAST(len(ts) AS BIGINT) AS n FROM d WHERE len(ts) > 0),
s AS (SELECT CAST(count(*) AS BIGINT) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM c),
p AS (SELECT r, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT r, unnest(ts) AS term FROM c) GROUP BY r, term),
f AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * nn + 2) / (2.0::DOUBLE * count(*) + 1))) AS BIGINT) AS w FROM p, s GROUP BY term, nn),
i AS (SELECT row_number() OVER () AS q, item_id, text FROM benchmark),
t AS (SELECT DISTINCT q, term FROM (SELECT q, unnest(regexp_extract_all({lower.format('text')}, '{rx}')) AS term FROM i)),
m AS (SELECT r, doc_id, 50 + (50 * n * nn) // ll AS m FROM c, s),
x AS (SELECT q, r, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
  FROM t JOIN f USING (term) JOIN p USING (term) JOIN m USING (r) GROUP BY q, r),
k AS (SELECT q, doc_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS FIRST, r) AS rank
  FROM x JOIN m USING (r) WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM k JOIN i USING (q) WHERE rank <= {k}"""
