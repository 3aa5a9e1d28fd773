import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import types as T
from tokenizers import Tokenizer

from tablecare.llm import common, packing

from .helpers import EDGES, SMALL, documents

PATH = public_tokenizers.path("byte_bpe_50k.json")


def check(docs):
    got = packing.pack(docs, PATH).toPandas()
    tok = Tokenizer.from_file(PATH)
    expected = []
    for r in docs.collect():
        ids = tok.encode(r["text"] or "", add_special_tokens=False).ids + [2]
        first = len(ids) % 1024 or min(len(ids), 1024)
        cuts = [0, *range(first, len(ids) + 1, 1024)] if len(ids) > first else [0, first]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            expected.append((-1 if r["doc_id"] is None else r["doc_id"], k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    got["doc_id"] = got["doc_id"].fillna(-1).astype(int)
    assert sorted(expected) == sorted(map(tuple, got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False)))
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert (g["offset"].to_numpy() == np.concatenate(([0], g["length"].cumsum()[:-1]))).all() and g["length"].sum() <= 1024
    return got


def test_whole_table(spark):
    got = check(spark.read.parquet(f"{SMALL}/documents.parquet"))
    assert got["sequence_id"].nunique() <= 1.02 * got["length"].sum() / 1024 + 2


def test_edges(spark, tmp_path):
    odd = [(20, "a  b\t c\n d  ", "s"), (21, " lead and trail ", "s"), (22, "x<|endoftext|> y", "s"), (23, "same same same", "s"),
           (24, "nb sp   em it's we'll", "s"), (25, "7 77 777 don't 'll stop", "s")]
    check(documents(spark, EDGES + odd, tmp_path))
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_tightest_space_is_taken():
    r = np.random.default_rng(0)
    lengths = np.sort(r.integers(1, 101, 3000))[::-1]
    bins, offsets = packing.best_fit(lengths, 100)
    space = {}
    for n, b, o in zip(lengths.tolist(), bins.tolist(), offsets.tolist()):
        fits = [s for s in space.values() if s >= n]
        assert (space[b] == min(fits)) if b in space else not fits
        assert o == 100 - space.get(b, 100)
        space[b] = space.get(b, 100) - n


def test_long_texts_reach_python_in_small_batches(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.range(0, 600, 1, 1).selectExpr("id as doc_id", "repeat('word ', 4000) as text")
    sizes = common.arrow_map(docs, [T.StructField("n", T.LongType())], lambda: lambda b: [[b.nbytes] * b.num_rows], ["doc_id"])
    assert sizes.count() == 600 and sizes.agg({"n": "max"}).first()[0] < common.BATCH_BYTES + 100_000
    spark.conf.unset(name)
    assert packing.pack(docs, PATH).count() == 600 * 4
    assert spark.conf.get(name) == str(common.BATCH_BYTES)
    spark.conf.set(name, "1m")
    common.small_batches(spark)
    assert spark.conf.get(name) == "1m"
    spark.conf.unset(name)
