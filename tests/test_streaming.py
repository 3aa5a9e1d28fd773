"""Fitted safe cleaning applied to a file stream equals the batch result."""

import os
import tempfile

from tablecare.operators.clean import apply_safe_clean, fit_safe_clean
from tablecare.sources.tables import dirty_orders
from tablecare.streaming import apply_clean_stream

from .conftest import SF_SMALL


def test_stream_clean_matches_batch(spark):
    src = dirty_orders(spark, SF_SMALL)
    d = tempfile.mkdtemp(prefix="tablecare-stream-")
    path = os.path.join(d, "in")
    src.write.parquet(path)
    batch = spark.read.parquet(path)
    spec = fit_safe_clean(batch)
    stream = spark.readStream.schema(batch.schema).parquet(path)
    q = (apply_clean_stream(stream, spec).writeStream.format("memory").queryName("clean_stream")
         .option("checkpointLocation", os.path.join(d, "ckpt")).start())
    q.processAllAvailable()
    q.stop()
    got = sorted(tuple(r) for r in spark.sql("SELECT * FROM clean_stream").collect())
    want = sorted(tuple(r) for r in apply_safe_clean(batch, spec, dedup=False).collect())
    assert got == want and len(got) == batch.count()
