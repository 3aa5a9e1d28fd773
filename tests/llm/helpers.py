import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, sequence_id string, row_id string, size string"


def documents(spark, rows, tmp_path):
    """A documents table with clashing extra columns, in files."""
    full = [(i, t, "en", s, None if t is None else len(t), "x", "y", "z") for i, t, s in rows]
    path = str(tmp_path / "docs")
    spark.createDataFrame(full, DOCS).coalesce(2).write.parquet(path)
    return spark.read.parquet(path)


LONG = " ".join(f"w{i % 977}x{i % 1013}" for i in range(60_000))
EDGES = [(1, None, "a"), (2, "", "a"), (3, "  \n ", None), (4, "one", "a"), (5, "one", "b"), (5, "one", "b"), (None, "null id here", "b"),
         (7, LONG, None), (8, None, None), (9, "Ünïcode wörds · 中文 字 \U0001f600 end of the text", "c")]
