"""Best-fit decreasing packing of tokenized documents into fixed-length sequences.

A document's ids are its text's tokens and a final separator. Documents longer than the
capacity are cut into full pieces, the first taking the remainder. Pieces are dealt at random
into shards of about ``shard_pieces``; in a shard they go by decreasing length into the open
sequence with the least sufficient space, found in a segment tree over remaining capacities in
logarithmic time. Shards are independent, so the number of sequences exceeds that of one
global run by a fraction of a sequence per shard.

Tokenizing a chunk that starts at a single space between two non-spaces gives the same ids as
tokenizing the whole text, since the byte-level pattern never joins characters across such a
place. So texts are split there and the ids of each chunk are kept in a bounded table; any text
with other white space at a cut, or with a special token's string, is tokenized whole.

Defined results: a null text is empty and gives one piece with the separator alone; repeated
rows are packed each; an empty table gives no rows.
"""

from __future__ import annotations

import json
import os
import zlib
from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import small_batches, texts, written

#: Chunks whose ids a worker keeps; beyond it the table starts anew.
CHUNKS = 200_000
#: Texts tokenized together.
TEXTS = 128


# Fixed value: the pattern by which byte-level pre-tokenization splits text.
BYTE_LEVEL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def rank_encoder(parts: dict):
    """A quicker encoder with the same ids for a byte-level BPE whose merges are numbered in order;
    None for any other. Merging the pair of least rank is then merging by the list's order."""
    model = parts["model"]
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    special = {t["content"] for t in parts.get("added_tokens") or []}
    vocab = {t: i for t, i in model["vocab"].items() if t not in special}
    merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    if model.get("type") != "BPE" or any(vocab.get(t) != 256 + i for i, t in enumerate(merged)) or len(vocab) != 256 + len(merged):
        return None
    import tiktoken
    ranks = {bytes(letters[c] for c in t): i for t, i in vocab.items()}
    return tiktoken.Encoding("ranks", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})


class ChunkTokenizer:
    """Token ids (little-endian unsigned 32-bit) of whole texts, by a tokenizers file."""

    _kept: dict[str, "ChunkTokenizer"] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as f:
            spec = f.read()
        parts = json.loads(spec)
        pre = parts.get("pre_tokenizer") or {}
        self.whole_only = bool(parts.get("normalizer")) or pre.get("type") != "ByteLevel" or not pre.get("use_regex") \
            or bool(pre.get("add_prefix_space"))
        self.special = [t["content"] for t in parts.get("added_tokens") or []]
        self.tokenizer = Tokenizer.from_str(spec)
        self.quick = None if self.whole_only else rank_encoder(parts)
        self.first: dict[str, bytes] = {}
        self.rest: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str) -> "ChunkTokenizer":
        """One per worker process: loading takes longer than a small task."""
        if path not in cls._kept:
            cls._kept[path] = cls(path)
        return cls._kept[path]

    def _encode(self, batch: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(batch, add_special_tokens=False)]

    def _chunks(self, words: list[str]) -> list[bytes]:
        """Ids of chunks, which hold no special token's string."""
        if self.quick is None or any(x in w for x in self.special for w in words):
            return self._encode(words)
        encode = self.quick.encode_ordinary
        return [array("I", encode(w)).tobytes() for w in words]

    def __call__(self, batch: list[str]) -> list[bytes]:
        if len(self.first) + len(self.rest) > CHUNKS:
            self.first.clear()
            self.rest.clear()
        out: list[bytes | None] = [None] * len(batch)
        whole, split, new_first, new_rest = [], [], set(), set()
        for i, text in enumerate(batch):
            if not text:
                out[i] = b""
                continue
            parts = text.split(" ")
            head, rest = parts[0], set(parts[1:]).difference(self.rest)
            new = [*rest, head] if head not in self.first else rest
            if self.whole_only or any(not x or x[0].isspace() or x[-1].isspace() for x in new) \
                    or any(s in text for s in self.special):
                whole.append(i)
                continue
            split.append((i, parts))
            new_rest |= rest
            if head not in self.first:
                new_first.add(head)
        for table, new, lead in ((self.first, new_first, ""), (self.rest, new_rest, " ")):
            if new:
                words = list(new)
                table.update(zip(words, self._chunks([lead + x for x in words]), strict=True))
        for i, parts in split:
            out[i] = self.first[parts[0]] + b"".join(map(self.rest.__getitem__, parts[1:]))
        if whole:
            for i, ids in zip(whole, self._encode([batch[i] for i in whole]), strict=True):
                out[i] = ids
        return out


class SpaceTree:
    """Segment tree over remaining capacities: which of them an open sequence has."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.held = [False] * (2 * self.size)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def put(self, space: int, bin_id: int) -> None:
        self.bins[space].append(bin_id)
        i = space + self.size
        while i and not self.held[i]:
            self.held[i] = True
            i >>= 1

    def take(self, length: int) -> tuple[int, int] | None:
        """Remove and return (space, bin) with the least space of at least ``length``."""
        i = length + self.size
        if not self.held[i]:
            while i > 1 and (i & 1 or not self.held[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if self.held[2 * i] else 2 * i + 1
        space = i - self.size
        bin_id = self.bins[space].pop()
        if not self.bins[space]:
            self.held[i] = False
            while i > 1 and not self.held[i ^ 1]:
                i >>= 1
                self.held[i] = False
        return space, bin_id


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece; ``lengths`` must be in decreasing order, each 1 to ``capacity``."""
    tree, n_bins = SpaceTree(capacity), 0
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i, length in enumerate(lengths.tolist()):
        space, b = tree.take(length) or (capacity, -1)
        if b < 0:
            b, n_bins = n_bins, n_bins + 1
        bins[i], offsets[i] = b, capacity - space
        if space > length:
            tree.put(space - length, b)
    return bins, offsets


def cut_points(total: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full ones behind a first with the remainder."""
    first = total % capacity or min(total, capacity)
    return [(0, first), *((s, capacity) for s in range(first, total, capacity))]


_PIECE = T.StructType([T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
                       T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()),
                       T.StructField("_row", T.LongType())])


def tokenize_pieces(docs: DataFrame, tokenizer_path: str, separator: int, capacity: int, text: str = "text",
                    key: str = "doc_id") -> DataFrame:
    """One row per piece: key, piece, start, length, ids_crc32 and ``_row`` (its place in the input)."""
    small_batches(docs.sparkSession)
    schema = T.StructType([docs.schema[key], *_PIECE.fields])
    arrow = to_arrow_schema(schema)

    def run(batches):
        tokenizer = ChunkTokenizer.of(tokenizer_path)
        tail, row = np.asarray([separator], "<u4").tobytes(), TaskContext.get().partitionId() << 40
        for b in batches:
            keys, which, cols, at = b.column(b.schema.get_field_index(key)), [], [[], [], [], [], []], 0
            for part in texts(b, text, TEXTS):
                for ids in tokenizer(part):
                    data = memoryview(ids + tail)
                    for k, (start, length) in enumerate(cut_points(len(data) // 4, capacity)):
                        which.append(at)
                        for c, v in zip(cols, (k, start, length, zlib.crc32(data[4 * start:4 * (start + length)]), row), strict=True):
                            c.append(v)
                        row += 1
                    at += 1
            taken = keys.take(pa.array(which, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [taken, *[pa.array(c, t) for c, t in zip(cols, arrow.types[1:], strict=True)]], schema=arrow)

    return docs.select(key, text).mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer_path: str, separator: int = 2, capacity: int = 1024, shard_pieces: int = 50_000,
         text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per piece: key, piece, start, length, ids_crc32, sequence_id and offset."""
    pieces = written(tokenize_pieces(docs, tokenizer_path, separator, capacity, text, key), "pack-pieces")
    shards = max(1, -(-pieces.count() // shard_pieces))

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.iloc[np.lexsort((pdf["_row"].to_numpy(), -pdf["length"].to_numpy()))]
        bins, offsets = best_fit(pdf["length"].to_numpy(), capacity)
        return pdf.assign(sequence_id=(pdf["_shard"].to_numpy().astype(np.int64) << 32) + bins, offset=offsets).drop(
            columns=["_row", "_shard"])

    dealt = pieces.withColumn("_shard", F.pmod(F.xxhash64("_row"), F.lit(shards)).cast("int"))
    schema = T.StructType([*[f for f in pieces.schema.fields if f.name != "_row"],
                           T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return dealt.groupBy("_shard").applyInPandas(fill, schema)
