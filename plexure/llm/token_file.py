"""Token ids in a compact binary format, and their reader.

Format. A folder with two Parquet tables, written and read by Spark, so that any store will do:
* ``codes``: rank, id. Ids ranked by falling count in this corpus, so that frequent ids take one byte.
* ``blocks``: shard, first (tokens of the shard before the block), doc_ids (int64), lengths (uint32, tokens of
  each document), control, data. Every rank takes 1 to 4 bytes, little-endian, in ``data``; ``control`` holds
  the byte counts less one, two bits each, four to a byte. Decoding looks up the byte counts of a control
  byte in a table of 256 rows and gathers the values with numpy.
Shards hold documents in ascending doc_id order, null first; within a shard, blocks in the order of ``first``.

Defined results: null is the empty text and yields only the end id; rows that share a doc_id stand side by side,
shorter ones first, those of one length in the order of a hash; they may fill any number of tasks. An empty table gives no blocks. Added tokens of the vocabulary that stand literally in a text
are one id each, as the library has it by default; the text between them is encoded by itself.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plexure.llm.chunks import ChunkEncoder, EncodeChunks
from plexure.llm.common import Scratch, arrow_map, column, record, slices, texts_of

BLOCK_TOKENS, SHARD_BYTES = 1 << 18, 256 << 20
_COUNTS = np.array([[(c >> (2 * k) & 3) + 1 for k in range(4)] for c in range(256)], np.uint8)


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit values."""
    v = np.ascontiguousarray(values, "<u4")
    size = 1 + (v >= 1 << 8).astype(np.uint8) + (v >= 1 << 16) + (v >= 1 << 24)
    four = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    four[: len(v)] = size - 1
    control = (four.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1).astype(np.uint8)
    return control.tobytes(), v.view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n values that ``pack`` took."""
    size = _COUNTS[np.frombuffer(control, np.uint8)].ravel()[:n]
    raw = np.frombuffer(data + b"\0\0\0", np.uint8)
    at = np.cumsum(size, dtype=np.int64) - size
    out = raw[at].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(size > k)
        if len(more):
            out[more] |= raw[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


class TokenEncoder(ChunkEncoder):
    """A ChunkEncoder that first cuts texts at the literal ``added`` tokens (content to id)."""

    def __init__(self, encode_chunks: EncodeChunks, added: dict[str, int]) -> None:
        super().__init__(encode_chunks)
        self.added = added
        self.literal = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = pc.fill_null(texts, "")
        holds = np.zeros(len(texts), bool)
        for token in self.added:
            holds |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        if not holds.any():
            return super().encode(texts)
        pieces: list[str] = []
        after: list[tuple[int, int]] = []  # number of pieces before an added token, and its id
        last = []
        for text, cut in zip(texts.to_pylist(), holds.tolist(), strict=True):
            for k, part in enumerate(self.literal.split(text) if cut else [text]):
                if k % 2:
                    after.append((len(pieces), self.added[part]))
                else:
                    pieces.append(part)
            last.append(len(pieces))
        ids, ends = super().encode(pa.array(pieces, pa.large_string()))
        place = np.array([n for n, _ in after], np.int64)
        ids = np.insert(ids, ends[place - 1], [i for _, i in after])
        last = np.array(last, np.int64)
        return ids, ends[last - 1] + np.searchsorted(place, last)


@cache
def _tokenizer(path: str) -> TokenEncoder:
    """One for each Python worker. Chunks without blanks at their ends go to the library joined to long texts; their ids part where the byte lengths say."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.encode_special_tokens = True  # TokenEncoder has cut them out; chunks that are joined must not spell one
    added = made.get_added_tokens_decoder()
    if any(t.single_word or t.lstrip or t.rstrip or t.normalized and made.normalizer for t in added.values()):
        raise ValueError(f"{path} has added tokens that take more than their own characters")
    width = np.array([len(made.id_to_token(i) or "") for i in range(made.get_vocab_size())], np.int64)  # a symbol for each byte

    def encode_chunks(chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        joint = [i for i, c in enumerate(chunks) if len(c) > 1 and c[0] == " " and not (c[1].isspace() or c[-1].isspace())]
        if len(joint) == len(chunks) and chunks:
            return together(chunks)
        rest = np.setdiff1d(np.arange(len(chunks)), joint)
        alone = [e.ids for e in made.encode_batch_fast([chunks[i] for i in rest.tolist()], add_special_tokens=False)] if len(rest) else []
        parts = [(rest, np.array([i for x in alone for i in x], "<u4"), np.array([len(x) for x in alone], np.int64))]
        if joint:
            parts.append((np.array(joint), *together([chunks[i] for i in joint])))
        size = np.zeros(len(chunks), np.int64)
        for places, _, sizes in parts:
            size[places] = sizes
        start, out = np.cumsum(size) - size, np.zeros(int(size.sum()), "<u4")
        for places, flat, sizes in parts:
            out[np.repeat(start[places] - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(flat))] = flat
        return out, size

    def together(chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        runs = [chunks[at : at + 4000] for at in range(0, len(chunks), 4000)]
        flat = np.concatenate([np.array(e.ids, "<u4") for e in made.encode_batch_fast(["".join(r) for r in runs], add_special_tokens=False)])
        ends = np.cumsum(np.fromiter(map(len, map(str.encode, chunks)), np.int64, len(chunks)))
        cut = np.searchsorted(np.cumsum(width[flat]), ends) + 1
        return flat, np.diff(cut, prepend=0)

    return TokenEncoder(encode_chunks, {t.content: i for i, t in added.items()})


def _narrow(path: str) -> str:
    """The least unsigned type that holds every id of the vocabulary."""
    from tokenizers import Tokenizer

    return "<u2" if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else "<u4"


def tokenize(docs: DataFrame, path: str, end_id: int, kind: str) -> DataFrame:
    """doc_id, n, ids (of numpy's type ``kind``, the end id last)."""
    width = np.dtype(kind).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _tokenizer(path)
        for batch in slices(batches, most=4 << 20):
            ids, ends = encoder.encode(column(batch, "text"))
            ids = np.insert(ids.astype(kind), ends, end_id)
            cut = np.concatenate([[0], ends + np.arange(1, len(ends) + 1)])
            binary = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer((cut * width).astype(np.int32)), pa.py_buffer(ids)])
            yield record("doc_id:long n:long ids:binary", column(batch, "doc_id"), pa.array(np.diff(cut)), binary)

    return arrow_map(texts_of(docs), run, "doc_id long, n long, ids binary")


def _counts(ids: DataFrame, kind: str) -> DataFrame:
    """id, n: counts of each task's ids, summed; at most one row an id of the vocabulary and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in slices(batches, "ids"):
            found = np.bincount(np.frombuffer(b"".join(column(batch, "ids").to_pylist()), kind), minlength=len(total))
            found[: len(total)] += total
            total = found
        seen = np.flatnonzero(total)
        yield record("id:long n:long", pa.array(seen.astype(np.int64)), pa.array(total[seen]))

    return arrow_map(ids.select("ids"), run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_tokens(docs: DataFrame, folder: str, scratch: Scratch, path: str, end_id: int) -> None:
    """Tokenize ``docs`` (doc_id, text) and write them under ``folder``. The code table is bounded by the vocabulary."""
    spark = docs.sparkSession
    kind = _narrow(path)
    width = np.dtype(kind).itemsize
    ids = scratch.keep(tokenize(docs, path, end_id, kind), "ids")
    counted = _counts(ids, kind).orderBy(F.desc("n"), "id").collect()
    ranked, total = [r.id for r in counted], sum(r.n for r in counted)
    spark.createDataFrame(list(enumerate(ranked)), "rank long, id long").coalesce(1).write.parquet(f"{folder}/codes")
    rank = np.zeros(max(ranked, default=0) + 1, "<u4")
    rank[ranked] = np.arange(len(ranked))
    given = spark.sparkContext.broadcast(rank)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, first, held, names = TaskContext.get().partitionId(), 0, [], []

        def block() -> pa.RecordBatch:
            nonlocal first, held, names
            sizes = np.array([len(x) // width for x in held], "<u4")
            control, data = pack(given.value[np.frombuffer(b"".join(held), kind)])
            row = record("shard:int first:long docs:int tokens:long doc_ids:longs lengths:binary control:binary data:binary", [shard], [first], [len(held)], [int(sizes.sum())], [names], [sizes.tobytes()], [control], [data])
            first, held, names = first + int(sizes.sum()), [], []
            return row

        waiting = 0
        for batch in slices(batches, "ids"):
            for name, x in zip(column(batch, "doc_id").to_pylist(), column(batch, "ids").to_pylist(), strict=True):
                held.append(x)
                names.append(name)
                waiting += len(x) // width
                if waiting >= BLOCK_TOKENS:
                    yield block()
                    waiting = 0
        if held:
            yield block()

    # Shards of bounded size, whatever the size of the corpus.
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total * width // SHARD_BYTES), 1)
    # Rows of one doc_id, or of none, are told apart by length and hash, and equal rows by where they were written.
    order = [F.asc_nulls_first("doc_id"), F.asc("n"), F.asc("_hash"), F.asc("_at")]
    keyed = ids.withColumn("_hash", F.xxhash64("ids")).withColumn("_at", F.monotonically_increasing_id())
    dealt = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "ids")
    arrow_map(dealt, run, "shard int, first long, docs int, tokens long, doc_ids array<bigint>, lengths binary, control binary, data binary").write.option("compression", "zstd").parquet(f"{folder}/blocks")
    scratch.drop(ids)


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, ids (unsigned 32-bit) from a folder that ``write_tokens`` wrote."""
    codes = np.zeros(0, "<u4")
    found = spark.read.parquet(f"{folder}/codes").orderBy("rank").collect()
    if found:
        codes = np.array([r.id for r in found], "<u4")
    given = spark.sparkContext.broadcast(codes)
    blocks = spark.read.parquet(f"{folder}/blocks")
    totals = blocks.groupBy("shard").agg(F.sum("tokens").alias("t"))
    before = totals.select(F.col("shard").alias("s"), (F.sum("t").over(Window.orderBy("shard")) - F.col("t")).alias("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                sizes = np.frombuffer(r["lengths"], "<u4").astype(np.int64)
                ids = given.value[unpack(r["control"], r["data"], int(sizes.sum()))]
                ends = np.cumsum(sizes)
                yield record("doc_id:long start:long ids:binary", r["doc_ids"], pa.array(ends - sizes + r["first"] + r["before"]), [ids[b - n : b].tobytes() for b, n in zip(ends, sizes, strict=True)])

    placed = blocks.join(F.broadcast(before), F.col("shard") == F.col("s")).drop("s", "shard", "docs", "tokens")
    return arrow_map(placed, run, "doc_id long, start long, ids binary")


def round_trip(docs: DataFrame, path: str, end_id: int = 2) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, all from the files as read back."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "token-file")
    write_tokens(docs, f"{scratch.base}/files", scratch, path, end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = column(batch, "ids").to_pylist()
            yield record("doc_id:long start:long n_tokens:long ids_crc32:long", column(batch, "doc_id"), column(batch, "start"), [len(x) // 4 for x in ids], [zlib.crc32(x) for x in ids])

    return arrow_map(read_tokens(spark, f"{scratch.base}/files"), run, "doc_id long, start long, n_tokens long, ids_crc32 long")
