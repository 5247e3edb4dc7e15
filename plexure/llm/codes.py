"""Vector codes by product quantization, in exact integers.

Method: components become floor(scale * x). Vectors are cut into ``parts`` equal consecutive parts, and each part position
has a codebook that begins as that part of the rows with the smallest vec_ids. A round is one treeAggregate over packed blocks
in which each component is a column: distances to all entries accumulate dimension by dimension, ``np.add.at`` adds
the components of each part to int64 sums and counts of its nearest entry, and these tensors are merged by a tree of
tasks, so that the driver gets a few of them, whose size does not depend on the number of rows. Entries become
the floor of their means; unused ones stay. After the last round the parts are assigned again.

At scale: rows are packed once, where they are read, and written; each round reads the blocks and shuffles only tensors (64
entries of all components). Errors by label are sums with map-side combine, joined back by broadcast when labels are few and
by a merge join, which adaptive execution splits at a hot label, when they are not.

Defined results: rows whose vector is null or holds null or non-finite components are dropped. Shorter vectors are filled with zeros at the
end, to the longest one's length, rounded up to whole parts of one component at least. Rows count as they come, repeated ids too; null ids come last.
Of rows with one vec_id the codebook takes the lesser vector first. With fewer rows than entries, there are as many entries as rows.
Ties go to the lower entry. Sums beyond 64 bits are held at the bounds. Null labels are one label. An empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plexure.llm.common import Scratch, arrow_map, column, record, tree_depth
from plexure.llm.vectors import finite

MOST = (1 << 63) - 1
#: Rows for which distances are held at once, and labels whose sums are broadcast.
TILE, FEW_LABELS = 1024, 100_000


def integers(x: np.ndarray, scale: int, kind: type) -> np.ndarray:
    """floor(scale * x); Python integers where 64 bits are too few."""
    if kind is not object:
        return np.floor(scale * x).astype(kind)
    with np.errstate(over="ignore"):
        whole = np.floor(scale * x)
    out = [int(a) if np.isfinite(a) else int(b) * scale for a, b in zip(whole.ravel().tolist(), x.ravel().tolist(), strict=True)]
    made = np.empty(len(out), object)
    made[:] = out
    return made.reshape(x.shape)


def _packed(rows: DataFrame, dims: int, size: int) -> DataFrame:
    """Blocks of ``size`` rows: ids, labels, and the numbers with each component as a column."""

    def block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        lists = t["v"].combine_chunks()
        offsets = lists.offsets.to_numpy()
        flat, width = lists.flatten().to_numpy(zero_copy_only=False), np.diff(offsets)
        x = np.zeros((t.num_rows, dims))
        x[np.repeat(np.arange(t.num_rows), width), np.arange(len(flat)) - np.repeat(offsets[:-1] - offsets[0], width)] = flat
        kinds = pa.list_(pa.int64()), pa.list_(pa.string())
        ids, labels = (pa.array([t[c].to_pylist()], k) for c, k in zip(("vec_id", "label"), kinds, strict=True))
        return pa.RecordBatch.from_arrays([ids, labels, pa.array([np.ascontiguousarray(x.T).tobytes()])], names=["ids", "labels", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, size - count)
                held.append(part)
                at, count = at + part.num_rows, count + part.num_rows
                if count == size:
                    yield block(held)
                    held, count = [], 0
        if held:
            yield block(held)

    return arrow_map(rows, run, "ids array<long>, labels array<string>, data binary")


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row and its squared distance. x: a part's components, each a row; book: entries, each a row."""
    code, far = np.zeros(x.shape[1], np.int64), np.zeros(x.shape[1], x.dtype)
    entries = book.astype(x.dtype)
    for at in range(0, x.shape[1], TILE):
        tile = x[:, at : at + TILE]
        total = np.zeros((len(book), tile.shape[1]), x.dtype)
        for d in range(len(x)):
            step = tile[d][None, :] - entries[:, d][:, None]
            step *= step
            total += step
        code[at : at + TILE] = best = total.argmin(axis=0)
        far[at : at + TILE] = total[best, np.arange(tile.shape[1])]
    return code, far


class Quantizer:
    """Codebooks (parts, entries, components of a part), in the integers that hold all distances."""

    def __init__(self, books: np.ndarray, scale: int, kind: type) -> None:
        self.books, self.scale, self.kind = books, scale, kind

    def columns(self, data: bytes) -> np.ndarray:
        """The components of a block as (parts, components of a part, rows)."""
        parts, _, width = self.books.shape
        return integers(np.frombuffer(data).reshape(parts, width, -1), self.scale, self.kind)

    def add(self, sums: tuple[np.ndarray, np.ndarray] | None, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Sums and counts of the entries with a block's parts added."""
        wide = object if self.kind is object else np.int64
        total, count = sums if sums is not None else (np.zeros(self.books.shape, wide), np.zeros(self.books.shape[:2], np.int64))
        for p, x in enumerate(self.columns(data)):
            code, _ = nearest(x, self.books[p])
            np.add.at(count[p], code, 1)
            for d in range(len(x)):
                np.add.at(total[p, :, d], code, x[d].astype(wide))
        return total, count

    def moved(self, total: np.ndarray, count: np.ndarray) -> Quantizer:
        """Entries at the floor of their means; unused ones where they were."""
        used = count > 0
        books = self.books.copy()
        books[used] = total[used] // count[used][:, None].astype(total.dtype)
        return Quantizer(books, self.scale, self.kind)

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()


def _merged(a: tuple | None, b: tuple | None) -> tuple | None:
    if a is None or b is None:
        return b if a is None else a
    return a[0] + b[0], a[1] + b[1]


def compress(
    table: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, block: int = 4096, label: str = "label"
) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 for each row of ``table`` (vec_id, embedding, label) that is kept."""
    spark = table.sparkSession
    scratch = Scratch(spark, "codes")
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), F.col(label).cast("string").alias("label"))
    rows = rows.filter(finite(F.col("v")))
    n, longest, top = rows.agg(F.count("*"), F.max(F.size("v")), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x))))).first()
    width = max(1, -(-(longest or 0) // parts))
    dims = parts * width
    # The largest distance of a part, or sum of components, decides which integers hold all.
    reach = (2 * (min(scale * (top or 0.0), 1e100) + 1)) ** 2 * max(dims, 1)
    kind = np.int32 if reach < 2.0**30 else np.int64 if max(reach, reach**0.5 * n) < 2.0**62 else object
    first = [list(r.v) + [0.0] * (dims - len(r.v)) for r in rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()]
    start = np.array(first, float).reshape(len(first), parts, width).transpose(1, 0, 2)
    made = Quantizer(integers(np.ascontiguousarray(start), scale, kind), scale, kind)
    packed = scratch.keep(_packed(rows, dims, max(1, min(block, (8 << 20) // max(8 * dims, 1)))), "packed")
    blocks = packed.select("data").rdd
    for _ in range(rounds if n else 0):
        given = spark.sparkContext.broadcast(made)
        sums = blocks.treeAggregate(None, lambda acc, row, given=given: given.value.add(acc, row.data), _merged, tree_depth(blocks))
        made = made.moved(*sums)
    last, digest = spark.sparkContext.broadcast(made), made.digest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = last.value
        for batch in batches:
            for ids, labels, data in zip(*(column(batch, c) for c in ("ids", "labels", "data")), strict=True):
                found = [nearest(x, b) for x, b in zip(book.columns(data.as_py()), book.books, strict=True)]
                digits = np.stack([c for c, _ in found], axis=1)
                code = ["".join(f"{c:02x}" for c in r) for r in digits.tolist()] if entries > 256 else [r.tobytes().hex() for r in digits.astype(np.uint8)]
                wide = object if book.kind is object else np.int64
                error = sum((far.astype(wide) for _, far in found), np.zeros(len(code), wide))
                error = [min(int(e), MOST) for e in error] if wide is object else pa.array(error)
                yield record("vec_id:long label:string code:string error:long", ids.values, labels.values, code, error)

    coded = scratch.keep(arrow_map(packed, run, "vec_id long, label string, code string, error long"), "codes")
    summed = F.least(F.sum(F.col("error").cast("decimal(19,0)")), F.lit(MOST).cast("decimal(38,0)")).cast("long")
    by_label = scratch.keep(coded.groupBy("label").agg(summed.alias("label_error")).withColumnRenamed("label", "l"), "labels")
    by_label = F.broadcast(by_label) if by_label.count() <= FEW_LABELS else by_label.hint("merge")
    out = coded.join(by_label, F.col("label").eqNullSafe(F.col("l")), "left")
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
