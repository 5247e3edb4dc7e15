"""Exact top-k by inner products of integer vectors.

Method: exhaustive, term at a time. Candidates stand in blocks whose postings are, for each component, the rows
where it is not zero and their weights. A tile of query rows goes through the components; each one that is not
zero in a query scatters its weighted posting into the query's dense score array. Partition selection keeps a
block's best k, and a merge keeps the best of all blocks.

At scale: queries and candidates are packed where they are read and meet in the cells of a grid, whose sides follow the
sizes of both (see ``plexure.operators.grid``): candidates are copied once for each group of queries, of which there are few,
queries once for each group of candidates. A cell goes through its candidates block by block, keeps k rows a query, and
only those leave the task.

Defined results: vectors that are null or empty or hold null or non-finite numbers take no part; a zero vector does, with
score 0. Missing components of a shorter vector are 0. Ties go to the smaller vec_id. Rows that share a query's
vec_id are its own rows; rows that share another vec_id count once, with their best score. Scores beyond 64 bits
are held at the bounds. Null vec_ids take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plexure.llm.common import arrow_map, column, record
from plexure.llm.vectors import usable
from plexure.operators import grid

TILE, MOST_HELD = 32, 2_000_000
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def _block(held: list[tuple[int, list[float]]], group: int, scale: int) -> pa.RecordBatch:
    """ids and floor(scale * x) of rows, packed; the values are 64-bit, or text where that is too small."""
    dims = max(len(v) for _, v in held)
    x = np.zeros((len(held), dims))
    for i, (_, v) in enumerate(held):
        x[i, : len(v)] = v
    big = np.abs(x).max() * scale >= 1 << 62
    wide = [[int(np.floor(float(scale) * c)) if np.isfinite(scale * c) else int(c) * scale for c in r] for r in x.tolist()] if big else []
    data = b"" if big else np.floor(scale * x).astype(np.int64).tobytes()
    ids = np.array([i for i, _ in held], np.int64).tobytes()
    return record("grp:int ids:binary dims:int data:binary wide:string", [group], [ids], [dims], [data], [repr(wide) if big else None])


def _blocks(rows: DataFrame, groups: int, scale: int, size: int) -> DataFrame:
    """Blocks of at most ``size`` rows of one group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[int, list[float]]]] = {}
        count = 0
        for batch in batches:
            for g, i, v in zip(*(column(batch, c).to_pylist() for c in ("grp", "vec_id", "v")), strict=True):
                some = held.setdefault(g, [])
                some.append((i, v))
                count += len(v)
                if len(some) == size:
                    yield _block(some, g, scale)
                    count -= sum(len(v) for _, v in some)
                    del held[g]
            if count > MOST_HELD:
                for g, some in held.items():
                    yield _block(some, g, scale)
                held, count = {}, 0
        for g, some in held.items():
            yield _block(some, g, scale)

    return arrow_map(rows.withColumn("grp", grid.group_of(groups, "vec_id", "v")), run, "grp int, ids binary, dims int, data binary, wide string")


def _unpack(ids: bytes, dims: int, data: bytes, wide: str | None) -> tuple[np.ndarray, np.ndarray]:
    if wide is not None:
        import ast

        return np.frombuffer(ids, np.int64), np.array(ast.literal_eval(wide), object)
    return np.frombuffer(ids, np.int64), np.frombuffer(data, np.int64).reshape(-1, dims)


def accumulate(queries: np.ndarray, candidates: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(first query row, dense scores) for tiles of query rows, component by component over postings."""
    dims = min(queries.shape[1], candidates.shape[1])
    wide = queries.dtype == object or candidates.dtype == object
    top = 0 if wide else float(np.abs(queries).max(initial=0)) * float(np.abs(candidates).max(initial=0)) * dims
    kind = object if wide or top >= 2.0**63 else np.int64 if top >= 2.0**31 else np.int32
    q, c = queries[:, :dims].astype(kind), candidates[:, :dims].astype(kind)
    postings = [(r, c[r, t]) if len(r := np.flatnonzero(c[:, t])) < len(c) else (None, np.ascontiguousarray(c[:, t])) for t in range(dims)]
    spare = np.empty((TILE, len(c)), kind)
    for at in range(0, len(q), TILE):
        tile = q[at : at + TILE]
        scores = np.zeros((len(tile), len(c)), kind)
        for t, (rows, weights) in enumerate(postings):
            some = np.flatnonzero(tile[:, t])
            if not len(some) or not len(weights):
                continue
            if rows is None and len(some) == len(tile):
                np.multiply(tile[:, t, None], weights[None, :], out=spare[: len(tile)])
                scores += spare[: len(tile)]
            else:
                scores[some if rows is None else np.ix_(some, rows)] += tile[some, t, None] * weights[None, :]
        yield at, np.clip(scores, _LEAST, _MOST) if kind is object else scores


def best(scores: np.ndarray, ids: np.ndarray, own: int, k: int) -> np.ndarray:
    """Places of the k best scores of one query, best first, ties to the smaller id; ``ids`` ascend."""
    at = np.flatnonzero(ids != own)
    s = scores[at]
    if len(at) > k:
        if s.dtype == object:
            at = at[np.argsort(-s, kind="stable")[:k]]
        else:
            bar = np.partition(s, len(s) - k)[len(s) - k]
            over, equal = at[s > bar], at[s == bar]
            at = np.concatenate([over, equal[: k - len(over)]])
    return at[np.lexsort((ids[at], -scores[at]))] if scores.dtype != object else np.array(sorted(at, key=lambda i: (-scores[i], ids[i])), int)


def _together(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """ids and values of all blocks of one side of a cell, by ascending id; shorter rows are filled with zeros."""
    parts = [_unpack(r["ids"], r["dims"], r["data"], r["wide"]) for r in t.to_pylist()]
    if not parts:
        return np.zeros(0, np.int64), np.zeros((0, 1), np.int64)
    ids = np.concatenate([i for i, _ in parts])
    values = np.zeros((len(ids), max(v.shape[1] for _, v in parts)), object if any(v.dtype == object for _, v in parts) else np.int64)
    at = 0
    for _, v in parts:
        values[at : at + len(v), : v.shape[1]] = v
        at += len(v)
    order = np.argsort(ids, kind="stable")
    return ids[order], values[order]


def _merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of two rows of (ids, scores) for each query, the k best, ties to the smaller id."""
    ids, scores = (np.concatenate(x, axis=1) for x in zip(a, b, strict=True))
    order = np.lexsort((ids, -scores), axis=1)[:, :k]
    return np.take_along_axis(ids, order, 1), np.take_along_axis(scores, order, 1)


def cell_best(qids: np.ndarray, q: np.ndarray, cids: np.ndarray, c: np.ndarray, k: int, block: int) -> Iterator[pa.RecordBatch]:
    """query_id, vec_id, score: the k best of a cell for each of its queries; more, if its candidates share ids or have scores beyond 64 bits."""
    if not len(qids) or not len(cids):
        return
    # Rows that share a vec_id would crowd out others: ask for as many more.
    more = len(cids) - len(np.unique(cids))
    alone = not more and q.dtype != object and c.dtype != object and len(cids) > block
    kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for first in range(0, len(cids), block):
        ids, part = cids[first : first + block], c[first : first + block]
        for at, scores in accumulate(q, part):
            picked = [best(row, ids, own, k + more) for row, own in zip(scores, qids[at : at + len(scores)], strict=True)]
            if alone and min(map(len, picked)) == k:
                found = np.stack([ids[p] for p in picked]), np.stack([row[p] for row, p in zip(scores, picked, strict=True)]).astype(np.int64)
                kept[at] = _merged(kept[at], found, k) if at in kept else found
                continue
            yield record(
                "query_id:long vec_id:long score:long", np.repeat(qids[at : at + len(scores)], [len(p) for p in picked]).tolist(),
                np.concatenate([ids[p] for p in picked]).tolist(), [int(s) for row, p in zip(scores, picked, strict=True) for s in row[p]],
            )
    for at, (ids, scores) in kept.items():
        yield record("query_id:long vec_id:long score:long", pa.array(np.repeat(qids[at : at + len(ids)], k)), pa.array(ids.ravel()), pa.array(scores.ravel()))


def top_products(table: DataFrame, every: int = 100, k: int = 10, scale: int = 1024, block: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible by ``every``, its k best others."""
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.filter(usable(F.col("v")) & F.col("vec_id").isNotNull())
    ask = F.col("vec_id") % every == 0
    size = F.coalesce(F.size("v") * 8, F.lit(0))
    total = [F.count("*"), F.coalesce(F.sum(size), F.lit(0)), F.count(F.when(ask, 1)), F.coalesce(F.sum(F.when(ask, size)), F.lit(0))]
    n, n_bytes, asked, asked_bytes = rows.agg(*total).first()
    i, j = grid.rectangle((asked, asked_bytes), (n, n_bytes), grid.tasks_of(rows))
    cells = grid.in_cells(_blocks(rows.filter(ask), i, scale, block), _blocks(rows, j, scale, block), i, j)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return grid.each_cell(batches, lambda a, b: cell_best(*_together(a), *_together(b), k, block))

    found = arrow_map(cells, run, "query_id long, vec_id long, score long").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
