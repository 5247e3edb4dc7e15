"""Similarity joins over vectors in blocks.

Rows are packed where they are read and meet in the cells of a grid (see ``grid``); a task multiplies tiles of two groups
and emits only what the caller asks of the pair: pairs over a threshold, the best of each row, or sums. Work is the product of
the two sides, as it must be for an exact join; memory is two groups a task, and a row is copied about as often as the
square root of the number of cells.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plexure.operators import grid

TILE, HELD_BYTES, ADD_ROWS, SLICE_BYTES = 512, 16 << 20, 1 << 16, 8 << 20
Kernel = Callable[[dict, dict, np.ndarray, bool], dict[str, np.ndarray]]


Product = Callable[[np.ndarray, np.ndarray], np.ndarray]


class Side(NamedTuple):
    """Rows (id, v, tags) of a side of a join, with their number, the bytes of their vectors, and whether these are brought to length one."""

    rows: DataFrame
    count: int
    bytes: int
    unit: bool = True


def packed(df: DataFrame, id_col: str, vec: str, tags: list[str] = (), unit: bool = True) -> Side:
    """A side of a join. Null vectors have no part in it; ids and tags are longs."""
    columns = [F.col(id_col).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("v"), *[F.col(t).cast("long").alias(t) for t in tags]]
    rows = df.filter(F.col(vec).isNotNull()).select(*columns)
    count, numbers = rows.agg(F.count("*"), F.coalesce(F.sum(F.size("v")), F.lit(0))).first()
    return Side(rows, count, 8 * numbers, unit)


def matrix(v: pa.ChunkedArray) -> np.ndarray:
    """Lists of one length as rows; missing components are no numbers."""
    sizes = pc.unique(pc.list_value_length(v))
    if len(sizes) != 1:
        raise ValueError(f"vectors of {len(sizes)} lengths")
    x = np.empty((len(v), sizes[0].as_py()))
    at = 0
    for chunk in v.chunks:
        x[at : at + len(chunk)] = chunk.flatten().to_numpy(zero_copy_only=False).reshape(len(chunk), -1)
        at += len(chunk)
    return x


def _blocks(side: Side, groups: int, names: list[str]) -> DataFrame:
    """Rows of one group packed together: ids and tags as binary, vectors as a matrix of rows.

    Rows have length one unless the side says otherwise; zero stays zero.
    """
    unit = side.unit

    def block(held: list[pa.RecordBatch], group: int) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        x = matrix(t["v"])
        if unit:
            x = x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)
        known = {n: [t[n].fill_null(-1).to_numpy().tobytes()] for n in names}
        return pa.RecordBatch.from_pydict({"grp": pa.array([group], pa.int32()), "rows": pa.array([len(x)], pa.int32()), "data": [x.tobytes()]} | known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[pa.RecordBatch]] = {}
        size = 0
        for batch in batches:
            group = batch.column(batch.schema.get_field_index("grp")).to_numpy()
            for g in np.unique(group).tolist():
                held.setdefault(g, []).append(batch.filter(pa.array(group == g)))
            size += batch.nbytes
            if size > HELD_BYTES:
                for g, some in held.items():
                    yield block(some, g)
                held, size = {}, 0
        for g, some in held.items():
            yield block(some, g)
        held.clear()
        grid.release()

    schema = T._parse_datatype_string("grp int, rows int, data binary, " + ", ".join(f"{n} binary" for n in names))
    return side.rows.withColumn("grp", grid.group_of(groups, "id", "v")).mapInArrow(run, schema)


def block_join(
    left: Side, right: Side | None, kernel: Kernel, ddl: str, tags: list[str] = (), product: Product = lambda x, y: x @ y.T,
    at_end: Callable[[], Iterator[dict[str, np.ndarray]]] | None = None,
) -> DataFrame:
    """Apply ``kernel(left columns, right columns, products, same rows)`` to tiles that hold every pair of rows; without ``right``, each unordered pair once.

    ``product``: a matrix of scores from two matrices of rows, or whatever else the kernel takes of them; by default cosines.
    ``at_end``: what is left of a cell after its last tile, where the kernel adds up rather than gives rows (then it gives none).
    """
    names, alone = ["id", *tags], right is None
    tasks = grid.tasks_of(left.rows)
    if alone:
        i = j = grid.square(left.count, left.bytes, tasks)
    else:
        i, j = grid.rectangle((left.count, left.bytes), (right.count, right.bytes), tasks)
    cells = grid.in_cells(_blocks(left, i, names), None if alone else _blocks(right, j, names), i, j)
    schema = T._parse_datatype_string(ddl)

    def tiles(t: pa.Table) -> list[tuple[dict, np.ndarray]]:
        n = sum(t["rows"].to_pylist())
        if not n:
            return []
        x = np.frombuffer(b"".join(t["data"].to_pylist())).reshape(n, -1)
        known = {c: np.frombuffer(b"".join(t[c].to_pylist()), np.int64) for c in names}
        return [({c: v[at : at + TILE] for c, v in known.items()}, x[at : at + TILE]) for at in range(0, n, TILE)]

    def solve(a: pa.Table, b: pa.Table) -> Iterator[pa.RecordBatch]:
        one, two = tiles(a), tiles(b)
        # A cell of the diagonal holds one group, all on the left.
        inside = alone and bool(one) and len(set(divmod(a["cell"][0].as_py(), i))) == 1
        two = one if inside else two
        del a, b
        for p, (mine, x) in enumerate(one):
            for other, y in two[p:] if inside else two:
                found = kernel(mine, other, product(x, y), y is x)
                if found is not None:
                    yield pa.RecordBatch.from_pydict({f.name: pa.array(found[f.name]) for f in schema.fields})
        for found in at_end() if at_end is not None else ():
            yield pa.RecordBatch.from_pydict({f.name: pa.array(found[f.name]) for f in schema.fields})

    return cells.mapInArrow(lambda batches: grid.each_cell(batches, solve), schema)


def unit_rows(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)


def _with_rows(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A product of two tiles for kernels that also take their rows: cosines and both."""
    return unit_rows(x) @ unit_rows(y).T, x, y


def similar_terms(
    nodes: DataFrame, threshold: float, f: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], dict[str, np.ndarray]], ddl: str, id_col: str = "vec_id", vec: str = "embedding",
    tags: list[str] = (), at_end: Callable[[], Iterator[dict[str, np.ndarray]]] | None = None,
) -> DataFrame:
    """What ``f(ids or tags of src, of dst, weights, rows of src, rows of dst)`` gives for the pairs (src < dst) with a cosine over ``threshold``.

    It is worked out where both vectors are, so that no vector is shuffled for a pair. Columns of ``f`` are a pair's, or sums of those it is given.
    ``at_end``: what ``f``, which then may give None, has held back of a cell.
    """

    def kernel(a: dict, b: dict, s: tuple[np.ndarray, np.ndarray, np.ndarray], same: bool) -> dict[str, np.ndarray] | None:
        w, x, y = s
        i, j = np.nonzero(_each_once(w, same) & (w > threshold) & (a["id"][:, None] != b["id"][None, :]))
        if not len(i):
            return None
        step, found = max(1, SLICE_BYTES // max(8 * x.shape[1], 1)), []
        for at in range(0, len(i), step):
            p, q = i[at : at + step], j[at : at + step]
            first = a["id"][p] < b["id"][q]
            ends = [{c: np.where(first, a[c][p], b[c][q]) for c in a}, {c: np.where(first, b[c][q], a[c][p]) for c in a}]
            rows = [np.where(first[:, None], x[p], y[q]), np.where(first[:, None], y[q], x[p])]
            more = f(*ends, w[p, q], *rows)
            if more is not None:
                found.append(more)
        if len(found) < 2:
            return found[0] if found else None
        return {c: [v for r in found for v in r[c]] if isinstance(found[0][c], list) else np.concatenate([r[c] for r in found]) for c in found[0]}

    return block_join(packed(nodes, id_col, vec, tags, unit=False), None, kernel, ddl, tags, _with_rows, at_end)


def similar_ends(
    nodes: DataFrame, threshold: float, f: Callable[[np.ndarray, np.ndarray], dict[str, np.ndarray] | None], ddl: str, id_col: str = "vec_id", vec: str = "embedding",
    at_end: Callable[[], Iterator[dict[str, np.ndarray]]] | None = None,
) -> DataFrame:
    """What ``f(src, dst)`` gives for the ids of the pairs with a cosine over ``threshold``, where they are found. ``at_end``: as in ``block_join``."""

    def kernel(a: dict, b: dict, s: np.ndarray, same: bool) -> dict[str, np.ndarray] | None:
        link = s > threshold
        i, j = np.nonzero(np.triu(link, 1) if same else link)
        x, y = a["id"][i], b["id"][j]
        x, y = np.minimum(x, y), np.maximum(x, y)
        apart = x != y
        return f(x[apart], y[apart]) if apart.any() else None

    return block_join(packed(nodes, id_col, vec), None, kernel, ddl, at_end=at_end)


#: Share of a tile's pairs from which its sums are a product of matrices rather than one of rows.
DENSE = 0.05


def similar_sums(nodes: DataFrame, threshold: float, id_col: str = "vec_id", vec: str = "embedding", payload: str | None = None) -> DataFrame:
    """id, n and total: how many other rows have a cosine over ``threshold`` with each row, and the sum of their ``payload`` vectors (by default the rows themselves).

    A cell adds up all its pairs before anything is shuffled, so that what is shuffled follows the rows and groups, not the pairs. Rows without partners
    are absent. Payloads have one length.
    """
    column, dims = F.col(vec), 0
    if payload is not None:
        dims = nodes.filter(F.col(vec).isNotNull()).agg(F.max(F.size(vec))).first()[0] or 0
        column = F.concat(F.col(vec), F.col(payload))
    rows = nodes.filter(F.col(vec).isNotNull()).select(F.col(id_col).alias("_id"), column.cast("array<double>").alias("_v"))
    held: dict[int, list[np.ndarray]] = {}

    def product(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        d = dims or x.shape[1]
        return unit_rows(x[:, :d]) @ unit_rows(y[:, :d]).T, x[:, d:] if dims else x, y[:, d:] if dims else y

    def near(link: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The number of links of each row, and the sums of what they lead to."""
        i, j = np.nonzero(link)
        if len(i) > DENSE * link.size:
            return np.column_stack([link.sum(axis=1), link.astype(float) @ x])
        out = np.zeros((len(link), x.shape[1] + 1))
        if len(i):
            first = np.flatnonzero(np.append(True, i[1:] != i[:-1]))
            out[i[first], 0] = np.diff(np.append(first, len(i)))
            out[i[first], 1:] = np.add.reduceat(x[j], first)
        return out

    def kernel(a: dict, b: dict, s: tuple[np.ndarray, np.ndarray, np.ndarray], same: bool) -> None:
        w, x, y = s
        link = (w > threshold) & (a["id"][:, None] != b["id"][None, :])
        for ids, sums in ((a["id"], near(link, y)),) if same else ((a["id"], near(link, y)), (b["id"], near(link.T, x))):
            key = ids.ctypes.data  # a tile's own ids stay where they are for the whole cell
            if key in held:
                held[key][1] += sums
            else:
                held[key] = [ids, sums]

    def at_end() -> Iterator[dict[str, np.ndarray]]:
        for ids, sums in held.values():
            some = sums[:, 0] > 0
            yield {"id": ids[some], "n": sums[some, 0].astype(np.int64), "total": [r.tobytes() for r in sums[some, 1:]]}
        held.clear()

    found = block_join(packed(rows, "_id", "_v", unit=False), None, kernel, "id long, n long, total binary", product=product, at_end=at_end)

    def add(t: pa.Table) -> pa.Table:
        x = np.frombuffer(b"".join(t["total"].to_pylist())).reshape(t.num_rows, -1)
        ids, at = np.unique(t["id"].to_numpy(), return_inverse=True)
        order = np.argsort(at, kind="stable")
        first = np.searchsorted(at[order], np.arange(len(ids)))
        n = np.add.reduceat(t["n"].to_numpy()[order], first)
        return pa.table({"id": ids, "n": n, "total": list(np.add.reduceat(x[order], first))})

    parts = max(1, grid.tasks_of(nodes))
    spread = found.repartition(parts, "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_rows: list[pa.Table] = []
        size, most = 0, ADD_ROWS
        for batch in batches:
            held_rows.append(pa.Table.from_batches([batch]))
            size += batch.num_rows
            if size > most:
                t = packed_again(held_rows)
                held_rows, size = [t], t.num_rows
                most = max(ADD_ROWS, 2 * size)
        if held_rows:
            yield from add(pa.concat_tables(held_rows)).to_batches(4096)

    def packed_again(some: list[pa.Table]) -> pa.Table:
        t = add(pa.concat_tables(some))
        return pa.table({"id": t["id"], "n": t["n"], "total": [np.asarray(v).tobytes() for v in t["total"].to_numpy()]})

    return spread.mapInArrow(run, "id long, n long, total array<double>")


def _each_once(s: np.ndarray, same: bool) -> np.ndarray:
    return np.triu(np.ones(s.shape, bool), 1) if same else np.ones(s.shape, bool)


def similar_pairs(
    nodes: DataFrame, threshold: float, id_col: str = "vec_id", vec: str = "embedding", tag: str | None = None, tag_weight: float = 1.0
) -> DataFrame:
    """src < dst and weight: pairs with a cosine over ``threshold``; with ``tag``, pairs of equal tags have ``tag_weight`` instead."""
    tags = [tag] if tag else []

    def kernel(a: dict, b: dict, s: np.ndarray, same: bool) -> dict[str, np.ndarray]:
        link = s > threshold
        if tag:
            link |= (a[tag][:, None] == b[tag][None, :]) & (a[tag] >= 0)[:, None]
        i, j = np.nonzero(np.triu(link, 1) if same else link)
        w = s[i, j]
        if tag:
            w[(a[tag][i] == b[tag][j]) & (a[tag][i] >= 0)] = tag_weight
        x, y = a["id"][i], b["id"][j]
        return {"src": np.minimum(x, y), "dst": np.maximum(x, y), "weight": w}

    blocks = packed(nodes, id_col, vec, tags)
    return block_join(blocks, None, kernel, "src long, dst long, weight double", tags).filter("src <> dst")


def top_similar(
    queries: DataFrame, candidates: DataFrame, k: int, id_col: str = "vec_id", vec: str = "embedding", threshold: float | None = None,
    or_best: bool = False, without_self: bool = True,
) -> DataFrame:
    """query_id, vec_id, score, rank: each query's k most similar candidates, ties to the smaller id.

    threshold: only scores over it. or_best: the best candidate of a query that has none over the threshold.
    k is clamped to what there is.
    """
    sides = packed(queries, id_col, vec), packed(candidates, id_col, vec)
    return top_of(*sides, k, threshold, or_best, without_self)


def top_of(
    queries: Side, candidates: Side, k: int, threshold: float | None = None, or_best: bool = False, without_self: bool = True,
    product: Product = lambda x, y: x @ y.T,
) -> DataFrame:
    """``top_similar`` of two sides by any product of their rows."""

    def kernel(a: dict, b: dict, s: np.ndarray, same: bool) -> dict[str, np.ndarray]:
        order = np.argsort(b["id"], kind="stable")
        ids, s = b["id"][order], s[:, order]
        if without_self:
            s = np.where(a["id"][:, None] == ids[None, :], -np.inf, s)
        m = min(k, s.shape[1])
        bar = np.partition(s, s.shape[1] - m, axis=1)[:, -m]
        over = np.isfinite(s) & (s >= bar[:, None])
        if threshold is not None and not or_best:
            over &= s > threshold
        i, j = np.nonzero(over)
        order = np.lexsort((j, -s[i, j], i))
        i, j = i[order], j[order]
        first = np.searchsorted(i, i, "left")
        best = np.arange(len(i)) - first < m  # of equal scores at the bar, those of the smaller ids
        i, j = i[best], j[best]
        return {"query_id": a["id"][i], "vec_id": ids[j], "score": s[i, j]}

    found = block_join(queries, candidates, kernel, "query_id long, vec_id long, score double", product=product)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= k)
    if threshold is not None and or_best:
        ranked = ranked.filter((F.col("score") > threshold) | (F.col("rank") == 1))
    return ranked


def pair_mean(nodes: DataFrame, f: Callable[[np.ndarray], np.ndarray], id_col: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """One row: total and pairs, of ``f`` of the cosine over unordered pairs."""

    def kernel(a: dict, b: dict, s: np.ndarray, same: bool) -> dict[str, np.ndarray]:
        v = f(s[_each_once(s, same)])
        return {"total": np.array([v.sum()]), "pairs": np.array([v.size])}

    return block_join(packed(nodes, id_col, vec), None, kernel, "total double, pairs long").agg(F.sum("total").alias("total"), F.sum("pairs").alias("pairs"))


#: Pairs that a task holds before it gives the lists of their ends.
LISTED = 1 << 20


def similar_lists(nodes: DataFrame, threshold: float, id_col: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """id and others (packed longs): for each row those with a cosine over ``threshold``, in a list a cell or part of one, so that a pair is 16 bytes, not two rows."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def lists() -> Iterator[dict[str, np.ndarray]]:
        if held:
            a, b = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            ends, others = np.append(a, b), np.append(b, a)
            order = np.lexsort((others, ends))
            ends, others = ends[order], others[order]
            first = np.flatnonzero(np.append(True, ends[1:] != ends[:-1])) if len(ends) else np.zeros(0, int)
            yield {"id": ends[first], "others": [o.tobytes() for o in np.split(others, first[1:])] if len(ends) else []}

    def kernel(a: dict, b: dict, s: np.ndarray, same: bool) -> dict[str, np.ndarray] | None:
        i, j = np.nonzero(_each_once(s, same) & (s > threshold) & (a["id"][:, None] != b["id"][None, :]))
        if len(i):
            held.append((a["id"][i], b["id"][j]))
        return next(lists()) if sum(len(x) for x, _ in held) >= LISTED else None

    return block_join(packed(nodes, id_col, vec), None, kernel, "id long, others binary", at_end=lists)
