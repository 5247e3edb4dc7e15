"""Near-duplicate vectors by a pivot-permutation index.

Method: every vector is described by its ``depth`` nearest of a set of reference points, in order. Inverted lists
hold, for each point, the vectors that have it among their ``heads`` nearest ones. Within a list, the points that pairs
share are counted over their whole descriptions by inverted lists of the rows at hand. Candidates are the pairs with
one nearest point, and the pairs of a list that share at least ``shared`` points; only those are verified, by their cosines
in double precision. A pair with one nearest point counts in that point's list only, any other in the list of the least
point that both have among their heads.

The points are vectors of the table itself, those with the least hashes of their content: a bounded sample, four times
the square root of the table's size, ``most_points`` at most and ``most_bytes`` of numbers. Their mean is taken off points and rows
before they are compared, so that a table whose vectors all point one way is told apart by what is left. A point whose cosine with an
earlier one is then over ``apart`` is left out, so that a dense group has about one point, which all its members share, and
not hundreds, among which noise would choose. All rows are indexed.

The narrower a table, the less is left of a cosine of ``least`` once the mean is gone. So the index measures its recall: points
of the sample meet copies of themselves at exactly that cosine, in random directions, without being points to either, and the least
of the ``LADDER`` of depths and heads that finds a share of ``recall`` of them is taken. If none finds nine in ten, there
is one list of all rows, in which all pairs are compared.

At scale: equal vectors collapse to one with a weight first, so that a very common vector is one row. Lists grow with
the square root of the table as long as the points do. A list is cut into blocks, of ``block`` rows and more in longer lists, up to
``MOST_BLOCK_BYTES``, so that a row is copied about as often as the square root of its list is long; a task holds two
blocks at a time, as packed numbers, and compares them tile by tile. Rows of a list that are many and have one nearest point, which is another, get blocks
of their own, which do not meet each other, so that a dense group is compared once and not in each list that its
members share. Pairs are never emitted: each pair of blocks gives the number of links of its vectors and a forest of
links that joins what is linked there. Components come from those forests by alternating large-star and small-star.

Defined results: vectors that are null, empty or zero, or hold null or non-finite numbers, link with nothing. Vectors
of different length do not link. Rows that share a vec_id are one vector as far as components go; null vec_ids
link with nothing. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plexure.llm.common import Scratch, arrow_map, column, opaque, record
from plexure.llm.components import connected_components
from plexure.llm.vectors import usable


#: Depths of descriptions and numbers of heads, from the cheapest on; and how large a block of a long list may be.
LADDER = ((16, 6), (24, 8), (32, 12), (48, 16), (64, 24))
MOST_BLOCK_BYTES, TILE = 8 << 20, 512


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision; scaled first so that squares neither overflow nor vanish."""
    v = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def thinned(points: np.ndarray, apart: float, step: int = 1024) -> np.ndarray:
    """Those of the unit rows whose cosine with each kept before is ``apart`` at most."""
    kept = np.zeros_like(points)
    n = 0
    for at in range(0, len(points), step):
        part = points[at : at + step]
        far = np.ones(len(part), bool) if not n else (part @ kept[:n].T).max(axis=1) <= apart
        first = n
        for p in part[far]:
            if n == first or (kept[first:n] @ p).max() <= apart:
                kept[n] = p
                n += 1
    return kept[:n]


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of n rows the least row it reaches over the links a-b."""
    low = np.arange(n)
    while True:
        m = np.minimum(low[a], low[b])
        new = low.copy()
        np.minimum.at(new, a, m)
        np.minimum.at(new, b, m)
        new = new[new]
        if (new == low).all():
            return low
        low = new


def _joined(low: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least row that each row reaches, with the links a-b added to those that made ``low``."""
    apart = low[a] != low[b]
    return _forest(low[a[apart]], low[b[apart]], len(low))[low] if apart.any() else low


def shared_counts(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many points each row of ``left`` shares with each of ``right``, by inverted lists of both sides' rows.

    A point of many rows of both sides is added as a rectangle, the others as single entries.
    """
    out = np.zeros((len(left), len(right)), np.int16)
    rows_l, rows_r = (np.argsort(x.ravel(), kind="stable") // x.shape[1] for x in (left, right))
    point_l, size_l = np.unique(left, return_counts=True)
    point_r, size_r = np.unique(right, return_counts=True)
    start_l, start_r = np.cumsum(size_l) - size_l, np.cumsum(size_r) - size_r
    _, i, j = np.intersect1d(point_l, point_r, assume_unique=True, return_indices=True)
    wide = size_l[i] * size_r[j] > out.size // 64
    for p, q in zip(i[wide].tolist(), j[wide].tolist(), strict=True):
        out[np.ix_(rows_l[start_l[p] : start_l[p] + size_l[p]], rows_r[start_r[q] : start_r[q] + size_r[q]])] += 1
    i, j = i[~wide], j[~wide]
    each = size_l[i] * size_r[j]
    if each.sum():
        place = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
        width = np.repeat(size_r[j], each)
        a = rows_l[np.repeat(start_l[i], each) + place // width]
        b = rows_r[np.repeat(start_r[j], each) + place % width]
        out += np.bincount(a * len(right) + b, minlength=out.size).reshape(out.shape).astype(np.int16)
    return out


class Index(NamedTuple):
    """Reference points without the mean, what the mean gives with each, and how many nearest ones describe a row and make its lists."""

    points: np.ndarray
    shift: np.ndarray
    depth: int
    heads: int

    def near(self, x: np.ndarray) -> np.ndarray:
        return x @ self.points[:, : x.shape[1]].T - self.shift

    def codes(self, near: np.ndarray) -> np.ndarray:
        """The nearest points of each row, in order."""
        top = np.argpartition(-near, self.depth - 1, axis=1)[:, : self.depth]
        order = np.take_along_axis(near, top, 1).argsort(axis=1)[:, ::-1]
        return np.take_along_axis(top, order, 1).astype(np.int32)


def candidates(a: np.ndarray, b: np.ndarray, heads: int, shared: int) -> np.ndarray:
    """Whether each row of codes ``a`` is a candidate with the same row of ``b``."""
    both = (a[:, :, None] == b[:, None, :]).any(axis=2).sum(axis=1)
    head = (a[:, :heads, None] == b[:, None, :heads]).any(axis=(1, 2))
    return (a[:, 0] == b[:, 0]) | (head & (both >= shared))


def fitted(drawn: np.ndarray, apart: float, least: float, shared: int, recall: float, asked: int = 512, seed: int = 5) -> Index:
    """The index over drawn unit rows: the cheapest of the ladder with the recall that is wanted, or one list."""
    one = Index(drawn[:1], np.zeros(min(1, len(drawn))), 1, 1)
    if len(drawn) < 2:
        return one
    mean = drawn.mean(axis=0)
    rest = drawn - mean
    size = np.sqrt((rest * rest).sum(axis=1))
    points = thinned(rest[size > 1e-6] / size[size > 1e-6, None], apart)
    if not len(points):
        return one
    shift = points @ mean
    if len(points) < 64:  # too few to leave one out
        return Index(points, shift, min(LADDER[0][0], len(points)), min(LADDER[0][1], len(points)))
    rng = np.random.default_rng(seed)
    x = drawn[:asked]
    side = rng.normal(size=x.shape)
    side -= (side * x).sum(axis=1, keepdims=True) * x
    y = least * x + math.sqrt(1 - least * least) * unit_rows(side)
    own = ((rest[:asked] / np.maximum(size[:asked, None], 1e-12)) @ points.T).argmax(axis=1)
    best, found = one, 0.0
    for depth, heads in LADDER:
        index = Index(points, shift, min(depth, len(points) - 1), heads)
        near = [index.near(v) for v in (x, y)]
        for n in near:
            n[np.arange(len(x)), own] = -np.inf  # a point would be nearest to itself
        share = candidates(*(index.codes(n) for n in near), heads, min(shared, index.depth)).mean()
        if share > found:
            best, found = index, share
        if share >= recall:
            break
    return best if found >= 0.9 else one


def _least_head(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least point that is in both rows' heads, pair by pair; a great number if there is none."""
    both = (a[:, :, None] == b[:, None, :]).any(axis=2)
    return np.where(both, a, np.iinfo(np.int32).max).min(axis=1)


def block_links(
    x: np.ndarray, codes: np.ndarray, first: np.ndarray, second: np.ndarray, point: int, heads: int, shared: int, least: float
) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs (rows of ``first`` and ``second``) that count in the list of ``point``."""
    home = codes[:, 0]
    alike = home[first][:, None] == home[second][None, :]
    near = np.where(alike, (home[first] == point)[:, None], False)
    if not alike.all():
        near |= ~alike & (shared_counts(codes[first], codes[second]) >= shared)
    if first is second:
        near = np.triu(near, 1)
    i, j = np.nonzero(near)
    if len(i) * 4 > near.size:
        ok = (x[first] @ x[second].T)[i, j] >= least
    else:
        ok = np.zeros(len(i), bool)
        for at in range(0, len(i), 20_000):
            part = slice(at, at + 20_000)
            ok[part] = np.einsum("ij,ij->i", x[first[i[part]]], x[second[j[part]]]) >= least
    a, b = first[i[ok]], second[j[ok]]
    keep = home[a] == home[b]
    for at in range(0, len(a), 20_000):
        part = slice(at, at + 20_000)
        keep[part] |= (_least_head(codes[a[part], :heads], codes[b[part], :heads]) == point)
    return a[keep], b[keep]


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id, key (a 128-bit hash of the numbers; -0.0 and 0.0 are one), dims, unit (packed)."""
    for batch in batches:
        lists, ids = column(batch, "v"), column(batch, "vec_id")
        flat, ends = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
        starts, size = ends[:-1] - ends[0], np.diff(ends)
        for width in np.unique(size).tolist():
            here = np.flatnonzero(size == width)
            x = flat[starts[here][:, None] + np.arange(width)] + 0.0
            keys = [xxhash.xxh3_128_digest(r.tobytes()) for r in x]
            units = [r.tobytes() for r in unit_rows(x)]
            yield record("vec_id:long key:binary dims:int unit:binary", ids.take(pa.array(here)), keys, [width] * len(here), units)


def _matrix(data: pa.ChunkedArray | pa.Array, kind: type, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(data.to_pylist()), kind).reshape(-1, width)


def near_vectors(
    table: DataFrame, least: float = 0.95, shared: int = 4, most_points: int = 1 << 16, most_bytes: int = 1 << 26, block: int = 512,
    apart: float = 0.7, recall: float = 0.99,
) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``table`` (vec_id, embedding): links are cosines of ``least`` or more."""
    spark = table.sparkSession
    scratch = Scratch(spark, "vector-dedup")
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    ok = rows.filter(usable(F.col("v")) & F.exists("v", lambda x: x != 0) & F.col("vec_id").isNotNull())
    packed = scratch.keep(arrow_map(ok, _packed, "vec_id long, key binary, dims int, unit binary"), "packed")
    nodes = packed.groupBy("key").agg(F.min("vec_id").alias("node"), F.count("*").alias("weight"), F.min("dims").alias("dims"), F.any_value("unit").alias("unit"))
    nodes = scratch.keep(nodes, "nodes")

    n, dims = nodes.agg(F.count("*"), F.coalesce(F.max("dims"), F.lit(1))).first()
    points = min(most_points, max(16, most_bytes // (8 * dims)), max(64, 1 << math.ceil(math.log2(max(4 * math.sqrt(n), 1)))))
    drawn = sorted((bytes(r.key), r.dims, bytes(r.unit)) for r in nodes.select("key", "dims", "unit").orderBy(F.xxhash64("key"), "key").limit(points).collect())
    centre = np.zeros((len(drawn), dims))
    for i, (_, width, unit) in enumerate(drawn):
        centre[i, :width] = np.frombuffer(unit)
    index = fitted(centre, apart, least, shared, recall)
    given = spark.sparkContext.broadcast(index)
    depth, heads = index.depth, index.heads
    shared = min(shared, depth)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(16, (1 << 22) // max(1, len(given.value.points)))
        for batch in batches:
            size = column(batch, "dims").to_numpy()
            for width in np.unique(size).tolist():
                part = batch.take(pa.array(np.flatnonzero(size == width)))
                x = _matrix(column(part, "unit"), np.float64, width)
                for at in range(0, len(x), step):
                    codes = given.value.codes(given.value.near(x[at : at + step]))
                    some = part.slice(at, step)
                    yield record(
                        "node:long weight:long dims:int unit:binary home:int heads:ints codes:binary", *(column(some, c) for c in ("node", "weight", "dims", "unit")),
                        pa.array(codes[:, 0]), codes[:, :heads].tolist(), [r.tobytes() for r in codes],
                    )

    kinds = "node long, weight long, dims int, unit binary, home int, heads array<int>, codes binary"
    coded = scratch.keep(arrow_map(nodes.select("node", "weight", "dims", "unit"), describe, kinds), "codes")
    # Own blocks for at most ``heads`` * 4096 parts of lists.
    lists = coded.select("home", F.explode("heads").alias("point"))
    own_from = max(block, -(-n // 4096))
    parts_of = lists.groupBy("point", "home").agg(F.count("*").alias("n")).withColumn("own", (F.col("n") >= own_from) & (F.col("home") != F.col("point")))
    parts_of = scratch.keep(parts_of, "parts")
    most_block = max(block, min(8192, MOST_BLOCK_BYTES // (8 * dims)))
    rows_of = parts_of.groupBy("point").agg(F.sum("n").alias("all"))
    rows_of = rows_of.select(F.col("point").alias("bp"), F.greatest(F.lit(block), F.least(F.lit(most_block), F.ceil(F.sqrt("all")) * 8)).cast("int").alias("block"))
    parts_of = parts_of.join(F.broadcast(rows_of), F.col("point") == F.col("bp")).drop("bp")  # a row a point
    size = F.ceil(F.col("n") / F.col("block")).cast("int")
    cuts = parts_of.groupBy("point").agg(
        F.ceil(F.sum(F.when(~F.col("own"), F.col("n")).otherwise(0)) / F.any_value("block")).cast("int").alias("mixed"),
        F.sum(F.when(F.col("own"), size).otherwise(0)).cast("int").alias("rest"),
    )
    cuts = cuts.select(F.col("point").alias("p"), "mixed", (F.col("mixed") + F.col("rest")).alias("nb"))
    cells = int(cuts.agg(F.coalesce(F.sum(F.col("nb") * (F.col("nb") + 1) / 2), F.lit(0))).first()[0])
    own = parts_of.filter("own").select(
        F.col("point").alias("op"), F.col("home").alias("oh"), size.alias("on"),
        (F.sum(size).over(Window.partitionBy("point").orderBy("home")) - size).cast("int").alias("before"),
    )
    carried = ["node", "weight", "dims", "unit", "codes", "point", "mine"]
    dealt = coded.withColumn("point", F.explode("heads")).join(F.broadcast(cuts), F.col("point") == F.col("p"))
    dealt = dealt.join(F.broadcast(own), (F.col("point") == F.col("op")) & (F.col("home") == F.col("oh")), "left")
    slot = F.abs(F.xxhash64("node") % F.lit(1 << 30))
    dealt = dealt.withColumn("start", F.col("mixed") + F.col("before")).withColumn("mine", F.coalesce(F.col("start") + slot % F.col("on"), slot % F.col("mixed")).cast("int"))
    every = F.sequence(F.lit(0), F.col("nb") - 1)
    meets = F.when(F.col("start").isNull(), every).otherwise(F.filter(every, lambda k: (k < F.col("start")) | (k >= F.col("start") + F.col("on"))))
    dealt = dealt.select(*carried, F.explode(meets).alias("other")).select(*carried, F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))

    def solve(held: list[pa.RecordBatch], key: tuple) -> pa.RecordBatch | None:
        point, i, j = key
        t = pa.Table.from_batches(held)
        node, weight, mine, size = (t[c].to_numpy() for c in ("node", "weight", "mine", "dims"))
        if len(node) < 2:
            return None
        codes = _matrix(t["codes"], np.int32, depth)
        links, low = np.zeros(len(node)), np.arange(len(node))
        for width in np.unique(size).tolist():
            here = np.flatnonzero(size == width)
            x = np.zeros((len(node), width))
            x[here] = _matrix(t["unit"].take(pa.array(here)), np.float64, width)
            first = here[mine[here] == i]
            second = first if i == j else here[mine[here] == j]
            ones, others = ([part[at : at + TILE] for at in range(0, len(part), TILE)] for part in (first, second))
            for k, one in enumerate(ones):
                for other in [one, *ones[k + 1 :]] if i == j else others:
                    a, b = block_links(x, codes, one, other, point, heads, shared, least)
                    if len(a):
                        links += np.bincount(a, weight[b], len(node)) + np.bincount(b, weight[a], len(node))
                        low = _joined(low, a, b)
        if not links.any():
            return None
        root = node[low]
        seen = np.flatnonzero(links)
        return record("u:long v:long links:long", pa.array(node[seen]), pa.array(root[seen]), pa.array(links[seen].astype(np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None
        for batch in batches:
            k = np.stack([column(batch, c).to_numpy() for c in ("point", "i", "j")])
            starts = [0, *(np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1), batch.num_rows]
            for s, e in zip(starts, starts[1:], strict=False):
                if s == e:
                    continue
                new = tuple(int(v) for v in k[:, s])
                if new != key:
                    if held and (out := solve(held, key)) is not None:
                        yield out
                    held, key = [], new
                held.append(batch.slice(s, e - s))
        if held and (out := solve(held, key)) is not None:
            yield out

    # Some pairs of blocks a task, whatever the size of the table.
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(cells // 64, 100_000), 1)
    by_cell = dealt.repartition(parts, "point", "i", "j").sortWithinPartitions("point", "i", "j")
    found = scratch.keep(arrow_map(by_cell, run, "u long, v long, links long"), "found")
    links = found.groupBy("u").agg(F.sum("links").alias("links")).select(F.col("u").alias("lk"), "links")
    comps = connected_components(scratch, found.select("u", "v")).select(F.col("node").alias("ck"), "component")
    of_node = nodes.select("node", "key", "weight").join(links, F.col("node") == F.col("lk"), "left").join(comps, F.col("node") == F.col("ck"), "left")
    of_node = scratch.keep(
        of_node.select(F.xxhash64("key").alias("h"), F.col("key").alias("k"), F.coalesce("component", "node").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n")), "of-node"
    )
    named = packed.select("vec_id", "key").distinct()
    placed = named.join(of_node, (opaque(F.xxhash64("key")) == F.col("h")) & (F.col("key") == F.col("k")))
    placed = placed.groupBy(F.col("vec_id").alias("id")).agg(F.max("n").alias("n"), F.min("component").alias("component"))
    out = rows.select("vec_id").join(placed, F.col("vec_id") == F.col("id"), "left")
    out = out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
