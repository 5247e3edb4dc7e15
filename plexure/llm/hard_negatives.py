"""Hard negatives by exact search in k-means inverted lists.

Method: integer vectors (floor of ``scale`` times each component) are assigned to the nearest of up to ``most_lists`` centroids,
which makes inverted lists; each stored block of a list has its centroid and its radius. By Cauchy and Schwarz no row of a block
scores above a * c + |a| * radius for an anchor a, nor below a * c - |a| * radius. Blocks are visited by descending upper bound;
those whose bounds lie outside a query's window of scores are skipped, and a query stops when the bound falls strictly
below its kth score. A query is an anchor that looks for rows of its own label (its positives), or an anchor and one positive that
look for rows of other labels within a window below the positive's score.

At scale: centroids are fitted on a bounded sample, all rows are in the lists. Lists, hot ones cut by a hash of their rows, are dealt to columns
of equal size, anchors in the order of their lists to groups. The sample's rows give each query a first bound on its kth score,
so an anchor group asks only for the columns in which some bound reaches it, and only for those cells are blocks copied; inside a
cell the visits begin with that bound. A cell keeps k rows a query, and only these leave it. The result does not depend on the sample.

Defined results: rows whose vec_id, label or vector is null, or whose vector holds null or non-finite components, take no part. Missing
components of a shorter vector are 0. Of rows that share an anchor's vec_id the one with the least label, then vector, is the
anchor, and all are its own; rows that share another vec_id count once for a query, with their best score there. Ties go to
the smaller vec_id. Scores beyond 64 bits are held at the bounds. An anchor without positives, and a positive with a negative
score, whose window is empty, give no rows. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plexure.llm.codes import integers
from plexure.llm.common import Scratch, arrow_map, column, record, schema_of
from plexure.llm.vectors import finite
from plexure.operators import grid

LEAST, MOST = -(1 << 63), (1 << 63) - 1
TILE, FLOOR_ROWS = 64, 4096


class Lists(NamedTuple):
    """What all tasks know: the centroids, how vectors are stored, and a bounded sample of rows."""

    centroids: np.ndarray
    dims: int
    scale: int
    store: type
    exact: type
    ids: np.ndarray
    labels: np.ndarray
    sample: np.ndarray

    def numbers(self, data: bytes) -> np.ndarray:
        """Stored vectors as whole numbers: doubles that hold them and their products exactly, or Python integers."""
        x = np.frombuffer(data, self.store).reshape(-1, self.dims)
        return integers(x, self.scale, object) if self.exact is object else x.astype(float)


def fitted(x: np.ndarray, lists: int, rounds: int = 5) -> np.ndarray:
    """Centroids of the rows by Lloyd's rounds from the first distinct ones."""
    _, first = np.unique(x, axis=0, return_index=True)
    c = x[np.sort(first)[:lists]].astype(float)
    for _ in range(rounds):
        home = nearest(x, c)
        size = np.bincount(home, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, home, x)
        c[size > 0] = total[size > 0] / size[size > 0, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = (c * c).sum(axis=1) / 2
    return np.concatenate([np.zeros(0, np.int64), *((x[at : at + 4096] @ c.T - half).argmax(axis=1) for at in range(0, len(x), 4096))])


def bounds(a: np.ndarray, c: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the scores of each anchor (row) in each block (column), with room for rounding."""
    if a.dtype == object:
        every = np.full((len(a), len(c)), np.inf)
        return -every, every
    middle, length = a @ c.T, np.sqrt((a * a).sum(axis=1))[:, None]
    room = length * radius + 1e-9 * length * (np.sqrt((c * c).sum(axis=1)) + radius) + 1e-3
    return middle - room, middle + room


class Queries(NamedTuple):
    """Anchors, and queries that refer to them by ``of``: windows of scores, and lower bounds of the kth scores."""

    x: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    of: np.ndarray
    low: np.ndarray
    high: np.ndarray
    kth: np.ndarray

    def part(self, first: int, last: int) -> Queries:
        """The anchors from ``first`` to ``last`` and their queries, which are in order."""
        a, b = np.searchsorted(self.of, [first, last])
        return Queries(self.x[first:last], self.ids[first:last], self.labels[first:last], self.of[a:b] - first, self.low[a:b], self.high[a:b], self.kth[a:b])


def fits(q: Queries, which: np.ndarray, scores: np.ndarray, ids: np.ndarray, labels: np.ndarray, same: bool) -> np.ndarray:
    """Which rows (columns) may answer which queries: other ids, equal or different labels, inside the window, not below the kth score."""
    own = q.of[which]
    ok = (q.labels[own][:, None] == labels[None, :]) == same
    ok &= q.ids[own][:, None] != ids[None, :]
    return ok & (scores >= np.maximum(q.low, q.kth)[which][:, None]) & (scores <= q.high[which][:, None])


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    s = a @ b.T
    return np.clip(s, LEAST, MOST) if s.dtype == object else s


def floors(q: Queries, known: Lists, k: int, same: bool) -> np.ndarray:
    """The kth score of each query among the sample's rows, -inf where these are fewer."""
    if len(known.ids) < k or known.exact is object:
        return q.kth
    out = q.kth.copy()
    for at in range(0, len(q.x), TILE):
        part = q.part(at, at + TILE)
        which = np.arange(len(part.of))
        s = products(part.x, known.sample)[part.of]
        s = np.where(fits(part, which, s, known.ids, known.labels, same), s, -np.inf)
        a = np.searchsorted(q.of, at)
        out[a : a + len(which)] = np.maximum(part.kth, np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k])
    return out


def best(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query, in order, an id once; ties to the smaller id."""
    order = np.lexsort((-scores, ids, query))
    query, ids, scores = query[order], ids[order], scores[order]
    once = np.ones(len(query), bool)
    once[1:] = (query[1:] != query[:-1]) | (ids[1:] != ids[:-1])
    query, ids, scores = query[once], ids[once], scores[once]
    order = np.lexsort((ids, -scores, query))
    query, ids, scores = query[order], ids[order], scores[order]
    top = np.arange(len(query)) - np.searchsorted(query, query, "left") < k
    return query[top], ids[top], scores[top]


def visit(q: Queries, blocks: list[tuple[np.ndarray, np.ndarray, np.ndarray]], centroids: np.ndarray, radius: np.ndarray, k: int, same: bool):
    """The k best rows of each query in blocks of (ids, labels, vectors), as (query, id, score); and the number of products made."""
    kth, made = q.kth.copy(), 0
    held = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, q.x.dtype)
    lower, upper = bounds(q.x, centroids, radius)
    reach = np.minimum(upper[q.of], q.high[:, None].astype(float))
    for b in np.argsort(-reach.max(axis=0), kind="stable").tolist():
        bar = np.maximum(kth, q.low).astype(float)
        if (reach.max(axis=0)[b] < bar).all():
            break  # no later bound is higher
        active = np.flatnonzero((upper[q.of, b] >= bar) & (lower[q.of, b] <= q.high.astype(float)))
        if not len(active):
            continue
        ids, labels, x = blocks[b]
        anchors, back = np.unique(q.of[active], return_inverse=True)
        scores = products(q.x[anchors], x)[back]
        made += len(anchors) * len(x)
        i, j = np.nonzero(fits(q._replace(kth=kth), active, scores, ids, labels, same))
        if not len(i):
            continue
        found = active[i], ids[j], scores[i, j]
        held = best(*(np.concatenate(p) for p in zip(held, found, strict=True)), k)
        last = np.flatnonzero(np.append(held[0][1:] != held[0][:-1], True))
        full = last[np.bincount(held[0], minlength=len(kth))[held[0][last]] == k]
        kth[held[0][full]] = np.maximum(kth[held[0][full]], held[2][full])
    return held, made


def _fit(rows: DataFrame, scale: int, most_lists: int, most_fit: int, most_bytes: int) -> tuple[Lists, int, int]:
    """The lists for a table, its number of rows, and how many of them are anchors."""
    size = F.aggregate("v", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x)))
    n, asked, dims, top = rows.agg(F.count("*"), F.count_if("asks"), F.max(F.size("v")), F.max(size)).first()
    dims, top = max(dims or 0, 1), scale * (top or 0.0) + 1
    exact = float if min(top, 1e100) ** 2 * dims < 2.0**53 else object
    store = float if exact is object else np.int16 if top < 2**15 else np.int32 if top < 2**31 else np.int64
    room = max(1, min(most_fit, most_bytes // (8 * dims)))
    share = math.ceil((1 << 20) * min(1.0, room / max(n, 1)))
    # The limit only holds back rows that repeat one id and vector; the share has about ``room`` rows.
    some = rows.filter(F.pmod(F.xxhash64("vec_id", "v"), F.lit(1 << 20)) < share).limit(2 * room).collect()
    once = {r.vec_id: r for r in some}
    ids, labels = (np.array([r[c] for r in once.values()], np.int64) for c in ("vec_id", "label"))
    x = np.zeros((len(once), dims))
    for i, r in enumerate(once.values()):
        x[i, : len(r.v)] = r.v
    if exact is object or not len(x):
        return Lists(np.zeros((1, dims)), dims, scale, store, exact, ids, labels, x), n, asked
    x = np.floor(scale * x)
    centroids = fitted(x, max(1, min(most_lists, math.ceil(math.sqrt(n)))))
    return Lists(centroids, dims, scale, store, exact, ids[:FLOOR_ROWS], labels[:FLOOR_ROWS], x[:FLOOR_ROWS]), n, asked


def _coded(rows: DataFrame, known) -> DataFrame:
    """vec_id, label, list, far (the distance to its centroid), asks and the stored vector of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = known.value
        for batch in batches:
            v = column(batch, "v")
            offsets = v.offsets.to_numpy()
            flat, width = v.flatten().to_numpy(zero_copy_only=False), np.diff(offsets)
            x = np.zeros((batch.num_rows, lists.dims))
            x[np.repeat(np.arange(len(x)), width), np.arange(len(flat)) - np.repeat(offsets[:-1] - offsets[0], width)] = flat
            home, far = np.zeros(len(x), np.int64), np.full(len(x), np.inf)
            if lists.exact is not object:
                x = np.floor(lists.scale * x)
                home = nearest(x, lists.centroids)
                far = np.sqrt(((x - lists.centroids[home]) ** 2).sum(axis=1))
            data = [r.tobytes() for r in x.astype(lists.store)]
            same = (column(batch, c) for c in ("vec_id", "label", "asks"))
            yield record("vec_id:long label:long asks:boolean list:int far:double data:binary", *same, pa.array(home), pa.array(far), data)

    return arrow_map(rows, run, "vec_id long, label long, asks boolean, list int, far double, data binary")


def _deal(sizes: dict[int, int], columns: int) -> tuple[list[int], list[int], list[int]]:
    """For each list its first unit and its number of units, and the column of each unit; columns come out about equally large."""
    target = max(1, -(-sum(sizes.values()) // columns))
    first, count, units = [], [], []
    for i in range(max(sizes, default=-1) + 1):
        first.append(len(units))
        count.append(max(1, -(-sizes.get(i, 0) // target)))
        units += [sizes.get(i, 0) // count[-1]] * count[-1]
    of, loads = [0] * len(units), [(0, c) for c in range(columns)]
    for u in sorted(range(len(units)), key=lambda u: (-units[u], u)):
        load, c = heapq.heappop(loads)
        of[u] = c
        heapq.heappush(loads, (load + units[u], c))
    return first, count, of


_BLOCK = "grp int, list int, far double, ids binary, labels binary, data binary, of binary, positive binary, score binary"


def _blocks(rows: DataFrame, size: int, by_list: bool) -> DataFrame:
    """Blocks of at most ``size`` rows of one ``grp``, and of one list where ``by_list``; rows come in that order."""

    def block(t: pa.Table) -> pa.RecordBatch:
        longs = lambda c: pa.chunked_array(t[c].chunks, pa.int64()).to_numpy().tobytes()
        of, positive, score = b"", b"", b""
        if "positives" in t.column_names:
            pairs = t["positives"].to_pylist()
            of = np.repeat(np.arange(len(pairs)), [len(p) for p in pairs]).astype(np.int64).tobytes()
            positive, score = (np.array([p[c] for some in pairs for p in some], np.int64).tobytes() for c in ("positive_id", "positive_score"))
        far = max(t["far"].to_pylist())
        first, data = [t["grp"][0].as_py()], b"".join(t["data"].to_pylist())
        parts = first, [t["list"][0].as_py()], [far], [longs("vec_id")], [longs("label")], [data], [of], [positive], [score]
        return record("grp:int list:int far:double ids:binary labels:binary data:binary of:binary positive:binary score:binary", *parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, now = [], 0, None
        for batch in batches:
            key = np.stack([column(batch, c).to_numpy() for c in (("grp", "list") if by_list else ("grp",))])
            starts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for s, e in zip(starts, starts[1:], strict=False):
                while s < e:
                    this = tuple(key[:, s].tolist())
                    if held and (this != now or count == size):
                        yield block(pa.Table.from_batches(held))
                        held, count = [], 0
                    part = batch.slice(s, min(e - s, size - count))
                    now, s, count = this, s + part.num_rows, count + part.num_rows
                    held.append(part)
        if held:
            yield block(pa.Table.from_batches(held))

    return arrow_map(rows, run, _BLOCK)


def _queries(blocks: list[dict], known: Lists, low: int, high: int, same: bool) -> tuple[Queries, np.ndarray, np.ndarray]:
    """The queries of anchor blocks; for each its positive's id and score, if it has one."""
    longs = lambda c: np.frombuffer(b"".join(b[c] for b in blocks), np.int64)
    x, ids, labels = known.numbers(b"".join(b["data"] for b in blocks)), longs("ids"), longs("labels")
    if same:
        none = np.full(len(ids), np.inf)
        return Queries(x, ids, labels, np.arange(len(ids)), -none, none, -none), ids, ids
    before = np.cumsum([0, *(len(b["ids"]) // 8 for b in blocks)])
    of = np.concatenate([np.frombuffer(b["of"], np.int64) + n for b, n in zip(blocks, before, strict=False)])
    positive, score = longs("positive"), longs("score")
    window = np.array([(-(-low * s // 100), high * s // 100) for s in score.tolist()], object).reshape(-1, 2).astype(known.exact)
    return Queries(x, ids, labels, of, window[:, 0], window[:, 1], np.full(len(of), -np.inf)), positive, score


def _search(
    anchors: DataFrame, lists: DataFrame, columns: int, radius: dict, known, k: int, low: int, high: int, same: bool, scratch: Scratch, tasks: int
) -> DataFrame:
    """anchor_id, positive_id, positive_score, vec_id, score: for each query at least its k best rows."""
    units = np.array([(c, l, r) for (c, l), r in sorted(radius.items())], float).reshape(-1, 3)

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, b in enumerate(batch.to_pylist()):
                q, _, _ = _queries([b], known.value, low, high, same)
                kth = floors(q, known.value, k, same)
                wanted = np.zeros(len(units), bool)
                bar = np.maximum(kth, q.low).astype(float)[:, None]
                for at in range(0, len(units), 4096):
                    some = units[at : at + 4096]
                    lower, upper = bounds(q.x, known.value.centroids[some[:, 1].astype(int)], some[:, 2])
                    wanted[at : at + 4096] = ((upper[q.of] >= bar) & (lower[q.of] <= q.high.astype(float)[:, None])).any(axis=0)
                needed = np.unique(units[wanted, 0].astype(np.int32))
                one = batch.slice(i, 1)
                more = pa.array([kth.tobytes() if kth.dtype == float else b""], pa.binary()), pa.array([needed.tolist()], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*one.columns, *more], names=[*one.schema.names, "kth", "cols"])

    ready = scratch.keep(arrow_map(anchors, asked, _BLOCK + ", kth binary, cols array<int>"), "queries")
    left = ready.withColumn("col", F.explode("cols")).drop("cols").withColumn("side", F.lit(0))
    need = left.select("grp", "col").distinct()
    cells = need.count()
    need = need.select(F.col("grp").alias("g"), F.col("col").alias("c"))
    need = F.broadcast(need) if cells <= 1_000_000 else need.hint("merge")
    right = lists.withColumnRenamed("grp", "col").join(need, F.col("col") == F.col("c"))
    right = right.select(F.col("g").alias("grp"), *lists.columns[1:], F.lit(b"").alias("kth"), "col", F.lit(1).alias("side"))
    both = left.unionByName(right).withColumn("cell", F.col("grp").cast("long") * columns + F.col("col"))
    both = both.repartition(max(min(cells, tasks), cells // 4, 1), "cell").sortWithinPartitions("cell", "side")

    def solve(a: pa.Table, b: pa.Table) -> Iterator[pa.RecordBatch]:
        if not a.num_rows or not b.num_rows:
            return
        lists_ = known.value
        mine = a.to_pylist()
        q, positive, score = _queries(mine, lists_, low, high, same)
        if lists_.exact is not object:
            q = q._replace(kth=np.frombuffer(b"".join(r["kth"] for r in mine), float))
        found = b.to_pylist()
        rows = [(np.frombuffer(r["ids"], np.int64), np.frombuffer(r["labels"], np.int64), lists_.numbers(r["data"])) for r in found]
        centre, far = lists_.centroids[[r["list"] for r in found]], np.array([r["far"] for r in found])
        for at in range(0, len(q.x), TILE):
            part = q.part(at, at + TILE)
            if not len(part.of):
                continue
            first = int(np.searchsorted(q.of, at))
            (query, ids, scores), _ = visit(part, rows, centre, far, k, same)
            scores = np.array([int(s) for s in scores], np.int64) if scores.dtype == object else scores.astype(np.int64)
            at_pair = first + query
            found_here = part.ids[part.of[query]], positive[at_pair], score[at_pair], ids, scores
            yield record("anchor_id:long positive_id:long positive_score:long vec_id:long score:long", *map(pa.array, found_here))

    return arrow_map(both, lambda batches: grid.each_cell(batches, solve), "anchor_id long, positive_id long, positive_score long, vec_id long, score long")


def _ranked(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k best of each query; a group holds k rows a column at most."""
    once = found.groupBy(*keys, "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], schema_of("anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"))


def hard_negatives(
    table: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256,
    most_lists: int = 1024, most_fit: int = 1 << 14, most_bytes: int = 1 << 25, block: int = 1024,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of the anchors of ``table`` (vec_id, embedding, label): rows whose
    vec_id is divisible by ``every``.

    low, high: the window of negative scores, in percent of the positive's. most_fit, most_bytes: the sample that centroids are fitted on.
    """
    spark = table.sparkSession
    scratch = Scratch(spark, "hard-negatives")
    named = {"vec_id": F.col("vec_id").cast("long"), "label": F.col("label").cast("long"), "v": F.col("embedding").cast("array<double>")}
    rows = table.select(*[c.alias(n) for n, c in named.items()])
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite(F.col("v"))).withColumn("asks", F.col("vec_id") % every == 0)
    lists, n, asked = _fit(rows, scale, most_lists, most_fit, most_bytes)
    if not asked:
        return _empty(spark)
    known = spark.sparkContext.broadcast(lists)
    coded = scratch.keep(_coded(rows, known), "coded")
    tasks, width = grid.tasks_of(coded), np.dtype(lists.store).itemsize * lists.dims
    groups, columns = grid.rectangle((asked, asked * width), (n, n * width), tasks)
    slot = F.abs(F.xxhash64("vec_id", "data") % F.lit(1 << 40))

    # Lists, at most ``most_lists``, in units, a column each; the driver sees one number a list.
    sizes = {r["list"]: r["n"] for r in coded.groupBy("list").agg(F.count("*").alias("n")).collect()}
    first, count, of = _deal(sizes, columns)
    units = spark.createDataFrame([(i, first[i], count[i]) for i in sizes], "l int, first int, units int")
    places = spark.createDataFrame(list(enumerate(of)), "u int, grp int")
    placed = coded.join(F.broadcast(units), F.col("list") == F.col("l")).withColumn("at", (F.col("first") + slot % F.col("units")).cast("int"))
    placed = placed.join(F.broadcast(places), F.col("at") == F.col("u")).select("grp", "list", "far", "vec_id", "label", "data")
    stored = scratch.keep(_blocks(placed.repartition("grp").sortWithinPartitions("grp", "list"), block, True), "lists")
    radius = {(r["grp"], r["list"]): r["far"] for r in stored.groupBy("grp", "list").agg(F.max("far").alias("far")).collect()}

    # Anchors by list, so that those of a group want the same columns.
    one = rows.filter("asks").groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("m")).select("vec_id", "m.*", F.lit(True).alias("asks"))
    anchors = scratch.keep(_coded(one, known).withColumn("far", F.lit(0.0)), "anchors")
    before, total = [], 0
    for r in sorted(anchors.groupBy("list").agg(F.count("*").alias("n")).collect()):
        before.append((r["list"], total, r["n"]))
        total += r["n"]
    offsets = spark.createDataFrame(before, "l int, start long, of_list long")
    grouped = anchors.join(F.broadcast(offsets), F.col("list") == F.col("l"))
    grouped = grouped.withColumn("grp", F.floor((F.col("start") + slot % F.col("of_list")) * groups / F.lit(total)).cast("int"))
    grouped = grouped.select("grp", "list", "far", "vec_id", "label", "data")

    def search(asking: DataFrame, k: int, same: bool) -> DataFrame:
        packed = _blocks(asking.repartition("grp").sortWithinPartitions("grp", "list"), TILE, False)
        return _search(packed, stored, columns, radius, known, k, low, high, same, scratch, tasks)

    near = _ranked(search(grouped, positives, True), ["anchor_id"], positives).filter("score >= 0")
    each = F.struct(F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    pairs = scratch.keep(near.groupBy("anchor_id").agg(F.sort_array(F.collect_list(each)).alias("positives")), "pairs")
    asking = grouped.join(pairs, F.col("vec_id") == F.col("anchor_id")).drop("anchor_id")
    found = _ranked(search(asking, negatives, False), ["anchor_id", "positive_id", "positive_score"], negatives)
    rank, negative, score = F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")
    return found.select("anchor_id", "positive_id", rank, negative, "positive_score", score)
