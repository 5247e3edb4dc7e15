"""Graphs as edge tables (src, dst, weight), each undirected edge once with src < dst unless said otherwise."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plexure.operators import grid
from plexure.operators.store import Scratch, at_places, numbered, opaque


PAIRS_A_TASK, MOST_TASKS = 1 << 26, 1 << 13


def symmetrized(edges: DataFrame) -> DataFrame:
    """Both directions of each edge, once."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest)).distinct()


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *[c for c in edges.columns if c not in ("src", "dst")])


def within_groups(nodes: DataFrame, id_col: str, group: str, rows: int = 4096) -> DataFrame:
    """src and dst: each pair of different nodes of one group, both ways.

    A group's nodes are dealt to parts of about ``rows`` by a hash of their ids, and two parts meet in a cell, so that a
    large group is many tasks; the number of these follows the number of pairs.
    """
    v = nodes.select(F.col(id_col).alias("src"), F.col(group).alias("_g")).filter("_g IS NOT NULL")
    sizes = v.groupBy(F.col("_g").alias("_h")).agg(F.count("*").alias("n"))
    pairs = sizes.agg(F.coalesce(F.sum(F.col("n").cast("double") * F.col("n")), F.lit(0.0))).first()[0]
    v = v.join(sizes.select("_h", F.ceil(F.col("n") / rows).cast("int").alias("parts")), F.col("_g") == F.col("_h"))
    v = v.withColumn("own", F.pmod(F.xxhash64("src"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    tasks = int(min(max(grid.tasks_of(nodes), pairs // PAIRS_A_TASK), MOST_TASKS))
    left = v.select("_g", F.col("own").alias("i"), F.col("other").alias("j"), "src").repartition(tasks, "_g", "i", "j")
    right = v.select(F.col("_g").alias("_r"), F.col("other").alias("i2"), F.col("own").alias("j2"), F.col("src").alias("dst")).repartition(tasks, "_r", "i2", "j2")
    cell = (F.col("_g") == F.col("_r")) & (F.col("i") == F.col("i2")) & (F.col("j") == F.col("j2"))
    return left.join(right.hint("merge"), cell & (F.col("src") != F.col("dst"))).select("src", "dst")


def undirected(edges: DataFrame) -> DataFrame:
    """Each pair once with its greatest weight, without self-loops."""
    return edges.filter("src <> dst").groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.max("weight").alias("weight"))


def node_count(edges: DataFrame) -> DataFrame:
    return edges.agg((F.max(F.greatest("src", "dst")) + 1).alias("n"))


def degrees(nodes: DataFrame, edges: DataFrame, id_col: str) -> DataFrame:
    """node and degree (both ends of each row count), nodes without edges included."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("_n")).groupBy("_n").agg(F.count("*").alias("_d"))
    joined = nodes.select(F.col(id_col).alias("node")).join(ends, F.col("node") == F.col("_n"), "left")
    return joined.select("node", F.coalesce("_d", F.lit(0)).cast("long").alias("degree"))


def density(edge_count: Column, n: Column, m: Column | None = None) -> Column:
    """Edges over possible pairs, within n nodes or between n and m; 0 if none is possible."""
    possible = n.cast("double") * m if m is not None else n.cast("double") * (n - 1) / 2
    return F.coalesce(F.try_divide(edge_count.cast("double"), possible), F.lit(0.0))


def components(nodes: DataFrame, edges: DataFrame, id_col: str, scratch: Scratch | None = None) -> DataFrame:
    """node and component (its least node), nodes without edges included.

    Labels shrink by hooking every node to its neighbours' least label and then jumping to the label's label,
    so rounds are logarithmic in practice, and end as labels cannot fall below the least. Each round ends in a written table, in
    ``scratch`` if the caller will remove them.
    """
    scratch = scratch or Scratch(nodes.sparkSession, "components")
    e = scratch.keep(undirected(edges.withColumn("weight", F.lit(1.0)) if "weight" not in edges.columns else edges).select("src", "dst"), "edges")
    labels = scratch.keep(nodes.select(F.col(id_col).alias("node"), F.col(id_col).alias("component")).distinct(), "labels")
    both = e.unionByName(reversed_edges(e))
    while True:
        theirs = labels.select(F.col("node").alias("_n"), F.col("component").alias("_c"))
        near = both.join(theirs, F.col("dst") == F.col("_n")).groupBy("src").agg(F.min("_c").alias("_m"))
        hooked = labels.join(near, F.col("node") == F.col("src"), "left")
        hooked = hooked.select("node", F.col("component").alias("was"), F.least("component", F.coalesce("_m", "component")).alias("component"))
        roots = hooked.groupBy("was").agg(F.min("component").alias("_r")).select(F.col("was").alias("_w"), "_r")
        jumped = hooked.join(roots, F.col("component") == F.col("_w"), "left")
        new = scratch.keep(jumped.select("node", "was", F.least("component", F.coalesce("_r", "component")).alias("component")), "round")
        if not new.filter("component <> was").limit(1).count():
            return new.select("node", "component")
        scratch.drop(labels)
        # ``drop`` knows the table that was kept, not a selection of it.
        labels = new


PRUNED_ROWS = 1 << 20


def _forest(src: np.ndarray, dst: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Which of some edges make up their maximum spanning forest, under the order weight descending, src, dst."""
    order = np.lexsort((dst, src, -weight))
    ids, ends = np.unique(np.concatenate([src[order], dst[order]]), return_inverse=True)
    a, b, label = ends[: len(src)], ends[len(src) :], np.arange(len(ids))
    left, chosen = np.arange(len(src)), []
    while True:
        left = left[label[a[left]] != label[b[left]]]
        if not len(left):
            return order[np.concatenate(chosen)] if chosen else order[:0]
        best = np.full(len(ids), len(src))
        for end in (a, b):  # the last assignment stays: that of the first edge
            first = np.full(len(ids), len(src))
            first[label[end[left[::-1]]]] = left[::-1]
            best = np.minimum(best, first)
        has = np.flatnonzero(best < len(src))
        chosen.append(np.unique(best[has]))
        parent = np.arange(len(ids))
        parent[has] = label[a[best[has]]] + label[b[best[has]]] - has
        both = has[(parent[parent[has]] == has) & (has < parent[has])]
        parent[both] = both
        while (parent[parent] != parent).any():
            parent = parent[parent]
        label = parent[label]


def pruned(edges: DataFrame) -> DataFrame:
    """Edges without those that are least in a cycle of edges which one task reads: no maximum spanning forest has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, most = [], 0, PRUNED_ROWS

        def cut() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            src, dst, weight = (np.concatenate(c) for c in zip(*held, strict=True))
            keep = _forest(src, dst, weight)
            return src[keep], dst[keep], weight[keep]

        for batch in batches:
            src, dst, weight = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            odd = np.isnan(weight)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(odd)) for c in batch.columns], schema=batch.schema)
            held.append((src[~odd], dst[~odd], weight[~odd]))
            size += len(src)
            if size > most:
                held = [cut()]
                size = len(held[0][0])
                most = max(PRUNED_ROWS, 2 * size)
        if held:
            columns = cut()
            for at in range(0, len(columns[0]), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(c[at : at + (1 << 16)]) for c in columns], names=["src", "dst", "weight"])

    ends = F.least("src", "dst").cast("long").alias("src"), F.greatest("src", "dst").cast("long").alias("dst")
    return edges.filter("src <> dst").select(*ends, F.col("weight").cast("double").alias("weight")).mapInArrow(run, "src long, dst long, weight double")


def spanning_forest(edges: DataFrame) -> DataFrame:
    """The maximum spanning forest of undirected edges, under the order weight descending, src, dst.

    Borůvka: each round every component takes its first edge in that order, all at once; components merge, and
    edges inside one are dropped. The order is total, so chosen edges never form a cycle. Before the first round each task drops
    what cannot be in the forest by the edges that it reads, so that what is shuffled follows nodes and tasks.
    """
    scratch = Scratch(edges.sparkSession, "forest")
    now = scratch.keep(undirected(pruned(edges)).select("src", "dst", "weight", F.col("src").alias("a"), F.col("dst").alias("b")), "edges")
    chosen = None
    while now.limit(1).count():
        both = now.select("a", "src", "dst", "weight").unionByName(now.select(F.col("b").alias("a"), "src", "dst", "weight"))
        best = both.groupBy("a").agg(F.min(F.struct((-F.col("weight")).alias("w"), "src", "dst")).alias("e"))
        picked = scratch.keep(best.select(F.col("e.src").alias("src"), F.col("e.dst").alias("dst"), (-F.col("e.w")).alias("weight")).distinct(), "picked")
        chosen = picked if chosen is None else chosen.unionByName(picked)
        taken = picked.select(F.col("src").alias("_s"), F.col("dst").alias("_d"))
        links = now.join(taken, (F.col("src") == F.col("_s")) & (F.col("dst") == F.col("_d"))).select(F.col("a").alias("src"), F.col("b").alias("dst"))
        ends = links.select(F.explode(F.array("src", "dst")).alias("n")).distinct()
        inner = Scratch(edges.sparkSession, "forest-round")
        label = components(ends, links, "n", inner)
        la, lb = (label.select(F.col("node").alias(f"_{s}"), F.col("component").alias(f"_c{s}")) for s in "ab")
        moved = now.join(la, F.col("a") == F.col("_a"), "left").join(lb, F.col("b") == F.col("_b"), "left")
        moved = moved.select("src", "dst", "weight", F.coalesce("_ca", "a").alias("a"), F.coalesce("_cb", "b").alias("b")).filter("a <> b")
        new = scratch.keep(moved, "edges")
        scratch.drop(now)
        inner.drop_all_but()
        now = new
    return chosen if chosen is not None else now.select("src", "dst", "weight")


def bridges(nodes: DataFrame, label: DataFrame, id_col: str, vec: str, size: int = 512, group_rows: int = 8192) -> DataFrame:
    """For each two components that follow each other by their least nodes, the pair with the greatest cosine: a chain of links.

    A component's rows are dealt to groups by a hash of their ids and packed into blocks where they are read. Two neighbours meet
    in the cells of a grid, one for each pair of their groups, so that two large components are many tasks.
    """
    order = numbered(label.select("component").distinct(), "component").select(F.col("component").alias("_c"), "pos")
    placed = nodes.join(label, F.col(id_col) == F.col("node")).join(order, F.col("component") == F.col("_c"))
    placed = placed.filter(F.col(vec).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("v"), "pos")
    groups = placed.groupBy(F.col("pos").alias("_at")).agg(F.ceil(F.count("*") / group_rows).cast("int").alias("groups"))
    groups = Scratch(nodes.sparkSession, "bridges").keep(groups, "groups")
    placed = placed.join(groups, F.col("pos") == F.col("_at")).withColumn("grp", F.pmod(F.xxhash64("id"), F.col("groups")).cast("int"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pos, grp, ids, vectors = (batch.column(batch.schema.get_field_index(c)) for c in ("pos", "grp", "id", "v"))
            order = pa.array(np.lexsort((grp.to_numpy(), pos.to_numpy())))
            pos, grp, ids, vectors = (c.take(order) for c in (pos, grp, ids, vectors))
            new = (np.diff(pos.to_numpy(), prepend=-1) != 0) | (np.diff(grp.to_numpy(), prepend=-1) != 0)
            starts = np.flatnonzero(new).tolist()
            cuts = [at for a, b in zip(starts, [*starts[1:], len(pos)], strict=True) for at in range(a, b, size)]
            x = np.array(vectors.to_pylist(), float)
            x = x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)
            spans, ids = list(zip(cuts, [*cuts[1:], len(pos)], strict=True)), ids.to_numpy()
            at = pa.array(cuts, pa.int64())
            packed = {"ids": [ids[a:b].tobytes() for a, b in spans], "data": [x[a:b].tobytes() for a, b in spans]}
            yield pa.RecordBatch.from_pydict({"pos": pos.take(at), "grp": grp.take(at)} | packed)

    blocks = placed.select("pos", "grp", "id", "v").mapInArrow(pack, "pos long, grp int, ids binary, data binary")
    every = F.explode(F.sequence(F.lit(0), F.col("groups") - 1))
    first = blocks.join(groups, F.col("pos") + 1 == F.col("_at")).select(F.col("pos").alias("low"), F.col("grp").alias("i"), every.alias("j"), "ids", "data")
    then = blocks.join(groups, F.col("pos") - 1 == F.col("_at")).select(F.col("_at").alias("low2"), every.alias("i2"), F.col("grp").alias("j2"), F.col("ids").alias("ids2"), F.col("data").alias("data2"))
    cell = (opaque(F.col("low")) == opaque(F.col("low2"))) & (F.col("i") == F.col("i2")) & (F.col("j") == F.col("j2"))
    pairs = first.join(then, cell).select("low", "ids", "data", "ids2", "data2")

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low, src, dst, weight = [], [], [], []
            for p, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a, b = np.frombuffer(row[0], np.int64), np.frombuffer(row[2], np.int64)
                s = np.frombuffer(row[1]).reshape(len(a), -1) @ np.frombuffer(row[3]).reshape(len(b), -1).T
                i, j = np.nonzero(s == s.max())
                x, y = np.minimum(a[i], b[j]), np.maximum(a[i], b[j])
                first = np.lexsort((y, x))[0]
                low.append(p)
                src.append(int(x[first]))
                dst.append(int(y[first]))
                weight.append(float(s.max()))
            ends = {c: pa.array(v, pa.int64()) for c, v in (("low", low), ("src", src), ("dst", dst))}
            yield pa.RecordBatch.from_pydict(ends | {"weight": pa.array(weight, pa.float64())})

    found = pairs.mapInArrow(best, "low long, src long, dst long, weight double")
    least = found.groupBy("low").agg(F.min(F.struct((-F.col("weight")).alias("w"), "src", "dst")).alias("e"))
    return least.select("e.src", "e.dst", (-F.col("e.w")).alias("weight"))


#: Rows of a task that sorts or counts them, however many there are.
TASK_ROWS = 1 << 19


def parts_of(rows: int, df: DataFrame) -> int:
    """Parts in which a task has ``TASK_ROWS`` rows at most, on average."""
    return max(grid.tasks_of(df), -(-rows // TASK_ROWS))


def shared_members(rows: DataFrame, group: str, member: str) -> DataFrame:
    """src < dst and weight: pairs of members by the number of groups that hold both. Groups are small; tasks have a bounded number of rows and of pairs."""
    known = rows.select(F.col(group).alias("k"), F.col(member).alias("src")).filter("k IS NOT NULL AND src IS NOT NULL")
    one = known.repartition(parts_of(known.count(), rows), "k").distinct()
    c = F.col("c")
    pairs = one.groupBy("k").agg(F.count("*").alias("c")).agg(F.sum(c * (c - 1) / 2)).first()[0] or 0
    two = one.select(F.col("k").alias("k2"), F.col("src").alias("dst"))
    both = one.join(two, (F.col("k") == F.col("k2")) & (F.col("src") < F.col("dst"))).select("src", "dst")
    return both.repartition(parts_of(int(pairs), rows), "src", "dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))


def _with_strength(edges: DataFrame, parts: int | None = None) -> DataFrame:
    """Each edge with strength and degree of both ends (s_src, k_src, s_dst, k_dst). parts: in how many the edges meet these."""
    both = edges.select(F.col("src").alias("n"), "weight").unionByName(edges.select(F.col("dst").alias("n"), "weight"))
    per = both.groupBy("n").agg(F.sum("weight").alias("s"), F.count("*").alias("k"))
    out = edges
    for end in ("src", "dst"):
        side = per.select(F.col("n").alias(f"_n_{end}"), F.col("s").alias(f"s_{end}"), F.col("k").alias(f"k_{end}"))
        spread = out if parts is None else out.repartition(parts, end)
        out = spread.join(side, F.col(end) == F.col(f"_n_{end}")).drop(f"_n_{end}")
    return out


def disparity(edges: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Edges that stand out at one end at least: (1 - weight / strength) ** (degree - 1) under ``alpha``; an end of degree 1 never decides."""
    p = {e: F.power(1 - F.coalesce(F.try_divide(F.col("weight"), F.col(f"s_{e}")), F.lit(0.0)), F.col(f"k_{e}") - 1) for e in ("src", "dst")}
    return _with_strength(edges).filter((p["src"] < alpha) | (p["dst"] < alpha)).select(*edges.columns)


def noise_corrected(edges: DataFrame, delta: float = 1.64) -> DataFrame:
    """Edges whose weight exceeds what their ends' strengths suggest by ``delta`` standard deviations (Coscia and Neffke 2017).

    The prior is the Beta distribution with the mean and variance of the hypergeometric one.
    """
    edges = Scratch(edges.sparkSession, "noise").keep(edges, "edges")
    whole = edges.agg(F.sum("weight")).first()[0] or 0.0  # one number
    n, a, b, w = F.lit(2.0 * whole), F.col("s_src"), F.col("s_dst"), F.col("weight")
    over_ = F.try_divide  # a graph too small for the estimate keeps nothing
    prior = over_(a * b, n * n)
    spread = over_(a * b * (n - a) * (n - b), n * n * n * n * (n - 1))
    alpha = over_(prior * prior, spread) * (1 - prior) - prior
    beta = over_(prior, spread) * (1 - prior) * (1 - prior) - (1 - prior)
    expected = over_(alpha + w, alpha + beta + n)
    lift = over_(n, a * b)
    score = over_(lift * w - 1, lift * w + 1)
    slope = over_(F.lit(1.0), a * b) - over_(n * (a + b), a * b * a * b)
    deviation = F.sqrt(expected * (1 - expected) * n) * F.abs(over_(2 * (lift + w * slope), (lift * w + 1) * (lift * w + 1)))
    return _with_strength(edges, parts_of(edges.count(), edges)).filter(score - delta * deviation > 0).select(*edges.columns)


def over(edges: DataFrame, threshold: float) -> DataFrame:
    return edges.filter(F.col("weight") > threshold)


def exact(edges: DataFrame, least: float = 0.99) -> DataFrame:
    """Edges that count as exact: of weight ``least`` or more."""
    return edges.filter(F.col("weight") >= least)


def strongest(edges: DataFrame, part: int = 10) -> DataFrame:
    """The greatest(1, count div part) heaviest edges, ties by src and dst.

    The weight of the last one comes from counts of bins (see ``at_places``); heavier edges are a filter, and only those of that very weight are
    placed in order. Null and NaN weights are not taken while others are left.
    """
    edges = Scratch(edges.sparkSession, "strongest").keep(edges, "edges")
    known = edges.filter(F.col("weight").isNotNull() & ~F.isnan("weight"))
    n, m = edges.count(), known.count()
    wanted = max(1, n // part) if n else 0
    if wanted >= m:
        rest = edges.filter(F.col("weight").isNull() | F.isnan("weight"))
        return known.unionByName(numbered(rest, "src", "dst").filter(F.col("pos") < wanted - m).drop("pos")) if wanted > m else known
    bar = at_places(known, "weight", [m - wanted])[m - wanted]
    over_bar = known.filter(F.col("weight") > bar)
    left = wanted - over_bar.count()
    return over_bar.unionByName(numbered(known.filter(F.col("weight") == bar), "src", "dst").filter(F.col("pos") < left).drop("pos"))


def backbone(edges: DataFrame, method: str = "mst", alpha: float = 0.05, threshold: float = 0.5) -> DataFrame:
    """A sparser graph in both directions; where a method keeps nothing, the strongest tenth."""
    methods = {
        "mst": lambda: spanning_forest(edges), "disparity": lambda: disparity(edges, alpha), "noise_corrected": lambda: noise_corrected(edges),
        "threshold": lambda: over(edges, threshold),
    }
    kept = methods[method]()
    if not kept.limit(1).count():
        kept = strongest(edges)
    return symmetrized(kept)


def random_edges(spark: SparkSession, nodes: int, edges: int, seed: int) -> DataFrame:
    """``edges`` seeded pairs of ``nodes`` nodes, the same in any engine."""
    from plexure.functions.hashing import hash_key, hash_share

    end = lambda side: F.floor(hash_share(hash_key(f"{seed}:{side}", "id")) * nodes).cast("long")
    return spark.range(edges).select(end("src").alias("src"), end("dst").alias("dst"))
