"""Linear probes of vectors from sums: one pass gives each fold's products, and all folds and penalties are solved from those.

A probe is a ridge regression of class indicators on the vectors and a constant, which names the class with the greatest value.
What it needs of a fold's rows is their Gram matrix and their products with the indicators; training without a fold takes off that
fold's sums from the total. Sums do not grow with the rows, and come to the driver through ``treeAggregate``; a second pass scores all
penalties at once.

Defined results: rows with a null vector or label take no part, nor do those whose vector has another length than most. Ties go to the class that sorts first.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plexure.operators.masks import folds
from plexure.operators.store import tree_depth


class Sums(NamedTuple):
    """Of one fold's rows, each with a last component of one: their number, the products among components, and with the class indicators."""

    n: int
    gram: np.ndarray
    cross: np.ndarray

    def __add__(self, other: Sums) -> Sums:
        return Sums(self.n + other.n, self.gram + other.gram, self.cross + other.cross)

    def __sub__(self, other: Sums) -> Sums:
        return Sums(self.n - other.n, self.gram - other.gram, self.cross - other.cross)


class Probe(NamedTuple):
    """Rows (fold, vec, label as text), the classes in order, and each fold's sums."""

    rows: DataFrame
    classes: list[str]
    sums: dict[int, Sums]


def _blocks(batch: pa.RecordBatch, place: dict[str, int], dims: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """fold, vectors with a constant, and class numbers of a batch, fold by fold."""
    fold, vec, label = (batch.column(batch.schema.get_field_index(c)) for c in ("fold", "vec", "label"))
    x = np.ones((batch.num_rows, dims + 1))
    x[:, :dims] = vec.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
    c = np.array([place[v] for v in label.to_pylist()])
    f = fold.to_numpy()
    for k in np.unique(f).tolist():
        yield k, x[f == k], c[f == k]


def statistics(df: DataFrame, id_col: str, vec: str, label: str, k: int = 5, seed: int = 1, most_classes: int = 10_000) -> Probe:
    """The sums of ``k`` folds of ``df``. More classes than ``most_classes`` are an error, as a solution holds a row for each."""
    rows = df.select(F.col(id_col).alias("id"), F.col(vec).cast("array<double>").alias("vec"), F.col(label).cast("string").alias("label"))
    rows = rows.filter(F.col("label").isNotNull() & (F.size("vec") > 0))
    size = rows.groupBy(F.size("vec").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    classes = sorted(r.label for r in rows.select("label").distinct().limit(most_classes + 1).collect())
    if len(classes) > most_classes:
        raise ValueError(f"more than {most_classes} classes")
    dims = size["d"] if size else 1
    placed = folds(rows.filter(F.size("vec") == dims), "id", k, seed).select("fold", "vec", "label")
    place = {c: i for i, c in enumerate(classes)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Sums] = {}
        for batch in batches:
            if batch.num_rows == 0:
                continue
            for f, x, c in _blocks(batch, place, dims):
                ones = np.zeros((len(x), len(classes)))
                ones[np.arange(len(x)), c] = 1
                new = Sums(len(x), x.T @ x, x.T @ ones)
                held[f] = held[f] + new if f in held else new
        if held:
            parts = [(f, s.n, s.gram.tobytes(), s.cross.tobytes()) for f, s in held.items()]
            yield pa.RecordBatch.from_pydict(dict(zip(("fold", "n", "gram", "cross"), map(list, zip(*parts, strict=True)), strict=True)))

    def both(a: dict[int, Sums], b: dict[int, Sums]) -> dict[int, Sums]:
        return {f: a[f] + b[f] if f in a and f in b else a.get(f) or b[f] for f in {*a, *b}}

    def one(acc: dict[int, Sums], r) -> dict[int, Sums]:
        return both(acc, {r.fold: Sums(r.n, np.frombuffer(r.gram).reshape(dims + 1, -1), np.frombuffer(r["cross"]).reshape(dims + 1, -1))})

    parts = placed.mapInArrow(run, "fold long, n long, gram binary, cross binary").rdd
    sums = parts.treeAggregate({}, one, both, tree_depth(parts))
    return Probe(placed, classes, sums)


def solved(sums: Sums, penalty: float) -> np.ndarray:
    """The weights of a ridge regression; the constant is not penalised."""
    own = np.eye(len(sums.gram)) * penalty
    own[-1, -1] = 0
    return np.linalg.lstsq(sums.gram + own, sums.cross, rcond=None)[0]


def accuracies(probe: Probe, penalties: list[float]) -> DataFrame:
    """fold, penalty, n and accuracy: each fold scored by what the others teach."""
    spark = probe.rows.sparkSession
    if not probe.sums:
        return spark.createDataFrame([], "fold long, penalty double, n long, accuracy double")
    total = sum(probe.sums.values(), start=Sums(0, 0, 0))
    models = {f: [solved(total - s, p) for p in penalties] for f, s in probe.sums.items()}
    given, classes = spark.sparkContext.broadcast(models), {c: i for i, c in enumerate(probe.classes)}
    dims = len(total.gram) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            for f, x, c in _blocks(batch, classes, dims):
                right = [int(((x @ w).argmax(axis=1) == c).sum()) for w in given.value[f]]
                count = len(penalties)
                yield pa.RecordBatch.from_pydict({"fold": pa.array([f] * count, pa.int64()), "penalty": penalties, "n": pa.array([len(x)] * count, pa.int64()), "hits": pa.array(right, pa.int64())})

    found = probe.rows.mapInArrow(run, "fold long, penalty double, n long, hits long").groupBy("fold", "penalty").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))
    return found.select("fold", "penalty", "n", (F.col("hits") / F.col("n")).alias("accuracy"))


def battery(df: DataFrame, id_col: str, vec: str, probes: dict[str, tuple[str, float | None]], k: int = 5, penalty: float = 1.0) -> DataFrame:
    """name, accuracy and chance of named probes, each (label column, chance); a chance of None is one over the number of classes."""
    out = []
    for name, (label, chance) in probes.items():
        probe = statistics(df, id_col, vec, label, k)
        mean = accuracies(probe, [penalty]).agg(F.avg("accuracy")).first()[0]
        out.append((name, mean, chance if chance is not None else 1.0 / max(len(probe.classes), 1)))
    return df.sparkSession.createDataFrame(out, "name string, accuracy double, chance double")
