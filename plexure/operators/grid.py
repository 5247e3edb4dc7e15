"""Every row of one table against every row of another, in the cells of a grid.

Rows are dealt to groups by a hash of their content, where they are read. A cell meets one group of the left table with
one of the right: a left group is copied once for each column of the grid, a right group once for each row, and nothing
else is shuffled. Group counts follow the sizes of the tables, so that a task holds two groups of bounded size, and are
balanced so that the copies are fewest. Within one table, cell (i, j) with i <= j meets groups i and j.

Which cells a row goes to depends on the row alone, so a task that runs again after a lost executor makes the same pairs.
"""

from __future__ import annotations

import ctypes
import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GROUP_BYTES, LEAST_ROWS = 32 << 20, 128


def tasks_of(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def square(rows: int, size: int, tasks: int) -> int:
    """Groups of a table of ``size`` bytes that meets itself."""
    wanted = min(math.ceil(math.sqrt(2 * tasks)), math.ceil(rows / LEAST_ROWS))
    return max(1, wanted, math.ceil(size / GROUP_BYTES))


def rectangle(left: tuple[int, int], right: tuple[int, int], tasks: int) -> tuple[int, int]:
    """Groups of two tables, each given as (rows, bytes)."""
    (n, a), (m, b) = left, right
    ratio = math.sqrt(max(a, 1) / max(b, 1))
    i = min(math.ceil(math.sqrt(tasks) * ratio), math.ceil(n / LEAST_ROWS))
    j = min(math.ceil(math.sqrt(tasks) / ratio), math.ceil(m / LEAST_ROWS), tasks)
    return max(1, min(i, tasks), math.ceil(a / GROUP_BYTES)), max(1, j, math.ceil(b / GROUP_BYTES))


def group_of(groups: int, *columns: str) -> Column:
    """The group of a row, by the content of its columns."""
    return F.pmod(F.xxhash64(*columns), F.lit(groups)).cast("int")


def in_cells(left: DataFrame, right: DataFrame | None, rows: int, columns: int, also: DataFrame | None = None) -> DataFrame:
    """Blocks (``grp`` and others, alike on both sides) with ``cell`` and ``side``, the blocks of a cell together, left ones first.

    ``right`` None: blocks of one table with ``rows`` groups; side is 0 for those of the lesser group. ``also``, then: rows that every cell has
    behind its blocks, as side 2.
    """
    tasks = tasks_of(left)
    spread = lambda df, n: df.withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    if right is None:
        both = spread(left, rows).withColumn("cell", F.least("grp", "_o") * F.lit(rows) + F.greatest("grp", "_o"))
        both = both.withColumn("side", (F.col("grp") > F.col("_o")).cast("int")).drop("_o")
        cells = rows * (rows + 1) // 2
        if also is not None:
            every = also.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(rows - 1)))).withColumn("_j", F.explode(F.sequence(F.col("_i"), F.lit(rows - 1))))
            every = every.withColumn("cell", F.col("_i") * F.lit(rows) + F.col("_j")).withColumn("side", F.lit(2)).drop("_i", "_j")
            both = both.unionByName(every, allowMissingColumns=True)
    else:
        a = spread(left, columns).withColumn("cell", F.col("grp") * F.lit(columns) + F.col("_o")).withColumn("side", F.lit(0))
        b = spread(right, rows).withColumn("cell", F.col("_o") * F.lit(columns) + F.col("grp")).withColumn("side", F.lit(1))
        both, cells = a.unionByName(b).drop("_o"), rows * columns
    parts = max(min(cells, tasks), cells // 4, 1)
    dealt = both.repartitionById(parts, _turn(rows, parts)) if right is None else both.repartition(parts, "cell")
    return dealt.sortWithinPartitions("cell", "side")


def _turn(rows: int, parts: int) -> Column:
    """The part of a cell of one table, dealt by turns: a hash gives some parts several cells and others none. Those of one group with itself, half the work, come last."""
    i, j = F.floor(F.col("cell") / rows).cast("int"), (F.col("cell") % rows).cast("int")
    number = i * (rows - 1) - F.floor(i * (i - 1) / 2).cast("int") + j - i - 1
    return (F.when(i == j, rows * (rows - 1) // 2 + i).otherwise(number) % parts).cast("int")


def _trimmer() -> Callable[[int], int] | None:
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):  # another C library
        return None


def release() -> None:
    """Hand free memory back to the system: Spark keeps workers for later stages, several a core, and each would keep its largest cell's."""
    pa.default_memory_pool().release_unused()
    trim = _trimmer()
    if trim is not None:
        trim(0)


def each_cell(
    batches: Iterator[pa.RecordBatch], solve: Callable[[pa.Table, pa.Table], Iterator[pa.RecordBatch]], more: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]] | None = None
) -> Iterator[pa.RecordBatch]:
    """What ``solve`` makes of the blocks of both sides of each cell, and then ``more`` of the rows behind them. Batches come as ``in_cells`` sorts them."""
    sides: tuple[list[pa.RecordBatch], list[pa.RecordBatch]] = ([], [])
    now = None

    def done() -> Iterator[pa.RecordBatch]:
        tables = [pa.Table.from_batches(s) if s else None for s in sides]
        sides[0].clear()
        sides[1].clear()
        if tables[0] is not None or tables[1] is not None:
            some = tables[0] if tables[0] is not None else tables[1]
            solved = solve(*(t if t is not None else some.slice(0, 0) for t in tables))
            tables.clear()  # ``solve`` may let go of the blocks once it has their matrices
            del some
            yield from solved
            release()

    for batch in batches:
        cell, side = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("cell", "side"))
        at = 0
        while at < batch.num_rows:
            end = at
            while end < batch.num_rows and (cell[end], side[end]) == (cell[at], side[at]):
                end += 1
            if cell[at] != now:
                yield from done()
                now = cell[at]
            if side[at] < 2:
                sides[side[at]].append(batch.slice(at, end - at))
            else:
                yield from done()
                yield from more(batch.slice(at, end - at))
            at = end
    yield from done()
