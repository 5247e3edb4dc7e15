"""Functions that a user hands in, applied to batches of rows in Arrow; plans stay lazy."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def transformed(df: DataFrame, column: str, f: Callable[[pd.Series], pd.Series], kind: str) -> DataFrame:
    """``df`` with ``column`` put through ``f``, a batch at a time; ``kind`` is the type of the result. Nulls reach ``f``."""
    return df.withColumn(column, F.pandas_udf(f, kind)(F.col(column)))


def collated(df: DataFrame, f: Callable[[pd.DataFrame], pd.DataFrame], ddl: str, size: int) -> DataFrame:
    """``f`` applied to batches of ``size`` rows of a partition, the last one smaller; its rows have the schema ``ddl``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for batch in batches:
            held = batch if held is None else pd.concat([held, batch], ignore_index=True)
            while len(held) >= size:
                yield f(held.iloc[:size].reset_index(drop=True))
                held = held.iloc[size:].reset_index(drop=True)
        if held is not None and len(held):
            yield f(held)

    return df.mapInPandas(run, ddl)


def evaluated(configs: DataFrame, f: Callable[[dict], dict], ddl: str) -> DataFrame:
    """Each configuration with what ``f`` gives for it, as columns ``ddl``: one call a row, spread over the tasks.

    ``f`` runs on an executor and must not use the session.
    """
    names = configs.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = batch.to_dict("records")
            yield pd.DataFrame([{**r, **f({k: r[k] for k in names})} for r in rows])

    fields = ", ".join(f"`{c}` {t}" for c, t in configs.dtypes)
    return configs.mapInPandas(run, f"{fields}, {ddl}")
