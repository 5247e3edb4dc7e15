"""Runs of configurations over folds, which go on where they stopped."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plexure.sources.versions import Versions

Run = Callable[[dict, int], dict[str, float]]


def run_grid(spark: SparkSession, configs: dict[str, dict], folds: int, run: Run, metrics: list[str], store: Versions | None = None) -> DataFrame:
    """config_id, fold, error and a column for each metric: what ``run`` gives for each configuration and fold.

    A run's work is Spark jobs; the driver goes through configurations and folds, of which there are few. A run that fails has
    infinite metrics and its error, and the others go on. With a ``store`` each result is committed as it comes, and those that are
    there already, for the same configuration, are not run again.
    """
    done: dict[str, dict] = {}
    if store is not None and (last := store.read()) is not None:
        done = last[1].get("runs", {})
    for config_id, config in configs.items():
        for fold in range(folds):
            key = json.dumps([config_id, config, fold], sort_keys=True)
            if key in done:
                continue
            try:
                found, error = {m: float(v) for m, v in run(config, fold).items() if m in metrics}, None
            except Exception as e:
                # Told in its row: one bad configuration must not cost the others their results.
                found, error = {}, str(e).strip().split("\n")[0] or type(e).__name__
            done[key] = {"found": found, "error": error}
            if store is not None:
                store.commit(None, {"runs": done})
    rows = []
    for config_id, config in configs.items():
        for fold in range(folds):
            r = done[json.dumps([config_id, config, fold], sort_keys=True)]
            rows.append((config_id, fold, r["error"], *(r["found"].get(m, float("inf")) for m in metrics)))
    return spark.createDataFrame(rows, "config_id string, fold long, error string" + "".join(f", {m} double" for m in metrics))


def averaged(runs: DataFrame, metrics: list[str]) -> DataFrame:
    """config_id, folds (those without an error) and the mean of each metric over these; infinite where there is none."""
    good = F.when(F.col("error").isNull(), True)
    means = [F.coalesce(F.avg(F.when(good, F.col(m))), F.lit(float("inf"))).alias(m) for m in metrics]
    return runs.groupBy("config_id").agg(F.count(good).alias("folds"), *means)
