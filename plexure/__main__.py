"""Command line: list the registered queries, or run one over a folder of tables and write what it gives.

python -m plexure list
python -m plexure run NAME --tables DIR [--out DIR] [--format parquet|csv|json] [--rows N] [--explain]
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from plexure.registry import ORACLE_SQL, QUERIES


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="plexure", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("what", choices=["list", "run"])
    parser.add_argument("name", nargs="?", choices=sorted(QUERIES), metavar="NAME")
    parser.add_argument("--tables", help="folder of <table>.parquet")
    parser.add_argument("--out", help="folder to write; without it the first rows are shown")
    parser.add_argument("--format", default="parquet", choices=["parquet", "csv", "json"])
    parser.add_argument("--rows", type=int, default=20, help="how many rows to show")
    parser.add_argument("--explain", action="store_true", help="show the plan instead")
    given = parser.parse_args(args)
    if given.what == "list":
        for name in sorted(QUERIES):
            print(f"{name}{'' if name in ORACLE_SQL else ' (no SQL)'}")
        return
    if not given.name or not given.tables:
        parser.error("run needs NAME and --tables")
    spark = SparkSession.builder.appName(f"plexure {given.name}").getOrCreate()
    found = QUERIES[given.name](spark, given.tables)
    if given.explain:
        found.explain("formatted")
    elif given.out:
        writer = found.write.mode("errorifexists").format(given.format)
        (writer.option("header", True) if given.format == "csv" else writer).save(given.out)
    else:
        found.show(given.rows, truncate=60)


if __name__ == "__main__":
    main()
