"""The command line and the functions that users hand in."""

from __future__ import annotations

import pytest

from plexure.__main__ import main
from plexure.operators import etl, hooks, selection

SF = "/root/testdata/sf0.001"


def test_queries_run_from_the_command_line(spark, tmp_path, capsys):
    main(["list"])
    assert "cosine_edges\n" in capsys.readouterr().out
    main(["run", "preview", "--tables", SF, "--out", str(tmp_path / "out"), "--format", "csv"])
    assert spark.read.csv(str(tmp_path / "out"), header=True).count() == 10
    main(["run", "preview", "--tables", SF, "--explain"])
    assert "Physical Plan" in capsys.readouterr().out
    main(["run", "preview", "--tables", SF, "--rows", "3"])
    assert "only showing top 3 rows" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        main(["run", "preview"])


def test_functions_that_are_handed_in(spark):
    rows = spark.createDataFrame([(i, float(i) if i % 4 else None) for i in range(10)], "i long, x double").coalesce(1)
    got = {r.i: r.x for r in hooks.transformed(rows, "x", lambda s: s.fillna(0) * 2, "double").collect()}
    assert got == {i: 2.0 * i if i % 4 else 0.0 for i in range(10)}
    sizes = hooks.collated(rows, lambda b: b.assign(n=len(b))[["i", "n"]], "i long, n long", 4).collect()
    assert [r.n for r in sorted(sizes)] == [4] * 8 + [2] * 2
    grid = selection.grid(spark, {"alpha": [0.1, 0.2], "k": [1, 2]})
    scores = hooks.evaluated(grid, lambda c: {"score": c["alpha"] * c["k"]}, "score double").collect()
    assert len(scores) == 4 and all(r.score == r.alpha * r.k for r in scores)
    assert hooks.collated(rows.limit(0), lambda b: b, "i long, x double", 4).count() == 0


def test_the_column_to_stratify_by():
    columns = ["text", "speaker_id", "source", "language"]
    assert etl.strata_column(columns, "text") == "text"
    assert etl.strata_column(columns, "speaker") == "speaker_id"
    assert etl.strata_column(columns[:2], "language") == "speaker_id"
    assert etl.strata_column(["a", "b"], "source") == "a"
    with pytest.raises(ValueError):
        etl.strata_column([], "source")
