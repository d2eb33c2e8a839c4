from __future__ import annotations

import json

import numpy as np
import pytest

from tephra.cli import COMMANDS, main, parser
from tests.helpers import weekly


def test_commands():
    assert len(COMMANDS) == 12
    with pytest.raises(SystemExit):
        parser().parse_args(["nothing"])


def test_index_validate_detect(spark, tmp_path, capsys):
    rng = np.random.default_rng(0)
    n = 150
    x = rng.normal(size=n)
    x[100] += 12
    weekly(spark, {"no2_corrected": x, "valid_coverage": np.full(n, 0.9)}).drop("series_id").write.parquet(str(tmp_path / "signal"))
    weekly(spark, {"value": x + 0.1 * rng.normal(size=n)}).drop("series_id").write.parquet(str(tmp_path / "target"))
    weekly(spark, {"residual_activity": x}).drop("series_id").write.parquet(str(tmp_path / "residual"))
    p = lambda s: str(tmp_path / s)
    assert main(["index", "--signal", p("signal"), "--deseason", "none", "--out", p("index")], spark) == 0
    assert main(["validate", "--index", p("index"), "--target", p("target"), "--out", p("report")], spark) == 0
    assert json.loads((tmp_path / "report/results.json").read_text())["peak_lag"] == 0
    assert main(["detect-events", "--residual", p("residual"), "--z", "5", "--out", p("events")], spark) == 0
    assert spark.read.parquet(p("events")).count() >= 1
    capsys.readouterr()
    assert main(["validate", "--index", p("absent"), "--target", p("target"), "--out", p("r")], spark) == 1
    assert "missing" in capsys.readouterr().err
    assert main(["index", "--signal", p("signal"), "--deseason", "magic", "--out", p("i2")], spark) == 1
