from __future__ import annotations

import ast
import pathlib

import pytest

import __spark_entry__ as entry
from tephra import registry

ROOT = pathlib.Path(__file__).parent.parent


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(registry.QUERIES) > 90


def test_the_rest_does_not_import_the_optional_part():
    for path in (ROOT / "tephra").rglob("*.py"):
        if "llm" in path.parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any(n.startswith(("tephra.llm", "corpus_pipeline")) for n in names), path


def test_entry(spark, sf_dir):
    assert registry.QUERIES[registry.FLAGSHIP](spark, sf_dir).count() == 17


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_sql(spark, sf_dir, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for p in pathlib.Path(sf_dir).iterdir():
        c.execute(f"create view {p.stem} as select * from '{p}'")
    got = registry.QUERIES[name](spark, sf_dir)
    columns = sorted(got.columns)
    got, want = _rows(got.toPandas()[columns]), _rows(c.execute(registry.ORACLES[name]).df()[columns])
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        # both sides round, and may do so to either side of a half
        assert all(abs(x - y) <= 2e-3 + 1e-9 * abs(y) if isinstance(x, float) and isinstance(y, float) else x == y for x, y in zip(a, b, strict=True)), (a, b)


def _rows(df):
    """Rows in an order that small differences of numbers don't change; dates without a time of day."""

    def plain(v):
        if v is None or v != v:
            return ""
        if isinstance(v, float):
            return v
        return str(v)[:10] if hasattr(v, "year") else str(v)

    rows = [tuple(plain(v) for v in r) for r in df.astype(object).itertuples(index=False)]
    return sorted(rows, key=lambda r: ([x for x in r if not isinstance(x, float)], [round(x, 1) for x in r if isinstance(x, float)], [x for x in r if isinstance(x, float)]))
