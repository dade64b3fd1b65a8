import pytest

from tessera.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(name, same):
    same(QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(name, spark, sf):
    assert QUERIES[name](spark, sf).count() > 0


def test_nothing_else_imports_this_package():
    from pathlib import Path

    root = Path(__file__).resolve().parents[2]
    for p in (root / "tessera").rglob("*.py"):
        if "llm" not in p.parts:
            assert "llm" not in p.read_text(), p
