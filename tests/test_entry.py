"""The contract with the driver, with and without the subpackage for text."""

import builtins
import importlib
import sys
from pathlib import Path

import pytest

DATA = "/root/testdata/sf0.001"


def fresh(monkeypatch, without_text):
    for name in [m for m in sys.modules if m == "__spark_entry__" or m.startswith("tokenloom.llm")]:
        monkeypatch.delitem(sys.modules, name)
    if without_text:
        real = builtins.__import__

        def imports(name, globals=None, locals=None, fromlist=(), level=0):
            if name.startswith("tokenloom.llm"):
                raise ImportError(name)
            return real(name, globals, locals, fromlist, level)

        monkeypatch.setattr(builtins, "__import__", imports)
    return importlib.import_module("__spark_entry__")


def test_rest_works_without_the_text_operators(monkeypatch):
    entry = fresh(monkeypatch, True)
    assert entry.llm is None and {"p4_found", "p5_found", "p6_found", "rollup_all"} <= set(entry.queries()) and not {"p1_found", "p8_ids"} & set(entry.queries())


def test_every_sql_has_its_query(monkeypatch):
    entry = fresh(monkeypatch, False)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_else_imports_the_text_operators():
    root = Path(__file__).resolve().parents[1] / "tokenloom"
    assert not [p for p in root.rglob("*.py") if "llm" not in p.relative_to(root).parts and "tokenloom.llm" in p.read_text()]


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")
def test_flagship(spark, monkeypatch):
    out = fresh(monkeypatch, False).entry(spark)
    assert out.count() > 0 and out.columns[:2] == ["project", "day_text"]


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")
@pytest.mark.parametrize("name", ["p4_found", "p6_found", "dedup_rank", "rollup_model", "report_daily_csv", "device_merge", "window_high_water_delta", "replay_offsets"])
def test_queries_agree_with_their_sql(spark, monkeypatch, name):
    duckdb = pytest.importorskip("duckdb")
    entry = fresh(monkeypatch, False)
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    want = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    shown = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    rows = sorted(tuple(map(shown, r)) for r in want.fetchall())
    assert sorted(tuple(shown(r[c]) for c in columns) for r in entry.queries()[name](spark, DATA).collect()) == rows
