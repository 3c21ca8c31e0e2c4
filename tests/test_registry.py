import importlib
import sys

import duckdb
import pytest

from loomwork.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_its_sql(spark, sf_dir, duck, name):
    df = registry.queries()[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in cols)) for r in df.collect())
    found = duck.sql(registry.oracle_sql()[name])
    assert sorted(found.columns) == cols
    at = [found.columns.index(c) for c in cols]
    assert got == sorted(repr(tuple(plain(r[i]) for i in at)) for r in found.fetchall())


def test_flagship_runs(spark, sf_dir):
    assert registry.flagship(spark, sf_dir).count() > 0


def test_written_outputs_account_for_every_document(spark, sf_dir):
    done = registry.o3_write_outputs(spark, sf_dir).collect()
    assert {r.kind for r in done} == {"json", "csv", "text"} and all(r.bytes > 0 for r in done)


def test_entry_imports_without_the_training_data_parts(monkeypatch):
    import loomwork

    for name in ("loomwork.llm", "loomwork.llm.queries", "corpus_pipeline"):
        monkeypatch.setitem(sys.modules, name, None)  # so that importing it fails
    monkeypatch.delattr(loomwork, "llm", raising=False)
    sys.modules.pop("__spark_entry__", None)
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.queries()) == set(registry.queries()) and set(entry.oracle_sql()) == set(registry.oracle_sql())
    sys.modules.pop("__spark_entry__", None)
