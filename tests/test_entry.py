"""The driver's contract, over the smallest tables."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

DATA = Path("/root/testdata/sf0.001")
REPO = Path(__file__).resolve().parent.parent


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() == 6


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["key_mixed", "reduce_nanargmax", "scan_cumsum_partitioned", "layout_cohorts", "sparse_mean"])
def test_like_sql(spark, name):
    con = duckdb.connect()
    for f in DATA.iterdir():
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    found, want = entry.queries()[name](spark, str(DATA)), con.sql(entry.oracle_sql()[name])
    assert sorted(found.columns) == sorted(want.columns)
    text = lambda rows, names: sorted(repr([row[names.index(c)] for c in sorted(names)]) for row in rows)
    assert text([tuple(r) for r in found.collect()], found.columns) == text(want.fetchall(), list(want.columns))


@pytest.mark.parametrize("gone", [(), ("corpus_pipeline.py",)])
def test_imports_without_the_pipeline(tmp_path, gone):
    for p in REPO.iterdir():
        if p.name not in (".git", "gridfold", "tests", *gone):
            (tmp_path / p.name).symlink_to(p)
    (tmp_path / "gridfold").mkdir()
    for p in (REPO / "gridfold").iterdir():
        if p.name != "llm":
            (tmp_path / "gridfold" / p.name).symlink_to(p)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'key_expected' in q and not any(k.startswith('op') for k in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
