"""Every registered query against its SQL, over whole small tables."""

from __future__ import annotations

import os
import shutil

import duckdb
import pytest

import __spark_entry__ as entry
from lethe.plans import suite

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(sf_dir, t)}.parquet'")
    return c


def plain(rows, columns) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    say = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(say(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(suite.ORACLES))
def test_query_matches_its_sql(spark, duck, sf_dir, name):
    df = suite.QUERIES[name](spark, sf_dir)
    got = duck.execute(suite.ORACLES[name])
    columns = [d[0] for d in got.description]
    assert sorted(df.columns) == sorted(columns)
    assert plain([tuple(r) for r in df.collect()], df.columns) == plain(got.fetchall(), columns)


@pytest.mark.parametrize("name", ["s10_folder_scan", "s11_flat_scan"])
def test_folder_scans_where_tables_are_folders_of_part_files(spark, duck, sf_dir, tmp_path, name):
    for t in TABLES:
        to = tmp_path / f"{t}.parquet"
        if t in ("documents", "labels", "pages", "conversations", "embeddings"):
            to.mkdir()
        for i in range(2 if to.is_dir() else 1):
            shutil.copyfile(f"{sf_dir}/{t}.parquet", to / f"part-{i:04}.parquet" if to.is_dir() else to)
    got = [r.name for r in suite.QUERIES[name](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(r[0] for r in duck.execute(suite.ORACLES[name]).fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
