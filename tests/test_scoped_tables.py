"""The tables that are in a folder, not those of a fixed list."""

import os
import shutil

import duckdb
import pytest

from marlstone.queries import catalogue
from marlstone.sources import catalog


@pytest.fixture
def folder(tmp_path, sf_dir):
    """The given tables, a ninth one whose name ends in s, a table in parts, and what is no table."""
    for name in os.listdir(sf_dir):
        os.symlink(f"{sf_dir}/{name}", tmp_path / name)
    shutil.copy(f"{sf_dir}/region.parquet", tmp_path / "returns.parquet")
    (tmp_path / "ratings.parquet").mkdir()
    shutil.copy(f"{sf_dir}/region.parquet", tmp_path / "ratings.parquet" / "part-0.parquet")
    for name in ("notes", "_drafts.parquet", ".drafts.parquet", "results.csv"):
        (tmp_path / name).write_text("")
    return str(tmp_path)


def test_scoped_tables_are_those_of_the_folder(spark, folder):
    queries, oracle = catalogue()
    con = duckdb.connect()
    for name in os.listdir(folder):
        if name.endswith(".parquet") and name[0] not in "._":
            path = f"{folder}/{name}" + ("/*.parquet" if os.path.isdir(f"{folder}/{name}") else "")
            con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{path}'")
    got = sorted(r["table"] for r in queries["scoped_tables"](spark, folder).collect())
    assert got == sorted(r[0] for r in con.execute(oracle["scoped_tables"]).fetchall())
    assert {"returns", "ratings"} < set(got)


def test_listing_takes_any_file_system(spark, folder):
    plain = catalog.tables_at(spark, folder)
    assert catalog.tables_at(spark, f"file://{folder}") == plain and len(plain) == 16
