"""Every registered query of the library against its oracle on the smallest tables."""

import oracle
import pytest
from pyspark.sql import functions as F

from sparkloom.plans.catalogue import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    assert name in ORACLE
    assert oracle.compare(spark, QUERIES[name], ORACLE[name], "/root/testdata/sf0.001") > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("name", ["join_left", "join_right", "join_semi", "join_anti", "join_where_2", "cumprod"])
def test_whole_tables(name):
    """No filter cuts the tables of these queries."""
    sql = ORACLE[name]
    assert "%" not in sql and ("WHERE" not in sql or name in ("join_semi", "join_anti"))


def test_joins_have_rows_without_a_match(spark):
    got = {name: QUERIES[f"join_{name}"](spark, "/root/testdata/sf0.001") for name in ("left", "right", "semi", "anti")}
    customers = spark.read.parquet("/root/testdata/sf0.001/customer.parquet").count()
    alone = got["anti"].count()
    assert alone > 0 and got["semi"].count() == customers - alone > 0
    assert got["left"].where("o_orderkey IS NULL").count() == got["right"].where("o_orderkey IS NULL").count() == alone


def test_whole_texts_and_sorted_rows(spark):
    sf = "/root/testdata/sf0.001"
    texts = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id AS d", "length(text) AS chars")
    for name, column in (("str_lengths", "rev"), ("str_regex", "r")):
        got = QUERIES[name](spark, sf).join(texts, F.col("doc_id") == F.col("d"))
        assert got.count() == texts.count() and got.where(f"length({column}) <> chars").count() == 0
    ranked = QUERIES["sort_nulls_last"](spark, sf)
    nulls = ranked.where("s IS NULL")
    assert ranked.count() == spark.read.parquet(f"{sf}/orders.parquet").count() and nulls.count() > 0
    assert nulls.agg(F.min("row_index")).first()[0] == ranked.where("s IS NOT NULL").count()


@pytest.mark.parametrize("gone", [["sparkloom/llm"], ["sparkloom/llm", "corpus_pipeline.py"]])
def test_entry_without_the_subpackage(tmp_path, gone):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    skip = shutil.ignore_patterns("__pycache__", *[Path(g).name for g in gone])
    shutil.copytree(root / "sparkloom", tmp_path / "sparkloom", ignore=skip)
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if name not in gone and (root / name).exists():
            shutil.copy(root / name, tmp_path / name)
    code = "import __spark_entry__ as e; assert not [q for q in e.queries() if q.startswith('op') or q == 'pipeline']; print(len(e.queries()), len(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin"})
    assert done.returncode == 0, done.stderr
