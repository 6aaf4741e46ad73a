import os
import shutil
import subprocess
import sys

import duckdb
import pandas as pd
import pytest

from memloom import queries as base

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(frame):
    def value(x):
        if not hasattr(x, "__len__") and pd.isna(x):
            return None
        x = x.item() if hasattr(x, "item") else x
        return float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x

    columns = sorted(frame.columns)
    return columns, sorted((tuple(map(value, r)) for r in frame[columns].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", list(base.CATALOGUE))
def test_query_against_sql(spark, sf_dir, duck, name):
    run, sql = base.CATALOGUE[name]
    frame = run(spark, sf_dir).toPandas()
    if sql:
        assert plain(frame) == plain(duck.sql(sql).df())
    else:
        assert len(frame.columns) > 0


def test_entry_without_the_training_data_folders(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", ".pytest_cache", "spark-warehouse"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 's04_bm25_top20' in q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=copy, env=env, check=True, timeout=120)


def test_nothing_else_imports_the_training_data_folder():
    for folder, _, names in os.walk(os.path.join(ROOT, "memloom")):
        if os.path.basename(folder) == "llm":
            continue
        for name in names:
            if name.endswith(".py"):
                text = open(os.path.join(folder, name)).read()
                assert "memloom.llm" not in text and "from .llm" not in text and "from ..llm" not in text


def test_stream_gives_what_the_batch_fold_gives(spark, sf_dir):
    from memloom.operators import lifecycle

    batch = lifecycle.fold_receipts(base.proposals(spark, sf_dir)).select("entity", "attribute", "seq", "status")
    stream = base.st02_stream_lifecycle(spark, sf_dir)
    assert sorted(map(tuple, stream.collect())) == sorted(map(tuple, batch.collect()))
