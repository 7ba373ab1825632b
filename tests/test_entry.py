import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from loomq.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def shown(x):
    if x is None or x != x:
        return None
    if isinstance(x, (float, int)) and not isinstance(x, bool):
        return round(float(x), 9)
    return str(x)


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0


def test_names():
    queries, sql = entry_module.queries(), entry_module.oracle_sql()
    assert set(sql) <= set(queries) and set(catalogue.QUERIES) <= set(queries)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(shown(r[c]) for c in columns) for r in df.collect()), key=str)
    if name in catalogue.ORACLES:
        result = duck.execute(catalogue.ORACLES[name])
        names = [d[0] for d in result.description]
        assert sorted(names) == columns
        at = [names.index(c) for c in columns]
        assert got == sorted((tuple(shown(r[i]) for i in at) for r in result.fetchall()), key=str)


@pytest.mark.parametrize("missing", ["folders", "library"])
def test_works_without_the_training_data_part(tmp_path, missing):
    """With both folders and the pipeline gone, or a library of theirs missing, every other query is there."""
    root = Path(entry_module.__file__).parent
    for name in ("loomq", "__spark_entry__.py", "corpus_pipeline.py"):
        if (root / name).exists():  # the pipeline may be taken away here too
            (shutil.copytree if (root / name).is_dir() else shutil.copy)(root / name, tmp_path / name)
    blocked = ""
    if missing == "folders":
        shutil.rmtree(tmp_path / "loomq/llm", ignore_errors=True)
        (tmp_path / "corpus_pipeline.py").unlink(missing_ok=True)
    else:
        blocked = "import sys; sys.modules['ahocorasick'] = None; "
    code = blocked + "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op1_') for n in e.queries()), set(e.oracle_sql()) <= set(e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) == len(catalogue.QUERIES) and out[1:] == ["False", "True"]


def test_shared_tables(spark):
    from loomq import session

    folder = session.shared_folder(spark, "test")
    with session.scratch(f"{folder}/work") as work:
        df = session.store(spark.range(5).withColumn("n", F.monotonically_increasing_id()), "rows")
    assert df.count() == 5 and all(work.split("/")[-1] in f for f in df.inputFiles())
    session.remove_folder(spark, work)
    assert not Path(work.removeprefix("file:")).exists() and Path(folder.removeprefix("file:")).exists()
    other = session.store(spark.range(2).toDF("n"), "rows")
    assert folder.split("/")[-1] not in other.inputFiles()[0] and other.count() == 2
