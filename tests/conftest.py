import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)

DATA = Path(os.environ.get("TESTDATA", "/root/testdata"))


@pytest.fixture(scope="session")
def spark():
    from vellumine.session import local_session

    s = local_session("8", "tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def tiny():
    if not (DATA / "sf0.001").exists():
        pytest.skip("no test tables")
    return str(DATA / "sf0.001")


@pytest.fixture(scope="session")
def small():
    if not (DATA / "sf0.01").exists():
        pytest.skip("no test tables")
    return str(DATA / "sf0.01")


@pytest.fixture(scope="session")
def empty(spark, tiny, tmp_path_factory):
    """The same tables without rows."""
    out = tmp_path_factory.mktemp("empty")
    for p in Path(tiny).glob("*.parquet"):
        spark.read.parquet(str(p)).limit(0).coalesce(1).write.parquet(str(out / p.name))
    return str(out)


@pytest.fixture(scope="session")
def clashing(spark, tiny, tmp_path_factory):
    """The same tables with every row twice and extra columns under names that operators use inside."""
    from pyspark.sql import functions as F

    out = tmp_path_factory.mktemp("clashing")
    for p in Path(tiny).glob("*.parquet"):
        df = spark.read.parquet(str(p))
        extra = [F.lit(i).alias(n) for i, n in enumerate(("k", "t", "v", "n", "tag", "key", "rank", "h", "label", "origin", "item_id", "known", "page", "word", "kind", "x")) if n not in df.columns]
        df.unionByName(df).select("*", *extra).coalesce(1).write.parquet(str(out / p.name))
    return str(out)
