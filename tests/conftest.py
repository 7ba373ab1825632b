import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from loomq.session import expose_package, local_session

    session = local_session(4, 4, "4g")
    session.sparkContext.setLogLevel("ERROR")
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    expose_package(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def value(spark):
    """The value of a column expression over some literals."""

    def evaluate(build, *literals):
        from pyspark.sql import functions as F

        columns = [F.lit(x) if not isinstance(x, tuple) else F.lit(x[0]).cast(x[1]) for x in literals]
        return spark.range(1).select(build(*columns).alias("v")).first()["v"]

    return evaluate
