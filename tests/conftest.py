import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from compare import session

    from marketlens.session import tune

    s = tune(session("8"))
    if s.sparkContext.getCheckpointDir() is None:
        s.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    return s


@pytest.fixture(scope="session")
def one(spark):
    """Value of an expression over a single row of named text values."""
    from pyspark.sql import functions as F

    def run(build, **values):
        df = spark.range(1).select(*[F.lit(v).cast("string").alias(k) if v is None or isinstance(v, str) else F.lit(v).alias(k) for k, v in values.items()])
        return df.select(build(*[F.col(k) for k in values]).alias("v")).first()["v"]

    return run
