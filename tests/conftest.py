import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from rinsework import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def texts(spark):
    """A one-column table ``v`` of texts with their position ``i``."""

    def make(values):
        return spark.createDataFrame(list(enumerate(values)), "i long, v string")

    return make


@pytest.fixture(scope="session")
def largest_method(spark):
    """Bytes of the largest method generated for a plan without shuffles; the JVM compiles none beyond 8,000."""

    def measure(df):
        debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
        stages = debug.codegenStringSeq(df._jdf.queryExecution().executedPlan())
        return max(stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size()))

    return measure
