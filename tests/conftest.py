import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from clausewise.session import build_session
    s = build_session("local[4]", shuffle_partitions=8, driver_memory="4g",
                      extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="clausewise-tests-", dir="/tmp")})
    yield s
    s.stop()


@pytest.fixture()
def scratch():
    return tempfile.mkdtemp(prefix="clausewise-test-", dir="/tmp")


@pytest.fixture(scope="session")
def frame(spark):
    """The DataFrame of a registered query on the small tables, built once: fitting and
    staging run when a query is built, and the plan guards and the oracle check share it."""
    import __spark_entry__ as E
    made, queries = {}, E.queries()

    def of(name):
        if name not in made:
            made[name] = queries[name](spark, SF_SMALL)
        return made[name]
    return of
