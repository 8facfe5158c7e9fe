import pytest

from tessel.plans import registry
from tests import oracle

pytestmark = pytest.mark.skipif(not oracle.available(), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def db():
    return oracle.database()


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_twin(spark, db, name):
    got, want = registry.QUERIES[name](spark, oracle.SF).toPandas(), db.sql(registry.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert oracle.rows(got) == oracle.rows(want)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, oracle.SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
