"""Every registered query against its SQL, on the smallest data."""

import pytest
from compare import connect, differences

from tidewire.queries import load

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = load()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    assert differences(QUERIES[name](spark, FOLDER), con, ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_every_inventory_id_is_registered():
    wanted = {
        "src": range(1, 13), "snk": range(1, 6), "prj": range(1, 12), "flt": range(1, 16), "join": range(1, 10),
        "agg": range(1, 12), "win": range(1, 6), "lim": range(1, 7), "set": range(1, 3), "scl": range(1, 35),
        "ml": range(1, 6), "str": range(1, 2), "udf": range(1, 4), "stg": range(1, 12),
    }
    have = {name.split("_")[0] for name in QUERIES}
    assert {f"{k}{i}" for k, r in wanted.items() for i in r} - have == set()
