"""Every registered query against its comparison SQL, at the smallest scale that has rows."""

import pytest
from compare import compare, connect

from workloom.plans import load_all
from workloom.plans.registry import ORACLES, QUERIES

load_all()
FOLDER = "/root/testdata/sf0.001"
#: Queries whose rows are too few at the smallest scale to have a result.
LARGER = dict.fromkeys(("A1_runtime_utilisation", "J5_samples_in_run", "U3_set_difference"), "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def connections():
    return {folder: connect(folder) for folder in (FOLDER, *LARGER.values())}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, connections, name):
    folder = LARGER.get(name, FOLDER)
    if name in ORACLES:
        note = compare(spark, connections[folder], folder, name, QUERIES[name], ORACLES[name])
        assert note is None, note
    else:
        assert QUERIES[name](spark, folder).count() > 0


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)
