import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from factorloom import Model, schema  # noqa: E402
from factorloom.plans.runtime import local_session  # noqa: E402

ROWS = {1: {0: 1, 2: 1, 4: 0.5, 5: 5}, 2: {0: 1, 3: 1, 4: 0.25, 5: 3}, 3: {1: 1, 2: 1, 4: 1, 5: 4}}
CATS = ["user", "user", "item", "item", "context_numerical", "label"]
V = [0.1, 0.2, -0.1, 0.3, 0.05]
M = [[0.1, 0.2, 0.3, -0.1, 0.05], [0.2, -0.1, 0.1, 0.4, -0.2]]


@pytest.fixture(scope="session")
def spark():
    return local_session("4", "tests")


def tiny_lines(changes=(), extra=()):
    """(row, col, cat, val) of the tiny fixture; `changes` maps (row, col) to a value or None to drop."""
    changes = dict(changes)
    lines = [(r, c, CATS[c], float(v)) for r, cells in ROWS.items() for c, v in cells.items()]
    lines = [(r, c, cat, changes.get((r, c), v)) for r, c, cat, v in lines]
    return [line for line in lines if line[3] is not None] + list(extra)


@pytest.fixture
def make_cells(spark):
    def make(changes=(), extra=()):
        return spark.createDataFrame(tiny_lines(changes, extra), schema.CELLS)
    return make


@pytest.fixture
def cells(make_cells):
    return make_cells()


@pytest.fixture
def model(spark):
    rows = [(i, V[i], [M[0][i], M[1][i]]) for i in range(5)]
    return Model(0.1, spark.createDataFrame(rows, schema.FACTORS), 5, 2)
