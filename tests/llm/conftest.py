import os

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf_dir():
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    return SF


@pytest.fixture
def frame(spark):
    """Rows as a DataFrame with doc_id, text, source and a column of a name that operators use inside."""
    def make(rows, ddl="doc_id long, text string, source string, key string"):
        return spark.createDataFrame([tuple(r) + (None,) * (4 - len(r)) for r in rows], ddl)
    return make
