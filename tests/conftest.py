import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF001 = "/root/testdata/sf0.01"
SF0001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from matstream.session import local_session

    s = local_session("*", shuffle_partitions=8, app="matstream-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def emb_rows(spark):
    from matstream.sources.frames import from_array

    emb = spark.read.parquet(f"{SF001}/embeddings.parquet")
    return from_array(emb, "embedding", row_id="vec_id")


@pytest.fixture(scope="session")
def emb_matrix(emb_rows):
    import numpy as np

    pdf = emb_rows.orderBy("row_id").toPandas()
    return np.array([list(r) for r in pdf["features"]], dtype=np.float64)


@pytest.fixture()
def tmp_dir():
    import tempfile

    return tempfile.mkdtemp(prefix="matstream-test-", dir="/tmp")
