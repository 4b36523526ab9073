import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from tablens.session import ensure_checkpoint_dir

    s = (SparkSession.builder.master("local[4]").appName("tablens-tests")
         .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(s)
    yield s


@pytest.fixture(scope="session")
def blobs(spark):
    """Three well separated Gaussian blobs in 4-D (stands in for a small labelled table)."""
    import numpy as np

    rng = np.random.default_rng(0)
    centers = np.array([[0, 0, 0, 0], [8, 8, 0, 0], [0, 8, 8, 8]], dtype=float)
    rows = []
    for k, c in enumerate(centers):
        for _ in range(50):
            rows.append((len(rows), *[float(v) for v in c + rng.normal(0, 0.7, 4)], k))
    return spark.createDataFrame(rows, "id long, a double, b double, c double, d double, truth int")
