"""Every registered query of the library against its SQL oracle on the smallest tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

from strandweave.plans.registry import ORACLES, QUERIES

DIR = os.environ.get("STRANDWEAVE_SF", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame):
    frame = frame[sorted(frame.columns)]
    value = lambda x: None if x is None or x is pd.NA or (isinstance(x, float) and math.isnan(x)) else round(float(x), 6) if isinstance(x, float) else x
    return sorted((tuple(value(x) for x in r) for r in frame.astype(object).itertuples(index=False)), key=repr)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    got = QUERIES[name](spark, DIR).toPandas()
    assert name not in ORACLES or rows(got) == rows(con.execute(ORACLES[name]).df())
