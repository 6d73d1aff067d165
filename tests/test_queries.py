"""Every query of the library against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from trackengine import queries as library

from .conftest import SMALL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{SMALL}/{t}.parquet"):
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    return repr(float(v)) if isinstance(v, float) else str(v)


def rows(df):
    names = sorted(df.columns)
    return sorted(tuple(plain(v) for v in r) for r in df[names].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(library.oracle_sql()))
def test_equals_sql(spark, con, name):
    got, want = library.queries()[name](spark, SMALL).toPandas(), con.sql(library.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(library.queries()) - set(library.oracle_sql())))
def test_gives_rows(spark, name):
    assert library.queries()[name](spark, SMALL).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["seqname", "from", "to", "strand", "test"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def repeated(spark, folder, times, *tables):
    """Tables of `times` as many rows."""
    for t in tables:
        spark.read.parquet(f"{SMALL}/{t}.parquet").withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(times)))).drop("copy").write.parquet(f"{folder}/{t}.parquet")
    c = duckdb.connect()
    for t in tables:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    return c


def test_any_form_of_counts_above_a_hundred(spark, tmp_path):
    con = repeated(spark, tmp_path, 150, "lineitem")
    got, want = library.queries()["em_nonparam"](spark, str(tmp_path)).toPandas(), con.sql(library.oracle_sql()["em_nonparam"]).df()
    assert want["x"].max() > 100 and rows(got) == rows(want)


def test_logarithms_that_round_to_zero_keep_their_sign(spark, tmp_path):
    """repr() tells -0.0 from 0.0."""
    events = [(i, v, u) for i, (v, u) in enumerate([(0.0, -15), (0.0, -18), (0.0, -90), (0.0, 0), (1e-9, -15), (3.5, 3), (2.0, 3)])]
    spark.createDataFrame(events, "event_id long, value double, user_id long").write.parquet(f"{tmp_path}/events.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    for name in ("logsub", "logadd"):
        got, want = library.queries()[name](spark, str(tmp_path)).toPandas(), c.sql(library.oracle_sql()[name]).df()
        assert rows(got) == rows(want)
        assert name == "logadd" or sum(y == 0 and math.copysign(1, y) < 0 for y in want["y"]) >= 2
