"""Registered queries against DuckDB on the smallest tables, and the shape of their plans."""

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, rows_of
from helioframe.operators import catalog as cg
from helioframe.operators import islands as isl
from helioframe.plans.fixtures import CADENCE, lc

SF = "/root/testdata/sf0.001"
SAMPLE = ["swpc_detect", "run_lengths", "class_text", "gti_filter", "label_upcoming", "coincidence_catalog", "quality_flags", "saturation", "rolling_p10_bg",
          "linear_interp", "hope_score", "event_recency", "window_stats", "power_law_gamma", "lomb_scargle", "mutual_information", "lag_edges", "auc_scores", "stream_sessions"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, con, name):
    got = entry.queries()[name](spark, SF).toPandas()
    want = con.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


@pytest.fixture
def quiet(tmp_path):
    """Six days of two channels whose bins stay near 50; one bin of the last days stands above 60: days of one and of two blocks, no flare."""
    value = "50 + (b * 37 + d * 11) % 64 / 16.0 + CASE WHEN d >= 4 AND b = 40 + d THEN 15 ELSE 0 END"
    duckdb.sql(f"""COPY (SELECT d * 144 + b AS event_id, TIMESTAMP '2024-01-30' + to_seconds(d * 86400 + b * 600 + 5) AS ts, 1::BIGINT AS user_id, c AS event_type, {value} AS value,
      '' AS props FROM (SELECT range AS d FROM range(6)), (SELECT range AS b FROM range(144)), (SELECT unnest(['view', 'error']) AS c)) TO '{tmp_path}/events.parquet'""")
    return str(tmp_path)


@pytest.mark.parametrize("name, rows", [("block_events", 8), ("catalog_cube", 1)])
def test_quiet_days_equal_sql(spark, quiet, name, rows):
    got = entry.queries()[name](spark, quiet).toPandas()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{quiet}/events.parquet'")
    want = con.execute(entry.oracle_sql()[name]).df()
    assert len(want) >= rows
    assert rows_of(got) == rows_of(want)


def test_days_of_two_blocks_equal_sql(spark, con):
    """Sparse days: 37 of them have two blocks, whose z is 1 up to the last bit."""
    test_query_equals_sql(spark, con, "block_events")


@pytest.mark.parametrize("events", [[], [("M", None, 3.0), ("M", "view", None), (None, None, 5.0), (None, None, 4.0), ("X", "view", 9.0)]])
def test_cube_equals_sql(spark, events):
    """With and without events, missing dimensions apart from totals."""
    table = "a string, b string, peak_flux double"
    got = cg.catalog_cube(spark.createDataFrame(events, table), ["a", "b"]).toPandas()
    con = duckdb.connect()
    con.execute("CREATE TABLE ev (a VARCHAR, b VARCHAR, peak_flux DOUBLE)")
    for row in events:
        con.execute("INSERT INTO ev VALUES (?, ?, ?)", row)
    want = con.execute("SELECT a, b, count(*) AS n, max(peak_flux) AS max_peak, grouping_id(a, b) AS level FROM ev GROUP BY CUBE (a, b)").df()
    assert rows_of(got) == rows_of(want)


def test_registry_is_consistent():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 150


def test_detection_shuffles_raw_rows_once(spark):
    """One for binning (after a partial aggregate); the gap filling and the Arrow group of the background deal binned rows only."""
    df = isl.detect_swpc(lc(spark, SF), cadence=CADENCE, threshold=50.0, window=24, min_run=1, min_duration=3)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 3
    assert "ReadSchema: struct<ts:timestamp_ntz,event_type:string,value:double>" in plan


def test_entry(spark):
    assert entry.entry(spark).count() > 0
