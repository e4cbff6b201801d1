"""Every query with SQL against DuckDB, on the smallest tables; the others for their shape."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tidemill.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLES = catalog.load()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(plain(x) for x in value)
    return value


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(x) for x in r) for r in df.select(*columns).collect()), key=repr)
    answer = duck.execute(ORACLES[name])
    names = [d[0] for d in answer.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in answer.fetchall()), key=repr)
    assert got == want


def texts(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def by_id(rows):
    out = {}
    for r in rows:
        out.setdefault(r["id"], []).append(r)
    return {k: sorted(v, key=lambda r: r["piece"]) for k, v in out.items()}


def line_chunks(spark, rows):
    whole = texts(spark)
    for k, pieces in by_id(rows).items():
        assert [r["piece"] for r in pieces] == list(range(pieces[0]["pieces"])) and all(r["n"] <= 4000 for r in pieces)
        # Between pieces one line end is lost, or nothing where a line was too long itself.
        assert len(whole[k]) - len(pieces) + 1 <= sum(r["n"] for r in pieces) <= len(whole[k])
    assert set(by_id(rows)) == set(whole)


def overlapping(spark, rows):
    whole = texts(spark)
    for k, pieces in by_id(rows).items():
        assert [r["piece"] for r in pieces] == list(range(pieces[0]["pieces"])) and all(r["n"] <= 4502 for r in pieces)
        assert sum(r["n"] for r in pieces) >= len(whole[k].strip()) - 2 * len(pieces) and (len(pieces) > 1) == (len(whole[k]) >= 4503)
    assert set(by_id(rows)) == set(whole)


def groups(spark, rows):
    import collections

    assert collections.Counter(r["id"] for r in rows) == dict.fromkeys(texts(spark), 1)
    sizes = collections.Counter(r["rep"] for r in rows)
    component = {r["id"]: r["component"] for r in rows}
    assert all(r["n"] == sizes[r["rep"]] and component[r["rep"]] == r["component"] <= r["id"] for r in rows) and max(sizes.values()) > 1


def sections(spark, rows):
    sizes = {r["label"]: r["count"] for r in spark.read.parquet(f"{SF}/embeddings.parquet").groupBy("label").count().collect()}
    assert {r["label"]: r["n"] for r in rows} == sizes and all(1 <= r["sections"] <= max(1, min(8, r["n"] // 12)) for r in rows)


def embedded(spark, rows):
    whole = texts(spark)
    assert {r["id"] for r in rows} == set(whole) and all(r["pieces"] >= 1 and abs(r["norm"] - 1) < 1e-5 for r in rows if whole[r["id"]].strip())


LAWS = {"txt04_line_chunks": line_chunks, "txt11_overlapping_pieces": overlapping, "vec05_near_groups": groups, "vec08_sections": sections, "ext02_embed_long": embedded}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    """What SQL does not state: each query's own law."""
    rows = QUERIES[name](spark, SF).collect()
    assert rows
    LAWS[name](spark, rows)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_range_filter_reaches_the_scan(spark):
    plan = QUERIES["flt04_country_range"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan and "LessThanOrEqual(ts" in plan
    assert "value" not in plan.split("ReadSchema")[1]


def test_no_query_multiplies_rows_of_two_tables(spark):
    for name in ("jon16_coverage", "agg19_pipeline_state", "jon04_channel_countries"):
        assert "CartesianProduct" not in QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
