"""The queries of the operators against their SQL, on the driver's smallest tables, and op8's columns against a count by hand."""

import collections
import os
import zlib

import duckdb
import pytest

from tidemill.llm import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    answer = duck.execute(queries.ORACLES[name])
    names = [d[0] for d in answer.description]
    assert sorted(names) == columns
    want = sorted((tuple(r[names.index(c)] for c in columns) for r in answer.fetchall()), key=repr)
    got = sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert [pytest.approx(x) if isinstance(x, float) else x for x in w] == list(g)


def test_shards_of_all_documents(spark, duck):
    texts = dict(duck.execute("select doc_id, text from documents").fetchall())
    rows = queries.op8_shards(spark, SF).collect()
    assert collections.Counter(r["doc_id"] for r in rows) == collections.Counter(texts.keys())
    shards = collections.defaultdict(list)
    for r in rows:
        said = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(said) + 8, zlib.crc32(said), "rows", None)
        shards[r["shard"]].append(r["slot"])
    assert set(shards) == set(range(24)) and len({len(v) for v in shards.values()}) <= 2
    assert all(sorted(v) == list(range(len(v))) for v in shards.values())
