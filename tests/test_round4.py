"""Queries against their SQL on tables with odd rows, or with more rows than a limit of old."""

import glob
import json

import duckdb
import pyarrow as pa

from sparkfind import plans
from sparkfind.operators import index
from sparkfind.plans import disk, indexed
from sparkfind.sources import remote


def differences(spark, folder, name, **tables):
    """Rows of a query that its SQL in DuckDB doesn't give, and the other way round, over tables of the folder."""
    con = duckdb.connect()
    for table, schema_rows in tables.items():
        schema, rows = schema_rows
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{table}.parquet")
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    plans.QUERIES[name](spark, str(folder)).write.parquet(f"{folder}/found")
    con.sql(f"CREATE TABLE a AS SELECT * FROM '{folder}/found/*.parquet'")
    con.sql(f"CREATE TABLE b AS {plans.SQL[name]}")
    return [con.sql(f"SELECT * FROM {x} EXCEPT ALL SELECT * FROM {y}").fetchall() for x, y in (("a", "b"), ("b", "a"))]


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def test_embed_pending_of_odd_rows(spark, tmp_path):
    """Empty and missing texts have no document, and a file without a name has no hash."""
    texts = [None, "", " ", "x", "\n" * 5000, "é word\n" * 900, "x" * 250_000]
    rows = [(i, t, "en", "src1", 0) for i, t in enumerate(texts)] + [(10, "a" * 3000, None, "src1", 0), (11, "b", "en", None, 0), (12, "", None, None, 0)]
    assert differences(spark, tmp_path, "embed_pending", documents=(DOCUMENTS, rows)) == [[], []]


def test_starred_pages_are_all_read(spark, tmp_path):
    """A listing of more than 200 pages is read whole, by 200 tasks at most; with a number of pages no more than these."""
    rows = [(k * 3, f"name {k}", f"b{k % 5}", k % 50) for k in range(20_250)]
    assert differences(spark, tmp_path, "starred_pages", part=("p_partkey long, p_name string, p_brand string, p_size int", rows)) == [[], []]
    runs = disk.part_runs(spark, str(tmp_path))
    listed = lambda **options: remote.list_starred(spark, "t", transport="sparkfind.plans.disk:part_pages", endpoint=runs, **options)
    assert listed().rdd.getNumPartitions() <= remote.MOST_PAGES and listed(pages="201").count() == 20_100
    for pages in (1, 199, 5000):
        last = remote.last_page(lambda url, head: (200, {}, json.dumps([0] * (100 if int(url.rsplit("page=", 1)[1]) < pages else 7)).encode()), "t", "https://x", None)
        assert last == pages


def test_dead_rows_stand_once(spark):
    """A block's dead rows are listed in one row before its postings, in whatever batches these come."""
    row = lambda block, ids, term="a": {"term": term, "origin": 1, "block": block, "most": [1], "least": 1, "ids": ids, "ds": [1] * len(ids), "at": list(range(len(ids))), "pos": [0] * len(ids), "gone": None}
    mark = lambda block, gone: dict.fromkeys(row(0, []), None) | {"origin": 1, "block": block, "gone": gone}
    rows = [mark(0, [1, 3]), row(0, [1, 2, 3]), row(0, [3], "b"), row(1, [1, 3]), mark(2, [7]), row(2, [6, 7]), row(2, [7, 8], "b")]
    schema = pa.schema([("term", pa.string()), ("origin", pa.int32()), ("block", pa.int64()), ("most", pa.list_(pa.int32())), ("least", pa.int32()), ("ids", pa.list_(pa.int64())), *[(c, pa.list_(pa.int32())) for c in ("ds", "at", "pos")], ("gone", pa.list_(pa.int64()))])
    want = [("a", 0, [2]), ("a", 1, [1, 3]), ("a", 2, [6]), ("b", 2, [8])]
    for size in (1, 3, 99):
        batches = [pa.RecordBatch.from_pylist(rows[i : i + size], schema) for i in range(0, len(rows), size)]
        assert [(r["term"], r["block"], r["ids"]) for b in index._without(1)(batches) for r in b.to_pylist()] == want


def test_one_build_with_few_files(spark, sf):
    """The queries after batches share an index, of which a batch's counts have a file for each lead, not one for each task and lead."""
    made = indexed.after_batches(spark, sf)
    assert indexed.after_batches(spark, sf) is made
    path = made.store.path.removeprefix("file://")
    for s in made.store.latest()[1]["segments"]:
        leads = glob.glob(f"{path}/{s['stats']}/lead=*")
        assert leads and all(len(glob.glob(f"{x}/*.parquet")) == 1 for x in leads)
