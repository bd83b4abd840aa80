"""What the engine keeps on disk: states of tables, the text index and its batches."""

import glob
import threading

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkfind.operators import fts, index, search, snapshots, vector_store

WEIGHTS = {"title": 4.0, "body": 1.0}


def hits(df):
    return [(r["id"], round(r["score"], 9)) for r in df.collect()]


def test_states_are_whole(spark, tmp_path):
    store = snapshots.Snapshots(spark, f"file://{tmp_path}/s")
    a, b = spark.createDataFrame([(1, "x")], "id long, v string"), spark.createDataFrame([(2,)], "id long")
    assert store.latest() == (0, {}) and store.read("a") == [None]
    assert store.write(lambda: {"a": a, "b": b}) == 1
    # of a change that fails between two tables nothing is seen
    broken = b.select(F.raise_error(F.lit("no disk")).cast("long").alias("id"))
    with pytest.raises(Exception):
        store.write(lambda old: {"a": old.withColumn("v", F.lit("new")), "b": broken}, "a")
    assert [store.read(x)[0].collect() for x in ("a", "b")] == [a.collect(), b.collect()] and store.numbers() == [1]
    assert store.write(lambda old: {"a": old.withColumn("v", F.lit("new"))}, "a") == 2
    assert [x.first()[-1] for x in store.read("a", "b")] == ["new", 2]
    # one of two writers from the same state wins
    with pytest.raises(snapshots.Conflict):
        store.commit(1, {})
    won, lost = [], []

    def race(n):
        try:
            won.append(store.commit(2, store.latest()[1] | {"by": n}))
        except snapshots.Conflict:
            lost.append(n)

    threads = [threading.Thread(target=race, args=(n,)) for n in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert won == [3] and len(lost) == 3
    assert store.vacuum(1) > 0 and store.numbers() == [3] and store.read("a")[0].first()["v"] == "new"


ROWS = [
    (1, "Grey heron", "the heron waits at the weir. herons wait"),
    (2, "Weir", None),
    (3, None, "Éclair and eclairs"),
    (4, "heronry", "many herons, one heron-tree"),
    (5, "", ""),
    (6, "a" * 40, "a" * 39 + "b, and " + "a" * 40),
    (7, "common", "the the the the"),
    *[(i, f"filler {i}", "the plain row " + "word " * (i % 13)) for i in range(20, 60)],
]
QUERIES = ["heron", "the", "t", "her wei", "heron-tree", "grey-her the", "eclair", "É", "a" * 30, "a" * 40, "filler-2", "the (", " ", "absent", "the absent", "row-word-word"]


def test_index_answers_as_the_rows(spark, tmp_path, monkeypatch):
    """Every query, with small blocks and few first ones, so that some are skipped; then after batches of changes, and after merges."""
    monkeypatch.setattr(index, "BLOCK_BITS", 1)
    monkeypatch.setattr(index, "FIRST", 2)
    schema = "id long, title string, body string"
    state = {r[0]: r for r in ROWS}
    made = index.Index(spark, f"file://{tmp_path}/i", columns=tuple(WEIGHTS))
    assert made.search("x", WEIGHTS).count() == 0 and made.merge() == 0

    def compare(queries):
        rows = spark.createDataFrame(list(state.values()), schema)
        for i, q in enumerate(queries):
            limit = (3, 50)[i % 2]
            assert hits(made.search(q, WEIGHTS, limit)) == hits(fts.bm25(rows, "id", WEIGHTS, q, limit)), (q, limit)

    made.apply(spark.createDataFrame(ROWS, schema).repartition(3))
    compare(QUERIES)
    some = ["the", "her wei", "row-word-word"]
    batches = [
        ([(1, "Grey", "no bird"), (100, "heron", "new heron"), (None, "heron", "no key")], [2, 21, 999]),
        ([(21, "back", "the heron")], [100, 1]),
        ([], [7]),
        ([(100, "heron again", "the the")], []),
    ]
    for new, gone in batches:
        made.apply(spark.createDataFrame(new, schema) if new else None, spark.createDataFrame([(g,) for g in gone], "id long") if gone else None)
        state = {k: v for k, v in state.items() if k not in gone} | {r[0]: r for r in new if r[0] is not None}
        compare(some[:1])
    want = {r["prefix"]: r["n"] for r in made.counts().collect()}
    for most in (3, 1):
        made.merge(most)
        assert len(made.store.latest()[1]["segments"]) == most
        compare(some)
    assert made.store.latest()[1]["dead"] == [] and {r["prefix"]: r["n"] for r in made.counts().collect()} == want
    assert sorted(r["id"] for r in made.living().collect()) == sorted(state)


def test_index_reads_little(spark, tmp_path):
    """Few blocks of many are read where one stands out, and only the leads and terms of the query reach the plan."""
    rows = spark.range(0, 40_000, numPartitions=4).select("id", F.lit("row").alias("title"), F.concat(F.lit("the "), F.when(F.col("id") % 1000 == 7, F.repeat(F.lit("heron "), 40)).otherwise("heron and much more of other words in this long row here")).alias("body"))
    made = index.Index(spark, f"file://{tmp_path}/i", columns=tuple(WEIGHTS))
    made.apply(rows)
    found = made.search("heron", WEIGHTS, 5)
    assert hits(found) == hits(fts.bm25(rows, "id", WEIGHTS, "heron", 5))
    assert made.figures["blocks"] == 40
    rare = made.search("heron the", WEIGHTS, 5)
    assert hits(rare) == hits(fts.bm25(rows, "id", WEIGHTS, "heron the", 5))
    m = made.store.latest()[1]
    plan = made._table(m, "postings", index.POSTINGS).filter(index._begins("heron")).groupBy("block").count()._jdf.queryExecution().executedPlan().toString()
    assert f"(lead#" in plan and f"= {index.lead_of('heron')})" in plan and "StringStartsWith(term,heron)" in plan and "posts" not in plan.split("ReadSchema")[1]


def test_searches_by_index(spark, tmp_path):
    repos = spark.createDataFrame([(1, "olga/kiln", "pottery", "[]", None, 500, "2024-01-01"), (2, "iwan/tides", "tide charts", "[]", "kiln", 5, None)], "id long, full_name string, description string, topics string, readme string, stars long, starred_at string")
    chunks = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, vec array<float>")
    made = index.Index(spark, f"file://{tmp_path}/i", columns=tuple(search.REPO_WEIGHTS))
    made.apply(repos)
    for q in ("kiln", "tide", "nothing"):
        a, b = (search.search_repos(repos, chunks, q, [0.0, 1.0], None, index=x).collect() for x in (None, made))
        assert a == b
    # the vectors from a store, and the query's vector from an embedder
    store = vector_store.VectorStore(spark, f"file://{tmp_path}/v")
    store.put(chunks)
    embedder = lambda texts: [[0.0, 1.0] if "tide" in t else [1.0, 0.0] for t in texts]
    for q, vector in (("tide", [0.0, 1.0]), ("kiln", [1.0, 0.0])):
        assert search.search_repos(repos, store, q, None, 5, index=made, embedder=embedder).collect() == search.search_repos(repos, chunks, q, vector, 5).collect()
    many = spark.range(200).select("id", F.lit("x").alias("full_name"), F.lit(None).cast("string").alias("starred_at"))
    assert [search.search_repos(many, chunks, " ", None, n).count() for n in (None, 7, 1000)] == [30, 7, 100]


def posted(batches):
    return sorted((r["term"], r["origin"], r["block"], r["ids"][at // 2], r["ds"][at // 2], at % 2, pos) for b in batches for r in b.to_pylist() for at, pos in zip(r["at"], r["pos"], strict=True))


def test_postings_in_parts(monkeypatch):
    """Postings, dead rows and beginnings of one batch are those of its parts, however small these are."""
    rows = [(7, 0, " b a b ", " a "), (5, 0, " ", " "), (6, 0, " c ", " a a "), (9, 1, " a ", " ")]
    batch = pa.RecordBatch.from_pylist([{"id": i, "origin": 3, "block": b, "d": len(x.split()) + len(y.split()), "t0": x, "t1": y} for i, b, x, y in rows])
    want = sorted((t, 3, b, i, len(x.split()) + len(y.split()), c, p) for i, b, x, y in rows for c, z in enumerate((x, y)) for p, t in enumerate(z.split()))
    counts = {"a": 3, "b": 1, "c": 1}
    for most in (1 << 20, 4, 1):
        monkeypatch.setattr(index, "AT_ONCE", most)
        made = list(index._inverted(2)([batch]))
        assert posted(made) == want
        whole = pa.Table.from_batches(made)
        gone = pa.array([[7, 9] if b == 0 else None for b in whole["block"].to_pylist()], pa.list_(pa.int64()))
        assert posted(index._without(2)(whole.append_column("gone", gone).to_batches())) == [x for x in want if x[3] != 7]
        begun = {}
        for b in index._beginnings([pa.RecordBatch.from_pydict({"terms": [f"{x} {y}" for _, _, x, y in rows]})]):
            for r in b.to_pylist():
                begun[r["prefix"]] = begun.get(r["prefix"], 0) + r["n"]
        assert begun == counts
    most = {(r["term"], r["block"]): (r["most"], r["least"]) for r in list(made)[0].to_pylist()}
    assert most == {("a", 0): ([1, 1], 4), ("b", 0): ([2, 0], 4)}


def test_no_task_holds_a_lead(spark, tmp_path):
    """A term of all rows is written by several tasks, as the rows of a block are; a merge of small segments gives one file."""
    rows = spark.range(0, 8192, numPartitions=4).select("id", F.lit("the").alias("title"), F.lit("the the").alias("body"))
    made = index.Index(spark, f"file://{tmp_path}/i", columns=tuple(WEIGHTS))
    made.apply(rows.filter("id < 8000"))
    files = f"{tmp_path}/i/data/postings-*/lead={index.lead_of('the')}/*.parquet"
    assert len(glob.glob(files)) > 1
    made.apply(rows.filter("id >= 7000"))
    old = set(glob.glob(files))
    made.merge(1)
    assert len(set(glob.glob(files)) - old) == 1
    assert hits(made.search("the", WEIGHTS, 9)) == hits(fts.bm25(rows, "id", WEIGHTS, "the", 9))
    m = made.store.latest()[1]
    made.store.commit(made.store.latest()[0], {k: v for k, v in m.items() if k != "format"})
    with pytest.raises(ValueError):
        made.search("the", WEIGHTS)
