"""The engine's own operators on small fixtures, and every query with SQL against DuckDB on the smallest tables."""

import glob
import json
import os
import sqlite3
import time
import tracemalloc

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from sparkfind import plans
from sparkfind.functions import display, text
from sparkfind.functions.vectors import dot, normalize
from sparkfind.operators import collections, embed, fts, fusion, mirror, search, vectors
from sparkfind.sources import bookmarks, files, remote
from sparkfind.streaming.refresh import refresh
from pyspark.sql import functions as F


def ids(df, key="id"):
    return [r[key] for r in df.collect()]


def test_query_strings():
    assert text.query_terms('a "b" NOT') == ["a", "b", "NOT"]
    assert text.phrases("a_b c") == [["a", "b"], ["c"]]
    assert text.phrases("the (") is None and text.phrases("  ") is None


def test_markdown_hash_and_snippet():
    assert text.clean_markdown_text("## Weather log\n[![state](s.svg)](ci)\n~~~\nrun\n~~~\n<br/>rain in [the [far] north](u) `today`\n> [x] a < b ![](") == "Weather log\nrain in the [far] north today\n[x] a < b ![](\n"
    assert text.clean_markdown_text("[" * 50_000 + "x" + "](u)" * 50_000) == "x\n"
    assert [f"{text.fnv64(x):016x}" for x in (b"", b"a", b"abc")] == ["cbf29ce484222325", "af63dc4c8601ec8c", "e71fa2190541574b"]
    some = [bytes(range(i % 256)) * (i % 5) for i in range(300)]
    assert text.fnv64_all(some).tolist() == [text.fnv64(x) for x in some] and text.fnv64_all([]).tolist() == []
    long = "one more row. " * 300 + "a heron waits"
    assert "\x01heron\x02" in fts.snippet_text(long, [["heron"]])


def test_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.7, 0.7]), (4, [])], "id long, vec array<float>")
    assert ids(vectors.top_similar(rows, [1.0, 0.0], 3)) == [1, 3, 2]
    assert ids(vectors.top_similar(rows, [1.0, 0.0, 0.0], 3)) == []
    chunks = spark.createDataFrame([(10, [0.2, 0.0]), (10, [0.9, 0.0]), (11, [0.5, 0.0])], "id long, vec array<float>")
    assert ids(vectors.top_similar_grouped(chunks, [1.0, 0.0])) == [10, 11]
    unit = rows.select(dot(normalize(F.array(F.lit(3.0), F.lit(4.0))), F.array(F.lit(0.6), F.lit(0.8))).alias("x"), normalize(F.array(F.lit(0.0))).alias("z")).first()
    assert abs(unit["x"] - 1) < 1e-12 and unit["z"] == [0.0]


def test_fusion(spark):
    lists = [spark.createDataFrame([(1, 0, 0.0), (2, 1, 0.0)], "id long, place int, sim double"), spark.createDataFrame([(2, 0, 0.0), (3, 1, 0.0)], "id long, place int, sim double")]
    assert ids(fusion.fuse(lists).orderBy(F.desc("score"), "id")) == [2, 1, 3]


def test_repo_search(spark):
    repos = spark.createDataFrame([(1, "olga/kiln", "pottery glaze tables", "[]", None, 500, "2024-01-01"), (2, "iwan/tides", "harbour tide charts", "[]", None, 5, "2024-01-03"), (3, "u/v", "charts", "[]", "charts", 1, None)], "id long, full_name string, description string, topics string, readme string, stars long, starred_at string")
    assert ids(fts.bm25(repos, "id", search.REPO_WEIGHTS, "glaz")) == [1]
    assert ids(fts.bm25(repos, "id", search.REPO_WEIGHTS, "the (")) == []
    chunks = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, vec array<float>")
    assert ids(search.search_repos(repos, chunks, "pottery", [1.0, 0.0], 5))[0] == 1
    assert ids(search.search_repos(repos, chunks, "charts", [0.0, 1.0], 5, "stars"))[0] == 1
    assert ids(search.search_repos(repos, chunks, " ", None, 5)) == [2, 1, 3]


def test_letters_outside_latin1(spark):
    texts = ["Dvořák čeština", "Őrült Šaty", "Nguyễn Việt", "cafe\u0301 no\u0308el", "한국어 が Ω", "crème brûlée", "का हिन्दी", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    for query, want in (("čeština", 0), ("dvorak", 0), ("Őrült", 1), ("saty", 1), ("Việt", 2), ("nguye\u0302\u0303n", 2), ("café", 3), ("noel", 3), ("한국", 4), ("creme", 5)):
        assert ids(fts.bm25(rows, "id", {"t": 1}, query)) == [want], query
    db = duckdb.connect()
    want = [db.execute(f"select {plans.TOKENS.replace('text', '?')}", [t]).fetchone()[0] for t in texts]
    assert [r["x"] for r in rows.select("id", text.tokens(F.col("t")).alias("x")).orderBy("id").collect()] == want
    assert sorted((r["id"], r["term"]) for r in fts.postings(rows, "id", ["t"]).collect()) == sorted((i, x) for i, w in enumerate(want) for x in w)


def test_chunks(spark):
    line = "x" * 40 + "\n"
    rows = spark.createDataFrame([(1, ""), (2, "short"), (3, line * 200 + "MARK"), (4, None)], "id long, t string")
    got = {r["id"]: r["c"] for r in rows.select("id", text.chunks(F.col("t")).alias("c")).collect()}
    assert got[1] == [] and [tuple(x) for x in got[2]] == [(0, 0, 5)] and len(got[3]) > 1 and got[3][-1]["stop"] == 200 * 41 + 4
    assert all(x["stop"] - x["start"] <= 1600 for x in got[3])


def test_mirror(spark):
    known = spark.createDataFrame([("a", 1, 1), ("b", 1, 1)], "path string, mtime long, size long")
    now = spark.createDataFrame([("a", 1, 1), ("b", 2, 1), ("c", 1, 1)], "path string, mtime long, size long")
    assert sorted(ids(mirror.changed_files(now, known), "path")) == ["b", "c"]
    states = spark.createDataFrame([(1, None), (2, "t1"), (3, "t1"), (4, ""), (5, "t1")], "id long, readme_pushed_at string")
    starred = spark.createDataFrame([(1, "t1"), (2, "t1"), (3, "t2"), (4, None), (5, "t2"), (6, "t9")], "id long, pushed_at string")
    assert sorted(ids(mirror.stale_readmes(states, starred))) == [1, 3, 5]
    folders = spark.createDataFrame([(1, "/a/b")], "id long, path string")
    assert ids(mirror.add_folder(folders, "/a/c"), "path") == ["/a/b", "/a/c"]
    for bad in ("/a", "/a/b/c"):
        with pytest.raises(ValueError):
            mirror.add_folder(folders, bad)


def test_sources(spark, tmp_path):
    (tmp_path / "attic").mkdir()
    given = {"plan.md": b"# spring", "sums [v1] *.py": b"x = 1", "map.png": b"\0\1", "choir.mp4": b"\0", ".gitignore": b"attic/", "attic/key.txt": b"x", "odd.txt": b"a\0b", "big.txt": b"y" * (2 << 20), "torn.docx": b"PK\3\4 torn"}
    for name, data in given.items():
        (tmp_path / name).write_bytes(data)
    folders = spark.createDataFrame([(1, str(tmp_path))], "id long, path string")
    none = spark.createDataFrame([], "folder_id long, path string, name string, ext string, size long, mtime long, content string, thumb string")
    first, report = files.index_folders(folders, none, max_file_mb=1)
    first = spark.createDataFrame(first.collect(), none.schema)
    assert {r["name"]: r["content"] for r in first.collect()} == {"plan.md": "# spring", "sums [v1] *.py": "x = 1", "map.png": None, "choir.mp4": None, "odd.txt": None, "big.txt": None, "torn.docx": None}
    assert tuple(report.first()) == (7, 7, 0)
    (tmp_path / "plan.md").unlink()
    marked = first.withColumn("thumb", F.lit("t"))
    (tmp_path / "odd.txt").write_text("now text")
    second, report = files.index_folders(folders, marked, max_file_mb=1)
    assert tuple(report.first()) == (6, 1, 1)
    assert {(r["name"], r["content"], r["thumb"]) for r in second.collect() if r["name"] in ("odd.txt", "map.png")} == {("odd.txt", "now text", "t"), ("map.png", None, "t")}
    tree = {"roots": {"bar": {"type": "folder", "name": "Top", "children": [{"type": "url", "name": "A", "url": "http://a", "date_added": "13300000000000000"}, {"type": "folder", "name": "Sub", "children": [{"type": "url", "url": "http://b"}, {"type": "url", "url": ""}]}]}}}
    assert bookmarks.parse_chromium("x", json.dumps(tree)) == [("x", "http://a", "A", "Top", 1655526400), ("x", "http://b", "http://b", "Top/Sub", None)]
    path = str(tmp_path / "places.sqlite")
    with sqlite3.connect(path) as db:
        db.executescript("create table moz_bookmarks(id, type, fk, parent, title, dateAdded); create table moz_places(id, url); insert into moz_bookmarks values (1,2,null,0,'',0),(2,2,null,1,'Menu',0),(3,1,9,2,'',5000000),(4,1,8,2,'x',1); insert into moz_places values (9,'HTTP://z'),(8,'ftp://q')")
    assert [tuple(r) for r in bookmarks.firefox_file(spark, path).collect()] == [("firefox", "HTTP://z", "HTTP://z", "Menu", 5)]
    assert remote.file_url("a/b", "c.bin", "https://h/") == "https://h/a/b/resolve/main/c.bin"


def test_embedding_is_incremental(spark):
    docs = spark.createDataFrame([(1, 0, "h1", "a b"), (2, 0, "h2", "c")], "id long, chunk_idx int, hash string, doc string")
    none = spark.createDataFrame([], "id long, chunk_idx int, hash string, model string, vec array<float>")
    first = embed.embed_pending(docs, none, "m").cache()
    changed = docs.withColumn("hash", F.expr("if(id = 2, 'h3', hash)"))
    assert sorted(r["hash"] for r in embed.embed_pending(changed, first, "m").collect()) == ["h1", "h3"]


def test_downloads_go_on(tmp_path):
    data, calls = bytes(range(256)) * 40, []

    def get(url, head):
        have = int(head["Range"][6:-1]) if head else 0
        calls.append(have)

        def body():
            yield data[have : have + 4000]
            if have + 4000 < len(data):
                raise OSError("the line broke")

        return (206 if have else 200), {"content-range": f"bytes {have}-/{len(data)}", "content-length": str(len(data) - have)}, body()

    path = str(tmp_path / "f")
    assert open(remote.fetch_file("u", path, get, pause=0), "rb").read() == data and calls == [0, 4000, 8000]
    (tmp_path / "g.part").write_bytes(b"x" * 9)
    seen = []

    def other(url, head):
        seen.append(dict(head))
        return (416, {}, iter(())) if head else (200, {"content-length": "2"}, iter([b"o", b"k"]))

    assert open(remote.fetch_file("u", str(tmp_path / "g"), other, pause=0), "rb").read() == b"ok" and len(seen) == 2
    assert remote.viewer_login("t", lambda u, h: (200, {}, b'{"login": "me"}')) == "me"
    with pytest.raises(PermissionError):
        remote.viewer_login("t", lambda u, h: (401, {}, b""))


def test_refresh_keeps_the_table(spark, tmp_path):
    source, table, schema = str(tmp_path / "in"), str(tmp_path / "table"), "id long, v string, n long"

    def add(*rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)

    def run():
        refresh(spark, source, schema, table, ["id"], "n", str(tmp_path / "state")).awaitTermination()
        return {r["id"]: r["v"] for r in mirror.current(spark, table).collect()}

    assert mirror.current(spark, table) is None
    add((1, "a", 1), (1, "b", 2), (2, "c", 1))
    assert run() == {1: "b", 2: "c"}
    add((2, "d", 5), (3, "e", 1))
    assert run() == {1: "b", 2: "d", 3: "e"} and run() == {1: "b", 2: "d", 3: "e"}
    add((4, "f", 1))
    rows = glob.glob(f"{table}/rows-2-*/*.parquet") + glob.glob(f"{table}/rows-2-*/.*.crc")
    held = {p: open(p, "rb").read() for p in rows}
    for p in rows:  # a table that can't be read is an error, not a table that isn't there
        open(p, "wb").write(b"")
    with pytest.raises(Exception):
        run()
    assert mirror.versions(spark, table)[-1] == 2
    for p, data in held.items():
        open(p, "wb").write(data)
    assert run() == {1: "b", 2: "d", 3: "e", 4: "f"} and len(mirror.versions(spark, table)) == 2


def test_collections(spark):
    meta = spark.createDataFrame([("a", "1")], collections.META)
    assert collections.meta_get(meta, "a") == "1" and collections.meta_get(meta, "b") is None
    vectors = spark.createDataFrame([(1, "h")], "id long, hash string")
    meta, kept = collections.ensure_model(meta, vectors, "embed_model", "m1")
    assert kept.count() == 0 and collections.meta_get(meta, "embed_model") == "m1" and collections.ensure_model(meta, vectors, "embed_model", "m1")[1].count() == 1
    rows = spark.createDataFrame([(1, "n", '["x"]'), (2, "n", "broken"), (3, "n", None)], "id long, full_name string, topics string")
    assert [r["topics"] for r in collections.decode_repos(rows).orderBy("id").collect()] == [["x"], [], []]
    hit = collections.decode_files(spark.createDataFrame([(1, bytearray(b"ab"))], "id long, thumb binary")).first()
    assert (hit["thumb"], hit["score"]) == ("YWI=", 0.0)
    ranked = spark.createDataFrame([(2, 0, 0.5), (9, 1, 0.4), (1, 2, None)], "id long, place int, score double")
    assert [(r["id"], r["score"]) for r in collections.files_by_ids(rows, ranked).collect()] == [(2, 0.5), (1, 0.0)]
    assert [collections.page_size(x) for x in (None, 7, 1000)] == [30, 7, 100]
    assert len(collections.embed_query("a b")) == 64 and collections.now_unix().isdigit()
    repos = spark.createDataFrame([(1, "r", None, ["t"], "l", "text " * 900)], "id long, full_name string, description string, topics array<string>, language string, readme string")
    docs = collections.repo_chunk_docs(repos).orderBy("chunk_idx").collect()
    assert len(docs) == 4 and all(d["doc"].startswith("r\nTopics: t\nLanguage: l\ntext") for d in docs) and len({d["hash"] for d in docs}) == 1
    none = spark.createDataFrame([], "id long, chunk_idx int, hash string, model string, vec array<float>")
    assert collections.embed_pending_repos(repos, none, "m").count() == 4
    marks = spark.createDataFrame([(1, "t", "u", None)], "id long, title string, url string, folder string")
    assert collections.embed_pending_bookmarks(marks, none, "m").count() == 1


def test_display(spark):
    row = spark.range(1).select(display.stars(F.lit(1234)).alias("a"), display.stars(F.lit(12345)).alias("b"), display.size(F.lit(2048)).alias("c"), display.age(F.lit(86400.0 * 40)).alias("d"), display.parent_dir(F.lit("/a/b.c")).alias("e"), display.address(F.lit("example.org/x")).alias("f"), display.webkit_to_unix(F.lit(0)).alias("g")).first()
    assert tuple(row) == ("1.2k", "12k", "2KB", "1mo", "/a", "https://example.org/x", None)


def tables(sf):
    db = duckdb.connect()
    for name in os.listdir(sf):
        db.sql(f"create view {name.split('.')[0]} as select * from '{sf}/{name}'")
    return db


def test_phrases_of_long_texts(spark):
    """Phrases that overlap themselves, and a text of 200,000 tokens, which no count may go through once for each of them."""
    texts = ["a a a", "a b a b a b", "a aa a a", "b-a.a", "a", "", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").withColumn("t", text.spaced(F.col("t")))
    counts = rows.select("i", *[fts.phrase_count(F.col("t"), p).alias("_".join(p)) for p in (["a", "a"], ["a", "b", "a"], ["b", "a"], ["a"])]).orderBy("i")
    assert [tuple(r)[1:] for r in counts.collect()] == [(2, 0, 0, 3), (0, 2, 2, 3), (2, 0, 0, 4), (1, 0, 1, 2), (0, 0, 0, 1), (0, 0, 0, 0), (0, 0, 0, 0)]
    long = spark.range(1).select(text.spaced(F.repeat(F.lit("doc-1 src "), 70_000)).alias("t"))
    began = time.monotonic()
    assert tuple(long.select(fts.phrase_count(F.col("t"), ["doc", "1"]), fts.phrase_count(F.col("t"), ["1", "src", "doc", "1"])).first()) == (70_000, 69_999)
    assert time.monotonic() - began < 60


def test_batches_are_not_held_as_strings():
    """Of an Arrow batch of 30 MB little is a Python object at a time, by cleaning and by cutting."""
    texts = pa.array([f"# line {i}\n" + "some [linked](x) prose\n" * 900 for i in range(1500)] + [None, ""])
    for f in (text.clean_markdown.func, text.chunks.func):
        tracemalloc.start()
        made = f(texts)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert len(made) == len(texts) and peak < 15_000_000
    assert text.clean_markdown.func(pa.array(["# a", None, ""])).to_pylist() == ["a\n", None, ""] and len(text.clean_markdown.func(texts.slice(0, 0))) == 0


def test_pages_of_a_large_table(tmp_path):
    """The pages of a table with more rows than a listing has, in no order: only rows of these pages are held."""
    keys = [(i * 7919) % 60_000 for i in range(60_000)]
    pq.write_table(pa.table({"p_partkey": keys, "p_name": [f"n{k}" for k in keys], "p_brand": ["b"] * len(keys), "p_size": keys}), tmp_path / "part.parquet")
    found = plans.disk._parts(str(tmp_path))
    assert [r[0] for r in found] == list(range(20_000)) and found[-1] == (19_999, "n19999", "b", 19_999)


def test_webkit_times_are_whole_seconds(spark):
    """A microsecond before a full second, where doubles have gaps of two."""
    micros = [13_300_000_000_999_999, 13_300_000_001_000_000, 1, 0, -1, None]
    rows = spark.createDataFrame([(i, m) for i, m in enumerate(micros)], "i int, m long").select("i", display.webkit_to_unix(F.col("m")).alias("t"))
    assert [r["t"] for r in rows.orderBy("i").collect()] == [1_655_526_400, 1_655_526_401, -11_644_473_600, None, None, None]


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_against_sql(spark, sf, name):
    want = tables(sf).sql(plans.SQL[name])
    got = plans.QUERIES[name](spark, sf)
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    key = lambda rows: sorted(str([round(x, 5) + 0.0 if isinstance(x, float) else x for x in r]) for r in rows)
    assert key(tuple(r) for r in got.select(*cols).collect()) == key(want.select(*cols).fetchall())
