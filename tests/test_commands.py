"""Walks, commands over several tables, requests and their outcomes, the refresh."""

import json
import os
import threading

import pytest
from pyspark.sql import functions as F

from sparkfind.operators import buckets, collections, library, mirror, snapshots, vector_store, vectors
from sparkfind.sources import bookmarks, files, remote, walk
from sparkfind.streaming.refresh import refresh

#: pattern, path, is a directory, ignored (None: no rule matches)
RULES = [
    ("*.log", "a.log", False, True), ("*.log", "x/y/a.log", False, True), ("*.log", "a.logs", False, None), ("/top.txt", "top.txt", False, True), ("/top.txt", "x/top.txt", False, None),
    ("build/", "build", True, True), ("build/", "build", False, None), ("build/", "x/build", True, True), ("doc/*.md", "doc/a.md", False, True), ("doc/*.md", "doc/x/a.md", False, None),
    ("doc/*.md", "x/doc/a.md", False, None), ("**/tmp", "tmp", True, True), ("**/tmp", "a/b/tmp", False, True), ("a/**", "a/b", False, True), ("a/**", "a", True, None),
    ("a/**/z", "a/z", False, True), ("a/**/z", "a/b/c/z", False, True), ("a/**/z", "b/a/z", False, None), ("?.c", "x.c", False, True), ("?.c", "xy.c", False, None),
    ("[a-c]1", "b1", False, True), ("[a-c]1", "d1", False, None), ("[!a-c]1", "d1", False, True), ("[^a-c]1", "a1", False, None), ("[]x]", "]", False, True),
    (r"\#note", "#note", False, True), ("#note", "#note", False, None), (r"\!bang", "!bang", False, True), ("!kept", "kept", False, False), ("end   ", "end", False, True),
    ("end\\ ", "end ", False, True), ("foo**bar", "fooxbar", False, True), ("foo**bar", "foo/bar", False, None), ("a[/]b", "a/b", False, None), ("[open", "[open", False, None),
    ("", "x", False, None), ("*", "x/y", False, True), ("a.b", "axb", False, None), (r"a\*", "a*", False, True), (r"a\*", "ab", False, None),
]


@pytest.mark.parametrize("line,path,is_dir,want", RULES)
def test_ignore_rules(line, path, is_dir, want):
    assert walk.decided([line], path, is_dir) is want


def test_walk(spark, tmp_path):
    given = {
        "top/.gitignore": "secret/\n*.tmp\n!keep.tmp\n/only-here\n.*\n!.shown\n", "top/secret/key.txt": "", "top/a.tmp": "", "top/keep.tmp": "", "top/only-here": "", "top/deep/only-here": "", "top/deep/er/x.md": "",
        "top/deep/.ignore": "!b.tmp\nlocal.md\n", "top/deep/b.tmp": "", "top/deep/local.md": "", "top/deep/er/local.md": "", "top/.hidden/x": "", "top/.shown": "", "top/deep/.gitignore": "b.tmp\nx.md\n!x.md\n",
        "other/.git/info/exclude": "never\n", "other/never": "", "other/odd [1] *.txt": "", "other/K.MD": "abc",
    }
    for name, text in given.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    os.symlink(tmp_path / "top", tmp_path / "other/link")
    with open(os.fsencode(tmp_path) + b"/other/bad\xff.txt", "wb"):
        pass
    folders = spark.createDataFrame([(1, f"{tmp_path}/top/"), (2, f"{tmp_path}/other"), (3, f"{tmp_path}/gone")], "id long, path string")
    want = {"top/keep.tmp", "top/deep/only-here", "top/deep/er/x.md", "top/deep/b.tmp", "top/.shown", "other/odd [1] *.txt", "other/K.MD", "other/bad�.txt"}
    for at_once in (1, 3, 1000):  # many rounds, some, one
        got = walk.scan(folders, at_once).collect()
        assert {r["path"][len(str(tmp_path)) + 1 :] for r in got} == want and len(got) == len(want)
    one = next(r for r in got if r["name"] == "K.MD")
    assert (one["folder_id"], one["ext"], one["size"]) == (2, "md", 3) and one["mtime"] > 1_000_000_000


def test_texts_without_a_limit(tmp_path):
    (tmp_path / "long.txt").write_text("x" * (3 << 20))
    assert len(files.read_text(str(tmp_path / "long.txt"), "text", 0)) == 3 << 20
    assert len(files.read_text(str(tmp_path / "long.txt"), "text", 4 << 20)) == 2 << 20
    import io
    import zipfile

    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", "<w:p>a</w:p>" * 500_000)
    assert len(held.getvalue()) < 100_000 and files.office_text(held.getvalue(), 100_000) is None
    assert len(files.office_text(held.getvalue(), 0)) == 2 * 500_000 - 1


def test_library(spark, tmp_path):
    home = tmp_path / "home"
    (home / "a").mkdir(parents=True)
    (home / "b").mkdir()
    (home / "a/one.md").write_text("first")
    (home / "a/two.md").write_text("z" * (1 << 20) + "tail")
    (home / "b/three.md").write_text("third")
    made = library.Library(spark, f"file://{tmp_path}/library")
    made.add_folder(str(home / "a"))
    made.add_folder(str(home / "b"))
    with pytest.raises(ValueError):
        made.add_folder(str(home))

    def held():
        return {r["name"]: (r["id"], r["folder_id"], None if r["content"] is None else len(r["content"])) for r in made.tables("files")[0].collect()}

    assert made.index_local() == {"scanned": 3, "indexed": 3, "removed": 0}
    assert held() == {"one.md": (1, 1, 5), "two.md": (3, 1, (1 << 20) + 4), "three.md": (2, 2, 5)} or {n: v[1:] for n, v in held().items()} == {"one.md": (1, 5), "two.md": (1, (1 << 20) + 4), "three.md": (2, 5)}
    first = held()
    made.embed_files("m")
    vectors_of = lambda: {r["id"] for r in made.tables("file_chunks")[0].collect()}
    assert vectors_of() == {v[0] for v in first.values()}
    # the stored limit takes effect, and a file that it leaves out has no text
    assert made.max_file_mb() == 4 and made.set_max_file_mb(1)["indexed"] == 3 and made.max_file_mb() == 1
    second = held()
    assert second["two.md"][2] is None and second["one.md"][2] == 5 and {v[0] for v in second.values()}.isdisjoint(v[0] for v in first.values()) and vectors_of() == set()
    (home / "b/three.md").write_text("changed")
    assert made.index_local() == {"scanned": 3, "indexed": 1, "removed": 0}
    assert held()["three.md"] == (second["three.md"][0], 2, 7)
    made.embed_files("m")
    assert made.rebuild_folder(1) == {"scanned": 3, "indexed": 2, "removed": 0}
    third = held()
    assert third["three.md"] == (second["three.md"][0], 2, 7) and third["one.md"][0] > second["one.md"][0] and vectors_of() == {third["three.md"][0]}
    # a crash between the writes of a removal leaves all of the old state
    save, calls = made.store.new_folder, []

    def broken(name):
        calls.append(name)
        if len(calls) == 3:
            raise OSError("the disk is full")
        return save(name)

    made.store.new_folder = broken
    with pytest.raises(OSError):
        made.remove_folder(2)
    made.store.new_folder = save
    assert held() == third and made.tables("folders")[0].count() == 2 and vectors_of() == {third["three.md"][0]}
    made.remove_folder(2)
    assert set(held()) == {"one.md", "two.md"} and made.tables("folders")[0].count() == 1 and vectors_of() == set()
    with pytest.raises(ValueError):
        made.set_hf_endpoint("http://plain")
    made.set_hf_endpoint(" https://mirror.example/ ")
    assert made.set_token(" t ", lambda t: "me") == "me"
    with pytest.raises(PermissionError):
        made.set_token("bad", lambda t: remote.viewer_login(t, lambda u, h: (401, {}, b"")))
    starred = spark.createDataFrame([(1, "o/r", None, None, ["t"], 5, "u", None, False, False, "2024", "p1")], remote.REPO_SCHEMA)
    fetch = lambda targets, token: targets.select("id", F.lit("fresh").alias("state"), F.lit("e").alias("etag"), F.lit(f"by {token}").alias("readme"))
    assert made.sync_stars(lambda t: starred, fetch) == {"total": 1, "removed": 0, "readmes_fetched": 1, "readme_errors": 0}
    assert made.sync_stars(lambda t: starred, fetch)["readmes_fetched"] == 0 and made.rebuild_stars(lambda t: starred, fetch)["readmes_fetched"] == 1
    row = made.status().first()
    assert (row["repo_count"], row["file_count"], row["folder_count"], row["max_file_mb"], row["hf_endpoint"], row["username"], row["has_token"]) == (1, 2, 1, 1, "https://mirror.example", "me", True)
    assert made.tables("repos")[0].first()["readme"] == "by t" and int(row["last_sync"]) > 0


# ------------------------------------------------------------------ requests
def star(i):
    return {"starred_at": f"t{i}", "repo": {"id": i, "full_name": f"o/r{i}", "html_url": "u", "homepage": "" if i % 2 else "h", "topics": ["a"], "stargazers_count": i}}


def three_pages(url, head):
    """205 repositories, no link header; every request is written down, as tasks run elsewhere."""
    page = int(url.rsplit("page=", 1)[1])
    with open(os.environ.get("STARRED_LOG", os.devnull), "a") as f:
        f.write(f"{page}\n")
    items = [star(i) for i in range((page - 1) * 100, min(205, page * 100))]
    return 200, {}, json.dumps(items).encode()


def linked(url, head):
    page = int(url.rsplit("page=", 1)[1])
    return 200, {"link": '<https://x/starred?per_page=100&page=2>; rel="next", <https://x/starred?per_page=100&page=4>; rel="last"'}, json.dumps([star(i) for i in range(page * 100, page * 100 + (100 if page < 4 else 7))]).encode()


def used_up(url, head):
    return 403, {"x-ratelimit-remaining": "0", "x-ratelimit-reset": "99"}, b"{}"


def test_starred_source(spark):
    here = "tests.test_commands" if "tests.test_commands" in __import__("sys").modules else __name__
    spark.sparkContext.addPyFile(__file__)
    here = os.path.splitext(os.path.basename(__file__))[0]
    rows = remote.list_starred(spark, "t", transport=f"{here}:three_pages")
    assert rows.rdd.getNumPartitions() == 3
    got = rows.collect()
    assert sorted(r["id"] for r in got) == list(range(205)) and got[0].asDict()["topics"] == ["a"] and {r["homepage"] for r in got} == {None, "h"}
    assert remote.list_starred(spark, "t", transport=f"{here}:linked").count() == 307
    assert remote.list_starred(spark, "t", transport=f"{here}:linked", pages="2").count() == 200
    with pytest.raises(Exception, match="used up until 99"):
        remote.list_starred(spark, "t", transport=f"{here}:used_up").count()
    for n in (0, 1, 99, 100, 101, 200, 1700, 30_000):  # pages are found with few requests, a short page is the last
        asked = []

        def get(url, head):
            page = int(url.rsplit("page=", 1)[1])
            asked.append(page)
            return 200, {}, json.dumps([star(0)] * max(0, min(100, n - (page - 1) * 100))).encode()

        last = remote.last_page(get, "t", "https://x")
        assert last in (max(1, min(200, -(-n // 100))), min(200, n // 100 + 1)) and len(asked) <= 17


def test_readmes_that_fail(spark):
    answers = {"r1": (200, {"etag": "e1"}, b"text"), "r2": (500, {}, b""), "r4": (304, {}, b""), "r5": (404, {}, b""), "r6": (200, {"etag": "e6"}, "é".encode() * 100_000)}

    def get(url, head):
        name = url.split("/")[-2]
        if name == "r3":
            raise TimeoutError("no answer")
        return answers[name]

    targets = spark.createDataFrame([(i, f"o/r{i}", None) for i in range(1, 7)], "id long, full_name string, etag string")
    got = {r["id"]: r for r in remote.fetch_readmes(targets, "t", get).collect()}
    assert {i: r["state"] for i, r in got.items()} == {1: "fresh", 2: "error", 3: "error", 4: "not_modified", 5: "missing", 6: "fresh"}
    assert got[2]["detail"] == "HTTP status 500" and "TimeoutError" in got[3]["detail"] and len(got[6]["readme"]) == 64 << 10
    # the whole sync: two errors leave their rows as they were, the rest is stored, and no request is sent twice
    columns = "id long, full_name string, description string, topics string, language string, stars long, pushed_at string"
    old = spark.createDataFrame([(i, f"o/r{i}", None, "[]", None, 1, "p0", f"old {i}", "old", "p0") for i in range(1, 7)], columns + ", readme string, readme_etag string, readme_pushed_at string")
    now = spark.createDataFrame([(i, f"o/r{i}", None, "[]", None, 1, "p1") for i in range(1, 7)], columns)
    sent = spark.sparkContext.accumulator(0)

    def counted(url, head):
        sent.add(1)
        return get(url, head)

    repos, report = collections.sync(old, now, lambda t: remote.fetch_readmes(t, "t", counted))
    kept = {r["id"]: (r["readme"], r["readme_pushed_at"]) for r in repos.collect()}
    assert tuple(report.first()) == (6, 0, 2, 2)
    assert kept[1] == ("text", "p1") and kept[2] == ("old 2", "p0") and kept[3] == ("old 3", "p0") and kept[4] == ("old 4", "p1") and kept[5] == (None, "p1")
    assert sent.value == 6

    def refused(url, head):
        return (429, {"x-ratelimit-remaining": "0", "x-ratelimit-reset": "7"}, b"") if url.split("/")[-2] == "r2" else (200, {}, b"ok")

    one = remote.fetch_readmes(targets.coalesce(1), "t", refused).collect()
    assert {r["state"] for r in one if r["id"] == 2} == {"limited"} and all(r["detail"] == "7" for r in one if r["state"] == "limited")
    many = spark.range(100).select("id", F.lit("o/r1").alias("full_name"), F.lit(None).cast("string").alias("etag"))
    states = [r["state"] for r in remote.fetch_readmes(many, "t", get, budget=20).collect()]
    assert len(states) == 100 and 0 < states.count("fresh") <= 20 and set(states) == {"fresh", "limited"}
    assert {r["state"] for r in remote.fetch_readmes(many, "t", get, budget=0).collect()} == {"limited"}


# ------------------------------------------------------------------ refresh
def test_late_rows_lose(spark, tmp_path):
    source, table, schema = str(tmp_path / "in"), str(tmp_path / "table"), "id long, v string, n long, w long"

    def run(*rows, checkpoint="state"):
        if rows:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        refresh(spark, source, schema, table, ["id"], "n", str(tmp_path / checkpoint)).awaitTermination()
        return {r["id"]: (r["v"], r["w"]) for r in mirror.current(spark, table).collect()}

    big = (1 << 62) + 1
    assert run((1, "new", 9, big), (1, "old", 8, None), (2, "x", None, None)) == {1: ("new", big), 2: ("x", None)}
    before = mirror.versions(spark, table)
    assert run((1, "late", 1, 5)) == {1: ("new", big), 2: ("x", None)} and mirror.versions(spark, table) == before  # it does not even reach the table
    assert run((2, "dated", 0, 7)) == {1: ("new", big), 2: ("dated", 7)}
    # rows of one order: the same one wins whatever comes first, and as a whole
    tie = run((3, "a", 4, 1), (3, "b", 4, None))[3]
    assert tie in {("a", 1), ("b", None)}
    assert run((4, "b", 4, None))[4] == ("b", None) and run((3, "a", 4, 1))[3] == tie
    # another checkpoint knows no state: all rows come again, and the table stays
    assert run(checkpoint="lost") == run() and run((1, "late again", 2, None), checkpoint="lost")[1] == ("new", big)


# ------------------------------------------------------------------ stores
def test_one_row_rewrites_one_bucket(spark, tmp_path):
    table = buckets.BucketTable(spark, f"file://{tmp_path}/t", ["id"], keep=("kept",), buckets=16)
    assert table.rows() is None
    table.apply(spark.range(1000).select("id", F.lit("old").alias("v"), F.lit(1).alias("kept")))
    before = table.files()
    assert len(before) == 16
    table.apply(spark.createDataFrame([(7, "new", 2)], "id long, v string, kept int"))
    after = table.files()
    assert [b for b in after if after[b] != before[b]] == table.rewritten and len(table.rewritten) == 1
    assert table.rows().filter("id = 7").first().asDict() == {"id": 7, "v": "new", "kept": 1} and table.rows().count() == 1000
    table.apply(spark.createDataFrame([(None, "no key", 3), (9, "both", 3)], "id long, v string, kept int"), spark.createDataFrame([(8,), (9,), (5000,)], "id long"))
    assert len(table.rewritten) <= 4 and {r["id"]: r["kept"] for r in table.rows().filter("id in (8, 9) or id is null").collect()} == {9: 1, None: 3}
    assert table.rows().filter("id is null").count() == 1 and table.rows().count() == 1000


def test_vector_store(spark, tmp_path, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    # clusters far from each other, so that bounds leave some out
    spread = rows.select((F.col("id") + 10_000).alias("id"), F.transform("vec", lambda x: (x * 0.05 + F.when(F.col("id") % 2 == 0, 1.0).otherwise(-1.0)).cast("float")).alias("vec"))
    odd = spark.createDataFrame([(1_000_001, [float("nan")] * 64), (1_000_002, [float("inf")] + [0.0] * 63), (1_000_003, []), (1_000_004, None), (1_000_005, [1.0, 2.0]), (1_000_006, [None] + [1.0] * 63)], "id long, vec array<float>")
    all_ = rows.unionByName(spread).unionByName(odd)
    store = vector_store.VectorStore(spark, f"file://{tmp_path}/v")
    assert store.top([1.0] * 64).count() == 0
    store.put(all_)
    q = [1.0] * 64

    def same(current, vector, n=20):
        for grouped in (False, True):
            got = [tuple(r) for r in store.top(vector, n, grouped).collect()]
            f = vectors.top_similar_grouped if grouped else vectors.top_similar
            assert got == [tuple(r) for r in f(current, vector, n).collect()], grouped

    same(all_, q)
    assert store.figures["rows_read"] < store.figures["rows"] / 2
    same(all_, [float(x) for x in rows.first()["vec"]])
    same(all_, [0.5, 1.0])
    assert store.top([1.0, 2.0, 3.0]).count() == 0
    # batches: ids' vectors are replaced as a whole or go
    two = spark.createDataFrame([(10_000, [9.0] * 64), (10_000, [0.5] * 64), (77_777, [-3.0] * 64)], "id long, vec array<float>")
    store.put(two, spark.createDataFrame([(10_002,), (10_004,)], "id long"))
    current = all_.filter("id not in (10000, 10002, 10004)").unionByName(two)
    same(current, q)
    store.merge()
    same(current, q)
    assert store.rows().count() == current.count() and len(store.store.latest()[1]["batches"]) == 1


def test_bookmark_trees(spark, tmp_path):
    deep = {"type": "url", "name": "leaf", "url": "http://leaf"}
    for i in range(300):
        deep = {"type": "folder", "name": f"d{i}" if i % 50 == 0 else "", "children": [deep]}
    good = {"roots": {"bar": deep, "sync_transaction_version": "1", "other": {"type": "folder", "name": "O", "children": [{"type": "url", "name": 5, "url": "u5", "date_added": 13300000000000000}, {"type": "separator"}, None]}}}
    for name, text in (("a", json.dumps(good)), ("b", "{broken"), ("c", "[]")):
        (tmp_path / name).write_text(text)
    got = sorted(tuple(r) for r in bookmarks.chromium(spark, [("x", str(tmp_path / n)) for n in "abcd"]).collect())
    assert got == [("x", "http://leaf", "leaf", "d250/d200/d150/d100/d50/d0", None), ("x", "u5", "u5", "O", None)]
    home = tmp_path / "home"
    for p in (".config/chromium/Default/Bookmarks", ".config/vendor/fork/User Data/Profile 2/Bookmarks", ".mozilla/firefox/abc/places.sqlite"):
        (home / p).parent.mkdir(parents=True)
        (home / p).write_text("{}")
    found = bookmarks.discover(str(home))
    assert [(b, f) for b, _, f in found] == [("chromium", False), ("vendor", False), ("firefox", True)]
