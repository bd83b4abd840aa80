"""The training-data operators against brute force, on hard little tables and on the smallest driver tables."""

import base64
import hashlib
import os
import zlib

import duckdb
import numpy as np
import pytest
import public_tokenizers as P
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from sparkfind import llm
from sparkfind.llm import bpe, exactdedup, huffman, lines, neardup, packing, substrings, tokens, toolcalls, topk, toxicity
from sparkfind.llm.common import Workspace, keyed
from sparkfind.llm.components import connected_components, in_memory

WORDS = [f"w{i}é" for i in range(60)]
LONG = " ".join(WORDS)
ROWS = [
    (1, None, "en"), (2, "", "en"), (3, "  \n\t ", "en"), (4, LONG, "en"), (5, LONG + " end.", "en"), (6, "x " + LONG, None), (7, "A-b  c\u00a0d  I'll 12,3\n\n x ", "en"),
    (8, "same line that is long enough\nother line of this text\nshort\n", "en"), (9, "new\nsame line that is long enough\nother line of this text\nshort", "en"), (10, "short\nTHE END", "en"),
    (11, "word " * 3000, "en"), (12, "日本語のテキスト \U0001f600 <|endoftext|> ﬁ É", "ja"), (13, "hello", "en"), (14, "hello", "en"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(a, b, c, "extra", 5) for a, b, c in ROWS], "doc_id long, text string, lang string, rid string, key long")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def rows_of(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_sql_queries(spark, sf):
    db = duckdb.connect()
    for name in os.listdir(sf):
        db.sql(f"create view {name.split('.')[0]} as select * from '{sf}/{name}'")
    for name, sql in llm.SQL.items():
        want = db.sql(sql)
        got = llm.QUERIES[name](spark, sf)
        cols = sorted(want.columns)
        assert sorted(map(str, (tuple(r) for r in got.select(*cols).collect()))) == sorted(map(str, want.select(*cols).fetchall())), name


def test_topk_edges(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [float("nan"), 1.0]), (3, None), (4, [1.0, None]), (5, [0.9]), (6, [1.0, 0.0]), (None, [1.0, 1.0]), (7, [])], "vec_id long, embedding array<float>")
    got = [tuple(r) for r in topk.search(rows, rows.filter("vec_id = 6"), k=3, group_rows=2).orderBy("rank").collect()]
    assert got == [(6, 1, 1, 4096), (6, 2, 5, 57 * 64), (6, 3, 1, 32 * 64)]
    assert topk.search(rows.limit(0), rows.limit(0)).count() == 0


def test_topk_by_global_lengths(spark):
    r = np.random.default_rng(2)
    v = r.normal(size=(600, 6)) * r.exponential(size=(600, 1))
    v[100:300] = v[100]  # a hot length
    rows = spark.createDataFrame([(int(i), x.tolist(), "x", 1.0) for i, x in enumerate(v)], "vec_id long, embedding array<double>, bucket string, norm double")
    got: dict = {}
    for x in topk.search(rows, rows.filter("vec_id % 20 = 0"), k=5, group_rows=50).orderBy("query_id", "rank").collect():
        got.setdefault(x.query_id, []).append((x.vec_id, x.score))
    e = np.floor(64 * v).astype(np.int64)
    for q in range(0, 600, 20):
        s = e @ e[q]
        assert got[q] == [(c, s[c]) for c in sorted((c for c in range(600) if c != q), key=lambda c: (-s[c], c))[:5]]


def test_topk_huge_components(spark):
    rows = spark.createDataFrame([(1, [1e30, 1.0]), (2, [1e8, 2.0]), (3, [-1e30, 0.0])], "vec_id long, embedding array<double>")
    got = [(x.vec_id, x.score) for x in topk.search(rows, rows.filter("vec_id = 1"), k=3).orderBy("rank").collect()]
    assert got == [(2, topk.MOST), (3, -topk.MOST)]


def test_topk_scores_of_a_whole_long(spark):
    """Scores beyond 2**62 that a long holds are told apart."""
    rows = spark.createDataFrame([(1, [float(1 << 30)]), (2, [float((1 << 20) + 1)]), (3, [float((1 << 20) + 2)]), (4, [-float((1 << 20) + 3)])], "vec_id long, embedding array<double>")
    got = [(x.vec_id, x.score) for x in topk.search(rows, rows.filter("vec_id = 1"), k=3).orderBy("rank").collect()]
    assert got == [(3, ((1 << 20) + 2) << 42), (2, ((1 << 20) + 1) << 42), (4, -((1 << 20) + 3) << 42)] and got[0][1] > 1 << 62


def test_topk_prunes_exactly(spark):
    r = np.random.default_rng(1)
    v = (r.normal(size=(3000, 8)) * r.exponential(size=(3000, 1)) * 64).astype(np.int64)
    group = topk.Group(np.arange(3000), v)
    q = np.concatenate([v[:40], np.eye(8, dtype=np.int64) * 50])
    ids = np.concatenate([np.arange(40), np.full(8, -1)])
    row, found, score = group.search(ids, q, 20)
    for i in range(len(q)):
        s = v @ q[i]
        want = [c for c in sorted(range(3000), key=lambda c: (-s[c], c)) if c != ids[i]][:20]
        got = sorted(zip(-score[row == i], found[row == i], strict=True))
        assert [c for _, c in got] == want


def ordered_plainly(turns, edges):
    """level and ready of every call that can be ordered."""
    needs = {c: {n for a, n in edges if a == c} for c in turns}
    out = {}
    while due := [c for c in turns if c not in out and all(n in out for n in needs[c])]:
        for c in due:
            out[c] = (max((out[n][0] + 1 for n in needs[c]), default=0), max([turns[c], *(out[n][1] for n in needs[c])]))
    return out


def test_deep_calls(spark, monkeypatch):
    """A chain of 2,000 calls, ladders, circles and missing needs, in a number of rounds that does not follow the depth."""
    r = np.random.default_rng(8)
    n = 2000
    turns = {f"c{i}": int(r.integers(0, 9000)) for i in range(n)}
    edges = [(f"c{i}", f"c{i - 1}") for i in range(1, n)]
    turns |= {f"t{i}": int(r.integers(0, 99)) for i in range(40)}  # a tree with cross needs: ten calls wait for two others
    edges += [(f"t{i}", f"t{i // 2}") for i in range(1, 40)] + [(f"t{i}", f"t{i - 4}") for i in range(30, 40)] + [("t39", "c1500"), ("t38", "c40")]
    turns |= {f"o{i}": i for i in range(30)}  # a circle, what hangs on it, and a call that needs one that isn't there
    edges += [(f"o{i}", f"o{(i + 1) % 20}") for i in range(20)] + [(f"o{i}", f"o{i - 1}") for i in range(20, 28)] + [("o28", "gone"), ("o29", "o28")]
    for rounds in (1, 3, 8):
        monkeypatch.setattr(toolcalls, "PLAIN_ROUNDS", rounds)
        calls = spark.createDataFrame([(1, c, t) for c, t in turns.items()], "conv_id long, call_id string, turn long")
        needs = spark.createDataFrame([(1, a, b) for a, b in edges] * 2, "conv_id long, call_id string, needs string")
        saved = []
        save = Workspace.save
        monkeypatch.setattr(Workspace, "save", lambda self, df, name: (saved.append(name), save(self, df, name))[1])
        got = {x.call_id: (x.level, x.ready) for x in toolcalls.levels(Workspace(spark, "t"), calls, needs).collect()}
        monkeypatch.setattr(Workspace, "save", save)
        assert got == ordered_plainly(turns, edges), rounds
        assert len(saved) < 50


def test_toxicity(spark):
    texts = [(i, ("nice calm words of day " * 5 + ("you vile scumbag " * 3 if i % 4 == 0 else "") + f"n{i}") if i else None) for i in range(400)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(1, 400)] + [(None, 1), (9999, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = toxicity.score(docs, model)
    assert got.filter("(score >= 0.5) <> (doc_id % 4 = 0 and doc_id > 0)").count() == 0
    assert got.filter("score < 0 or score > 1").count() == 0
    assert toxicity.score(docs, toxicity.train(docs, labels.limit(0))).select("score").distinct().count() == 1
    assert toxicity.score(docs.limit(0), model).count() == 0
    odd = docs.select(F.lit(None).cast("long").alias("doc_id"), "text", F.lit(1).alias("toxic"), F.lit("x").alias("piece"))
    assert toxicity.score(odd, toxicity.train(odd, labels)).count() == 400


def test_toxicity_models_sum_to_one_and_tell_held_out_rows(spark):
    r = np.random.default_rng(4)
    n1, n0, kinds = r.integers(0, 50, 500), r.integers(0, 400, 500), r.integers(1, 9, 500)
    n1[7], n0[7] = 900, 1
    n0 = n0 + (n1 + n0 == 0)
    shared = toxicity.shared_distribution(n1 + n0, kinds, n1.sum() + n0.sum(), 500, kinds.sum())
    assert np.isclose(shared.sum(), 1)
    own = [toxicity.own_part(n, n.sum(), shared) for n in (n1, n0)]
    p = [o / n.sum() + (1 - o.sum() / n.sum()) * shared for o, n in zip(own, (n1, n0))]
    assert np.isclose(p[0].sum(), 1) and np.isclose(p[1].sum(), 1) and own[0][7] > 0
    want = np.log(p[0] / p[1])
    got = toxicity.fitted(spark.createDataFrame([(i, int(a), int(b), int(k)) for i, (a, b, k) in enumerate(zip(n1, n0, kinds))], "piece long, n1 long, n0 long, kinds long")).lookup(np.arange(501, dtype=np.uint64))
    assert np.allclose(got[:500], want) and np.isclose(got[500], np.median(want))
    # held-out rows of a driver table: the area under the curve
    sf = "/root/testdata/sf0.1"
    rows = toxicity.op2_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").select("score", "toxic").toPandas()
    ranks, ones = rows["score"].rank(), rows["toxic"].sum()
    assert (ranks[rows["toxic"] == 1].sum() - ones * (ones + 1) / 2) / (ones * (len(rows) - ones)) > 0.85


def test_packing(docs, empty):
    path = tokens.public_path("byte_bpe_50k.json")
    made = Tokenizer.from_file(path)
    made.encode_special_tokens = True
    want = {i: np.array(made.encode(t or "", add_special_tokens=False).ids + [1], "<u4") for i, t, _ in ROWS}
    got = packing.pack(docs, path).collect()
    for i, ids in want.items():
        parts = sorted((r for r in got if r.doc_id == i), key=lambda r: r.start)
        assert [r.start for r in parts] == [0, *np.cumsum([r.length for r in parts])[:-1]] and sum(r.length for r in parts) == len(ids)
        assert all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in parts)
    for s in {r.sequence_id for r in got}:
        parts = sorted((r.offset, r.length) for r in got if r.sequence_id == s)
        assert [a for a, _ in parts] == [0, *np.cumsum([n for _, n in parts])[:-1]] and sum(n for _, n in parts) <= 2048
    assert packing.pack(empty, path).count() == 0


def test_packing_wastes_little():
    r = np.random.default_rng(0)
    sizes = (r.exponential(500, 3000) + 1).astype(int).tolist()
    ends: dict = {}
    for _, _, n, s, at in packing.assign(sizes):
        ends[s] = max(ends.get(s, 0), at + n)
    assert sum(ends.values()) == sum(sizes) and sum(2048 - e for e in ends.values() if e & (e - 1)) < 64


def test_packing_cuts_only_what_fits_nowhere():
    r = np.random.default_rng(0)
    sizes = (r.exponential(500, 3000) + 1).astype(int).tolist()
    pieces = packing.assign(sizes)
    room: dict = {}
    for _, _, n, s, _ in pieces:
        room[s] = room.get(s, 0) + n
    costs = dict.fromkeys(room, 0.0)
    for d, start, n, s, _ in pieces:
        left = sizes[d] - start
        if n < 2048 or room[s] < 2048:
            fitting = [(costs[x], x) for x in room if room[x] >= left and costs[x] < float("inf")]
            assert s == min(fitting or [(costs[x], x) for x in room if room[x]])[1]
            assert n == left or not fitting
        elif left >= 2048:  # a full sequence of one document
            costs[s] = float("inf")
        room[s] -= n
        costs[s] += packing.cost(n)


def test_substrings(docs, empty):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], hashlib.sha256(r["kept_text"].encode()).hexdigest()) for r in substrings.remove_repeats(keyed(Workspace(docs.sparkSession, "t"), docs)).collect()}
    assert got == substrings.brute_force([(a, b) for a, b, _ in ROWS])
    assert substrings.remove_repeats(keyed(Workspace(docs.sparkSession, "t"), empty)).count() == 0


def test_repeated_and_null_ids(spark):
    docs = spark.createDataFrame([(1, LONG), (1, LONG), (None, LONG), (None, None)], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["n_removed"]) for r in substrings.remove_repeats(keyed(Workspace(spark, "t"), docs)).collect())
    assert [n for _, n in got if n] == [60, 60] and len(got) == 4
    assert neardup.near_duplicates(keyed(Workspace(spark, "t"), docs)).filter("component <> rid").count() == 2
    assert exactdedup.dedup(docs).filter("group_size = 3").count() == 3


def test_binary_ids(docs, empty, spark):
    path, ws = tokens.public_path("word_bpe_49k.json"), Workspace(spark, "t")
    made = Tokenizer.from_file(path)
    made.encode_special_tokens = True
    huffman.write(docs, ws.path("f"), path)
    got, at = rows_of(huffman.read(spark, ws.path("f"))), 0
    for i, t, _ in ROWS:
        ids = np.array(made.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes())), i
        at += len(ids)
    huffman.write(empty, ws.path("e"), path)
    assert huffman.read(spark, ws.path("e")).count() == 0


def test_binary_ids_of_split_files(spark):
    r = np.random.default_rng(2)
    docs = spark.createDataFrame([(i, " ".join(f"{x:x}" for x in r.integers(0, 1 << 30, 20))) for i in range(1500)], "doc_id long, text string").coalesce(1)
    ws, hadoop = Workspace(spark, "t"), spark.sparkContext._jsc.hadoopConfiguration()
    conf = {"spark.sql.files.maxPartitionBytes": "4k", "spark.sql.files.openCostInBytes": "1"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    hadoop.setInt("parquet.block.size", 4096)
    try:
        huffman.write(docs, ws.path("f"), tokens.public_path("word_bpe_49k.json"))
        blocks = spark.read.parquet(ws.path("f/blocks")).select("shard", "block").collect()
        got = sorted((x["doc_id"], x["start"], x["n_tokens"]) for x in huffman.read(spark, ws.path("f")).collect())
    finally:
        hadoop.unset("parquet.block.size")
        for k in conf:
            spark.conf.unset(k)
    assert [i for i, _, _ in got] == list(range(1500)) and [s for _, s, _ in got] == [0, *np.cumsum([n for _, _, n in got])[:-1]]
    assert len(blocks) == len(set(blocks)) > len({x["shard"] for x in blocks})


def test_huffman_blocks():
    r = np.random.default_rng(0)
    counts = np.zeros(49408, np.int64)
    counts[:5000] = (1e7 / np.arange(1, 5001) ** 1.5).astype(int) + 1
    lengths = huffman.code_lengths(counts)
    assert lengths.max() <= 16 and np.isclose((2.0 ** -lengths[lengths > 0].astype(float)).sum(), 1)
    for n in (1, 255, 256, 257, 5000):
        ids = r.integers(0, 5000, n)
        bits, points = huffman.encode_block(ids, huffman.canonical(lengths), lengths)
        assert (huffman.decode_block(bits, points, n, huffman.decoding_table(lengths)) == ids).all()


def test_exact(docs, empty):
    got = rows_of(exactdedup.dedup(docs, bucket_bytes=256))
    assert [(got[i]["keep_id"], got[i]["group_size"]) for i in (1, 2, 3, 13, 14, 4)] == [(3, 3), (3, 3), (3, 3), (13, 2), (13, 2), (4, 1)]
    assert got[3]["kept"] and not got[1]["kept"] and got[1]["text_sha256"] == hashlib.sha256(b"").hexdigest()
    assert exactdedup.dedup(empty).count() == 0


def test_exact_hot_texts(spark):
    """One text in many batches and windows: folded in rounds, one owner sees few entries of it."""
    rows = [(i, ("hot  text" if i % 3 else "hot text") if i % 2 else (f"t{i}" if i % 4 else None)) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(150)
    old, exactdedup.FOLD_ROWS = exactdedup.FOLD_ROWS, 8
    try:
        got = {x["doc_id"]: (x["keep_id"], x["group_size"]) for x in exactdedup.dedup(docs, bucket_bytes=2048).collect()}
    finally:
        exactdedup.FOLD_ROWS = old
    empty = sum(1 for _, t in rows if t is None)
    assert got == {i: (1, 1500) if i % 2 else (i, 1) if i % 4 else (0, empty) for i, _ in rows}


def test_tool_calls(spark):
    calls = spark.createDataFrame([(1, "a", 0, "reply", '{"turn":1,"text":"q \\u00e9"}'), (1, "b", 2, "reply", "{}"), (1, "c", 4, "other", "{}"), (1, "d", 6, "reply", "no json"), (1, "e", 8, "reply", '{"text":"x","turn":2}'), (1, "f", 9, "reply", '{"text":"x","turn":2}'), (1, "g", 9, "reply", '{"text":"x","turn":2}'), (None, None, None, None, None)], "conv_id long, call_id string, turn long, name string, arguments string")
    results = spark.createDataFrame([(1, "a", 1, 'say "hi"'), (1, "a", 5, "later"), (1, "z", 3, None)], "conv_id long, call_id string, turn long, content string")
    needs = spark.createDataFrame([(1, "e", "a"), (1, "f", "g"), (1, "g", "f")], "conv_id long, call_id string, needs string")
    got = {r["call_id"]: r for r in toolcalls.link(Workspace(spark, "t"), calls, results, needs).collect()}
    assert {k: r["status"] for k, r in got.items()} == {"a": "ok", "b": "bad_arguments", "c": "unknown_tool", "d": "bad_json", "e": "no_result", "f": "unordered", "g": "unordered", "z": "orphan_result", None: "unordered"}
    assert got["a"]["message"] == '{"arguments":{"text":"q é","turn":1},"call_id":"a","name":"reply","result":"say \\"hi\\""}'
    assert got["e"]["level"] == 1 and got["a"]["level"] == 0
    assert toolcalls.link(Workspace(spark, "t"), calls.limit(0), results.limit(0), needs.limit(0)).count() == 0


def test_tool_calls_in_long_chains(spark):
    n = 66
    calls = spark.createDataFrame([(1, f"c{i}", i, "reply", '{"text":"x","turn":1}') for i in range(n)], "conv_id long, call_id string, turn long, name string, arguments string")
    needs = spark.createDataFrame([(1, f"c{i + 1}", f"c{i}") for i in range(n - 1)], "conv_id long, call_id string, needs string")
    got = {r["call_id"]: (r["level"], r["ready"]) for r in toolcalls.levels(Workspace(spark, "t"), calls, needs).collect()}
    assert got == {f"c{i}": (i, i) for i in range(n)}


def test_byte_bpe(docs, empty):
    path = tokens.public_path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    made = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = rows_of(bpe.encode_documents(docs, path, P.PATTERN))
    for i, t, _ in ROWS:
        assert (got[i]["ids"], bytes(got[i]["decoded"])) == (made.encode_ordinary(t or ""), (t or "").encode()), i
    assert bpe.digest_documents(empty, path, P.PATTERN).count() == 0


def test_lines(docs, empty):
    got = {r["doc_id"]: r for r in lines.remove_lines(keyed(Workspace(docs.sparkSession, "t"), docs)).collect()}
    assert got[9]["kept_text"] == "new" and got[8]["n_removed"] == 0 and got[10]["n_removed"] == 0 and got[1]["kept_text"] == ""
    runs = lines.repeated_lines(keyed(Workspace(docs.sparkSession, "t"), docs), report_runs=True)
    assert {r["rid"]: r["longest_run"] for r in runs.collect()} == {8: 3, 9: 3, 10: 1, 13: 1, 14: 1}
    assert lines.remove_lines(keyed(Workspace(docs.sparkSession, "t"), empty)).count() == 0


def lines_brute(rows):
    """The longest run of lines of each row that is elsewhere too."""
    seqs = {i: [x for x in (t or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")] for i, t in rows}
    out, width, alive = {}, 1, {(i, p) for i, s in seqs.items() for p in range(len(s))}
    while alive:
        found: dict = {}
        for i, p in alive:
            if p + width <= len(seqs[i]):
                found.setdefault(tuple(seqs[i][p : p + width]), []).append((i, p))
        alive = {x for xs in found.values() if len(xs) > 1 for x in xs}
        out |= {i: width for i, _ in alive}
        width += 1
    return out


def test_maximal_runs(spark):
    r = np.random.default_rng(5)
    rows = [(i, "\n".join(f"line {x}" for x in r.integers(0, 3 if i % 3 else 40, r.integers(0, 40)))) for i in range(30)]
    rows += [(50, rows[3][1] + "\nx\n" + rows[7][1]), (51, rows[3][1]), (52, "\n".join(["same"] * 21)), (53, None), (54, "alone")]
    table = spark.createDataFrame(rows, "rid long, text string").fillna("")
    got = {x["rid"]: x["longest_run"] for x in lines.repeated_lines(table, report_runs=True).collect()}
    assert got == lines_brute(rows)
    for least in (1, 3, 5):  # runs of least lines and more go, whatever least is
        gone = {(x["rid"], i) for x in lines.repeated_lines(table, min_lines=least, long_line=1000).collect() for i in x["deleted"]}
        seen, want = set(), set()
        for i, t in rows:
            s = (t or "").split("\n") if t else []
            for p in range(len(s) - least + 1):
                if (key := tuple(s[p : p + least])) in seen:
                    want |= {(i, q) for q in range(p, p + least)}
                seen.add(key)
        assert gone == want, least


def thue_morse(n):
    out = "a"
    for _ in range(n):
        out += out.translate({97: 98, 98: 97})
    return out, out.translate({97: 98, 98: 97})


def test_words_that_polynomials_confuse(spark, tmp_path):
    """Words of 1,024 letters that are equal under any polynomial hash modulo a power of two."""
    one, other = thue_morse(10)
    tail = " ".join(f"t{i}" for i in range(19))
    rows = [(1, f"{one} {tail}"), (2, f"{other} {tail}"), (3, one), (4, other), (5, one)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {x["doc_id"]: x["n_removed"] for x in substrings.op4_substring_dedup(spark, str(tmp_path)).collect()}
    assert got == dict.fromkeys(range(1, 6), 0)
    got = {x["doc_id"]: x["component_id"] for x in neardup.op10_minhash_dedup(spark, str(tmp_path)).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 3}  # 1 and 2 share 18 of 20 shingles


def test_queries_against_brute_force(spark):
    """op4 and op10 over a whole driver table."""
    sf = "/root/testdata/sf0.01"
    rows = [tuple(x) for x in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = {x["doc_id"]: (x["n_words"], x["n_removed"], x["kept_sha256"]) for x in substrings.op4_substring_dedup(spark, sf).collect()}
    assert got == substrings.brute_force(rows)
    sets, label = near_brute(rows)
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"], x["kept"]) for x in neardup.op10_minhash_dedup(spark, sf).collect()}
    assert got == {i: (len(s), label.get(i, i), label.get(i, i) == i) for i, s in sets.items()}


def near_brute(rows, k=2):
    sets = {}
    for i, t in rows:
        w = (t or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    return sets, in_memory(links)


def test_near(docs, empty, spark, sf):
    some = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    for rows in ([(a, b) for a, b, _ in ROWS], some):
        table = spark.createDataFrame(rows, "doc_id long, text string")
        sets, label = near_brute(rows)
        got = {r["rid"]: (r["n_shingles"], r["component"]) for r in neardup.near_duplicates(keyed(Workspace(spark, "t"), table)).collect()}
        assert got == {i: (len(s), label.get(i, i)) for i, s in sets.items()}
    assert neardup.near_duplicates(keyed(Workspace(spark, "t"), empty)).count() == 0


def test_near_keeps_doc_ids(spark, tmp_path):
    other = " ".join(f"v{i}" for i in range(60))
    rows = [(70, LONG), (90, LONG + " end."), (50, other), (50, other), (None, "alone"), (30, "single")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in neardup.op10_minhash_dedup(spark, str(tmp_path)).select("doc_id", "component_id", "kept").collect()]
    assert sorted(got, key=str) == sorted([(70, 70, True), (90, 70, False), (50, 50, True), (50, 50, False), (None, None, True), (30, 30, True)], key=str)


def test_prefix_pairs_lose_no_link(spark):
    r = np.random.default_rng(3)
    common = list(range(1000, 1030))  # a passage of many rows
    sets = {}
    for i in range(60):
        own = r.integers(0, 60, r.integers(0, 30)).tolist()
        sets[i] = sorted({*(common if i % 2 else []), *own} or {5000 + i})
        if i % 3 == 0:  # a near copy, at, above or below the threshold
            sets[100 + i] = sorted({*sets[i][: len(sets[i]) - int(r.integers(0, 1 + len(sets[i]) // 4))], *([7000 + i] if i % 2 else [])} or {6000 + i})
    nodes = spark.createDataFrame([(i, i, len(x)) for i, x in sets.items()], "rid long, label long, n long")
    table = spark.createDataFrame(list(sets.items()), "rid long, shingles array<long>")
    got = {tuple(x) for x in neardup.prefix_pairs(Workspace(spark, "t"), nodes, table, 80).collect()}
    pairs = [(a, b) for a in sets for b in sets if a < b]
    linked = {(a, b) for a, b in pairs if 100 * len({*sets[a]} & {*sets[b]}) >= 80 * len({*sets[a]} | {*sets[b]})}
    assert linked and linked <= got and len(got) < len(pairs) / 4
    one = nodes.withColumn("label", F.lit(1))
    assert neardup.prefix_pairs(Workspace(spark, "t"), one, table, 80).count() == 0
    assert neardup.prefix_pairs(Workspace(spark, "t"), nodes.limit(0), table, 80).count() == 0


def test_prefix_pairs_of_short_texts(spark):
    """Short texts of few common shingles: pairs in proportion to what is alike, not to the square of their number."""
    r = np.random.default_rng(5)
    sets = {}
    for i in range(2000):
        sets.setdefault(tuple(sorted(r.choice(40, int(r.integers(3, 5)), replace=False).tolist())), i)
    nodes = spark.createDataFrame([(i, i, len(x)) for x, i in sets.items()], "rid long, label long, n long")
    table = spark.createDataFrame([(i, list(x)) for x, i in sets.items()], "rid long, shingles array<long>")
    assert neardup.prefix_pairs(Workspace(spark, "t"), nodes, table, 80).count() < 4 * len(sets)


def test_words_made_to_collide(spark):
    """Words and lines that fixed hashes of 64 bits don't tell apart."""
    text = 'a ?1jw)"w\\>9wwm4>4 a %bs^4q\\k2y~53t`! a'
    rows = spark.createDataFrame([(1, text)], "rid long, text string")
    assert neardup.near_duplicates(rows).first()["n_shingles"] == 4
    pair = ["97G)@5R{filler..filler..filler..F7Ztw+mlfiller..filler..filler..", "97G)@5Rkfiller..filler..filler..F7Z,}+6Ffiller..filler..filler.."]
    both = spark.createDataFrame(list(enumerate(pair)), "rid long, text string")
    assert [r["n_removed"] for r in lines.remove_lines(both).collect()] == [0, 0]


def test_equal_lines_stay_linear(spark, monkeypatch):
    """A text of n equal lines stages rows in proportion to n at each level; runs are right to the line."""
    staged = {}
    save = Workspace.save

    def counted(self, df, name):
        table = save(self, df, name)
        staged[name] = table.count()
        return table

    monkeypatch.setattr(Workspace, "save", counted)
    for n in (500, 1000):
        staged.clear()
        rows = spark.createDataFrame([(1, "\n".join(["the same line"] * n)), (2, "other\n" + "\n".join(["the same line"] * 7))], "rid long, text string")
        got = {r["rid"]: (r["n_removed"], r["longest_run"]) for r in lines.remove_lines(rows, report_runs=True).collect()}
        assert got == {1: (n - 1, n - 1), 2: (7, 7)} and max(staged.values()) <= 2 * n + 14, staged


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 40) if i % 7] + [(100, 3), (101, 100)]
    got = {r["node"]: r["label"] for r in connected_components(Workspace(spark, "t"), spark.createDataFrame(links, "a long, b long"), "t").collect()}
    want = {n: x for n, x in in_memory(links).items() if n != x}
    assert got == want


def test_pipeline_stages_against_brute_force(spark, tmp_path):
    passage = " ".join(f"p{i}" for i in range(40))
    texts = {i: " ".join(f"d{i}x{j}" for j in range(30)) for i in range(40)}
    texts |= {i: texts[i] + " you vile scumbag" * 4 for i in range(0, 40, 4)}
    texts[41] = "a line of this text that is repeated\nand the line that follows it\n" + texts[1]
    texts[42] = "a line of this text that is repeated\nand the line that follows it\n" + texts[2].replace("d2x", "e2x")
    texts[43], texts[45] = texts[3] + " end", texts[5] + " " + passage
    texts[46], texts[47], texts[48] = texts[6].replace("d6x", "e6x") + " " + passage, "", None
    docs = spark.createDataFrame([(i, t, len(t or "")) for i, t in sorted(texts.items())], "doc_id long, text string, n_chars long")
    spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(40)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    by_name, ws = dict(corpus_pipeline.STAGES), Workspace(spark, "t")

    def after(name):
        nonlocal docs
        docs = ws.save(by_name[name](spark, docs, str(tmp_path)), name.replace(" ", "-"))
        rows = docs.collect()
        assert len({r["doc_id"] for r in rows}) == len(rows) and all(r["n_chars"] == len(r["text"] or "") for r in rows)
        return {r["doc_id"]: r["text"] for r in rows}

    want = {i: t for i, t in texts.items() if "scumbag" not in (t or "")}
    assert after("toxicity") == want
    seen: set = set()
    for i, t in sorted(want.items()):  # no short lines here: every later copy goes
        lines_ = (t or "").split("\n")
        want[i] = t if t is None else "\n".join(x for x in lines_ if not x or x not in seen)
        seen |= set(lines_)
    assert after("line dedup") == want
    _, label = near_brute(list(want.items()), 5)
    want = {i: t for i, t in want.items() if label.get(i, i) == i}
    assert 43 not in want and after("MinHash near-dedup") == want
    brute = substrings.brute_force(list(want.items()))
    got = after("substring dedup")
    assert {i: hashlib.sha256(b" ".join((t or "").encode().split())).hexdigest() for i, t in got.items()} == {i: x[2] for i, x in brute.items()}
    assert all(got[i] == want[i] for i, x in brute.items() if not x[1])  # others stay as they are
    assert sum(x[1] for x in brute.values()) > 0
    packed = by_name["packing"](spark, docs, str(tmp_path)).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("all")).collect()
    assert {r["doc_id"] for r in packed} == set(got) and all(r["n"] == r["all"] for r in packed)


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        ws = Workspace(spark, "t")
        before = docs.count()
        docs = ws.save(stage(spark, docs, sf), "s")
        assert docs.columns == columns and 0 < docs.count() <= before, name
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    gone = {r["rid"]: r["deleted"] for r in lines.repeated_lines(spark.createDataFrame(texts, "rid long, text string").fillna("")).collect()}
    assert len(texts) > 50 and sum(n for _, n, _ in substrings.brute_force(texts).values()) < sum(len((t or "").split()) for _, t in texts) / 100
    assert sum(map(len, gone.values())) < len(texts)
    total = corpus_pipeline.pack(spark, docs, sf).select("doc_id").distinct().count()
    assert total == docs.count()
    assert docs.filter(F.col("n_chars") != F.length("text")).count() == 0
