"""Repeated and null ids, driver tables against the libraries, a plain recomputation of the toxicity scores, the pipeline's edges."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

import corpus_pipeline
from sparkfind.llm import bpe, huffman, lines, neardup, packing, substrings, toxicity
from sparkfind.llm.common import Workspace, keyed

ODD = [(1, "one two three"), (1, "one two three"), (1, "another text"), (None, "no id"), (None, "no id"), (None, None), (2, ""), (3, "l1 of this long line\nl2 of this long line\n"), (3, "l1 of this long line\nl2 of this long line\n")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in ODD], "doc_id long, text string, rid string, n_tokens int")


@pytest.fixture(scope="module")
def library():
    made = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    made.encode_special_tokens = True
    return made


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def test_packing_of_odd_ids_and_the_driver_table(spark, sf, odd, library):
    got = packing.pack(odd, P.path("byte_bpe_50k.json")).collect()
    whole = [r for r in got if r["start"] == 0]
    assert sorted((r["doc_id"] or -1, r["doc_tokens"]) for r in whole) == sorted((i or -1, len(library.encode(t or "", add_special_tokens=False).ids) + 1) for i, t in ODD)
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    ids = {i: [*library.encode(t or "", add_special_tokens=False).ids, 1] for i, t in docs.items()}
    seen, fill = defaultdict(list), defaultdict(list)
    for r in packing.op3_packing(spark, sf).collect():
        assert r["ids_crc32"] == crc(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]) and r["doc_tokens"] == len(ids[r["doc_id"]])
        seen[r["doc_id"]].append((r["start"], r["length"]))
        fill[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, parts in seen.items():
        assert [a for a, _ in sorted(parts)] == list(np.cumsum([0, *(n for _, n in sorted(parts))])[:-1]) and sum(n for _, n in parts) == len(ids[i])
    for parts in fill.values():
        assert [a for a, _ in sorted(parts)] == list(np.cumsum([0, *(n for _, n in sorted(parts))])[:-1]) and sum(n for _, n in parts) <= 2048
    assert seen.keys() == ids.keys()


def test_binary_ids_of_odd_ids_and_the_driver_table(spark, sf, odd, tmp_path):
    made = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    made.encode_special_tokens = True
    huffman.write(odd, f"file://{tmp_path}/ids", P.path("word_bpe_49k.json"))
    got = huffman.read(spark, f"file://{tmp_path}/ids").collect()
    assert sorted((r["doc_id"] or -1, r["n_tokens"]) for r in got) == sorted((i or -1, len(made.encode(t or "", add_special_tokens=False).ids) + 1) for i, t in ODD)
    at = sorted((r["start"], r["n_tokens"]) for r in got)
    assert [a for a, _ in at] == list(np.cumsum([0, *(n for _, n in at)])[:-1]) and [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])] == sorted((i for i, _ in ODD), key=lambda i: (i is not None, i))
    start, want = 0, []
    for r in sorted(spark.read.parquet(f"{sf}/documents.parquet").collect(), key=lambda r: r["doc_id"]):
        ids = [*made.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        want.append((r["doc_id"], start, len(ids), crc(ids)))
        start += len(ids)
    found = huffman.op5_binary_ids(spark, sf).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(tuple(r) for r in found) == want


def test_byte_bpe_of_odd_ids_and_the_driver_table(spark, sf, odd):
    ranks = bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
    made = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def row(i, t):
        ids = np.asarray(made.encode_ordinary(t or ""), "<u4")
        return str((i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))

    got = bpe.digest_documents(odd, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
    assert sorted(str(tuple(r)) for r in got) == sorted(row(i, t) for i, t in ODD)
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(str(tuple(r)) for r in bpe.op8_byte_bpe(spark, sf).collect()) == sorted(row(i, t) for i, t in docs)
    assert bpe.digest_documents(odd.limit(0), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


def test_lines_of_odd_ids(spark, odd):
    got = lines.remove_lines(keyed(Workspace(spark, "t"), odd), report_runs=True).collect()
    assert sorted((r["doc_id"] or -1, r["n_lines"], r["n_removed"], r["longest_run"]) for r in got) == sorted(
        [(1, 1, 0, 1), (1, 1, 0, 1), (1, 1, 0, 0), (-1, 1, 0, 1), (-1, 1, 0, 1), (-1, 0, 0, 0), (2, 0, 0, 0), (3, 2, 0, 2), (3, 2, 2, 2)]
    )


def test_long_texts(spark):
    """Texts beyond what the helpers hold at once: near copies of 1.5 MB, a passage repeated over 2.5 MB apart."""
    r = np.random.default_rng(4)
    long = " ".join(f"w{x}" for x in r.integers(0, 10**6, 200_000))
    rows = spark.createDataFrame([(1, long), (2, long + " end"), (3, "small text")], "rid long, text string")
    assert {x.rid: x.component for x in neardup.near_duplicates(rows).collect()} == {1: 1, 2: 1, 3: 3}
    passage = " ".join(f"p{i}" for i in range(50))
    text = passage + " " + long + " " + " ".join(f"v{x}" for x in range(200_000)) + " " + passage
    got = {x.rid: (x.n_words, x.n_removed) for x in substrings.remove_repeats(spark.createDataFrame([(1, text), (2, passage)], "rid long, text string")).collect()}
    want = substrings.brute_force([(1, text), (2, passage)])
    assert got == {i: want[i][:2] for i in (1, 2)} and got[1][1] == 50


# ------------------------------------------------------------------ toxicity, word by word
def plain_pieces(text):
    b = " " + "".join(" " if c in " \t\n\x0b\x0c\r" else chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or "").encode().decode("latin-1")) + " "
    return [b[i : i + 5] for i in range(len(b) - 4) if " " not in b[i + 1 : i + 4]]


def plain_scores(docs, labels):
    toxic = defaultdict(int)
    for i, t in labels:
        toxic[i] = max(toxic[i], t)
    part = lambda i: zlib.crc32(str(i).encode()) % 5
    count, after = [Counter(), Counter()], defaultdict(set)
    for i, t in docs:
        if i in toxic and part(i) in (1, 2, 3):
            before = None
            for x in plain_pieces(t):
                count[toxic[i]][x] += 1
                after[x].add(before)
                before = x
    all_, kinds = [sum(c.values()) for c in count], sum(len(v) for v in after.values())
    shared = {x: (count[0][x] + count[1][x] - 0.75 + 0.75 * len(after) * len(after[x]) / kinds) / sum(all_) for x in after}
    own = [{x: max(count[c][x] - all_[c] * s - 5 * math.sqrt(all_[c] * s + 1), 0) for x, s in shared.items()} for c in (0, 1)]
    rest = [1 - sum(own[c].values()) / all_[c] for c in (0, 1)]
    ratio = {x: math.log((own[1][x] / all_[1] + rest[1] * s) / (own[0][x] / all_[0] + rest[0] * s)) for x, s in shared.items()}
    other = math.log(rest[1] / rest[0])

    def feature(t):
        found = [ratio.get(x, other) for x in plain_pieces(t)]
        return sum(found) / len(found) if found else 0.0

    x, y = zip(*[(feature(t), toxic[i]) for i, t in docs if i in toxic and part(i) == 4], strict=True)
    scale = float(np.std(x)) or 1.0
    a = b = 0.0
    for _ in range(20_000):  # ascent of the same ridged likelihood, by small steps
        p = [1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * v / scale)))) for v in x]
        ga = sum(t - q for t, q in zip(y, p, strict=True)) - 1e-3 * a
        gb = sum((t - q) * v / scale for t, q, v in zip(y, p, x, strict=True)) - 1e-3 * b
        a, b = a + ga * 8 / len(x), b + gb * 8 / len(x)
        if abs(ga) + abs(gb) < 1e-9:
            break
    return {i: 1 / (1 + math.exp(-max(-500.0, min(500.0, a + b / scale * feature(t))))) for i, t in docs}


def test_toxicity_scores_plainly(spark):
    r = np.random.default_rng(6)
    calm, vile = [f"word{i}" for i in range(40)], ["scumbag", "vile", "idiot", "Éxtreme"]
    docs = []
    for i in range(200):
        w = r.choice(calm, 20).tolist()
        docs.append((i, None if i == 5 else " ".join(w + (r.choice(vile, 4).tolist() if i % 3 == 0 else r.choice(vile, i % 2).tolist()))))
    labels = [(i, int(i % 3 == 0 and i % 21 != 0)) for i in range(190)] + [(3, 0), (500, 1)]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    model = toxicity.train(table, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {x.doc_id: x.score for x in toxicity.score(table, model).select("doc_id", "score").collect()}
    want = plain_scores(docs, labels)
    assert max(abs(got[i] - want[i]) for i in got) < 1e-5 and max(want.values()) - min(want.values()) > 0.5


# ------------------------------------------------------------------ pipeline
def test_pipeline_edges(spark, tmp_path):
    spark.createDataFrame([(i, i % 2) for i in range(6)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = [(1, "same text of both rows here and there", "a"), (1, "same text of both rows here and there", "b"), (None, "without any id but words", "c"), (None, None, "d"), (2, "", None), (3, "x " * 50, "e")]
    schema = "doc_id long, text string, _toxicity string"
    docs = spark.createDataFrame(rows, schema)
    ws = Workspace(spark, "t")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = ws.save(stage(spark, docs, str(tmp_path)), f"edge-{i}")
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns and {r["_toxicity"] for r in out.collect()} >= {"c", "d", None}, name
        else:
            assert {r["doc_id"] for r in out.collect()} == {r["doc_id"] for r in docs.collect()}
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
        docs = out
