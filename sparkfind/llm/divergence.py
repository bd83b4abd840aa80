"""Source divergence audit: which terms, and which other sources, a source differs from in its language.

A term is a run of letters A-Z, a-z (lower-cased) and characters beyond ASCII. Each language keeps the ``V``
terms that at least ``min_docs`` of its documents have. A group is an occurring (lang, source). With ``n``
occurrences of a kept term in the group and ``N`` of all kept terms, the term's share is
``p = 1 + floor(SCALE * (n + 2) / (N + 2 V))``, and ``q`` the same over the whole language. The divergence is
``f = floor((p - q)**2 / (p + q))``. Shares are exact: products are decimals of 38 digits, quotients longs.

Part ``term`` is an upper-bound search. In a group all terms of one count have one share, so they are a bucket;
f falls as q rises to p, so the least q of a bucket bounds all of it. Buckets are evaluated best bound first, in
rounds: the first takes those that surely hold k terms, each further one sixteen times as many. A round leaves out buckets whose
bound is strictly below the group's k-th value, and the search ends when no unseen bucket reaches it (ties do).

Part ``pair`` sums f over all kept terms for each two sources of a language. Most terms of most groups are absent
and share the group's base share, so with base shares ``p0`` the sum is
``(V - |A| - |B|) f(p0a, p0b) + sum_A f(pa, p0b) + sum_B f(p0a, pb) + sum_AB [f(pa, pb) - f(pa, p0b) - f(p0a, pb) + f(p0a, p0b)]``:
the middle sums come from the count buckets, the last from a join of the postings by (lang, term). The output itself
has every pair of sources of a language; nothing else is made for pairs of groups.

Null text, lang and source are empty strings. A group without terms has pairs but no term rows; where V is 0 its
values are 0. Repeated rows count as often as they stand there. An empty table gives no rows. Further columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Workspace, schema_columns

MIN_DOCS, TOP, SCALE = 10, 10, 1_000_000_000
#: Entries that a task holds before it passes its partial counts on, and bytes of one text taken at a time.
HELD, SLICE = 200_000, 4 << 20
#: Bytes of terms, A-Z lower-cased; all others part terms.
_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
COUNTS = "lang string, source string, term string, n long, docs long"


def _slices(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, slice by slice; slices end between terms."""
    at = 0
    while at < len(text):
        end = at + SLICE
        if end < len(text):
            end = text.find(b" ", end)
            end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def partial_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs: each task's own counts; the empty term stands for the group (docs: its documents)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def emit() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, docs) in held.items():
                terms = list(docs)
                for i in range(0, len(terms), 50_000):
                    part = terms[i : i + 50_000]
                    columns = [pa.array([lang] * len(part)), pa.array([source] * len(part)), pa.array(part, pa.binary()).cast(pa.string())]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array([n[t] for t in part], pa.int64()), pa.array([docs[t] for t in part], pa.int64())], ["lang", "source", "term", "n", "docs"])
            held.clear()

        for batch in batches:
            lang, source, text = schema_columns(batch, "lang", "source", "text")
            for key, t in zip(zip(lang.to_pylist(), source.to_pylist(), strict=True), text.cast(pa.binary()), strict=True):
                n, docs = held.setdefault(key, (Counter(), Counter()))
                seen = {b""}
                for words in _slices(t.as_py().translate(_BYTES)):
                    n.update(words)
                    seen.update(words)
                docs.update(seen)
            if sum(len(d) for _, d in held.values()) > HELD:
                yield from emit()
        yield from emit()

    return docs.mapInArrow(run, COUNTS)


def share(n: str, total: str, terms: str = "v") -> Column:
    """1 + floor(SCALE * (n + 2) / (total + 2 terms)); null where there are no terms."""
    return F.expr(f"1 + cast({SCALE} as decimal(10,0)) * cast({n} + 2 as decimal(20,0)) div nullif(cast({total} + 2 * {terms} as decimal(20,0)), 0)")


def spread(p: str, q: str) -> str:
    """f of two shares; shares are at most SCALE + 1, so their difference squared is a long."""
    return f"(({p} - {q}) * ({p} - {q}) div ({p} + {q}))"


def shares(ws: Workspace, docs: DataFrame, min_docs: int) -> tuple[DataFrame, DataFrame]:
    """The groups (lang, source, v, base: share of an absent term, kinds: its kept terms) and the postings (lang, source, term, n, p, q, base)."""
    named = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counts = ws.save(partial_counts(named).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "counts")
    words = counts.filter("term <> ''")
    kept = words.groupBy("lang", "term").agg(F.sum("n").alias("nl"), F.sum("docs").alias("docs")).filter(F.col("docs") >= min_docs).drop("docs")
    plain = ws.save(words.drop("docs").join(kept, ["lang", "term"]), "kept")
    of_lang = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("nl").alias("total"))
    of_group = plain.groupBy("lang", "source").agg(F.sum("n").alias("own"), F.count(F.lit(1)).alias("kinds"))
    groups = counts.filter("term = ''").select("lang", "source").join(of_group, ["lang", "source"], "left").join(of_lang, "lang", "left").fillna(0, ["own", "kinds", "v", "total"])
    groups = ws.save(groups.withColumn("base", share("0", "own")), "groups")
    postings = plain.join(groups, ["lang", "source"]).select("lang", "source", "term", "n", share("n", "own").alias("p"), share("nl", "total").alias("q"), "base")
    postings = ws.save(postings, "postings")
    ws.drop("counts", "kept")
    return groups, postings


def count_buckets(ws: Workspace, postings: DataFrame) -> DataFrame:
    """lang, source, n, p, terms (how many have this count in the group), q_min, q_max."""
    found = postings.groupBy("lang", "source", "n").agg(F.max("p").alias("p"), F.count(F.lit(1)).alias("terms"), F.min("q").alias("q_min"), F.max("q").alias("q_max"))
    return ws.save(found, "buckets")


def top_terms(ws: Workspace, postings: DataFrame, buckets: DataFrame, k: int) -> DataFrame:
    """lang, source, item, value, rank of each group's k terms of greatest f among those of p > q."""
    own = Window.partitionBy("lang", "source")
    open_ = buckets.filter("p > q_min").withColumn("bound", F.expr(spread("p", "q_min"))).withColumn("sure", F.expr("if(q_max < p, terms, 1)"))
    before = F.sum("sure").over(own.orderBy(F.desc("bound"), F.desc("n")).rowsBetween(Window.unboundedPreceding, -1))
    open_ = ws.save(open_.select("lang", "source", "n", "bound", F.coalesce(before, F.lit(0)).alias("before")), "open")
    ranking = own.orderBy(F.desc("value"), "item")
    best, low, high, i = None, 0, k, 0
    while True:
        picked = open_.filter(F.col("before").between(low, high - 1))
        if best is not None:
            picked = _reaching(picked, best, k)
        found = postings.join(picked.select("lang", "source", "n"), ["lang", "source", "n"]).filter("p > q").select("lang", "source", F.col("term").alias("item"), F.expr(spread("p", "q")).alias("value"))
        found = found if best is None else found.unionByName(best.drop("rank"))
        best = ws.save(found.withColumn("rank", F.row_number().over(ranking)).filter(F.col("rank") <= k), f"best-{i}")
        low, high, i = high, high * 16, i + 1
        if not _reaching(open_.filter(F.col("before") >= low), best, k).limit(1).count():
            return best


def _reaching(buckets: DataFrame, best: DataFrame, k: int) -> DataFrame:
    """Those of the buckets whose bound is not below the k-th value that is known of their group."""
    kth = best.filter(F.col("rank") == k).select("lang", "source", F.col("value").alias("kth"))
    return buckets.join(kth, ["lang", "source"], "left").filter("kth is null or bound >= kth").drop("kth")


def source_pairs(postings: DataFrame, buckets: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value, rank for each source of a language and each other one."""
    g = groups.select("lang", F.col("source").alias("a"), F.col("base").alias("base_a"), F.col("kinds").alias("kinds_a"), "v")
    h = groups.select("lang", F.col("source").alias("b"), F.col("base").alias("base_b"), F.col("kinds").alias("kinds_b"))
    absent = g.join(h, "lang").filter("a < b").select("lang", "a", "b", F.expr(f"coalesce((v - kinds_a - kinds_b) * {spread('base_a', 'base_b')}, 0)").alias("value"))
    alone = buckets.join(h, "lang").filter("source <> b").select("lang", F.least("source", "b").alias("a"), F.greatest("source", "b").alias("b"), F.expr(f"terms * {spread('p', 'base_b')}").alias("value"))
    x = postings.select("lang", "term", F.col("source").alias("a"), F.col("p").alias("pa"), F.col("base").alias("base_a"))
    y = postings.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("pb"), F.col("base").alias("base_b"))
    more = F.expr(f"{spread('pa', 'pb')} - {spread('pa', 'base_b')} - {spread('base_a', 'pb')} + {spread('base_a', 'base_b')}")
    both = x.join(y, ["lang", "term"]).filter("a < b").select("lang", "a", "b", more.alias("value"))
    # each part first by itself, so that a few numbers for each pair are exchanged
    parts = [part.groupBy("lang", "a", "b").agg(F.sum("value").alias("value")) for part in (absent, alone, both)]
    sums = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    ways = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    rows = sums.select("lang", "value", ways.alias("w")).select("lang", "w.source", "w.item", "value")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank over ``docs`` (text, lang, source)."""
    ws = Workspace(docs.sparkSession, "divergence")
    groups, postings = shares(ws, docs, min_docs)
    buckets = count_buckets(ws, postings)
    terms = top_terms(ws, postings, buckets, top)
    pairs = source_pairs(postings, buckets, groups)
    columns = [F.col("item"), F.col("value"), F.col("rank").cast("int").alias("rank")]
    return pairs.select("lang", "source", F.lit("pair").alias("part"), *columns).unionByName(terms.select("lang", "source", F.lit("term").alias("part"), *columns))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP12_SQL = rf"""
WITH d AS (SELECT coalesce(text, '') AS t, coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM w GROUP BY ALL),
kept AS (SELECT lang, term, sum(n)::HUGEINT AS nl FROM c GROUP BY ALL HAVING sum(docs) >= {MIN_DOCS}),
g AS (SELECT DISTINCT lang, source FROM d),
k AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0)::HUGEINT AS n, nl FROM g JOIN kept USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
s AS (SELECT *, sum(n) OVER own AS gn, sum(nl) OVER own AS ln, count(*) OVER own AS v FROM k WINDOW own AS (PARTITION BY lang, source)),
p AS (SELECT lang, source, term, n, 1 + {SCALE} * (n + 2) // (gn + 2 * v) AS p, 1 + {SCALE} * (nl + 2) // (ln + 2 * v) AS q FROM s),
f AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value FROM p WHERE n > 0 AND p > q),
o AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
e AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(o.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN o ON o.lang = a.lang AND o.source = a.source AND o.item = b.source),
u AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM f UNION ALL SELECT * FROM e))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM u WHERE part = 'pair' OR rank <= {TOP}
"""
