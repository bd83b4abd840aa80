"""Near-duplicate detection with SetSketch registers over word shingles.

A register is ``floor(1 - log_b x)`` (kept within 0 .. ``TOP``) of the least of exponentially
distributed points that the set's elements draw for it: merging sets is the registers' maximum, and
equal registers are the likelier the more alike two sets are. Points are drawn in ascending order
from each element's own Poisson process, each for a random register, so only those below a bound
that depends on the set's size are made (about m ln m per set, not m per element).

1. Every whole text becomes its set of shingle hashes, a digest of it, and its registers. Texts with
   equal sets are one class from here on; the class is its smallest row.
2. ``BANDS`` bands of ``ROWS`` registers. In each bucket every class is compared with one
   representative, the member of the least hash, so a group of n alike texts costs a small multiple
   of n comparisons and no bucket is expanded into pairs. Buckets go by pre-aggregated minima.
3. A pair's similarity is estimated by the likelihood of its registers (how many are greater, less
   and equal, with both set sizes known); pairs that are implausible at the threshold by more than
   ``DOUBT`` log units are left out, all others are verified on the words of both whole texts.
4. Links give components by alternating star contraction. Buckets that still hold several components
   are then compared across components, so no link between different texts is lost to the choice of
   representatives. Only pairs that share one of their rarest shingles are made, which every pair at
   the threshold does (``prefix_pairs``): a passage that many texts have makes no pairs. All of them
   are verified without an estimate, those that step 3 left out among them.

At similarity 0.8 a pair shares no bucket with probability below 1e-8. Nulls and texts without words
have an empty set and no links. Shingles are told apart, and equal sets found, by 128 bits under keys drawn for the call. Null or repeated ids: see ``common.keyed``. Empty table: no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CHECK_BASE, U64, Keys, Workspace, keyed, mix, run_hashes, schema_columns, secret_keys, signed, text_chunks, word_hashes, words
from .components import connected_components

BASE, SHIFT, TOP = 1.2, 40, 254
BANDS, ROWS = 64, 6
REGISTERS = BANDS * ROWS
DOUBT = 12.0
#: Pairs of one row that one copy of its set serves.
SALTED = 256
#: Sets of at most so many shingles are compared where they share two of their rarest, larger ones where they share one.
SMALL = 60
SKETCH = "rid long, n_shingles long, d1 long, d2 long, registers binary"


def shingle_sets(lanes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text by both lanes, sorted, as (row, hash, the second lane's hash); a text of fewer words than k has its whole sequence."""
    w, check = lanes
    counts = np.diff(first)
    row = np.repeat(np.arange(len(counts)), counts)
    g, check_g = run_hashes(w, k), run_hashes(check, k, CHECK_BASE)
    ends = first[1:][row] if len(row) else first[:0]
    whole = np.flatnonzero(np.arange(len(g)) + k <= ends[: len(g)])
    rows, hashes, checks = [row[whole]], [g[whole]], [check_g[whole]]
    for n in range(1, k):  # short texts
        short = np.flatnonzero(counts == n)
        if len(short):
            rows.append(short)
            at = first[:-1][short]
            hashes.append(run_hashes(w, n)[at] ^ U64(n))
            checks.append(run_hashes(check, n, CHECK_BASE)[at] ^ U64(n))
    rows, hashes, checks = np.concatenate(rows), np.concatenate(hashes), np.concatenate(checks)
    order = np.lexsort((checks, hashes, rows))
    rows, hashes, checks = rows[order], hashes[order], checks[order]
    fresh = np.ones(len(rows), bool)
    fresh[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1]) | (checks[1:] != checks[:-1])
    return rows[fresh], hashes[fresh], checks[fresh]


def shingles_of(text: str, k: int) -> set[tuple]:
    """The shingles themselves."""
    w = text.encode("utf-8", "surrogatepass").lower().split()
    return set(zip(*[w[i:] for i in range(k)])) if len(w) >= k else {tuple(w)} if w else set()


def registers(rows: np.ndarray, hashes: np.ndarray, n_rows: int, m: int = REGISTERS) -> np.ndarray:
    """SetSketch registers (uint8) of each row's set; empty sets have zeros."""
    least = np.full(n_rows * m, np.inf)
    sizes = np.bincount(rows, minlength=n_rows)
    todo = np.flatnonzero(sizes)
    margin = 5.0
    while len(todo):
        bound = np.zeros(n_rows)
        bound[todo] = (math.log(m) + margin) / sizes[todo]
        live = np.flatnonzero(bound[rows] > 0)
        r, seed, x = rows[live], hashes[live], np.zeros(len(live))
        step = 0
        while len(r):
            step += 1
            draw = mix(seed + U64(step * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
            # 40 bits for the gap, 24 for the register
            x = x - np.log(((draw >> U64(24)).astype(np.float64) + 0.5) * 2.0**-40) / m
            keep = x < bound[r]
            r, seed, x, draw = r[keep], seed[keep], x[keep], draw[keep]
            at = r * m + ((draw & U64(0xFFFFFF)).astype(np.int64) * m >> 24)
            np.minimum.at(least, at, x)
        # a register without a point below the bound: draw further for that set
        todo = todo[np.isinf(least.reshape(n_rows, m)[todo]).any(1)]
        margin *= 2
    with np.errstate(divide="ignore"):
        level = np.floor(1 - np.log(least) / math.log(BASE)) + SHIFT
    return np.clip(np.where(np.isfinite(level), level, 0), 0, TOP).astype(np.uint8).reshape(n_rows, m)


def band_keys(regs: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band's registers, bands told apart."""
    cells = regs.reshape(len(regs), BANDS, ROWS).astype(U64)
    key = np.broadcast_to(mix(np.arange(BANDS, dtype=U64) + U64(77)), cells.shape[:2]).copy()
    for i in range(ROWS):
        key = mix(key * U64(0x9E3779B97F4A7C15) + cells[:, :, i] + U64(1))
    return key


def _sets(batch: pa.RecordBatch, k: int, keys: Keys) -> Iterator[tuple[pa.Array, int, np.ndarray, np.ndarray, np.ndarray]]:
    rid, text = schema_columns(batch, "rid", "text")
    for i, j, buf, off in text_chunks(text, 1 << 20):
        starts, ends, first = words(buf, off)
        yield rid.slice(i, j - i), j - i, *shingle_sets(word_hashes(buf, starts, ends, keys, lower=True), first, k)


def sketch(docs: DataFrame, k: int, keys: Keys) -> DataFrame:
    """Size, digest and registers of the shingle set of each whole text of ``docs`` (rid, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rid, n, rows, hashes, checks in _sets(batch, k, keys):
                regs = registers(rows, hashes, n)
                sizes = np.bincount(rows, minlength=n)
                cuts = np.concatenate([[0], np.cumsum(sizes)])
                sums = []
                for lane in (hashes, checks):  # order-free digests: sums of remixed hashes
                    total = np.concatenate([np.zeros(1, U64), np.cumsum(mix(lane + U64(0x632BE59BD9B4E019)), dtype=U64)])
                    sums.append(signed(total[cuts[1:]] - total[cuts[:-1]]))
                yield pa.RecordBatch.from_arrays([rid, pa.array(sizes.astype(np.int64)), pa.array(sums[0]), pa.array(sums[1]), pa.array([x.tobytes() for x in regs], pa.binary())], [c.split()[0] for c in SKETCH.split(", ")])

    return docs.select("rid", "text").mapInArrow(run, SKETCH)


def shingles(docs: DataFrame, k: int, keys: Keys) -> DataFrame:
    """rid and the full set of shingle hashes of ``docs`` (rid, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rid, n, rows, hashes, _ in _sets(batch, k, keys):
                cuts = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n))])
                yield pa.RecordBatch.from_arrays([rid, pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(signed(hashes)))], ["rid", "shingles"])

    return docs.select("rid", "text").mapInArrow(run, "rid long, shingles array<long>")


def band_rows(sketched: DataFrame) -> DataFrame:
    """rid, bucket: a row for each band of each row of ``sketched`` (rid, registers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                rid, regs = schema_columns(part, "rid", "registers")
                keys = band_keys(np.frombuffer(b"".join(regs.to_pylist()), np.uint8).reshape(-1, REGISTERS))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(rid.to_numpy(), BANDS)), pa.array(signed(keys).ravel())], ["rid", "bucket"])

    return sketched.select("rid", "registers").mapInArrow(run, "rid long, bucket long")


def plausible(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, threshold: float) -> np.ndarray:
    """Whether each pair's registers allow the threshold: log-likelihood there against the best one."""
    m = a.shape[1]
    more, less = (a > b).sum(1), (a < b).sum(1)
    same = m - more - less
    u, v = na / (na + nb), nb / (na + nb)
    most = np.minimum(u / v, v / u)

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / math.log(BASE)

    def likelihood(j: np.ndarray) -> np.ndarray:
        up, down = p(u - v * j), p(v - u * j)
        tiny = 1e-12
        return more * np.log(up + tiny) + less * np.log(down + tiny) + same * np.log(np.maximum(1 - up - down, tiny))

    tried = [likelihood(most * f) for f in np.linspace(0, 1, 33)]
    at = np.maximum(likelihood(np.minimum(threshold, most)), np.max([likelihood(threshold + (most - threshold) * f) for f in np.linspace(0, 1, 9)], axis=0))
    return (most >= threshold - 1e-9) & (at >= np.max(tried, axis=0) - DOUBT)


def _estimate(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b, ra, rb, na, nb = schema_columns(batch, "a", "b", "ra", "rb", "na", "nb")
            x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(-1, REGISTERS) for c in (ra, rb))
            ok = plausible(x, y, na.to_numpy().astype(float), nb.to_numpy().astype(float), threshold)
            yield pa.RecordBatch.from_arrays([a.filter(pa.array(ok)), b.filter(pa.array(ok))], ["a", "b"])

    return run


def likely(ws: Workspace, pairs: DataFrame, sketched: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b, salt) whose registers allow the threshold."""
    small = sketched.select("rid", "n_shingles", "registers")
    left = salted_rows(ws, pairs, small.select(F.col("rid").alias("a"), F.col("n_shingles").alias("na"), F.col("registers").alias("ra")))
    right = small.select(F.col("rid").alias("b"), F.col("n_shingles").alias("nb"), F.col("registers").alias("rb"))
    joined = pairs.join(right, "b").join(left, ["a", "salt"]).filter(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
    return joined.select("a", "b", "ra", "rb", "na", "nb").mapInArrow(_estimate(percent / 100), "a long, b long")


def salted(ws: Workspace, pairs: DataFrame, name: str) -> DataFrame:
    """``pairs`` (a, b), written, with a salt by b: as many salts for an a as it has ``SALTED`` pairs."""
    pairs = ws.save(pairs.select("a", "b"), f"plain-{name}")
    counts = pairs.groupBy("a").agg((F.floor(F.count(F.lit(1)) / SALTED) + 1).cast("int").alias("salts")).filter("salts > 1")
    many = ws.save(counts, f"many-{name}")  # few: one a for SALTED pairs at most, so Spark sends them around where they fit
    return pairs.join(many, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("salts", F.lit(1))).cast("int").alias("salt"))


def salted_rows(ws: Workspace, pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` (a and more) for each salt that ``pairs`` has with their a."""
    return pairs.select("a", "salt").distinct().join(rows, "a")


def verify(ws: Workspace, pairs: DataFrame, rows: DataFrame, k: int, percent: int, name: str) -> DataFrame:
    """The linked ones of ``pairs`` (a, b, salt), on the words of both whole texts of ``rows`` (rid, text)."""
    some = pairs.select(F.col("a").alias("rid")).unionByName(pairs.select(F.col("b").alias("rid"))).distinct()
    texts = ws.save(rows.select("rid", "text").join(some.hint("shuffle_hash"), "rid", "left_semi"), f"texts-{name}")
    # the text of a is sent once for each salt (one for SALTED pairs), not once for each pair
    left = salted_rows(ws, pairs, texts.select(F.col("rid").alias("a"), F.col("text").alias("ta")))
    right = pairs.join(texts.select(F.col("rid").alias("b"), F.col("text").alias("tb")).hint("merge"), "b")
    both = right.hint("merge").join(left, ["a", "salt"])
    links = ws.save(both.select("a", "b", "ta", "tb").mapInArrow(_linked(k, percent), "a long, b long"), f"links-{name}")
    ws.drop(f"texts-{name}")
    return links


def _linked(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, x = None, set()
        for batch in batches:
            a, b, ta, tb = schema_columns(batch, "a", "b", "ta", "tb")
            ok = np.zeros(batch.num_rows, bool)
            for i, key in enumerate(a.to_pylist()):
                if key != last:
                    last, x = key, shingles_of(ta[i].as_py(), k)
                y = shingles_of(tb[i].as_py(), k)
                common = len(x & y)
                ok[i] = 100 * common >= percent * (len(x) + len(y) - common)
            yield pa.RecordBatch.from_arrays([a.filter(pa.array(ok)), b.filter(pa.array(ok))], ["a", "b"])

    return run


def prefix_pairs(ws: Workspace, nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of ``nodes`` (rid, label, n: its shingles) of different labels that can reach the threshold: all of them that do.

    A set's shingles stand in the order (rows that have it, hash), rarest first. Two sets of the
    threshold share one of each one's first ``n - ceil(t n) + 1``, and two of one more; from the first shared one on
    enough are left. Shingles of one row alone only count for the places of the others. Two sets of at most
    ``SMALL`` meet by two shingles, so a shingle that many short texts have makes no pairs by itself; others by one.
    A set to which the threshold allows no set but its equal meets it by all of its shingles."""
    each = sets.select("rid", F.explode("shingles").alias("s"))
    shared = ws.save(each.groupBy("s").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"), "shared")
    ranked = each.join(shared, "s").groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("df", "s"))).alias("ranked"))
    ranked = ranked.join(nodes, "rid")
    first = f"n - int(ceil({percent} * n / 100)) - (n - size(ranked))"  # and one for each shingle to share
    own = ranked.select("rid", "label", "n", F.expr(f"transform(slice(ranked, 1, greatest(0, {first} + 1)), x -> x.s)").alias("one"), F.expr(f"transform(slice(ranked, 1, greatest(0, {first} + 2)), x -> x.s)").alias("two"), F.size("ranked").alias("size"), F.expr("xxhash64(transform(ranked, x -> x.s))").alias("all"))
    ones = "transform(one, (s, i) -> struct(size - i as left, s, cast(null as bigint) as t))"
    twos = "flatten(transform(two, (s, i) -> transform(slice(two, i + 2, size(two)), t -> struct(size - i as left, s, t))))"
    none = "cast(array() as array<struct<left:int,s:bigint,t:bigint>>)"
    equal = "if(size = n, array(struct(size as left, `all` as s, cast(n as bigint) as t)), cast(array() as array<struct<left:int,s:bigint,t:bigint>>))"
    keys = F.expr(f"if(100 * n < {percent} * (n + 1), {equal}, concat(if(100 * n >= {percent * SMALL}, {ones}, {none}), if(n <= {SMALL}, {twos}, {none})))")
    prefix = ws.save(own.select("rid", "label", "n", F.inline(keys)), "prefix")
    enough = f"100 * least(x.left, y.left) >= {percent} * (x.n + y.n - least(x.left, y.left))"
    apart = f"x.label <> y.label and x.rid < y.rid and {enough}"
    x, y = prefix.alias("x"), prefix.alias("y")
    by_one = x.filter("t is null").join(y.filter("t is null"), F.expr(f"x.s = y.s and greatest(x.n, y.n) > {SMALL} and {apart}"))
    by_two = x.filter("t is not null").join(y.filter("t is not null"), F.expr(f"x.s = y.s and x.t = y.t and {apart}"))
    return by_one.select(F.col("x.rid").alias("a"), F.col("y.rid").alias("b")).unionByName(by_two.select(F.col("x.rid").alias("a"), F.col("y.rid").alias("b"))).distinct()


def near_duplicates(rows: DataFrame, k: int = 2, percent: int = 80) -> DataFrame:
    """rid, n_shingles and component (a rid) for every one of ``rows`` (rid, text; see ``common.keyed``)."""
    ws = Workspace(rows.sparkSession, "near")
    keys = secret_keys()
    sketched = ws.save(sketch(rows, k, keys), "sketch")
    # classes of equal sets: pre-aggregated by digest, so copies reach a task as partial minima
    classes = ws.save(sketched.filter("n_shingles > 0").groupBy("d1", "d2", "n_shingles").agg(F.min("rid").alias("class")), "classes")
    heads = sketched.join(classes.select(F.col("class").alias("rid")), "rid", "left_semi")
    buckets = band_rows(heads)
    # one representative a bucket: the member with the least draw (a draw for each of two kinds of buckets)
    chosen = buckets.withColumn("draw", F.xxhash64("rid", F.col("bucket").bitwiseAND(1))).groupBy("bucket").agg(F.min_by("rid", "draw").alias("rep"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    chosen = ws.save(chosen.select("bucket", "rep"), "chosen")
    members = ws.save(buckets.join(chosen, "bucket").select("rid", "bucket", "rep"), "members")
    ws.drop("chosen")
    pairs = salted(ws, members.filter("rid <> rep").select(F.least("rid", "rep").alias("a"), F.greatest("rid", "rep").alias("b")).distinct(), "first")
    tested = salted(ws, likely(ws, pairs, heads, percent), "likely")
    links = verify(ws, tested, rows, k, percent, "first")
    labels = connected_components(ws, links, "first")
    # what representatives left open: buckets that hold several components
    tagged = members.select("rid", "bucket").join(labels.withColumnRenamed("node", "rid"), "rid", "left").withColumn("label", F.coalesce("label", "rid"))
    mixed = tagged.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("bucket")
    rest = tagged.join(mixed, "bucket")
    nodes = ws.save(rest.groupBy("rid").agg(F.min("label").alias("label")).join(heads.select("rid", F.col("n_shingles").alias("n")), "rid"), "open")
    ws.drop("members")
    sets = ws.save(shingles(rows.select("rid", "text").join(nodes.select("rid").hint("shuffle_hash"), "rid", "left_semi"), k, keys), "shingles")
    across = prefix_pairs(ws, nodes, sets, percent)
    untested = salted(ws, across.join(tested.select("a", "b"), ["a", "b"], "left_anti"), "rest")
    ws.drop("shingles", "shared", "prefix")
    more = verify(ws, untested, rows, k, percent, "rest")
    if more.limit(1).count():
        labels = connected_components(ws, links.unionByName(more), "second")
    by_class = classes.join(labels.withColumnRenamed("node", "class"), "class", "left").select("d1", "d2", "n_shingles", F.coalesce("label", "class").alias("component"))
    # every row takes its class's component; a hot class is a skewed join that Spark splits
    out = sketched.select("rid", "n_shingles", "d1", "d2").join(by_class, ["d1", "d2", "n_shingles"], "left").select("rid", "n_shingles", F.coalesce("component", "rid").alias("component"))
    return ws.save(out, "result")


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = keyed(Workspace(spark, "op10"), spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return with_doc_ids(rows, near_duplicates(rows))


def with_doc_ids(rows: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (the doc_id of the component's kept row) and kept of ``found`` (see ``near_duplicates``)."""
    kept = F.col("rid") == F.col("component")
    if not rows.filter("not (rid <=> doc_id)").limit(1).count():  # no scan where keyed took rid from doc_id
        return found.select(F.col("rid").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), kept.alias("kept"))
    ids = rows.select("rid", "doc_id")
    named = found.join(ids, "rid").join(ids.select(F.col("rid").alias("component"), F.col("doc_id").alias("component_id")), "component")
    return named.select("doc_id", "n_shingles", "component_id", kept.alias("kept"))
