"""Merkle manifest of a table: a leaf hash for each row, a tree of eight-way nodes for each language, one root over all.

``H`` is the lowercase hex SHA-256 of its inputs in a row, digests as hex text. A leaf is H of the fields
``doc_id, source, lang, n_chars, text``, each ``-`` where null, else its UTF-8 length, a colon and its value.

1. Leaves are hashed beside the text in the JVM; from there on only digests move. Rows are put in the order
   (lang, doc_id, leaf), nulls first, by a range sort, and numbered within their language by the counts of
   (partition, language) runs, so no language is gathered in one task.
2. ``BUCKET`` consecutive leaves (a power of eight, so a bucket is a whole subtree) make one row of arrays.
   Executors run the levels inside buckets as DuckDB queries on Arrow batches: ``string_agg`` in order, ``sha256``.
3. Spark combines the bucket roots level by level to subroots and those, ordered by language, to the root. Each
   node's siblings go down again: a node's outer proof is its own siblings and its parent's outer proof.
4. Outer proofs are joined to the buckets, and the executors complete each leaf's proof and fold a given leaf
   (``altered``, or the leaf itself) with the original siblings to a root.

Null ids and repeated ids have their place by leaf; rows that are equal in all five fields have equal leaves,
and their order is of no consequence. A null language is a tree of its own, the first. Null and empty texts
differ (``-`` and ``0:``). An empty table has no rows and no root. Further columns are no part of a leaf.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Workspace, range_ordinals

FAN, LEVELS = 8, 4
BUCKET = FAN**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Leaves that one DuckDB pass holds.
PASS = 65_536
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LEAVES = "array<struct<i:long,doc_id:long,leaf:string,altered:string>>"


def leaf_hash(**fields: Column) -> Column:
    """H of a row's fields, in the order of ``FIELDS``."""
    parts = []
    for name in FIELDS:
        value = fields[name].cast("string")
        parts.append(F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaves(docs: DataFrame, altered_text: Column | None = None) -> DataFrame:
    """tree (the language: empty for null, else = and its name), doc_id, leaf, altered (the leaf of ``altered_text`` where that is another text)."""
    own = {c: F.col(f"`{c}`") for c in FIELDS}
    other = F.lit(None).cast("string")
    if altered_text is not None:
        other = F.when(altered_text != own["text"], leaf_hash(**own | {"text": altered_text}))
    tree = F.coalesce(F.concat(F.lit("="), own["lang"]), F.lit(""))
    return docs.select(tree.alias("tree"), own["doc_id"].cast("long").alias("doc_id"), leaf_hash(**own).alias("leaf"), other.alias("altered"))


def numbered(ws: Workspace, rows: DataFrame) -> DataFrame:
    """``rows`` with i (place in its tree by doc_id and leaf) and size (leaves of the tree)."""
    keys = [F.col(c).asc_nulls_first() for c in ("tree", "doc_id", "leaf")]
    # digests are written first: the range sort's sample then reads them and not the texts
    ordered = ws.save(rows, "hashed").repartitionByRange(*keys).sortWithinPartitions(*keys)
    table = ws.save(ordered.withColumn("m", F.monotonically_increasing_id()), "ordered").withColumn("part", F.shiftright("m", 33))
    ws.drop("hashed")
    runs = table.groupBy("part", "tree").agg(F.count(F.lit(1)).alias("n"), F.min("m").alias("first"))
    tree = Window.partitionBy("tree")  # a row for each partition that the tree lies in
    runs = runs.select("part", "tree", "first", (F.sum("n").over(tree.orderBy("part")) - F.col("n")).alias("before"), F.sum("n").over(tree).alias("size"))
    return table.join(runs, ["part", "tree"]).select("tree", "size", (F.col("before") + F.col("m") - F.col("first")).alias("i"), "doc_id", "leaf", "altered")


def depth(size: Column, most: int) -> Column:
    """Levels above ``size`` nodes until one remains, at most ``most``."""
    out = F.lit(most)
    for level in reversed(range(most)):
        out = F.when(size <= FAN**level, level).otherwise(out)
    return out


# ---------------------------------------------------------------- inside buckets: DuckDB on Arrow batches
def _engine():
    import duckdb

    db = duckdb.connect(config={"threads": 1, "memory_limit": "512MB", "temp_directory": ""})
    db.execute("SET preserve_insertion_order = false")
    return db


def _nodes(db, part: pa.Table) -> int:
    """Tables n0, n1, ... (b, i, h, levels): the nodes of each level of the buckets of ``part``; how many levels there are."""
    db.register("buckets", part)
    db.execute("CREATE OR REPLACE TEMP TABLE n0 AS SELECT b, e.i AS i, e.leaf AS h, levels FROM (SELECT b, levels, unnest(leaves) AS e FROM buckets)")
    top = max(part.column("levels").to_pylist(), default=0)
    for j in range(top):
        db.execute(f"""CREATE OR REPLACE TEMP TABLE n{j + 1} AS
            SELECT b, i // {FAN} AS i, sha256(string_agg(h, '' ORDER BY i)) AS h, levels FROM n{j} WHERE levels > {j} GROUP BY b, i // {FAN}, levels
            UNION ALL SELECT b, i, h, levels FROM n{j} WHERE levels <= {j}""")
    return top


def _passes(batch: pa.RecordBatch) -> Iterator[pa.Table]:
    """The buckets of a batch, numbered b, in parts of at most ``PASS`` leaves (a bucket at least)."""
    table = pa.Table.from_batches([batch]).append_column("b", pa.array(range(batch.num_rows), pa.int32()))
    sizes, start, held = batch.column(batch.schema.get_field_index("leaves")).value_lengths().to_pylist(), 0, 0
    for at, size in enumerate(sizes):
        if held and held + size > PASS:
            yield table.slice(start, at - start)
            start, held = at, 0
        held += size
    if start < len(sizes):
        yield table.slice(start)


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    db = _engine()
    for batch in batches:
        for part in _passes(batch):
            top = _nodes(db, part)
            found = db.sql(f"SELECT tree, bucket, size, levels, leaves, h AS root FROM buckets JOIN n{top} USING (b, levels)").to_arrow_table()
            yield from found.cast(pa.schema([*(part.schema.field(c) for c in ("tree", "bucket", "size", "levels", "leaves")), pa.field("root", pa.string())])).to_batches()


def _folds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each leaf's siblings (``proof``) and the fold of its altered hash (``cur``), level by level, then through the outer proof."""
    db = _engine()
    for batch in batches:
        for part in _passes(batch):
            top = _nodes(db, part)
            db.execute("CREATE OR REPLACE TEMP TABLE f AS SELECT b, e.i AS i, e.doc_id AS doc_id, e.leaf AS leaf, coalesce(e.altered, e.leaf) AS cur, '' AS proof FROM (SELECT b, unnest(leaves) AS e FROM buckets)")
            for j in range(top):
                run = f"OVER (PARTITION BY b, i // {FAN} ORDER BY i ROWS BETWEEN"
                db.execute(f"""CREATE OR REPLACE TEMP TABLE f AS
                    WITH s AS (SELECT b, i AS k, coalesce(string_agg(h, '') {run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
                               coalesce(string_agg(h, '') {run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM n{j} WHERE levels > {j})
                    SELECT f.b, f.i, doc_id, leaf, CASE WHEN l IS NULL THEN cur ELSE sha256(l || cur || r) END AS cur, proof || coalesce(l || r, '') AS proof
                    FROM f LEFT JOIN s ON f.b = s.b AND f.i // {FAN**j} = s.k""")
            for j in range(1, max(part.column("outer").combine_chunks().value_lengths().to_pylist(), default=0) + 1):
                db.execute(f"""CREATE OR REPLACE TEMP TABLE f AS
                    SELECT f.b, i, doc_id, leaf, CASE WHEN len("outer") < {j} THEN cur ELSE sha256("outer"[{j}].l || cur || "outer"[{j}].r) END AS cur,
                           proof || CASE WHEN len("outer") < {j} THEN '' ELSE "outer"[{j}].l || "outer"[{j}].r END AS proof
                    FROM f JOIN buckets USING (b)""")
            found = db.sql("SELECT doc_id, leaf, subroot, top AS root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = top AS verified FROM f JOIN buckets USING (b)").to_arrow_table()
            kinds = [pa.int64(), *[pa.string()] * 5, pa.bool_()]
            yield from found.cast(pa.schema([pa.field(n, k) for n, k in zip(found.column_names, kinds, strict=True)])).to_batches()


# ---------------------------------------------------------------- outside buckets: Spark
def outer_proofs(ws: Workspace, nodes: DataFrame, name: str) -> DataFrame:
    """tree, pos, top (the tree's last node) and outer (l, r: siblings to the left and right, upwards) of ``nodes`` (tree, pos, h, n: nodes of the tree)."""
    level, runs, tops = ws.save(nodes, f"{name}-0"), [], []
    most = level.agg(F.max("n")).first()[0] or 0
    while True:
        tops.append(level.filter("n = 1").select("tree", "pos", F.col("h").alias("top"), F.expr("cast(array() as array<struct<l:string,r:string>>)").alias("outer")))
        if most <= 1:
            break
        up = level.filter("n > 1").groupBy("tree", "n", F.expr(f"pos div {FAN}").alias("up")).agg(F.sort_array(F.collect_list(F.struct("pos", "h"))).alias("run"))  # at most FAN nodes
        runs.append(ws.save(up, f"{name}-runs-{len(runs)}"))
        level = runs[-1].select("tree", F.col("up").alias("pos"), F.sha2(F.array_join("run.h", "").cast("binary"), 256).alias("h"), F.expr(f"(n + {FAN - 1}) div {FAN}").alias("n"))
        most = -(-most // FAN)
    found = tops.pop()
    while runs:
        each = runs.pop().select("tree", "up", F.col("run.h").alias("h"), F.posexplode("run").alias("at", "x"))
        sides = F.struct(F.array_join(F.slice("h", F.lit(1), F.col("at")), "").alias("l"), F.array_join(F.slice("h", F.col("at") + 2, F.lit(FAN)), "").alias("r"))
        each = each.select("tree", "up", F.col("x.pos").alias("pos"), sides.alias("own"))
        below = each.join(found.select("tree", F.col("pos").alias("up"), "top", "outer"), ["tree", "up"])
        found = below.select("tree", "pos", "top", F.concat(F.array("own"), "outer").alias("outer")).unionByName(tops.pop())
    return ws.save(found, f"{name}-outer")


def manifest(docs: DataFrame, altered_text: Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row of ``docs``.

    ``altered_text`` is a text to test against the manifest; where it differs, the leaf it makes is folded in place of the original one."""
    ws = Workspace(docs.sparkSession, "merkle")
    rows = numbered(ws, leaves(docs, altered_text))
    entry = F.struct((F.col("i") % BUCKET).alias("i"), "doc_id", "leaf", "altered")
    buckets = rows.groupBy("tree", F.expr(f"i div {BUCKET}").alias("bucket"), "size").agg(F.sort_array(F.collect_list(entry)).alias("leaves"))  # BUCKET entries at most
    buckets = buckets.select("tree", "bucket", "size", depth(F.col("size"), LEVELS).alias("levels"), "leaves")
    buckets = ws.save(buckets.mapInArrow(_roots, f"tree string, bucket long, size long, levels int, leaves {_LEAVES}, root string"), "buckets")
    ws.drop("ordered")
    inner = outer_proofs(ws, buckets.select("tree", F.col("bucket").alias("pos"), F.col("root").alias("h"), F.expr(f"(size + {BUCKET - 1}) div {BUCKET}").alias("n")), "tree")
    subroots = ws.save(inner.filter("pos = 0").select("tree", "top"), "subroots")
    count = subroots.count()
    across = range_ordinals(ws, subroots, ["tree"], "trees", "pos").select(F.lit("").alias("tree"), "pos", F.col("top").alias("h"), F.lit(count).cast("long").alias("n"), F.col("tree").alias("name"))
    across = ws.save(across, "across")
    whole = _rooted(ws, across)
    proofs = inner.join(whole, "tree").select("tree", F.col("pos").alias("bucket"), F.col("top").alias("subroot"), "root", F.concat("outer", "above").alias("outer"))
    proofs = ws.save(proofs.withColumnRenamed("root", "top"), "proofs")
    joined = buckets.select("tree", "bucket", "levels", "leaves").join(proofs, ["tree", "bucket"])
    return joined.mapInArrow(_folds, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def _rooted(ws: Workspace, across: DataFrame) -> DataFrame:
    """tree, root, above (the outer proof of the tree's subroot) of every subroot of ``across`` (tree, pos, h, n, name)."""
    found = outer_proofs(ws, across.drop("name"), "root").select("pos", F.col("top").alias("root"), F.col("outer").alias("above"))
    return across.select("pos", F.col("name").alias("tree")).join(found, "pos").drop("pos")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of ``documents``; where 3 divides the CRC-32 of the decimal id, a text with its A-Z lower-cased is tested against it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return manifest(docs, F.when(tampered, F.translate("text", UPPER, LOWER)).otherwise(F.col("text")))


def _sql(levels: int = 8, across: int = 3) -> str:
    """The same in DuckDB, for up to 8**levels rows a language and 8**across languages."""

    def field(c: str) -> str:
        return f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR) END"

    head = " || ".join(field(c) for c in FIELDS[:-1])
    out = [
        "bytes AS (SELECT list(v ORDER BY k) AS t FROM (SELECT k, list_reduce(list_prepend(k, range(8)), lambda c, x: xor(c >> 1, (c & 1) * 3988292384)) AS v FROM (SELECT unnest(range(256)) AS k)))",
        "d AS (SELECT documents.*, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]))) AS crc FROM documents, bytes)",
        f"x AS (SELECT *, {head} AS head, CASE WHEN crc % 3 = 0 THEN translate(text, '{UPPER}', '{LOWER}') ELSE text END AS other FROM d)",
        f"y AS (SELECT doc_id, lang, sha256(head || {field('text')}) AS leaf, sha256(head || {field('other')}) AS altered FROM x)",
        "f0 AS (SELECT doc_id, leaf, altered AS cur, '' AS proof, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS t, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM y)",
        "n0 AS (SELECT t, i, leaf AS h, count(*) OVER (PARTITION BY t) AS n FROM f0)",
    ]
    run = "OVER (PARTITION BY t, i // 8 ORDER BY i ROWS BETWEEN"
    for j in range(levels + across):
        if j == levels:  # from here the nodes are the languages' subroots, in one tree
            out.append(f"sub AS (SELECT t, h AS subroot FROM n{j})")
            out.append(f"m{j} AS (SELECT 0 AS t, t AS i, h, count(*) OVER () AS n FROM n{j})")
        nodes = f"m{j}" if j == levels else f"n{j}"
        at = f"f.t = s.t AND f.i // {8**j} = s.i" if j < levels else f"f.t // {8 ** (j - levels)} = s.i"
        out.append(f"n{j + 1} AS (SELECT t, i // 8 AS i, CASE WHEN n > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE any_value(h) END AS h, (n + 7) // 8 AS n FROM {nodes} GROUP BY t, i // 8, n)")
        out.append(f"s{j} AS (SELECT t, i, coalesce(string_agg(h, '') {run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(h, '') {run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {nodes} WHERE n > 1)")
        out.append(f"f{j + 1} AS (SELECT f.doc_id, f.leaf, f.t, f.i, CASE WHEN l IS NULL THEN cur ELSE sha256(l || cur || r) END AS cur, proof || coalesce(l || r, '') AS proof FROM f{j} f LEFT JOIN s{j} s ON {at})")
    last = levels + across
    return f"WITH {', '.join(out)} SELECT doc_id, leaf, subroot, n{last}.h AS root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = n{last}.h AS verified FROM f{last} JOIN sub USING (t), n{last}"


OP13_SQL = _sql()
