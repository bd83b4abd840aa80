"""Line dedup: later copies of repeated line runs are deleted, by prefix doubling over line ids.

A line is what stands between line feeds; lines of white space only (``[\\x20\\x09-\\x0D]``) have no
place in the sequence and always stay. Ranks are those of a suffix array's prefixes: at level 0 of a
line's identifier, at level j + 1 of the pair of ranks at a suffix and 2**j lines on. Suffixes of equal
rank at level j are an interval of the array whose longest common prefix is at least 2**j lines; a rank
that one suffix alone has leaves the doubling, as nothing longer can repeat there. Doubling goes on
until no rank repeats. Then the intervals are lengthened by the lower powers of two, from the top
(``maximal_runs``): what is left of each suffix is its longest common prefix with any other, so the
length of the maximal repeated run that begins there.

A line is deleted if it lies in a later copy of a run of ``min_lines`` lines or more (all but the first
suffix of an interval, in the order of row and place, start one; runs of min_lines cover all longer
ones), or is itself a later copy and has ``long_line`` characters: short lines alone ("The end.") stay.
Deletion is judged on the input, so the first copy of every run stays whole.

Counts and firsts are pre-aggregated; joins back to a rank's occurrences are plain equi-joins that
Spark splits where a rank is hot. Lines are equal if 128 bits of their SHA-256 are. Null text: no lines, kept as empty. Ids: ``common.keyed``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import FEW_ROWS, Workspace, keyed, range_ordinals, schema_columns

MIN_LINES, LONG_LINE = 2, 20
NOT_BLANK = r"[^\x20\x09-\x0D]"


def line_table(rows: DataFrame) -> DataFrame:
    """rid, p (place among the lines that are not blank), i (line number), h (128 bits of the line's SHA-256: lines equal in it are taken for equal), chars."""
    kept = F.filter(F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda s: s["x"].rlike(NOT_BLANK))
    lines = rows.select("rid", F.posexplode(kept).alias("p", "s"))
    return lines.select("rid", "p", F.col("s.i").alias("i"), F.substring(F.unhex(F.sha2(F.col("s.x").cast("binary"), 256)), 1, 16).alias("h"), F.length("s.x").alias("chars"))


def ranked(ws: Workspace, suffixes: DataFrame, keys: list[str], name: str, few: bool = False) -> tuple[DataFrame, int]:
    """The suffixes whose keys repeat, with rank (dense, in the order of the keys) and later (not the first of its rank); and their number."""
    # per text first: of one text's copies the first place counts
    once = suffixes.groupBy(*keys, "rid").agg(F.min("p").alias("p"), F.count(F.lit(1)).alias("n"))
    classes = once.groupBy(*keys).agg(F.sum("n").alias("n"), F.min("rid").alias("rid0"), F.min_by("p", "rid").alias("p0")).filter("n > 1").drop("n")
    ranks = range_ordinals(ws, classes, keys, f"ranks-{name}", "rank", few)
    found = suffixes.join(ranks, keys).withColumn("later", ~((F.col("rid") == F.col("rid0")) & (F.col("p") == F.col("p0")))).drop("rid0", "p0", *keys)
    table = ws.save(found, f"level-{name}")
    if not few:
        ws.drop(f"ranks-{name}")
    n = table.count()
    return (table.coalesce(1) if n <= FEW_ROWS else table), n


def pairs_of(level: DataFrame, step: int) -> DataFrame:
    """rid, p, r1, r2: each suffix of a level with its rank and that of the suffix ``step`` lines on."""
    shifted = level.select("rid", (F.col("p") - step).alias("p"), F.col("rank").alias("r2"))
    return level.select("rid", "p", F.col("rank").alias("r1")).join(shifted, ["rid", "p"])


def maximal_runs(ws: Workspace, levels: list[DataFrame]) -> DataFrame:
    """rid, p, run: the longest run that begins at each suffix of ``levels`` (widths 1, 2, 4, ...) and is elsewhere too.

    From the top level down, intervals of each width (``held``: rid, p, c for the interval, width) are cut by
    the next lower power's rank behind them. Parts of several suffixes are longer intervals. While some suffix is in
    none of these, the interval itself is held on, by that one and by the first suffix of each longer part: it
    stands for all of its part, which are equal beyond what the others can share. So of the suffixes that doubling leaves
    at a level a number in proportion is held, as of a tree's branches, and of all others one for each class."""
    held = None
    for j in range(len(levels) - 1, 0, -1):
        whole = levels[j]
        if j + 1 < len(levels):  # of the suffixes that doubling took on the first of each class
            whole = whole.join(levels[j + 1].filter("later").select("rid", "p"), ["rid", "p"], "left_anti")
        whole = whole.select("rid", "p", F.concat_ws("/", F.lit(str(j)), F.col("rank").cast("string")).alias("c"), F.lit(1 << j).alias("width"))
        if held is not None:
            tried = _tried(held, levels[j])
            sizes = tried.groupBy("c", "r").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("rid", "p")).alias("first")).withColumn("more", F.col("r").isNotNull() & (F.col("n") > 1))
            told = tried.join(sizes.filter("more").select("c", "r", "more", "first"), ["c", "r"], "left").join(sizes.groupBy("c").agg(F.max(~F.col("more")).alias("stuck")), "c")
            stays = F.col("stuck") & (F.col("more").isNull() | ((F.col("first.rid") == F.col("rid")) & (F.col("first.p") == F.col("p"))))
            kinds = F.explode(F.filter(F.array(F.when(F.col("more"), F.lit(1)), F.when(stays, F.lit(0))), lambda x: x.isNotNull()))
            told = told.withColumn("on", kinds).select("rid", "p", F.when(F.col("on") == 1, F.concat_ws("/", "c", F.lit(str(j)), F.col("r").cast("string"))).otherwise(F.col("c")).alias("c"), (F.col("width") + F.col("on") * (1 << j)).alias("width"))
            # intervals of which doubling took every suffix on are not held here
            open_ = whole.join(levels[j + 1], ["rid", "p"], "left_anti").select("c").distinct()
            whole = told.unionByName(whole.join(open_, "c", "left_semi").select("rid", "p", "c", "width"))
        # the name of an interval: 128 bits for its path of ranks
        held = ws.save(whole.select("rid", "p", F.md5(F.col("c").cast("binary")).alias("c"), "width"), f"held-{j}")
        held = held.coalesce(1) if held.count() <= FEW_ROWS else held
    runs = levels[0].select("rid", "p", F.lit(1).alias("run"))
    if held is not None:
        tried = _tried(held, levels[0])
        more = tried.filter("r is not null").groupBy("c", "r").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("c", "r", F.lit(1).alias("more"))
        runs = runs.unionByName(tried.join(more, ["c", "r"], "left").select("rid", "p", (F.col("width") + F.coalesce("more", F.lit(0))).alias("run")))
    return runs.groupBy("rid", "p").agg(F.max("run").alias("run"))


def _tried(held: DataFrame, level: DataFrame) -> DataFrame:
    """``held`` with r: the level's rank behind each interval's suffix, if it has one there."""
    behind = level.select("rid", F.col("p").alias("at"), F.col("rank").alias("r"))
    return held.withColumn("at", F.col("p") + F.col("width")).join(behind, ["rid", "at"], "left").drop("at")


def repeated_lines(rows: DataFrame, min_lines: int = MIN_LINES, long_line: int = LONG_LINE, report_runs: bool = False) -> DataFrame:
    """rid, deleted (line numbers) of every row with deleted lines; with report_runs also longest_run: lines
    of the longest run in the row that is elsewhere too (in it or in another), for every row that has one."""
    ws = Workspace(rows.sparkSession, "lines")
    first, n = ranked(ws, line_table(rows), ["h"], "0")
    places = first.select("rid", "p", "i")
    gone = first.filter((F.col("chars") >= long_line) | F.lit(min_lines <= 1)).filter("later").select("rid", "i")
    levels, most = [first.select("rid", "p", "rank", "later")], min_lines.bit_length() - 1
    while n and (report_runs or len(levels) <= most):
        level, n = ranked(ws, pairs_of(levels[-1], 1 << (len(levels) - 1)), ["r1", "r2"], str(len(levels)), n <= FEW_ROWS)
        levels += [level] * (n > 0)
    if 0 < most < len(levels):
        exact = levels[most]
        if step := min_lines - (1 << most):  # two overlapping runs of the power of two below
            exact = ranked(ws, pairs_of(exact, step), ["r1", "r2"], "exact")[0]
        covered = exact.filter("later").select("rid", F.explode(F.sequence("p", F.col("p") + (min_lines - 1))).alias("p")).distinct()
        gone = gone.unionByName(covered.join(places, ["rid", "p"]).select("rid", "i"))
    out = gone.groupBy("rid").agg(F.collect_set("i").alias("deleted"))
    if report_runs:
        out = maximal_runs(ws, levels).groupBy("rid").agg(F.max("run").alias("longest_run")).join(out, "rid", "full")
    return ws.save(out, "deleted")


def _apply(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        white = " \t\n\x0b\x0c\r"
        for batch in batches:
            text, deleted = schema_columns(batch, "text", "deleted")
            total, removed, kept = [], [], []
            for t, d in zip(text.to_pylist(), deleted.to_pylist(), strict=True):
                lines = t.split("\n")
                gone = set(d or ())
                total.append(sum(1 for x in lines if x.strip(white)))
                removed.append(len(gone))
                kept.append("\n".join([x for i, x in enumerate(lines) if i not in gone]) if gone else t)
            made = {"n_lines": pa.array(total, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_text": pa.array(kept, pa.string())}
            yield pa.RecordBatch.from_arrays([made[c] if c in made else batch.column(batch.schema.get_field_index(c)) for c in names], names)

    return run


def remove_lines(rows: DataFrame, min_lines: int = MIN_LINES, long_line: int = LONG_LINE, report_runs: bool = False) -> DataFrame:
    """n_lines (not blank), n_removed, kept_text (with report_runs also longest_run) for every one of ``rows`` (rid, text), with all its columns but text."""
    found = repeated_lines(rows, min_lines, long_line, report_runs)
    marked = rows.join(found.hint("shuffle_hash"), "rid", "left")
    kept = [f for f in rows.schema.fields if f.name != "text"]
    if report_runs:
        marked = marked.withColumn("longest_run", F.coalesce("longest_run", F.lit(0)).cast("long"))
        kept.append(StructField("longest_run", LongType()))
    schema = StructType([*kept, StructField("n_lines", LongType()), StructField("n_removed", LongType()), StructField("kept_text", StringType())])
    return marked.mapInArrow(_apply(schema.names), schema)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_lines(keyed(Workspace(spark, "op9"), spark.read.parquet(f"{sf_dir}/documents.parquet")), report_runs=True)
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"), "longest_run")


OP9_SQL = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
x AS (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS i FROM d),
y AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS p FROM x WHERE regexp_matches(line, '{NOT_BLANK}')),
z AS (SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY p) AS after, lead(p) OVER (PARTITION BY doc_id ORDER BY p) AS p2 FROM y),
r AS (SELECT *, row_number() OVER (PARTITION BY line ORDER BY doc_id, p) > 1 AS one,
      p2 IS NOT NULL AND row_number() OVER (PARTITION BY line, after, p2 IS NULL ORDER BY doc_id, p) > 1 AS two FROM z),
g AS (SELECT doc_id, i, (one AND length(line) >= {LONG_LINE}) OR two OR coalesce(lag(two) OVER (PARTITION BY doc_id ORDER BY p), false) AS gone FROM r),
k AS (SELECT x.doc_id, count(g.i) AS n_lines, coalesce(sum(CAST(g.gone AS INT)), 0) AS n_removed,
      coalesce(string_agg(x.line, chr(10) ORDER BY x.i) FILTER (WHERE NOT coalesce(g.gone, false)), '') AS kept
      FROM x LEFT JOIN g ON x.doc_id = g.doc_id AND x.i = g.i GROUP BY x.doc_id),
e AS (SELECT a.doc_id AS da, b.doc_id AS db, a.p - b.p AS apart, a.p AS p FROM y a JOIN y b ON a.line = b.line AND (a.doc_id <> b.doc_id OR a.p <> b.p)),
m AS (SELECT *, p - row_number() OVER (PARTITION BY da, db, apart ORDER BY p) AS island FROM e),
w AS (SELECT da, max(n) AS longest_run FROM (SELECT da, count(*) AS n FROM m GROUP BY da, db, apart, island) GROUP BY da)
SELECT doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_removed AS BIGINT) AS n_removed, sha256(kept) AS kept_sha256, CAST(coalesce(longest_run, 0) AS BIGINT) AS longest_run FROM k LEFT JOIN w ON w.da = k.doc_id
"""
