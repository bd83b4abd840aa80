"""Chat formatting: tool calls linked to their results, in topological order, as canonical JSON.

DataFrame functions only. ``link`` takes calls (conv_id, call_id, turn, name, arguments as JSON
text), results (conv_id, call_id, turn, content) and needs (conv_id, call_id, needs: a call that must
come first), and gives one row per call and per result without a call:

- ``status``: ok; unknown_tool; bad_json (arguments that are no JSON object); bad_arguments (a
  required field is missing, null, of another type, or shorter than its least length); no_result;
  early_result (the result's turn is not after the call's); unordered (the call needs one that does
  not exist, or is in a circle); orphan_result. The first that applies, in the order unordered,
  unknown_tool, bad_json, bad_arguments, no_result, early_result, ok.
- ``level`` and ``ready``: the call's depth, and the least turn at which it and all it needs are
  due. Ascending (ready, level, turn, call_id) is a topological order, close to the turns' order. Null
  for unordered calls and orphans.
- ``message``: {"arguments", "call_id", "name", "result"} with sorted keys, no blanks, nulls as null;
  arguments that are JSON have their keys sorted at every depth, others are kept as a string.

Ids that repeat: of several results of one call the earliest turn's (then the least content) counts; of
several needs each counts once; every call row keeps a row of its own. Null ids link with nothing.
Empty tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Workspace

BLOCK_TURNS = 1024
#: name -> field -> (type as schema_of_variant names it, required, least length of a string)
SCHEMAS: dict[str, dict[str, tuple[str, bool, int]]] = {
    "configure": {"text": ("STRING", True, 1)},
    "reply": {"text": ("STRING", True, 1), "turn": ("BIGINT", True, 0)},
}


def valid(arguments: "F.Column", name: "F.Column", schemas: dict) -> "F.Column":
    """Whether the arguments (a variant) have what the schema of ``name`` asks for; null for an unknown name."""
    out = F.lit(None).cast("boolean")
    for tool, fields in schemas.items():
        ok = F.lit(True)
        for field, (kind, required, least) in fields.items():
            value = F.try_variant_get(arguments, f"$.{field}", "string")
            found = F.schema_of_variant(F.try_variant_get(arguments, f"$.{field}", "variant"))
            good = (found == kind) & (F.length(value) >= least)
            ok = ok & F.coalesce(good if required else value.isNull() | good, F.lit(False))
        out = F.when(name == tool, ok).otherwise(out)
    return out


#: Levels that are found one by one before chains are contracted.
PLAIN_ROUNDS = 8
IDS = ["conv_id", "call_id"]


def levels(ws: Workspace, calls: DataFrame, needs: DataFrame) -> DataFrame:
    """conv_id, call_id, level, ready of every call that can be ordered.

    The first ``PLAIN_ROUNDS`` levels come one a round, by joins; a round looks only at calls that need one of the level
    before. What is then left is contracted (see ``deeper``)."""
    nodes = calls.filter("conv_id is not null and call_id is not null").groupBy(*IDS).agg(F.min("turn").alias("turn"))
    edges = needs.filter("conv_id is not null and call_id is not null and needs is not null").select(*IDS, "needs").distinct()
    first = nodes.join(edges, IDS, "left_anti").select(*IDS, F.lit(0).alias("level"), F.col("turn").alias("ready"))
    if not edges.limit(1).count():
        return first
    edges = ws.save(edges, "edges")
    left = ws.save(nodes.join(edges, IDS, "left_semi"), "left")
    done, deep = _rounds(ws, first, edges.select(*IDS, "needs", F.lit(-1).alias("a"), F.lit(0).alias("n"), F.lit(None).cast("long").alias("r")), left.select(*IDS, F.lit(0).alias("a"), F.col("turn").alias("r")), "levels", PLAIN_ROUNDS)
    return done.unionByName(deeper(ws, done, edges, left)) if deep else done


def _rounds(ws: Workspace, first: DataFrame, edges: DataFrame, left: DataFrame, name: str, most: int | None = None) -> tuple[DataFrame, bool]:
    """The levels of ``left`` (with a and r, what they are at least) that follow from ``first``, and whether there may be more than ``most`` rounds found.

    An edge hands on its need's level plus n, at least a, and its ready turn, at least r."""
    found = [ws.save(first, f"{name}-0")]
    for i in itertools.count(1):
        done = ws.spark.read.schema(found[0].schema).parquet(*[ws.path(f"{name}-{j}") for j in range(i)])
        if i - 1 == most:
            return done, True
        near = edges.join(found[-1].select("conv_id", F.col("call_id").alias("needs")), ["conv_id", "needs"], "left_semi").select(*IDS).distinct()
        from_ = done.select("conv_id", F.col("call_id").alias("needs"), F.col("level").alias("l0"), F.col("ready").alias("r0"))
        told = edges.join(near, IDS, "left_semi").join(from_, ["conv_id", "needs"], "left").withColumn("l", F.when(F.col("l0").isNotNull(), F.greatest("a", F.col("l0") + F.col("n"))))
        state = told.groupBy(*IDS).agg(F.max("l").alias("l"), F.max(F.greatest("r", "r0")).alias("r1"), F.max(F.col("l").isNull()).alias("open"))
        due = state.filter("not open").join(left, IDS).select(*IDS, F.greatest("a", F.col("l") + 1).alias("level"), F.greatest("r", "r1").alias("ready"))
        found.append(ws.save(due, f"{name}-{i}"))
        if not found[-1].limit(1).count():
            return done, False


def deeper(ws: Workspace, done: DataFrame, edges: DataFrame, left: DataFrame) -> DataFrame:
    """Levels beyond ``done``. A call with one open need hangs on it; such chains are doubled (each call points to the end of what it points to), so a chain
    of m calls takes about log2 m joins. What is left, calls with several open needs, is ordered round by round over the chains' ends. Calls in circles, or
    that need one that isn't there, are in no row."""
    open_ = ws.save(left.join(done, IDS, "left_anti"), "open")
    by_need = done.select("conv_id", F.col("call_id").alias("needs"), "level", "ready")
    is_open = open_.select("conv_id", F.col("call_id").alias("needs"), F.lit(True).alias("waits"))
    told = edges.join(open_.select(*IDS), IDS, "left_semi").join(by_need, ["conv_id", "needs"], "left").join(is_open, ["conv_id", "needs"], "left")
    told = ws.save(told, "told")
    state = told.groupBy(*IDS).agg(F.max("level").alias("l"), F.max("ready").alias("r"), F.count("waits").alias("open"), F.max(F.when(F.col("waits"), F.col("needs"))).alias("to"), F.max(F.col("level").isNull() & F.col("waits").isNull()).alias("missing"))
    live = state.filter("not missing").join(open_, IDS).select(*IDS, F.coalesce(F.col("l") + 1, F.lit(0)).alias("a"), F.greatest("turn", "r").alias("r"), "open", "to")
    live = ws.save(live, "live")
    hop = ws.save(live.filter("open = 1").select(*IDS, "to", "a", F.lit(1).alias("n"), "r"), "hop-0")
    for i in range(1, hop.count().bit_length() + 1):
        y = hop.select("conv_id", F.col("call_id").alias("to"), F.col("to").alias("to2"), F.col("a").alias("a2"), F.col("n").alias("n2"), F.col("r").alias("r2"))
        told_on = hop.join(y, ["conv_id", "to"], "left")
        moved = told_on.select(*IDS, F.coalesce("to2", "to").alias("to"), F.greatest("a", F.col("a2") + F.col("n")).alias("a"), (F.col("n") + F.coalesce("n2", F.lit(0))).alias("n"), F.greatest("r", "r2").alias("r"))
        hop = ws.save(moved, f"hop-{i}")
        ws.drop(f"hop-{i - 1}")
        if not hop.join(hop.select("conv_id", F.col("call_id").alias("to")), ["conv_id", "to"], "left_semi").limit(1).count():
            break
    chains = ws.save(hop.join(hop.select("conv_id", F.col("call_id").alias("to")), ["conv_id", "to"], "left_anti"), "chains")
    ends = chains.select("conv_id", F.col("call_id").alias("needs"), "to", F.col("a").alias("ca"), F.col("n").alias("cn"), F.col("r").alias("cr"))
    several = told.filter("waits").join(live.filter("open > 1").select(*IDS), IDS, "left_semi").select(*IDS, "needs").join(ends, ["conv_id", "needs"], "left")
    several = several.select(*IDS, F.coalesce("to", "needs").alias("needs"), F.coalesce("ca", F.lit(-1)).alias("a"), F.coalesce("cn", F.lit(0)).alias("n"), F.col("cr").alias("r"))
    # a call can be needed through several chains that end in one: each hands on its own
    first = live.filter("open = 0").select(*IDS, F.col("a").alias("level"), F.col("r").alias("ready"))
    heads, _ = _rounds(ws, first, ws.save(several, "several"), live.filter("open > 1").select(*IDS, "a", "r"), "heads")
    at = heads.select("conv_id", F.col("call_id").alias("to"), "level", "ready")
    hung = chains.join(at, ["conv_id", "to"]).select(*IDS, F.greatest("a", F.col("level") + F.col("n")).alias("level"), F.greatest("r", "ready").alias("ready"))
    return heads.unionByName(hung)


def link(ws: Workspace, calls: DataFrame, results: DataFrame, needs: DataFrame, schemas: dict = SCHEMAS) -> DataFrame:
    ids = IDS
    calls = calls.select(*ids, "turn", "name", "arguments")
    got = results.groupBy(*ids).agg(F.min(F.struct("turn", "content")).alias("r")).select(*ids, F.col("r.turn").alias("result_turn"), F.col("r.content").alias("content"), F.lit(True).alias("has"))
    linked = calls.join(got, ids, "left").join(levels(ws, calls, needs), ids, "left")
    parsed = F.try_parse_json("arguments")
    is_object = F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))
    known = F.col("name").isin(*schemas)
    status = (
        F.when(F.col("level").isNull(), "unordered")
        .when(~F.coalesce(known, F.lit(False)), "unknown_tool")
        .when(~is_object, "bad_json")
        .when(~valid(parsed, F.col("name"), schemas), "bad_arguments")
        .when(F.col("has").isNull(), "no_result")
        .when(~F.coalesce(F.col("result_turn") > F.col("turn"), F.lit(False)), "early_result")
        .otherwise("ok")
    )
    out = linked.select(*ids, "turn", "level", "ready", "result_turn", status.alias("status"), _message(F.coalesce(F.to_json(parsed), _text("arguments")), "call_id", "name", "content").alias("message"))
    orphans = got.join(calls.select(*ids).distinct(), ids, "left_anti")
    null = F.lit(None)
    lone = orphans.select(*ids, null.cast("long").alias("turn"), null.cast("int").alias("level"), null.cast("long").alias("ready"), "result_turn", F.lit("orphan_result").alias("status"), _message(F.lit("null"), "call_id", null.cast("string"), "content").alias("message"))
    return out.unionByName(lone)


def _text(value) -> "F.Column":
    """A JSON string (or null) of a text column: cut out of a one-field object, which escapes it."""
    value = F.col(value) if isinstance(value, str) else value
    whole = F.to_json(F.struct(value.alias("v")), {"ignoreNullFields": "false"})
    return F.substr(whole, F.lit(6), F.length(whole) - 6)


def _message(arguments, call_id, name, content) -> "F.Column":
    return F.concat(F.lit('{"arguments":'), F.coalesce(arguments, F.lit("null")), F.lit(',"call_id":'), _text(call_id), F.lit(',"name":'), _text(name), F.lit(',"result":'), _text(content), F.lit("}"))


def of_conversations(turns: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Calls, results and needs of plain conversations (conv_id, turn, role, text): a user's turn calls
    reply, a system's turn configure, an assistant's or tool's turn is the result of the last call
    before it; a call needs the conversation's first configure call, if that is before it."""
    turns = turns.selectExpr("cast(conv_id as long) conv_id", "cast(turn as long) turn", "role", "cast(text as string) text").filter("conv_id is not null and turn is not null")
    ident = F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    is_call = F.col("role").isin("user", "system")
    # what a turn sees before it: by blocks of turns, so that no task takes a whole long conversation
    order = turns.groupBy("conv_id", "turn").agg(F.max(F.when(is_call, F.col("turn"))).alias("call"), F.max(F.when(F.col("role") == "system", F.col("turn"))).alias("system")).withColumn("block", F.expr(f"floor(turn / {BLOCK_TURNS})"))
    blocks = order.groupBy("conv_id", "block").agg(F.max("call").alias("call"), F.min("system").alias("system"))
    across = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = blocks.select("conv_id", "block", F.max("call").over(across).alias("call0"), F.min("system").over(across).alias("system0"))
    inside = Window.partitionBy("conv_id", "block").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    seen = order.select("conv_id", "block", "turn", F.max("call").over(inside).alias("call1"), F.min("system").over(inside).alias("system1")).join(before, ["conv_id", "block"])
    seen = seen.select("conv_id", "turn", F.coalesce("call1", "call0").alias("last"), F.coalesce("system0", "system1").alias("first"))
    told = turns.join(seen, ["conv_id", "turn"])
    calls = told.filter(is_call).select("conv_id", ident.alias("call_id"), "turn", F.when(F.col("role") == "user", "reply").otherwise("configure").alias("name"), F.to_json(F.struct("text", "turn"), {"ignoreNullFields": "false"}).alias("arguments"))
    results = told.filter(F.col("role").isin("assistant", "tool")).select("conv_id", F.concat_ws("/", F.col("conv_id").cast("string"), F.coalesce(F.col("last").cast("string"), F.lit("none"))).alias("call_id"), "turn", F.col("text").alias("content"))
    needs = told.filter(is_call & F.col("first").isNotNull()).select("conv_id", ident.alias("call_id"), F.concat_ws("/", F.col("conv_id").cast("string"), F.col("first").cast("string")).alias("needs"))
    return calls, results, needs


def op7_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results, needs = of_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return link(Workspace(spark, "op7"), calls, results, needs)


OP7_SQL = """
WITH t AS (SELECT conv_id, turn, role, text, conv_id || '/' || turn AS ident, role IN ('user', 'system') AS is_call,
      max(CASE WHEN role IN ('user', 'system') THEN turn END) OVER w AS last, min(CASE WHEN role = 'system' THEN turn END) OVER w AS first
      FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL
      WINDOW w AS (PARTITION BY conv_id ORDER BY turn RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, CASE WHEN role = 'user' THEN 'reply' ELSE 'configure' END AS name FROM t WHERE is_call),
r0 AS (SELECT conv_id, conv_id || '/' || coalesce(CAST(last AS VARCHAR), 'none') AS call_id, turn, text FROM t WHERE role IN ('assistant', 'tool')),
r AS (SELECT conv_id, call_id, turn AS result_turn, text AS content FROM r0 QUALIFY row_number() OVER (PARTITION BY conv_id, call_id ORDER BY turn, text NULLS FIRST) = 1),
s AS (SELECT ident, min(first) AS first, min(turn) AS turn FROM c GROUP BY ident),
l AS (SELECT s.ident, CASE WHEN s.first IS NULL THEN 0 ELSE 1 END AS level, greatest(s.turn, s.first) AS ready FROM s),
o AS (SELECT c.conv_id, c.ident AS call_id, c.turn, CAST(l.level AS INT) AS level, l.ready, r.result_turn,
      CASE WHEN c.text IS NULL OR length(c.text) < 1 THEN 'bad_arguments' WHEN r.call_id IS NULL THEN 'no_result' WHEN r.result_turn > c.turn THEN 'ok' ELSE 'early_result' END AS status,
      '{"arguments":' || to_json({'text': c.text, 'turn': c.turn}) || ',"call_id":' || to_json(c.ident) || ',"name":' || to_json(c.name) || ',"result":' || coalesce(CAST(to_json(r.content) AS VARCHAR), 'null') || '}' AS message
      FROM c JOIN l ON c.ident = l.ident LEFT JOIN r ON r.call_id = c.ident AND r.conv_id = c.conv_id)
SELECT * FROM o UNION ALL
SELECT r.conv_id, r.call_id, NULL, NULL, NULL, r.result_turn, 'orphan_result', '{"arguments":null,"call_id":' || to_json(r.call_id) || ',"name":null,"result":' || coalesce(CAST(to_json(r.content) AS VARCHAR), 'null') || '}'
FROM r WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.ident = r.call_id)
"""
