"""Full-text search: column-weighted BM25 over phrases with a prefix-matched last token.

Tokens are derived in the plan, so there is no index to keep in step; ``postings`` materialises one
for repeated queries. Counts come from one pass over the texts; only they (a few numbers a row) are
exchanged, once, for the global aggregate (a row) of the collection's figures and for the scores.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.text import fold_text, phrases, spaced, tokens

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
CANDIDATES = 50


def occurrences(text: Column, part: str) -> Column:
    """How often ``part`` occurs in the text, overlapping occurrences too, in time that grows with the text."""
    if any(part.startswith(part[k:]) for k in range(1, len(part))):  # only such a part can overlap itself
        return F.regexp_count(text, F.lit(f"(?={part})"))
    return ((F.octet_length(text) - F.octet_length(F.replace(text, F.lit(part), F.lit("")))) / len(part.encode())).cast("int")


def phrase_count(text: Column, phrase: list[str]) -> Column:
    """How often the phrase occurs in ``spaced`` tokens; its last token stands for all that begin with it.

    Tokens are letters and digits between single blanks, so each occurrence is one of the phrase's text after a blank."""
    return occurrences(text, " " + " ".join(phrase))


def bm25(rows: DataFrame, key: str, weights: dict[str, float], query: str, limit: int = CANDIDATES) -> DataFrame:
    """key, score (lower is better) of the best rows that hold every phrase in any column; ties by key.

    A blank query, or a term without letters and digits, matches nothing."""
    found = phrases(query)
    if found is None:
        return rows.select(key, F.lit(0.0).alias("score")).limit(0)
    t = rows.select(key, *[spaced(F.col(c)).alias(f"t{i}") for i, c in enumerate(weights)])
    size = reduce(lambda a, b: a + b, [occurrences(F.col(f"t{i}"), " ") - 1 for i in range(len(weights))])
    counts = []
    for j, phrase in enumerate(found):
        each = [phrase_count(F.col(f"t{i}"), phrase) for i in range(len(weights))]
        counts += [reduce(lambda a, b: a + b, each).alias(f"n{j}"), reduce(lambda a, b: a + b, [c * float(w) for c, w in zip(each, weights.values(), strict=True)]).alias(f"f{j}")]
    # as a generator's row, so that filters on the counts don't make Spark derive the tokens anew for each of them
    counted = t.select(key, F.inline(F.array(F.struct(size.alias("d"), *counts)))).repartition(key)
    # both sides read one exchange of all the columns: what is pruned or filtered on one side only would be a second pass over the texts
    used = reduce(lambda a, b: a + b, [F.sum(f"f{j}") for j in range(len(found))], F.count(key))
    stats = counted.agg(F.count(F.lit(1)).alias("rows"), F.sum("d").alias("total"), *[F.sum((F.col(f"n{j}") > 0).cast("long")).alias(f"df{j}") for j in range(len(found))], used.alias("_used"))
    scored = counted.crossJoin(F.broadcast(stats))  # stats: one row
    hit = reduce(lambda a, b: a & b, [F.col(f"n{j}") > 0 for j in range(len(found))])
    score = F.lit(0.0)
    for j in range(len(found)):
        idf = F.ln((F.col("rows") - F.col(f"df{j}") + 0.5) / (F.col(f"df{j}") + 0.5))
        tf = F.col(f"f{j}")
        score = score - F.when(idf > 0, idf).otherwise(LEAST_IDF) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("d") * F.col("rows") / F.col("total")))
    return scored.select(key, F.when(hit & (F.col("_used") >= 0), score).alias("score")).filter("score is not null").orderBy("score", key).limit(limit)


def candidates(rows: DataFrame) -> DataFrame:
    """A list of candidates (as many as its limit, by default 50) held as a local table: what follows plans on a few rows."""
    return rows.sparkSession.createDataFrame(rows.collect(), rows.schema)


def bm25_sql(source: str, key: str, weights: dict[str, float], query: str, limit: int = CANDIDATES) -> str:
    """The same as SQL for DuckDB: a SELECT of key and score."""
    found = phrases(query)
    if found is None:
        return f"SELECT {key}, 0.0 AS score FROM {source} WHERE false"
    toks = ", ".join(f"list_filter(string_split_regex(strip_accents(lower(coalesce({c}, ''))), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '') AS t{i}" for i, c in enumerate(weights))
    parts = []
    for j, phrase in enumerate(found):
        each = []
        for i in range(len(weights)):
            m = len(phrase) - 1
            tests = [f"t{i}[k + {n}] = '{w}'" for n, w in enumerate(phrase[:-1])] + [f"starts_with(t{i}[k + {m}], '{phrase[-1]}')"]
            each.append(f"len(list_filter(range(1, greatest(len(t{i}) - {m} + 1, 1)), lambda k: {' AND '.join(tests)}))")
        parts += [f"{' + '.join(each)} AS n{j}", f"{' + '.join(f'{c} * {float(w)}' for c, w in zip(each, weights.values(), strict=True))} AS f{j}"]
    score = "".join(
        f" - CASE WHEN ln((rows - df{j} + 0.5) / (df{j} + 0.5)) > 0 THEN ln((rows - df{j} + 0.5) / (df{j} + 0.5)) ELSE {LEAST_IDF} END * f{j} * {K1 + 1} / (f{j} + {K1} * (1 - {B} + {B} * d * rows / total))" for j in range(len(found))
    )
    return f"""SELECT {key}, score FROM (
WITH tk AS (SELECT {key}, {toks} FROM {source}),
ct AS (SELECT {key}, {' + '.join(f'len(t{i})' for i in range(len(weights)))} AS d, {', '.join(parts)} FROM tk),
st AS (SELECT count(*)::DOUBLE AS rows, sum(d)::DOUBLE AS total, {', '.join(f'count(*) FILTER (WHERE n{j} > 0) AS df{j}' for j in range(len(found)))} FROM ct)
SELECT {key}, 0.0{score} AS score FROM ct, st WHERE {' AND '.join(f'n{j} > 0' for j in range(len(found)))} ORDER BY score, {key} LIMIT {limit})"""


def postings(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """term, key, col, pos of every token: what to write, partitioned by the term's first letters, for repeated queries."""
    parts = [rows.select(key, F.lit(i).alias("col"), F.posexplode(tokens(F.col(c))).alias("pos", "term")) for i, c in enumerate(columns)]
    return reduce(DataFrame.unionByName, parts).select(F.substring("term", 1, 2).alias("prefix"), "term", key, "col", "pos")


def snippet_text(text: str, found: list[list[str]], width: int = 12, cut: str = "…") -> str:
    """The best window of ``width`` tokens with its hits between \\x01 and \\x02.

    A window scores 1000 for each phrase it shows for the first time and 1 for a repeat; one that begins at the
    start of the sentence of a hit within gains 100, or 120 at the text's start. The first of the best windows wins."""
    import re

    spans = [(m.start(), m.end()) for m in re.finditer(r"[^\W_]+", text)]
    toks = [fold_text(text[a:b]) for a, b in spans]
    hits = []
    for i in range(len(toks)):
        for j, phrase in enumerate(found):
            m = len(phrase)
            if i + m <= len(toks) and toks[i : i + m - 1] == phrase[:-1] and toks[i + m - 1].startswith(phrase[-1]):
                hits.append((i, i + m - 1, j))

    def window(start: int) -> tuple[int, int]:
        seen, score, first, last = set(), 0, None, -1
        for a, b, j in hits:
            if start <= a < start + width:
                score += 1 if j in seen else 1000
                seen.add(j)
                first = a if first is None else first
                last = b + 1
        at = first - int((width - (last - first)) / 2) if first is not None else start
        return score, max(0, min(at, len(toks) - width))

    sentences = [i for i, (a, _) in enumerate(spans) if i == 0 or re.search(r"[.:]\s+$", text[spans[i - 1][1] : a])]
    best, start = -1, 0
    for a, _, _ in hits:
        score, at = window(a)
        if score > best:
            best, start = score, at
        before = [s for s in sentences if s <= a]
        if len(toks) > width and before and before[-1] < a:  # a hit that begins a sentence has no other window
            score, _ = window(before[-1])
            score += 120 if before[-1] == 0 else 100
            if score > best:
                best, start = score, before[-1]
    stop = min(len(toks), start + width)
    marked = sorted((max(a, start), min(b, stop - 1)) for a, b, _ in hits if b >= start and a < stop)
    merged: list[list[int]] = []
    for a, b in marked:
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    if not toks:
        return text
    out, at = cut if start else "", 0 if not start else spans[start][0]
    for a, b in merged:
        out += text[at : spans[a][0]] + "\x01" + text[spans[a][0] : spans[b][1]] + "\x02"
        at = spans[b][1]
    return out + (text[at : spans[stop - 1][1]] + cut if stop < len(toks) else text[at:])


def snippets(text: Column, query: str) -> Column:
    """The snippet of each text; null for null, and where no hit shows."""
    found = phrases(query) or []

    @F.pandas_udf(StringType())
    def run(texts: pd.Series) -> pd.Series:
        out = texts.map(lambda t: None if t is None else snippet_text(t, found))
        return out.map(lambda s: s if s and "\x01" in s else None)

    return run(text)
