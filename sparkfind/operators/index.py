"""An inverted index on disk for BM25: immutable segments, kept in step with the rows by upserts, deletes and merges.

A segment has three tables. ``postings``: for each term and block of up to 1,024 rows the rows that hold it (``ids``, their lengths ``ds``) and
its hits (``at``: the row's place in ``ids`` times the number of columns, and the column; ``pos``), and as a header the most hits a row has in
each column and the least length of a row; partitioned by ``lead``, a hash of a term's first two letters, sorted by term in each file.
``docs``: each row's block, length and distinct terms, partitioned by a hash of the key. ``stats``: for each beginning of a term, up to
``PREFIX`` letters, in how many rows a term begins so.

Rows are exchanged by block, so a block's postings are made where its rows are, in tasks of a bounded number of tokens, and no token is
exchanged by itself. A block that two Arrow batches share, or one of very long rows, has several postings for a term; their headers add up to a bound as well.

Segments are never changed. A batch makes one more segment of its rows; the versions that it replaces or deletes are listed
as dead, and its ``stats`` are the new rows' less the dead ones', so sums over segments are those of the
living rows. A manifest (see ``snapshots``) names segments, dead lists, the number of rows and of their tokens; it is written
last, so readers see whole batches. ``merge`` rewrites the smallest segments as one, without their dead rows.

``search`` gives what ``fts.bm25`` gives over the living rows. Only the leads and terms of the query are read. Where every phrase is
one token, headers bound each block's scores: the best blocks are scored first, then those whose bound reaches the worst
of the results so far; all others are skipped. A phrase of several tokens has no count in ``stats``, so the
postings of its tokens are all read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..functions.text import phrases, spaced
from .fts import B, CANDIDATES, K1, LEAST_IDF, occurrences
from .snapshots import Snapshots

BLOCK_BITS, LEADS, PARTS, PREFIX = 10, 64, 64, 16
#: Blocks that are scored before any is skipped; a merge goes on until no more segments than this are left.
FIRST, SEGMENTS = 64, 8
#: Tokens that Python holds sorted at a time (a longer row by itself), and that a task writes postings of.
AT_ONCE, TASK_TOKENS = 1 << 20, 1 << 23
#: Letters of terms whose beginnings are counted at a time, in units of ``AT_ONCE``.
LETTERS = 8
FORMAT = 2
MADE = "term string, origin int, block long, most array<int>, least int, ids array<long>, ds array<int>, at array<int>, pos array<int>"
POSTINGS = MADE + ", lead int"
DOCS = "id long, origin int, block long, d int, terms string, part int"
DEAD = "id long, origin int, block long, d int, terms string"
STATS = "prefix string, n long, lead int"
ROW = ["origin", "block", "id"]


def lead(term: Column) -> Column:
    return F.pmod(F.crc32(F.substring(term, 1, 2).cast("binary")), F.lit(LEADS)).cast("int")


def lead_of(term: str) -> int:
    return zlib.crc32(term[:2].encode()) % LEADS


def part(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(PARTS)).cast("int")


def every(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, tests)


def some(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def _begins(token: str) -> Column:
    """Terms that begin with the token; from two letters on in one lead."""
    return F.col("term").startswith(token) & (F.col("lead") == lead_of(token) if len(token) > 1 else F.lit(True))


def _is(token: str) -> Column:
    return (F.col("term") == token) & (F.col("lead") == lead_of(token))


def _row(at: Column, columns: int) -> list[Column]:
    """id, d of a hit's row."""
    place = F.call_function("div", at, F.lit(columns)).cast("int")
    return [F.get("ids", place).alias("id"), F.get("ds", place).alias("d")]


def _list(ends: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind))


def _runs(same: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.r_[True, same[1:] != same[:-1]]) if len(same) else np.zeros(0, np.int64)


def _cuts(sizes: np.ndarray, apart: np.ndarray, times: int = 1) -> Iterator[tuple[int, int]]:
    """Runs of rows that are alike in ``apart`` and hold some ``times`` ``AT_ONCE`` things at most."""
    starts = np.union1d(_runs(apart), _runs((np.cumsum(sizes, dtype=np.int64) - sizes) // (AT_ONCE * times)))
    yield from zip(starts.tolist(), [*starts[1:].tolist(), len(sizes)], strict=True)


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words of texts that have blanks between them; their rows and places."""
    lists = pc.split_pattern(pc.utf8_trim(texts, characters=" "), pattern=" ")
    ends = lists.offsets.to_numpy()
    row = np.repeat(np.arange(len(texts)), np.diff(ends))
    place = np.arange(len(row)) - ends[row]
    some = pc.not_equal(lists.flatten(), "")  # of a blank text one empty word
    keep = some.to_numpy(zero_copy_only=False)
    return lists.flatten().filter(some), row[keep], place[keep]


def _packed(group: np.ndarray, row: np.ndarray, ids: np.ndarray, ds: np.ndarray, col: np.ndarray, pos: np.ndarray, columns: int) -> tuple[np.ndarray, dict[str, pa.Array]]:
    """The first hit of each group, and the groups' postings, of hits in order of group and row (``ids`` and ``ds`` are the rows')."""
    first = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (row[1:] != row[:-1])])
    post = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(group)]))
    starts = _runs(group[first])
    ends = np.r_[starts, len(first)]
    rank = np.arange(len(first)) - np.repeat(starts, np.diff(ends))
    counts = np.bincount(post * columns + col, minlength=len(first) * columns).reshape(-1, columns)
    ds = ds[row[first]]
    hits = np.r_[first[starts], len(group)]
    return first[starts], {
        "most": _list(np.arange(len(starts) + 1) * columns, np.maximum.reduceat(counts, starts, axis=0).ravel(), pa.int32()),
        "least": pa.array(np.minimum.reduceat(ds, starts), pa.int32()),
        "ids": _list(ends, ids[row[first]], pa.int64()),
        "ds": _list(ends, ds, pa.int32()),
        "at": _list(hits, rank[post] * columns + col, pa.int32()),
        "pos": _list(hits, pos, pa.int32()),
    }


def _inverted(columns: int):
    """Staged rows (id, origin, block, d, t0, t1, ...) to postings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in _cuts(batch["d"].to_numpy(), batch["block"].to_numpy()):
                rows = batch.slice(a, b - a)
                words, row, pos = zip(*[_words(rows[f"t{c}"]) for c in range(columns)], strict=True)
                col = np.repeat(np.arange(columns), [len(x) for x in row])
                coded, row, pos = pa.concat_arrays(words).dictionary_encode(), np.concatenate(row), np.concatenate(pos)
                if not len(row):
                    continue
                code = coded.indices.to_numpy().astype(np.int64)
                order = np.argsort(code * len(rows) + row, kind="stable")  # hits of one row stay in order of column and place
                first, made = _packed(code[order], row[order], rows["id"].to_numpy(), rows["d"].to_numpy(), col[order], pos[order], columns)
                place = row[order][first]
                yield pa.RecordBatch.from_pydict({"term": coded.dictionary.take(pa.array(code[order][first])), "origin": rows["origin"].take(pa.array(place)), "block": rows["block"].take(pa.array(place))} | made)

    return run


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Where each list begins in the values of all, and these."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
    return np.r_[0, np.cumsum(sizes, dtype=np.int64)], lists.flatten().to_numpy()


def _without(columns: int):
    """Postings to postings without the rows that ``gone`` lists: ids that a block of theirs, or a row before them without a term, has.

    The postings of a block follow each other, so that the list of one block is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, gone = None, np.zeros(0, np.int64)
        for batch in batches:
            for a, b in _cuts(pc.fill_null(pc.list_value_length(batch["at"]), 0).to_numpy(), np.zeros(batch.num_rows)):
                rows = batch.slice(a, b - a)
                (posts, ids), (_, ds), (hits, at), (_, pos), (ends, listed) = (_flat(rows[c]) for c in ("ids", "ds", "at", "pos", "gone"))
                origin, block = rows["origin"].to_numpy(), rows["block"].to_numpy()
                starts = np.union1d(_runs(origin), _runs(block))
                dead = np.zeros(len(ids), bool)
                for i, j in zip(starts.tolist(), [*starts[1:].tolist(), len(rows)], strict=True):
                    own, gone = (key := (origin[i], block[i])), gone if key == own else gone[:0]
                    gone = np.union1d(gone, listed[ends[i] : ends[j]]) if ends[j] > ends[i] else gone
                    if len(gone):
                        dead[posts[i] : posts[j]] = np.isin(ids[posts[i] : posts[j]], gone)
                if not dead.any():
                    yield rows.filter(rows["term"].is_valid()).drop_columns(["gone"])
                    continue
                group = np.repeat(np.arange(len(rows)), np.diff(hits))
                post = posts[group] + at // columns
                keep = ~dead[post]
                if not keep.any():
                    continue
                first, made = _packed(group[keep], post[keep], ids, ds, (at % columns)[keep], pos[keep], columns)
                place = pa.array(group[keep][first])
                yield pa.RecordBatch.from_pydict({c: rows[c].take(place) for c in ("term", "origin", "block")} | made)

    return run


def _beginnings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """prefix, n: in how many rows of a batch a term begins so.

    Of a row's terms in order, each has the beginnings for the first time that are longer than what it shares with the term before."""
    for batch in batches:
        for a, b in _cuts(pc.fill_null(pc.binary_length(batch["terms"]), 0).to_numpy(), np.zeros(batch.num_rows), LETTERS):
            words, row, _ = _words(batch["terms"].slice(a, b - a))
            if not len(row):
                continue
            coded = words.dictionary_encode()
            order = pc.array_sort_indices(coded.dictionary)
            terms = pc.utf8_slice_codeunits(coded.dictionary.take(order), 0, PREFIX)
            rank = np.argsort(order.to_numpy())
            letters = np.array(terms.to_pylist(), f"U{PREFIX}").view(np.uint32).reshape(len(terms), PREFIX)
            size = np.count_nonzero(letters, axis=1)
            place = np.sort(row * len(terms) + rank[coded.indices.to_numpy()])
            place = place[_runs(place)]
            row, term = place // len(terms), place % len(terms)
            shared = np.zeros(len(term), np.int64)
            _share(letters, term[1:], term[:-1], np.flatnonzero(row[1:] == row[:-1]), shared[1:])
            above = np.zeros(len(terms), np.int64)
            _share(letters, np.arange(1, len(terms)), np.arange(len(terms) - 1), np.arange(len(terms) - 1), above[1:])
            # in how many rows a term shares so many letters at most with the one before
            fresh = np.bincount(term * (PREFIX + 1) + shared, minlength=len(terms) * (PREFIX + 1)).reshape(-1, PREFIX + 1).cumsum(axis=1)
            for k in range(1, int(size.max()) + 1):
                long = np.flatnonzero(size >= k)
                starts = np.flatnonzero(np.r_[True, above[long[1:]] < k])
                n = np.add.reduceat(fresh[long, k - 1], starts)
                yield pa.RecordBatch.from_pydict({"prefix": pc.utf8_slice_codeunits(terms.take(pa.array(long[starts])), 0, k), "n": pa.array(n, pa.int64())})


def _share(letters: np.ndarray, left: np.ndarray, right: np.ndarray, pairs: np.ndarray, out: np.ndarray) -> None:
    """Into ``out``: how many letters the terms ``left`` and ``right`` of each of the ``pairs`` share at their beginning."""
    for k in range(letters.shape[1]):
        x = letters[left[pairs], k]
        pairs = pairs[(x == letters[right[pairs], k]) & (x > 0)]
        out[pairs] += 1


def _counts(docs: DataFrame, sign: int) -> DataFrame:
    """prefix, n: the rows of ``docs`` in which a term begins so, times ``sign``; in parts."""
    return docs.select("terms").mapInArrow(_beginnings, "prefix string, n long").select("prefix", (F.col("n") * sign).alias("n"))


def _by_lead(stats: DataFrame, total: int) -> DataFrame:
    """Dealt out so that a lead's beginnings, of so many tokens, are in few files: one below ``4 * TASK_TOKENS`` tokens, one more for each so many."""
    shares = 1 + total // (4 * TASK_TOKENS)
    return stats.repartition(16 * shares, "lead", F.pmod(F.xxhash64("prefix"), F.lit(shares)))


def _placed(postings: DataFrame) -> DataFrame:
    return postings.withColumn("lead", lead(F.col("term"))).sortWithinPartitions("lead", "term", "origin", "block")


class Index:
    """An index at ``path`` over rows of a key (long) and text ``columns``; the path's folder may be empty or not there yet."""

    def __init__(self, spark: SparkSession, path: str, key: str = "id", columns: tuple[str, ...] = ()):
        self.spark, self.key, self.columns = spark, key, tuple(columns)
        self.store = Snapshots(spark, path)
        #: What the last search looked at: blocks that hold all phrases, and those of them that were read.
        self.figures: dict[str, int] = {}

    # ------------------------------------------------------------------ writing
    def apply(self, upserts: DataFrame | None = None, deletes: DataFrame | None = None) -> int:
        """One batch: rows of ``upserts`` (the key, a row each, and the columns) replace those of their key, keys of ``deletes`` go.
        Rows without a key are left out.

        A key in both is upserted. Keys that aren't there are deleted without effect. Gives the state's number."""
        number, m = self._latest()
        m = m or {"format": FORMAT, "columns": list(self.columns), "segments": [], "dead": [], "rows": 0, "total": 0, "next": 1}
        new, segment = None, m["next"]
        touched = [] if deletes is None else [deletes.select(F.col(self.key).cast("long").alias("id"))]
        if upserts is not None:
            new = self._staged(upserts, m["columns"], segment)
            touched.append(new.select("id"))
        ids = reduce(DataFrame.unionByName, touched).filter("id is not null").distinct()
        parts = [r[0] for r in ids.select(part(F.col("id")).alias("p")).distinct().collect()]  # PARTS at most
        touched_docs = self._table(m, "docs", DOCS).filter(F.col("part").isin(parts)).drop("part").join(ids, "id", "left_semi")
        killed = self._save(self._alive(m, touched_docs).select(*[c.split()[0] for c in DEAD.split(", ")]), "dead", DEAD)
        gone = killed[1].agg(F.count(F.lit(1)), F.coalesce(F.sum("d"), F.lit(0))).first()
        came, folders = (0, 0), {}
        deltas = _counts(killed[1], -1)
        if new is not None:
            terms = F.array_join(F.array_distinct(F.split(F.trim(F.concat(*[f"t{i}" for i in range(len(m["columns"]))])), " +")), " ")
            docs = new.select("id", "origin", "block", "d", terms.alias("terms"), part(F.col("id")).alias("part"))
            docs = self._save(docs, "docs", DOCS, "part")
            came = tuple(docs[1].agg(F.count(F.lit(1)), F.coalesce(F.sum("d"), F.lit(0))).first())
            deltas = deltas.unionByName(_counts(docs[1], 1))
            folders = {"docs": docs[0], "postings": self._inverted(new, m["columns"], came[1])}
        stats = deltas.groupBy("prefix").agg(F.sum("n").alias("n")).filter("n <> 0").withColumn("lead", lead(F.col("prefix")))
        folders["stats"] = self._save(_by_lead(stats, came[1]), "stats", STATS, "lead")[0]
        made = m | {
            "segments": [*m["segments"], {"number": segment, "rows": came[0], **folders}],
            "dead": m["dead"] + ([killed[0]] if gone[0] else []),
            "rows": m["rows"] + came[0] - gone[0],
            "total": m["total"] + came[1] - gone[1],
            "next": segment + 1,
        }
        return self.store.commit(number, made)

    def merge(self, most: int = SEGMENTS) -> int:
        """Rewrites the smallest segments as one, so that at most ``most`` are left; their dead rows are left out for good."""
        number, m = self._latest()
        if len(m.get("segments", [])) <= max(1, most):
            return number
        order = sorted(m["segments"], key=lambda s: (s["rows"], s["number"]))
        old, kept = order[: len(order) - max(1, most) + 1], order[len(order) - max(1, most) + 1 :]
        part_m, segment = m | {"segments": old}, m["next"]
        docs = self._save(self._living(part_m), "docs", DOCS, "part")
        rows = docs[1].count()
        total = docs[1].agg(F.coalesce(F.sum("d"), F.lit(0))).first()[0]
        posts = self._table(part_m, "postings", POSTINGS).drop("lead")
        if m["dead"]:  # each block's dead rows stand once, before its postings
            gone = self._dead(m).groupBy("origin", "block").agg(F.collect_list("id").alias("gone"))  # a block's rows at most
            posts = posts.unionByName(gone, allowMissingColumns=True).repartition(self._tasks(total), "origin", "block").sortWithinPartitions("origin", "block", F.col("term").isNotNull())
            posts = posts.select(*[c.split()[0] for c in MADE.split(", ")], "gone").mapInArrow(_without(len(m["columns"])), MADE)
        # small segments give one file a lead; larger ones have large files already, and so much is not exchanged
        if total < TASK_TOKENS:
            posts = posts.repartition(16, lead(F.col("term")))
        postings = self._save(_placed(posts), "postings", POSTINGS, "lead")
        stats = self._table(part_m, "stats", STATS).groupBy("prefix", "lead").agg(F.sum("n").alias("n")).filter("n <> 0").select("prefix", "n", "lead")
        folders = {"docs": docs[0], "postings": postings[0], "stats": self._save(_by_lead(stats, total), "stats", STATS, "lead")[0]}
        dead, still = m["dead"], self._dead(m, whole=True).join(self._table(part_m, "docs", DOCS).select(*ROW), ROW, "left_anti")
        if dead:
            folder, table = self._save(still, "dead", DEAD)
            dead = [folder] if table.limit(1).count() else []
        made = m | {"segments": [*sorted(kept, key=lambda s: s["number"]), {"number": segment, "rows": rows, **folders}], "dead": dead, "next": segment + 1}
        return self.store.commit(number, made)

    def _staged(self, rows: DataFrame, columns: list[str], segment: int) -> DataFrame:
        """The rows' tokens, written once: the block numbers of later reads are theirs."""
        texts = [spaced(F.col(c)).alias(f"t{i}") for i, c in enumerate(columns)]
        size = reduce(lambda a, b: a + b, [occurrences(F.col(f"t{i}"), " ") - 1 for i in range(len(columns))])
        made = rows.filter(F.col(self.key).isNotNull()).select(F.col(self.key).cast("long").alias("id"), *texts).withColumn("d", size).withColumn("origin", F.lit(segment)).withColumn("block", F.shiftright(F.monotonically_increasing_id(), BLOCK_BITS))
        folder = self.store.new_folder("staged")
        made.write.option("parquet.block.size", 16 << 20).option("compression", "zstd").parquet(f"{self.store.path}/{folder}")
        return self.spark.read.schema(made.schema).parquet(f"{self.store.path}/{folder}")

    def _tasks(self, total: int) -> int:
        """Tasks that make postings of so many tokens."""
        return max(self.spark.sparkContext.defaultParallelism, total // TASK_TOKENS + 1)

    def _inverted(self, staged: DataFrame, columns: list[str], total: int) -> str:
        return self._save(_placed(staged.repartition(self._tasks(total), "block").mapInArrow(_inverted(len(columns)), MADE)), "postings", POSTINGS, "lead")[0]

    def _save(self, rows: DataFrame, name: str, schema: str, by: str | None = None) -> tuple[str, DataFrame]:
        folder = self.store.new_folder(name)
        writer = rows.write.option("parquet.block.size", 16 << 20).option("compression", "zstd")
        (writer.partitionBy(by) if by else writer).parquet(f"{self.store.path}/{folder}")
        return folder, self.spark.read.schema(schema).parquet(f"{self.store.path}/{folder}")

    # ------------------------------------------------------------------ reading
    def _latest(self) -> tuple[int, dict]:
        number, m = self.store.latest()
        if m and m.get("format") != FORMAT:
            raise ValueError(f"the index at {self.store.path} is of another format and must be made anew")
        return number, m

    def _table(self, m: dict, name: str, schema: str) -> DataFrame:
        found = [self.spark.read.schema(schema).parquet(f"{self.store.path}/{s[name]}") for s in m["segments"] if name in s]
        return reduce(DataFrame.unionByName, found) if found else self.spark.createDataFrame([], schema)

    def _dead(self, m: dict, whole: bool = False) -> DataFrame:
        found = [self.spark.read.schema(DEAD).parquet(f"{self.store.path}/{f}") for f in m["dead"]]
        rows = reduce(DataFrame.unionByName, found) if found else self.spark.createDataFrame([], DEAD)
        return rows if whole else rows.select(*ROW)

    def _alive(self, m: dict, docs: DataFrame) -> DataFrame:
        return docs.join(self._dead(m), ROW, "left_anti") if m["dead"] else docs

    def _living(self, m: dict) -> DataFrame:
        return self._alive(m, self._table(m, "docs", DOCS))

    def living(self) -> DataFrame:
        """id, origin, block, d, terms (with a blank between each two) of every row that the index answers for."""
        return self._living(self._latest()[1] or {"segments": [], "dead": []}).drop("part")

    def counts(self) -> DataFrame:
        """prefix, n: in how many living rows a term begins so, for every beginning of up to ``PREFIX`` letters."""
        stats = self._table(self._latest()[1] or {"segments": []}, "stats", STATS)
        return stats.groupBy("prefix").agg(F.sum("n").alias("n")).filter("n <> 0")

    def search(self, query: str, weights: dict[str, float], limit: int = CANDIDATES) -> DataFrame:
        """key, score (lower is better) of the best rows, ties by key: ``fts.bm25`` over the living rows."""
        _, m = self._latest()
        found = phrases(query)
        self.figures = {"blocks": 0, "read": 0}
        schema = f"{self.key} long, score double"
        if found is None or not m or not m["rows"]:
            return self.spark.createDataFrame([], schema)
        by_column = [float(weights[c]) for c in m["columns"]]
        plain = all(len(p) == 1 and len(p[0]) <= PREFIX for p in found)
        best = (self._by_bounds if plain else self._by_phrases)(m, found, by_column, limit)
        # a page of results, held by the driver
        return self.spark.createDataFrame([(r["id"], -r["score"]) for r in best], schema)

    def _top(self, m: dict, counted: DataFrame, df: list[int], limit: int) -> DataFrame:
        """id, score (greater is better) of the best living ones of ``counted`` (origin, block, id, d, f0, f1, ...)."""
        counted = counted.filter(every([F.col(f"f{j}") > 0 for j in range(len(df))]))
        if m["dead"]:
            counted = counted.join(self._dead(m), ROW, "left_anti")
        return counted.select("id", self._score(m, df, [F.col(f"f{j}") for j in range(len(df))], [F.col("d")] * len(df)).alias("score")).orderBy(F.desc("score"), "id").limit(limit)

    @staticmethod
    def _score(m: dict, df: list[int], f: list[Column], d: list[Column]) -> Column:
        rows, total, out = float(m["rows"]), float(m["total"]), F.lit(0.0)
        for j, n in enumerate(df):
            idf = F.ln(F.lit((rows - n + 0.5) / (n + 0.5)))
            out = out + F.when(idf > 0, idf).otherwise(LEAST_IDF) * f[j] * (K1 + 1) / (f[j] + K1 * (1 - B + B * d[j] * rows / total))
        return out

    def _by_bounds(self, m: dict, found: list[list[str]], weights: list[float], limit: int) -> list:
        terms = [p[0] for p in found]
        whole = [t for t in terms if len(t) > 1]
        counts = self._table(m, "stats", STATS).filter(F.col("prefix").isin(terms) & F.col("lead").isin([lead_of(t) for t in terms]))
        n = {r["prefix"]: r["n"] for r in counts.groupBy("prefix").agg(F.sum("n").alias("n")).collect()}  # a row for each term of the query
        df = [n.get(t, 0) for t in terms]
        if not all(df):
            return []
        postings = self._table(m, "postings", POSTINGS).filter(some([_begins(t) for t in terms]))
        if len(whole) == len(terms):
            postings = postings.filter(F.col("lead").isin([lead_of(t) for t in terms]))
        bound = reduce(lambda a, b: a + b, [F.get("most", F.lit(c)) * w for c, w in enumerate(weights)])
        matched = [F.when(_begins(t), bound) for t in terms]
        heads = postings.groupBy("origin", "block").agg(*[F.sum(x).alias(f"f{j}") for j, x in enumerate(matched)], *[F.min(F.when(_begins(t), F.col("least"))).alias(f"d{j}") for j, t in enumerate(terms)])
        heads = heads.filter(every([F.col(f"f{j}") > 0 for j in range(len(terms))]))
        heads = heads.select("origin", "block", self._score(m, df, [F.col(f"f{j}") for j in range(len(df))], [F.col(f"d{j}") for j in range(len(df))]).alias("bound")).persist(StorageLevel.DISK_ONLY)

        def scored(blocks: DataFrame) -> list:
            own = F.array(*[F.lit(w) for w in weights])
            hit = F.transform("at", lambda x: F.struct(*_row(x, len(weights)), F.get(own, x % len(weights)).alias("f")))
            hits = postings.join(blocks.select("origin", "block"), ["origin", "block"], "left_semi").select("origin", "block", "term", "lead", F.inline(hit))
            each = [F.sum(F.when(_begins(t), F.col("f"))).alias(f"f{j}") for j, t in enumerate(terms)]
            return self._top(m, hits.groupBy("origin", "block", "id", "d").agg(*each), df, limit).collect()

        try:
            blocks = heads.count()
            first = heads.orderBy(F.desc("bound"), "origin", "block").limit(FIRST).collect()
            best = scored(F.broadcast(self.spark.createDataFrame(first, heads.schema))) if first else []  # FIRST rows at most
            self.figures = {"blocks": blocks, "read": len(first)}
            if blocks > len(first):
                # bounds and scores are sums of the same terms: a little less than the last score allows for their rounding
                least = best[-1]["score"] * (1 - 1e-9) if len(best) == limit else -1.0
                rest = heads.filter(F.col("bound") >= least)
                self.figures["read"] = max(len(first), rest.count())
                if self.figures["read"] > len(first) or least < 0:
                    best = scored(rest)
            return best
        finally:
            heads.unpersist()

    def _by_phrases(self, m: dict, found: list[list[str]], weights: list[float], limit: int) -> list:
        tests = [(j, k, _is(t) if k < len(p) - 1 else _begins(t)) for j, p in enumerate(found) for k, t in enumerate(p)]
        postings = self._table(m, "postings", POSTINGS).filter(some([t for _, _, t in tests]))
        if all(len(p[-1]) > 1 for p in found):
            postings = postings.filter(F.col("lead").isin([lead_of(t) for p in found for t in p]))
        hit = F.transform("at", lambda x, i: F.struct(*_row(x, len(weights)), (x % len(weights)).alias("col"), F.get("pos", i).alias("pos")))
        hits = postings.select("origin", "block", "term", "lead", F.inline(hit))
        starts = F.filter(F.array(*[F.when(t, F.struct(F.lit(j).alias("j"), (F.col("pos") - k).alias("start"))) for j, k, t in tests]), lambda x: x.isNotNull())
        placed = hits.select(*ROW, "d", "col", F.inline(starts)).groupBy(*ROW, "d", "col", "j", "start").agg(F.count(F.lit(1)).alias("n"))
        size = F.element_at(F.array(*[F.lit(len(p)) for p in found]), F.col("j") + 1)
        weight = F.element_at(F.array(*[F.lit(w) for w in weights]), F.col("col") + 1)
        counted = placed.filter(F.col("n") == size).groupBy(*ROW, "d").agg(*[F.coalesce(F.sum(F.when(F.col("j") == j, weight)), F.lit(0.0)).alias(f"f{j}") for j in range(len(found))])
        if m["dead"]:
            counted = counted.join(self._dead(m), ROW, "left_anti")
        counted = counted.persist(StorageLevel.DISK_ONLY)
        try:
            df = list(counted.agg(*[F.count(F.when(F.col(f"f{j}") > 0, 1)) for j in range(len(found))]).first())
            return self._top(m | {"dead": []}, counted, df, limit).collect() if all(df) else []
        finally:
            counted.unpersist()
