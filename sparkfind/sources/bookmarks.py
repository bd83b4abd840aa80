"""Browser bookmarks as rows (browser, url, title, folder, added_at)."""

from __future__ import annotations

import glob
import json
import os
import shutil
import sqlite3
import tempfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

SCHEMA = "browser string, url string, title string, folder string, added_at long"
EPOCH = 11644473600


def webkit_seconds(micros: int) -> int | None:
    return micros // 1_000_000 - EPOCH if micros > 0 else None


def parse_chromium(browser: str, text: str) -> list[tuple]:
    """Every address in the trees of a bookmarks file, with its folders' path."""
    out: list[tuple] = []
    todo = [(n, "") for n in reversed(list((json.loads(text).get("roots") or {}).values())) if isinstance(n, dict)]
    while todo:
        node, folder = todo.pop()
        kind, name = node.get("type"), node.get("name") if isinstance(node.get("name"), str) else None
        if kind == "url":
            if isinstance(url := node.get("url"), str) and url:
                added = node.get("date_added")
                micros = int(added) if isinstance(added, str) and added.lstrip("-").isdigit() else 0
                out.append((browser, url, url if name is None else name, folder, webkit_seconds(micros)))
        elif kind in ("folder", None):
            path = "/".join(x for x in (folder, name) if x)
            children = node.get("children")
            todo += [(c, path) for c in reversed(children if isinstance(children, list) else []) if isinstance(c, dict)]
    return out


@udtf(returnType="n int, url string, title string, folder string, added_at long")
class Tree:
    """``bookmark_tree(text)``: the addresses of a bookmarks file in its order, whatever the trees' depth; a broken file has none."""

    def eval(self, text: str):
        try:
            found = parse_chromium("", text or "")
        except (ValueError, AttributeError, RecursionError):  # no JSON, or no object
            return
        for n, (_, url, title, folder, added) in enumerate(found):
            yield n, url, title, folder, added


def trees(files: DataFrame, column: str = "text") -> DataFrame:
    """``files`` without the column of texts, and n, url, title, folder, added_at of every address in their trees. Executors parse them."""
    spark = files.sparkSession
    spark.udtf.register("bookmark_tree", Tree)
    others = [f"`{c}`" for c in files.columns if c != column]
    return spark.sql(f"SELECT {', '.join([*(f'f.{c}' for c in others), 't.*'])} FROM {{files}} f, LATERAL bookmark_tree(f.`{column}`) t", files=files)


def chromium(spark: SparkSession, files: list[tuple[str, str]]) -> DataFrame:
    """The bookmarks of stores (browser, path), which executors read."""
    paths = spark.createDataFrame(files, "browser string, path string")

    @F.pandas_udf("string")
    def read(paths: pd.Series) -> pd.Series:
        out = []
        for path in paths:
            try:
                with open(path, encoding="utf-8") as f:
                    out.append(f.read())
            except (OSError, UnicodeDecodeError):
                out.append(None)
        return pd.Series(out, dtype=object)

    rows = paths.repartition(min(len(files) or 1, spark.sparkContext.defaultParallelism)).select("browser", read("path").alias("text"))
    return trees(rows).select("browser", "url", "title", "folder", "added_at")


def firefox(bookmarks: DataFrame, places: DataFrame, depth: int = 32) -> DataFrame:
    """From moz_bookmarks (id, type, fk, parent, title, dateAdded) and moz_places (id, url): folders' paths by
    rounds of joins, at most ``depth`` levels."""
    folders = bookmarks.filter("type = 2").select("id", "parent", F.coalesce("title", F.lit("")).alias("title"))
    done = bookmarks.filter("type = 1").join(places.select(F.col("id").alias("fk"), "url"), "fk").filter(F.col("url").ilike("http%"))
    done = done.select(F.when(F.coalesce("title", F.lit("")) == "", F.col("url")).otherwise(F.col("title")).alias("title"), "url", F.expr("dateAdded div 1000000").alias("added_at"), F.col("parent").alias("at"), F.array().cast("array<string>").alias("parts"))
    up = folders.select(F.col("id").alias("at"), F.col("parent").alias("_up"), F.col("title").alias("_name"))
    for _ in range(depth):
        done = done.join(up, "at", "left").select("title", "url", "added_at", F.when(F.coalesce("_name", F.lit("")) != "", F.concat(F.array("_name"), "parts")).otherwise(F.col("parts")).alias("parts"), F.col("_up").alias("at"))
        if not done.filter("at is not null").limit(1).count():
            break
    return done.select(F.lit("firefox").alias("browser"), "url", "title", F.array_join("parts", "/").alias("folder"), "added_at")


def firefox_file(spark: SparkSession, path: str) -> DataFrame:
    """From a store, which is copied first (with its log), as the browser may hold it open."""
    with tempfile.TemporaryDirectory() as folder:  # on the driver alone, for as long as the copy is read
        copy = os.path.join(folder, "places.sqlite")
        for end in ("", "-wal"):
            if os.path.exists(path + end):
                shutil.copyfile(path + end, copy + end)
        db = sqlite3.connect(copy)
        marks = db.execute("select id, type, fk, parent, title, dateAdded from moz_bookmarks").fetchall()
        places = db.execute("select id, url from moz_places").fetchall()
        db.close()
    return firefox(spark.createDataFrame(marks, "id long, type long, fk long, parent long, title string, dateAdded long"), spark.createDataFrame(places, "id long, url string"))


def discover(home: str | None = None) -> list[tuple[str, str, bool]]:
    """(browser, path, is_firefox) of the stores below a home folder; a Chromium store counts once."""
    home = home or os.environ.get("HOME") or os.environ.get("USERPROFILE") or ""
    found: dict[str, tuple[str, str, bool]] = {}
    for base in (".config", "AppData/Local", "Library/Application Support"):
        for deep in ("*", "*/User Data", "*/*", "*/*/User Data"):
            for profile in ("Default", "Profile*"):
                for path in sorted(glob.glob(os.path.join(home, base, deep, profile, "Bookmarks"))):
                    browser = os.path.relpath(path, os.path.join(home, base)).split(os.sep)[0].lower()
                    found.setdefault(path, (browser, path, False))
    fox = [("firefox", p, True) for base in (".mozilla/firefox", "AppData/Roaming/Mozilla/Firefox/Profiles", "Library/Application Support/Firefox/Profiles") for p in sorted(glob.glob(os.path.join(home, base, "*/places.sqlite")))]
    return [*found.values(), *fox]


def dedupe(rows: DataFrame) -> DataFrame:
    """One row per (browser, url, folder, title), with the last row's added_at; rows have an ordinal ``n``."""
    return rows.groupBy("browser", "url", "folder", "title").agg(F.max_by("added_at", "n").alias("added_at"))
