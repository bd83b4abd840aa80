"""A walk of folders by executors, in rounds of directories, with ignore rules inherited down the tree.

A task lists the directories that it is given and goes down into them until it has seen ``AT_ONCE`` entries; what is left
are the next round's directories, dealt anew over the tasks, so a wide tree is walked by many and a small one in one round.
Each directory comes with the rules that hold there. Rounds are written to the shared folder; the driver sees the
registered folders and counts. The folders must be reachable from all executors under the same paths.

Ignore files are ``.ignore`` and ``.gitignore`` in a directory or above it, and ``.git/info/exclude``. Rules of the first kind come before all of
the second, those before the third; within a kind the deepest directory's decide, and in a file the last rule that matches. An
ignored directory is not entered, so nothing in it can be included again. Names that begin with a dot are left out unless a
rule includes them. Links are not followed and not listed.
"""

from __future__ import annotations

import functools
import json
import os
import re
import stat
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.snapshots import scratch

#: Entries that a task sees before it hands directories on.
AT_ONCE = 20_000
#: Ignore files in the order of their precedence.
KINDS = (".ignore", ".gitignore", os.path.join(".git", "info", "exclude"))
SCANNED = "folder_id long, path string, name string, ext string, size long, mtime long"
_ROUND = SCANNED + ", directory binary, rules string"


def pattern(glob: str) -> str:
    """The regular expression of a glob: ``*`` and ``?`` stop at slashes, ``**`` between slashes stands for any directories."""
    out, i, n = "", 0, len(glob)
    while i < n:
        c = glob[i]
        if c == "*":
            j = i
            while j < n and glob[j] == "*":
                j += 1
            whole = j - i == 2 and (i == 0 or glob[i - 1] == "/") and (j == n or glob[j] == "/")
            if whole and j < n:  # any directories, or none
                out, i = out + "(?:[^/]+/)*", j + 1
                continue
            out += ".+" if whole else "[^/]*"
            i = j
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[":
            j = i + 1 + (i + 1 < n and glob[i + 1] in "!^")
            j += j < n and glob[j] == "]"  # a bracket in the first place is one of the characters
            while j < n and glob[j] != "]":
                j += 2 if glob[j] == "\\" else 1
            if j >= n:
                return r"(?!)"  # an open class matches nothing
            body = glob[i + 1 : j]
            negated = body[:1] in ("!", "^")
            body = re.sub(r"\\(.)", r"\1", body[negated:])
            parts = [re.escape(x) if x != "-" or at in (0, len(body) - 1) else "-" for at, x in enumerate(body)]
            out += f"(?!/)[{'^' if negated else ''}{''.join(parts)}]"
            i = j + 1
        elif c == "\\":
            if i + 1 == n:
                return r"(?!)"
            out, i = out + re.escape(glob[i + 1]), i + 2
        else:
            out, i = out + re.escape(c), i + 1
    return out


@functools.lru_cache(4096)
def rule(line: str) -> tuple[re.Pattern, bool, bool] | None:
    """A line of an ignore file as (expression for paths below its directory, for directories only, includes); None for blanks and comments."""
    line = line.rstrip("\r\n")
    while line.endswith(" ") and not line.endswith("\\ "):
        line = line[:-1]
    if not line or line.startswith("#"):
        return None
    includes = line.startswith("!")
    line = line[includes:]
    only = line.endswith("/")
    line = line[:-1] if only else line
    if not line:
        return None
    anchored = "/" in line
    line = line.removeprefix("/")
    try:
        return re.compile(("" if anchored else "(?:[^/]+/)*") + pattern(line), re.S), only, includes
    except re.error:  # a class with a range that ends before it begins
        return None


def decided(lines: list[str], path: str, is_dir: bool) -> bool | None:
    """Whether the lines of a file ignore a path below its directory; None where no rule matches."""
    for line in reversed(lines):
        found = rule(line)
        if found and (is_dir or not found[1]) and found[0].fullmatch(path):
            return not found[2]
    return None


def shown(rules: list[list], path: str, is_dir: bool) -> bool:
    """Whether the walk lists a path. ``rules``: for each kind its (directory, lines), the deepest last."""
    for kind in rules:
        for base, lines in reversed(kind):
            verdict = decided(lines, path[len(base.rstrip("/")) + 1 :], is_dir)
            if verdict is not None:
                return not verdict
    return not os.path.basename(path).startswith(".")


def with_rules(rules: list[list], directory: str) -> list[list]:
    """``rules`` with those of the ignore files in ``directory``."""
    out = []
    for name, kind in zip(KINDS, rules, strict=True):
        try:
            with open(os.path.join(directory, name), encoding="utf-8", errors="replace") as f:
                kind = [*kind, [directory, f.read().split("\n")]]
        except OSError:
            pass
        out.append(kind)
    return out


def inherited(directory: str) -> list[list]:
    """The rules of all directories above one."""
    above, at = [], directory
    while os.path.dirname(at) != at:
        at = os.path.dirname(at)
        above.append(at)
    return functools.reduce(with_rules, reversed(above), [[] for _ in KINDS])


def plain(path: str) -> str:
    """A path as text: bytes that are no UTF-8 are replaced."""
    return os.fsencode(path).decode("utf-8", "replace")


def listed(folder_id: int, directory: bytes, rules: str | None, most: int) -> Iterator[tuple]:
    """Rows of one directory and those below it, until ``most`` entries were seen: files, then the directories that are left."""
    top = os.fsdecode(directory)
    todo, seen = [(top, inherited(top) if rules is None else json.loads(rules))], 0
    while todo and seen < most:
        at, above = todo.pop()
        own = with_rules(above, at)
        try:
            entries = os.scandir(at)
        except OSError:  # gone, or not to be read
            continue
        with entries:
            for e in entries:
                seen += 1
                try:
                    st = e.stat(follow_symlinks=False)
                except OSError:
                    continue
                is_dir = stat.S_ISDIR(st.st_mode)
                if not (is_dir or stat.S_ISREG(st.st_mode)) or not shown(own, e.path, is_dir):
                    continue
                if is_dir:
                    todo.append((e.path, own))
                else:
                    name = plain(e.name)
                    yield folder_id, plain(e.path), name, os.path.splitext(name)[1][1:].lower() or None, st.st_size, max(0, int(st.st_mtime)), None, None
    for at, above in todo:
        yield folder_id, None, None, None, None, None, os.fsencode(at), json.dumps(above)


def scan(folders: DataFrame, at_once: int = AT_ONCE) -> DataFrame:
    """folder_id, path, name, ext, size, mtime of the files below the ``folders`` (id, path)."""
    spark, store = folders.sparkSession, scratch(folders.sparkSession, "walk")
    columns = ["folder_id", "path", "name", "ext", "size", "mtime", "directory", "rules"]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows: list[tuple] = []
            for folder_id, directory, rules in zip(part["folder_id"], part["directory"], part["rules"], strict=True):
                for row in listed(int(folder_id), bytes(directory), rules, at_once):
                    rows.append(row)
                    if len(rows) == 10_000:
                        yield pd.DataFrame(rows, columns=columns, dtype=object)
                        rows = []
            yield pd.DataFrame(rows, columns=columns, dtype=object)

    todo = folders.select(F.col("id").alias("folder_id"), F.rtrim("path", F.lit("/")).cast("binary").alias("directory"), F.lit(None).cast("string").alias("rules"))
    todo = todo.withColumn("directory", F.when(F.length("directory") == 0, F.lit("/").cast("binary")).otherwise(F.col("directory")))
    done, i = [], 0
    while True:
        tasks = spark.sparkContext.defaultParallelism
        todo.repartition(tasks, "directory").mapInPandas(run, _ROUND).write.parquet(f"{store}/{i}")
        done.append(spark.read.schema(_ROUND).parquet(f"{store}/{i}"))
        todo, i = done[-1].filter("directory is not null").select("folder_id", "directory", "rules"), i + 1
        if not todo.limit(1).count():
            break
    files = functools.reduce(DataFrame.unionByName, done).filter("directory is null").drop("directory", "rules")
    return files
