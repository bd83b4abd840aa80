"""Starred repositories and model files over HTTP; the transport is a parameter, so tests need no network."""

from __future__ import annotations

import http.client
import importlib
import json
import os
import re
import sys
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

API, PAGE, MOST_PAGES = "https://api.github.com", 100, 200
REPO_SCHEMA = "id long, full_name string, description string, language string, topics array<string>, stars long, html_url string, homepage string, archived boolean, fork boolean, starred_at string, pushed_at string"
Fetch = Callable[[str, dict], tuple[int, dict, bytes]]


def fetch(url: str, headers: dict) -> tuple[int, dict, bytes]:
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=30) as r:
            return r.status, {k.lower(): v for k, v in r.headers.items()}, r.read()
    except urllib.error.HTTPError as e:
        return e.code, {k.lower(): v for k, v in e.headers.items()}, e.read()


def headers(token: str) -> dict:
    return {"Authorization": f"Bearer {token.strip()}", "Accept": "application/vnd.github.star+json", "X-GitHub-Api-Version": "2022-11-28", "User-Agent": "sparkfind"}


class RateLimited(RuntimeError):
    """The server takes no more requests before ``reset`` (seconds of the epoch, if it says so)."""

    def __init__(self, reset: str | None):
        super().__init__(f"the rate limit is used up until {reset}")
        self.reset = reset

    def __reduce__(self):
        return RateLimited, (self.reset,)


def limited(status: int, head: dict) -> bool:
    return status in (403, 429) and head.get("x-ratelimit-remaining") == "0"


def check_limit(status: int, head: dict) -> None:
    if status == 401:
        raise PermissionError("the token was refused")
    if limited(status, head):
        raise RateLimited(head.get("x-ratelimit-reset"))
    if status >= 400 and status != 404:
        raise RuntimeError(f"HTTP status {status}")


def viewer_login(token: str, get: Fetch = fetch) -> str:
    """The name of the token's owner; an error where the token is refused."""
    status, head, body = get(f"{API}/user", headers(token))
    check_limit(status, head)
    return json.loads(body)["login"]


# ------------------------------------------------------------------ starred repositories
def starred_page(get: Fetch, token: str, api: str, page: int) -> tuple[dict, list]:
    """Headers and items of a page of the listing."""
    status, head, body = get(f"{api}/user/starred?per_page={PAGE}&page={page}", headers(token))
    check_limit(status, head)
    return head, json.loads(body)


def last_page(get: Fetch, token: str, api: str, most: int | None = MOST_PAGES) -> int:
    """The listing's last page, at most ``most`` (None: whichever it is): as the first page's link header names it, else by trying pages: a page short of ``PAGE`` items ends the listing."""
    head, items = starred_page(get, token, api, 1)
    most = sys.maxsize if most is None else most
    if named := re.search(r'[?&]page=(\d+)[^>]*>;\s*rel="last"', head.get("link", "")):
        return max(1, min(most, int(named.group(1))))
    full, low = len(items) == PAGE, 1
    step = 1
    while full and low < most:  # doubling, then halving: two requests for each doubling of the number
        at = min(most, low + step)
        n = len(starred_page(get, token, api, at)[1])
        if n == PAGE:
            low, step = at, step * 2
        else:
            high = at  # the listing ends at this page or before
            while high - low > 1:
                mid = (low + high) // 2
                n = len(starred_page(get, token, api, mid)[1])
                low, high = (mid, high) if n == PAGE else (low, mid)
            return high
    return low


def transport(name: str | None) -> Fetch:
    """The function ``module:function`` that sends requests; by default ``fetch``."""
    if not name:
        return fetch
    module, function = name.split(":")
    return getattr(importlib.import_module(module), function)


class Pages(InputPartition):
    """A run of pages."""

    def __init__(self, numbers: range):
        super().__init__(numbers)


class StarredReader(DataSourceReader):
    """A partition a page, or of more than ``MOST_PAGES`` pages as many runs of them at most. The driver asks only how many pages there are; tasks fetch the pages, and a refused or limited request fails its task with the reason."""

    def __init__(self, options: dict):
        self.token, self.name = options.get("token", ""), options.get("transport")
        self.api = options.get("endpoint", API).rstrip("/")
        self.most = int(options["pages"]) if "pages" in options else None

    def partitions(self) -> list[InputPartition]:
        last = last_page(transport(self.name), self.token, self.api, self.most)
        run = -(-last // MOST_PAGES)
        return [Pages(range(n, min(n + run, last + 1))) for n in range(1, last + 1, run)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for n in partition.value:
            for x in starred_page(transport(self.name), self.token, self.api, n)[1]:
                r = x["repo"]
                yield (
                    r["id"], r["full_name"], r.get("description"), r.get("language"), r.get("topics") or [], r.get("stargazers_count", 0), r["html_url"],
                    r.get("homepage") or None, bool(r.get("archived")), bool(r.get("fork")), x.get("starred_at"), r.get("pushed_at"),
                )


class StarredSource(DataSource):
    """``spark.read.format("starred")`` with the options token, endpoint, pages (at most so many; without it all) and transport (``module:function``, for tests)."""

    @classmethod
    def name(cls) -> str:
        return "starred"

    def schema(self) -> str:
        return REPO_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return StarredReader({k.lower(): v for k, v in self.options.items()})


def list_starred(spark: SparkSession, token: str, **options: str) -> DataFrame:
    """All starred repositories, read by executors (see ``StarredSource``)."""
    spark.dataSource.register(StarredSource)
    return spark.read.format("starred").options(token=token, **options).load()


# ------------------------------------------------------------------ READMEs
#: Requests that a task sends at a time, and characters of a README that are kept.
AT_ONCE, README_CHARS = 8, 64 << 10
FETCHED = "id long, state string, etag string, readme string, detail string"


def fetch_readme(get: Fetch, token: str, name: str, etag: str | None) -> tuple[str, str | None, str | None, str | None]:
    """state, etag, readme and detail of one README. Nothing that a server or the line does is raised: fresh (200), not_modified (304),
    missing (404), limited (no more requests for now), or error, with what it was."""
    head = headers(token) | {"Accept": "application/vnd.github.raw+json"} | ({"If-None-Match": etag} if etag else {})
    try:
        status, got, body = get(f"{API}/repos/{name}/readme", head)
    except (OSError, http.client.HTTPException) as e:  # no connection, a timeout, a broken answer
        return "error", None, None, f"{type(e).__name__}: {e}"
    if limited(status, got):
        return "limited", None, None, got.get("x-ratelimit-reset")
    if status == 200:
        return "fresh", got.get("etag"), body.decode("utf-8", "replace")[:README_CHARS], None
    if status in (304, 404):
        return "not_modified" if status == 304 else "missing", got.get("etag"), None, None
    return "error", None, None, f"HTTP status {status}"


def fetch_readmes(targets: DataFrame, token: str, get: Fetch = fetch, budget: int | None = None) -> DataFrame:
    """id, state, etag, readme, detail: one row for every one of ``targets`` (id, full_name, etag), whatever came of it (see ``fetch_readme``).

    Executors send the requests, a task ``AT_ONCE`` at a time. ``budget`` is the number of requests of all tasks: each
    has its share, and rows beyond it are limited without a request, as are a task's rows after the server has refused one for its limit."""
    tasks = max(1, min(targets.sparkSession.sparkContext.defaultParallelism, budget or 1))
    share = None if budget is None else budget // tasks

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sent, closed = 0, None
        with ThreadPoolExecutor(AT_ONCE) as pool:
            for rows in parts:
                todo, found = list(zip(rows["full_name"], rows["etag"], strict=True)), []
                while todo:
                    n = AT_ONCE if share is None else min(AT_ONCE, share - sent)
                    if closed or n <= 0:
                        found += [("limited", None, None, closed)] * len(todo)
                        break
                    got = list(pool.map(lambda x: fetch_readme(get, token, *x), todo[:n]))
                    todo, sent = todo[n:], sent + len(got)
                    found += got
                    closed = next((d or "0" for s, _, _, d in got if s == "limited"), closed)
                yield rows[["id"]].assign(**{c: pd.Series([f[i] for f in found], index=rows.index, dtype=object) for i, c in enumerate(("state", "etag", "readme", "detail"))})

    rows = targets.select("id", "full_name", "etag")
    return (rows if budget is None else rows.repartition(tasks)).mapInPandas(run, FETCHED)


def file_url(repo: str, path: str, endpoint: str | None = None) -> str:
    endpoint = (endpoint or os.environ.get("HF_ENDPOINT") or "https://huggingface.co").strip().rstrip("/")
    return f"{endpoint}/{repo}/resolve/main/{path}"


def fetch_parts(url: str, headers: dict, size: int = 1 << 20) -> tuple[int, dict, Iterator[bytes]]:
    """As ``fetch``, with the body in parts."""
    request = urllib.request.Request(url, headers=headers)
    try:
        r = urllib.request.urlopen(request, timeout=30)
    except urllib.error.HTTPError as e:
        return e.code, {k.lower(): v for k, v in e.headers.items()}, iter(())

    def parts() -> Iterator[bytes]:
        with r:
            while part := r.read(size):
                yield part

    return r.status, {k.lower(): v for k, v in r.headers.items()}, parts()


def fetch_file(url: str, path: str, get: Callable[[str, dict], tuple[int, dict, Iterable[bytes]]] = fetch_parts, tries: int = 4, pause: float = 2.0) -> str:
    """Downloads to ``path`` unless it is there: writes what comes to a part, goes on from it, retries, renames when whole.

    A part that the server can't go on from is deleted."""
    if os.path.exists(path):
        return path
    part = path + ".part"
    for i in range(tries):
        have = os.path.getsize(part) if os.path.exists(part) else 0
        try:
            status, head, body = get(url, {"Range": f"bytes={have}-"} if have else {})
            if status == 416:
                os.remove(part)
            if status not in (200, 206):
                raise OSError(f"HTTP status {status}")
            start = int(head.get("content-range", "bytes 0-").split()[1].split("-")[0]) if status == 206 else 0
            if start not in (0, have):
                os.remove(part)
                raise OSError("the server sent another range")
            with open(part, "r+b" if start else "wb") as f:
                f.seek(start)
                for data in body:
                    f.write(data)
                f.truncate()
            if "content-length" in head and os.path.getsize(part) != start + int(head["content-length"]):
                raise OSError("the file is short")
            os.replace(part, path)
            return path
        except (OSError, http.client.HTTPException):
            if i == tries - 1:
                raise
            time.sleep(pause)
    return path
