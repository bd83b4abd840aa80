"""Files as a table: executors walk the folders (see ``walk``) and read contents."""

from __future__ import annotations

import io
import os
import re
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..operators.mirror import changed_files, missing, upsert
from ..operators.search import IMAGE_EXTENSIONS
from .walk import scan

#: Kinds of files by extension or name (fixed values).
OFFICE_EXTENSIONS = ("docx", "xlsx", "pptx")
TEXT_EXTENSIONS = (
    "md", "markdown", "txt", "rst", "org", "adoc", "tex", "csv", "tsv", "json",
    "yaml", "yml", "toml", "ini", "cfg", "conf", "xml", "html", "htm", "css",
    "scss", "less", "js", "mjs", "cjs", "ts", "jsx", "tsx", "rs", "py",
    "go", "java", "c", "cpp", "cc", "h", "hpp", "cs", "rb", "php",
    "sh", "bash", "zsh", "ps1", "psm1", "bat", "cmd", "sql", "ipynb", "vue",
    "svelte", "kt", "swift", "lua", "r", "pl", "pm", "ex", "exs", "erl",
    "hs", "ml", "mli", "scala", "clj", "cljs", "zig", "nim", "dart", "proto",
    "graphql", "gql", "dockerfile", "makefile", "gradle", "properties", "env", "log",
)
TEXT_NAMES = ("makefile", "dockerfile", "readme", "license", "justfile", "rakefile")
MAX_CHARS, DOC_BYTES = 2 << 20, 64 << 20
#: Bytes that the parts of an office file may unpack to for each byte of its limit: a small file can unpack to very much.
UNPACKED = 16


def kind(ext: Column, name: Column) -> Column:
    """image, pdf, office, text or other."""
    ext, name = F.lower(ext), F.lower(name)
    return (
        F.when(ext.isin(*IMAGE_EXTENSIONS), "image")
        .when(ext == "pdf", "pdf")
        .when(ext.isin(*OFFICE_EXTENSIONS), "office")
        .when(ext.isin(*TEXT_EXTENSIONS) | (ext.isNull() & name.isin(*TEXT_NAMES)), "text")
        .otherwise("other")
    )


def cut(text: str, limit: int) -> str:
    """At most ``MAX_CHARS`` characters; the whole text where there is no limit."""
    return text[:MAX_CHARS] if limit else text


def decode(data: bytes, limit: int) -> str | None:
    """Text of at most ``limit`` bytes (0: of any size); None if it is larger or has a NUL in its first 8 KB."""
    if limit and len(data) > limit or b"\0" in data[:8192]:
        return None
    return cut(data.decode("utf-8", "replace"), limit)


def office_text(data: bytes, limit: int = DOC_BYTES) -> str | None:
    """Text of an office file's XML parts, in the order of their names; None where they unpack to more than ``UNPACKED`` times the limit (0: no limit)."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            names = sorted(n for n in z.namelist() if re.fullmatch(r"word/document\.xml|xl/sharedStrings\.xml|ppt/slides/slide\d+\.xml", n))
            if limit and sum(z.getinfo(n).file_size for n in names) > UNPACKED * limit:
                return None  # zipfile reads no more of a part than its header says
            xml = "\n".join(z.read(n).decode("utf-8", "replace") for n in names)
    except (zipfile.BadZipFile, zlib.error, RuntimeError, NotImplementedError, EOFError, KeyError, ValueError, OSError):  # damaged or encrypted: no text
        return None
    xml = re.sub(r"</(w:p|a:p|si)>", "\n", xml)
    text = re.sub(r"<[^>]*>", "", xml)
    for name, sign in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'")):
        text = text.replace(name, sign)
    text = "\n".join(" ".join(x.split()) for x in text.split("\n") if x.split())
    return cut(text, limit) or None


def pdf_text(data: bytes, limit: int = DOC_BYTES) -> str | None:
    """Text of a PDF where a reader is installed; else None."""
    try:
        import pypdf
    except ImportError:
        return None
    try:
        text = "\n".join(p.extract_text() or "" for p in pypdf.PdfReader(io.BytesIO(data)).pages)
    except Exception:  # noqa: BLE001  a broken file has no text
        return None
    return cut(text, limit) if text.strip() else None


def read_text(path: str, kind: str, limit: int) -> str | None:
    """The text of a file of a kind; None for none, for a file beyond its limit (checked before it is read), and for one that is gone."""
    most = limit if kind == "text" else max(limit, DOC_BYTES) if limit else 0
    try:
        if most and os.path.getsize(path) > most:
            return None
        with open(path, "rb") as f:
            data = f.read()
    except OSError:
        return None
    return decode(data, limit) if kind == "text" else office_text(data, most) if kind == "office" else pdf_text(data, most)


def with_content(files: DataFrame, max_file_mb: int = 4) -> DataFrame:
    """Files with their text: images and unknown kinds have none. 0 MB means no limit.

    Executors read the files by path, as the folders are shared; paths are names, not patterns."""
    limit = max_file_mb << 20
    routed = files.drop("content").withColumn("_kind", kind(F.col("ext"), F.col("name")))
    names = [c for c in routed.columns if c != "_kind"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            for i in range(0, batch.num_rows, 64):
                rows = zip(at["path"].slice(i, 64).to_pylist(), at["_kind"].slice(i, 64).to_pylist())
                found = [read_text(p, k, limit) if k in ("text", "office", "pdf") else None for p, k in rows]
                yield pa.RecordBatch.from_arrays([*(at[n].slice(i, 64) for n in names), pa.array(found, pa.string())], [*names, "content"])

    schema = StructType([*[f for f in routed.schema.fields if f.name != "_kind"], StructField("content", StringType())])
    return routed.mapInArrow(run, schema)


def index_folders(folders: DataFrame, known: DataFrame, max_file_mb: int = 4) -> tuple[DataFrame, DataFrame]:
    """The indexed files and a report (scanned, indexed, removed; one row) of the ``folders`` (id, path).

    ``known`` has what ``scan`` gives, content and thumb. Files of the same time and size stay as they are; new and
    changed ones are read, and keep their thumbnail; files that are gone go. Write the result (``mirror.swap``)
    before the report is read again."""
    found = scan(folders)
    fresh = changed_files(found, known)
    gone = missing(known, found, "path")
    kept = known.join(gone.select("path"), "path", "left_anti").select(*known.columns)
    report = found.agg(F.count(F.lit(1)).alias("scanned")).crossJoin(fresh.agg(F.count(F.lit(1)).alias("indexed"))).crossJoin(gone.agg(F.count(F.lit(1)).alias("removed")))  # one row each
    return upsert(kept, with_content(fresh, max_file_mb), ["path"], keep=("thumb",)), report
