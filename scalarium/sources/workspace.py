"""Discovery of a folder's entries, and reading of its files.

Discovery runs on the driver: it is about at most ten thousand names, and Spark's own listing hides some of them and
follows links.  Contents are read by executors.
"""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scalarium.sources.decode import FILE_LIMIT

MOST_ENTRIES, MOST_DEPTH, MOST_PATH_BYTES = 10_000, 64, 4 << 20
ENTRY = "relative_path string, kind string, state string, reason string, size long"


class DiscoveryError(RuntimeError):
    """Nothing of a folder is known if a limit is met or a name isn't UTF-8."""


def discovered(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """Entries below a folder by relative path: candidates, and what is skipped or failed and why."""
    found: list[tuple] = []
    used = 0

    def walk(folder: str, prefix: str, depth: int) -> None:
        nonlocal used
        if depth > MOST_DEPTH:
            raise DiscoveryError("too deep")
        try:
            entries = sorted(os.scandir(folder), key=lambda e: e.name.encode("utf-8", "surrogateescape"))
        except OSError:
            found.append((prefix.rstrip("/"), "directory", "failed", "directory_unavailable", None))
            return
        for entry in entries:
            path = prefix + entry.name
            try:
                used += len(path.encode())
            except UnicodeEncodeError as e:
                raise DiscoveryError("a name isn't UTF-8") from e
            if len(found) >= MOST_ENTRIES or used > MOST_PATH_BYTES:
                raise DiscoveryError("too many entries")
            try:
                status = entry.stat(follow_symlinks=False)
            except OSError:
                found.append((path, "unknown", "failed", "entry_unavailable", None))
                continue
            if stat.S_ISLNK(status.st_mode):
                found.append((path, "symlink", "skipped", "symlink_not_followed", None))
            elif stat.S_ISDIR(status.st_mode):
                if recursive:
                    walk(entry.path, path + "/", depth + 1)
                else:
                    found.append((path, "directory", "skipped", "recursion_disabled", None))
            elif stat.S_ISREG(status.st_mode):
                found.append((path, "file", "candidate", None, status.st_size))
            else:
                found.append((path, "special", "skipped", "not_regular", None))

    walk(root, "", 0)
    return spark.createDataFrame(sorted(found, key=lambda r: r[0].encode()), ENTRY)


def _read(path: str, limit: int) -> tuple[int | None, bytes | None, str | None]:
    """Size, bytes and what went wrong: links aren't followed, and a file that changes while it is read is refused."""
    try:
        handle = os.open(path, os.O_RDONLY | os.O_NOFOLLOW | os.O_NONBLOCK | getattr(os, "O_CLOEXEC", 0))
    except OSError:
        return None, None, "file.unavailable"
    with os.fdopen(handle, "rb") as f:
        before = os.fstat(handle)
        if not stat.S_ISREG(before.st_mode):
            return None, None, "file.not_regular"
        if before.st_size > limit:
            return before.st_size, None, "file.too_large"
        data = f.read(limit + 1)
        after = os.fstat(handle)
        if len(data) != before.st_size or (before.st_mtime_ns, before.st_size) != (after.st_mtime_ns, after.st_size):
            return before.st_size, None, "file.changed_during_read"
        return len(data), data, None


def contents(entries: DataFrame, root: str, limit: int = FILE_LIMIT) -> DataFrame:
    """path, size, content, code of candidates.  The root must be a folder that executors see.

    Spark's own readers leave out names that begin with `_` or `.`, so files are opened by name.
    """
    base = os.path.abspath(root)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch.relative_path:  # a row at a time: a file may have megabytes
                size, data, code = _read(f"{base}/{path}", limit)
                yield pd.DataFrame({"path": [path], "size": pd.array([size], "Int64"), "content": [data], "code": [code]})

    return entries.filter("state = 'candidate'").select("relative_path").mapInPandas(run, "path string, size long, content binary, code string")


def acquisition(entries: Column, allowance: int, per_file: int = FILE_LIMIT) -> Column:
    """What a budget of bytes lets one read of an array of (path, size) in order: array of (path, state, charged).

    A file may use what is left less one; one that is larger is rejected and charges nothing, so a smaller one that
    follows is still read.
    """
    kind = "array<struct<path:string,state:string,charged:bigint>>"

    def step(s, e):
        limit = F.least(F.lit(per_file).cast("long"), s["left"] - 1)
        state = F.when(s["left"] <= 1, "execution.resource_limit").when(e["size"] <= limit, "read").when(e["size"] > per_file, "file.too_large").otherwise("execution.resource_limit")
        charged = F.when(state == "read", e["size"]).otherwise(F.lit(0).cast("long"))
        return F.struct((s["left"] - charged).alias("left"), F.concat(s["out"], F.array(F.struct(e["path"].alias("path"), state.alias("state"), charged.alias("charged")))).alias("out"))

    return F.aggregate(entries, F.struct(F.lit(allowance).cast("long").alias("left"), F.array().cast(kind).alias("out")), step, lambda s: s["out"])
