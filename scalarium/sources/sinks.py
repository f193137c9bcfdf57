"""Sinks: JSON lines, reports for people, and bundles of files with a manifest that is written last."""

from __future__ import annotations

import hashlib
import json
import os
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from scalarium.functions import identity

MOST_FILES = 64
NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]{0,127}")


def write_json_lines(lines: DataFrame, path: str) -> None:
    """Lines (part, _key, line) in order, ASCII only, in a folder that must not exist; its files follow one another by name."""
    told = lines.withColumn("line", identity.ascii_json(F.col("line")))
    told.orderBy("part", "_key").select("line").write.mode("errorifexists").text(path)


def console(found: DataFrame, most: int = 8) -> str:
    """A report of one source's findings, all of them; they come to the driver a partition at a time."""
    out = []
    for r in found.orderBy("id").toLocalIterator():
        shown = ", ".join(map(str, r["positions"][:most])) + (", ..." if len(r["positions"]) > most else "")
        out.append(f"[{r['severity']}] {r['id']}: {r['title']}" + (f" at {shown}" if shown else ""))
    return "\n".join(out) or "no reported findings (which is no proof that there is nothing)"


def write_bundle(folder: str, files: dict[str, bytes]) -> dict:
    """Files and, last, manifest.json with their sizes and digests, in a new folder; nothing stays if one can't be written."""
    if len(files) > MOST_FILES or not all(NAME.fullmatch(n) and n != "manifest.json" for n in files):
        raise ValueError("too many files, or a name that isn't portable")
    if len({n.casefold() for n in files}) < len(files):
        raise ValueError("names that differ by case alone")
    os.mkdir(folder)
    written = []
    try:
        told = [{"name": n, "bytes": len(b), "sha256": hashlib.sha256(b).hexdigest()} for n, b in sorted(files.items())]
        for name, data in [*sorted(files.items()), ("manifest.json", json.dumps({"files": told}).encode())]:
            with open(f"{folder}/{name}", "xb") as f:
                written.append(name)
                f.write(data)
    except OSError:
        for name in written:
            os.unlink(f"{folder}/{name}")
        os.rmdir(folder)
        raise
    return {"files": told}


def folded(path: Column) -> Column:
    """A path as case-insensitive file systems may see it: NFC, fully case-folded, and NFC again."""

    @pandas_udf("string")
    def run(paths: pd.Series) -> pd.Series:
        form = lambda t: unicodedata.normalize("NFC", t)
        return paths.map(lambda t: None if t is None else form(form(t).casefold()))

    ascii_only = F.octet_length(path) == F.length(path)
    return F.when(ascii_only, F.lower(path)).otherwise(run(F.when(~ascii_only, path)))


def colliding_paths(paths: DataFrame) -> DataFrame:
    """Paths that are equal once normalised and folded: fold, n, paths."""
    return paths.select("path", folded(F.col("path")).alias("fold")).groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("path")).alias("paths")).filter("n > 1")
