"""Import of reports: exact bytes are kept, the version decides how far the content is read."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from scalarium.functions.identity import CanonicalError, strictly

MOST_NODES, MOST_DEPTH = 4 << 20, 64


def checked(text: str) -> tuple[str | None, str | None, int]:
    """Version, what is wrong, and how many findings, of a report's JSON."""
    try:
        value = strictly(text)
    except (CanonicalError, ValueError) as e:
        return None, f"report.invalid: {e}", 0
    nodes, stack = 0, [(value, 1)]
    while stack:
        v, depth = stack.pop()
        nodes += 1
        if nodes > MOST_NODES or depth > MOST_DEPTH:
            return None, "report.resource_limit", 0
        stack += [(x, depth + 1) for x in (v.values() if isinstance(v, dict) else v if isinstance(v, list) else ())]
    version = value.get("schema_version") if isinstance(value, dict) else None
    found = value.get("findings", []) if isinstance(value, dict) else []
    return (version if isinstance(version, str) else None), None, len(found) if isinstance(found, list) else 0


def imported(files: DataFrame) -> DataFrame:
    """Reports (path, content) with sha256, version, mode (legacy, validated or inert), findings and code.

    Version 1.0 is legacy, 2.0 validated, anything else is kept and not interpreted.
    """

    @pandas_udf("struct<version:string,code:string,findings:int,sha256:string>")
    def read(content: pd.Series) -> pd.DataFrame:
        rows = []
        for data in content:
            raw = bytes(data)
            try:
                rows.append((*checked(raw.decode()), hashlib.sha256(raw).hexdigest()))
            except UnicodeDecodeError as e:
                rows.append((None, f"report.invalid: {e.reason}", 0, hashlib.sha256(raw).hexdigest()))
        return pd.DataFrame([(v, c, f, s) for v, c, f, s in rows], columns=["version", "code", "findings", "sha256"])

    mode = F.when(F.col("code").isNotNull(), "inert").when(F.col("version") == "1.0", "legacy").when(F.col("version") == "2.0", "validated").otherwise("inert")
    return files.withColumn("_r", read("content")).select("path", "content", "_r.*").withColumn("mode", mode)
