"""Canonical JSON (RFC 8785) and digests of values under a domain."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf

SAFE_INTEGER = (1 << 53) - 1
SELECTION_DOMAIN = "scalarium.text-selection/1"


class CanonicalError(ValueError):
    """A JSON text that has no canonical form: repeated keys, lone surrogates, or numbers beyond doubles."""


def number(value: float) -> str:
    """A double as ECMAScript writes it: the shortest digits that give it back, plain from 1e-6 to below 1e21."""
    if not math.isfinite(value):
        raise CanonicalError("a number isn't finite")
    if value == 0:
        return "0"
    sign, text = ("-", repr(-value)) if value < 0 else ("", repr(value))
    mantissa, _, exponent = text.partition("e")
    whole, _, fraction = mantissa.partition(".")
    fraction = "" if fraction == "0" else fraction
    digits = (whole + fraction).lstrip("0")
    point = len(whole) + int(exponent or 0) - (len(whole + fraction) - len(digits))  # digits before the point
    digits = digits.rstrip("0")
    n = len(digits)
    if n <= point <= 21:
        return sign + digits + "0" * (point - n)
    if 0 < point <= 21:
        return f"{sign}{digits[:point]}.{digits[point:]}"
    if -6 < point <= 0:
        return f"{sign}0.{'0' * -point}{digits}"
    tail = f"e{'+' if point > 0 else '-'}{abs(point - 1)}"
    return sign + digits[0] + ("." + digits[1:] if n > 1 else "") + tail


def _pairs(pairs: Iterable[tuple[str, object]]) -> dict:
    out: dict = {}
    for key, value in pairs:
        if key in out:
            raise CanonicalError(f"the key {key!r} is repeated")
        out[key] = value
    return out


def _quoted(text: str) -> str:
    try:
        text.encode()
    except UnicodeEncodeError as e:
        raise CanonicalError("a surrogate stands alone") from e
    return json.dumps(text, ensure_ascii=False)


def _written(value: object) -> str:
    if value is None or isinstance(value, bool):
        return {None: "null", True: "true", False: "false"}[value]
    if isinstance(value, str):
        return _quoted(value)
    if isinstance(value, (int, float)):
        return number(float(value))
    if isinstance(value, dict):
        keys = sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"))
        return "{" + ",".join(f"{_quoted(k)}:{_written(value[k])}" for k in keys) + "}"
    return "[" + ",".join(map(_written, value)) + "]"


def canonical(text: str) -> str:
    """The canonical form of a JSON text."""
    return _written(strictly(text))


def strictly(text: str) -> object:
    """A JSON text's value, without what JSON readers often let pass: repeated keys, NaN, infinities."""

    def refuse(what: str) -> float:
        raise CanonicalError(f"{what} isn't JSON")

    return json.loads(text, object_pairs_hook=_pairs, parse_constant=refuse, parse_int=float)


def digest(domain: str, value: str) -> str:
    """SHA-256 of the canonical form of {domain, value}; value is a JSON text."""
    strictly(value)
    return hashlib.sha256(canonical(f'{{"domain":{json.dumps(domain)},"value":{value}}}').encode()).hexdigest()


def canonical_json(text: Column) -> Column:
    @pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else canonical(t))

    return run(text)


def domain_digest(domain: str, value: Column) -> Column:
    @pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else digest(domain, v))

    return run(value)


def ascii_json(text: Column) -> Column:
    """JSON with everything beyond ASCII escaped."""

    @pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else json.dumps(json.loads(t), ensure_ascii=True, separators=(",", ":")))

    return run(text)


def selection(text: str, spans: list[tuple[int, int]]) -> str:
    """Digest of exact spans of a text: each with its character and byte bounds and its characters."""
    told, last = [], 0
    for a, b in spans:
        if not last <= a < b <= len(text):
            raise ValueError("spans are empty, overlap or lie outside")
        last = b
        first = len(text[:a].encode())
        told.append({"span": {"scalar": {"start": a, "end": b}, "byte": {"start": first, "end": first + len(text[a:b].encode())}}, "text": text[a:b]})
    if not told:
        raise ValueError("no spans")
    return digest(SELECTION_DOMAIN, json.dumps(told))


def selection_digest(text: Column, spans: Column) -> Column:
    """selection() of a text and its spans (an array of pairs); null for a null text and where there are no spans."""

    @pandas_udf("string")
    def run(texts: pd.Series, chosen: pd.Series) -> pd.Series:
        return pd.Series([None if t is None or c is None or not len(c) else selection(t, [(int(a), int(b)) for a, b in c]) for t, c in zip(texts, chosen, strict=True)], dtype=object)

    return run(text, spans)
