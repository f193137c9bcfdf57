"""Registration of profiles: closed definitions that never change once known by their id and version."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession

from scalarium.functions.identity import canonical, strictly
from scalarium.operators.profiles import ASSESSMENTS

MOST_PROFILES, MOST_BYTES = 128, 256 << 10
_ID = re.compile(r"[a-z0-9][a-z0-9._-]{0,63}")
_RULE = {"id", "revision", "kind", "assessment", "queue", "facts"}


class RegistryError(ValueError):
    pass


class Registry:
    """Profiles by id and version, and their rules as tables."""

    def __init__(self):
        self.profiles: dict[tuple[str, str], tuple[str, dict]] = {}
        self.rules: dict[tuple[str, int], str] = {}

    def register(self, text: str) -> str:
        """Takes in a definition (JSON) and gives its digest; the same definition again is no error, another under its name is."""
        if len(text.encode()) > MOST_BYTES:
            raise RegistryError("profile.too_large")
        value = strictly(text)
        if not isinstance(value, dict) or set(value) != {"id", "version", "scope", "rules"} or not isinstance(value["rules"], list):
            raise RegistryError("profile.schema")
        if not all(isinstance(value[k], str) and value[k] for k in ("id", "version", "scope")) or not _ID.fullmatch(value["id"]):
            raise RegistryError("profile.schema")
        digest = hashlib.sha256(canonical(text).encode()).hexdigest()
        key = (value["id"], value["version"])
        if key in self.profiles:
            if self.profiles[key][0] != digest:
                raise RegistryError("profile.changed")
            return digest
        if len(self.profiles) >= MOST_PROFILES:
            raise RegistryError("profile.limit")
        fresh: dict[tuple[str, int], str] = {}
        for rule in value["rules"]:
            if not isinstance(rule, dict) or not set(rule) <= _RULE or not _RULE - {"queue"} <= set(rule) or rule["assessment"] not in ASSESSMENTS or rule.get("queue") not in (None, "retain") or not isinstance(rule["facts"], list):
                raise RegistryError("rule.schema")
            name = (rule["id"], int(rule["revision"]))
            own = hashlib.sha256(repr(sorted((k, str(v)) for k, v in rule.items())).encode()).hexdigest()
            if name in fresh or self.rules.get(name, own) != own:
                raise RegistryError("rule.conflict")
            fresh[name] = own
        self.rules |= fresh
        self.profiles[key] = (digest, value)
        return digest

    def tables(self, spark: SparkSession, profile: str, version: str) -> tuple[str, DataFrame, DataFrame]:
        """Scope, rules and rule facts of a profile, as operators.profiles takes them."""
        _, value = self.profiles[profile, version]
        rules = [(r["id"], r["kind"], r["assessment"], r.get("queue")) for r in value["rules"]]
        facts = [(r["id"], str(f)) for r in value["rules"] for f in r["facts"]]
        return value["scope"], spark.createDataFrame(rules, "rule_id string, kind string, assessment string, queue string"), spark.createDataFrame(facts, "rule_id string, fact string")
