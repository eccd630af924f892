"""Ids and signatures over canonical JSON: sorted keys, lists sorted by their own JSON, so the order in which a writer built a payload does not count."""

from __future__ import annotations

import hashlib
import hmac
import json
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the name of the recipe, which is part of what is hashed.
ALGORITHM = "assertid-v1"


def canonical(value: Any) -> Any:
    if isinstance(value, dict):
        return {k: canonical(value[k]) for k in sorted(value)}
    if isinstance(value, list):
        return sorted((canonical(v) for v in value), key=lambda v: json.dumps(v, sort_keys=True, ensure_ascii=False))
    return value


def _dumps(value: Any) -> bytes:
    return json.dumps(value, sort_keys=True, ensure_ascii=False).encode()


def assertion_id(kind: Column, body: Column) -> Column:
    """The first 16 hex digits of the hash of an assertion's kind and body (a JSON text); null for a null body."""

    @F.pandas_udf("string")
    def make(kinds: pd.Series, bodies: pd.Series) -> pd.Series:
        one = lambda k, b: hashlib.sha256(_dumps({"algo": ALGORITHM, "kind": k, "body": canonical(json.loads(b))})).hexdigest()[:16]
        return pd.Series([None if b is None else one(k, b) for k, b in zip(kinds, bodies)], dtype="object")

    return make(kind, body)


def signature(record: Column, key: str) -> Column:
    """HMAC-SHA256 of a provenance record (a JSON object) without its own sig; null for a null record."""

    @F.pandas_udf("string")
    def make(records: pd.Series) -> pd.Series:
        one = lambda r: hmac.new(key.encode(), _dumps({k: v for k, v in json.loads(r).items() if k != "sig"}), hashlib.sha256).hexdigest()
        return pd.Series([None if r is None else one(r) for r in records], dtype="object")

    return make(record)


def landing_maturity(provenance: Column, proposed_sources: list[str]) -> Column:
    """The tier at which a memory enters: proposed where its first provenance record (a JSON object or list) is from such a source, else working."""
    source = F.coalesce(F.get_json_object(provenance, "$[0].source"), F.get_json_object(provenance, "$.source"))
    return F.when(source.isin(proposed_sources), "proposed").otherwise("working")
