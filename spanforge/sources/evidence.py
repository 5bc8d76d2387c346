"""The evidence file: family contracts, their validators, benign taxonomies and the allowlist."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from spanforge.functions.canonical import canonical_json, sha256_text
from spanforge.functions.codecs import VALIDATORS

MAX_BYTES = 16 << 20
FIELDS = {"schema", "families", "validators", "benign_taxonomies", "classification_allowlist"}
CONTRACTS = "family string, pattern string, validator string, delimiter string, removable array<bigint>"


@dataclass(frozen=True)
class Evidence:
    """``contracts`` as ``generation.generate`` takes them; ``taxonomies`` and ``allowlist`` are None where the file has none."""

    contracts: DataFrame
    taxonomies: frozenset[str] | None
    allowlist: frozenset[str] | None
    digest: str


def read_evidence(spark: SparkSession, content: bytes, schema: str) -> Evidence:
    """A file of at most ``MAX_BYTES``, so that it is read on the driver; unknown fields, families or validators are refused."""
    if len(content) > MAX_BYTES:
        raise ValueError("evidence file too large")
    document = json.loads(content)
    if not isinstance(document, dict) or document.get("schema") != schema or not isinstance(document.get("families"), dict) or set(document) - FIELDS:
        raise ValueError("not an evidence file of this schema")
    families, validators = document["families"], document.get("validators") or {}
    for family, name in validators.items():
        if family not in families or name not in VALIDATORS:
            raise ValueError(f"validator {name!r} of family {family!r}")
    taxonomies = document.get("benign_taxonomies")
    if taxonomies is not None and not all(t.strip() for t in taxonomies):
        raise ValueError("blank benign taxonomy")
    rows = []
    for family, contract in families.items():
        if contract.get("pattern") is not None:
            re.compile(contract["pattern"])
        segments = contract.get("segments") or {}
        rows.append((family, contract.get("pattern"), validators.get(family), segments.get("delimiter"), segments.get("removable")))
    allowlist = frozenset(families) if document.get("classification_allowlist") else None
    return Evidence(spark.createDataFrame(rows, CONTRACTS), None if taxonomies is None else frozenset(taxonomies), allowlist, sha256_text(canonical_json(document)))
