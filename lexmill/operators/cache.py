"""Stage fingerprints: what must be computed again after a change of settings."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STAGES = ("parsing", "chunking", "embedding", "summarizer", "index")
#: What a changed stage takes with it.
CASCADE = {
    "parsing": ("parsing", "chunking", "embedding", "summarizer"), "chunking": ("chunking", "embedding"), "embedding": ("embedding",), "summarizer": ("summarizer",),
    "index": ("index",),
}


def fingerprint(settings: dict) -> str:
    """SHA-256 of the settings as JSON with sorted keys. Give all that affect the stage."""
    return hashlib.sha256(json.dumps(settings, sort_keys=True, default=str).encode()).hexdigest()


def changed_stages(now: dict[str, dict], stored: dict[str, str | None]) -> set[str]:
    """Stages whose fingerprint differs or is missing."""
    return {s for s in STAGES if s in now and stored.get(s) != fingerprint(now[s])}


def invalidated(changed: set[str]) -> set[str]:
    return {x for s in changed for x in CASCADE[s]}


def still_valid(cached: DataFrame, documents: DataFrame, fingerprints: dict[str, str]) -> DataFrame:
    """Cached rows whose checksum is their document's and whose fingerprints are the present ones."""
    rows = cached
    for column, value in fingerprints.items():
        rows = rows.where(F.col(column) == value)
    return rows.join(documents.select("checksum").distinct(), "checksum", "left_semi")


def to_process(documents: DataFrame, valid: DataFrame) -> DataFrame:
    return documents.join(valid.select("checksum").distinct(), "checksum", "left_anti")


def load_fingerprints(text: str | None) -> dict[str, str]:
    """Stored fingerprints; a corrupt or missing file counts as none."""
    try:
        data = json.loads(text) if text else {}
        return {k: v for k, v in data.items() if isinstance(v, str)} if isinstance(data, dict) else {}
    except ValueError:
        return {}
