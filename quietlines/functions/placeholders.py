"""What stands where a value stood, in Python and as columns."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from quietlines.config import PLACEHOLDER_STARTS


def stable_hash(value: str, label: str, seed: int) -> str:
    """First ten hex digits of the SHA-256 of `seed|label|value`."""
    return hashlib.sha256(f"{seed}|{label}|{value}".encode("utf-8", "replace")).hexdigest()[:10]


def is_placeholder(value: str) -> bool:
    return value.startswith(PLACEHOLDER_STARTS)


def replacement(value: str, label: str, mode: str, seed: int) -> str:
    if mode == "remove":
        return ""
    if mode == "mask":
        return f"<REDACTED:{label}>"
    return f"<{'HASHED' if mode == 'hash' else 'REPLACED'}:{label}:{stable_hash(value, label, seed)}>"


def stable_hash_column(value: Column, label: str | Column, seed: int) -> Column:
    return F.substring(F.sha2(F.concat(F.lit(f"{seed}|"), F.lit(label) if isinstance(label, str) else label, F.lit("|"), value), 256), 1, 10)


def is_placeholder_column(value: Column) -> Column:
    first, second, third = (value.startswith(p) for p in PLACEHOLDER_STARTS)
    return first | second | third


def replacement_column(value: Column, label: Column, mode: str, seed: int) -> Column:
    if mode == "remove":
        return F.lit("")
    if mode == "mask":
        return F.concat(F.lit("<REDACTED:"), label, F.lit(">"))
    kind = "HASHED" if mode == "hash" else "REPLACED"
    return F.concat(F.lit(f"<{kind}:"), label, F.lit(":"), stable_hash_column(value, label, seed), F.lit(">"))
