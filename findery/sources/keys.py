"""Storage keys: the same grammar as strings and as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from findery.errors import CorruptSnapshot

_DIGITS = re.compile(r"[0-9]{20}")
_MOST = (1 << 64) - 1


def version_key(namespace: Column, name: Column, version: Column) -> Column:
    return F.concat_ws("/", namespace, name, F.lpad(version.cast("string"), 20, "0"))


staging_key = version_key


def operation_key(namespace: Column, name: Column, key: Column) -> Column:
    return F.concat_ws("/", namespace, name, key)


def head(namespace: str, name: str) -> str:
    return f"{namespace}/{name}"


def index_prefix(namespace: str, name: str) -> str:
    return f"{namespace}/{name}/"


def version(namespace: str, name: str, number: int) -> str:
    return f"{namespace}/{name}/{number:020d}"


def operation(namespace: str, name: str, key: str) -> str:
    return f"{namespace}/{name}/{key}"


def quarantine(sequence: int, namespace: str, name: str, number: int, part: str) -> str:
    return f"{sequence:020d}/{namespace}/{name}/{number:020d}/{part}"


def decimal(text: str) -> int:
    """Exactly twenty digits that fit 64 bits."""
    if not _DIGITS.fullmatch(text) or int(text) > _MOST:
        raise CorruptSnapshot(f"not a number key: {text[:64]}")
    return int(text)


def _split(key: str, count: int) -> list[str]:
    parts = key.split("/")
    if len(parts) != count or not all(parts):
        raise CorruptSnapshot(f"not a key: {key[:64]}")
    return parts


def parse_head(key: str) -> tuple[str, str]:
    from findery.plans.identity import check_name, check_namespace

    namespace, name = _split(key, 2)
    return check_namespace(namespace, CorruptSnapshot), check_name(name, CorruptSnapshot)


def parse_version(key: str) -> tuple[str, str, int]:
    namespace, name, number = _split(key, 3)
    found = decimal(number)
    if not found:
        raise CorruptSnapshot("version 0")
    return *parse_head(f"{namespace}/{name}"), found


parse_staging = parse_version


def parse_operation(key: str) -> tuple[str, str, str]:
    from findery.plans.identity import check_key

    namespace, name, own = _split(key, 3)
    return *parse_head(f"{namespace}/{name}"), check_key(own, CorruptSnapshot)


def parse_quarantine(key: str) -> tuple[int, str, str, int, str]:
    sequence, namespace, name, number, part = _split(key, 5)
    if part not in ("marker", "payload"):
        raise CorruptSnapshot(f"not a quarantine part: {part[:64]}")
    found = decimal(sequence)
    if not found:
        raise CorruptSnapshot("sequence 0")
    return found, *parse_version(f"{namespace}/{name}/{number}"), part
