"""The canonical digest of an operation: SHA-256 over a domain and tagged items.

Every item is a tag and its payload; lengths and counts are 64-bit big-endian.
Integers carry a declared width, so a Python ``int`` is wrapped in ``Int``.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterable
from dataclasses import dataclass
from typing import Any

from findery.errors import UnencodableOperation

DOMAIN = b"findery.lifecycle.operation.v1\0"
#: The tags of the item grammar and the widths of integers.
UNIT, NONE, SOME, FALSE, TRUE = 0x00, 0x01, 0x02, 0x03, 0x04
UNSIGNED = {8: 0x10, 16: 0x11, 32: 0x12, 64: 0x13, 128: 0x14}
SIGNED = {8: 0x18, 16: 0x19, 32: 0x1A, 64: 0x1B, 128: 0x1C}
STRING, BYTES, SEQUENCE, MAP, VARIANT = 0x40, 0x41, 0x50, 0x51, 0x60


@dataclass(frozen=True)
class Int:
    value: int
    bits: int = 64
    signed: bool = False


@dataclass(frozen=True)
class Some:
    value: Any


@dataclass(frozen=True)
class Variant:
    """A named alternative with a payload; without one it is its name as a string."""

    name: str
    value: Any


class Unit:
    pass


def _length(n: int) -> bytes:
    return struct.pack(">Q", n)


def _tag(tag: int) -> bytes:
    return bytes([tag])


def string(text: str) -> bytes:
    raw = text.encode("utf-8")
    return _tag(STRING) + _length(len(raw)) + raw


def item(value: Any) -> bytes:
    """The canonical bytes of a value. Floats and untyped numbers have none."""
    if value is None:
        return _tag(NONE)
    if isinstance(value, Some):
        return _tag(SOME) + item(value.value)
    if value is Unit or isinstance(value, Unit):
        return _tag(UNIT)
    if isinstance(value, bool):
        return _tag(TRUE if value else FALSE)
    if isinstance(value, Int):
        tags = SIGNED if value.signed else UNSIGNED
        try:
            return _tag(tags[value.bits]) + value.value.to_bytes(value.bits // 8, "big", signed=value.signed)
        except (OverflowError, KeyError) as e:
            raise UnencodableOperation(f"{value.value} in {value.bits} bits") from e
    if isinstance(value, int):  # a plain number: unsigned, or signed where it is negative, of 64 bits
        return item(Int(value, 64, value < 0))
    if isinstance(value, str):
        return string(value)
    if isinstance(value, bytes | bytearray):
        return _tag(BYTES) + _length(len(value)) + bytes(value)
    if isinstance(value, list | tuple):
        return sequence(len(value), (item(v) for v in value))
    if isinstance(value, dict):
        return mapping((_key(k), item(v)) for k, v in value.items())
    if isinstance(value, Variant):
        return _tag(VARIANT) + string(value.name) + item(value.value)
    raise UnencodableOperation(f"no canonical form: {type(value).__name__}")


def _key(key: Any) -> bytes:
    if isinstance(key, bool) or not isinstance(key, str | int | Int):
        raise UnencodableOperation("a key must be a string or an integer")
    return item(key)


def sequence_start(count: int) -> bytes:
    return _tag(SEQUENCE) + _length(count)


def map_start(count: int) -> bytes:
    return _tag(MAP) + _length(count)


def sequence(count: int, items: Iterable[bytes]) -> bytes:
    return sequence_start(count) + b"".join(items)


def mapping(entries: Iterable[tuple[bytes, bytes]]) -> bytes:
    found = sorted(entries)
    if any(a[0] == b[0] for a, b in zip(found, found[1:], strict=False)):
        raise UnencodableOperation("a key stands twice")
    return map_start(len(found)) + b"".join(k + v for k, v in found)


def component_bits(x: float) -> Int:
    """A vector component as the bits of its 32-bit float, so -0.0 and 0.0 differ."""
    return Int(struct.unpack(">I", struct.pack(">f", x))[0], 32)


class Digest:
    """SHA-256 that takes items as they come: counts stand before elements, so members can stream."""

    def __init__(self, domain: bytes = DOMAIN):
        self._sha = hashlib.sha256(domain)

    def add(self, raw: bytes) -> Digest:
        self._sha.update(raw)
        return self

    def hex(self) -> str:
        return self._sha.hexdigest()
