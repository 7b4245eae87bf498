"""Names, keys, versions and digests, and the grammar of each."""

from __future__ import annotations

import re

from findery.errors import FinderyError, InvalidIdentifier

#: The identifier grammars.
_NAMESPACE = re.compile(r"[a-z0-9][a-z0-9._-]{0,63}")
_NAME = re.compile(r"[a-z0-9][a-z0-9._-]{0,127}")
_KEY = re.compile(r"[A-Za-z0-9][A-Za-z0-9._:-]{0,127}")
_DIGEST = re.compile(r"[0-9a-f]{64}")
MOST_VERSION = (1 << 64) - 1


def _check(pattern: re.Pattern, what: str, text: str, error: type[FinderyError]) -> str:
    if not isinstance(text, str) or not pattern.fullmatch(text):
        raise error(f"{what}: {str(text)[:64]}")
    return text


def check_namespace(text: str, error: type[FinderyError] = InvalidIdentifier) -> str:
    return _check(_NAMESPACE, "namespace", text, error)


def check_name(text: str, error: type[FinderyError] = InvalidIdentifier) -> str:
    return _check(_NAME, "name", text, error)


def check_key(text: str, error: type[FinderyError] = InvalidIdentifier) -> str:
    return _check(_KEY, "operation key", text, error)


def check_digest(text: str, error: type[FinderyError] = InvalidIdentifier) -> str:
    return _check(_DIGEST, "digest", text, error)


def check_version(number: int) -> int:
    if not isinstance(number, int) or isinstance(number, bool) or not 1 <= number <= MOST_VERSION:
        raise InvalidIdentifier(f"version: {str(number)[:64]}")
    return number


def next_version(number: int) -> int:
    return check_version(check_version(number) + 1)
