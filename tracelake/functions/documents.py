"""Small governing documents (rules, allowlists, profiles): strict JSON, one spelling, checked texts. They are read on the driver."""

from __future__ import annotations

import json
import re

MAX_DOCUMENT = 1 << 20


def _once(pairs: list[tuple[str, object]]) -> dict:
    out = dict(pairs)
    if len(out) < len(pairs):
        raise ValueError("a JSON object has a key twice")
    return out


def _no_constant(name: str) -> None:
    raise ValueError(f"{name} is no JSON number")


def read_strict(text: str | bytes, most: int = MAX_DOCUMENT) -> object:
    """A JSON document of at most so many bytes, in which no key repeats and every number is finite."""
    data = text.encode() if isinstance(text, str) else text
    if len(data) > most:
        raise ValueError(f"a document has more than {most} bytes")
    return json.loads(data.decode("utf-8"), object_pairs_hook=_once, parse_constant=_no_constant)


def canonical(value: object) -> str:
    """The one JSON text of a value: sorted keys, no spaces, characters as they are."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def checked_text(value: object, most: int = 1000) -> str:
    """value, if it is a text with something in it, of at most so many characters and without control characters."""
    if not isinstance(value, str) or not value.strip() or len(value) > most or re.search(r"[\x00-\x08\x0b-\x1f\x7f]", value):
        raise ValueError("a text is missing, too long or has control characters")
    return value


def checked_name(value: object, pattern: str = r"[A-Za-z0-9][A-Za-z0-9._-]{0,63}") -> str:
    """value, if it is a name: of a scope, a field or a file."""
    if not isinstance(value, str) or not re.fullmatch(pattern, value):
        raise ValueError(f"{value!r} is no name")
    return value
