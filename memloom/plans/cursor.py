"""Page cursors: opaque text that carries positions exactly and is bound to its query."""

from __future__ import annotations

import base64
import hashlib
import json
import struct
from collections.abc import Callable

MAX_BYTES = 4096
VERSION = 2


class CursorError(ValueError):
    """A cursor of another query, index generation or format."""


def score_bits(score: float) -> int:
    """The double's 64 bits; decimal text would lose some."""
    return struct.unpack("<Q", struct.pack("<d", score))[0]


def bits_score(bits: int) -> float:
    return struct.unpack("<d", struct.pack("<Q", bits))[0]


def binding(*parts: object) -> str:
    return hashlib.sha256(json.dumps(parts, sort_keys=True, ensure_ascii=False).encode()).hexdigest()


def encode(position: list, bound_to: str) -> str:
    return base64.urlsafe_b64encode(json.dumps([VERSION, position, bound_to]).encode()).decode()


def fit_page(rows: list[dict], limit: int, max_bytes: int, cursor_of: Callable[[dict], str]) -> tuple[list[dict], str | None]:
    """The leading rows whose page, its cursor included, fits into `max_bytes` as JSON, and the cursor of
    the last one if any are left. A first row that does not fit is an error.

    `rows` are the page and one more if there is a next one.
    """
    size, kept, cursor = len('{"items":[]}'), [], None
    for row in rows[:limit]:
        size += len(json.dumps(row, ensure_ascii=False, default=str).encode()) + 1
        after = cursor_of(row)
        if size + len(after) + len(',"next_cursor":""') > max_bytes:
            if not kept:
                raise CursorError("one hit exceeds the byte budget; raise it")
            break
        kept.append(row)
        cursor = after
    return kept, cursor if len(kept) < len(rows) else None


def decode(cursor: str, bound_to: str) -> list:
    try:
        if len(cursor) > MAX_BYTES:
            raise ValueError("too long")
        version, position, bound = json.loads(base64.urlsafe_b64decode(cursor.encode()))
    except ValueError as error:
        raise CursorError(f"malformed cursor: {error}") from None
    if version != VERSION or bound != bound_to:
        raise CursorError("the cursor belongs to another query or index")
    return position
