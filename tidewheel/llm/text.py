"""Small helpers on text that several operators share."""

from __future__ import annotations

#: ASCII white space, as in the contracts: space and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]+"
#: A word: a longest run of anything else.
WORD = r"[^\x20\x09-\x0D]+"


def squeeze(raw: bytes) -> bytes:
    """Each run of ASCII white space becomes one space; ends are kept, not trimmed."""
    if not raw:
        return raw
    mid = b" ".join(raw.split())
    if not mid:
        return b" "
    return b" " * raw[:1].isspace() + mid + b" " * raw[-1:].isspace()
