"""Words of a text, as UTF-8 bytes."""

from __future__ import annotations

#: A-Z to a-z; digits, a-z and all bytes of non-ASCII characters stay; everything else is a space.
WORD_BYTES = bytes(b | 0x20 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def words(raw: bytes) -> list[bytes]:
    """Maximal runs of ASCII letters (lower-cased), digits and non-ASCII characters."""
    return raw.translate(WORD_BYTES).split()


def spaced_words(raw: bytes) -> list[bytes]:
    """Maximal runs without ASCII white space; A-Z lower-cased."""
    return raw.lower().split()
