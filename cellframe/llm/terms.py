"""Terms of texts: runs of ASCII letters and digits and of anything beyond ASCII, A-Z lower-cased.

Every other ASCII character separates.  Texts are bytes of UTF-8, so the bytes beyond ASCII are kept as
they are and one translation and one split find the terms.
"""

from __future__ import annotations

from collections.abc import Iterator

#: What each byte becomes: itself if it belongs to a term, a space if not.
FOLDED = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()
#: Bytes of a long text that are split into terms at once.
STRETCH = 1 << 20


def term_stretches(text: str | None) -> Iterator[list[bytes]]:
    """The terms of ``text`` in stretches of bounded size, no term cut; null has none."""
    folded = (text or "").encode().translate(FOLDED)
    at = 0
    while at < len(folded):
        end = folded.find(b" ", at + STRETCH)
        end = len(folded) if end < 0 else end
        yield folded[at:end].split()
        at = end
