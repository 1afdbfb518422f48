"""Character classes that Spark's and DuckDB's regular expressions read alike, and translation tables made from the Unicode database."""

from __future__ import annotations

import functools
import unicodedata

#: White space of str.split() and str.strip(), for use inside brackets.
WS = r"\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: The same, each as it is.
BLANKS = "".join(chr(c) for c in range(0x10000) if chr(c).isspace())
#: A word character: letter, number or underscore, but no combining mark.
WORD = r"\p{L}\p{N}_"
TONES = "̀́̄"


def _without(c: str, tones_only: bool) -> str:
    marks = TONES if tones_only else None
    kept = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn" or (marks and x not in marks))
    return unicodedata.normalize("NFC", kept)


@functools.cache
def strip_table(tones_only: bool = False) -> tuple[str, str]:
    """From and to strings for translate(): every single character that stripping turns into another one."""
    pairs = []
    for code in range(0xC0, 0x10000):
        c = chr(code)
        if unicodedata.decomposition(c) and not unicodedata.decomposition(c).startswith("<"):
            bare = _without(c, tones_only)
            if bare != c and len(bare) == 1:
                pairs.append((c, bare))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)
