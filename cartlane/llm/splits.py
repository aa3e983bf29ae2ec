"""The split of byte-level BPE vocabularies into words."""

from __future__ import annotations

import re

# --- fixed values of the vocabulary -------------------------------------------
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# ------------------------------------------------------------------------------
# The same split for texts of Latin-1, where explicit classes let the standard library's faster engine run; the
# alternatives begin with different characters (but for the contractions), so the commonest may come first.
LETTERS, NUMBERS = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", r"0-9\xb2\xb3\xb9\xbc-\xbe"
BLANK = r"\t-\r \x85\xa0"
LATIN = re.compile(f" ?[{LETTERS}]+|'(?:[stmd]|re|ve|ll)| ?[{NUMBERS}]+| ?[^{BLANK}{LETTERS}{NUMBERS}]+"
                   f"|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]+")


def is_latin(text: str) -> bool:
    try:
        text.encode("latin-1")
        return True
    except UnicodeEncodeError:
        return False
