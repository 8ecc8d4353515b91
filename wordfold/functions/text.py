"""Tokenization expressions.

Fixed values: whitespace is the ASCII set space, tab, newline, carriage return,
form feed and vertical tab; a corpus line is a text fragment between newlines.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: Java-regex form of the whitespace set (\x0B = vertical tab).
WHITESPACE_RE = r"[ \t\n\r\f\x0B]+"
# DuckDB / RE2 form of the same set.
WHITESPACE_RE_SQL = r"[ \t\n\r\f\v]+"


def tokens(line) -> Column:
    """Whitespace split with empty strings removed (leading/trailing blanks)."""
    col = F.col(line) if isinstance(line, str) else line
    return F.array_remove(F.split(col, WHITESPACE_RE), "")
