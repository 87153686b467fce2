"""Text helpers that follow Unicode white space rather than the ASCII blank."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680"
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)


def trimmed(value: Column | str) -> Column:
    """Text without white space around it. A column given by name is left alone where it starts and ends with a plain mark: trimming
    looks either end up among all of WHITE. Other expressions would be made once for each look."""
    if not isinstance(value, str):
        return F.btrim(value, F.lit(WHITE))
    return trimmed_text(F.col(value))


def trimmed_text(text: Column) -> Column:
    """The same of a column, or of a member of a lambda's variable, which costs nothing to name again."""
    plain = (text == "") | (F.ascii(text).between(33, 126) & F.ascii(F.right(text, F.lit(1))).between(33, 126))
    return F.when(plain, text).otherwise(F.btrim(text, F.lit(WHITE)))


def text_or_empty(value: Column | str) -> Column:
    """Trimmed text, '' for NULL."""
    return F.coalesce(trimmed(value), F.lit(""))


def is_blank(value: Column) -> Column:
    """Whether nothing is left after trimming; text that starts with a plain mark is not trimmed."""
    plain = F.coalesce(F.ascii(value), F.lit(0)).between(33, 126)
    return ~plain & (text_or_empty(value) == "")


def is_required_text(value: Column, limit: int = 255) -> Column:
    """1..limit characters after trimming."""
    return F.char_length(text_or_empty(value)).between(1, limit)
