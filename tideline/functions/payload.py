"""Expressions over JSON payloads held as VARIANT. Everything here stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tideline import vocab
from tideline.functions.text import text_or_empty, trimmed

# Decimal numbers in text; suffixes that the JVM would also take do not count.
NUMERIC = r"^[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity|nan))$"
RFC3339 = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}([.,]\d+)?(Z|[+-]\d{2}:\d{2})$"
RFC3339_UTC = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}([.,]\d+)?(Z|[+-]00:00)$"


def canonical(value: Column) -> Column:
    """JSON text with sorted keys and normalised numbers."""
    return F.to_json(value)


# --- members and coercions -------------------------------------------------------------------


def member(value: Column, path: str) -> Column:
    """Member as VARIANT; SQL NULL when absent, a VARIANT null when present and null."""
    return F.try_variant_get(value, path, "variant")


def members(value: Column, names) -> Column:
    """The named members as a struct, read in one pass; absent ones are NULL. Looking an absent one up by its path costs an
    exception inside, far more than the rest."""
    fields = ", ".join(f"`{n}`: variant" for n in names)
    return F.try_variant_get(value, "$", f"struct<{fields}>")


def inherited(line: Column, header: Column, name: str) -> Column:
    """A member of the line, else of the header; a null member of the line hides the header."""
    return F.coalesce(member(line, f"$.{name}"), member(header, f"$.{name}"))


def kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def is_object(value: Column) -> Column:
    """Any object casts to the struct without fields; that spares spelling out its schema."""
    return F.try_variant_get(value, "$", "struct<>").isNotNull()


def is_array(value: Column) -> Column:
    return F.try_variant_get(value, "$", "array<variant>").isNotNull()


def is_number(value: Column) -> Column:
    name = kind(value)
    return F.coalesce(name.isin("BIGINT", "DOUBLE") | name.startswith("DECIMAL"), F.lit(False))


def is_string(value: Column) -> Column:
    return F.coalesce(kind(value) == "STRING", F.lit(False))


def is_absent_or_null(value: Column) -> Column:
    return value.isNull() | F.is_variant_null(value)


def as_text(value: Column) -> Column:
    """Any scalar as trimmed text, '' when null or absent."""
    return text_or_empty(F.try_variant_get(value, "$", "string"))


def as_pure_text(value: Column) -> Column:
    """Trimmed text only when the member is a JSON string, else ''."""
    return F.when(is_string(value), as_text(value)).otherwise(F.lit(""))


def as_number(value: Column) -> Column:
    """Number or numeric text as double; booleans and everything else NULL."""
    text = trimmed(F.try_variant_get(value, "$", "string"))
    return F.when(is_number(value), F.try_variant_get(value, "$", "double")).when(
        is_string(value) & text.rlike(NUMERIC), text.try_cast("double")
    )


def as_long(value: Column) -> Column:
    return as_number(value).cast("bigint")


def as_int(value: Column) -> Column:
    return as_number(value).cast("bigint").try_cast("int")


def as_time(value: Column, pattern: str = RFC3339) -> Column:
    text = as_pure_text(value)
    return F.when(text.rlike(pattern), F.try_to_timestamp(text))


def as_text_list(value: Column) -> Column:
    """Array elements, or comma separated text, trimmed and without blanks."""
    elements = F.transform(
        F.try_variant_get(value, "$", "array<variant>"), lambda x: as_text(x)
    )
    pieces = F.transform(F.split(as_text(value), ","), lambda x: trimmed(x))
    chosen = F.when(is_array(value), elements).when(is_string(value), pieces)
    return F.coalesce(F.filter(chosen, lambda x: x != ""), F.array().cast("array<string>"))


def as_positive_int(value: Column) -> Column:
    """Whole positive JSON number as int; numeric text does not count."""
    number = F.when(is_number(value), F.try_variant_get(value, "$", "double"))
    return F.when((number > 0) & (number == F.floor(number)), number.cast("bigint").try_cast("int"))


def object_or_empty(value: Column) -> Column:
    """JSON text of an object member, '{}' otherwise."""
    return F.when(is_object(value), F.to_json(value)).otherwise(F.lit("{}"))


# --- safety ----------------------------------------------------------------------------------

_KEY_PAD = r"(?:\\[tnrf]|\\u000[bB]|[\s\p{Z}\x{85}])*"
_BLOCKED = (
    r'(?i)[{,]"(' + _KEY_PAD + "(?:" + "|".join(vocab.BLOCKED_KEYS) + ")" + _KEY_PAD + ')":'
)


def blocked_key(text: Column) -> Column:
    """First blocked key of canonical JSON text, as written; '' when there is none.

    Quotes inside values are escaped in canonical text, so only real keys match.
    """
    return F.coalesce(F.regexp_extract(text, _BLOCKED, 1), F.lit(""))


def _count(text: Column, characters: str) -> Column:
    """Occurrences of any of the characters, all of one length in bytes; translate would look every character up."""
    left = text
    for c in characters:
        left = F.replace(left, F.lit(c), F.lit(""))
    return F.floor((F.octet_length(text) - F.octet_length(left)) / len(characters[0].encode())).cast("int")


def encoded_size(text: Column) -> Column:
    """Bytes of the payload once '<', '>', '&' and the line separators are written as escapes."""
    return F.octet_length(text) + 5 * _count(text, "<>&") + 3 * _count(text, "\u2028\u2029")


def depth(text: Column) -> Column:
    """Nesting depth in nodes: a scalar and an empty container are 1, {"a":1} is 2."""
    # Possessive groups keep the matcher iterative on long strings.
    skeleton = F.regexp_replace(text, r'"(?:[^"\\]|\\.)*+"', "s")
    skeleton = F.regexp_replace(skeleton, "s:", "")
    skeleton = F.regexp_replace(skeleton, r"(s|true|false|null|-?[0-9][0-9.eE+-]*+)", "[]")
    skeleton = F.regexp_replace(skeleton, r"[^\[\]{}]", "")
    start = F.struct(F.lit(0).alias("open"), F.lit(0).alias("deepest"))

    def step(state, char):
        opened = F.when(char.isin("{", "["), state["open"] + 1).otherwise(state["open"] - 1)
        return F.struct(opened.alias("open"), F.greatest(state["deepest"], opened).alias("deepest"))

    return F.aggregate(F.split(skeleton, ""), start, step, lambda state: state["deepest"])


def too_deep(text: Column, limit: int = vocab.MAX_PAYLOAD_DEPTH) -> Column:
    """Depth beyond the limit; the full walk runs only for texts with enough brackets."""
    return F.when(_count(text, "{[") >= limit, depth(text) > limit).otherwise(F.lit(False))


def limit_issue(text: Column, name: str) -> Column:
    """'<name>_depth', '<name>_size' or NULL. Escapes make a byte six at most, so short texts aren't counted out."""
    large = (F.octet_length(text) * 6 > vocab.MAX_PAYLOAD_BYTES) & (encoded_size(text) > vocab.MAX_PAYLOAD_BYTES)
    return F.when(too_deep(text), F.lit(f"{name}_depth")).when(large, F.lit(f"{name}_size"))
