"""Secrets found through a trigram inverted index, in DataFrame operations only.

Of each rule's pattern a Boolean query over trigrams is derived: what any match must contain. Postings (trigram, text)
of the trigrams that some rule asks for are gathered from all texts in lower case; grouping them by text intersects
them, and a rule is tried only on texts whose trigrams satisfy its query. Rules that no trigram is mandatory for are
tried on every text.

Spans count code points, the end is exclusive. Matches of a rule are leftmost and don't overlap; one that fails the
rule's check is dropped and the search goes on behind it. A null text counts as empty and has no spans. Texts are
searched whole. Rows with equal key and text share their postings and are returned as often as they came.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as parser
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import free_name, text_of


@dataclass(frozen=True)
class Rule:
    """A kind of secret. holds is the check of a match; base marks the plain kinds."""

    kind: str
    pattern: str
    base: bool = False
    holds: Callable[[Column], Column] | None = None


_ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""

#: In the order in which spans of equal start are listed. Runs with a least length are those of the same class that
#: reach it, as each match is as long as it can be.
RULES = (
    Rule("assign", _ASSIGN, True, lambda match: F.length(F.regexp_extract(match, _ASSIGN, 2)) >= 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}", True),
    Rule("hex", r"[0-9a-f]{24,}", True),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)

#: Strings that a part of a pattern may stand for; beyond that, the part counts as unknown.
MOST_STRINGS = 64


# --- trigram queries -------------------------------------------------------------------------------------------------
# A query is True (anything goes), a trigram, ("and", queries) or ("or", queries).


def _all(queries: list) -> object:
    queries = list(dict.fromkeys(q for q in queries if q is not True))
    return True if not queries else queries[0] if len(queries) == 1 else ("and", tuple(queries))


def _any(queries: list) -> object:
    queries = list(dict.fromkeys(queries))
    return True if True in queries or not queries else queries[0] if len(queries) == 1 else ("or", tuple(queries))


def _containing(strings: set[str]) -> object:
    """Some string's trigrams; a string whose trigrams include all of another's asks for nothing more than that one."""
    sets = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
    return _any([_all(sorted(x)) for x in sorted(sets, key=sorted) if not any(y < x for y in sets)])


def _strings(nodes) -> set[str] | None:
    """All strings the nodes match, in lower case, or None if there are too many."""
    out = {""}
    for op, arg in nodes:
        if op is sre.LITERAL:
            here = {chr(arg).lower()}
        elif op is sre.IN:
            here = set()
            for kind, value in arg:
                if kind is sre.LITERAL:
                    here.add(chr(value).lower())
                elif kind is sre.RANGE and value[1] - value[0] < MOST_STRINGS:
                    here |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
                else:
                    return None
        elif op is sre.SUBPATTERN:
            here = _strings(arg[3])
        elif op is sre.BRANCH:
            parts = [_strings(b) for b in arg[1]]
            here = None if None in parts else set().union(*parts)
        elif op is sre.MAX_REPEAT and arg[1] <= 2:
            once = _strings(arg[2])
            here = once and set().union(*[{"".join(x) for x in _power(once, n)} for n in range(arg[0], arg[1] + 1)])
        elif op is sre.AT:
            here = {""}
        else:
            return None
        if here is None or len(out) * len(here) > MOST_STRINGS:
            return None
        out = {a + b for a in out for b in here}
    return out


def _power(strings: set[str], n: int) -> list[tuple[str, ...]]:
    out: list[tuple[str, ...]] = [()]
    for _ in range(n):
        out = [(*x, s) for x in out for s in sorted(strings)]
    return out


def trigram_query(pattern: str) -> object:
    """What the trigrams of a text in lower case must satisfy if the pattern matches somewhere in it."""
    return _required(list(parser.parse(pattern)))


def _required(nodes: list) -> object:
    needed, run = [], {""}
    for op, arg in nodes:
        here = _strings([(op, arg)])
        if here is not None and len(run) * len(here) <= MOST_STRINGS:
            run = {a + b for a in run for b in here}
            continue
        once = _strings(arg[2]) if op is sre.MAX_REPEAT and arg[0] >= 1 and here is None else None
        if once and len(run) * len(once) <= MOST_STRINGS:  # it begins with one pass and ends with one
            needed.append(_containing({a + b for a in run for b in once}))
            run = once
            continue
        needed.append(_containing(run))
        run = here if here is not None else {""}
        if here is None:
            if op is sre.SUBPATTERN:
                needed.append(_required(list(arg[3])))
            elif op is sre.BRANCH:
                needed.append(_any([_required(list(b)) for b in arg[1]]))
            elif op is sre.MAX_REPEAT and arg[0] >= 1:
                needed.append(_required(list(arg[2])))
    return _all([*needed, _containing(run)])


def _trigrams(query: object) -> set[str]:
    return set() if query is True else {query} if isinstance(query, str) else set().union(*map(_trigrams, query[1]))


def _satisfied(query: object, found: Column) -> Column:
    if isinstance(query, str):
        return F.array_contains(found, query)
    parts = [_satisfied(q, found) for q in query[1]]
    out = parts[0]
    for part in parts[1:]:
        out = out & part if query[0] == "and" else out | part
    return out


# --- index -----------------------------------------------------------------------------------------------------------


def _escaped(chars: str) -> str:
    return "".join(c if c.isalnum() else f"\\x{ord(c):02x}" for c in chars)


def postings(texts: DataFrame, key: str, text: str, trigrams: set[str]) -> DataFrame:
    """(trigram, key) for each of the given trigrams that a text has, in lower case."""
    by_first: dict[str, list[str]] = {}
    for t in sorted(trigrams):
        by_first.setdefault(t[0], []).append(_escaped(t[1:]))
    anywhere = "(?=(" + "|".join(f"{_escaped(c)}(?:{'|'.join(rest)})" for c, rest in by_first.items()) + "))"
    found = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(anywhere), 1))
    return texts.select(F.explode(found).alias("trigram"), F.col(key).alias("key"))


def candidates(index: DataFrame, queries: dict[str, object]) -> DataFrame:
    """(key, kinds): the rules whose query the postings of a text satisfy, for texts with at least one."""
    sets = index.groupBy("key").agg(F.collect_set("trigram").alias("found"))
    kinds = F.array_compact(F.array(*[F.when(_satisfied(q, F.col("found")), F.lit(k)) for k, q in queries.items()]))
    return sets.select("key", kinds.alias("kinds")).where(F.size("kinds") > 0)


# --- matches ---------------------------------------------------------------------------------------------------------

#: Lengths are summed in blocks of so many, so that a text with many matches takes n * BLOCK steps, not n * n.
BLOCK = 64


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


def _sum(lengths: Column, start: Column, n: Column) -> Column:
    return F.aggregate(F.slice(lengths, start, n), F.lit(0), lambda a, x: a + x)


def _ends(steps: Column) -> Column:
    """Running sums of an array of lengths."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / BLOCK).cast("int")), lambda b: _sum(steps, b * BLOCK + 1, F.lit(BLOCK)))
    return _let(
        blocks,
        lambda totals: _let(
            F.transform(totals, lambda _, b: _sum(totals, F.lit(1), b)),
            lambda before: F.transform(
                steps,
                lambda _, i: F.element_at(before, F.floor(i / BLOCK).cast("int") + 1) + _sum(steps, i - i % BLOCK + 1, i % BLOCK + 1),
            ),
        ),
    )


_NONE = "array<struct<start: int, order: int, kind: string, end: int, base: boolean>>"


def _spans(text: Column, rule: Rule, order: int) -> Column:
    def placed(matches: Column) -> Column:
        # what stands between the matches gives their places
        steps = F.zip_with(F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(matches)), matches, lambda gap, m: F.length(gap) + F.length(m))
        spans = _let(
            steps,
            lambda s: F.zip_with(
                matches,
                _ends(s),
                lambda m, end: F.struct(
                    (end - F.length(m)).alias("start"), F.lit(order).alias("order"), F.lit(rule.kind).alias("kind"), end.alias("end"),
                    F.lit(rule.base).alias("base"), (rule.holds(m) if rule.holds else F.lit(True)).alias("holds"),
                ),
            ),
        )
        held = F.filter(spans, lambda s: s["holds"])
        plain = F.transform(held, lambda s: F.struct(s["start"].alias("start"), s["order"].alias("order"), s["kind"].alias("kind"), s["end"].alias("end"), s["base"].alias("base")))
        return F.when(F.size(matches) == 0, F.array().cast(_NONE)).otherwise(plain)

    return _let(F.regexp_extract_all(text, F.lit(rule.pattern), 0), placed)


def _redacted(text: Column, rule: Rule, mark: str) -> Column:
    def replaced(matches: Column) -> Column:
        shown = F.transform(matches, lambda m: F.when(rule.holds(m), F.lit(mark)).otherwise(m) if rule.holds else F.lit(mark))
        both = F.zip_with(F.split(text, rule.pattern, -1), shown, lambda gap, m: F.concat(gap, F.coalesce(m, F.lit(""))))
        return F.when(F.size(matches) == 0, text).otherwise(F.array_join(both, ""))

    return _let(F.regexp_extract_all(text, F.lit(rule.pattern), 0), replaced)


def _tried(docs: DataFrame, text: str, key: Sequence[str], rules: Sequence[Rule]) -> tuple[DataFrame, str, Callable[[Rule], Column]]:
    """The rows with the rules to try on them: their frame, the columns it adds, and the test for a rule."""
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    named = {k: q for k, q in queries.items() if q is not True}
    row, kinds = free_name(docs, "_row"), free_name(docs, "_kinds")
    # rows of equal hash share candidates, which costs a needless try at most: matches are sought in the row's own text
    rows = docs.withColumn(row, F.xxhash64(*[F.col(c) for c in dict.fromkeys([*key, text])]))
    if named:
        texts = rows.select(F.col(row).alias("key"), F.col(text).alias("text"))
        found = candidates(postings(texts, "key", "text", set().union(*map(_trigrams, named.values()))), named)
        rows = rows.join(found.select(F.col("key").alias(row), F.col("kinds").alias(kinds)).hint("shuffle_hash"), row, "left")
    else:
        rows = rows.withColumn(kinds, F.lit(None).cast("array<string>"))
    return rows, (row, kinds), lambda rule: F.lit(True) if queries[rule.kind] is True else F.coalesce(F.array_contains(kinds, rule.kind), F.lit(False))


def scan(docs: DataFrame, spans: str = "spans", text: str = "text", key: Sequence[str] = ("doc_id",), rules: Sequence[Rule] = RULES) -> DataFrame:
    """docs with the column spans: array<struct<kind, start, end, base>> by start, then the order of the rules."""
    rows, extra, applies = _tried(docs, text, key, rules)
    found = [F.when(applies(r), _spans(text_of(text), r, i)).otherwise(F.array().cast(_NONE)) for i, r in enumerate(rules)]
    ordered = F.transform(
        F.sort_array(F.concat(*found)), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["base"].alias("base"))
    )
    return rows.withColumn(spans, ordered).select(*docs.columns, spans)


def redact(docs: DataFrame, text: str = "text", key: Sequence[str] = ("doc_id",), rules: Sequence[Rule] = RULES, mark: str = "<removed>") -> DataFrame:
    """docs with each secret in the text replaced by the mark, rule after rule; null texts stay null."""
    rows, extra, applies = _tried(docs, text, key, rules)
    for rule in rules:
        rows = rows.withColumn(text, F.when(applies(rule), _redacted(F.col(text), rule, mark)).otherwise(F.col(text)))
    return rows.select(*docs.columns)
