"""Quality rules as a decision list learnt from labelled statistics, in DataFrame operations only.

statistics() measures texts; words are runs of characters other than space and U+0009 to U+000D. fit() learns an
ordered list of conjunctions of thresholds by sequential covering: a rule for label 0 grows by the condition of largest
information gain, is cut back on rows set aside, and is kept if enough of what it takes there has label 0; then the
rows that it covers go and the next rule grows. rejects() is the list as one conditional expression.

Null texts count as empty: all statistics are 0. Texts are measured whole. Rows with a null label or a null id teach
nothing; an id with several labels counts with the lowest. At most most_rows labelled rows, chosen by the hash of their
id, are learnt from; without rows of both labels the list is empty and rejects nothing. Ties between conditions
go to the first statistic in STATISTICS, then the lower threshold. Repeated rows get equal verdicts.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import cut, learnable, text_of

WINDOW = 8
_BLANKS = " \t\n\x0b\f\r"
_WORD = r"[^\x20\x09-\x0D]+"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _count(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def _covered(hashes: Column) -> Column:
    """How many words lie in windows whose hash comes twice or more."""

    def of_sorted(s: Column) -> Column:
        same = F.transform(
            s, lambda x, k: F.when((F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]), x["at"])
        )
        return _let(
            F.sort_array(F.array_compact(same)),
            lambda at: F.aggregate(
                F.transform(at, lambda p, k: F.coalesce(F.least(F.lit(WINDOW), F.get(at, k + 1) - p), F.lit(WINDOW))),
                F.lit(0), lambda a, x: a + x,
            ),
        )

    return _let(F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("at")))), of_sorted)


def _repeated_words(words: Column) -> Column:
    def of_windows(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(_covered(hashes))

    windows = _let(
        F.transform(words, lambda w: F.xxhash64(w)),
        lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(h, i, WINDOW))),
    )
    return F.when(F.size(words) <= WINDOW, F.lit(0)).otherwise(_let(windows, of_windows)).cast("long")


def statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and the counts of each text."""
    t = F.col("text")
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("text"))
    rows = rows.select(
        "doc_id", "text", F.regexp_extract_all("text", F.lit(_WORD), 0).alias("words"),
        F.filter(F.split("text", "\n"), lambda line: F.length(F.translate(line, _BLANKS, "")) > 0).alias("lines"),
    )
    return rows.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate(t, _BLANKS, "")).cast("long").alias("word_chars"),
        _count(t, "#*$%&|<>").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeated_words(F.col("words")).alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.aggregate(
            F.transform("words", lambda w, i: (F.get("words", i - 1) == w).cast("int")), F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))
        ).cast("long").alias("n_next_equal"),
        _count(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("n_upper"),
        _count(t, "!?").alias("n_marks"),
        _count(t, "0123456789").alias("n_digits"),
    )


def _share(part: str, of: str) -> Column:
    return F.coalesce(F.try_divide(F.col(part).cast("double"), F.col(of)), F.lit(0.0))


#: What conditions are about, over the columns of statistics(): marks of bad texts. The length of texts and of words is
#: not among them, as it tells the source and the language rather than the quality.
STATISTICS: dict[str, Callable[[], Column]] = {
    "symbols": lambda: _share("n_symbols", "word_chars"),
    "upper": lambda: _share("n_upper", "word_chars"),
    "marks": lambda: _share("n_marks", "word_chars"),
    "digits": lambda: _share("n_digits", "word_chars"),
    "repeated_lines": lambda: _share("n_dup_lines", "n_lines"),
    "repeated_words": lambda: _share("n_repeat_words", "n_words"),
    "next_equal": lambda: _share("n_next_equal", "n_words"),
    "line_words": lambda: _share("n_words", "n_lines"),
}


@dataclass(frozen=True)
class Condition:
    """statistic >= threshold if above, else statistic < threshold."""

    statistic: str
    above: bool
    threshold: float

    def holds(self, value: Column | None = None) -> Column:
        value = STATISTICS[self.statistic]() if value is None else value
        return value >= self.threshold if self.above else value < self.threshold


Rule = tuple[Condition, ...]


def _all(conditions: Sequence[Condition]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c.holds(F.col(c.statistic))
    return out


def _gain(p: int, n: int, before: float) -> float:
    return p * (math.log2(p / (p + n)) - before) if p else 0.0


def _bin(value: Column, edges: list[float]) -> Column:
    return F.size(F.filter(F.lit(edges).cast("array<double>"), lambda x: x <= value))


def _grown(rows: DataFrame, edges: dict[str, list[float]], most_conditions: int) -> Rule:
    """Adds the condition of largest gain while rows of label 1 remain; one small count per statistic and bin a step."""
    rule: tuple[Condition, ...] = ()
    longer = F.explode(F.array(*[F.struct(F.lit(s).alias("statistic"), _bin(F.col(s), e).alias("bin")) for s, e in edges.items()]))
    while len(rule) < most_conditions:
        counts = rows.where(_all(rule)).select("label", longer.alias("x")).groupBy("x.statistic", "x.bin").agg(
            F.sum(1 - F.col("label")).alias("bad"), F.sum("label").alias("good")
        )
        # (number of statistics) * (number of bins) rows at most
        seen = {(r["statistic"], r["bin"]): (r["bad"], r["good"]) for r in counts.collect()}
        first = next(iter(edges))
        bad, good = (sum(v[i] for (s, _), v in seen.items() if s == first) for i in (0, 1))
        if not bad or not good:
            break
        best, most = None, 0.0
        for s, e in edges.items():
            for k, threshold in enumerate(e):
                low = [sum(seen.get((s, b), (0, 0))[i] for b in range(k + 1)) for i in (0, 1)]
                for above, (p, n) in ((True, (bad - low[0], good - low[1])), (False, tuple(low))):
                    gain = _gain(p, n, math.log2(bad / (bad + good)))
                    if gain > most:
                        best, most = Condition(s, above, threshold), gain
        if best is None:
            break
        rule += (best,)
    return rule


def _pruned(rows: DataFrame, rule: Rule) -> tuple[Rule, int, int]:
    """The beginning of the rule that does best on rows set aside, with what it takes there of labels 0 and 1."""
    taken = [F.sum(F.when(_all(rule[:k]), v).otherwise(0)) for k in range(1, len(rule) + 1) for v in (1 - F.col("label"), F.col("label"))]
    counts = [int(x or 0) for x in rows.agg(*taken).first()]
    scored = [((p - n) / (p + n) if p + n else -1.0, p, -k) for k, (p, n) in enumerate(zip(counts[::2], counts[1::2]), 1)]
    _, _, k = max(scored)
    return rule[:-k], counts[-2 * k - 2], counts[-2 * k - 1]


def fit(stats: DataFrame, labels: DataFrame, doc_id: str = "doc_id", label: str = "quality", most_rows: int = 20_000, most_rules: int = 8, most_conditions: int = 3, precision: float = 0.9, bins: int = 32) -> list[Rule]:
    """The ordered list of rules for label 0. stats has the columns of statistics()."""
    marks = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("label"))
    marks = marks.where(learnable() & F.col("label").isin(0, 1)).groupBy("doc_id").agg(F.min("label").alias("label"))
    marks = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    # at most most_rows rows of two numbers, so the statistics needn't be shuffled
    rows = stats.join(F.broadcast(marks), "doc_id").select("doc_id", "label", *[s().alias(name) for name, s in STATISTICS.items()])
    rows = cut(rows.withColumn("aside", F.pmod(F.xxhash64("doc_id", F.lit("aside")), F.lit(3)) == 0))
    ranks = F.lit([i / bins for i in range(1, bins)])
    found = rows.agg(*[F.percentile_approx(s, ranks, 10_000).alias(s) for s in STATISTICS]).first()
    edges = {s: sorted(set(found[s])) for s in STATISTICS} if found[0] is not None else {}
    rules: list[Rule] = []
    left = rows
    while edges and len(rules) < most_rules:
        rule = _grown(left.where(~F.col("aside")), edges, most_conditions)
        if not rule:
            break
        rule, bad, good = _pruned(left.where("aside"), rule)
        if bad < precision * (bad + good) or not bad:
            break
        rules.append(rule)
        left = left.where(~_all(rule))
    return rules


def rejects(rules: Sequence[Rule]) -> Column:
    """The list over the columns of statistics(): the first rule that fits rejects; without one the text stays."""
    out = None
    for rule in rules:
        fits = F.lit(True)
        for c in rule:
            fits = fits & c.holds()
        out = F.when(fits, True) if out is None else out.when(fits, True)
    return F.lit(False) if out is None else out.otherwise(False)
