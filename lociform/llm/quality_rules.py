"""Operator 1: quality rules.

A threshold table is compiled into one Spark projection. All measures are built-in expressions:
no user function runs. Every text is read whole.

Defined cases: a null text has no words, so every measure is 0, base_failed is true and kept false.
Empty and blank texts behave alike. Repeated rows are judged one by one. An empty table gives an empty
result. Very long texts are read whole; a measure that equals its threshold breaks no rule. Columns beside the key and
the text never take part, so clashing names do no harm.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE

SYMBOLS = "#*$%&|<>"

#: Frequent function words of four languages (plain word list, natural order per language).
STOP_WORDS = (
    "the of and to in is that it for was on are as with be at by this from or an have not you which"
    " der die und das von zu den mit ist des im auf für nicht ein eine als auch sich dem"
    " de la le et les des en un du une que est pour qui dans par sur pas au il"
    " el los las que del y por con una para se lo no su al es como más"
).split()


@dataclass(frozen=True)
class Rule:
    """A document breaks the rule if the measure is below `least` or above `most` (None: no bound)."""

    measure: str
    least: float | None = None
    most: float | None = None


#: Production thresholds. A measure is a ratio or a count from `ratios`.
RULES = (
    Rule("mean_word_chars", 1.0, 40.0),
    Rule("symbol_ratio", None, 0.05),
    Rule("shout_ratio", None, 0.5),
    Rule("duplicate_line_ratio", None, 0.5),
    Rule("repeated_word_ratio", None, 0.5),
    Rule("stop_word_ratio", 0.005, None),
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once: it becomes the bound variable of a one-element transform."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeat_words(words: Column) -> Column:
    """How many words lie in three-word windows that the text has twice or more.

    Windows and positions are sorted together; a window is repeated if a neighbour in this order equals it.
    That costs n log n a text, whatever its windows are.
    """

    def covered(order: Column) -> Column:
        def repeated(x: Column, i: Column) -> Column:
            w = x["w"]
            return (w == F.get(order, i - 1)["w"]) | (w == F.get(order, i + 1)["w"])

        hits = F.filter(order, lambda x, i: F.coalesce(repeated(x, i), F.lit(False)))
        at = F.flatten(F.transform(hits, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))
        return F.size(F.array_distinct(at))

    # Most texts repeat no window: then nothing is sorted.
    windows = F.transform(F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))), lambda a, i: F.concat_ws(" ", a, F.get(words, i + 1), F.get(words, i + 2)))
    placed = lambda ws: F.sort_array(F.transform(ws, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
    return let(windows, lambda ws: F.when(F.size(F.array_distinct(ws)) == F.size(ws), 0).otherwise(let(placed(ws), covered)))


def measures(text: Column) -> Column:
    """A struct of the base counts and the counts behind the ratios, for one text column."""
    body = F.coalesce(text.cast("string"), F.lit(""))

    def from_words(words: Column) -> Column:
        lines = F.filter(F.split(body, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            F.length(F.regexp_replace(body, "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
            let(lines, lambda ls: F.struct(F.size(ls).alias("n"), (F.size(ls) - F.size(F.array_distinct(ls))).alias("dup"))).alias("lines"),
            _repeat_words(words).cast("long").alias("n_repeat_words"),
            (F.length(body) - F.length(F.replace(body, F.lit("!"), F.lit("")))).cast("long").alias("n_shouts"),
            F.size(F.filter(words, lambda w: F.lower(w).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        )

    return let(F.filter(F.split(body, SPACE), lambda w: w != ""), from_words)


def ratios(m: Column) -> dict[str, Column]:
    n = F.greatest(m["n_words"], F.lit(1)).cast("double")
    return {
        "mean_word_chars": m["word_chars"] / n,
        "symbol_ratio": m["n_symbols"] / F.greatest(m["word_chars"], F.lit(1)),
        "shout_ratio": m["n_shouts"] / n,
        "duplicate_line_ratio": m["lines"]["dup"] / F.greatest(m["lines"]["n"], F.lit(1)),
        "repeated_word_ratio": m["n_repeat_words"] / n,
        "stop_word_ratio": m["n_stop_words"] / n,
    }


def compiled(rules: tuple[Rule, ...], m: Column) -> Column:
    """The threshold table as one boolean: true if a document breaks no rule."""
    have = ratios(m)
    ok = F.lit(True)
    for r in rules:
        if r.least is not None:
            ok = ok & (have[r.measure] >= r.least)
        if r.most is not None:
            ok = ok & (have[r.measure] <= r.most)
    return ok


def verdict(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """A struct of base counts, ratios, base_failed and kept."""

    def judged(m: Column) -> Column:
        failed = (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
        return F.struct(
            *[m[c].alias(c) for c in ("n_words", "word_chars", "n_symbols")],
            m["lines"]["dup"].cast("long").alias("n_dup_lines"),
            m["n_repeat_words"].alias("n_repeat_words"),
            failed.alias("base_failed"),
            (~failed & compiled(rules, m)).alias("kept"),
            *[v.alias(k) for k, v in ratios(m).items()],
        )

    return let(measures(text), judged)


def quality_rules(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per row of docs: key, the base counts, base_failed, kept, and the ratios that were compared."""
    return docs.select(F.col(key), F.inline(F.array(verdict(F.col(text), rules))))
