"""Quality rules: a table of thresholds compiled into one projection.

Each rule compares one measure of a text with a bound. The measures (lengths, symbols, stop words,
lines, repeats) are expressions over the text, so a whole rule set is one ``select`` without user
functions or shuffles, and other rules need no code.
"""

from __future__ import annotations

import operator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import SPACES, fresh, words

SYMBOLS = "#*$%&|<>"  # fixed value
WINDOW = 5

# Frequent short words of four languages; a long text without any of them is hardly prose.
STOP_WORDS = {
    "en": "a and are as at be by for from have he in is it not of on or that the this to was were which with".split(),
    "de": "auch auf das dem den der die ein eine es für im in ist mit nicht sich sie und von zu".split(),
    "fr": "au aux avec ce dans de des du elle en est et il la le les par pas pour que qui sur un une".split(),
    "es": "con de del el en es la las lo los no para por que se su un una y".split(),
}


@dataclass(frozen=True)
class Rule:
    """A text fails where ``measure op bound`` holds. ``base`` marks rules that a contract fixes."""

    measure: str
    op: str
    bound: float
    base: bool = False


# base_failed: fewer than 10 words, or more than 20 % of them in repeated windows.
RULES = (
    Rule("n_words", "<", 10, base=True),
    Rule("repeat_percent", ">", 20, base=True),
    Rule("mean_word_length", ">", 40),
    Rule("symbols_per_word", ">", 0.3),
    Rule("dup_line_share", ">", 0.5),
    Rule("stop_words_short", ">", 0),
)
OPS = {"<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


def _repeat_words(w: Column) -> Column:
    """Words inside windows that occur at least twice. Windows are told apart by a 64-bit hash.

    Equal hashes are neighbours once sorted, so the places of repeated windows come out in one sort;
    each covers the words up to the next place, WINDOW at most.
    """
    n = F.size(w)
    places = F.sequence(F.lit(1), n - (WINDOW - 1))
    hashes = F.transform(places, lambda i: F.xxhash64(F.slice(w, i, WINDOW)))

    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.zip_with(h, places, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        m = F.size(h)

        def of_sorted(s: Column) -> Column:
            return F.sort_array(
                F.filter(
                    F.transform(
                        s,
                        lambda x, j: F.when(
                            ((j > 0) & (F.get(s, j - 1)["h"] == x["h"])) | ((j < m - 1) & (F.get(s, j + 1)["h"] == x["h"])),
                            x["i"],
                        ),
                    ),
                    lambda i: i.isNotNull(),
                )
            )

        def spread(p: Column) -> Column:
            steps = F.transform(p, lambda i, j: F.least(F.coalesce(F.get(p, j + 1) - i, F.lit(WINDOW)), F.lit(WINDOW)))
            return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

        return _let(_let(pairs, of_sorted), spread)

    # Most texts repeat nothing: a hash set finds that out before anything is sorted.
    return F.when(n < WINDOW + 1, F.lit(0)).otherwise(
        _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))
    )


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def measures(text: Column) -> dict[str, Column]:
    """Counts of a text as expressions; null counts as empty."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    bare = F.translate(t, SPACES, "")
    lines = F.filter(F.split(t, "\n"), lambda x: F.translate(x, SPACES, "") != "")
    stop = sorted({w for some in STOP_WORDS.values() for w in some})

    def by_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            _repeat_words(w).cast("long").alias("n_repeat_words"),
            F.size(F.filter(w, lambda x: F.lower(x).isin(stop))).cast("long").alias("n_stop_words"),
        )

    return {
        "counted": _let(words(t), by_words),
        "word_chars": F.length(bare).cast("long"),
        "latin": F.octet_length(t) <= F.length(t) * 1.2,
        "n_symbols": (F.length(bare) - F.length(F.translate(bare, SYMBOLS, ""))).cast("long"),
        "by_line": _let(
            lines,
            lambda x: F.struct(
                F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")
            ),
        ),
    }


def _ratios(c: dict[str, Column]) -> dict[str, Column]:
    share = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    return c | {
        # In whole numbers, as 100 * repeats > bound * words.
        "mean_word_length": share(c["word_chars"], c["n_words"]),
        "symbols_per_word": share(c["n_symbols"], c["n_words"]),
        "dup_line_share": F.when(c["n_lines"] >= 4, share(c["n_dup_lines"], c["n_lines"])).otherwise(0.0),
        # A text of many words in Latin letters without any stop word is a list or noise.
        "stop_words_short": F.when(c["latin"] & (c["n_words"] >= 200) & (c["n_stop_words"] == 0), 1).otherwise(0),
    }


def _fails(rule: Rule, c: dict[str, Column]) -> Column:
    if rule.measure == "repeat_percent":
        return OPS[rule.op](c["n_repeat_words"] * 100, c["n_words"] * rule.bound)
    return OPS[rule.op](c[rule.measure], F.lit(rule.bound))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words")


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", into: str = "quality") -> DataFrame:
    """All rows and columns, and a struct ``into`` with the counts, base_failed, kept and reasons.

    Null and empty texts have no words. ``reasons`` lists the measures that failed. Repeated rows
    are judged alike; an empty table stays empty. A column named like ``into`` would be replaced, so
    callers pick a free name.
    """
    raw = fresh(docs, "__raw")
    m = measures(F.col(text))
    counted = docs.withColumn(raw, F.struct(*[v.alias(k) for k, v in m.items()]))
    at = F.col(raw)
    c = {k: at["counted"][k] for k in ("n_words", "n_repeat_words", "n_stop_words")}
    c |= {k: at["by_line"][k] for k in ("n_lines", "n_dup_lines")}
    c |= {k: at[k] for k in ("word_chars", "n_symbols", "latin")}
    ratios = _ratios(c)
    failed = [(r, _fails(r, ratios)) for r in rules]
    either = lambda some: F.coalesce(F.array_max(F.array(F.lit(False), *some)), F.lit(False))
    return counted.withColumn(
        into,
        F.struct(
            *[c[k].alias(k) for k in COUNTS],
            either([f for r, f in failed if r.base]).alias("base_failed"),
            (~either([f for _, f in failed])).alias("kept"),
            F.filter(F.array(*[F.when(f, F.lit(r.measure)) for r, f in failed]), lambda x: x.isNotNull()).alias("reasons"),
        ),
    ).drop(raw)


def keep(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The rows that no rule rejects, with their columns as they were."""
    into = fresh(docs, "__quality")
    return judge(docs, rules, text, into).where(F.col(into)["kept"]).drop(into)
