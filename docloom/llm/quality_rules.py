"""Quality rules as a short-circuit cascade, in built-in functions only.

A rule is a condition on measures of a text that rejects it. ``plan_cascade`` takes each
rule's cost, the time that its own measures add per row over repeated passes of a sample,
and its selectivity there, and orders the rules by rejection per cost. ``apply_rules`` then
runs them in that order: a measure is made right before the first rule that needs it, and
only for rows that no earlier rule has rejected. Measures that the caller asks for
(``always``) are made for all rows first and cost the rules nothing.

The order changes the time taken, which rule is named and which measures are null, never
the verdict. Costs are measured, so two runs may order rules of like worth differently.

Words are runs of characters outside 0x20 and 0x09-0x0D.

Defined results: a null or empty text has no words and fails the rule on their number;
repeated rows get equal verdicts; a rule whose condition is null does not reject; whole
texts are measured, however long; an empty table gives an empty table; extra columns are
kept, but for those named as a measure, rejected_by or kept, which are replaced.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import Scratch, fresh

#: Rows of the sample, about, and times that a timed job goes over it.
SAMPLE_ROWS, PASSES = 2000, 4
#: Costs below this many seconds a row are alike: they are lost in the noise of a job.
LEAST_COST = 1e-6
WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
_INDEX_BITS = 20


@dataclass(frozen=True)
class Rule:
    """``rejects`` is a condition that reads the measures in ``needs``."""

    name: str
    needs: tuple[str, ...]
    rejects: str


#: Conditions in whole numbers; the first two are the base rules.
RULES = (
    Rule("few_words", ("n_words",), "n_words < 50"),
    Rule("repeated_words", ("n_words", "n_repeat_words"), "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", ("n_words", "n_symbols"), "100 * n_symbols > 10 * n_words"),
    Rule("word_length", ("n_words", "word_chars"), "word_chars < 2 * n_words or word_chars > 20 * n_words"),
    Rule("repeated_lines", ("n_lines", "n_dup_lines"), "100 * n_dup_lines > 50 * n_lines"),
    Rule("few_letters", ("word_chars", "n_letters"), "100 * n_letters < 50 * word_chars"),
    Rule("bullets", ("n_lines", "n_bullets"), "100 * n_bullets > 90 * n_lines"),
)


class _Measures:
    """Adds measures to df, with the steps that several of them share, each made once.

    A step or measure that is made under a condition is null elsewhere; as conditions only
    narrow from rule to rule, what is there may be read by all later ones. Steps stand in
    projections of their own, as later ones read each more than once.
    """

    def __init__(self, df: DataFrame, text_col: str):
        self.df, self.made = df, set()
        names = ("words", "lines", "grams", "packed", "flags", "starts")
        self.step = dict(zip(names, fresh([*df.columns, *_MEASURES], *names), strict=True))
        self.text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))

    def _with(self, name: str, value: Column, when: Column | None) -> None:
        self.df = self.df.withColumn(name, value if when is None else F.when(when, value))
        self.made.add(name)

    def _need(self, step: str, when: Column | None) -> Column:
        if self.step[step] not in self.made:
            self._with(self.step[step], getattr(self, f"_{step}")(when), when)
        return F.col(self.step[step])

    def add(self, columns: tuple[str, ...], when: Column | None = None) -> DataFrame:
        for c in columns:
            if c not in self.made:
                self._with(c, _MEASURES[c](lambda step: self._need(step, when), self.text).cast("bigint"), when)
        return self.df

    def done(self) -> DataFrame:
        return self.df.drop(*self.step.values())

    def _words(self, when) -> Column:
        return F.regexp_extract_all(self.text, F.lit(WORD), F.lit(0))

    def _lines(self, when) -> Column:
        return F.filter(F.split(self.text, "\n", -1), lambda x: x.rlike(WORD))

    def _grams(self, when) -> Column:
        words = self._need("words", when)
        n, word = F.size(words), lambda i: F.get(words, i)
        return F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(word(i), word(i + 1), word(i + 2))))

    def _packed(self, when) -> Column:
        """The hashes' high bits with the window's place in the low ones, which sort as plain numbers."""
        return F.sort_array(F.transform(self._need("grams", when), lambda x, i: x.bitwiseAND(F.lit(~_MASK())).bitwiseOR(i.cast("bigint"))))

    def _flags(self, when) -> Column:
        """Of each packed entry and the one before: 1 if the hashes are equal, 2 if only their high bits are, else 0."""
        packed, grams = self._need("packed", when), self._need("grams", when)

        def flag(x: Column, i: Column) -> Column:
            last = F.get(packed, i - 1)
            return F.when(F.shiftright(x, _INDEX_BITS) == F.shiftright(last, _INDEX_BITS), F.when(F.get(grams, _place(x)) == F.get(grams, _place(last)), F.lit(1)).otherwise(2)).otherwise(0)

        return F.transform(packed, flag)

    def _starts(self, when) -> Column:
        """Places of windows that the text has twice or more, in order. Where places or high bits are not enough, whole hashes are sorted."""
        flags, packed, grams = self._need("flags", when), self._need("packed", when), self._need("grams", when)
        short = F.transform(F.filter(packed, lambda x, i: (F.get(flags, i) == 1) | F.coalesce(F.get(flags, i + 1) == 1, F.lit(False))), _place)
        pairs = F.array_sort(F.transform(grams, lambda x, i: F.struct(x.alias("g"), i.alias("i"))))
        near = F.transform(pairs, lambda x, i: F.struct(x["g"].alias("g"), x["i"].alias("i"), F.get(pairs, i - 1)["g"].alias("a"), F.get(pairs, i + 1)["g"].alias("b")))
        long = F.transform(F.filter(near, lambda x: F.coalesce((x["g"] == x["a"]) | (x["g"] == x["b"]), F.lit(False))), lambda x: x["i"])
        return F.sort_array(F.when((F.size(grams) <= _MASK()) & ~F.array_contains(flags, 2), short).otherwise(long))


def _MASK() -> int:
    return (1 << _INDEX_BITS) - 1


def _place(x: Column) -> Column:
    return x.bitwiseAND(F.lit(_MASK())).cast("int")


def _covered(starts: Column) -> Column:
    """Words in windows of three: a start adds the words up to the next start, three at most."""
    return F.coalesce(F.aggregate(starts, F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")), lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")), lambda a: a["n"]), F.lit(0))


#: Each measure of the shared steps and the text.
_MEASURES = {
    "n_words": lambda step, text: F.size(step("words")),
    "word_chars": lambda step, text: F.length(F.array_join(step("words"), "")),
    "n_symbols": lambda step, text: F.regexp_count(text, F.lit(f"[{SYMBOLS}]")),
    "n_letters": lambda step, text: F.regexp_count(text, F.lit(r"\p{L}")),
    "n_lines": lambda step, text: F.size(step("lines")),
    "n_dup_lines": lambda step, text: F.size(step("lines")) - F.size(F.array_distinct(step("lines"))),
    "n_bullets": lambda step, text: F.size(F.filter(step("lines"), lambda x: x.rlike(r"^[\x20\x09-\x0D]*[-*•]"))),
    "n_repeat_words": lambda step, text: _covered(step("starts")),
}


def measure(df: DataFrame, text_col: str, columns: tuple[str, ...]) -> DataFrame:
    """df with the asked measures, for all rows."""
    measures = _Measures(df, text_col)
    measures.add(columns)
    return measures.done()


def plan_cascade(df: DataFrame, text_col: str, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS, seed: int = 1, always: tuple[str, ...] = ()) -> list[tuple[Rule, float, float]]:
    """(rule, seconds per row, share of rows rejected), by rejection per cost, best first.

    Takes one count of df, which columnar files answer from their footers, and one scan for
    the sample, by all tasks; the sample has the measures in ``always`` already.
    """
    rows = df.select(F.col(text_col).cast("string").alias("text"))
    total = rows.count()
    out = []
    with Scratch(df.sparkSession, "rules") as scratch:
        sample = scratch.write(measure(rows.sample(min(1.0, sample_rows / max(total, 1)), seed), "text", always), "sample")
        n = max(sample.count(), 1)
        again = sample.withColumn("pass", F.explode(F.sequence(F.lit(1), F.lit(PASSES))))

        def timed(condition: str, needs: tuple[str, ...]) -> tuple[float, int]:
            """Seconds of the better of two runs, and rows of the sample that are hit."""
            seconds = []
            for _ in range(2):
                began = time.perf_counter()
                measures = _Measures(again, "text")
                measures.made |= set(always)
                hit = measures.add(needs).agg(F.count_if(F.expr(condition))).first()[0]
                seconds.append(time.perf_counter() - began)
            return min(seconds), hit // PASSES

        empty = timed("text is null", ())[0]
        for rule in rules:
            seconds, hit = timed(rule.rejects, rule.needs)
            out.append((rule, max((seconds - empty) / (n * PASSES), LEAST_COST), hit / n))
    return sorted(out, key=lambda x: (-x[2] / x[1], x[0].name))


def cascade(measures: _Measures, rules: list[Rule], rejected: str) -> None:
    """Adds the name of the first rule that rejects, null if none does; a later rule's measures are made for rows that are left."""
    for k, rule in enumerate(rules):
        left = F.col(rejected).isNull() if k else None
        measures.add(rule.needs, left)
        name = F.when(F.expr(rule.rejects), F.lit(rule.name))
        measures.df = measures.df.withColumn(rejected, name if left is None else F.when(left, name).otherwise(F.col(rejected)))


def apply_rules(df: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS, always: tuple[str, ...] = (), order: list[Rule] | None = None) -> DataFrame:
    """df with rejected_by (null if kept), kept, and the measures that the rules read: those in ``always``
    for all rows, others null where no rule came to need them. order: the rules in a planned order."""
    order = order if order is not None else [x[0] for x in plan_cascade(df, text_col, rules, sample_rows, always=always)]
    measures = _Measures(df, text_col)
    measures.add(always)
    cascade(measures, order, "rejected_by")
    out = measures.done() if order else measures.done().withColumn("rejected_by", F.lit(None).cast("string"))
    return out.withColumn("kept", F.col("rejected_by").isNull())
