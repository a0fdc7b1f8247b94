"""Quality rules: a table of thresholds compiled into Spark expressions, without user functions.

`measure` adds the measures of a text, `judge` the verdict of a rule table on them. Both are plain projections: no
shuffle, no Python, so a text is read once and a row never meets another.

Words are runs of characters other than space and the control characters 9 to 13. A null text counts as an empty one:
all measures are 0 and, having fewer words than the base rule asks for, it fails. Rows are judged one by one, so
repeated rows get equal verdicts and an empty table gives an empty one. Columns that the input has besides the text
stay; those named like a measure are replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm._spark import words

WINDOW = 5
#: Low bits of a window hash that give way to its place, so that one sort of numbers orders both.
PLACE_BITS = 28
SYMBOLS = "[#*$%&|<>]"

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in is that for it with as was on are be by this from at or an not which a have had they you were"
    " le la les de des du un une et est que qui dans pour pas sur au par avec en ce il elle ne se plus"
    " der die das und ist nicht ein eine zu den dem mit von auf sich auch es als für an werden aus er hat"
    " el los las y que del se no una por con para su al lo como más o pero sus"
).split()


@dataclass(frozen=True)
class Rule:
    """A measure of a text must lie in [at_least, at_most]; a missing bound doesn't bind."""

    name: str
    value: Callable[[], Column]
    at_least: float | None = None
    at_most: float | None = None

    def holds(self) -> Column:
        value, tests = self.value(), F.lit(True)
        if self.at_least is not None:
            tests = tests & (value >= F.lit(self.at_least))
        if self.at_most is not None:
            tests = tests & (value <= F.lit(self.at_most))
        return tests


def ratio(part: str, whole: str) -> Callable[[], Column]:
    """part / whole, 0 where the whole is 0."""
    return lambda: F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(F.lit(0.0))


#: What a text must not fail before the table is asked.
BASE_RULES = (
    Rule("enough words", lambda: F.col("n_words"), at_least=10),
    Rule("few repeated windows", lambda: 100 * F.col("n_repeat_words") - 20 * F.col("n_words"), at_most=0),
)
RULES = (
    Rule("mean word length", ratio("word_chars", "n_words"), at_least=2.0, at_most=14.0),
    Rule("symbols a word", ratio("n_symbols", "n_words"), at_most=0.1),
    Rule("repeated lines", ratio("n_dup_lines", "n_lines"), at_most=0.4),
    Rule("stop words of longer texts", lambda: F.when(F.col("n_words") < 50, F.lit(1.0)).otherwise(ratio("n_stop_words", "n_words")()), at_least=0.02),
    Rule("words with a letter", ratio("n_letter_words", "n_words"), at_least=0.6),
)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.transform(F.array(value), use)[0]


def _repeated(found: Column) -> Column:
    """Words covered by windows of the words `found` that occur twice or more.

    Sorted hashes show the windows that may have a twin. Those windows themselves are sorted with their places, the
    ones with an equal neighbour are kept, and what each kept place covers before the next one starts is added up.
    """

    def covered(places: Column) -> Column:
        step = F.transform(places, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(places, i + 1) - p, F.lit(WINDOW))))
        return F.aggregate(step, F.lit(0).cast("long"), lambda a, x: a + x)

    def places(ordered: Column) -> Column:
        same = lambda x, i: (F.get(ordered, i + 1)["w"] == x["w"]) | (F.get(ordered, i - 1)["w"] == x["w"])
        return F.sort_array(F.transform(F.filter(ordered, lambda x, i: F.coalesce(same(x, i), F.lit(False))), lambda x: x["p"]))

    def again(ordered: Column) -> Column:
        """Places whose hash, its low bits aside, has an equal neighbour in sorted order."""
        top = lambda k: F.shiftright(k, PLACE_BITS)
        same = lambda x, i: (top(F.get(ordered, i + 1)) == top(x)) | (top(F.get(ordered, i - 1)) == top(x))
        return F.transform(F.filter(ordered, lambda x, i: F.coalesce(same(x, i), F.lit(False))), lambda x: x.bitwiseAND((1 << PLACE_BITS) - 1).cast("int"))

    def counted(hashes: Column) -> Column:
        keys = F.transform(hashes, lambda h, i: h.bitwiseAND(-(1 << PLACE_BITS)).bitwiseOR(i.cast("long")))
        pairs = F.transform(let(F.sort_array(keys), again), lambda i: F.struct(F.array_join(F.slice(found, i + 1, WINDOW), " ").alias("w"), i.alias("p")))
        return let(F.sort_array(pairs), lambda ordered: let(places(ordered), covered))

    def windows(word: Column) -> Column:
        joined = F.transform(word, lambda x, i: F.xxhash64(x, *[F.get(word, i + k) for k in range(1, WINDOW)]))
        return F.slice(joined, F.lit(1), F.greatest(F.size(word) - WINDOW + 1, F.lit(0)))

    return let(F.transform(found, lambda w: F.xxhash64(w)), lambda word: let(windows(word), counted))


def _measures(text: Column, found: Column, lines: Column) -> Column:
    count = lambda test: F.size(F.filter(found, test)).cast("long")
    return F.struct(
        F.size(found).cast("long").alias("n_words"),
        F.char_length(F.array_join(found, "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.size(lines).cast("long").alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        _repeated(found).alias("n_repeat_words"),
        count(lambda w: F.lower(F.rtrim(w, F.lit(".,;:!?"))).isin(*STOP_WORDS)).alias("n_stop_words"),
        count(lambda w: w.rlike(r"\p{L}")).alias("n_letter_words"),
    )


def measure(df: DataFrame, text: str = "text") -> DataFrame:
    """df with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_stop_words and n_letter_words.

    n_lines and n_dup_lines look at the lines between line feeds that have a word; n_repeat_words counts the words
    inside windows of five words that occur twice or more in the text.
    """
    names = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_letter_words")
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    all_of = let(F.struct(words(whole).alias("w"), lines.alias("l")), lambda x: _measures(whole, x["w"], x["l"]))
    kept = [F.col(f"`{c}`") for c in df.columns if c not in names]
    return df.select(*kept, F.inline(F.array(all_of)))


def judge(df: DataFrame, rules: Sequence[Rule] = RULES, base: Sequence[Rule] = BASE_RULES) -> DataFrame:
    """df, which `measure` made, with base_failed and kept: every base rule and every rule of the table holds."""
    both = lambda some: F.forall(F.array(*[r.holds() for r in some]), lambda x: x) if some else F.lit(True)
    df = df.drop("base_failed", "kept").withColumn("base_failed", ~both(base))
    return df.withColumn("kept", ~F.col("base_failed") & both(rules))
