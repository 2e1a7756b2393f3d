"""Quality rules: a table of thresholds compiled into one projection of DataFrame functions, without user functions.

Counts are made once for each text, from its words and lines where they stand; a rule bounds one count, or its share of another in
thousandths, so that verdicts are whole-number comparisons. Nothing is shuffled: a text's repeated three-word windows are neighbours among
the sorted hashes of its own windows, and are then compared word by word.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import and_, or_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACES = r"\x20\x09-\x0D"
ALONE, ENDS = rf"(?<![^{SPACES}])", rf"(?![^{SPACES}])"  # a whole word stands between them
SYMBOL = r"[#*$%&|<>]"
WIDTH = 3

#: Frequent function words of English, French, German and Spanish, lower case.
STOP_WORDS = """
the of and to in is that it for was with as on be at by this an a are from or have not but they which you he his we
le la les de des et un une du en que est au aux à dans par pour sur ne pas ce qui il elle plus avec sont
der die das und den von zu mit ist ein eine dem nicht auf für im sich auch als es an werden aus er sie bei nach
el los las y una del por con se lo su al como más pero sus no es
""".split()


class Rule(NamedTuple):
    """A bound on a count, or on its share of the count ``of`` in thousandths; null leaves a side open."""

    name: str
    measure: str
    of: str | None
    at_least: int | None
    at_most: int | None


#: The usual bounds for web prose: length, word length, symbols, list and cut-off lines, words with letters, stop words, capitals, repeated lines.
RULES = [
    Rule("length", "n_words", None, 50, 100_000),
    Rule("word_length", "word_chars", "n_words", 3_000, 10_000),
    Rule("symbols", "n_symbols", "n_words", None, 100),
    Rule("list_lines", "n_list_lines", "n_lines", None, 900),
    Rule("cut_lines", "n_cut_lines", "n_lines", None, 300),
    Rule("letters", "n_letter_words", "n_words", 800, None),
    Rule("stop_words", "n_stop_words", "n_words", 60, None),
    Rule("capitals", "n_capital_words", "n_words", None, 300),
    Rule("repeated_lines", "n_dup_lines", "n_lines", None, 300),
]
#: Each is a count of the text; ``measures`` makes them.
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_list_lines", "n_cut_lines", "n_letter_words", "n_stop_words", "n_capital_words"]


def rules_table(spark: SparkSession, rules: list[Rule] = RULES) -> DataFrame:
    return spark.createDataFrame(rules, "name string, measure string, of string, at_least long, at_most long")


def read_rules(table: DataFrame) -> list[Rule]:
    """The rules of a table (name, measure, of, at_least, at_most), such as ``rules_table`` gives: a hand-made table of a few rows."""
    return [Rule(r["name"], r["measure"], r["of"], r["at_least"], r["at_most"]) for r in table.select(*Rule._fields).collect()]


def _matches(pattern: str) -> Column:
    return (F.size(F.split("text", pattern)) - 1).cast("long")


def _word_pattern(words: list[str]) -> str:
    """A pattern of whole words, in any case; words with the same first letter share a branch."""
    rest: dict[str, list[str]] = {}
    for word in sorted(set(words), key=lambda w: (-len(w), w)):
        rest.setdefault(word[0], []).append(re.escape(word[1:]))
    return rf"{ALONE}(?iu:{'|'.join(f'{first}(?:{"|".join(ends)})' for first, ends in rest.items())}){ENDS}"


def _hashes() -> Column:
    of = lambda i: F.xxhash64(*[F.get(F.col("words"), i + j) for j in range(WIDTH)])
    windows = F.transform(F.sequence(F.lit(0), F.size("words") - WIDTH), of)
    return F.when(F.size("words") >= WIDTH, windows).otherwise(F.array().cast("array<long>"))


def _numbered() -> Column:
    """Where windows repeat, a number for each: bits of its hash above, its place in the ``bits`` below. Sorted, equal windows are neighbours."""
    number = lambda h, i: F.call_function("shiftleft", h, F.col("bits")).bitwiseOR(i.cast("long"))
    repeat = F.size(F.array_distinct("hashes")) < F.size("hashes")
    return F.when(repeat, F.transform("hashes", number)).otherwise(F.array().cast("array<long>"))


def _pair_starts() -> Column:
    """Places of the windows that are equal, word by word, to the one before or after them in ``numbered``; some twice."""
    at = lambda k: F.get(F.col("numbered"), k)
    near = F.filter(F.sequence(F.lit(1), F.size("numbered") - 1), lambda k: F.call_function("shiftright", at(k).bitwiseXOR(at(k - 1)), F.col("bits")) == 0)
    place = lambda k: (at(k) - F.call_function("shiftleft", F.call_function("shiftright", at(k), F.col("bits")), F.col("bits"))).cast("int")
    pairs = F.transform(near, lambda k: F.array(place(k - 1), place(k)))
    word = lambda pair, k, j: F.get(F.col("words"), pair[k] + j)
    equal = F.filter(pairs, lambda p: reduce(and_, [word(p, 0, j) == word(p, 1, j) for j in range(WIDTH)]))
    return F.when(F.size("numbered") > 1, F.flatten(equal)).otherwise(F.array().cast("array<int>"))


def _covered(starts: str) -> Column:
    """Words under windows that begin at these places, in order: ``WIDTH`` each, or as many as come before the next."""
    at = lambda k: F.get(F.col(starts), k)
    steps = F.transform(F.sequence(F.lit(1), F.size(starts)), lambda k: F.least(F.lit(WIDTH), F.coalesce(at(k) - at(k - 1), F.lit(WIDTH))))
    return F.when(F.size(starts) > 0, F.aggregate(steps, F.lit(0).cast("long"), lambda total, x: total + x)).otherwise(F.lit(0).cast("long"))


def measures(docs: DataFrame, keys: list[Column], text: Column) -> DataFrame:
    """``keys`` and the counts ``MEASURES`` of each text; null is an empty text."""
    named = [k.alias(f"__key_{i}") for i, k in enumerate(keys)]
    held = [f"__key_{i}" for i in range(len(keys))]
    split = docs.select(*named, F.coalesce(text, F.lit("")).alias("text")).select(
        *held, "text", F.array_remove(F.split("text", f"[{SPACES}]+"), "").alias("words"), F.filter(F.split("text", "\n"), lambda x: x.rlike(f"[^{SPACES}]")).alias("lines"),
    )
    split = split.select("*", F.ceil(F.log2(F.size("words") + F.lit(2))).cast("int").alias("bits"))
    # each step is a projection of its own, so that what it makes is made once
    hashed = split.select(*held, "text", "words", "lines", "bits", _hashes().alias("hashes"))
    numbered = hashed.select(*held, "text", "words", "lines", "bits", F.sort_array(_numbered()).alias("numbered"))
    repeated = numbered.select(*held, "text", "words", "lines", F.sort_array(F.array_distinct(_pair_starts())).alias("starts"))
    among = lambda items, test: F.size(F.filter(items, test)).cast("long")
    counts = {
        "n_words": F.size("words").cast("long"),
        "word_chars": F.char_length(F.array_join("words", "")).cast("long"),
        "n_symbols": _matches(SYMBOL),
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        "n_repeat_words": _covered("starts"),
        "n_lines": F.size("lines").cast("long"),
        "n_list_lines": among("lines", lambda x: x.rlike(f"^[{SPACES}]*[-*•]")),
        "n_cut_lines": among("lines", lambda x: x.rlike(rf"(\.\.\.|…)[{SPACES}]*$")),
        "n_letter_words": F.size("words") - _matches(rf"{ALONE}[^\p{{L}}{SPACES}]+{ENDS}"),
        "n_stop_words": _matches(_word_pattern(STOP_WORDS)),
        "n_capital_words": _matches(rf"{ALONE}(?=[^{SPACES}]*\p{{Lu}})[^\p{{Ll}}{SPACES}]+{ENDS}"),
    }
    # explode of one element: a filter on a count stays above, or the optimizer would move it down and split the text anew for each word
    told = repeated.select(*held, F.explode(F.array(F.struct(*[counts[m].alias(m) for m in MEASURES]))).alias("told"))
    return told.select(*held, "told.*")


def breaks(rule: Rule) -> Column:
    """Whether the counts of a row are outside the rule; a share of nothing is inside."""
    unknown = [m for m in (rule.measure, rule.of) if m is not None and m not in MEASURES]
    if unknown or rule.at_least is None and rule.at_most is None:
        raise ValueError(f"rule {rule.name}: {unknown or 'no bound'}")
    value, unit = (F.col(rule.measure), F.lit(1)) if rule.of is None else (F.col(rule.measure) * 1000, F.col(rule.of))
    sides = [value < unit * rule.at_least] if rule.at_least is not None else []
    sides += [value > unit * rule.at_most] if rule.at_most is not None else []
    return reduce(or_, sides) & (unit > 0)


def base_fails() -> Column:
    """Fewer than 50 words, or over half of them in repeated windows."""
    return (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


def quality_rules(docs: DataFrame, rules: list[Rule] = RULES, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: (id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, broken_rules).

    Words are the runs of characters other than ASCII white space, lines are cut at line feeds and count if they hold a word; all counts are
    of whole texts. ``broken_rules`` names, in the table's order and joined by commas, the rules that a row breaks ('' for none); ``kept`` is true
    if there are none and the base holds. A rule without a bound or on an unknown count raises ValueError. Null and empty texts have no words,
    so they fail the base. Every row is judged alone, whether its id is null or repeated; an empty table gives an empty one; with no
    rules the base alone decides. Other columns are not read.
    """
    counted = measures(docs, [F.col(id_col)], F.col(text))
    broken = F.array_compact(F.array(*[F.when(breaks(r), F.lit(r.name)) for r in rules], F.lit(None).cast("string")))
    judged = counted.select(F.col("__key_0").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_fails().alias("base_failed"), broken.alias("broken"))
    kept = ~F.col("base_failed") & (F.size("broken") == 0)
    return judged.select(*judged.columns[:-1], kept.alias("kept"), F.array_join("broken", ",").alias("broken_rules"))
