"""Quality rules with adaptive thresholds, in DataFrame functions only.

Fixed rules catch what is bad anywhere. What is unusual depends on where a text comes from, so further limits are
read off mergeable KLL quantile sketches of the passing documents of each language and source: partial sketches are
built before the shuffle, so a source with a third of all rows costs no task more than another. A group's quantiles are
drawn to its language's, and these to those of all documents, by SHRINK rows' weight, so that no number of rows switches
from one sketch to another.

Counts that are mostly 0 are compared as logarithms of smoothed shares, (count + unit / 2) / (words + unit): a long
text without a symbol shows more than a short one, so quartiles don't fall together where most counts are 0, and a
limit is never a constant.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tocsin.llm.common import Scratch, refuse

#: White space of words, and symbols that prose rarely holds.
WHITE_SPACE, SYMBOLS = " \t\n\x0b\f\r", "#*$%&|<>"
_SPACES = "[\\x20\\x09-\\x0D]+"
WINDOW = 8
#: Each rule: a value, and how many times the distance from the median to the upper (lower) quartile away from the median
#: its limits above (below) lie. Junk lifts a limit only from a quarter of a group on.
RULES = {
    "symbol_share": ("ln((n_symbols + 0.5) / (n_words + 1))", 6.0, None),
    "duplicate_line_share": ("ln((n_dup_lines + 0.5) / (n_words + 1))", 6.0, None),
    "repeat_share": ("ln((n_repeat_words + 8) / (n_words + 16))", 6.0, None),
    "word_length": ("word_chars / n_words", 7.6, 7.6),
}
QUARTILES = 0.25, 0.75
#: Rows' weight by which a group's quantiles are drawn to those of the wider sketch.
SHRINK = 20.0
SKETCH_K = 400


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def _repeated_words(hashes: Column) -> Column:
    """Words under windows whose hash occurs twice or more; hashes: one for each window, in order."""

    def covered(places: Column) -> Column:
        steps = F.transform(places, lambda p, k: F.when(k + 1 < F.size(places), F.least(F.lit(WINDOW), F.get(places, k + 1) - p)).otherwise(WINDOW))
        return F.aggregate(steps, F.lit(0), lambda total, x: total + x)

    def twice(ordered: Column) -> Column:
        same = lambda a, b: F.get(ordered, a)["h"] == F.get(ordered, b)["h"]
        rows = F.filter(ordered, lambda x, k: ((k > 0) & same(k - 1, k)) | ((k + 1 < F.size(ordered)) & same(k, k + 1)))
        return _let(F.sort_array(F.transform(rows, lambda x: x["i"])), covered)

    marked = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(_let(marked, twice))


def measures(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """keep and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of every whole text; null counts as empty."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    words = F.filter(F.split(text, _SPACES, -1), lambda w: w != "")
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    lines = F.filter(F.split(text, "\n", -1), lambda line: F.translate(line, WHITE_SPACE, "") != "")
    windows = lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - WINDOW + 1), lambda i: F.xxhash64(F.slice(h, i, F.lit(WINDOW))))
    counts = _let(hashes, lambda h: F.struct(F.size(h).alias("words"), F.when(F.size(h) > WINDOW, _let(windows(h), _repeated_words)).otherwise(0).alias("repeated")))
    out = docs.select(
        *keep,
        counts.alias("_counts"),
        F.length(F.translate(text, WHITE_SPACE, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    )
    return out.select(*keep, F.col("_counts.words").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", F.col("_counts.repeated").cast("long").alias("n_repeat_words"))


def limits(measured: DataFrame, shrink: float = SHRINK) -> DataFrame:
    """(_lang, _source, <rule>_most, <rule>_least): limits of each group among the documents that pass the fixed rules."""
    passing = measured.where(~F.col("base_failed"))
    own = passing.groupBy("lang", "source").agg(*(F.kll_sketch_agg_double(F.expr(value), F.lit(SKETCH_K)).alias(name) for name, (value, _, _) in RULES.items()))
    wider = lambda key: own.groupBy(*key).agg(*(F.kll_merge_agg_double(name, F.lit(SKETCH_K)).alias(f"{name}_{'lang' if key else 'all'}") for name in RULES))
    everything = wider([]).withColumn("_one", F.lit(1))
    joined = own.withColumn("_one", F.lit(1)).join(everything, "_one")
    langs = wider(["lang"]).withColumnRenamed("lang", "_lang")
    joined = joined.join(langs, F.col("lang").eqNullSafe(F.col("_lang")))
    out = [F.col("lang").alias("_lang"), F.col("source").alias("_source")]
    for name, (_, above, below) in RULES.items():

        def at(q: float, name: str = name) -> Column:
            quantile = lambda sketch: F.kll_sketch_get_quantile_double(sketch, F.lit(q))
            value = quantile(f"{name}_all")
            for sketch in (f"{name}_lang", name):
                n = F.kll_sketch_get_n_double(sketch)
                value = (n * quantile(sketch) + shrink * value) / (n + shrink)
            return value

        out.append((at(0.5) + above * (at(QUARTILES[1]) - at(0.5))).alias(f"{name}_most"))
        if below is not None:
            out.append((at(0.5) - below * (at(0.5) - at(QUARTILES[0]))).alias(f"{name}_least"))
    return joined.select(*out)


def quality_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", carry: tuple[str, ...] = ()) -> DataFrame:
    """Judge every whole text: (doc_id, *carry, counts, base_failed, kept, reason), one row for each row of docs.

    base_failed: fewer than 20 words, or over 30 % of the words lie in 8-word windows that the text repeats. kept is
    false for these and for texts beyond a limit of their language and source; reason names the first such rule. A
    null text counts as empty, null languages and sources are groups of their own, rows that repeat an id are judged
    one by one, an empty table gives an empty table. carry names further columns to hand through; a name of the result is
    refused, other columns are ignored.
    """
    refuse(carry, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "reason")
    scratch = Scratch(docs.sparkSession)
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("_text"), *(F.col(c).alias(f"_carry_{c}") for c in carry))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    measured = scratch.write(measures(named, ["doc_id", "lang", "source", *(f"_carry_{c}" for c in carry)], "_text").withColumn("base_failed", failed))
    own_limits = scratch.write(limits(measured))
    judged = measured.join(own_limits, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    reasons = [F.when(F.col("base_failed"), F.lit("base"))]
    for name, (rule, _, below) in RULES.items():
        value = F.when(F.col("n_words") > 0, F.expr(rule))
        outside = value > F.col(f"{name}_most")
        reasons.append(F.when(outside | (value < F.col(f"{name}_least")) if below is not None else outside, F.lit(name)))
    return judged.select(
        "doc_id", *(F.col(f"_carry_{c}").alias(c) for c in carry), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.coalesce(*reasons).isNull().alias("kept"), F.coalesce(*reasons).alias("reason"),
    )
