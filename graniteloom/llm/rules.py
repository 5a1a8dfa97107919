"""Quality rules: a table of thresholds, compiled into one projection of built-in functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graniteloom.llm.common import SPACES, documents, fields_of, kept, row_of, text_of, words_of

#: Frequent function words of the four languages of the corpus.
STOP_WORDS = (
    "a an and are as at be by for from has have he in is it its of on or she that the their there they this to was were which with you "
    "als am auf aus bei das dass dem den der des die ein eine einem einen einer es für hat ich im ist mit nicht sich sie sind und von war wie zu "
    "au aux avec ce dans de des du elle en est et il ils je la le les mais ne on ou par pas pour que qui se sur un une "
    "al como con del el ella ellos entre era esta este la las lo los más no para pero por se sin su sus un una y"
).split()

#: Symbols that prose rarely holds.
SYMBOLS = "#*$%&|<>"

WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """A document fails the rule if `metric` lies outside [least, most]; a null metric passes."""

    name: str
    metric: str
    least: float | None = None
    most: float | None = None

    def failed(self) -> Column:
        outside = F.lit(False)
        if self.least is not None:
            outside = outside | (F.col(self.metric) < self.least)
        if self.most is not None:
            outside = outside | (F.col(self.metric) > self.most)
        return F.coalesce(outside, F.lit(False))


#: The production table. Ratios are per word or per line that holds a word.
RULES = (
    Rule("length", "n_words", least=10),
    Rule("word_length", "mean_word_chars", least=2.0, most=14.0),
    Rule("symbols", "symbol_ratio", most=0.25),
    Rule("stop_words", "stop_ratio", least=0.02),
    Rule("repeated_lines", "dup_line_ratio", most=0.35),
    Rule("repeated_words", "repeat_ratio", most=0.20),
)


def measures(docs: DataFrame, keep: list[str]) -> DataFrame:
    """`keep` columns of docs and the counts the rules are made of.

    A null text counts as empty; an empty text has no words and all counts 0. Texts are read whole.
    n_repeat_words are the words covered by windows of five words that occur twice or more in the text; windows
    are compared by 64-bit hashes, and only texts with an equal pair pay for the positions.
    """
    flat = SPACES + " "
    base = docs.select(*keep, text_of().alias("_t"))
    step = base.select(
        *keep,
        (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.length(F.translate("_t", flat, "")).cast("long").alias("word_chars"),
        F.filter(F.split("_t", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"),
        words_of(F.col("_t")).alias("_w"),
    )
    step = step.select(
        *keep,
        "n_symbols",
        "word_chars",
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size("_w").cast("long").alias("n_words"),
        F.size(F.filter("_w", lambda w: F.lower(w).isin(list(dict.fromkeys(STOP_WORDS))))).cast("long").alias("n_stop"),
        F.expr(
            f"CASE WHEN size(_w) >= {WINDOW} THEN transform(sequence(0, size(_w) - {WINDOW}), i -> xxhash64("
            + ", ".join(f"_w[i + {j}]" for j in range(WINDOW))
            + ")) ELSE cast(array() AS array<bigint>) END"
        ).alias("_h"),
    )
    counts = [c for c in step.columns if c != "_h"]
    step = step.select(
        *counts,
        F.expr("CASE WHEN size(array_distinct(_h)) < size(_h) THEN sort_array(transform(_h, (x, i) -> struct(x AS h, i AS p))) END").alias("_s"),
    )
    step = step.select(
        *counts,
        F.expr(
            "CASE WHEN _s IS NOT NULL THEN sort_array(transform(filter(sequence(0, size(_s) - 1), j -> "
            "(j > 0 AND get(_s, j - 1).h = _s[j].h) OR (j < size(_s) - 1 AND get(_s, j + 1).h = _s[j].h)), j -> _s[j].p)) END"
        ).alias("_p"),
    )
    return step.select(
        *counts,
        F.expr(
            f"CASE WHEN _p IS NULL THEN 0L ELSE aggregate(sequence(0, size(_p) - 1), 0L, "
            f"(a, j) -> a + CASE WHEN j = 0 THEN {WINDOW} ELSE least({WINDOW}, _p[j] - _p[j - 1]) END) END"
        ).alias("n_repeat_words"),
    )


MADE = (
    "n_symbols word_chars n_lines n_dup_lines n_words n_stop n_repeat_words mean_word_chars symbol_ratio stop_ratio repeat_ratio dup_line_ratio base_failed failed_rules kept"
).split()


def judged(docs: DataFrame, keep: list[str], rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts, base_failed, the names of the failed rules and kept, for each row of docs.

    base_failed: fewer than 10 words, or more than a fifth of the words in repeated windows. kept is false for
    those and for texts that fail any rule. Rows are independent, so null and repeated ids do not matter: equal rows
    get equal results, an empty table gives an empty one, and no row is moved between tasks. A column of keep with the
    name of a result gives way to it.
    """
    stay = kept(keep, *MADE)
    verdict = _judged(docs.select(row_of(stay).alias("_row"), text_of().alias("text")), rules)
    return verdict.select(*fields_of("_row", stay), *MADE)


def _judged(rows: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """_row and the results, for rows of _row and text."""
    n = F.nullif(F.col("n_words"), F.lit(0))
    ratios = measures(rows, ["_row"]).select(
        "*",
        (F.col("word_chars") / n).alias("mean_word_chars"),
        (F.col("n_symbols") / n).alias("symbol_ratio"),
        (F.col("n_stop") / n).alias("stop_ratio"),
        (F.col("n_repeat_words") / n).alias("repeat_ratio"),
        (F.col("n_dup_lines") / F.nullif(F.col("n_lines"), F.lit(0))).alias("dup_line_ratio"),
        ((F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))).alias("base_failed"),
    )
    failed = F.array_compact(F.array(*(F.when(r.failed(), F.lit(r.name)) for r in rules)))
    return ratios.withColumn("failed_rules", failed).withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of docs that pass, with the columns of docs: the filtering form of `judged`.

    Needs a text column; other columns pass through whatever their names. Rows with a null text fail.
    """
    body = docs.select(row_of(docs.columns).alias("_row"), "text")
    # The one-row explode keeps the filter from being pushed down, where the verdict's expressions would be unfolded
    # into each other and evaluated again and again.
    verdict = _judged(body, rules).select("_row", F.explode(F.array("kept")).alias("kept"))
    return verdict.where("kept").select(*fields_of("_row", docs.columns))


def op10(spark, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    return judged(documents(spark, sf_dir), ["doc_id"]).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )
