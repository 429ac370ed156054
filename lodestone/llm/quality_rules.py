"""Quality rules: a threshold table compiled into one Spark projection.

The table RULES lists (name, ratio, lowest, highest). Every ratio is a Column over counts that the
projection takes from the text itself; no user function runs, nothing is shuffled, and a document
is judged from its own row alone, so the plan is one scan however large the table is.

Defined results: null text counts as empty and fails the base rule; repeated rows are judged
alike; an empty table gives an empty one; a text of any length is one row's arrays in one task; the
stop-word rule asks for words of the document's own language (the column lang, where there is one)
and is skipped where that is null or not listed; keep() passes all columns through; judge() adds
its columns to those it is given. Word and line equality is judged on 64-bit hashes inside one document.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.rows import ROW, unwrap, wrap

SEP = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[^#*$%&|<>]+"

# Frequent function words of the supported languages.
STOP_WORDS = {
    "en": "the be to of and that have with in is was for on are as by at from or an a it this which",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als",
    "fr": "de la le et les des en un du une que est pour qui dans par au sur pas plus avec",
    "es": "de la que el en y a los se del las por un para con no una su al lo",
}

# (name, lowest allowed, highest allowed); None leaves that side open. A ratio that is null passes.
RULES: tuple[tuple[str, float | None, float | None], ...] = (
    ("mean_word_chars", 2.0, 12.0),
    ("symbols_per_word", None, 0.10),
    ("stop_word_share", 0.02, None),
    ("dup_line_share", None, 0.50),
    ("ellipsis_line_share", None, 0.50),
    ("capital_share", None, 0.50),
    ("exclaim_per_word", None, 0.10),
)
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate value once and use it many times inside body, also within nested lambdas."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SEP), "")


def repeat_words(words: Column, width: int = 3) -> Column:
    """Words inside width-word windows that occur twice or more in the same array."""

    def covered(pairs: Column) -> Column:
        same = F.filter(
            pairs,
            lambda p, i: (F.get(pairs, i - 1)["h"] == p["h"]) | (F.get(pairs, i + 1)["h"] == p["h"]),
        )
        at = F.array_sort(F.transform(same, lambda p: p["i"]))
        return F.aggregate(
            at,
            F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
            lambda a, p: F.struct(
                (a["n"] + p + width - F.greatest(p, a["end"])).alias("n"), (p + width).alias("end")
            ),
        )["n"]

    def count(w: Column) -> Column:
        grams = F.transform(
            F.slice(w, 1, F.greatest(F.size(w) - (width - 1), F.lit(0))),
            lambda x, i: F.xxhash64(x, *(F.get(w, i + k) for k in range(1, width))),
        )
        return let(
            grams,
            lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(
                let(F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), covered)
            ),
        )

    return let(words, count)


def is_stop_word(word: Column, lang: Column) -> Column:
    """Null where the language has no list."""
    out = F.lit(None).cast("boolean")
    for name, listed in STOP_WORDS.items():
        out = F.when(lang == name, word.isin(*sorted(set(listed.split())))).otherwise(out)
    return out


def counts(df: DataFrame, text: str = "text", lang: str | None = None) -> DataFrame:
    """Add the counts that the contract and the rules need; lang is the column of the document's language."""
    t = F.coalesce(F.col(text), F.lit(""))
    spoken = F.col(lang).cast("string") if lang else F.lit(None).cast("string")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumn("_words", words_of(F.col(text))).withColumn("_lines", F.transform(lines, lambda x: F.xxhash64(x)))
    return df.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_symbols": F.length(F.regexp_replace(t, SYMBOLS, "")).cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": repeat_words(F.col("_words")).cast("long"),
            "n_stop_words": F.when(spoken.isin(*STOP_WORDS), F.size(F.filter("_words", lambda w: is_stop_word(F.lower(w), spoken)))).cast("long"),
            "n_ellipsis_lines": F.regexp_count(t, F.lit(r"(?m)(?:\.\.\.|…)[ \t]*$")).cast("long"),
            "n_capitals": F.length(F.regexp_replace(t, r"\P{Lu}+", "")).cast("long"),
            "n_exclaims": F.length(F.regexp_replace(t, r"[^!?]+", "")).cast("long"),
        }
    ).drop("_words", "_lines")


def ratios() -> dict[str, Column]:
    def per(a: str, b: str) -> Column:
        return F.col(a).cast("double") / F.greatest(F.col(b), F.lit(1)).cast("double")

    return {
        "mean_word_chars": per("word_chars", "n_words"),
        "symbols_per_word": per("n_symbols", "n_words"),
        "stop_word_share": per("n_stop_words", "n_words"),
        "dup_line_share": per("n_dup_lines", "n_lines"),
        "ellipsis_line_share": per("n_ellipsis_lines", "n_lines"),
        "capital_share": per("n_capitals", "word_chars"),
        "exclaim_per_word": per("n_exclaims", "n_words"),
    }


def judge(df: DataFrame, text: str = "text", rules=RULES, lang: str | None = None) -> DataFrame:
    """Add the counts, base_failed and kept to every row."""
    r = ratios()
    ok = F.lit(True)
    for name, low, high in rules:
        if low is not None:
            ok = ok & F.coalesce(r[name] >= F.lit(low), F.lit(True))
        if high is not None:
            ok = ok & F.coalesce(r[name] <= F.lit(high), F.lit(True))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return counts(df, text, lang).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & ok)


def keep(docs: DataFrame, text: str = "text", rules=RULES, lang: str = "lang") -> DataFrame:
    """The documents, all columns, that the rules keep."""
    spoken = F.col(lang).cast("string") if lang in docs.columns else F.lit(None).cast("string")
    judged = judge(wrap(docs, text=F.col(text), lang=spoken), rules=rules, lang="lang")
    return unwrap(judged.filter("kept").select(ROW))
