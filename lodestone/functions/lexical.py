"""Lexical analysis as Columns: two tokenizers, query heuristics, quotes and hints.

Words for BM25 and rank terms are different things and are never mixed: BM25 words are lower-case
runs of two or more letters, digits or underscores without stopwords, possibly stemmed; rank
terms are sets of identifiers and their parts with a plural s taken off.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stopwords of the BM25 analyzer.
STOPWORDS = (
    "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with"
).split()
# Stopwords of rank terms and query profiles.
RANK_STOPWORDS = "a an and are for how in is of the to what when where which who why".split()

WORD = r"[\p{L}\p{N}_]{2,}"
TERM = r"[A-Za-z0-9_/-]+"
PART = r"[A-Za-z0-9]{2,}"
COMPOUND = r"(?<![A-Za-z0-9_/-])[A-Za-z0-9]*+[_/-][A-Za-z0-9_/-]*+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate value once per row and use it in body, also inside lambdas, where it would be evaluated for
    each element otherwise."""
    return F.transform(F.array(value), body)[0]


def array_of(words: list[str]) -> Column:
    return F.array(*(F.lit(w) for w in words))


def words(text: Column) -> Column:
    """BM25 words in order, repeats kept, stopwords out, not stemmed."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)), lambda w: ~w.isin(*STOPWORDS))


def normal_term(term: Column) -> Column:
    low = F.lower(term)
    return F.when((F.length(low) > 3) & low.endswith("s"), F.substring(low, F.lit(1), F.length(low) - 1)).otherwise(low)


def rank_terms(text: Column, stopwords: bool = False) -> Column:
    """Distinct terms and parts of terms; with stopwords=True rank stopwords are taken out, after normalising."""
    # the parts of all terms are the runs without separators; only terms with one are more than their part
    parts, compound = (F.regexp_extract_all(text, F.lit(x), F.lit(0)) for x in (PART, COMPOUND))
    found = F.array_distinct(F.concat(parts, F.filter(compound, lambda t: F.length(t) > 1)))
    terms = F.array_distinct(F.transform(found, normal_term))
    return F.array_except(terms, array_of(RANK_STOPWORDS)) if stopwords else terms


def query_terms(query: Column) -> Column:
    return F.filter(F.regexp_extract_all(F.lower(query), F.lit(TERM), F.lit(0)), lambda t: F.length(t) > 1)


def keywordish(query: Column) -> Column:
    """Whether a query has strong lexical anchors."""
    found = F.regexp_extract_all(F.lower(query), F.lit(TERM), F.lit(0))
    first, second = F.get(found, F.lit(0)), F.get(found, F.lit(1))
    asks = (F.size(found) <= 4) & (first == "what") & F.coalesce(second.isin("is", "are"), F.lit(False))
    joined = F.exists(found, lambda w: w.rlike("[_/-]") | w.rlike("[0-9]"))
    # an all-capitals word has a cased letter and no lower-case one
    capitals = F.exists(F.split(query, r"(?U)\s+"), lambda w: (F.length(w) > 1) & w.rlike(r"\p{Lu}") & ~w.rlike(r"\p{Ll}"))
    dense = (F.size(found) <= 6) & ~F.exists(found, lambda w: w.isin(*RANK_STOPWORDS))
    return F.when(F.size(found) == 0, F.lit(False)).otherwise(asks | joined | capitals | dense)


def compact(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), "^ | $", "")


def trim_boundary(text: Column, limit: int) -> Column:
    """Collapse white space and cut at the last space before the limit."""
    c = compact(text)
    head = F.substring(c, 1, limit)
    at = F.length(F.regexp_extract(head, r"(?s)^(.*) ", 1))
    cut = F.when(at > 0, F.substring(head, F.lit(1), at)).otherwise(head)
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(F.regexp_replace(cut, r"(?U)\s+$", ""), F.lit("...")))


def best_quote(content: Column, query: Column, limit: int = 360) -> Column:
    """A snippet about the earliest query term found; null for blank content."""

    def quote(c: Column) -> Column:
        def around(pos: Column) -> Column:
            start = F.greatest(pos - 121, F.lit(0))
            end = F.least(F.length(c), pos - 1 + limit - 120)
            snippet = F.concat(
                F.when(start > 0, F.lit("...")).otherwise(F.lit("")), F.substring(c, start + 1, end - start),
                F.when(end < F.length(c), F.lit("...")).otherwise(F.lit("")),
            )
            return let(F.when(pos.isNotNull(), snippet).otherwise(c), lambda x: trim_boundary(x, limit))

        found = let(F.lower(c), lambda low: F.filter(F.transform(query_terms(query), lambda t: F.instr(low, t)), lambda p: p > 0))
        return F.when(c == "", F.lit(None).cast("string")).otherwise(let(F.array_min(found), around))

    return let(compact(content), quote)


def near_dup_key(text: Column) -> Column:
    return F.substring(F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " ")), 1, 220)


def matched_terms(query: Column, quote: Column) -> Column:
    return let(F.lower(quote), lambda low: F.filter(query_terms(query), lambda t: F.contains(low, t)))


def match_hint(query: Column, value: Column) -> Column:
    """The first five of the sorted distinct query terms found in value, joined."""
    found = let(F.lower(value), lambda low: F.filter(query_terms(query), lambda t: F.contains(low, t)))
    return F.array_join(F.slice(F.array_sort(F.array_distinct(found)), 1, 5), ", ")
