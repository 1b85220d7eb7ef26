"""Text column expressions: whitespace, sentences, tokens, phrase segmentation.

Everything here returns a ``Column`` built from Spark built-ins and
higher-order functions, so it runs inside whole-stage code generation and
works unchanged on batch and streaming DataFrames.  No Python UDF.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.functions.stopwords import coherence_stopwords, segmentation_stopwords

# Whitespace exactly as Python's ``str.split()`` / ``\s`` sees it: ASCII
# controls including U+001C..U+001F, NEL, and every Unicode separator (Z*).
# Java's ``\s`` (even with (?U)) misses U+001C..U+001F, so the class is explicit.
WS_CLASS = r"[\t\n\x0B\f\r\x1C-\x1F \x85\p{Z}]"
NON_WS_RUN = r"[^\t\n\x0B\f\r\x1C-\x1F \x85\p{Z}]+"
SENTENCE_DELIMS = r"[.!?]+"
SEGMENT_TOKEN = r"[A-Za-z0-9']+"
# Two or more Unicode letters/digits/underscore: the vectoriser's default word.
VECTOR_TOKEN = r"[\p{L}\p{N}_]{2,}"
COHERENCE_TOKEN = r"[a-z]+"
# Separator used between units inside one string; outside the token alphabet.
_SEP = "|"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def normalize_text(col) -> Column:
    """Collapse whitespace runs to one space and strip.  NULL stays NULL."""
    return F.trim(F.regexp_replace(_c(col), WS_CLASS + "+", " "))


def whitespace_token_count(col) -> Column:
    """Number of whitespace-separated tokens; NULL text counts 0."""
    return F.coalesce(F.regexp_count(_c(col), F.lit(NON_WS_RUN)), F.lit(0))


def split_sentences(col) -> Column:
    """Sentences split on runs of ``.!?``, stripped, empties dropped.

    NULL text gives an empty array.
    """
    parts = F.split(normalize_text(col), SENTENCE_DELIMS)
    out = F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != F.lit(""))
    return F.coalesce(out, F.array().cast("array<string>"))


def segment_tokens(col) -> Column:
    """Lower-cased ``[A-Za-z0-9']+`` tokens (accented letters split words)."""
    return F.regexp_extract_all(F.lower(_c(col)), F.lit(SEGMENT_TOKEN), 0)


def _is_stop(tok: Column, stopwords: Sequence[str]) -> Column:
    return tok.isin(list(stopwords))


def _marked_tokens(sentence, stopwords: Sequence[str] | None = None) -> Column:
    """Tokens of one sentence joined by spaces, ``_SEP`` in the place of each stopword."""
    sw = segmentation_stopwords() if stopwords is None else list(stopwords)
    marked = F.transform(segment_tokens(sentence),
                         lambda t: F.when(_is_stop(t, sw), F.lit(_SEP)).otherwise(t))
    return F.array_join(marked, " ")


def stopword_fragments(sentence, stopwords: Sequence[str] | None = None) -> Column:
    """Maximal runs of non-stopword tokens of one sentence, each joined by spaces."""
    frags = F.transform(F.split(_marked_tokens(sentence, stopwords), r"\|"), lambda f: F.trim(f))
    return F.filter(frags, lambda f: f != F.lit(""))


def _merged_units(marked: Column, min_tokens: int) -> Column:
    """``merge_short_fragments`` of marked tokens, by one pattern: a unit is ``min_tokens`` tokens, what is
    left of the fragment of the last one, and fewer than ``min_tokens`` tokens before the end; or all,
    where there are fewer.  Possessive parts: no recursion, however long the sentence."""
    k = max(1, min_tokens)
    tok, gap = f"[^ {_SEP}]++", f"[ {_SEP}]++"
    unit = f"(?:{tok}{gap}){{{k - 1}}}+{tok}(?: {tok})*+"
    if k > 1:
        unit += f"(?:(?:{gap}{tok}){{1,{k - 1}}}+$)?|^.++"
    units = F.regexp_extract_all(F.btrim(marked, F.lit(" " + _SEP)), F.lit(unit), 0)
    return F.transform(units, lambda u: F.replace(u, F.lit(" " + _SEP), F.lit("")))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` as a lambda variable.

    Spark evaluates higher-order functions without common-subexpression
    elimination, so an expression used twice inside a lambda is computed
    twice.  Wrapping it in a one-element array and transforming that binds it.
    """
    return F.transform(F.array(value), body)[0]


def _n_tokens(phrase: Column) -> Column:
    # tokens are joined by single spaces: count spaces + 1 (no regex split)
    return F.length(phrase) - F.length(F.replace(phrase, F.lit(" "), F.lit(""))) + 1


def merge_short_fragments(fragments: Column, min_tokens: int = 5) -> Column:
    """Greedy left-to-right merge of fragments into units of >= ``min_tokens``.

    The buffer grows fragment by fragment and is emitted once it holds
    ``min_tokens`` tokens; a leftover buffer joins the last emitted unit, or is
    a unit of its own when nothing was emitted.  The fold carries only an
    integer and one flag character per fragment, so the state stays small even
    for sentences with tens of thousands of fragments.
    """
    init = F.struct(F.lit(0).alias("buf"), F.lit("").alias("flags"))

    def step(acc, frag):
        nb = acc["buf"] + _n_tokens(frag)
        closes = nb >= F.lit(min_tokens)
        return F.struct(
            F.when(closes, F.lit(0)).otherwise(nb).alias("buf"),
            F.concat(acc["flags"], F.when(closes, F.lit("1")).otherwise(F.lit("0"))).alias("flags"),
        )

    def build(frags, state):
        # one flag per fragment: "1" closes a unit
        flag_arr = F.split(state["flags"], "")
        pieces = F.zip_with(frags, flag_arr, lambda f, g: F.concat(
            f, F.when(g == F.lit("1"), F.lit(_SEP)).otherwise(F.lit(" "))))

        def finish(joined):
            # A leftover (buffer not empty at the end) joins the previous
            # unit: turn the last separator into a space.
            last_sep = F.length(joined) - F.instr(F.reverse(joined), _SEP) + 1
            has_leftover = (state["buf"] > 0) & (F.instr(joined, _SEP) > 0)
            fixed = F.when(has_leftover, F.overlay(joined, F.lit(" "), last_sep, F.lit(1))).otherwise(joined)
            units = F.transform(F.split(fixed, r"\|"), lambda u: F.trim(u))
            return F.filter(units, lambda u: u != F.lit(""))

        return let(F.array_join(pieces, ""), finish)

    return let(fragments, lambda frags: let(F.aggregate(frags, init, step), lambda st: build(frags, st)))


def _with_fallback(units: Column, sentence: Column) -> Column:
    return let(units, lambda u: F.when(F.size(u) == 0, F.array(F.trim(F.lower(sentence)))).otherwise(u))


def segment_base(col, stopwords: Sequence[str] | None = None) -> Column:
    """Units of a review: stopword-split phrases; a sentence with no phrase
    falls back to the whole lower-cased sentence."""
    per_sentence = F.transform(
        split_sentences(col),
        lambda s: _with_fallback(stopword_fragments(s, stopwords), s),
    )
    units = F.flatten(per_sentence)
    return F.filter(units, lambda u: u != F.lit(""))


def segment_mintoken(col, min_tokens: int = 5, drop_if_short: int = 3,
                     stopwords: Sequence[str] | None = None) -> Column:
    """Units of a review with short fragments merged.

    Per sentence: merge fragments to >= ``min_tokens`` tokens, drop units with
    fewer than ``drop_if_short`` tokens, and if all are dropped keep the whole
    lower-cased sentence (stopwords included).
    """
    def per_sentence(s):
        merged = _merged_units(_marked_tokens(s, stopwords), min_tokens)
        kept = F.filter(merged, lambda u: _n_tokens(u) >= F.lit(drop_if_short))
        return _with_fallback(kept, s)

    units = F.flatten(F.transform(split_sentences(col), per_sentence))
    return F.filter(units, lambda u: u != F.lit(""))


def vectorizer_tokens(col) -> Column:
    """Lower-cased words of two or more letters/digits (the vectoriser default)."""
    return F.regexp_extract_all(F.lower(_c(col)), F.lit(VECTOR_TOKEN), 0)


def coherence_tokens(col, stopwords: Sequence[str] | None = None) -> Column:
    """Lower-cased ``[a-z]+`` tokens minus the full English stopword list."""
    sw = coherence_stopwords() if stopwords is None else list(stopwords)
    toks = F.regexp_extract_all(F.lower(_c(col)), F.lit(COHERENCE_TOKEN), 0)
    toks = F.filter(toks, lambda t: ~t.isin(sw))
    return F.coalesce(toks, F.array().cast("array<string>"))
