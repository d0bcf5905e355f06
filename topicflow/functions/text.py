"""Text expressions: trimming, cleaning, tokenizing, n-grams.

All of them stay on the JVM. Whitespace follows the Unicode definition plus the
four ASCII separators U+001C..U+001F, and word characters are letters, numbers
and underscore, so results do not depend on the regex engine's ASCII defaults.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from topicflow.functions import stopwords as sw

SPACE = r"[\s\x1c-\x1f]"
NON_SPACE = r"[^\s\x1c-\x1f]"
# every character the two classes above call whitespace, for trimming without a regex
SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
ALPHABET = "a-zа-яё"
WORD = r"[\p{L}\p{N}_]"


def strip(col: Column) -> Column:
    """Trim all Unicode whitespace (``F.trim`` removes only U+0020)."""
    return F.btrim(col, F.lit(SPACES))


def text_length(col: Column) -> Column:
    """Characters left after trimming; null counts as empty."""
    return F.length(strip(F.coalesce(col, F.lit(""))))


def letter_runs(
    col: Column,
    needs_lower: bool = True,
    alphabet: str = ALPHABET,
    min_len: int = 3,
) -> Column:
    """Maximal runs of ``alphabet`` letters with at least ``min_len`` of them.

    URLs are blanked first. Taking the runs directly equals replacing every
    other character by a space, splitting and dropping short tokens, in one
    regex pass instead of three.
    """
    text = F.coalesce(col, F.lit(""))
    if needs_lower:
        text = F.lower(text)
    text = F.regexp_replace(text, rf"(?U)(?:http|www){NON_SPACE}+", " ")
    return F.regexp_extract_all(text, F.lit(rf"(?iu)[{alphabet}]{{{min_len},}}"), F.lit(0))


def clean_tokens(
    col: Column,
    needs_lower: bool = True,
    stopwords: Sequence[str] = sw.DEFAULT,
    alphabet: str = ALPHABET,
    min_len: int = 3,
) -> Column:
    """Cleaned tokens. The stopword test is case-sensitive, so without
    lower-casing a capitalised stopword survives."""
    runs = letter_runs(col, needs_lower, alphabet, min_len)
    words = list(stopwords)
    if not words:
        return runs
    # isin() becomes a hash-set lookup, unlike array_contains on a literal array
    return F.filter(runs, lambda t: ~t.isin(words))


def clean_text(col: Column, needs_lower: bool = True, **options) -> Column:
    """Space-joined ``clean_tokens``; null gives an empty string."""
    return F.array_join(clean_tokens(col, needs_lower, **options), " ")


def strip_html(col: Column) -> Column:
    """Replace every tag by a space."""
    return F.regexp_replace(col, r"(?s)<[^>]+>", " ")


def space_tokens(col: Column) -> Column:
    """Whitespace tokens; null and blank give an empty array."""
    parts = F.split(F.coalesce(col, F.lit("")), rf"(?U){SPACE}+")
    return F.filter(parts, lambda t: t != "")


def word_tokens(col: Column, min_len: int = 2) -> Column:
    """Lower-cased words of at least ``min_len`` letters, numbers or underscores."""
    text = F.lower(F.coalesce(col, F.lit("")))
    return F.regexp_extract_all(text, F.lit(rf"{WORD}{{{min_len},}}"), F.lit(0))


def ngrams(tokens: Column, n: int) -> Column:
    """Space-joined n-grams of one array, empty when it is shorter than ``n``."""
    grams = tokens
    for i in range(1, n):
        grams = F.zip_with(
            F.slice(grams, F.lit(1), F.greatest(F.size(tokens) - i, F.lit(0))),
            F.slice(tokens, F.lit(i + 1), F.greatest(F.size(tokens) - i, F.lit(0))),
            lambda a, b: F.concat_ws(" ", a, b),
        )
    return grams


def ngram_range(tokens: Column, low: int = 1, high: int = 2) -> Column:
    """All n-grams for n in ``low..high`` in one array.

    The tokens are bound to a lambda variable: written out, Spark would find them again
    at each of their uses.
    """

    def grams(own: Column) -> Column:
        parts = [ngrams(own, n) for n in range(low, high + 1)]
        return parts[0] if len(parts) == 1 else F.concat(*parts)

    return F.get(F.transform(F.array(tokens), grams), 0)
