"""Text expressions. All of them stay inside the JVM."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a link, a removable character, white space and a word.
# (?U) makes \s and \S Unicode-aware; letters and digits are named by category,
# because \w also takes combining marks and drops some number signs.
LINK = r"(?U)http\S+|www\.\S+"
NOT_WORD_OR_SPACE = r"(?U)[^\p{L}\p{N}_\s]+"
SPACES = r"(?U)\s+"
# every run of white space but a single blank, which may stay as it is
UNEVEN_SPACES = r"(?U) \s+|[\s&&[^ ]]\s*"
WORD_OF_TWO = r"[\p{L}\p{N}_]{2,}"
CLOUD_WORD = r"[\p{L}\p{N}_][\p{L}\p{N}_']*"


def clean_text(text: Column) -> Column:
    """Drop links, then every character that is no word character or space, then
    squeeze white space. Letter case is kept."""
    has_link = text.contains("http") | text.contains("www.")
    without_links = F.when(has_link, F.regexp_replace(text, LINK, "")).otherwise(text)
    words_only = F.regexp_replace(without_links, NOT_WORD_OR_SPACE, "")
    return F.trim(F.regexp_replace(words_only, UNEVEN_SPACES, " "))


def whitespace_words(text: Column) -> Column:
    """Words between white space, case kept: the retrieval tokens."""
    return F.array_remove(F.split(text, SPACES), "")


def lower_words(text: Column) -> Column:
    """Lower-case runs of at least two word characters: the n-gram tokens."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD_OF_TWO), F.lit(0))


def cloud_words(text: Column) -> Column:
    """Words as a word cloud counts them: possessive 's cut, plain numbers left out."""
    words = F.regexp_extract_all(text, F.lit(CLOUD_WORD), F.lit(0))
    bare = F.transform(words, lambda w: F.regexp_replace(w, r"'[sS]$", ""))
    return F.filter(bare, lambda w: ~w.rlike(r"^\p{Nd}+$"))


def ngrams(words: Column, low: int, high: int, sep: str = " ") -> Column:
    """All n-grams of a word array for low <= n <= high, in one array."""
    if not 1 <= low <= high:
        raise ValueError("need 1 <= low <= high")
    by_size = []
    grams = words
    for n in range(1, high + 1):
        if n > 1:
            rest = F.greatest(F.size(words) - (n - 1), F.lit(0))
            grams = F.zip_with(
                F.slice(grams, F.lit(1), rest),
                F.slice(words, F.lit(n), rest),
                lambda left, right: F.concat(left, F.lit(sep), right),
            )
        if n >= low:
            by_size.append(grams)
    return F.concat(*by_size) if len(by_size) > 1 else by_size[0]


def only_words(words: str, listed: Collection[str] | None) -> Column:
    """Entries of an array column that are not listed become null, and so do n-grams with one; None lists all."""
    if listed is None:
        return F.col(words)
    # as text, which is much faster to build than a literal for each word
    kept = ", ".join("'" + w.replace("\\", "\\\\").replace("'", "\\'") + "'" for w in sorted(listed)) or "null"
    return F.expr(f"transform({words}, w -> if(w in ({kept}), w, null))")


def word_count(text: Column) -> Column:
    """Number of white-space words; 0 for a missing text."""
    return F.coalesce(F.size(whitespace_words(text)), F.lit(0))


def text_length(text: Column) -> Column:
    """Number of characters; 0 for a missing text."""
    return F.coalesce(F.char_length(text), F.lit(0))


def without_words(words: Column, stopwords: Collection[str]) -> Column:
    """Drop array entries that are in a (size-checked) set of stopwords.

    Spark turns the literal list into a hash set, so the cost per word is constant.
    """
    if not stopwords:
        return words
    listed = sorted(stopwords)
    return F.filter(words, lambda w: ~w.isin(listed))
