"""Text analyzers as Column expressions; only what one word becomes is there in Python too."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Longest first, which is all that their order decides.
SUFFIXES = tuple(sorted("ed ied able ible ive ing al ful en sion tion er s es ies less ness ous ment ly ingly".split(), key=lambda x: (-len(x), x)))
STOP_WORDS = tuple(
    sorted(
        (
            "a i be he me we if of an in on no so to up or as is us at it by my had and she the one are own who too her for "
            "our has was his its not but out you how why some were more have with will them whom from than then when into "
            "over your this that what just they very while there where these which their"
        ).split()
    )
)
NOT_WORD = r"[^\p{IsAlphabetic}\p{M}\p{N}]+"


def stem(w: Column) -> Column:
    """A word without the first suffix of the list that leaves more than two bytes."""
    out = w
    for s in reversed(SUFFIXES):
        out = F.when(w.endswith(s) & (F.octet_length(w) > len(s) + 2), F.substring(w, F.lit(1), F.char_length(w) - len(s))).otherwise(out)
    return out


def words(text: Column) -> Column:
    """What ``standard`` makes terms of, word by word."""
    return F.split(F.lower(text), NOT_WORD)


_STOP, _SUFFIXES = {w.encode() for w in STOP_WORDS}, tuple(s.encode() for s in SUFFIXES)


def standard_word(w: bytes) -> bytes | None:
    """The term that ``standard`` makes of one of ``words``, in UTF-8; None of one that it leaves out."""
    if len(w) < 2 or w in _STOP:
        return None
    return next((w[: -len(s)] for s in _SUFFIXES if w.endswith(s) and len(w) > len(s) + 2), w)


def standard(text: Column) -> Column:
    """Lower-cased words of two bytes or more, without stop words, stemmed."""
    kept = F.filter(words(text), lambda w: (F.octet_length(w) >= 2) & ~w.isin(*STOP_WORDS))
    return F.transform(kept, stem)


def whitespace(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")


def keyword(text: Column) -> Column:
    return F.when(text.isNotNull(), F.array(text))


def ngram(text: Column, least: int = 2, most: int = 3) -> Column:
    """All windows of ``least`` to ``most`` characters of the lower-cased text, blank ones left out."""
    low = F.lower(text)

    def windows(n: int) -> Column:
        starts = F.when(F.char_length(low) >= n, F.sequence(F.lit(1), F.char_length(low) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.substring(low, i, F.lit(n)))

    return F.filter(F.concat(*map(windows, range(least, most + 1))), lambda w: F.trim(w) != "")


def edge_ngram(text: Column, least: int = 2, most: int = 10) -> Column:
    """Prefixes of ``least`` to ``most`` characters of each word."""

    def prefixes(w: Column) -> Column:
        top = F.least(F.lit(most), F.char_length(w))
        sizes = F.when(top >= least, F.sequence(F.lit(least), top)).otherwise(F.array().cast("array<int>"))
        return F.transform(sizes, lambda n: F.substring(w, F.lit(1), n))

    return F.flatten(F.transform(whitespace(text), prefixes))


#: Analyzers that make a term of each word by itself: the words, and what becomes of one.
BY_WORD = {"standard": (words, standard_word)}
ANALYZERS = {"standard": standard, "whitespace": whitespace, "keyword": keyword, "ngram": ngram, "edge_ngram": edge_ngram}
