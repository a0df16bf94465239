"""Text functions as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}_]+"
LEAF = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+"


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def normalize_text(text: Column) -> Column:
    """Line ends as line feeds, tabs as spaces, stripped, runs of spaces as one; line feeds stay. Null is empty."""
    lines = F.translate(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n", "\n"), r"\r", "\n"), "\t", " ")
    return F.regexp_replace(strip(lines), r" {2,}", " ")


def normalize_token(text: Column, default: str = "empty") -> Column:
    """Lower case, runs of other characters than letters, digits and underscores as one underscore, none at the ends."""
    joined = F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]+", "_"), r"^_+|_+$", "")
    return F.coalesce(F.nullif(joined, F.lit("")), F.lit(default))


def first_filled(*columns: Column) -> Column:
    """The first value that is neither null nor empty; empty if none is."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns], F.lit(""))


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def ngrams(words: Column, n: int, glue: str = "_") -> Column:
    """Adjacent ``n`` words joined by ``glue``."""
    if n == 1:
        return words
    starts = F.sequence(F.lit(1), F.size(words) - (n - 1))
    return F.when(F.size(words) >= n, F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), glue))).otherwise(F.array().cast("array<string>"))


def preprocessed(text: Column, stopwords: Sequence[str] = (), n: int = 1) -> Column:
    """Lower-cased words of ASCII letters, digits and underscores without ``stopwords``, as n-grams joined by underscores; all else parts words."""
    words = F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9_]+", " "), " "), lambda w: w != "")
    return ngrams(F.filter(words, lambda w: ~w.isin(*stopwords)) if stopwords else words, n)


def unit_float(*parts: Column) -> Column:
    """A number from 0 to 1 drawn from ``parts``: the first 8 bytes of the SHA-256 digest of the parts joined by a pipe, over 2^64."""
    digest = F.sha2(F.concat_ws("|", *parts).cast("binary"), 256)
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(2.0**64)


def f1(precision: Column, recall: Column) -> Column:
    """Harmonic mean, 0 where both are 0."""
    return F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(F.lit(0.0))
