"""Text columns: folding, sanitising, keyword tests, content checks."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What a missing value is written as, in any case.
SENTINELS = ("", "none", "null", "nan")
#: Patterns of error pages, then of bot checks, in lower case; a text that holds one isn't content.
INVALID = (
    "error scraping content", "no content saving", "no content", "<!doctype html>", "404 not found", "page not found", "document not found", "the resource requested could not be found",
    "diese seite wurde nicht gefunden", "seite nicht gefunden", "page introuvable",
    "verifying you are human", "enable javascript and cookies", "cloudflare", "waiting for .* to respond", "performance & security by cloudflare", "ray id",
)


@F.pandas_udf(T.StringType())
def ascii_fold(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """NFKD without what isn't ASCII; null stays null. No built-in does this."""
    for b in batches:
        yield b.map(lambda t: None if t is None else unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode())


def strip(x: Column) -> Column:
    """x without white space of any kind at its ends (trim() only takes spaces)."""
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def fold(x: Column) -> Column:
    """Lower case, ASCII, stripped. 'É ' -> 'e'; letters without an ASCII base vanish."""
    return strip(F.lower(ascii_fold(x)))


def fold_words(x: Column) -> Column:
    """fold(), hyphens as blanks, without punctuation, single blanks."""
    return strip(F.regexp_replace(F.regexp_replace(F.regexp_replace(fold(x), "-", " "), r"[^\w\s]", ""), r"\s+", " "))


def fold_hyphens(x: Column) -> Column:
    """fold() with hyphens as blanks; null becomes ''."""
    return F.coalesce(strip(F.regexp_replace(fold(x), "-", " ")), F.lit(""))


def null_if_sentinel(x: Column) -> Column:
    """Null for '', 'none', 'null', 'nan' in any case and with blanks around."""
    return F.when(~F.lower(strip(x)).isin(*SENTINELS), x)


def null_if_blank(x: Column) -> Column:
    """Null for texts of white space only."""
    return F.when(~x.rlike(r"^\s*$"), x)


def safe_name(x: Column) -> Column:
    """Letters, digits, blank, '_' and '-' only, without blanks at the end: a file name."""
    return F.regexp_replace(F.regexp_replace(x, r"[^\p{L}\p{N} _-]", ""), r"\s+$", "")


def concat_key(*cols: str) -> Column:
    """The columns joined by a blank; nulls count as absent."""
    return F.concat_ws(" ", *cols)


def compose_address(*cols: str) -> Column:
    """The parts that aren't empty, joined by ', '; null if there are none."""
    return F.nullif(F.concat_ws(", ", *(F.nullif(F.col(c), F.lit("")) for c in cols)), F.lit(""))


def geocode_query(address: str, *more: str) -> Column:
    """'address, plz, ort'; null without an address."""
    return F.when(F.col(address).isNotNull(), F.concat_ws(", ", address, *(null_if_sentinel(F.col(c)) for c in more)))


def contains_any(x: Column, words: list[str]) -> Column:
    """True if x holds one of the words (empty ones aside); false for null."""
    hit = F.lit(False)
    for w in sorted({w for w in words if w}):
        hit = hit | F.contains(x, F.lit(w))
    return F.coalesce(hit, F.lit(False))


def keyword_score(x: Column, weights: dict[str, int]) -> Column:
    """The sum over keywords of weight times occurrences as a whole word; 0 for null."""
    total = F.lit(0)
    for word, weight in sorted(weights.items()):
        total = total + F.coalesce(F.regexp_count(x, F.lit(rf"(?i)\b\Q{word}\E\b")), F.lit(0)) * weight
    return total


def valid_content(x: Column, least: int = 200, invalid: tuple[str, ...] = INVALID) -> Column:
    """True for a text of `least` characters or more, the blanks around it aside, that holds none of the patterns; false for null."""
    return F.coalesce((F.length(strip(x)) >= least) & ~F.lower(x).rlike("|".join(f"(?:{p})" for p in invalid)), F.lit(False))


def visible(x: Column, least: int = 300) -> Column:
    """True for a text of `least` characters or more without the blanks around it."""
    return F.coalesce(F.length(strip(x)) >= least, F.lit(False))


def species_flag(specialization: Column, category: str) -> Column:
    """True or false, or null where nothing is known: whether the specialization names the category."""
    return F.when(null_if_blank(specialization).isNotNull(), F.contains(F.lower(specialization), F.lit(category)))


def token_estimate(n_tokens: Column, messages: int = 1) -> Column:
    """Tokens of a chat request: those of the text, 4 for each message and 2 at the end."""
    return n_tokens + 4 * messages + 2


def image_tokens(width: Column, height: Column, per_megapixel: int = 85) -> Column:
    """Tokens of an image by its size."""
    return F.round(width * height / 1e6 * per_megapixel).cast("int")


def label_number(x: Column, numbers: dict[str, int], otherwise: int | None = None) -> Column:
    """The number of a label; `otherwise` for labels without one, null included."""
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(v) for kv in sorted(numbers.items()) for v in kv)), x), F.lit(otherwise).cast("int"))


def falsy_coalesce(*x: Column) -> Column:
    """The first of the columns that is neither null nor ''."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in x))


def stop_word_language(x: Column, stop_words: dict[str, list[str]]) -> Column:
    """The language whose stop words (code -> words) make up most of a text's words; ties go to the first code, null without any.

    A vote in the JVM, without a model; for the trained classifier see the training-data operators.
    """
    words = F.regexp_extract_all(F.lower(x), F.lit(r"[\p{L}']+"), F.lit(0))
    said = lambda some: F.size(F.filter(words, lambda w: w.isin(some)))
    votes = [F.struct(said(some).alias("n"), F.lit(-i).alias("at"), F.lit(code).alias("code")) for i, (code, some) in enumerate(sorted(stop_words.items()))]
    best = F.array_max(F.array(*votes))
    return F.when(best["n"] > 0, best["code"])
