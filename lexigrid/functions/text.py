"""Text normalisation, tokens and name patterns as Spark column expressions."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

BLANKS = r"[ \t\n\r\f]+"
NON_WORD = r"[^\p{L}\p{N}_]+"
# a year standing alone between underscores: fixed value
YEAR_TOKEN = r"(?:^|_)((?:19|20)\d{2})(?:_|$)"


@lru_cache(maxsize=1)
def accent_pairs() -> tuple[str, str]:
    """(accented, plain) characters: every code point whose base form is one other character.

    Rule: decompose, drop combining marks, compose again.
    """
    accented, plain = [], []
    for code in range(0x80, 0x30000):
        char = chr(code)
        if unicodedata.decomposition(char) == "" or 0xD800 <= code <= 0xDFFF:
            continue
        base = "".join(c for c in unicodedata.normalize("NFD", char)
                       if not unicodedata.category(c).startswith("M"))
        base = unicodedata.normalize("NFC", base)
        if len(base) == 1 and base != char:
            accented.append(char)
            plain.append(base)
    return "".join(accented), "".join(plain)


def strip_accents(text: Column) -> Column:
    """Drop accents.  Pure ASCII text skips both passes."""
    accented, plain = accent_pairs()
    stripped = F.regexp_replace(F.translate(text, accented, plain), r"\p{M}", "")
    return F.when(text.rlike(r"[^\x00-\x7F]"), stripped).otherwise(text)


def text_normalizer():
    """``normalize_term`` as a function on Python strings, for use inside tasks."""
    table = str.maketrans(*accent_pairs())

    def normalize(text: str) -> str:
        plain = text.translate(table)
        return "".join(c for c in plain if not unicodedata.category(c).startswith("M")).lower()

    return normalize


def normalize_term(text: Column) -> Column:
    """Lower case without accents: the form in which terms are compared."""
    return F.lower(strip_accents(text))


def words(text: Column) -> Column:
    """Blank-separated words in order."""
    return F.filter(F.split(text, BLANKS), lambda w: F.length(w) > 0)


def names(text: Column) -> Column:
    """Lower-case runs of letters, digits and underscores, each once, in order of first use."""
    return F.array_distinct(
        F.filter(F.split(F.lower(text), NON_WORD), lambda w: F.length(w) > 0))


def token_count(text: Column, special: int = 2) -> Column:
    """Words plus the start and end marks an encoder adds; NULL stays NULL."""
    return F.when(text.isNotNull(), F.size(words(text)) + F.lit(special))


def replace_first(text: Column, pattern: str, literal: str) -> Column:
    """Replace the first match only (Spark's ``regexp_replace`` replaces every match)."""
    safe = literal.replace("\\", "\\\\").replace("$", "\\$")
    return F.regexp_replace(text, f"(?s)^(.*?)(?:{pattern})(?<tail>.*)$", f"$1{safe}${{tail}}")


def name_variants(name: Column) -> Column:
    """Spellings to try for a place name, most literal first.

    The normalised name; without a leading "city of" and the like; with St, Ft, Mt and
    similar written out; with hyphens as blanks.  Every later step starts from the one before.
    """
    base = F.trim(normalize_term(name))
    bare = F.regexp_replace(base, r"^(?:city|republic|state|province|kingdom) of ", "")
    full = F.regexp_replace(bare, r"(^|[ -])st\.? ", "$1saint ")
    full = F.regexp_replace(full, r"(^|[ -])ft\.? ", "$1fort ")
    full = F.regexp_replace(full, r"(^|[ -])mt\.? ", "$1mount ")
    spaced = F.regexp_replace(full, r"-", " ")
    return F.array_distinct(F.array(base, bare, full, spaced))


def register(spark: SparkSession) -> None:
    accented, plain = accent_pairs()
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION strip_accents(s STRING) RETURNS STRING RETURN "
        f"regexp_replace(translate(s, '{accented}', '{plain}'), '\\\\p{{M}}', '')")
