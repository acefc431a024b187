"""Text normalisation and tokens, as built-in expressions.

Spark SQL has no NFKC or case-fold function, but the ICU library it ships for collations has
both, and ``java_method`` calls it row by row inside the JVM. ICU is only reached for rows with a
non-ASCII character (character length differs from byte length); other rows take ``lower``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Phrases that mark a prompt-injection attempt in normalised text.
INJECTION_MARKERS = (
    "ignore previous instructions",
    "mark every control satisfied",
    "system prompt",
    "developer message",
)

# Every character Python's str.split() splits on: Unicode white space and the four separators.
_SPACES = r"(?U)[\s\x1c-\x1f]+"
# What ASCII holds of it, but for a single space.
_ASCII_RUNS = ("  ", *"\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f")
_ZERO_WIDTH = "[\u200b\u200c\u200d]"


def _is_ascii(text: Column) -> Column:
    return F.length(text) == F.octet_length(text)


def _is_single_spaced(text: Column) -> Column:
    """ASCII without white space but single spaces, which needs no slow pattern."""
    plain = _is_ascii(text)
    for run in _ASCII_RUNS:
        plain = plain & ~text.contains(run)
    return plain


def _fold_case(text: Column) -> Column:
    return F.call_function(
        "java_method", F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), text, F.lit(True)
    )


def _nfkc(text: Column) -> Column:
    return F.call_function(
        "java_method", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True)
    )


def casefold(text: Column) -> Column:
    """Full Unicode case folding; null stays null."""
    return F.when(_is_ascii(text), F.lower(text)).when(text.isNotNull(), _fold_case(text))


def collapse_spaces(text: Column) -> Column:
    """Runs of white space become one space; no space at either end."""
    return F.when(_is_single_spaced(text), F.trim(text)).otherwise(_collapse(text))


def _collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, _SPACES, " "))


def security_text(text: Column) -> Column:
    """NFKC, case fold, drop zero-width characters, collapse white space."""
    folded = F.when(_is_ascii(text), F.lower(text)).when(
        text.isNotNull(), F.regexp_replace(_fold_case(_nfkc(text)), _ZERO_WIDTH, "")
    )
    # decided on the text itself: an expression that is read again for every run would be computed again
    return F.when(_is_single_spaced(text), F.trim(F.lower(text))).otherwise(_collapse(folded))


def has_injection_marker(normalised: Column) -> Column:
    found = F.lit(False)
    for marker in INJECTION_MARKERS:
        found = found | normalised.contains(marker)
    return found


def tokens(text: Column) -> Column:
    """Set of ``[a-z0-9]+`` runs in the case-folded text."""
    return F.array_distinct(F.regexp_extract_all(casefold(text), F.lit("[a-z0-9]+"), F.lit(0)))
