"""Language of a text from its most common words: the offline default for an injected detector."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.text import words

#: Function words of each language.
STOP_WORDS = {
    "de": ("der", "die", "das", "und", "ist", "nicht", "ein", "eine", "mit", "von", "den", "zu", "auf", "für"),
    "en": ("the", "of", "and", "to", "in", "is", "that", "it", "was", "for", "with", "as", "are", "this"),
    "es": ("el", "los", "las", "y", "que", "del", "una", "por", "con", "para", "se", "no", "su", "al"),
    "fr": ("le", "les", "et", "des", "du", "une", "dans", "est", "pour", "qui", "sur", "par", "avec", "au"),
    "vi": ("và", "của", "là", "các", "có", "được", "trong", "cho", "không", "này", "người", "những", "một", "với"),
}
OTHER = "other"


def detect_language(text: Column, languages: tuple[str, ...] = ("vi", "en")) -> Column:
    """The language with most of its function words in the text, the first by code of equals; ``other`` outside ``languages``."""
    tokens = F.transform(words(F.lower(text)), lambda w: F.regexp_replace(w, r"(?U)^\W+|\W+$", ""))

    def scored(code: str) -> Column:
        """One pass over the words; (-count, code) sorts the winner first."""
        found = F.filter(tokens, lambda w: w.isin(*STOP_WORDS[code]))
        return F.struct((-F.size(found)).alias("n"), F.lit(code).alias("code"))

    best = F.array_min(F.array(*map(scored, sorted(STOP_WORDS))))
    return F.when((best["n"] < 0) & best["code"].isin(*languages), best["code"]).otherwise(F.lit(OTHER))


def coerced(value: Column, allowed: tuple[str, ...], other: str) -> Column:
    """Values of a closed set; anything else, null too, becomes ``other``."""
    return F.when(value.isin(*allowed), value).otherwise(F.lit(other))
