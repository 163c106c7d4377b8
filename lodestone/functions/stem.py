"""English word stems (the Porter2 algorithm) as column expressions, for a vocabulary rather than for each word of a text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.text import let

#: Fixed values of the published algorithm: irregular words, words that stay, endings of each step.
IRREGULAR = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli",
    "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
KEPT_AFTER_PLURAL = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
STEP_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al",
    "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
STEP_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")
VOWEL, OTHER = "[aeiouy]", "[^aeiouy]"
SHORT_END = f"(?:{OTHER}{VOWEL}[^aeiouywxY]|^{VOWEL}{OTHER})$"


def _cut(word: Column, ending: Column) -> Column:
    return F.left(word, F.length(word) - F.length(ending))


def _longest(word: Column, endings: object, body: Callable[[Column], Column]) -> Column:
    """``body`` of the longest of ``endings`` that the word has; the word itself where it has none."""
    pattern = "(" + "|".join(sorted(endings, key=lambda e: (-len(e), e))) + ")$"
    return let(F.regexp_extract(word, pattern, 1), lambda e: F.when(e == "", word).otherwise(body(e)))


def _replaced(word: Column, endings: dict[str, str], allowed: Callable[[Column], Column]) -> Column:
    """The longest ending replaced where it is allowed."""
    table = F.create_map(*(F.lit(x) for pair in endings.items() for x in pair))
    return _longest(word, endings, lambda e: F.when(allowed(e), F.concat(_cut(word, e), F.element_at(table, e))).otherwise(word))


def _region(word: Column, start: Column) -> Column:
    """Where what follows the first vowel and non-vowel from ``start`` on begins; the word's length where there is no such place."""
    rest = F.substr(word, start + 1)
    return start + F.length(rest) - F.length(F.regexp_replace(rest, f"^.*?{VOWEL}{OTHER}", "")) + F.when(rest.rlike(f"{VOWEL}{OTHER}"), 0).otherwise(F.length(rest))


def _stem(word: Column) -> Column:
    marked = F.regexp_replace(F.regexp_replace(word, "^y", "Y"), f"({VOWEL})y", "$1Y")

    def with_regions(w: Column) -> Column:
        first = F.when(w.rlike("^(?:gener|arsen)"), F.lit(5)).when(w.rlike("^commun"), F.lit(6)).otherwise(_region(w, F.lit(0)))
        return let(first, lambda r1: let(_region(w, r1), lambda r2: steps(w, r1, r2)))

    def steps(w: Column, r1: Column, r2: Column) -> Column:
        inside = lambda x, start: lambda e: F.length(x) - F.length(e) >= start

        def plural(x: Column) -> Column:
            short = F.length(x) == 4
            cut_s = F.when(x.rlike(f"{VOWEL}.+s$"), F.substr(x, F.lit(1), F.length(x) - 1)).otherwise(x)
            return _longest(x, ("sses", "ied", "ies", "us", "ss", "s"), lambda e: F.when(e == "sses", F.substr(x, F.lit(1), F.length(x) - 2)).when(e.isin("ied", "ies"), F.concat(_cut(x, e), F.when(short, "ie").otherwise("i"))).when(e == "s", cut_s).otherwise(x))

        def past(x: Column) -> Column:
            def mended(y: Column) -> Column:
                doubled = F.when(y.rlike("(?:bb|dd|ff|gg|mm|nn|pp|rr|tt)$"), F.left(y, F.length(y) - 1))
                return F.when(y.rlike("(?:at|bl|iz)$"), F.concat(y, F.lit("e"))).otherwise(F.coalesce(doubled, F.when(y.rlike(SHORT_END) & (r1 >= F.length(y)), F.concat(y, F.lit("e"))).otherwise(y)))

            def of(e: Column) -> Column:
                longer = F.when(inside(x, r1)(e), F.concat(_cut(x, e), F.lit("ee"))).otherwise(x)
                return F.when(e.isin("eed", "eedly"), longer).otherwise(let(_cut(x, e), lambda y: F.when(y.rlike(VOWEL), mended(y)).otherwise(x)))

            return _longest(x, ("eed", "eedly", "ed", "edly", "ing", "ingly"), of)

        final_y = lambda x: F.when(x.rlike(f"^.+{OTHER}[yY]$"), F.concat(F.left(x, F.length(x) - 1), F.lit("i"))).otherwise(x)

        def second(x: Column) -> Column:
            fits = lambda e: inside(x, r1)(e) & F.when(e == "ogi", x.rlike("logi$")).when(e == "li", x.rlike("[cdeghkmnrt]li$")).otherwise(True)
            return _replaced(x, STEP_2, fits)

        third = lambda x: _replaced(x, STEP_3, lambda e: inside(x, r1)(e) & ((e != "ative") | inside(x, r2)(e)))
        fourth = lambda x: _replaced(x, dict.fromkeys(STEP_4, ""), lambda e: inside(x, r2)(e) & ((e != "ion") | x.rlike("[st]ion$")))

        def fifth(x: Column) -> Column:
            stem, n = F.left(x, F.length(x) - 1), F.length(x) - 1
            drop_e = x.endswith("e") & ((n >= r2) | ((n >= r1) & ~stem.rlike(SHORT_END)))
            return F.when(drop_e | (x.endswith("ll") & (n >= r2)), stem).otherwise(x)

        later = lambda x: let(let(let(let(let(let(past(x), final_y), second), third), fourth), fifth), lambda y: F.lower(y))
        return let(plural(w), lambda x: F.when(x.isin(*KEPT_AFTER_PLURAL), x).otherwise(later(x)))

    return let(marked, with_regions)


def english_stem(word: Column) -> Column:
    """The stem of a lower-case word; words of up to two letters, and those with other characters than a to z, stay."""
    table = F.create_map(*(F.lit(x) for pair in IRREGULAR.items() for x in pair))
    return F.when(~word.rlike("^[a-z]{3,}$"), word).otherwise(F.coalesce(F.try_element_at(table, word), _stem(word)))
