"""Text functions as column expressions. Null in, null out."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as L

#: White space that a strip or a split on white space takes, spelled out so that every engine agrees.
SPACE = r"[ \t\n\r\f\x0B\x1C-\x1F\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"


def column(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: Column | str) -> Column:
    return F.regexp_replace(column(x), f"^{SPACE}+|{SPACE}+$", "")


def normalise(x: Column | str) -> Column:
    """Odd spaces become plain ones, soft hyphens go, runs of blanks and of blank lines shrink."""
    plain = F.translate(column(x), "\u00a0\u2009\u202f\u00ad", "   ")
    return strip(F.regexp_replace(F.regexp_replace(plain, "[ \\t]+", " "), "\\n{3,}", "\n\n"))


ODD = {"\u00a0": " ", "\u2009": " ", "\u202f": " ", "\u00ad": ""}


def normalised(text: str | None) -> str | None:
    """normalise, of a text in a worker."""
    if text is None:
        return None
    for odd, plain in ODD.items():
        if odd in text:
            text = text.replace(odd, plain)
    if "\t" in text or "  " in text:
        text = re.sub(r"[ \t]+", " ", text)
    if "\n\n\n" in text:
        text = re.sub(r"\n{3,}", "\n\n", text)
    return text.strip()


def collapse(x: Column | str) -> Column:
    """Every run of white space is one space."""
    return F.trim(F.regexp_replace(column(x), f"{SPACE}+", " "))


def strip_list_marker(x: Column | str) -> Column:
    return F.regexp_replace(column(x), f"^{SPACE}*(?:[-•*·]|\\(?[0-9]{{1,3}}[.)]){SPACE}*", "")


def whitespace_share(x: Column | str) -> Column:
    n = F.length(column(x))
    return F.when(n == 0, F.lit(0.0)).otherwise((n - F.length(F.regexp_replace(column(x), SPACE, ""))) / n)


def capitalised(x: Column | str) -> Column:
    return F.concat(F.upper(F.substring(column(x), 1, 1)), F.substring(column(x), 2, 1 << 30))


def any_of(words) -> str:
    return "(?:" + "|".join(words) + ")"


def clean_definition(x: Column | str) -> Column:
    """A definition as a sentence: one line, first letter in upper case, a closing mark."""
    text = capitalised(collapse(x))
    return F.when(text.rlike("[.!?]$") | (text == ""), text).otherwise(F.concat(text, F.lit(".")))


def clean_term(x: Column | str) -> Column:
    """Leading determiners and trailing connecting words go; x holds words joined by single spaces."""
    start = F.regexp_replace(column(x), f"^(?i:{any_of(L.DETERMINERS)}(?: |$))+", "")
    return F.trim(F.regexp_replace(start, f"(?i:(?:^| ){any_of(L.TRAILING_WORDS)})+$", ""))


def display_form(x: Column | str) -> Column:
    return capitalised(collapse(F.regexp_replace(column(x), f"^(?i:{any_of(L.DETERMINERS)} )+", "")))


def normalise_key(x: Column | str) -> Column:
    """A phrase key without leading articles."""
    return F.regexp_replace(column(x), f"^(?:{any_of(L.ARTICLES)} )+", "")


def back_key(x: Column | str) -> Column:
    """What makes two card backs the same."""
    return F.regexp_replace(F.lower(collapse(x)), "\\.+$", "")


def strip_article(x: Column | str) -> Column:
    """One leading article goes."""
    return F.regexp_replace(column(x), f"^(?i:{any_of(L.ARTICLES)} )", "")


def quoted(x: Column) -> Column:
    """x as a literal inside a regular expression."""
    return F.concat(F.lit("\\Q"), F.replace(x, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def blank_first(sentence: Column | str, target: Column | str, blank: str = L.BLANK) -> Column:
    """sentence with the first whole-word occurrence of target blanked, in any case; null if there is none."""
    pattern = F.concat(F.lit("(?is)^(.*?)(?<![A-Za-z0-9_-])"), quoted(column(target)), F.lit("(?![A-Za-z0-9_-])(.*)$"))
    part = lambda n: F.call_function("regexp_extract", column(sentence), pattern, F.lit(n))
    found = F.regexp_like(column(sentence), pattern) & (F.length(column(target)) > 0)
    return F.when(found, F.concat(part(1), F.lit(blank), part(2)))


def is_plausible_term(x: Column | str) -> Column:
    """Short, with a letter, and not made of words that point elsewhere."""
    term = column(x)
    low = F.lower(term)
    words = F.split(low, "[ -]+")
    all_bad = F.forall(words, lambda w: w.isin(*L.BAD_TERMS))
    return (F.length(term) > 0) & (F.length(term) <= L.MAX_TERM_CHARS) & ~low.isin(*L.BAD_TERMS) & ~all_bad & (F.size(F.split(term, " +")) <= L.MAX_TERM_WORDS) & term.rlike("[A-Za-z\\p{L}]")


def is_property_of(x: Column | str) -> Column:
    """Terms such as "advantage of a list", whose definition is a property of the list."""
    words = F.split(F.lower(column(x)), " ")
    return (F.size(words) > 2) & F.get(words, F.lit(0)).isin(*L.PROPERTY_NOUNS) & (F.get(words, F.lit(1)) == "of")


def is_usable_sentence(text: Column, words: Column, letters_enough: Column, has_verb: Column | None = None) -> Column:
    n = F.length(strip(text))
    out = n.between(L.MIN_SENTENCE_CHARS, L.MAX_SENTENCE_CHARS) & (words >= L.MIN_SENTENCE_WORDS) & letters_enough
    return out if has_verb is None else out & has_verb


def clamp(x: Column | str, most: int) -> Column:
    return F.greatest(F.lit(1), F.least(column(x), F.lit(most)))


def seeded_order(*parts: Column) -> Column:
    """A key that orders options the same way whenever their contents are the same."""
    return F.sha2(F.concat_ws("\u001f", *parts), 256)


def card_front(term: Column, other: Column, family: Column, cards: Column) -> Column:
    """A comparison names both sides; a term with several cards names what the card is about."""
    label = F.create_map(*(F.lit(v) for pair in L.FAMILY_LABELS.items() for v in pair))[family]
    return (
        F.when((family == "COMPARISON") & other.isNotNull() & (other != ""), F.concat(term, F.lit(f" {L.VERSUS} "), other))
        .when(cards > 1, F.concat(term, F.lit(" — "), label))
        .otherwise(term)
    )
