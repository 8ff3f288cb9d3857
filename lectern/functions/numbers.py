"""Numbers as English words, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Number words.
ONES = (
    "", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve",
    "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen",
)
TENS = ("", "", "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety")
SCALES = ("", " thousand", " million", " billion")
ORDINALS = {
    "one": "first", "two": "second", "three": "third", "four": "fourth", "five": "fifth", "six": "sixth",
    "seven": "seventh", "eight": "eighth", "nine": "ninth", "twelve": "twelfth",
}

#: Digits that a number in words may have; longer ones stay as they are.
MAX_DIGITS = 18


def _pick(words: tuple[str, ...], at: Column) -> Column:
    """words[at]; one literal that Catalyst splits once, however long."""
    return F.element_at(F.split(F.lit("|".join(words)), r"\|"), (at + 1).cast("int"))


def _whole(n: Column, by: int) -> Column:
    """Whole quotient, exact for longs."""
    return F.call_function("div", n.cast("long"), F.lit(by).cast("long")) if by > 1 else n


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with the value computed once, also inside a lambda, where
    Catalyst shares no common parts."""
    return F.element_at(F.transform(F.array(value), f), 1)


#: Words of 0..99 by the rule; 0 is empty.  Short, since a plan holds it once for every use.
BELOW_HUNDRED = ONES + tuple(ten + ("-" + one if one else "") for ten in TENS[2:] for one in ONES[:10])


def below_thousand(n: Column) -> Column:
    """Words of 1..999; the empty string for 0."""
    hundred = F.when(n >= 100, F.concat(_pick(ONES[:10], _whole(n, 100)), F.lit(" hundred")))
    return F.concat_ws(" ", hundred, F.when(n % 100 > 0, _pick(BELOW_HUNDRED, n % 100)))


def cardinal(n: Column) -> Column:
    """Words of a non-negative whole number below 10**18; above 10**9 the
    count of billions is itself in words, "one thousand billion"."""

    def scaled(words: Column, at: int) -> list[Column]:
        parts = [F.element_at(words, at + i) for i in (0, 1, 2)]
        return [F.when(part != "", F.concat(part, F.lit(scale))) for part, scale in zip(parts, SCALES[2::-1], strict=True)]

    def joined(words: Column) -> Column:
        billions = let(F.concat_ws(" ", *scaled(words, 1)), lambda b: F.when(b != "", F.concat(b, F.lit(SCALES[3]))))
        return F.concat_ws(" ", billions, *scaled(words, 4))

    def words(v: Column) -> Column:
        groups = F.array(*[_whole(v, 1000**i) % 1000 for i in (5, 4, 3, 2, 1, 0)])
        return F.when(v == 0, F.lit("zero")).otherwise(let(F.transform(groups, below_thousand), joined))

    return let(n.cast("long"), words)


def ordinal(words: Column, strict: bool = False) -> Column:
    """Ordinal form of cardinal words.  Only the forms in ORDINALS, final "t"
    and final "e" are special; ``strict`` also turns "twenty" to "twentieth"."""

    def form(w: Column) -> Column:
        out = None
        for cardinal_word, ordinal_word in ORDINALS.items():
            value = F.concat(F.substr(w, F.lit(1), F.length(w) - len(cardinal_word)), F.lit(ordinal_word))
            test = F.endswith(w, F.lit(cardinal_word))
            out = F.when(test, value) if out is None else out.when(test, value)
        cut = F.substr(w, F.lit(1), F.length(w) - 1)
        if strict:
            out = out.when(F.endswith(w, F.lit("y")), F.concat(cut, F.lit("ieth")))
        out = out.when(F.endswith(w, F.lit("t")), F.concat(w, F.lit("h")))
        return out.when(F.endswith(w, F.lit("e")), F.concat(cut, F.lit("th"))).otherwise(F.concat(w, F.lit("th")))

    return let(words, form)


def year(n: Column) -> Column:
    """Spoken form of 1000..2099: two halves, "hundred" or "oh"; else cardinal."""

    def spoken(v: Column) -> Column:
        century, rest = below_thousand(_whole(v, 100)), v % 100
        out = F.when((v < 1000) | (v > 2099), cardinal(v)).when(v == 2000, F.lit("two thousand")).when(rest == 0, F.concat(century, F.lit(" hundred")))
        return out.when(rest < 10, F.concat(century, F.lit(" oh "), _pick(ONES, rest))).otherwise(F.concat(century, F.lit(" "), below_thousand(rest)))

    return let(n.cast("long"), spoken)


def decimal(value: Column, strict: bool = False) -> Column:
    """Words of a digit string with or without a fraction; a digit 0 of the
    fraction has no word unless ``strict``."""

    def said(v: Column) -> Column:
        digits = lambda: F.array_join(F.transform(F.split(F.split_part(v, F.lit("."), F.lit(2)), ""), lambda d: _pick(("zero" if strict else "", *ONES[1:10]), d.cast("int"))), " ")
        both = lambda w: F.when((w == "") | (F.length(w) > MAX_DIGITS), v).otherwise(F.concat(cardinal(w), F.when(F.instr(v, ".") > 0, F.concat(F.lit(" point "), digits())).otherwise(F.lit(""))))
        return let(F.split_part(v, F.lit("."), F.lit(1)), both)

    return let(value, said)


def replace_each(text: Column, pattern: str, f: Callable[[Column], Column]) -> Column:
    """The text with every match of the pattern replaced by f(match)."""

    def joined(found: Column) -> Column:
        pieces = F.zip_with(F.split(text, pattern, -1), found, lambda p, m: F.concat(p, F.when(m.isNull(), F.lit("")).otherwise(f(m))))
        return F.when(F.size(found) > 0, F.array_join(pieces, "")).otherwise(text)

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), joined)


#: The space that a percent sign may follow, not across a paragraph's end.
_SPACE_INSIDE = r"(?:(?!\n\n)\s)*"
ORDINAL_PATTERN = r"\b(\d+)(?i:st|nd|rd|th)\b"
CURRENCY_PATTERN = r"\$([0-9,]+)(?:\.(\d{1,2}))?"
PERCENT_PATTERN = r"\b(\d+(?:\.\d+)?)" + _SPACE_INSIDE + "%"
YEAR_PATTERN = r"(?<!\d)((?:1[0-9]|20)\d{2})(?!\d)"
NUMBER_PATTERN = r"\b(\d{1,3}(?:,\d{3})*(?:\.\d+)?|\d+(?:\.\d+)?)\b"


def _currency(m: Column, strict: bool) -> Column:
    def dollars(whole: Column) -> Column:
        return F.concat(decimal(whole, strict), F.when(whole == "1", F.lit(" dollar")).otherwise(F.lit(" dollars")))

    def cents(digits: Column) -> Column:
        name = F.when(F.ltrim(digits, F.lit("0")) == "1", F.lit(" cent")).otherwise(F.lit(" cents"))
        return F.when(digits == "", F.lit("")).otherwise(F.concat(F.lit(" and "), cardinal(digits), name))

    return F.concat(let(F.replace(F.regexp_extract(m, CURRENCY_PATTERN, 1), F.lit(","), F.lit("")), dollars), let(F.regexp_extract(m, CURRENCY_PATTERN, 2), cents))


def number_passes(strict: bool = False) -> list[tuple[str, Callable[[Column], Column]]]:
    """(pattern, replacement) of the five passes, in their order."""
    return [
        (ORDINAL_PATTERN, lambda m: F.when(F.length(m) - 2 > MAX_DIGITS, m).otherwise(ordinal(cardinal(F.regexp_extract(m, r"\d+", 0)), strict))),
        (CURRENCY_PATTERN, lambda m: _currency(m, strict)),
        (PERCENT_PATTERN, lambda m: F.concat(decimal(F.regexp_extract(m, r"\d+(?:\.\d+)?", 0), strict), F.lit(" percent"))),
        (YEAR_PATTERN, lambda m: year(m)),
        (NUMBER_PATTERN, lambda m: decimal(F.replace(m, F.lit(","), F.lit("")), strict)),
    ]
