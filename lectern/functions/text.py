"""Text normalisation for speech, sentence splitting and small text functions."""

from __future__ import annotations

import functools
import logging
import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.numbers import number_passes, replace_each

log = logging.getLogger(__name__)

#: A column of normalize's own, while it works.
DIGITS = "lectern_digits"
#: White space as Unicode defines it, for a Java character class.
SPACE = r"\s\x1C-\x1F\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"

# Abbreviations and their words, in the order of application.
TITLES = (
    ("Mr", "Mister"), ("Mrs", "Missus"), ("Ms", "Miss"), ("Dr", "Doctor"), ("Prof", "Professor"), ("Rev", "Reverend"),
    ("Gen", "General"), ("Sgt", "Sergeant"), ("Cpl", "Corporal"), ("Pvt", "Private"), ("Lt", "Lieutenant"),
    ("Capt", "Captain"), ("Cmdr", "Commander"), ("Adm", "Admiral"), ("Pres", "President"), ("Gov", "Governor"),
    ("Sen", "Senator"), ("Rep", "Representative"), ("Atty", "Attorney"), ("Supt", "Superintendent"), ("Insp", "Inspector"),
)
#: (pattern after the word boundary, words), without regard to case.
ABBREVIATIONS = (
    (r"st\.\s+(?=[A-Z])", "Saint "), (r"vs\.", "versus"), (r"etc\.", "et cetera"), (r"i\.e\.", "that is"), (r"e\.g\.", "for example"),
    (r"approx\.", "approximately"), (r"dept\.", "department"), (r"gov\.", "government"), (r"max\.", "maximum"), (r"min\.", "minimum"),
    (r"no\.\s*(?=\d)", "number "), (r"vol\.", "volume"), (r"ch\.\s*(?=\d)", "chapter "), (r"fig\.", "figure"),
    (r"p\.\s*(?=\d)", "page "), (r"pp\.\s*(?=\d)", "pages "), (r"jan\.", "January"), (r"feb\.", "February"), (r"apr\.", "April"),
    (r"aug\.", "August"), (r"sept?\.", "September"), (r"oct\.", "October"), (r"nov\.", "November"), (r"dec\.", "December"),
    (r"sq\.", "square"), (r"ave\.", "Avenue"), (r"blvd\.", "Boulevard"), (r"rd\.", "Road"),
)
#: Abbreviations after which no sentence ends.
NO_END = (
    "mr", "mrs", "ms", "dr", "prof", "rev", "gen", "sgt", "cpl", "pvt", "lt", "capt", "cmdr", "adm", "pres", "gov", "sen", "rep",
    "atty", "supt", "insp", "sr", "jr", "vs", "etc", "fig", "vol", "no", "op", "pp", "est", "approx", "dept", "co", "corp", "inc",
    "ltd", "llc", "jan", "feb", "mar", "apr", "jun", "jul", "aug", "sep", "sept", "oct", "nov", "dec", "mon", "tue", "wed", "thu",
    "fri", "sat", "sun", "st", "ave", "blvd", "rd", "ln", "ct", "pl", "sq", "ch", "p", "pg", "ref", "ed", "eds",
)


def strip(text: Column) -> Column:
    """Without white space at both ends, of any kind."""
    ends = F.concat(F.left(text, F.lit(1)), F.right(text, F.lit(1)))
    return F.when(F.rlike(ends, F.lit(f"[{SPACE}]")), F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+$", "")).otherwise(text)


#: A character that NFC may change, or that may join the one before it: none of Latin,
#: most punctuation, Cyrillic letters, kana, Han, Hangul.  The first class is the fast one.
MAY_CHANGE = r"[^\x00-\u02FF](?<![\u0400-\u0482\u048A-\u052F\u2010-\u2027\u2030-\u205E\u3001-\u3029\u3041-\u3096\u30A0-\u30FF\u4E00-\u9FFF\uAC00-\uD7A3])"


@F.pandas_udf(T.StringType())
def _nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def nfc(text: Column) -> Column:
    """Unicode NFC; only texts that it may change leave the JVM."""
    return F.coalesce(_nfc(F.when(F.rlike(text, F.lit(MAY_CHANGE)), text)), text)


def _where(test: Column, text: Column, change: Callable[[Column], Column]) -> Column:
    """change(text) where the test, a cheaper search, says that it may differ."""
    return F.when(test, change(text)).otherwise(text)


#: Characters that become plain quotes, then those that go.
_QUOTES, _UNSEEN = "\u2018\u2019\u2032\u201c\u201d\u201e\u201f\u2033", "\u200b\u200c\u200d\u2060\ufeff\u00ad"


def mark_passes() -> list[Callable[[Column], Column]]:
    """The steps of plain_marks, in their order; each searches first for what it changes."""

    def replaced(test: Callable[[Column], Column], pattern: str, words: str) -> Callable[[Column], Column]:
        return lambda text: _where(test(text), text, lambda t: F.regexp_replace(t, pattern, words))

    def has(*marks: str) -> Callable[[Column], Column]:
        return lambda text: F.contains(text, F.lit(marks[0])) if len(marks) == 1 else F.contains(text, F.lit(marks[0])) | F.contains(text, F.lit(marks[1]))

    return [
        lambda text: _where(F.rlike(text, F.lit(rf"[^\x00-\x7F](?<=[{_QUOTES}{_UNSEEN}])")), text, lambda t: F.translate(t, _QUOTES + _UNSEEN, "'''\"\"\"\"\"")),
        replaced(has("\u2013", "\u2014"), f"[{SPACE}]*[\u2013\u2014][{SPACE}]*", " \u2014 "),
        replaced(has("--"), f"[{SPACE}]*--[{SPACE}]*", " \u2014 "),
        lambda text: F.replace(text, F.lit("\u2026"), F.lit("...")),
        replaced(has("...."), r"\.{4,}", "..."),
        lambda text: F.regexp_replace(text, rf"\.[{SPACE}]\.[{SPACE}]\.", "..."),
    ]


def plain_marks(text: Column) -> Column:
    """No invisible characters; straight quotes, spaced dashes, three dots."""
    for change in mark_passes():
        text = change(text)
    return text


#: Any of the abbreviations, titles first; letters and a full stop are asked for before the list is tried.
_ABBREVIATION = r"(?=[A-Za-z]{1,6}\.)(?:(?:" + "|".join(short for short, _ in TITLES) + r")\.|(?i:\b(?:" + "|".join(pattern for pattern, _ in ABBREVIATIONS) + ")))"
#: A full stop after one: the search that most texts end with looks back from full stops only.
_ABBREVIATED = r"\.(?<=(?:" + "|".join(short for short, _ in TITLES) + r")\.|\b(?i:" + "|".join(pattern.split(r"\s")[0] for pattern, _ in ABBREVIATIONS) + "))"


def _spelled() -> tuple[Column, Column]:
    """Words by title and by abbreviation in lower case."""
    short = {}
    for pattern, words in ABBREVIATIONS:
        plain = pattern.split(r"\s")[0].replace("\\", "")
        short |= {plain.replace("?", ""): words, re.sub(".[?]", "", plain): words}
    pairs = lambda d: F.create_map(*[F.lit(x) for pair in d.items() for x in pair])
    return pairs({f"{title}.": words for title, words in TITLES}), pairs(short)


def spell_abbreviations(text: Column) -> Column:
    """Abbreviations in words, as if each were replaced in the order of the
    tables: all at once, or one after the other where two of them touch, since
    the words of the one then end the word boundary before the other."""
    one_by_one = text
    for short, words in TITLES:
        one_by_one = F.regexp_replace(one_by_one, rf"{short}\.", words)
    for pattern, words in ABBREVIATIONS:
        one_by_one = F.regexp_replace(one_by_one, rf"(?i)\b{pattern}", words)
    titles, short = _spelled()
    at_once = replace_each(text, _ABBREVIATION, lambda m: F.coalesce(F.try_element_at(titles, m), F.try_element_at(short, F.lower(F.regexp_extract(m, r"^\S+", 0)))))
    touching = F.rlike(text, F.lit(rf"{_ABBREVIATED}\s*(?:{_ABBREVIATION})"))
    return F.when(~F.rlike(text, F.lit(_ABBREVIATED)), text).when(touching, one_by_one).otherwise(at_once)


def tidy_paragraphs(text: Column) -> Column:
    """One space between words, one blank line between paragraphs."""
    one = F.transform(F.split(text, "\n\n"), lambda p: strip(F.replace(F.regexp_replace(p, r"[ \t]{2,}|\t", " "), F.lit("\n"), F.lit(" "))))
    return F.array_join(F.filter(one, lambda p: p != ""), "\n\n")


@functools.lru_cache(maxsize=16)
def _passes(session: SparkSession, column: str, numbers: bool, abbreviations: bool, strict: bool) -> list[tuple[str, Column]]:
    """(column, its new value) of every pass.  Thousands of small expressions:
    a session makes them once, since that takes longer than a book's text."""
    c, digits = F.col(column), F.col(DIGITS)
    out = [nfc(c), *[change(c) for change in mark_passes()]]
    if abbreviations:
        out.append(spell_abbreviations(c))
    passes = [(column, value) for value in out]
    if numbers:
        passes.append((DIGITS, F.rlike(c, F.lit(r"\d"))))
        passes += [(column, F.when(digits, replace_each(c, pattern, words)).otherwise(c)) for pattern, words in number_passes(strict)]
    return [*passes, (column, tidy_paragraphs(c))]


def normalize(df: DataFrame, column: str = "text", numbers: bool = True, abbreviations: bool = True, strict: bool = False) -> DataFrame:
    """The column prepared for speech.  Every pass is a projection of its own,
    so that its input is computed once; texts without digits skip the number
    passes.  Null stays null."""
    for name, value in _passes(df.sparkSession, column, numbers, abbreviations, strict):
        df = df.withColumn(name, value)
    return df.drop(DIGITS)


def sentences_of(paragraph: Column) -> Column:
    """Array of a paragraph's sentences.

    A sentence ends at ``.``, ``!`` or ``?`` with closing marks, before white
    space and an upper-case letter or opening mark; not after an abbreviation
    or initial, not at an ellipsis.
    """
    held = F.regexp_replace(paragraph, r"\b((?i:" + "|".join(NO_END) + r")|[A-Z])\.( +)", "$1\u0001$2")
    held = F.replace(held, F.lit("..."), F.lit("\u0002"))
    ended = F.regexp_replace(held, rf"([.!?]['\"\u201d\u2019)\]]*)[{SPACE}]+(?=[A-Z\u00C0-\u00DC\u0400-\u04FF\"'\u201c\u2018(\[])", "$1\u0000")
    back = F.transform(F.split(ended, "\u0000"), lambda s: strip(F.replace(F.replace(s, F.lit("\u0001"), F.lit(".")), F.lit("\u0002"), F.lit("..."))))
    return F.filter(back, lambda s: s != "")


def segmenter(name: str) -> Callable[[Column], Column]:
    """Splitter of paragraphs by name: "regex", or "nltk" where that is
    installed with its models; any other name means "regex", with a warning."""
    if name == "nltk":
        try:
            from nltk.tokenize import sent_tokenize

            sent_tokenize("One. Two.")
        except (ImportError, LookupError):
            log.warning("nltk or its models are missing; sentences are split by the regex")
            return sentences_of

        @F.pandas_udf(T.ArrayType(T.StringType()))
        def tokenized(paragraphs: pd.Series) -> pd.Series:
            return paragraphs.map(lambda p: [s.strip() for s in sent_tokenize(p) if s.strip()])

        return tokenized
    if name != "regex":
        log.warning("unknown segmenter %r; sentences are split by the regex", name)
    return sentences_of


def title_case(text: Column) -> Column:
    """First letter of every run of letters upper, the others lower case."""
    runs = F.regexp_extract_all(text, F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda w: F.concat(F.upper(F.substr(w, F.lit(1), F.lit(1))), F.lower(F.substr(w, F.lit(2))))), "")


def capitalize(text: Column) -> Column:
    return F.concat(F.upper(F.substr(text, F.lit(1), F.lit(1))), F.lower(F.substr(text, F.lit(2))))


def safe_file_name(title: Column) -> Column:
    return F.regexp_replace(title, r'[<>:"/\\|?*]', "_")


def shorten(title: Column, width: int = 35) -> Column:
    return F.when(F.length(title) > width, F.concat(F.substr(title, F.lit(1), F.lit(width - 2)), F.lit(".."))).otherwise(title)


def unfence(reply: Column) -> Column:
    """A reply without the Markdown fence around it."""
    return strip(F.regexp_replace(strip(reply), r"^```(?:json)?\s*|\s*```$", ""))


def escape_metadata(value: Column) -> Column:
    """Backslash before backslash, equals sign, hash, semicolon and newline."""
    return F.regexp_replace(value, r"([\\=#;\n])", r"\\$1")


def concat_line(path: Column) -> Column:
    """A line of a concat list; single quotes are closed, escaped, reopened."""
    return F.concat(F.lit("file '"), F.replace(path, F.lit("'"), F.lit("'\\''")), F.lit("'"))
