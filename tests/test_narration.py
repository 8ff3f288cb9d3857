"""Chapters, sentences, dialogue, emotions, guardrails, chunks."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lectern.functions import speech
from lectern.functions.html import read
from lectern.operators import chapters, narration


def chaptered(spark, body):
    return [tuple(r)[1:] for r in chapters.text_chapters(spark.createDataFrame([("b", "My Book", body)], "book_id string, title string, text string")).orderBy("chapter_index").collect()]


def test_chapters(spark):
    body = "Before.\n\nChapter 1: Down\nText one.\r\n\r\n\r\n\r\nMore.  \n\nCHAPTER iv - Up\n\nPart tHREE\nThree.\n\nXIV.\nRoman.\n\nTHE RABBIT'S-HOLE\nCaps.\nNOT BLANK BEFORE\nend"
    assert chaptered(spark, body) == [
        (0, "Prologue", "Before."), (1, "Chapter 1: Down", "Text one.\n\nMore."), (2, "Part Three", "Three."), (3, "XIV", "Roman."), (4, "The Rabbit'S-Hole", "Caps.\nNOT BLANK BEFORE\nend"),
    ]


def test_chapter_oddities(spark):
    assert chaptered(spark, "no headings\nat all") == [(0, "My Book", "no headings\nat all")]
    assert chaptered(spark, ".\nbody") == [(0, "", "body")]
    assert chaptered(spark, "Chapter One\nbody") == [(0, "My Book", "Chapter One\nbody")]
    assert chaptered(spark, "mix\nbody") == [(0, "mix", "body")]


def test_contents_join(spark):
    toc = spark.createDataFrame([("b", 0, "t/a.xhtml", "A"), ("b", 1, "b.xhtml", ""), ("b", 2, "t/a.xhtml", "again"), ("b", 3, "none.xhtml", "gone"), ("b", 4, "", "section"), ("b", 5, "t/blank.xhtml", "blank")], "book_id string, pos int, href string, title string")
    items = spark.createDataFrame([("b", 0, "t/late.xhtml", "late"), ("b", 1, "t/b.xhtml", "bb"), ("b", 2, "t/a.xhtml", "aa"), ("b", 3, "t/blank.xhtml", " \n")], "book_id string, pos int, name string, text string")
    got = [tuple(r)[1:] for r in chapters.toc_chapters(toc, items).orderBy("chapter_index").collect()]
    assert got == [(0, "A", "aa"), (1, "Chapter 2", "bb"), (2, "Chapter 3", "late")]


def test_flatten():
    assert chapters.flatten_toc([("a#x", "A"), (("", "S"), [("b", "B"), (("c", "C"), [("d#1", "D")])])]) == [("a", "A"), ("", "S"), ("b", "B"), ("c", "C"), ("d", "D")]


@pytest.mark.parametrize(
    ("html", "text", "heading"),
    [
        ("<p>a</p><p>b<br>c</p>", "a\n\nb\n\nc", ""), ("intro<p>a</p>", "intro a", ""), ("<b>x</b>y", "x y", ""), ("<head><title>t</title></head><h2>Head &amp; more</h2>x", "Head & more\n\nx", "Head & more"),
        ("<script>no</script><nav>no</nav>yes<!-- c -->", "yes", ""), ("<ul><li>a<li>b</ul>c", "a\n\nb\n\nc", ""), ("<p>a<p>b", "a\n\nb", ""), (None, "", ""), ("plain\ntext", "plain text", ""),
    ],
)
def test_html(html, text, heading):
    assert read(html) == (text, heading)


def test_segments(spark):
    rows = spark.createDataFrame([("b", 0, "One. Two.\n\n \n\nThree.")], "book_id string, chapter_index int, text string")
    assert [tuple(r)[2:] for r in narration.segment(rows).orderBy("sentence_index").collect()] == [(0, 0, "One.", False), (0, 1, "Two.", True), (1, 2, "Three.", True)]


@pytest.mark.parametrize(
    ("text", "mode", "speaker", "verb"),
    [
        ('"Go away now," he said.', "dialogue", "character", "said"), ('"Hi," and then a very long narration follows the words.', "mixed", "character", ""), ("'What is this thing' he wondered", "thought", "narrator", "wondered"),
        ("It's Alice's cat.", "prose", "narrator", ""), ("_never_ again", "thought", "narrator", ""), ('"Oh" and \'what now then\'', "mixed", "character", ""), ("", "prose", "narrator", ""), ("She WHISPERED it", "prose", "narrator", "whispered"),
    ],
)
def test_dialogue(spark, text, mode, speaker, verb):
    r = speech.detect_dialogue(spark.createDataFrame([(text,)], "text string")).first()
    assert (r["narration_mode"], r["speaker"], r["attribution_verb"]) == (mode, speaker, verb)


@pytest.mark.parametrize(
    ("text", "emotion", "level"),
    [
        ('"Go away," she whispered.', "whispered", 5000), ('"Go away now or else," she shouted!', "excited", 7000), ('"Is it so," he said?', "curious", 3000), ("Well...", "calm", 2000), ("THE END IS near", "neutral", 4000),
        ("Stop!", "neutral", 4500), ("'thinking about it'", "calm", 3000), ("plain", "neutral", 3000),
    ],
)
def test_emotions(spark, text, emotion, level):
    r = speech.tag_emotions(speech.detect_dialogue(spark.createDataFrame([(text,)], "text string"))).first()
    assert (r["emotion"], r["level"]) == (emotion, level)


def test_guardrails_against_the_rule_in_sequence(spark):
    rng = random.Random(4)
    rows = [(f"b{b}", 0, i, rng.choice(["neutral", "sad", "excited"]), rng.choice([1000, 2000, 3000, 5000, 6000, 7000, 9000])) for b in range(25) for i in range(rng.randrange(1, 30))]
    got = narration.guard(spark.createDataFrame(rows, "book_id string, chapter_index int, sentence_index int, emotion string, level int")).orderBy("book_id", "sentence_index").collect()
    want = []
    for b in sorted({r[0] for r in rows}):
        own = sorted(r for r in rows if r[0] == b)
        levels, before = [], None
        for r in own:
            level = min(r[4], 7000)
            level = level if before is None else min(level, before + 3000)
            levels.append(level)
            before = level
        loud = sorted((levels[i], i) for i, r in enumerate(own) if r[3] != "neutral")
        reset = {i for _, i in loud[: max(0, len(loud) - max(1, len(own) * 30 // 100))]}
        want += [(b, i, "neutral" if i in reset else r[3], levels[i] / 10000) for i, r in enumerate(own)]
    assert [(r["book_id"], r["sentence_index"], r["emotion"], r["intensity"]) for r in got] == want


def test_chunks_against_the_rule_in_sequence(spark):
    rng = random.Random(6)
    rows = [(f"b{b}", 0, i, "x" * rng.choice([5, 20, 90, 180, 500]), rng.random() < 0.3) for b in range(20) for i in range(rng.randrange(1, 25))]
    frame = spark.createDataFrame(rows, "book_id string, chapter_index int, sentence_index int, text string, is_paragraph_end boolean")
    got = {(r["book_id"], r["sentence_index"]): r["chunk_index"] for r in narration.assign_chunks(frame).collect()}
    for b in {r[0] for r in rows}:
        chunk, size, filled = 0, 0, False
        for _, _, i, t, end in sorted(r for r in rows if r[0] == b):
            if filled and size + 1 + len(t) > 400:
                chunk, filled = chunk + 1, False
            fresh = not filled
            size, filled = (len(t), True) if fresh else (size + 1 + len(t), True)
            assert got[(b, i)] == chunk
            if not fresh and end and size >= 200:
                chunk, filled = chunk + 1, False
    table = {(r["book_id"], r["chunk_index"]): r for r in narration.chunks(narration.assign_chunks(frame)).collect()}
    assert sum(r["n_sentences"] for r in table.values()) == len(rows)


def test_delivery_columns(spark):
    rows = spark.createDataFrame([("sad", 0.7, "hello"), ("neutral", 0.3, "x" * 30), ("odd", 0.9, ""), ("angry", 0.6, "no")], "e string, i double, t string")
    got = rows.select(speech.speed(F.col("e"), F.col("i")), speech.tagged_text(F.col("e"), F.col("i"), F.col("t")), speech.fallback_seconds(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [(0.965, "[very sad, melancholic] hello", 1.0), (1.0, "x" * 30, 2.0), (1.0, "", 1.0), (1.06, "[angry] no", 1.0)]
    assert [r[0] for r in spark.createDataFrame([(True,), (False,)], "p boolean").select(speech.pause_samples(24_000, speech.pause_ms(F.col("p")), F.col("p"))).collect()] == [24_000, 6_000]
