"""Altered short notices are found as full alignment finds them."""

from __future__ import annotations

import pyarrow as pa

from lectern.llm import licenses, textnum
from tests.llm import cases


def words(text):
    return textnum.words_of(pa.array([text])).bare()


def test_short_notices_with_a_word_changed():
    for name, template in licenses.TEMPLATES.items():
        own = template.split()
        if not 5 <= len(own) < 20:
            continue
        for at in range(len(own)):
            if max(at, len(own) - at - 1) < licenses.GRAM:
                continue  # no triple is left
            changed = [*own[:at], "new", *own[at + 1 :]]
            h = words("some text before " + " ".join(changed) + " and after")
            index = licenses.Index({name: template})
            best = max(licenses.align(index.words[0], h, s)[0] for s in range(-8, len(h) + 1))
            assert best >= licenses.COVERAGE * len(own)
            assert licenses.scan_words(h, index), (name, at)


def test_published_under_mit():
    found = licenses.scan_words(words("Published under the MIT License"), licenses.Index(licenses.TEMPLATES))
    assert found and found[0][1] == 4


def test_places_are_characters_among_many_notices(spark):
    """Every notice of a text full of them, at its place in characters."""
    notice = "Released under the MIT License"
    text = "".join(f"é日本 ü{i} {notice}. " for i in range(300))
    got = sorted((r["start"], r["end"]) for r in licenses.scan(cases.made(spark, [(1, "ß " + text), (2, text)])).filter("doc_id = 2 and license = 'mit-line'").collect())
    assert len(got) == 300 and all(text[a:b] == notice for a, b in got)
