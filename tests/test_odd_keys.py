"""Turns without a number, numbers below zero and numbers that come twice: the queries give what their SQL gives."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from lectern.operators import engines, narration
from lectern.plans import registry
from tests.test_oracles import NAMES, keyed

#: Turns of a conversation; two without a number, or two of one number, leave
#: the order of the guardrails open in the SQL.
NO_NUMBER = [(c, turn) for c in range(60) for turn in (0, None, 1, 2, 3)]
BELOW_ZERO = [(c - 30, turn - 4) for c in range(60) for turn in range(9)]
TWICE = [(c, turn // 2) for c in range(60) for turn in range(6)]


@pytest.fixture(scope="module")
def check(spark, sf_dir, tmp_path_factory):
    """Holds a query against its SQL on conversations of given keys."""

    def run(name, keys):
        folder = tmp_path_factory.mktemp("keys")
        for table in set(NAMES) - {"conversations"}:
            (folder / f"{table}.parquet").symlink_to(Path(sf_dir) / f"{table}.parquet")
        with duckdb.connect() as con:
            con.execute("create table t (conv_id bigint, turn bigint, role varchar, text varchar)")
            con.executemany("insert into t values (?, ?, 'user', ?)", [(*key, ("a plain turn", "OK NO")[i % 3 == 0]) for i, key in enumerate(keys)])
            con.execute(f"copy t to '{folder / 'conversations.parquet'}' (format parquet)")
            con.execute("alter table t rename to conversations")
            df = registry.QUERIES[name](spark, str(folder))
            columns = sorted(df.columns)
            found = con.sql(f"select {', '.join(columns)} from ({registry.ORACLE_SQL[name]})").fetchall()
        assert keyed(tuple(r) for r in df.select(*columns).collect()) == keyed(found)

    return run


@pytest.mark.parametrize("name", ["annotation_metrics", "refinement_merge"])
@pytest.mark.parametrize("keys", [NO_NUMBER, BELOW_ZERO], ids=["no_number", "below_zero"])
def test_keys(check, name, keys):
    check(name, keys)


def test_merge_of_one_number(check):
    check("refinement_merge", TWICE)


def test_replies_of_one_index(spark):
    """Of items of one index the last stands, and no sentence comes twice."""
    reply = '[{"index": 1, "emotion": "sad", "intensity": 0.5}, {"index": 2, "emotion": "tense"}, {"index": 1, "emotion": "angry", "intensity": 0.4}, {"index": null}]'
    replies = engines.refinement_replies(spark.createDataFrame([("b", 0, reply)], "book_id string, chapter_index int, reply string"))
    assert sorted(tuple(r)[2:] for r in replies.collect()) == [(1, "angry", 4000), (2, "tense", 3000)]
    own = spark.createDataFrame([("b", 0, i, "neutral", 3000) for i in range(3)], "book_id string, chapter_index int, sentence_index int, emotion string, level int")
    found = narration.refine(own, replies.union(replies)).select("sentence_index", "emotion", "level")
    assert sorted(tuple(r) for r in found.collect()) == [(0, "neutral", 3000), (1, "angry", 4000), (2, "tense", 3000)]


def test_guard_of_one_index(spark):
    """The guardrails give the same rows in whatever order the sentences come."""
    rows = [("b", 0, i // 3, level, emotion) for i, (level, emotion) in enumerate([(7000, "sad"), (1000, "calm"), (7000, "excited"), (2000, "neutral"), (6500, "tense"), (1000, "neutral")] * 3)]
    rows += [("c", 0, i // 2, level, emotion) for i, (level, emotion) in enumerate([(9000, "calm"), (8000, "sad"), (1000, "calm"), (1000, "sad"), (8000, "tense"), (9000, "excited")])]
    found = []
    for own in (rows, rows[::-1]):
        df = spark.createDataFrame(own, "book_id string, chapter_index int, sentence_index int, level int, emotion string").coalesce(1)
        found.append(sorted(tuple(r) for r in narration.guard(df).collect()))
    assert found[0] == found[1]
    # all levels are capped before sentences of one index are put in order
    assert [(r[2], r[4], r[3]) for r in found[0] if r[0] == "c" and r[2] == 2] == [(2, "neutral", 4000), (2, "tense", 7000)]
