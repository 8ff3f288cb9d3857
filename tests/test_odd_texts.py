"""Quotes, spaces and letters that ASCII and Unicode tell apart: the queries give what their SQL gives."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from lectern.functions import speech
from lectern.plans import registry
from tests.test_oracles import NAMES, keyed

TEXTS = (
    "he thought “OK then” so", "a ' word' b", "a 'word　' b", "a '\x0bword' b", "a 'word\x1c' b", "a 'word ' b", "a ' word' b",
    "\U0001d401'abc' x", "'abc'\U0001d401 x", "\U0001f600'abc' x", "\U0001d7d8'abc' x", "aſked and sobbed", "aſk", "ſaid", "xſaid", "hiſſ", "hiſſeſ",
    "asKs and sobbed", "K", "thınks and sobbed", "saİd",
)


@pytest.fixture(scope="module")
def odd_dir(spark, sf_dir, tmp_path_factory):
    """Every text in every form of a turn; each is a conversation of its own
    and one of another."""
    folder = tmp_path_factory.mktemp("texts")
    for name in set(NAMES) - {"conversations"}:
        (folder / f"{name}.parquet").symlink_to(Path(sf_dir) / f"{name}.parquet")
    rows = [(c, 0, text) for c, text in enumerate(text for text in TEXTS for _ in range(42))]
    rows += [(10_000 + c // 4, turn, text) for c, text in enumerate(TEXTS) for turn in range(c % 4 * 10, c % 4 * 10 + 7)]
    with duckdb.connect() as con:
        con.execute("create table t (conv_id bigint, turn bigint, role varchar, text varchar)")
        con.executemany("insert into t values (?, ?, 'user', ?)", rows)
        con.execute(f"copy t to '{folder / 'conversations.parquet'}' (format parquet)")
    return str(folder)


@pytest.mark.parametrize("name", ["guarded_emotions", "annotation_metrics", "refinement_merge", "dialogue", "delivery_plan"])
def test_query(spark, odd_dir, name):
    df = registry.QUERIES[name](spark, odd_dir)
    columns = sorted(df.columns)
    rows = [tuple(r) for r in df.select(*columns).collect()]
    with duckdb.connect() as con:
        con.sql(f"create view conversations as from '{odd_dir}/conversations.parquet'")
        found = con.sql(f"select {', '.join(columns)} from ({registry.ORACLE_SQL[name]})").fetchall()
    assert keyed(rows) == keyed(found)


@pytest.mark.parametrize(("text", "mode"), [
    ("“Yes”", "dialogue"), ("' word'", "prose"), ("'word　'", "prose"), ("\U0001d401'abc' x", "prose"), ("'abc'\U0001d401", "prose"), ("\U0001f600'abc'", "thought"),
])
def test_operator(spark, text, mode):
    """The operator itself takes curly quotes and Unicode's white space."""
    assert speech.detect_dialogue(spark.createDataFrame([(text,)], "text string")).first()["narration_mode"] == mode
