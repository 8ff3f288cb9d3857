"""Vectors of extreme lengths, ids with two vectors, columns that clash."""

from __future__ import annotations

import math

from lectern.llm import forest


def test_extreme_lengths(spark):
    rows = [(0, [1e-200, 0.0]), (1, [1e200, 1e200]), (2, [1.0, 0.0]), (3, [0.5, 1.0]), (4, [-5e-324, 0.0]), (50, [1.7e308, -1.7e308])]
    got = [tuple(r) for r in forest.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("query_id", "rank").collect()]
    assert [(q, v) for q, _, v, _ in got] == [(0, 2), (0, 1), (0, 50), (0, 3), (0, 4), (50, 0), (50, 2), (50, 1), (50, 3), (50, 4)]
    want = [1.0, math.sqrt(0.5), math.sqrt(0.5), 0.5 / math.sqrt(1.25), -1.0]
    assert all(abs(s - w) < 1e-15 for (_, _, _, s), w in zip(got, want, strict=False))


def test_one_id_with_two_vectors_has_the_neighbours_of_each(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (0, [1.0, 0.0]), *[(i, [1.0, 0.01 * i]) for i in range(1, 7)], *[(i, [0.01 * i, 1.0]) for i in range(11, 17)]]
    got = sorted((r["rank"], r["vec_id"]) for r in forest.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).filter("query_id = 0").collect())
    assert got == [(k, v) for k in range(1, 6) for v in (k, k + 10)]


def test_other_columns(spark):
    rows = [(i, [1.0, float(i)], 1, b"v", 2, 0.5) for i in range(8)]
    got = forest.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<float>, shard int, vector binary, kind int, score double"))
    assert got.columns == ["query_id", "rank", "vec_id", "score"] and [r["vec_id"] for r in got.orderBy("rank").collect()] == [1, 2, 3, 4, 5]
