"""Mixing sources to target weights by entropy balancing.

``targets`` water-fills the total over the sources under their caps.
``balance`` gives every document a rate of its own, the solution of

    minimise    sum_i w_i * (r_i log r_i - r_i),  0 <= r_i <= MAX_COPIES
    subject to  sum_{i in s} size_i * r_i = target_s

with w_i = size_i + (mean size of the source), so that both documents and
their words count.  Its dual has one multiplier per source; the rates are
exponential tilts, r_i = min(MAX_COPIES, exp(lambda_s * x_i)) with
x_i = size_i / w_i: a long document bends more than a short one.  Each Newton
step is one distributed aggregation of sum size * r and of its slope over the
documents, counted by source and size; steps that leave the bracket found so
far are replaced by its middle.
``round_copies`` turns rates into whole copies by error diffusion over
documents of falling size inside hash buckets of bounded size, so that a
source with a third of all rows is many tasks.  Rows of one source, id and
size are one entry there, with their number: what is left over when their
copies are shared out goes to the first of them.

Cases: null text has size 0; null source is a source of its own, ordered
last; documents of size 0 and sources of total size 0 take 0 copies; repeated
rows each count; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm import store
from lectern.llm.common import small

WORD = r"[^\x20\x09-\x0D]+"
MAX_COPIES = 3
NEWTON_STEPS = 40
#: Of the target, within which a source's words are when Newton's steps end.
TOLERANCE = 1e-9
#: Sources whose rates are broadcast; more are joined by a shuffle.
MAX_SOURCES = 100_000
#: Rows of a rounding bucket, about.
BUCKET_ROWS = 4096


def word_count(text: str | Column) -> Column:
    """Number of words; 0 for null."""
    col = F.col(text) if isinstance(text, str) else text
    # Each word ends where white space or the end of the text follows it.
    return F.coalesce(F.regexp_count(col, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = MAX_COPIES) -> DataFrame:
    """``sizes`` (source, source_size) -> adds ``weight`` and ``target``.

    target = min(cap * source_size, weight * level), where the level makes the
    targets sum to the total.  Sources fill in the order of cap / weight; the
    level is that of the first source that the rest of the total, shared by
    weight among it and those after it, does not fill.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    n = (F.row_number().over(by_name) - 1) % len(weights)
    got = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (n + 1).cast("int")))
    got = got.withColumn("limit", F.col("source_size").cast("double") * cap).withColumn("ratio", F.col("limit") / F.col("weight"))
    order = Window.orderBy("ratio", F.col("source").isNull(), F.col("source").cast("binary"))
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    got = got.withColumn("left_total", F.sum("source_size").over(whole) - F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
    got = got.withColumn("left_weight", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    got = got.withColumn("level", F.col("left_total") / F.col("left_weight"))
    got = got.withColumn("level", F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "level"))).over(whole)["level"])
    target = F.when(F.col("level").isNull(), F.col("limit")).otherwise(F.least("limit", F.col("weight") * F.col("level")))
    return got.select("source", "source_size", "weight", target.alias("target"))


def _rate(lam: Column, x: Column) -> Column:
    return F.exp(F.least(lam * x, F.lit(float(np.log(MAX_COPIES)))))


def newton(counted: DataFrame, goals: DataFrame, steps: int = NEWTON_STEPS) -> DataFrame:
    """counted (source, size, n), goals (source, source_size, rows, target) ->
    goals with the multiplier ``lam`` and ``mean``; lam is null where the
    source has nothing to take and infinite where it is taken at its cap."""
    size, cap = F.col("source_size").cast("double"), F.col("target") >= MAX_COPIES * F.col("source_size") * (1 - 1e-12)
    start = F.when((size <= 0) | (F.col("target") <= 0), F.lit(None)).when(cap, F.lit(float("inf"))).otherwise(2 * F.log(F.col("target") / size))
    none = F.lit(None).cast("double")
    state = store.table(goals.withColumns({"mean": size / F.col("rows"), "lam": start, "low": none, "high": none}), "multipliers")
    found, open_ = counted.filter("size > 0").withColumnRenamed("source", "own"), F.col("lam").isNotNull() & (F.abs("lam") != float("inf"))
    for _ in range(steps):
        both = found.join(state.filter(open_).select("source", "mean", "lam"), F.col("own").eqNullSafe(F.col("source")))
        x = F.col("size") / (F.col("size") + F.col("mean"))
        words, rate = F.col("size") * F.col("n"), _rate(F.col("lam"), x)
        exact = lambda v: F.sum(v.cast("decimal(38,12)")).cast("double")  # noqa: E731  (in any order of rows the same)
        sums = both.groupBy(F.col("source").alias("own")).agg(exact(words * rate).alias("mass"), exact(F.when(rate < MAX_COPIES, words * x * rate).otherwise(0.0)).alias("slope"))
        after = state.join(sums, F.col("source").eqNullSafe(F.col("own")), "left").drop("own")
        over = F.col("mass") >= F.col("target")
        after = after.withColumns({"high": F.when(over, F.col("lam")).otherwise(F.col("high")), "low": F.when(over, F.col("low")).otherwise(F.coalesce(F.when(F.col("mass").isNotNull(), F.col("lam")), F.col("low")))})
        step = F.col("lam") - (F.col("mass") - F.col("target")) / F.col("slope")
        outside = (F.col("slope") <= 0) | (step <= F.col("low")) | (step >= F.col("high"))
        middle = F.when(F.col("low").isNull(), F.col("high") - 8 - F.abs("high")).when(F.col("high").isNull(), F.col("low") + 8 + F.abs("low")).otherwise((F.col("low") + F.col("high")) / 2)
        done = F.abs(F.col("mass") - F.col("target")) <= TOLERANCE * F.col("target")
        after = after.withColumns({"lam": F.when(F.col("mass").isNull() | done, F.col("lam")).when(F.coalesce(outside, F.lit(False)), middle).otherwise(step), "off": F.coalesce(~done, F.lit(False))})
        after = store.table(after.drop("mass", "slope"), "multipliers")
        store.drop(state)
        state = after.drop("off")
        if after.filter("off").limit(1).count() == 0:
            break
    return state.drop("low", "high")


def _diffuse(pdf: pd.DataFrame) -> pd.DataFrame:
    """Copies of each entry of n equal rows, in all, whose words follow rate *
    size with the error carried on."""
    pdf = pdf.sort_values(["size", "doc_id"], ascending=[False, True], kind="stable", na_position="last").reset_index(drop=True)
    copies, error = np.zeros(len(pdf), np.int64), 0.0
    for i, (s, r, n) in enumerate(zip(pdf["size"].tolist(), pdf["rate"].tolist(), pdf["n"].tolist(), strict=True)):
        if s:
            want = r * s * n + error
            copies[i] = min(MAX_COPIES * n, max(0, int(want / s + 0.5)))
            error = want - copies[i] * s
    pdf["copies"] = copies
    return pdf


_ENTRY = "source string, doc_id long, size long, n long, source_size long, target double, rate double, copies long"


def round_copies(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """source, doc_id, size, n (rows with these), source_size, target, rate,
    copies (of all n together)."""
    own = docs.select(F.col("source").cast("string").alias("source"), F.col("doc_id").cast("long").alias("doc_id"), word_count("text").alias("size"))
    entries = store.table(own.groupBy("source", "doc_id", "size").agg(F.count("*").alias("n")), "entries")
    counted = store.table(entries.groupBy("source", "size").agg(F.sum("n").alias("n"), F.count("*").alias("entries")), "sizes")
    sums = counted.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("rows"), F.sum("entries").alias("entries"))
    goals = targets(sums.select("source", "source_size"), weights).withColumnRenamed("source", "goal").drop("weight", "source_size")
    goals = sums.join(goals, F.col("source").eqNullSafe(F.col("goal"))).drop("goal")
    goals = newton(counted, goals).withColumnRenamed("source", "goal").withColumnRenamed("entries", "all")
    x = F.col("size") / (F.col("size") + F.col("mean"))
    rate = F.when((F.col("size") == 0) | F.col("lam").isNull(), 0.0).when(F.col("lam") == float("inf"), float(MAX_COPIES)).otherwise(_rate(F.col("lam"), x))
    rated = entries.join(F.broadcast(goals) if goals.limit(MAX_SOURCES + 1).count() <= MAX_SOURCES else goals, F.col("source").eqNullSafe(F.col("goal"))).withColumn("rate", rate)
    bucket = F.pmod(F.xxhash64("doc_id", "size"), F.ceil(F.col("all") / BUCKET_ROWS).cast("long"))
    rated = rated.select("source", "doc_id", "size", "n", "source_size", "target", "rate", bucket.alias("bucket"))
    columns = [c.split()[0] for c in _ENTRY.split(", ")]
    return rated.groupBy("source", "bucket").applyInPandas(lambda pdf: _diffuse(pdf)[columns], _ENTRY)


def balance(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Per document: doc_id, size, source_size, target, rate, taken (copies * size)."""
    got = round_copies(docs, weights)
    row = F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))
    each = F.call_function("div", F.col("copies"), F.col("n")) + (F.col("row") <= F.col("copies") % F.col("n")).cast("long")
    return got.withColumn("row", row).select("doc_id", "size", "source_size", "target", "rate", (each * F.col("size")).alias("taken"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """The documents, with their columns, each as often as the mix takes it.
    Of rows of one source, id and size the first by a hash of all their
    columns have a copy more where their copies cannot be shared out evenly."""
    got = round_copies(docs, weights).filter("copies > 0")
    each = F.call_function("div", F.col("copies"), F.col("n"))
    got = store.table(got.select(F.col("source").alias("lectern_source"), F.col("doc_id").alias("lectern_id"), F.col("size").alias("lectern_size"), each.alias("lectern_each"), (F.col("copies") % F.col("n")).alias("lectern_more"), (F.col("n") > 1).alias("lectern_several")), "copies")
    sized = docs.withColumn("lectern_words", word_count("text"))
    same = F.col("source").cast("string").eqNullSafe(F.col("lectern_source")) & F.col("doc_id").cast("long").eqNullSafe(F.col("lectern_id")) & (F.col("lectern_words") == F.col("lectern_size"))
    more = F.when(F.col("lectern_several"), 0).otherwise(F.col("lectern_more"))
    shared = got.filter("lectern_several and lectern_more > 0")
    out = sized.join(small(got), same).withColumn("lectern_copies", (F.col("lectern_each") + more).cast("int"))
    if shared.limit(1).count():
        order = Window.partitionBy("lectern_source", "lectern_id", "lectern_size").orderBy(F.xxhash64(*docs.columns))
        first = sized.join(small(shared), same).withColumn("lectern_copies", F.row_number().over(order)).filter(F.col("lectern_copies") <= F.col("lectern_more"))
        out = out.unionByName(first.withColumn("lectern_copies", F.lit(1)))
    return out.withColumn("lectern_copy", F.explode(F.array_repeat(F.lit(0), F.col("lectern_copies")))).select(*docs.columns)
