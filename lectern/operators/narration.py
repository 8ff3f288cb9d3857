"""Chapters to sentences, guarded emotions and chunks.

chapters carry (book_id, chapter_index, text); every later table keeps these
keys, so that one hash partitioning by them serves all ordered operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.speech import Rules
from lectern.functions.text import segmenter, sentences_of, strip

CHAPTER = ["book_id", "chapter_index"]
CHUNK_CHARS = 400


def paragraphs(chapters: DataFrame) -> DataFrame:
    """book_id, chapter_index, paragraph_index, text; blank ones drop out."""
    own = F.filter(F.transform(F.split("text", "\n\n"), strip), lambda p: p != "")
    return chapters.select(*CHAPTER, F.posexplode(own).alias("paragraph_index", "text"))


def segment(chapters: DataFrame, method: str = "regex") -> DataFrame:
    """book_id, chapter_index, paragraph_index, sentence_index, text, is_paragraph_end.

    Both levels are arrays of the chapter's row, so numbering is a position in
    the flattened array and nothing is shuffled.  A splitter that is no
    built-in expression works on one row per paragraph instead.
    """
    split = segmenter(method)
    if split is not sentences_of:
        rows = paragraphs(chapters).withColumn("s", split(F.col("text"))).filter(F.size("s") > 0)
        rows = rows.select(*CHAPTER, "paragraph_index", F.size("s").alias("n"), F.posexplode("s").alias("pos", "text"))
        order = Window.partitionBy(*CHAPTER).orderBy("paragraph_index", "pos")
        return rows.select(*CHAPTER, "paragraph_index", (F.row_number().over(order) - 1).alias("sentence_index"), "text", (F.col("pos") == F.col("n") - 1).alias("is_paragraph_end"))
    own = F.filter(F.transform(F.split("text", "\n\n"), strip), lambda p: p != "")
    nested = F.transform(own, lambda p: sentences_of(p))
    rows = F.flatten(F.transform(nested, lambda s, i: F.transform(s, lambda t, j: F.struct(i.cast("int").alias("paragraph_index"), t.alias("text"), (j == F.size(s) - 1).alias("is_paragraph_end")))))
    out = chapters.select(*CHAPTER, F.posexplode(rows).alias("sentence_index", "s"))
    return out.select(*CHAPTER, "s.paragraph_index", "sentence_index", "s.text", "s.is_paragraph_end")


def guard(sentences: DataFrame, rules: Rules = Rules()) -> DataFrame:  # noqa: B008
    """Chapter guardrails on emotion and level: levels rise by at most
    ``escalation`` from sentence to sentence, and at most ``emotional_share``
    percent of the sentences (one at least) keep an emotion, the strongest;
    of equals the later ones.  Adds intensity.  Sentences without an index
    come last; of one index the weaker come first, then emotions in order.

    The rise has a closed form: the least of level_k - escalation * k over all
    sentences k so far, plus escalation * i.
    """
    order = Window.partitionBy(*CHAPTER).orderBy(F.asc_nulls_last("sentence_index"), "level", "emotion")
    place = F.row_number().over(order) - 1
    capped = sentences.withColumn("level", F.least("level", F.lit(rules.max_intensity))).withColumn("lectern_i", place)
    step = F.col("level") - rules.escalation * F.col("lectern_i")
    capped = capped.withColumn("level", (F.min(step).over(order.rowsBetween(Window.unboundedPreceding, 0)) + rules.escalation * F.col("lectern_i")).cast("int"))
    loud = F.col("emotion") != "neutral"
    rank = F.row_number().over(Window.partitionBy(*CHAPTER, loud).orderBy("level", "lectern_i"))
    whole = Window.partitionBy(*CHAPTER)
    n, n_loud = F.count("*").over(whole), F.count_if(loud).over(whole)
    allowed = F.greatest(F.floor(n * rules.emotional_share / F.lit(100)), F.lit(1))
    capped = capped.withColumn("lectern_reset", loud & (rank <= n_loud - allowed))
    out = capped.withColumns({"emotion": F.when(F.col("lectern_reset"), "neutral").otherwise(F.col("emotion")), "intensity": F.col("level") / F.lit(10000.0)})
    return out.drop("lectern_i", "lectern_reset")


def assign_chunks(sentences: DataFrame, max_chars: int = CHUNK_CHARS) -> DataFrame:
    """Adds chunk_index: sentences in order, joined by a space, up to
    max_chars; a paragraph's end closes a chunk of two sentences or more that
    is at least half full.  A fold over the chapter's array that keeps the
    places where chunks start."""
    columns = [c for c in sentences.columns if c not in CHAPTER]
    rows = F.sort_array(F.collect_list(F.struct("sentence_index", *[c for c in columns if c != "sentence_index"])))
    packed = sentences.groupBy(*CHAPTER).agg(rows.alias("rows"))
    start = F.expr("named_struct('starts', cast(array() as array<int>), 'at', 0, 'chars', 0L, 'open', false)")

    def step(state, row):
        size = F.length(row["text"]).cast("long")
        longer = state["chars"] + 1 + size
        fresh = ~state["open"] | (longer > max_chars)
        close = ~fresh & row["is_paragraph_end"] & (longer >= max_chars // 2)
        return F.struct(
            F.when(fresh, F.concat(state["starts"], F.array(state["at"]))).otherwise(state["starts"]).alias("starts"), (state["at"] + 1).alias("at"),
            F.when(close, F.lit(0).cast("long")).when(fresh, size).otherwise(longer).alias("chars"), (~close).alias("open"),
        )

    folded = packed.withColumn("starts", F.aggregate("rows", start, step)["starts"])
    sizes = F.zip_with(F.concat(F.slice("starts", 2, F.size("starts")), F.array(F.size("rows"))), "starts", lambda end, begin: end - begin)
    folded = folded.withColumn("ids", F.flatten(F.transform(sizes, lambda n, k: F.array_repeat(k.cast("int"), n))))
    flat = folded.select(*CHAPTER, F.explode(F.arrays_zip("rows", "ids")).alias("z"))
    return flat.select(*CHAPTER, *[F.col(f"z.rows.{c}").alias(c) for c in columns], F.col("z.ids").alias("chunk_index"))


def chunks(sentences: DataFrame) -> DataFrame:
    """One row per chunk of sentences that carry chunk_index."""
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("sentence_index", "text"))), lambda x: x["text"]), " ")
    return sentences.groupBy(*CHAPTER, "chunk_index").agg(
        F.min("sentence_index").alias("start_sentence"), F.max("sentence_index").alias("end_sentence"), F.count("*").cast("int").alias("n_sentences"),
        F.sum(F.length("text")).alias("n_chars"), text.alias("text"),
    )


def annotation_metrics(sentences: DataFrame) -> DataFrame:
    """Per chapter: sentences, dialogue sentences, share that is not neutral, greatest intensity."""
    return sentences.groupBy(*CHAPTER).agg(
        F.count("*").alias("n_sentences"), F.count_if("contains_dialogue").alias("n_dialogue"),
        F.avg((F.col("emotion") != "neutral").cast("double")).alias("emotional_share"), F.max("intensity").alias("max_intensity"),
    )


def refine(sentences: DataFrame, replies: DataFrame) -> DataFrame:
    """Rule results overridden by replies (keys, sentence_index, emotion,
    level) where these are not neutral.  Of several such replies to one
    sentence the greatest in (emotion, level) stands: none comes twice."""
    r = replies.filter(F.col("emotion") != "neutral").groupBy(*CHAPTER, "sentence_index").agg(F.max(F.struct("emotion", "level")).alias("r"))
    r = r.select(*CHAPTER, "sentence_index", F.col("r.emotion").alias("lectern_e"), F.col("r.level").alias("lectern_l"))
    own = sentences.join(r, [*CHAPTER, "sentence_index"], "left")
    use = F.col("lectern_e").isNotNull()
    return own.withColumns({"emotion": F.when(use, F.col("lectern_e")).otherwise(F.col("emotion")), "level": F.when(use, F.col("lectern_l")).otherwise(F.col("level"))}).drop("lectern_e", "lectern_l")
