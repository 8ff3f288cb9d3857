"""Books to narration tables: the plan that the command line runs.

    files -> books, chapters -> normalised -> sentences -> annotated -> chunks
          -> audio -> chapters' audio -> timeline, metadata; validation

One shuffle by (book_id, chapter_index) serves guardrails, the chunk fold and
the chunk table.
"""

from __future__ import annotations

import dataclasses
import logging
import re
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import speech
from lectern.functions.text import normalize
from lectern.operators import container, delivery, engines, narration, progress, services  # noqa: F401  (registers its engines)
from lectern.plans.config import Settings
from lectern.sources import audio, books

log = logging.getLogger(__name__)


def rules_of(settings: Settings) -> speech.Rules:
    e, a = settings.emotion, settings.audio
    return speech.Rules(default_emotion=e.default_emotion, max_intensity=round(e.max_intensity * 10000), sentence_pause_ms=a.sentence_pause_ms, paragraph_pause_ms=a.paragraph_pause_ms, min_refine_length=e.min_refine_length)


#: Engines that render emotions well enough to be worth refining.
EXPRESSIVE = frozenset({"tagged"})


def refinement_mode(settings: Settings) -> str:
    """Emotions off, by rules, or refined; refinement needs an expressive engine."""
    if not settings.emotion.enabled:
        return "off"
    return settings.emotion.mode if settings.emotion.mode == "rules" or settings.engine in EXPRESSIVE else "rules"


def annotate(chapters: DataFrame, settings: Settings = Settings(), client=None) -> DataFrame:  # noqa: B008
    """chapters (book_id, chapter_index, text) -> annotated sentences."""
    rules, p = rules_of(settings), settings.processing
    clean = normalize(chapters.select("book_id", "chapter_index", "text"), numbers=p.expand_numbers, abbreviations=p.expand_abbreviations)
    own = speech.detect_dialogue(narration.segment(clean, p.segmenter))
    mode = refinement_mode(settings)
    if mode == "off":
        own = speech.plain_delivery(own).withColumn("intensity", F.lit(0.3))
    else:
        own = speech.tag_emotions(own, rules)
        if mode != "rules" and client is not None:
            wanted = speech.needs_refinement(own, rules)
            replies = engines.ask(engines.refinement_requests(own, wanted, settings.emotion.batch_size), client)
            own = narration.refine(own, engines.refinement_replies(replies, rules))
        own = narration.guard(own, rules)
    return own.withColumn("pause_after_ms", speech.pause_ms(F.col("is_paragraph_end"), rules)).drop("level")


def synthesis_plan(chunked: DataFrame, settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """Chunks with their sentences as an engine takes them."""
    rate = settings.audio.sample_rate
    sentence = F.struct("sentence_index", "text", "emotion", "intensity", speech.speed(F.col("emotion"), F.col("intensity"), settings.speed).alias("speed"), speech.pause_samples(rate, F.col("pause_after_ms"), F.col("is_paragraph_end")).alias("pause_samples"))
    return chunked.groupBy(*narration.CHAPTER, "chunk_index").agg(F.sort_array(F.collect_list(sentence)).alias("sentences"))


@dataclass
class Narration:
    """The tables of a run, none of them computed yet."""

    books: DataFrame
    chapters: DataFrame
    sentences: DataFrame
    chunks: DataFrame
    plan: DataFrame
    path: str = ""


def build(spark: SparkSession, path: str, settings: Settings = Settings(), client=None) -> Narration:  # noqa: B008
    found, chapters = books.read_books(spark, path)
    choose = lambda own, c: F.lit(own) if own else F.col(c)
    found = found.withColumns({"title": choose(settings.book.title, "title"), "author": choose(settings.book.author, "author"), "narrator": F.lit(settings.book.narrator), "year": F.lit(settings.book.year)})
    own = narration.assign_chunks(annotate(chapters, settings, client), settings.processing.chunk_chars)
    return Narration(found, chapters, own, narration.chunks(own), synthesis_plan(own, settings), path)


def state_keys(run: Narration, settings: Settings) -> DataFrame:
    """book_id, state_key: of the input, its number of chapters and the settings."""
    sums = run.chapters.groupBy("book_id").agg(F.count("*").alias("n"))
    key = F.sha2(F.concat_ws("|", "book_id", F.col("n").cast("string"), F.lit(str(dataclasses.asdict(settings)))), 256)
    return sums.select("book_id", key.alias("state_key"))


def render(run: Narration, settings: Settings, state: str) -> dict[str, DataFrame]:
    """Synthesise what is pending, write audio and progress under ``state``;
    returns chapter audio, timeline and metadata.  A chapter of which a chunk
    failed is logged and left out; it is pending in the next run."""
    spark = run.books.sparkSession
    keyed = state_keys(run, settings)
    events = progress.valid(progress.load(spark, f"{state}/events"), keyed) if settings.resume else progress.load(spark, f"{state}/none")
    pending = progress.pending_chunks(run.plan, events.filter("kind = 'chunk'"))
    made = engines.synthesize(pending, settings.engine, voice=settings.voice).join(keyed, "book_id")
    made.write.mode("append").parquet(f"{state}/audio")
    totals = run.plan.groupBy("book_id", "chapter_index").agg(F.count("*").alias("chunks"))
    totals.join(keyed, "book_id").write.mode("overwrite").parquet(f"{state}/totals")
    totals = spark.read.parquet(f"{state}/totals")

    stored = spark.read.parquet(f"{state}/audio").filter("content is not null").join(keyed, ["book_id", "state_key"], "left_semi").dropDuplicates(["book_id", "chapter_index", "chunk_index"])
    progress.append(progress.marked(stored, "chunk"), f"{state}/events")
    done = stored.groupBy("book_id", "chapter_index").agg(F.count("*").alias("made")).join(totals, narration.CHAPTER).filter("made >= chunks").select(*narration.CHAPTER, "state_key")
    progress.append(progress.marked(done, "chapter"), f"{state}/events")
    for r in totals.join(done, narration.CHAPTER, "left_anti").select(*narration.CHAPTER).toLocalIterator():
        log.error("chapter %s of %s failed and is skipped", r["chapter_index"], r["book_id"])

    whole = stored.join(done.select(*narration.CHAPTER), narration.CHAPTER, "left_semi")
    sound = settings.audio
    chapters = audio.joined_wav(whole.select("book_id", "chapter_index", "chunk_index", "content"), narration.CHAPTER, "chunk_index", sound.trim, sound.loudness if sound.normalize else None, settings.container.sample_rate)
    chapters = chapters.join(run.chapters.select("book_id", "chapter_index", "title"), narration.CHAPTER)
    times = delivery.timeline(chapters)
    return {"audio": chapters, "timeline": times, "metadata": delivery.metadata_text(run.books, times)}


def assemble(run: Narration, chapters: DataFrame, times: DataFrame, settings: Settings, state: str) -> list[str]:
    """One container a book: chapter files, list, metadata and cover beside
    it; returns the paths of the books made.  Where the tool is missing the
    files are left ready and the book stays unfinished.  Books are taken one
    at a time: a book is one call of the tool."""
    spark, made = run.books.sparkSession, []
    keyed = state_keys(run, settings)
    covers = {r["book_id"]: (r["cover_ext"], r["cover"]) for r in books.covers(spark, run.path).toLocalIterator()}
    for b in run.books.join(keyed, "book_id").join(delivery.metadata_text(run.books, times).select("book_id", F.col("value").alias("meta")), "book_id").toLocalIterator():
        name = re.sub(r'[<>:"/\\|?*]', "_", b["title"] or "book")
        folder = Path(settings.output) / "books" / name
        paths = container.write_book(chapters.filter(F.col("book_id") == b["book_id"]), str(folder), covers.get(b["book_id"]))
        if not paths:
            log.error("book %s has no chapter with audio", b["title"])
            continue
        rows = spark.createDataFrame([(b["book_id"], i, p) for i, p in enumerate(paths)], "book_id string, chapter_index int, path string")
        listed = delivery.concat_list(rows).first()["value"]
        out, cover = str(Path(settings.output) / f"{name}.m4b"), covers.get(b["book_id"])
        if not container.available():
            (folder / "list.txt").write_text(listed, encoding="utf-8")
            (folder / "metadata.txt").write_text(b["meta"], encoding="utf-8")
            log.warning("ffmpeg is not installed; the parts of %s are in %s", name, folder)
            continue
        made.append(container.assemble(paths, b["meta"], listed, out, str(folder / f"cover{cover[0]}") if cover else None))
        event = spark.createDataFrame([(b["book_id"], b["state_key"], out)], "book_id string, state_key string, audio_path string")
        progress.append(progress.marked(event, "book"), f"{state}/events")
    return made


def unfinished(run: Narration, settings: Settings, state: str) -> Narration:
    """The run without the books that an earlier one finished from the same
    input and settings and whose file is still there."""
    spark = run.books.sparkSession
    if not settings.resume:
        return run
    events = progress.valid(progress.load(spark, f"{state}/events"), state_keys(run, settings))
    last = progress.latest(events.filter("kind = 'book'")).join(progress.finished_books(events), "book_id", "left_semi")
    gone = [r["book_id"] for r in last.toLocalIterator() if Path(r["audio_path"]).exists()]
    if not gone:
        return run
    log.info("already assembled: %s", ", ".join(gone))
    rest = lambda df: df.filter(~F.col("book_id").isin(gone))
    return Narration(rest(run.books), rest(run.chapters), rest(run.sentences), rest(run.chunks), rest(run.plan), run.path)
