"""Command line: forge, status, validate, reset.

Exit codes: 0 done or interrupted, 1 failed or flagged, 2 wrong usage.
"""

from __future__ import annotations

import argparse
import logging
import sys
from pathlib import Path

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lectern.operators import delivery, engines, progress, services
from lectern.plans import book, config

log = logging.getLogger("lectern")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lectern", description="Books to narration tables on Spark.")
    sub = top.add_subparsers(dest="command", required=True)
    forge = sub.add_parser("forge", help="read, annotate and render books")
    forge.add_argument("input")
    for flag in ("config", "output", "engine", "voice", "whisper-model", "title", "author"):
        forge.add_argument(f"--{flag}")
    forge.add_argument("--emotion", action="store_true", default=None)
    forge.add_argument("--validate", action="store_true", default=None)
    forge.add_argument("--no-resume", action="store_true")
    for name in ("status", "validate", "reset"):
        p = sub.add_parser(name)
        p.add_argument("output")
        p.add_argument("--config")
        if name == "validate":
            p.add_argument("--input", required=True)
            p.add_argument("--transcripts", required=True, help="Parquet of book_id, chapter_index, transcript, duration_seconds")
        if name == "reset":
            p.add_argument("--yes", action="store_true")
    return top


def overrides(args: argparse.Namespace) -> dict:
    pairs = {"engine": args.engine, "voice": args.voice, "output": args.output, "emotion": {"enabled": args.emotion}, "validation": {"enabled": args.validate, "model": args.whisper_model}, "book": {"title": args.title, "author": args.author}, "resume": False if args.no_resume else None}
    clean = lambda d: {k: clean(v) if isinstance(v, dict) else v for k, v in d.items() if v is not None}
    return clean(pairs)


def refiner(settings: config.Settings):
    """Factory of a chat refiner where the settings ask for one and name it."""
    e = settings.emotion
    if book.refinement_mode(settings) in ("off", "rules") or not e.url:
        return None
    return services.chat_client(e.url, e.model, e.api_key, e.temperature, e.max_intensity)


def forge(spark: SparkSession, args: argparse.Namespace) -> int:
    settings = config.load(args.config, overrides(args))
    state, whole = f"{settings.output}/state", book.build(spark, args.input, settings, refiner(settings))
    if not settings.resume:
        progress.reset(spark, state)
    run = book.unfinished(whole, settings, state)
    if run.books.isEmpty():
        return 0
    out = book.render(run, settings, state)
    out["audio"].write.mode("overwrite").parquet(f"{settings.output}/chapters")
    chapters = spark.read.parquet(f"{settings.output}/chapters")
    if chapters.isEmpty():
        raise RuntimeError("no chapter has audio")
    times = delivery.timeline(chapters)
    delivery.metadata_text(run.books, times).select("value").write.mode("overwrite").text(f"{settings.output}/metadata", lineSep="\n\n")
    for made in book.assemble(run, chapters, times, settings, state):
        log.info("assembled %s", made)
    if settings.validation.enabled:
        checked_transcripts(run, chapters, settings)
    return 0


def checked_transcripts(run: book.Narration, chapters, settings: config.Settings) -> None:
    """Transcribes, compares and reports; only warns where no transcriber is installed."""
    if not engines.TRANSCRIBERS:
        log.warning("no transcriber is installed; run validate with transcripts")
        return
    make = next(iter(engines.TRANSCRIBERS.values()))(settings.validation.model)
    report(run, engines.transcribe(chapters, make), settings, settings.output)


def report(run: book.Narration, transcripts, settings: config.Settings, output: str) -> bool:
    """Prints and writes the report and the transcripts by book and chapter; whether a chapter is flagged."""
    checked = delivery.validate(run.chapters, transcripts, settings.validation.threshold).cache()
    told = delivery.report(run.books, checked, settings.validation.model).cache()
    for r in told.toLocalIterator():
        print(r["value"])
    told.select("value").write.mode("overwrite").text(f"{output}/report")
    checked.select("book_id", "chapter_index", F.col("transcript").alias("value")).write.mode("overwrite").partitionBy("book_id", "chapter_index").text(f"{output}/transcripts")
    return not checked.filter("flagged").isEmpty()


def status(spark: SparkSession, args: argparse.Namespace) -> int:
    at, events = f"{args.output}/state", progress.load(spark, f"{args.output}/state/events")
    if events.isEmpty():
        return 0
    planned = spark.read.parquet(f"{at}/totals")
    totals = planned.groupBy("book_id").agg(F.count("*").alias("total_chapters"), F.sum("chunks").alias("total_chunks"))
    own = progress.valid(events, planned.select("book_id", "state_key").distinct())
    for r in progress.progress(totals, own).orderBy("book_id").toLocalIterator():
        print(f"{r['book_id']}: {r['completed_chunks']}/{r['total_chunks']} chunks, {r['completed_chapters']}/{r['total_chapters']} chapters, {r['percent']}%")
    return 0


def validate(spark: SparkSession, args: argparse.Namespace) -> int:
    settings = config.load(args.config)
    run = book.build(spark, args.input, settings)
    return int(report(run, spark.read.parquet(args.transcripts), settings, args.output))


def reset(spark: SparkSession, args: argparse.Namespace) -> int:
    if not args.yes and input("Delete all progress? [y/N] ").strip().lower() not in ("y", "yes"):
        return 0
    progress.reset(spark, f"{args.output}/state")
    return 0


LINE = "%(asctime)s %(levelname)s %(message)s"


def log_file(args: argparse.Namespace) -> logging.Handler | None:
    """A log beside what forge makes, in addition to the console."""
    if args.command != "forge":
        return None
    folder = Path(args.output or config.load(args.config).output)
    folder.mkdir(parents=True, exist_ok=True)
    handler = logging.FileHandler(folder / "lectern.log", encoding="utf-8")
    handler.setFormatter(logging.Formatter(LINE))
    logging.getLogger().addHandler(handler)
    return handler


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    logging.basicConfig(format=LINE)
    log.setLevel(logging.INFO)
    spark = spark or SparkSession.builder.appName("lectern").getOrCreate()
    handler = log_file(args)
    try:
        return {"forge": forge, "status": status, "validate": validate, "reset": reset}[args.command](spark, args)
    except KeyboardInterrupt:
        log.warning("interrupted; progress is kept")
        return 0
    except (FileNotFoundError, ValueError, RuntimeError, PySparkException) as e:
        log.error("%s", e)
        return 1
    finally:
        if handler:
            logging.getLogger().removeHandler(handler)
            handler.close()


if __name__ == "__main__":
    sys.exit(main())
