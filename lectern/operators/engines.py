"""Interfaces to external models, each one call per partition.

A voice engine synthesises sentences, a transcriber writes down audio, a
refiner revises emotions.  Engines are started once per partition and closed
in any case; what ships here are deterministic stand-ins.
"""

from __future__ import annotations

import functools
import json
import logging
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.speech import EMOTIONS, Rules
from lectern.functions.text import unfence
from lectern.sources.audio import wav_bytes

log = logging.getLogger(__name__)


class VoiceEngine:
    """name, sample_rate and the life of an engine."""

    name, sample_rate = "abstract", 24_000

    def initialize(self) -> None:
        """Load models; called once per partition."""

    def synthesize(self, text: str, emotion: str, intensity: float, speed: float) -> np.ndarray:
        raise NotImplementedError

    def shutdown(self) -> None:
        """Free what initialize() took."""


class SilentEngine(VoiceEngine):
    """Silence as long as the text would take at 15 characters a second."""

    name = "silent"

    def __init__(self, sample_rate: int = 24_000):
        self.sample_rate = sample_rate

    def synthesize(self, text, emotion, intensity, speed):
        return np.zeros(int(self.sample_rate * max(1.0, len(text) / 15.0) / speed), np.float32)


class ToneEngine(SilentEngine):
    """A quiet tone of the same length, for tests of what follows."""

    name = "tone"

    def synthesize(self, text, emotion, intensity, speed):
        n = len(super().synthesize(text, emotion, intensity, speed))
        return (0.1 * np.sin(2 * np.pi * 220 * np.arange(n) / self.sample_rate)).astype(np.float32)


ENGINES: dict[str, Callable[[], VoiceEngine]] = {"silent": SilentEngine, "tone": ToneEngine}


#: Transcribers by name: model name -> factory for transcribe().  None ships.
TRANSCRIBERS: dict[str, Callable[[str], Callable[[], Callable[[bytes], str]]]] = {}


def engine_factory(name: str, voice: str = "") -> Callable[[], VoiceEngine]:
    """Makes the named engine; the voice goes to engines that take one, by
    name or as the path of a reference."""
    if name not in ENGINES:
        raise ValueError(f"unknown engine {name!r}; known: {', '.join(sorted(ENGINES))}")
    kind = ENGINES[name]
    takes = next((f for f in ("voice", "reference") if f in getattr(kind, "__dataclass_fields__", ())), None)
    return functools.partial(kind, **{takes: voice}) if voice and takes else kind


def get_engine(name: str, voice: str = "") -> VoiceEngine:
    return engine_factory(name, voice)()


def with_retries(call: Callable[[], object], attempts: int, delay: Callable[[int], float], sleep: Callable[[float], None] = time.sleep) -> object:
    """The call's value; between failed attempts k = 1, 2, … it waits delay(k) seconds."""
    for k in range(1, attempts + 1):
        try:
            return call()
        except Exception:
            if k == attempts:
                raise
            sleep(delay(k))
    raise ValueError("no attempts")


def linear_delay(k: int) -> float:
    return 2.0 * k


def doubling_delay(k: int) -> float:
    return float(min(2**k, 60))


def synthesize(chunks: DataFrame, engine: str = "silent", factory: Callable[[], VoiceEngine] | None = None, voice: str = "") -> DataFrame:
    """chunks (book_id, chapter_index, chunk_index, sentences array<struct<text,
    emotion, intensity, speed, pause_samples>>) -> content (WAV),
    duration_seconds, sample_rate, failed (sentences that became silence).
    Where an engine does not start, or a chunk cannot be made into sound at
    all, content is null, so that its chapter can be skipped."""
    make = factory or engine_factory(engine, voice)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = make()
        try:
            own.initialize()
        except Exception:
            log.exception("engine %s does not start", own.name)
            for pdf in frames:
                yield pdf[["book_id", "chapter_index", "chunk_index"]].assign(content=None, duration_seconds=0.0, sample_rate=own.sample_rate, failed=pdf["sentences"].map(len).astype("int32"))
            return
        try:
            for pdf in frames:
                rows = []
                for book, chapter, chunk, sentences in zip(pdf["book_id"], pdf["chapter_index"], pdf["chunk_index"], pdf["sentences"], strict=True):
                    pieces, failed = [], 0
                    for s in sentences:
                        try:
                            x = own.synthesize(s["text"], s["emotion"], s["intensity"], s["speed"])
                        except Exception:  # a sentence that fails is silence of its usual length
                            x, failed = np.zeros(int(own.sample_rate * max(1.0, len(s["text"]) / 15.0)), np.float32), failed + 1
                        pieces += [x, np.zeros(s["pause_samples"], np.float32)]
                    try:
                        x = np.concatenate(pieces) if pieces else np.zeros(0, np.float32)
                        content = wav_bytes(x, own.sample_rate)
                    except Exception:
                        log.exception("chunk %s of chapter %s of %s has no sound", chunk, chapter, book)
                        x, content = np.zeros(0, np.float32), None
                    rows.append((book, chapter, chunk, content, len(x) / own.sample_rate, own.sample_rate, failed))
                yield pd.DataFrame(rows, columns=["book_id", "chapter_index", "chunk_index", "content", "duration_seconds", "sample_rate", "failed"])
        finally:
            own.shutdown()

    return chunks.select("book_id", "chapter_index", "chunk_index", "sentences").mapInPandas(run, "book_id string, chapter_index int, chunk_index int, content binary, duration_seconds double, sample_rate int, failed int")


def transcribe(audio: DataFrame, factory: Callable[[], Callable[[bytes], str]]) -> DataFrame:
    """audio (book_id, chapter_index, content, duration_seconds) -> transcript;
    the model is made once per partition."""

    def run(frames):
        model = factory()
        for pdf in frames:
            yield pdf[["book_id", "chapter_index", "duration_seconds"]].assign(transcript=[model(c) for c in pdf["content"]])

    return audio.select("book_id", "chapter_index", "content", "duration_seconds").mapInPandas(run, "book_id string, chapter_index int, duration_seconds double, transcript string")


BATCH = 20


def refinement_requests(sentences: DataFrame, wanted: Column, batch: int = BATCH) -> DataFrame:
    """Requests of at most ``batch`` sentences of a chapter: book_id,
    chapter_index, batch_id, request (JSON)."""
    from pyspark.sql import Window

    order = Window.partitionBy("book_id", "chapter_index").orderBy("sentence_index")
    own = sentences.filter(wanted).withColumn("batch_id", F.floor((F.row_number().over(order) - 1) / batch).cast("int"))
    rows = F.sort_array(F.collect_list(F.struct(F.col("sentence_index").alias("index"), F.col("text"))))
    body = F.struct(F.array(*[F.lit(e) for e in EMOTIONS]).alias("emotions"), rows.alias("sentences"))
    return own.groupBy("book_id", "chapter_index", "batch_id").agg(F.to_json(body).alias("request"))


def refinement_replies(replies: DataFrame, rules: Rules = Rules()) -> DataFrame:  # noqa: B008
    """replies (book_id, chapter_index, reply) -> sentence_index, emotion,
    level.  Unknown emotions are neutral, items without an index and replies
    that are no JSON list drop out, of items of one index the last stands,
    intensities stay within 0.1 and the greatest."""
    items = F.from_json(unfence(F.col("reply")), "array<struct<index:int,emotion:string,intensity:double>>", {"mode": "PERMISSIVE"})
    later = F.slice("items", F.col("pos") + 2, F.size("items"))
    out = replies.withColumn("items", items).select("book_id", "chapter_index", "items", F.posexplode("items").alias("pos", "i"))
    out = out.filter(F.col("i.index").isNotNull() & ~F.coalesce(F.exists(later, lambda x: x["index"] == F.col("i.index")), F.lit(False)))
    level = F.greatest(F.lit(1000), F.least(F.lit(rules.max_intensity), F.round(F.coalesce("i.intensity", F.lit(0.3)) * 10000).cast("int")))
    emotion = F.lower(F.trim(F.coalesce("i.emotion", F.lit(""))))
    return out.select("book_id", "chapter_index", F.col("i.index").alias("sentence_index"), F.when(emotion.isin(*EMOTIONS), emotion).otherwise("neutral").alias("emotion"), level.alias("level"))


def ask(requests: DataFrame, factory: Callable[[], Callable[[str], str]]) -> DataFrame:
    """requests -> reply; a request that fails has the empty list."""

    def run(frames):
        client = factory()
        for pdf in frames:
            replies = []
            for request in pdf["request"]:
                try:
                    replies.append(client(request))
                except Exception:  # the rules' results stand
                    replies.append("[]")
            yield pdf[["book_id", "chapter_index", "batch_id"]].assign(reply=replies)

    return requests.select("book_id", "chapter_index", "batch_id", "request").mapInPandas(run, "book_id string, chapter_index int, batch_id int, reply string")


def echo_client() -> Callable[[str], str]:
    """A stand-in that finds every sentence curious."""
    return lambda request: json.dumps([{"index": s["index"], "emotion": "curious", "intensity": 0.4} for s in json.loads(request)["sentences"]])
