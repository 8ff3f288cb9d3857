"""WAV bytes, samples and probe results."""

from __future__ import annotations

import io
import wave

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def samples(content: bytes) -> tuple[np.ndarray, int]:
    """(mono float32 in [-1, 1], sample rate) of 16- or 32-bit PCM; channels are averaged."""
    with wave.open(io.BytesIO(content)) as w:
        width, channels, rate = w.getsampwidth(), w.getnchannels(), w.getframerate()
        data = w.readframes(w.getnframes())
    if width not in (2, 4):
        raise ValueError(f"unsupported sample width {width}")
    x = np.frombuffer(data, "<i2" if width == 2 else "<i4").astype(np.float32) / np.float32(1 << (8 * width - 1))
    return (x.reshape(-1, channels).mean(axis=1) if channels > 1 else x), rate


def wav_bytes(x: np.ndarray, rate: int) -> bytes:
    """16-bit mono WAV; samples are clipped to [-1, 1] and scaled by 32767."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.clip(x, -1.0, 1.0) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def trim_silence(x: np.ndarray, rate: int, floor_db: float = -40.0, least_ms: int = 500) -> np.ndarray:
    """Without silence of least_ms or more at either end."""
    loud = np.flatnonzero(np.abs(x) > 10 ** (floor_db / 20))
    if not len(loud):
        return x[:0]
    least = rate * least_ms // 1000
    first, last = int(loud[0]), int(loud[-1]) + 1
    return x[first if first >= least else 0 : last if len(x) - last >= least else len(x)]


def resample(x: np.ndarray, rate: int, new_rate: int) -> np.ndarray:
    """Linear interpolation to another rate."""
    n = int(round(len(x) * new_rate / rate))
    return np.interp(np.arange(n) * rate / new_rate, np.arange(len(x)), x).astype(np.float32) if len(x) else x


def normalize_level(x: np.ndarray, target_db: float = -19.0, peak_db: float = -1.5) -> np.ndarray:
    """One gain to the target root mean square, held below the peak."""
    power = float(np.sqrt(np.mean(np.square(x)))) if len(x) else 0.0
    if power == 0.0:
        return x
    gain = min(10 ** (target_db / 20) / power, 10 ** (peak_db / 20) / float(np.abs(x).max()))
    return (x * np.float32(gain)).astype(np.float32)


_FACTS = T.StructType([T.StructField("sample_rate", T.IntegerType()), T.StructField("n_samples", T.LongType()), T.StructField("duration_seconds", T.DoubleType()), T.StructField("error", T.StringType())])


@F.pandas_udf(_FACTS)
def probe(content: pd.Series) -> pd.DataFrame:
    """Header facts of WAV bytes; error where they cannot be read."""
    rows = []
    for c in content:
        try:
            with wave.open(io.BytesIO(c)) as w:
                rows.append((w.getframerate(), w.getnframes(), w.getnframes() / w.getframerate(), None))
        except (wave.Error, EOFError, TypeError, ZeroDivisionError) as e:
            rows.append((None, None, None, str(e) or "unreadable"))
    return pd.DataFrame(rows, columns=["sample_rate", "n_samples", "duration_seconds", "error"]).astype({"sample_rate": "Int32", "n_samples": "Int64"})


def probe_duration(payload: Column) -> Column:
    """Seconds in probe JSON: of the format, else of the first audio stream, else null."""
    p = F.from_json(payload, "format struct<duration:string>, streams array<struct<codec_type:string,duration:string>>")
    audio = F.try_element_at(F.filter(p["streams"], lambda s: s["codec_type"] == "audio"), F.lit(1))
    return F.coalesce(p["format"]["duration"], audio["duration"]).cast("double")


def loudness_stats(log: Column) -> Column:
    """Struct of measured loudness from the first JSON object of a log, with defaults."""
    p = F.from_json(F.regexp_extract(log, r"(?s)(\{[^{}]*\})", 1), "input_i string, input_tp string, input_lra string, input_thresh string, target_offset string")
    names = (("input_i", -23.0), ("input_tp", -2.0), ("input_lra", 7.0), ("input_thresh", -33.0), ("target_offset", 0.0))
    return F.struct(*[F.coalesce(p[n].cast("double"), F.lit(d)).alias(n) for n, d in names])


def finished(x: np.ndarray, rate: int, trim: bool, loudness: float | None, new_rate: int | None) -> tuple[np.ndarray, int]:
    """Trimmed, levelled, resampled, in this order.  A chapter of silence alone stays as it is."""
    cut = trim_silence(x, rate) if trim else x
    cut = cut if len(cut) else x
    cut = cut if loudness is None else normalize_level(cut, loudness)
    return (cut, rate) if new_rate in (None, rate) else (resample(cut, rate, new_rate), new_rate)


def joined_wav(parts: DataFrame, keys: list[str], order: str, trim: bool = False, loudness: float | None = None, new_rate: int | None = None) -> DataFrame:
    """parts (keys, order, content) -> one WAV per key group, in order, with
    what finished() does.  The group is one chapter; its size is that of its audio."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        pieces = [samples(c) for c in pdf["content"]]
        rate = pieces[0][1]
        x = np.concatenate([p if r == rate else resample(p, r, rate) for p, r in pieces])
        x, rate = finished(x, rate, trim, loudness, new_rate)
        return pd.DataFrame([(*(pdf[k].iloc[0] for k in keys), wav_bytes(x, rate), len(x) / rate)], columns=[*keys, "content", "duration_seconds"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema if f.name in keys) + ", content binary, duration_seconds double"
    return parts.groupBy(*keys).applyInPandas(run, schema)


def voice_base64(voices: DataFrame) -> DataFrame:
    """Reference voices (path, content) as base64 for a request."""
    return voices.select("path", F.base64("content").alias("voice"))
