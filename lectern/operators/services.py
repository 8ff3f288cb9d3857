"""Voices and refiners behind HTTP, with the standard library alone.

Each object is made and used on a worker, once per partition.
"""

from __future__ import annotations

import base64
import json
import logging
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path

import numpy as np

from lectern.functions.speech import EMOTIONS, TAG_WORDS
from lectern.operators.engines import ENGINES, VoiceEngine, doubling_delay, linear_delay, with_retries
from lectern.sources.audio import resample, samples

log = logging.getLogger(__name__)


class Refused(RuntimeError):
    """An answer that no retry can mend."""


def post(url: str, body: dict, key: str = "", timeout: float = 120) -> bytes:
    """Answer to a JSON request.  Rate limits, server errors and lost
    connections raise OSError, other refusals Refused."""
    headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})
    request = urllib.request.Request(url, json.dumps(body, ensure_ascii=False).encode(), headers, method="POST")
    try:
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            return answer.read()
    except urllib.error.HTTPError as e:
        if e.code == 429 or e.code >= 500:
            raise
        raise Refused(f"{url}: {e.code} {e.reason}") from e


def _patient(call: Callable[[], bytes], attempts: int, delay: Callable[[int], float]) -> bytes:
    """with_retries, but a refusal is final."""

    def once():
        try:
            return call()
        except Refused as e:
            return e

    got = with_retries(once, attempts, delay)
    if isinstance(got, Refused):
        raise got
    return got


@dataclass
class SpeechApi(VoiceEngine):
    """A speech endpoint of the common kind (``/audio/speech``); emotion is not sent."""

    url: str = "http://localhost:8000/v1"
    model: str = "tts-1"
    voice: str = "alloy"
    key: str = ""
    sample_rate: int = 24_000
    name = "speech_api"

    def synthesize(self, text: str, emotion: str, intensity: float, speed: float) -> np.ndarray:
        body = {"model": self.model, "voice": self.voice, "input": text, "speed": speed, "response_format": "wav"}
        x, rate = samples(_patient(lambda: post(f"{self.url.rstrip('/')}/audio/speech", body, self.key), 5, doubling_delay))
        return x if rate == self.sample_rate else resample(x, rate, self.sample_rate)


@dataclass
class TaggedApi(VoiceEngine):
    """A server (``/v1/tts``) that reads inline emotion tags and can imitate a voice."""

    url: str = "http://localhost:8080"
    reference: str = ""
    reference_text: str = ""
    sample_rate: int = 44_100
    name = "tagged"

    def initialize(self) -> None:
        """RuntimeError where the server cannot be reached; the voice is read once."""
        try:
            with urllib.request.urlopen(self.url.rstrip("/") + "/", timeout=10):
                pass
        except OSError as e:
            raise RuntimeError(f"cannot reach {self.url}: {e}") from e
        self.voice = ""
        if self.reference and Path(self.reference).is_file():
            self.voice = base64.b64encode(Path(self.reference).read_bytes()).decode()
        elif self.reference:
            log.warning("no reference voice at %s; going on without", self.reference)

    def synthesize(self, text: str, emotion: str, intensity: float, speed: float) -> np.ndarray:
        word = dict(TAG_WORDS).get(emotion, "")
        tag = f"[{'very ' if intensity > 0.6 else ''}{word}] " if word else ""
        body = {"text": tag + text, "format": "wav"} | ({"reference_audio": self.voice, "reference_text": self.reference_text} if self.voice else {})
        x, rate = samples(_patient(lambda: post(f"{self.url.rstrip('/')}/v1/tts", body), 3, linear_delay))
        return x if rate == self.sample_rate else resample(x, rate, self.sample_rate)


ENGINES |= {"speech_api": SpeechApi, "tagged": TaggedApi}


def chat_client(url: str, model: str, key: str = "", temperature: float = 0.3, most: float = 0.7) -> Callable[[], Callable[[str], str]]:
    """Factory of a refiner for engines.ask(): a chat endpoint
    (``/chat/completions``) that answers with a JSON list."""
    task = (
        f"You label sentences of a book for its narrator. Emotions: {', '.join(EMOTIONS)}. Intensity: 0.1 to {most}. "
        'Answer with a JSON list alone: [{"index": 0, "emotion": "calm", "intensity": 0.3}]'
    )

    def make() -> Callable[[str], str]:
        def client(request: str) -> str:
            sentences = json.dumps(json.loads(request)["sentences"], ensure_ascii=False)
            body = {"model": model, "temperature": temperature, "messages": [{"role": "system", "content": task}, {"role": "user", "content": sentences}]}
            return json.loads(post(f"{url.rstrip('/')}/chat/completions", body, key, timeout=30))["choices"][0]["message"]["content"]

        return client

    return make
