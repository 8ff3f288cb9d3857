"""Settings: defaults, then a YAML file, then the environment, then overrides."""

from __future__ import annotations

import dataclasses
import os
import re
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any


@dataclass(frozen=True)
class Processing:
    chunk_chars: int = 400
    segmenter: str = "regex"
    expand_numbers: bool = True
    expand_abbreviations: bool = True


@dataclass(frozen=True)
class Emotion:
    enabled: bool = False
    mode: str = "rules"
    default_emotion: str = "neutral"
    max_intensity: float = 0.7
    min_refine_length: int = 20
    batch_size: int = 20
    temperature: float = 0.3
    api_key: str = ""
    url: str = ""
    model: str = ""


@dataclass(frozen=True)
class Audio:
    sample_rate: int = 24_000
    sentence_pause_ms: int = 250
    paragraph_pause_ms: int = 500
    loudness: float = -19.0
    trim: bool = True
    normalize: bool = True


@dataclass(frozen=True)
class Container:
    bitrate: str = "64k"
    sample_rate: int = 22_050
    channels: int = 1


@dataclass(frozen=True)
class Validation:
    enabled: bool = False
    model: str = "base"
    threshold: float = 0.15


@dataclass(frozen=True)
class Book:
    title: str = ""
    author: str = ""
    narrator: str = ""
    year: str = ""


@dataclass(frozen=True)
class Settings:
    engine: str = "silent"
    voice: str = ""
    speed: float = 1.0
    output: str = "output"
    resume: bool = True
    processing: Processing = field(default_factory=Processing)
    emotion: Emotion = field(default_factory=Emotion)
    audio: Audio = field(default_factory=Audio)
    container: Container = field(default_factory=Container)
    validation: Validation = field(default_factory=Validation)
    book: Book = field(default_factory=Book)


def merged(base: dict[str, Any], over: dict[str, Any]) -> dict[str, Any]:
    """Deep merge; the second wins, lists and scalars as a whole."""
    both = dict(base)
    for k, v in over.items():
        both[k] = merged(both[k], v) if isinstance(v, dict) and isinstance(both.get(k), dict) else v
    return both


def build(kind: type, values: dict[str, Any]) -> Any:
    """A nested dataclass of the known keys of a dict; others are ignored."""
    out = {}
    for f in dataclasses.fields(kind):
        if f.name in values:
            inner = f.default_factory if f.default_factory is not dataclasses.MISSING else None
            out[f.name] = build(inner, values[f.name] or {}) if inner is not None and dataclasses.is_dataclass(inner) else values[f.name]
    return kind(**out)


def parse_yaml(text: str) -> dict[str, Any]:
    """Nested mappings of scalars, the part of YAML that settings need; PyYAML
    where it is installed.  Without it lists, block scalars, flow collections,
    anchors and lines that are no pair raise ValueError."""
    try:
        import yaml
    except ImportError:
        yaml = None
    if yaml is not None:
        return yaml.safe_load(text) or {}
    root: dict[str, Any] = {}
    levels: list[tuple[int, dict[str, Any]]] = [(-1, root)]
    for raw in text.splitlines():
        if raw.strip() in ("", "---") or raw.lstrip().startswith("#"):
            continue
        found = PAIR.match(raw)
        value = found and (found["value"] or "")
        if not found or value[:1] in (*"[{|>&*!%@`",):
            raise ValueError(f"cannot read this line of settings without PyYAML: {raw.strip()!r}")
        while levels[-1][0] >= len(found["indent"]):
            levels.pop()
        if value:
            levels[-1][1][found["key"]] = _scalar(value)
        else:
            child: dict[str, Any] = {}
            levels[-1][1][found["key"]] = child
            levels.append((len(found["indent"]), child))
    return root


#: A key with a scalar, quoted or not, and a comment.
PAIR = re.compile(r"""^(?P<indent> *)(?P<key>[A-Za-z0-9_.-]+) *:(?: +(?P<value>"[^"\\]*"|'[^']*'|[^\s"'#-](?:[^#]|(?<=\S)#)*?|-?[\d.][^\s#]*)?)? *(?: #.*)?$""")


def _scalar(value: str) -> Any:
    if value[0] == value[-1] and value[0] in "\"'" and len(value) > 1:
        return value[1:-1]
    if value.lower() in ("true", "false"):
        return value.lower() == "true"
    if value.lower() in ("null", "~"):
        return None
    for kind in (int, float):
        try:
            return kind(value)
        except ValueError:
            pass
    return value


def dotenv(path: Path) -> dict[str, str]:
    """KEY=value lines of a .env file; none where there is no file."""
    if not path.exists():
        return {}
    pairs = (line.partition("=") for line in path.read_text().splitlines() if "=" in line and not line.lstrip().startswith("#"))
    return {k.strip().removeprefix("export ").strip(): v.strip().strip("\"'") for k, _, v in pairs}


def load(path: str | None = None, overrides: dict[str, Any] | None = None, env: dict[str, str] | None = None) -> Settings:
    values: dict[str, Any] = parse_yaml(Path(path).read_text()) if path else {}
    environment = {**dotenv(Path(".env")), **(dict(os.environ) if env is None else env)}
    key = environment.get("EMOTION_LLM_API_KEY") or environment.get("OPENAI_API_KEY")
    if key:
        values = merged({"emotion": {"api_key": key}}, values)
    return build(Settings, merged(values, overrides or {}))
