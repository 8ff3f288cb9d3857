"""Who speaks, and how: dialogue and emotion rules as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import SPACE

# Verbs of attribution, past, third person, base form.
ATTRIBUTION_VERBS = (
    "said", "says", "say", "asked", "asks", "ask", "replied", "replies", "reply", "answered", "answers", "answer",
    "called", "calls", "call", "cried", "cries", "cry", "shouted", "shouts", "shout", "yelled", "yells", "yell",
    "whispered", "whispers", "whisper", "murmured", "murmurs", "murmur", "muttered", "mutters", "mutter",
    "growled", "growls", "growl", "snapped", "snaps", "snap", "hissed", "hisses", "hiss", "breathed", "breathes", "breathe",
    "laughed", "laughs", "laugh", "sobbed", "sobs", "sob", "sighed", "sighs", "sigh", "groaned", "groans", "groan",
    "screamed", "screams", "scream", "declared", "declares", "declare", "announced", "announces", "announce",
    "exclaimed", "exclaims", "exclaim", "demanded", "demands", "demand", "ordered", "orders", "order",
    "pleaded", "pleads", "plead", "begged", "begs", "beg", "suggested", "suggests", "suggest",
    "admitted", "admits", "admit", "agreed", "agrees", "agree", "argued", "argues", "argue",
    "insisted", "insists", "insist", "interrupted", "interrupts", "interrupt", "continued", "continues", "continue",
    "added", "adds", "add", "noted", "notes", "note", "observed", "observes", "observe", "thought", "thinks", "think",
    "wondered", "wonders", "wonder", "realized", "realises", "realize", "remembered", "remembers", "remember",
    "told", "tells", "tell", "warned", "warns", "warn", "promised", "promises", "promise", "lied", "lies", "lie",
    "teased", "teases", "tease", "confessed", "confesses", "confess", "repeated", "repeats", "repeat",
    "echoed", "echoes", "echo", "grumbled", "grumbles", "grumble", "whimpered", "whimpers", "whimper",
    "stuttered", "stutters", "stutter",
)
# Verb, emotion, intensity in ten-thousandths.
VERB_EMOTIONS = (
    ("whispered", "whispered", 5000), ("murmured", "whispered", 5000), ("breathed", "whispered", 5000),
    ("shouted", "excited", 6000), ("screamed", "excited", 6000), ("yelled", "excited", 6000), ("bellowed", "excited", 6000),
    ("sobbed", "sad", 5000), ("wept", "sad", 5000), ("cried", "sad", 5000),
    ("snapped", "tense", 5000), ("growled", "tense", 5000), ("snarled", "tense", 5000),
    ("laughed", "excited", 4000), ("chuckled", "excited", 4000), ("giggled", "excited", 4000),
    ("asked", "curious", 3000), ("wondered", "curious", 3000), ("inquired", "curious", 3000),
)
EMOTIONS = ("angry", "calm", "curious", "excited", "neutral", "sad", "tense", "whispered")
STRONG_WORDS = (
    "terrified", "terror", "petrified", "ecstatic", "euphoric", "elated", "heartbroken", "devastated", "shattered",
    "furious", "enraged", "livid", "anguish", "despair", "hopeless", "triumphant", "exhilarating", "overwhelming",
    "horrified", "panic", "dread", "grief", "mourning", "bereavement", "betrayed", "humiliated", "ashamed",
)

#: Spans in straight quotes, and in curly ones.
STRAIGHT, CURLY = '"[^"\\n]{1,500}"', "\u201c[^\u201d\\n]{1,500}\u201d"
#: A letter, digit or _; a mark that combines is none.
WORD = r"\p{L}\p{N}_"
#: Edges of a word of ASCII letters, digits and _, whatever stands beside it.
#: \b is not used: in Java up to 18 other letters count as part of a word.
BEFORE, AFTER = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
#: The same where a word may begin or end with a long s or a Kelvin sign, which
#: are an s and a k without regard to case; (?i) knows ASCII only.
FIRST = "(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?=[\u017f\u212a]))"
LAST = "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<=[\u017f\u212a])(?=[A-Za-z0-9_]))"
#: White space of ASCII without the vertical tab.
ASCII_SPACE = r"\t\n\f\r "
ITALIC = r"_[^_\n]{1,200}_"


@dataclass(frozen=True)
class Rules:
    """Settings of the emotion rules; intensities in ten-thousandths."""

    default_emotion: str = "neutral"
    default_intensity: int = 3000
    max_intensity: int = 7000
    sentence_pause_ms: int = 250
    paragraph_pause_ms: int = 500
    min_refine_length: int = 20
    escalation: int = 3000
    emotional_share: int = 30


def _total_length(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0), lambda a, s: a + F.length(s))


def attribution_verb(text: Column) -> Column:
    """First verb of attribution in lower case, or the empty string.  Verbs
    of one first letter are tried together, in their order."""
    ends = {}
    for verb in ATTRIBUTION_VERBS:
        ends.setdefault(verb[0], []).append(verb[1:])
    verbs = "|".join(f"{first}(?:{'|'.join(own)})" for first, own in ends.items()).replace("s", "[s\u017f]").replace("k", "[k\u212a]")
    return F.lower(F.regexp_extract(text, f"(?i){FIRST}({verbs}){LAST}", 1))


def thought(space: str) -> str:
    """Pattern of a span in single quotes with no space inside them and no
    word outside.  What stands outside is part of the match: a look behind
    sees half of a letter beyond U+FFFF."""
    return rf"(?U)(?:^|[^{WORD}])'([^{space}'][^'\n]{{1,198}}[^{space}'])'(?:[^{WORD}]|\z)"


def detect_dialogue(df: DataFrame, column: str = "text", straight: bool = False) -> DataFrame:
    """Adds narration_mode, speaker, contains_dialogue, attribution_verb.
    straight: only straight double quotes hold dialogue, and beside single
    ones only ASCII's white space counts as such."""
    text = F.col(column)
    quoted, single = (STRAIGHT, thought(ASCII_SPACE)) if straight else (f"{STRAIGHT}|{CURLY}", thought(SPACE))
    df = df.withColumns({
        "lectern_d": _total_length(F.regexp_extract_all(text, F.lit(quoted), F.lit(0))),
        "lectern_t": _total_length(F.regexp_extract_all(text, F.lit(single), F.lit(1))) + _total_length(F.regexp_extract_all(text, F.lit(ITALIC), F.lit(0))),
    })
    d, t, n = F.col("lectern_d"), F.col("lectern_t"), F.length(text)
    rest = n - d - t
    mode = F.when((d > 0) & (t > 0), "mixed").when((d > 0) & (rest > F.greatest(F.lit(20.0), 0.4 * n)), "mixed").when(d > 0, "dialogue").when(t > 0, "thought").otherwise("prose")
    df = df.withColumns({"narration_mode": mode, "contains_dialogue": d > 0, "attribution_verb": attribution_verb(text)})
    spoken = F.col("narration_mode").isin("dialogue", "mixed") & F.col("contains_dialogue")
    return df.withColumn("speaker", F.when(spoken, "character").otherwise("narrator")).drop("lectern_d", "lectern_t")


def caps_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"{BEFORE}[A-Z]{{2,}}{AFTER}"))


def pause_ms(paragraph_end: Column, rules: Rules = Rules()) -> Column:  # noqa: B008
    return F.when(paragraph_end, rules.paragraph_pause_ms).otherwise(rules.sentence_pause_ms).cast("int")


def tag_emotions(df: DataFrame, rules: Rules = Rules(), column: str = "text") -> DataFrame:  # noqa: B008
    """Adds emotion and level (intensity in ten-thousandths) by the rules, before guardrails."""
    text, mode, verb = F.trim(F.col(column)), F.col("narration_mode"), F.col("attribution_verb")
    spoken, top = mode == "dialogue", rules.max_intensity
    table_e = F.create_map(*[F.lit(x) for v, e, _ in VERB_EMOTIONS for x in (v, e)])
    table_i = F.create_map(*[F.lit(x) for v, _, i in VERB_EMOTIONS for x in (v, i)])
    mapped = spoken & F.map_contains_key(table_e, verb)
    df = df.withColumns({
        "emotion": F.when(mapped, F.try_element_at(table_e, verb)).when(mode == "thought", "calm").otherwise(rules.default_emotion),
        "level": F.when(mapped, F.try_element_at(table_i, verb)).otherwise(rules.default_intensity),
    })
    level, emotion = F.col("level"), F.col("emotion")
    dots = F.endswith(text, F.lit("..."))
    level = F.when(F.endswith(text, F.lit("!")), F.least(level + 1500, F.lit(top))).otherwise(level)
    level = F.when(dots, F.greatest(level - 1000, F.lit(1000))).otherwise(level)
    level = F.when(caps_words(text) >= 2, F.least(level + 1000, F.lit(top))).otherwise(level)
    asks = F.endswith(text, F.lit("?")) & spoken & (emotion == rules.default_emotion)
    return df.withColumns({"emotion": F.when(dots, "calm").when(asks, "curious").otherwise(emotion), "level": F.least(level, F.lit(top)).cast("int")})


def plain_delivery(df: DataFrame) -> DataFrame:
    """What tag_emotions adds where emotions are off."""
    return df.withColumns({"emotion": F.lit("neutral"), "level": F.lit(3000)})


def needs_refinement(df: DataFrame, rules: Rules = Rules(), column: str = "text") -> Column:  # noqa: B008
    """Neutral dialogue, or a long enough sentence with a strong word."""
    words = F.regexp_extract_all(F.lower(F.col(column)), F.lit(f"[{WORD}]+"), F.lit(0))
    strong = F.arrays_overlap(words, F.array(*[F.lit(w) for w in STRONG_WORDS]))
    return ((F.col("emotion") == "neutral") & F.col("contains_dialogue")) | ((F.length(column) > rules.min_refine_length) & strong)


# Inline tag words and speed factors of the emotions.
TAG_WORDS = (
    ("neutral", ""), ("calm", "calm narrator voice"), ("curious", "curious tone"), ("tense", "tense, urgent"),
    ("excited", "excited"), ("sad", "sad, melancholic"), ("whispered", "whispering"), ("angry", "angry"),
)
SPEED_FACTORS = (
    ("neutral", 1.0), ("calm", 0.95), ("curious", 1.0), ("tense", 1.05), ("excited", 1.05), ("sad", 0.95),
    ("whispered", 0.85), ("angry", 1.1),
)


def _lookup(pairs: tuple, key: Column, default: object) -> Column:
    table = F.create_map(*[F.lit(x) for pair in pairs for x in pair])
    return F.coalesce(F.try_element_at(table, key), F.lit(default))


def tagged_text(emotion: Column, intensity: Column, text: Column) -> Column:
    """The sentence after its inline tag; "very" above an intensity of 0.6."""
    word = _lookup(TAG_WORDS, emotion, "")
    tag = F.when(intensity > 0.6, F.concat(F.lit("very "), word)).otherwise(word)
    return F.when(word == "", text).otherwise(F.concat(F.lit("["), tag, F.lit("] "), text))


def speed(emotion: Column, intensity: Column, base: float = 1.0) -> Column:
    """Speaking rate: the emotion's factor in proportion to intensity, within 0.5 and 2."""
    factor = _lookup(SPEED_FACTORS, emotion, 1.0)
    return F.greatest(F.lit(0.5), F.least(F.lit(2.0), base * (1.0 + (factor - 1.0) * intensity)))


def pause_samples(rate: int, pause: Column, paragraph_end: Column, extra_ms: int = 500) -> Column:
    """Silent samples after a sentence; a paragraph's end adds extra_ms."""
    own = F.floor(rate * pause / 1000)
    return (own + F.when(paragraph_end, rate * extra_ms // 1000).otherwise(0)).cast("long")


def fallback_seconds(text: Column) -> Column:
    """Length of speech without a voice: 15 characters a second, one second at least."""
    return F.greatest(F.lit(1.0), F.length(text) / F.lit(15.0))
