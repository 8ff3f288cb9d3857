"""Awkward documents that every operator must take."""

from __future__ import annotations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, bucket int, keys string, slice long"

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(seed: int, n: int) -> str:
    """n words that repeat no five in a row of another seed."""
    return " ".join(f"{WORDS[(seed * 7 + i * (seed % 5 + 3)) % len(WORDS)]}{seed}x{i % 97}" for i in range(n))


def rows() -> list[tuple]:
    long = prose(1, 30_000)
    texts = [
        (1, prose(2, 120)), (2, prose(2, 120)), (3, prose(2, 119) + " other"), (4, prose(3, 80)), (5, None), (6, ""), (7, " \n\t "), (8, "one"),
        (9, "one two three four"), (9, "one two three four"), (10, long), (11, "ÄÖÜ ß é é İ Σ \U0001F600 " + prose(4, 60)), (None, prose(5, 60)), (None, None),
        (12, "a\x00b " + prose(6, 40)), (13, "idiot " * 3 + prose(7, 50)), (14, "x" * 5000),
    ]
    return [(i, t, "en" if k % 2 else None, None if k % 5 == 0 else f"s{k % 3}", len(t or ""), 1.5, 3, "k", 7) for k, (i, t) in enumerate(texts)]


def docs(spark, some=None):
    return spark.createDataFrame(rows() if some is None else some, SCHEMA)


def made(spark, pairs):
    """Documents of (doc_id, text)."""
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", len(t or ""), 0.0, 0, "", 0) for i, t in pairs], SCHEMA)
