"""Documents that try every edge, and plain versions of what operators compute."""

from __future__ import annotations

import random
import re

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, fingerprint string, key string, n_tokens int, digest string, kept boolean"


def documents(spark, texts, ids=None, sources=None):
    """A documents table with extra columns whose names operators use inside."""
    rows = [((ids[i] if ids else i), t, None if i % 5 == 0 else "en", (sources[i] if sources else None if i % 7 == 0 else f"src{i % 3}"), None if t is None else len(t), "x", None, 1, "d", i % 2 == 0) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def odd_texts(seed: int = 1) -> list[str | None]:
    rng = random.Random(seed)
    vocab = [f"{a}{b}" for a in ("the", "de", "Qu", "é", "x9") for b in ("", "on", "TER", ".", "ß,", "日本")]
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    base = prose(300)
    words = base.split()
    shared = prose(40)
    return [
        None, "", " ", "\n\t ", "a", "a b", "A B c", "é́ﬁ İ ΑΣ", "\x00\x01 \x1c\x1d \x85 x", "<|endoftext|> <|startoftext|>x<|endoftext|>",
        base, base, base.upper(), " ".join(words[:-1] + ["changed"]), " ".join(["new", *words[1:]]), shared, f"{prose(30)} {shared} {prose(30)}", f"{prose(20)}\n{shared}", shared,
        "same line\n" * 60, "word " * 500, prose(20_000), "x" * 70_000, *(prose(rng.randrange(0, 120)) for _ in range(40)),
    ]


def ascii_lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)
