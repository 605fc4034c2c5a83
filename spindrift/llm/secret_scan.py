"""Secret scan: patterns, and strings that a tokenizer's vocabulary can't shorten.

Pattern spans are those of three kinds (assign, access, hex). Beside them, what these leave of a run of key characters
that mixes letters and digits, or small and capital letters, is tokenised: prose and names make few tokens for their
length, random strings many. Small letters alone are tested as well. A run is parted at equals signs; a part, or else its windows of twenty characters, with at
most ``max_chars_per_token`` characters a token are added as kind ``random``, unless they are digests, UUIDs, numbers, readable words set off by
- or _, embedded data or mail addresses. Twenty or more small letters alone count by the ratio of all of them, and in URLs a path's
segment or a query's value counts if it is random as a whole (``in_urls``).

Rows are independent: no shuffle. Null and empty text has no spans. Repeated rows are scanned each. An empty table gives
an empty one; ``redact`` carries other columns along, whatever their names, and ``scan`` does not look at them.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.bpe import PRE_TOKEN, vocabulary_path
from spindrift.llm.common import text_or_empty, text_parts

KINDS = ("assign", "access", "hex", "random")
#: The three patterns. Runs are greedy, so a least length inside the pattern of access and hex selects the same runs.
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
LEAST_VALUE = 6
RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
LEAST_RUN = 20
#: Letters and digits, or, without digits, small and capital letters by turns.
MIXED = re.compile(r"(?=.*[A-Za-z])(?:.*[0-9]|(?:.*?[a-z][A-Z]){2})", re.S)
LETTERS = re.compile(r"[a-z]+")
PART = re.compile(r"[A-Za-z0-9]{8,}")
NAME = re.compile(r"[^-_]+")
SEGMENT = re.compile(r"[^/=]+")
#: Pieces of a run between equals signs; those at its end pad a value.
VALUE = re.compile(r"[^=]+(?:=+\Z)?")
UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
DIGEST = re.compile(r"(?:[a-z0-9]+[-=])?(?:[0-9A-Fa-f]{32}|[0-9A-Fa-f]{40}|[0-9A-Fa-f]{56}|[0-9A-Fa-f]{64}|[0-9A-Fa-f]{96}|[0-9A-Fa-f]{128})")
#: Addresses: what follows a URL's scheme (and user), a www. host, embedded data, a mail address.
ADDRESS = re.compile(
    r"(?<![A-Za-z0-9+.-])(?:(?:[a-z][a-z0-9+.-]{0,30}://(?:[^\s/?#\"'<>@]{0,200}@)?|www\.)(?P<rest>[^\s\"'<>]+)|data:[a-z0-9/+.-]{0,80};base64,(?P<data>[^\s\"'<>]+))"
    r"|(?<![A-Za-z0-9._%+-])(?P<mail>[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.)+[A-Za-z]{2,})",
    re.I | re.A,
)


@cache
def token_counter(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("secret_scan", pat_str=PRE_TOKEN, mergeable_ranks=ranks, special_tokens={})


def pattern_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) of the three patterns, per kind from the left and without overlap."""
    spans = []
    low = text.lower()
    if any(w in low for w in WORDS):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= LEAST_VALUE]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return spans


def addresses(text: str) -> list[tuple[int, int, bool]]:
    """Spans of addresses, and whether their segments are tested: those of URLs are, embedded data and mail addresses are not."""
    if not any(x in text for x in ("://", "@")) and not re.search(r"www\.|;base64,", text, re.I):
        return []
    kinds = ((m, next(k for k in ("rest", "data", "mail") if m[k])) for m in ADDRESS.finditer(text))
    return [(*m.span(k), k == "rest") for m, k in kinds]


def readable(part: str, encoding) -> bool:
    """A word as names hold them: letters only, five or more, in few tokens."""
    return len(part) >= 5 and part.isalpha() and len(part) >= 3 * len(encoding.encode_ordinary(part.lower()))


def unnamed(piece: str, encoding) -> list[tuple[int, int]]:
    """What a piece has between readable words, all of it where there are none; words are set off by - and _."""
    words = [m.span() for m in NAME.finditer(piece)]
    known = [w for w in words if readable(piece[w[0] : w[1]], encoding)]
    if not known:
        return [(0, len(piece))]
    found, done = [], 0
    for a, b in [*known, (len(piece) + 1, 0)]:
        if a - 1 > done:
            found.append((done, a - 1))
        done = b + 1
    return found


def dense(piece: str, encoding, max_chars_per_token: float) -> list[tuple[int, int]]:
    """Stretches of a piece with few characters per token: all of it, or the union of its windows of LEAST_RUN characters that have few."""
    tokens = encoding.encode_ordinary(piece)
    if len(piece) <= max_chars_per_token * len(tokens):
        return [(0, len(piece))]
    at = [0]
    for t in tokens:
        at.append(at[-1] + len(encoding.decode_single_token_bytes(t)))
    found: list[tuple[int, int]] = []
    j = 0
    for i in range(len(tokens)):
        while j < len(tokens) and at[j] - at[i] < LEAST_RUN:
            j += 1
        size = at[j] - at[i]
        if size < LEAST_RUN:
            break
        if size <= max_chars_per_token * (j - i):
            window = piece[at[i] : at[j]]
            # Numbers and short words by turns, as in names of versions, have short tokens as well.
            if MIXED.match(window) and any(MIXED.match(w) for w in PART.findall(window)):
                if found and at[i] <= found[-1][1]:
                    found[-1] = found[-1][0], at[j]
                else:
                    found.append((at[i], at[j]))
    return found


def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, overlapping ones as one."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = out[-1][0], max(e, out[-1][1])
        else:
            out.append((s, e))
    return out


def candidate(piece: str) -> bool:
    """Long enough and no digest or UUID, and mixed, or small letters alone."""
    return len(piece) >= LEAST_RUN and not UUID.fullmatch(piece) and not DIGEST.fullmatch(piece) and (MIXED.match(piece) is not None or LETTERS.fullmatch(piece) is not None)


def stretches(piece: str, encoding, max_chars_per_token: float) -> list[tuple[int, int]]:
    """Random stretches of a candidate. Small letters alone have no windows: the ratio of all of them decides."""
    found = []
    for a, b in unnamed(piece, encoding):
        part = piece[a:b]
        if not candidate(part):
            continue
        if MIXED.match(part):
            found += [(a + x, a + y) for x, y in dense(part, encoding, max_chars_per_token)]
        elif len(part) <= max_chars_per_token * len(encoding.encode_ordinary(part)):
            found.append((a, b))
    return found


def segments(text: str, start: int, end: int, encoding, max_chars_per_token: float) -> list[tuple[int, int]]:
    """Segments of a path and values of a query that are random as a whole."""
    found = []
    for m in SEGMENT.finditer(text, start, end):
        part = m[0]
        if candidate(part) and MIXED.match(part) and unnamed(part, encoding) == [(0, len(part))] and len(part) <= max_chars_per_token * len(encoding.encode_ordinary(part)):
            found.append(m.span())
    return found


def random_spans(text: str, taken: list[tuple[int, int, int]], encoding, max_chars_per_token: float, in_urls: bool = False) -> list[tuple[int, int, int]]:
    spans = []
    known: list[tuple[int, int, bool]] | None = None
    covered, at = joined([(s, e) for s, _, e in taken]), 0
    for m in RUN.finditer(text):
        run, a, b = m[0], m.start(), m.end()
        while at < len(covered) and covered[at][1] <= a:
            at += 1
        if not candidate(run) and "/" not in run and "=" not in run:
            continue
        # What pattern spans leave of the run, and then its values.
        pieces, done, k = [], a, at
        while k < len(covered) and covered[k][0] < b:
            pieces += [(done + v.start(), done + v.end()) for v in VALUE.finditer(text[done : max(covered[k][0], done)])]
            done, k = max(done, covered[k][1]), k + 1
        pieces += [(done + v.start(), done + v.end()) for v in VALUE.finditer(text[done : max(b, done)])]
        for s, e in pieces:
            piece = text[s:e]
            if not candidate(piece):
                continue
            found = stretches(piece, encoding, max_chars_per_token)
            if found and known is None:
                known = addresses(text)
            for x, y in found:
                before = bisect_right(known, (s + x, len(text), True)) - 1
                if before < 0 or known[before][1] <= s + x:
                    spans.append((s + x, 3, s + y))
                elif in_urls and known[before][2]:
                    spans += [(u, 3, v) for u, v in segments(text, max(s, known[before][0]), e, encoding, max_chars_per_token) if u < s + y and v > s + x]
    return sorted(set(spans))


def spans_of(text: str, encoding, max_chars_per_token: float, in_urls: bool = False) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) of all spans; segments of URLs are tested if ``in_urls``."""
    base = pattern_spans(text)
    return sorted(base + random_spans(text, base, encoding, max_chars_per_token, in_urls))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k.tiktoken", max_chars_per_token: float = 2.0, in_urls: bool = False) -> DataFrame:
    """Return ``id_col``, spans array<struct<kind, start, end>> per document: code points, end exclusive, by start and kind."""
    rows = docs.select(F.col(id_col).alias("key"), text_or_empty(text_col).alias("text"))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = token_counter(vocabulary_path(vocabulary))
        for part, texts in text_parts(batches, "text"):
            found = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans_of(t, encoding, max_chars_per_token, in_urls)] for t in texts]
            yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(found, kind)], ["key", "spans"])

    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, spans array<struct<kind:string,start:long,end:long>>").withColumnRenamed("key", id_col)


def redact(docs: DataFrame, text_col: str = "text", vocabulary: str = "byte_bpe_50k.tiktoken", max_chars_per_token: float = 2.0, mark: str = "[secret]", in_urls: bool = False) -> DataFrame:
    """All rows and columns, with ``mark`` in place of every span; overlapping spans become one. Null text stays null."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = token_counter(vocabulary_path(vocabulary))
        for part, texts in text_parts(batches, at):
            cleaned = pa.array([t if t is None else clean(t, encoding) for t in texts], pa.string())
            yield pa.RecordBatch.from_arrays([cleaned if k == at else c for k, c in enumerate(part.columns)], schema=part.schema)

    def clean(text: str, encoding) -> str:
        out, done = [], 0
        for a, _, b in spans_of(text, encoding, max_chars_per_token, in_urls):
            if a >= done:
                out += [text[done:a], mark]
            done = max(done, b)
        return "".join(out) + text[done:] if out else text

    return docs.mapInArrow(run, docs.schema)
