"""Quality rules on documents and on the hosts they come from.

Each document gets counts and the rules it fails. Failures are summed by host; a host's failure rate is shrunk towards
the rate of all hosts by a beta prior fitted to them by moments, and a host whose shrunk rate passes ``host_limit``
is rejected with all its documents. The verdicts are joined back to the documents.

Null and empty text has no words and fails; a null host is a host of its own. Repeated rows and ids are judged each. An empty
table gives an empty one; ``passing`` carries further columns along, whatever their names, and ``judge`` does not look at them.
The text is read once: what later steps use is a table of counts in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindrift.llm.common import byte_parts, fresh, shared_dir, text_or_empty, without, written

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that occur twice or more, the first occurrence included."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), dtype=np.int64, count=n)
    if len(seen) == n:
        return 0
    pair = ids[:-1] * len(seen) + ids[1:]
    if len(seen) > 2_000_000:  # the product of three would pass 63 bits
        pair = np.unique(pair, return_inverse=True)[1]
        window = pair[:-1] * len(seen) + ids[2:]
    else:
        window = pair[:-1] * len(seen) + ids[2:]
    order = np.argsort(window, kind="stable")
    same = window[order][1:] == window[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n - 2, dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    inside = np.zeros(n, dtype=bool)
    for k in range(3):
        inside[k : n - 2 + k] |= twice
    return int(inside.sum())


def counts_of(raw: bytes) -> tuple[int, int, int, int, int]:
    words = raw.split()  # ASCII white space only
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return len(words), len(b"".join(words).decode()), len(raw) - len(raw.translate(None, b"#*$%&|<>")), len(lines) - len(set(lines)), repeated_words(words)


def signals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Return key, host and the counts per document."""
    rows = docs.select(F.col(id_col).alias("key"), F.col(host_col).cast("string").alias("host"), text_or_empty(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in byte_parts(batches, "text"):
            counts = np.array([counts_of(raw) for raw in texts], dtype=np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("host"), *(pa.array(counts[:, k]) for k in range(len(COUNTS)))], ["key", "host", *COUNTS])

    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, host string, " + ", ".join(f"{c} long" for c in COUNTS))


def base_failed(prefix: str = "", min_words: int = 50, max_repeat_percent: int = 50) -> Column:
    """The rules that reject a document by itself."""
    n, repeats = F.col(f"{prefix}n_words"), F.col(f"{prefix}n_repeat_words")
    return (n < min_words) | (100 * repeats > max_repeat_percent * n)


def ruled(counts: DataFrame, max_symbol_percent: int = 10, max_word_chars: int = 20, **limits: int) -> DataFrame:
    """Add base_failed and failing, whether a document fails any rule that counts against its host."""
    base = base_failed(**limits)
    symbols = 100 * F.col("n_symbols") > max_symbol_percent * F.col("word_chars")
    long_words = F.col("word_chars") > max_word_chars * F.col("n_words")
    return counts.withColumns({"base_failed": base, "failing": base | symbols | long_words})


def host_verdicts(rows: DataFrame, host_limit: float = 0.9) -> DataFrame:
    """Return host, n_docs, n_failing, rate (shrunk) and host_rejected.

    The prior of failure rates p: mean m and variance v over hosts, v without the share that counting alone makes;
    a + b = m (1 - m) / v - 1, at least 2. With one host, or hosts all alike, the prior is worth ten documents.
    """
    hosts = rows.groupBy("host").agg(F.count("*").alias("n_docs"), F.sum(F.col("failing").cast("long")).alias("n_failing"))
    rate = F.col("n_failing") / F.col("n_docs")
    moments = hosts.agg(
        (F.sum("n_failing") / F.sum("n_docs")).alias("m"), F.var_samp(rate).alias("v"), F.avg(1 / F.col("n_docs")).alias("per_doc"),
    )
    spread = F.col("m") * (1 - F.col("m"))
    between = F.col("v") - spread * F.col("per_doc")
    weight = F.when(between > 0, F.greatest(F.lit(2.0), spread / between - 1)).otherwise(F.lit(10.0))
    mean, weight = moments.select(F.coalesce("m", F.lit(0.0)), F.coalesce(weight, F.lit(10.0))).first()  # two numbers
    shrunk = hosts.withColumn("rate", (F.col("n_failing") + mean * weight) / (F.col("n_docs") + weight))
    return shrunk.select("host", "n_docs", "n_failing", "rate", (F.col("rate") > host_limit).alias("host_rejected"))


def passing(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", host_limit: float = 0.9, **limits: int) -> DataFrame:
    """The documents that stay, with all their columns.

    Texts are counted once: rows and counts go into a table of the shared folder, without the texts of documents that fail by themselves.
    """
    spark, names, at = docs.sparkSession, docs.columns, docs.columns.index(text_col)
    counts = fresh(docs, *COUNTS)
    own = {k: v for k, v in limits.items() if k in ("min_words", "max_repeat_percent")}
    least, most = own.get("min_words", 50), own.get("max_repeat_percent", 50)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in byte_parts(batches, at):
            found = np.array([counts_of(raw) for raw in texts], dtype=np.int64).reshape(-1, len(COUNTS))
            failed = (found[:, 0] < least) | (100 * found[:, 4] > most * found[:, 0])
            text = part.column(at).take(pa.array(np.arange(len(failed)), mask=failed))
            columns = [text if k == at else c for k, c in enumerate(part.columns)]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(found[:, k]) for k in range(len(COUNTS)))], [*part.schema.names, *counts])

    schema = T.StructType([*docs.schema.fields, *(T.StructField(c, T.LongType()) for c in counts)])
    rows = written(docs.mapInArrow(counted, schema), f"{shared_dir(spark)}/counted")
    signs = rows.select(F.col(host_col).cast("string").alias("host"), *(F.col(c).alias(name) for c, name in zip(counts, COUNTS, strict=True)))
    rejected = host_verdicts(ruled(signs, **limits), host_limit).where("host_rejected").select("host")
    failed = (F.col(counts[0]) < least) | (100 * F.col(counts[4]) > most * F.col(counts[0]))
    return without(rows.where(~failed).select(*names), [F.col(host_col).cast("string")], written(rejected, f"{shared_dir(spark)}/rejected"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", host_limit: float = 0.9, **limits: int) -> DataFrame:
    """Return ``id_col``, the counts, base_failed, failing, host_rate, host_rejected and kept per document."""
    counts = written(signals(docs, id_col, text_col, host_col), f"{shared_dir(docs.sparkSession)}/signals")
    rows = ruled(counts, **limits)
    hosts = host_verdicts(rows, host_limit).select(F.col("host").alias("of"), F.col("rate").alias("host_rate"), "host_rejected")
    joined = rows.join(hosts, F.col("host").eqNullSafe(F.col("of")), "left")
    return joined.select(F.col("key").alias(id_col), *COUNTS, "base_failed", "failing", "host_rate", "host_rejected", (~F.col("base_failed") & ~F.col("host_rejected")).alias("kept"))
