"""Filter interaction audit: what each filter removes in every order of application, by part of the corpus.

Texts are routed as an RDD by their xxhash. A partition keeps a chain of unequal texts for each hash, every one whole
and with the smallest identifier seen; a row whose identifier is not the smallest of its text is emitted as a copy.
Each task builds such chains of its own before the shuffle, so a text travels once a task however many copies it has, and copies
found there travel without it, dealt out by identifier. Chains after the shuffle come sorted by hash (Spark's external
sort), so one hash's texts are in memory at a time.

Every row then has a mask of the conditions it fails. Masks are counted by part in vectors (rows, good, toxic for each of the
2**n masks) that combineByKey merges; all orders are read off a part's vector.

Null text counts as empty, a null part as the empty string. Null identifiers come after all others; rows of equal
identifier and text are no copies of each other. An identifier labelled more than once is good, or toxic, if one of its labels says so;
labels without an identifier are left out. An empty table gives an empty one. Further columns are not looked at, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping
from itertools import groupby, permutations
from operator import itemgetter

import numpy as np
from pyspark import RDD
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindrift.llm.common import text_or_empty

#: Bytes of texts that a task's own chains hold before they are sent on.
CHAIN_BYTES = 16 << 20

#: Bytes of texts in a partition after the shuffle, about.
PARTITION_BYTES = 256 << 20

Rule = Callable[[bytes, list[bytes]], bool]


def few_words(raw: bytes, words: list[bytes]) -> bool:
    return len(words) < 200


def few_distinct(raw: bytes, words: list[bytes]) -> bool:
    return 100 * len(set(words)) < 50 * len(words)


def many_capitals(raw: bytes, words: list[bytes]) -> bool:
    code_points = len(raw) - len(raw.translate(None, LEADING))
    return 100 * (len(raw) - len(raw.translate(None, CAPITALS))) > 3 * code_points


def has_symbols(raw: bytes, words: list[bytes]) -> bool:
    return SYMBOL.search(raw) is not None


CAPITALS = bytes(range(65, 91))
#: Bytes that begin a code point in UTF-8.
LEADING = bytes(b for b in range(256) if b >> 6 != 2)
SYMBOL = re.compile(rb"[#$%&*|]")

#: Conditions on a text by the letter of their filter.
RULES: Mapping[str, Rule] = {"A": few_words, "B": few_distinct, "C": many_capitals, "D": has_symbols}


def after(key: object) -> tuple:
    """Sorting key of identifiers, null last."""
    return (key is None, 0 if key is None else key)


#: A record of the shuffle: its text (None: known to be a copy), its identifier, and part and mask of the rows with both.
Record = tuple[bytes | None, object, list[tuple[str, int]]]


def chained(chain: list[list], record: Record) -> Record | None:
    """Put a text's record into the chain of its hash; the record that turns out not to have the smallest identifier comes back."""
    raw, key, rows = record
    for link in chain:
        if link[0] == raw:
            if key == link[1]:
                link[2] = link[2] + rows
                return None
            if after(key) > after(link[1]):
                return None, key, rows
            larger = (None, link[1], link[2])
            link[1:] = key, rows
            return larger
    chain.append([raw, key, rows])
    return None


def routed(rules: Mapping[str, Rule], limit: int) -> Callable[[Iterator[Row]], Iterator[tuple[int, Record]]]:
    """Of rows (key, part, text): the task's distinct texts by xxhash, and its copies by the xxhash of their identifier."""

    def run(rows: Iterator[Row]) -> Iterator[tuple[int, Record]]:
        import xxhash

        def apart(record: Record) -> tuple[int, Record]:
            return xxhash.xxh64_intdigest(repr(record[1])), record

        chains: dict[int, list[list]] = {}
        held = 0
        for key, part, text in rows:
            raw = text.encode()
            words = raw.split()  # ASCII white space only
            mask = sum(1 << k for k, fails in enumerate(rules.values()) if fails(raw, words))
            chain = chains.setdefault(xxhash.xxh64_intdigest(raw), [])
            known = len(chain)
            copy = chained(chain, (raw, key, [(part, mask)]))
            if copy is not None:
                yield apart(copy)
            held += len(raw) + 200 if len(chain) > known else 100
            if held > limit:
                yield from ((route, tuple(link)) for route, links in chains.items() for link in links)
                chains, held = {}, 0
        yield from ((route, tuple(link)) for route, links in chains.items() for link in links)

    return run


def judged(bit: int) -> Callable[[Iterator[tuple[int, Record]]], Iterator[tuple]]:
    """Rows (key, part, mask) of records sorted by hash; copies have ``bit`` set."""

    def run(records: Iterator[tuple[int, Record]]) -> Iterator[tuple]:
        for _, same in groupby(records, key=itemgetter(0)):
            chain: list[list] = []
            for _, record in same:
                copy = record if record[0] is None else chained(chain, record)
                if copy is not None:
                    yield from ((copy[1], part, mask | bit) for part, mask in copy[2])
            yield from ((key, part, mask) for _, key, rows in chain for part, mask in rows)

    return run


def masks(docs: DataFrame, rules: Mapping[str, Rule] = RULES, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", chain_bytes: int = CHAIN_BYTES) -> DataFrame:
    """Return key, part and mask per row: bit k for the k-th rule, and the bit after the rules' for a text that a smaller identifier has."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("key"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text_or_empty(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // PARTITION_BYTES)
    sent: RDD = rows.rdd.mapPartitions(routed(rules, chain_bytes)).repartitionAndSortWithinPartitions(n, lambda route: route)
    schema = T.StructType([T.StructField("key", rows.schema["key"].dataType), T.StructField("part", T.StringType()), T.StructField("mask", T.IntegerType())])
    return spark.createDataFrame(sent.mapPartitions(judged(1 << len(rules))), schema, verifySchema=False)


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` of the rows whose text a smaller identifier has, a row each."""
    found = masks(docs, {}, id_col, text_col, id_col)
    return found.where("mask = 1").select(F.col("key").alias(id_col))


def orders(part: str, counts: np.ndarray, letters: str) -> Iterator[tuple]:
    """Rows of all orders of the filters: part, order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    number = np.arange(len(counts))
    bits = {letter: 1 << k for k, letter in enumerate(letters)}
    found = []
    shares = dict.fromkeys(letters, 0)
    for order in permutations(letters):
        gone = np.zeros(len(counts), dtype=bool)
        for step, letter in enumerate(order, 1):
            fails = (number & bits[letter]) > 0
            here = fails & ~gone
            removed, good, toxic = (int(x) for x in counts[here].sum(axis=0))
            redundant = int(counts[fails & gone, 0].sum())
            gone |= fails
            shares[letter] += removed
            found.append((letter, ("".join(order), step, int(counts[~gone, 0].sum()), removed, redundant, int(counts[bits[letter], 0]), good, toxic)))
    for letter, values in found:
        yield (part, *values, shares[letter])


AUDIT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def audit(docs: DataFrame, labels: DataFrame, rules: Mapping[str, Rule] = RULES, copy_letter: str = "E", id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """Return a row per part, order of the filters and step (``AUDIT``); ``labels`` has ``id_col``, quality and toxic.

    ``rules`` are the filters on a single text, ``copy_letter`` names that of copies.
    """
    letters = "".join(rules) + copy_letter
    found = masks(docs, rules, id_col, text_col, part_col).groupBy("key", "part", "mask").agg(F.count("*").alias("n"))
    key_type = found.schema["key"].dataType
    marks = labels.select(F.col(id_col).cast(key_type).alias("key"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic")).where("key is not null")
    marks = marks.groupBy("key").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    said = lambda c: F.coalesce(c, F.lit(False))
    joined = found.join(marks, "key", "left").select("part", "mask", "n", said("good").alias("good"), said("toxic").alias("toxic"))

    def counted(vector: np.ndarray, row: Row) -> np.ndarray:
        vector[row.mask] += (row.n, row.n * row.good, row.n * row.toxic)
        return vector

    size = 1 << len(letters)
    vectors = joined.rdd.map(lambda row: (row.part, row)).combineByKey(lambda row: counted(np.zeros((size, 3), dtype=np.int64), row), counted, lambda a, b: a + b)
    return docs.sparkSession.createDataFrame(vectors.flatMap(lambda x: orders(x[0], x[1], letters)), AUDIT, verifySchema=False)
