"""What five document filters do to each other in every order: texts routed by fingerprint, mask counts merged by part.

Which documents repeat a text of a smaller doc_id is found by an RDD: texts go to the partition of their xxhash, sorted by
hash and doc_id, so a collision chain holds the distinct full texts of one hash with the smallest id of each, and every
further row is told apart as it streams by. Copies met within CHUNK_CHARS of text on the reading side are told apart
there and go on without their text, so a text of a third of all rows sends one row a chunk.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from itertools import permutations

import xxhash
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FILTERS = "ABCDE"
#: Characters of text whose copies are looked for before any is sent, and characters of all texts for each partition that texts are routed to.
CHUNK_CHARS, ROUTE_CHARS = 16_000_000, 16_000_000
#: Fixed values of the filters.
FEWEST_WORDS, DISTINCT_PERCENT, UPPER_PERCENT = 200, 50, 2
UPPER, MARKS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|"

SCHEMA = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def fingerprint(text: bytes) -> int:
    return xxhash.xxh64_intdigest(text)


def fails(text: bytes, n_chars: int) -> int:
    """The bits of A, B, C and D that a text fails."""
    words = text.split()  # of bytes: at \\x20 and \\x09-\\x0D alone
    n = len(words)
    upper, marks = (len(text) - len(text.translate(None, some)) for some in (UPPER, MARKS))
    return (n < FEWEST_WORDS) | (100 * len(set(words)) < DISTINCT_PERCENT * n) << 1 | (100 * upper > UPPER_PERCENT * n_chars) << 2 | (marks > 0) << 3


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source", hashed: Callable[[bytes], int] = fingerprint, chunk: int = CHUNK_CHARS) -> RDD:
    """(key, part, mask, rows): the filters that the rows of one key, part and text fail, E among them where a row of a smaller key has the same text.

    A null text is an empty one, a null part an empty string. Rows of a null key repeat nothing and are repeated by nothing;
    rows of one key and text do not repeat each other.
    """
    # As many partitions as the characters ask for: files say little of the size of the texts in them.
    routes = -(-(docs.agg(F.sum(F.length(text).cast("long"))).first()[0] or 1) // ROUTE_CHARS)
    rows = docs.select(F.col(key).cast("long"), F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(part).cast("string"), F.lit(""))).rdd
    routed = rows.mapPartitions(lambda it: _sent(it, hashed, chunk))
    return routed.repartitionAndSortWithinPartitions(routes, lambda k: k[0], keyfunc=lambda k: k[:2]).mapPartitions(_chained)


def _sent(rows: Iterable, hashed: Callable[[bytes], int], chunk: int) -> Iterator:
    """((hash, id), (text or None, id, {part: rows}, mask)): one with its text for every text of a chunk, of its smallest id; the ids above it without, since they fail E."""
    held: dict[bytes, list] = {}
    nameless: Counter = Counter()
    size = 0
    for id_, text, part in rows:
        raw = text.encode("utf-8", "surrogatepass")
        if id_ is None:
            nameless[part, fails(raw, len(text))] += 1
            continue
        if raw not in held:
            size += len(text) + 200
            held[raw] = [fails(raw, len(text)), id_, {part: 1}]
        else:
            mask, least, parts = entry = held[raw]
            if id_ == least:
                parts[part] = parts.get(part, 0) + 1
            else:
                above = (id_, {part: 1}) if id_ > least else (least, parts)
                yield (hashed(repr(above[0]).encode()), 0), (None, *above, mask | 16)
                if id_ < least:
                    entry[1:] = [id_, {part: 1}]
        if size >= chunk:
            yield from _heads(held, hashed)
            held, size = {}, 0
    yield from _heads(held, hashed)
    for (part, mask), n in nameless.items():
        yield (hashed(part.encode()), 0), (None, None, {part: n}, mask)


def _heads(held: dict[bytes, list], hashed: Callable[[bytes], int]) -> Iterator:
    for raw, (mask, id_, parts) in held.items():
        yield (hashed(raw), id_), (raw, id_, parts, mask)


def _chained(rows: Iterable) -> Iterator:
    """Rows sorted by hash and id: the chain of the hash at hand has each of its full texts with the smallest id, the first to come."""
    at, chain = None, {}
    for (mark, _), (raw, id_, parts, mask) in rows:
        if raw is not None:
            if mark != at:
                at, chain = mark, {}
            mask |= 16 * (chain.setdefault(raw, id_) < id_)
        for part, n in parts.items():
            yield id_, part, mask, n


def audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source", hashed: Callable[[bytes], int] = fingerprint, chunk: int = CHUNK_CHARS) -> DataFrame:
    """One row per part, order of the filters and step: what the step keeps, removes and loses, and its filter's Shapley sum.

    Every row of docs counts, repeated ones too. A document is good if any of its labels has quality 1, toxic if any has
    toxic 1. A table without rows gives none. Columns beside those named are not read.
    """
    spark = docs.sparkSession
    rows = spark.createDataFrame(repeats(docs, key, text, part, hashed, chunk), "id long, part string, mask int, n long")
    known = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("id"))
    known = known.agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    seen = rows.join(known, "id", "left").select("part", F.col("mask") + 32 * F.coalesce("good", F.lit(0)) + 64 * F.coalesce("toxic", F.lit(0)), "n").rdd
    counts = seen.map(lambda r: (r[0], (r[1], r[2]))).combineByKey(_count, _counted, _together)
    return spark.createDataFrame(counts.flatMap(lambda c: [(c[0], *r) for r in orders(c[1])]), SCHEMA)


def _count(seen: tuple[int, int]) -> list[int]:
    return _counted([0] * 128, seen)


def _counted(vector: list[int], seen: tuple[int, int]) -> list[int]:
    vector[seen[0]] += seen[1]
    return vector


def _together(left: list[int], right: list[int]) -> list[int]:
    return [a + b for a, b in zip(left, right, strict=True)]


def orders(vector: list[int]) -> Iterator[tuple]:
    """(filter_order, step, ...) from the documents of every mask: five bits of filters failed, a bit good, a bit toxic."""
    of = lambda bits: [sum(n for m, n in enumerate(vector) if m & bits == bits and m % 32 == mask) for mask in range(32)]
    every, good, toxic = of(0), of(32), of(64)
    # left[kind][applied]: the documents that fail none of the filters applied.
    left = [[sum(n for m, n in enumerate(counts) if not m & applied) for applied in range(32)] for counts in (every, good, toxic)]
    failing = [sum(n for m, n in enumerate(every) if m >> f & 1) for f in range(5)]
    walks, shapley = [], [0] * 5
    for order in permutations(range(5)):
        applied = 0
        for step, f in enumerate(order, 1):
            after = applied | 1 << f
            removed, good_lost, toxic_lost = (kind[applied] - kind[after] for kind in left)
            shapley[f] += removed
            walks.append((order, step, f, left[0][after], removed, failing[f] - removed, every[1 << f], good_lost, toxic_lost))
            applied = after
    for order, step, f, *rest in walks:
        yield ("".join(FILTERS[i] for i in order), step, *rest, shapley[f])
