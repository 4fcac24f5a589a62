"""What the operators share: the scratch folder, connected components and byte-level word hashing.

Text is handled as Arrow's UTF-8 buffers, so one pass over a batch costs a few array operations however many
documents it holds.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that end a word: space and \t \n \v \f \r.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, *range(9, 14)]] = True
#: A-Z to a-z, all else as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of text that are hashed at once; a longer document is hashed alone.
CHUNK_BYTES = 4_000_000
WORDS_PER_SHINGLE = 5

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 2**64)
_MIX = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB], np.uint64)
_PLACES = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a session of a single process, as in tests, gets one of its own where it is unset; a cluster must name one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = known.get() if known.isDefined() else None
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='panelspark-')}"  # one process, as in tests
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read again. A lost executor costs nothing that was written."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/panelspark/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._panelspark_path = path
    return out


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 2500) -> Iterator[pa.RecordBatch]:
    """The batches in slices of so many rows, so that what a worker makes of one at a time is small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


_REMEMBERED: dict[str, object] = {}


def remembered(name: str, make):
    """What a worker process keeps from task to task under this name; what it kept for another operator goes, so one such memory is held at a time."""
    if name not in _REMEMBERED:
        _REMEMBERED.clear()
        _REMEMBERED[name] = make()
    return _REMEMBERED[name]


def forget() -> None:
    """Let go of what this worker process keeps for an operator that is done."""
    _REMEMBERED.clear()


def discard(df: DataFrame) -> None:
    """Delete what materialize() wrote, once nothing reads it any more."""
    path = getattr(df, "_panelspark_path", None)
    if path:
        jvm = df.sparkSession._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


def connected_components(links: DataFrame, tag: str = "cc", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of links (a, b): component is the smallest node that links reach.

    Alternates large-star and small-star steps, each one aggregation and one join, until every edge points from a
    node to the root of its component. A hub is an aggregated minimum and a join that Spark may split, never a list.
    """
    edges = materialize(_stars(links.select("a", "b"), large=False), tag)
    for _ in range(max_rounds):
        large = _stars(edges, large=True)
        small = materialize(_stars(large, large=False), tag)
        left = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        right = small.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        discard(edges)
        edges = small
        if left == right:
            break
    else:
        raise RuntimeError(f"components have not settled after {max_rounds} rounds")
    found = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return found.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over edges (a, b); the result has distinct edges with a > b."""
    ordered = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    near = ordered.unionByName(ordered.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else ordered
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
    moved = near.join(least, "u")
    if large:
        out = moved.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = moved.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


#: Matches whose lengths are summed up together, and characters of context kept of either side.
SPAN_BLOCK, CONTEXT_CHARS = 256, 24


def match_spans(text: Column, pattern: Column | str) -> Column:
    """Every match of a pattern as array<struct<start, end, span, before, after>> in code points, by DataFrame functions alone.

    Places are the summed lengths of matches and of the pieces between, block by block, so that thousands of matches do
    not copy each other. before and after are the nearest CONTEXT_CHARS of the pieces on either side.
    """
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    kind = "array<struct<start:int,end:int,span:string,before:string,after:string>>"
    found, pieces = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, pattern, -1)
    n = F.size(found)
    parts = F.zip_with(
        F.zip_with(found, F.slice(pieces, 1, n), lambda m, p: F.struct(F.length(p).alias("gap"), m.alias("span"), F.right(p, F.lit(CONTEXT_CHARS)).alias("before"))),
        F.slice(pieces, 2, n),
        lambda x, p: F.struct(x["gap"].alias("gap"), x["span"].alias("span"), x["before"].alias("before"), F.left(p, F.lit(CONTEXT_CHARS)).alias("after")),
    )

    def fold(done, x):
        start = done["at"] + x["gap"]
        end = start + F.length(x["span"])
        return F.struct(end.alias("at"), F.concat(done["spans"], F.array(F.struct(start.alias("start"), end.alias("end"), x["span"].alias("span"), x["before"].alias("before"), x["after"].alias("after")))).alias("spans"))

    def blocks(parts):
        sums = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(parts) - 1) / SPAN_BLOCK).cast("int"), F.lit(0))), lambda b: F.aggregate(F.slice(parts, b * SPAN_BLOCK + 1, F.lit(SPAN_BLOCK)), F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as {kind})").alias("spans")), fold))
        # Each block's start is the sum of the lengths of those before it.
        starts = lambda s: F.aggregate(s, F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("starts")), lambda d, x: F.struct((d["at"] + x["at"]).alias("at"), F.concat(d["starts"], F.array(d["at"])).alias("starts")))["starts"]
        moved = lambda x, o: F.transform(x["spans"], lambda m: F.struct((m["start"] + o).alias("start"), (m["end"] + o).alias("end"), m["span"].alias("span"), m["before"].alias("before"), m["after"].alias("after")))
        return F.flatten(F.flatten(F.transform(F.array(sums), lambda s: F.zip_with(s, starts(s), moved))))

    # Named once each by passing through arrays of one.
    return F.flatten(F.transform(F.array(parts), blocks))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column; null is empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.fill_null("") if column.null_count else column
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return bounds, np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)


def chunks(bounds: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about `most` bytes, at least one document each."""
    lo, n = 0, len(bounds) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def word_bounds(bounds: np.ndarray, data: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of documents lo..hi: their bytes, the words' starts and ends in these, and each document's first word."""
    part, at = data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo]
    word = ~IS_SPACE[part]
    begins = np.zeros(len(part) + 1, bool)
    begins[at] = True
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1] | begins[1:-1]
    last[:-1] &= ~word[1:] | begins[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return part, starts, ends, np.searchsorted(starts, at)


def word_counts(column: pa.Array) -> np.ndarray:
    """Words of each text."""
    bounds, data = utf8(column)
    out = np.zeros(len(bounds) - 1, np.int64)
    for lo, hi in chunks(bounds):
        out[lo:hi] = np.diff(word_bounds(bounds, data, lo, hi)[3])
    return out


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX[0]
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX[1]
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def hash_words(part: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of words, A-Z lower-cased: differences of a running polynomial, moved to a common place."""
    running = np.zeros(len(part) + 1, np.uint64)
    np.cumsum((LOWER[part].astype(np.uint64) + np.uint64(1)) * powers(_BASE, len(part)), out=running[1:])
    h = (running[ends] - running[starts]) * powers(_BASE_INVERSE, len(part) + 1)[starts]
    return mix64(h ^ ((ends - starts).astype(np.uint64) * _PLACES[0]))


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """Each text's sorted distinct 64-bit hashes of its shingles: five consecutive words, or all of fewer."""
    bounds, data = utf8(column)
    k = WORDS_PER_SHINGLE
    for lo, hi in chunks(bounds):
        part, starts, ends, first = word_bounds(bounds, data, lo, hi)
        words = hash_words(part, starts, ends)
        n = len(words) - k + 1
        rolled = np.zeros(0, np.uint64)
        if n > 0:
            rolled = words[:n] * _PLACES[0]
            for j in range(1, k):
                rolled = rolled + words[j : n + j] * _PLACES[j]
            rolled = mix64(rolled)
        for s, e in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if e - s >= k:
                yield np.unique(rolled[s : e - k + 1])
            elif e > s:
                short = (words[s:e] * _PLACES[: e - s]).sum(dtype=np.uint64) + np.uint64(e - s)
                yield mix64(np.array([short], np.uint64) ^ _MIX[0])
            else:
                yield np.zeros(0, np.uint64)
