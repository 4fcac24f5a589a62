"""Approximate nearest neighbours by inner product, from balanced posting lists.

A bounded sample is split in two again and again, the largest part first, until its parts are small and even; their means
are the centroids of the posting lists. Every vector goes to its nearest centroid and, near a border, to every further
centroid that is almost as near. A query finds centroids in a graph of neighbouring centroids held in memory, best first,
and reads the lists whose distance is at most a ratio times the nearest one's. The ratio is the smallest that reaches the
recall asked for: a fixed number of trial queries is compared with every row, in blocks, and the lists of what is truly
nearest tell which ratio finds it. If none does, that is an error.

Inner products become distances by one more coordinate, which brings every vector to the largest norm; a query has 0 there.
Lists are laid out in shards of even size, long lists over several of them.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from panelspark.llm.common import discard, materialize
from panelspark.llm.embed_dedup import unit_rows

#: Rows that the centroids are learned from at most, and most rows of it that make a list.
SAMPLE, SAMPLE_LIST = 8192, 48
#: A vector goes to at most so many lists, those within this ratio of the nearest distance.
COPIES, BORDER_RATIO = 3, 1.08
#: Neighbours of a centroid in the graph; rows of a shard and of a list's part, about.
DEGREE, SHARD_ROWS, PART_ROWS = 24, 8000, 4000
#: Queries that read a shard in one task, about.
SHARD_QUERIES = 2000
#: Rows compared with each other at once.
BLOCK = 1024
#: Ratios tried for the search, and queries of the sample that they are tried on.
RATIOS, TRIALS = (1.02, 1.04, 1.06, 1.08, 1.1, 1.12, 1.14, 1.16, 1.18, 1.2, 1.25, 1.3, 1.4, 1.6, 2.0, 3.0, 10.0), 128


@dataclass
class Lists:
    """What the driver broadcasts: centroids, their graph, the common norm and the ratio that prunes lists."""

    centroids: np.ndarray
    graph: np.ndarray
    norm: float
    ratio: float = 1.0
    #: A query's usual distance to its nearest centroid: one that lies much nearer, within a group of copies, still looks around as far as the others do.
    usual: float = 0.0

    def lifted(self, rows: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(0.0, self.norm**2 - np.einsum("ij,ij->i", rows, rows)))
        return np.c_[rows, rest]

    def distances(self, lifted: np.ndarray) -> np.ndarray:
        squares = (lifted**2).sum(1)[:, None] - 2 * lifted @ self.centroids.T + (self.centroids**2).sum(1)
        return np.sqrt(np.maximum(squares, 0))

    def homes(self, rows: np.ndarray) -> list[np.ndarray]:
        """Lists of each vector, nearest first."""
        d = self.distances(self.lifted(rows))
        order = np.argsort(d, 1)[:, :COPIES]
        near = np.take_along_axis(d, order, 1)
        return [o[x <= x[0] * BORDER_RATIO + 1e-12] for o, x in zip(order, near, strict=True)]

    def probe(self, query: np.ndarray, ratio: float | None = None) -> list[int]:
        """Lists for a query: best-first over the graph, as long as centroids are within the ratio of the nearest one."""
        ratio = self.ratio if ratio is None else ratio
        q = np.r_[query, 0.0]
        start = np.array([0])
        seen = np.zeros(len(self.centroids), bool)
        seen[start] = True
        heap = [(float(np.linalg.norm(self.centroids[0] - q)), 0)]
        best, found = np.inf, []
        while heap:
            d, c = heapq.heappop(heap)
            # Greedy descent goes on below the best so far; beyond it, up to the ratio.
            if d > max(best, self.usual) * max(ratio, 1.05) and len(found) >= DEGREE:
                break
            best = min(best, d)
            found.append((d, c))
            near = self.graph[c]
            near = near[~seen[near]]
            if len(near):
                seen[near] = True
                for dist, other in zip(np.sqrt(((self.centroids[near] - q) ** 2).sum(1)).tolist(), near.tolist(), strict=True):
                    heapq.heappush(heap, (dist, other))
        return [c for d, c in found if d <= max(best, self.usual) * ratio + 1e-12]


def _split(rows: np.ndarray, most: int) -> list[np.ndarray]:
    """Places of rows in even parts of at most `most`: halves by the direction of the most variance, largest part first."""
    heap, parts = [(-len(rows), 0, np.arange(len(rows)))], []
    made = 0
    while heap:
        size, _, at = heapq.heappop(heap)
        spread = rows[at] - rows[at].mean(0)
        if -size <= most or not (np.abs(spread) > 1e-12).any():
            parts.append(at)
            continue
        axis = np.linalg.svd(spread, full_matrices=False)[2][0] if len(at) <= 512 else np.linalg.eigh(spread.T @ spread)[1][:, -1]
        order = np.argsort(spread @ axis, kind="stable")
        half = len(at) // 2
        for piece in (at[order[:half]], at[order[half:]]):
            made += 1
            heapq.heappush(heap, (-len(piece), made, piece))
    return parts


def learn_lists(sample: np.ndarray, norm: float) -> Lists:
    """Centroids and their graph from the sample."""
    lists = Lists(np.zeros((1, sample.shape[1] + 1)), np.zeros((1, 0), np.int64), norm)
    lifted = lists.lifted(sample)
    centroids = np.array([lifted[p].mean(0) for p in _split(lifted, SAMPLE_LIST)])
    for _ in range(3):  # even parts, rounded off to their neighbourhoods
        lists.centroids = centroids
        home = np.concatenate([lists.distances(lifted[lo : lo + BLOCK]).argmin(1) for lo in range(0, len(lifted), BLOCK)])
        for c in np.unique(home):
            centroids[c] = lifted[home == c].mean(0)
    near = []
    for lo in range(0, len(centroids), BLOCK):
        apart = lists.distances(centroids[lo : lo + BLOCK])
        apart[np.arange(len(apart)), lo + np.arange(len(apart))] = -1
        near.append(np.argsort(apart, 1, kind="stable")[:, 1 : DEGREE + 1])
    ring = np.stack([(np.arange(len(centroids)) + 1) % len(centroids), (np.arange(len(centroids)) - 1) % len(centroids)], 1)
    lists = Lists(centroids, np.concatenate([np.concatenate(near), ring], 1), norm)
    queries = sample[:: max(1, len(sample) // TRIALS)][:TRIALS]
    lists.usual = float(np.median(lists.distances(np.c_[queries, np.zeros(len(queries))]).min(1)))
    return lists


def _truly_nearest(ids: np.ndarray, queries: np.ndarray, k: int, width: int):
    """(vec_id, vector) -> (query, vec_id, score, vector): for each trial query the k nearest of a partition, its own row aside."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.zeros(0), np.zeros(0, np.int64), np.zeros((0, width))) for _ in ids]
        for batch in batches:
            at, rows = unit_rows(batch.column(1), width)
            names = batch.column(0).to_numpy()[at]
            for lo in range(0, len(at), BLOCK):
                scores = queries @ rows[lo : lo + BLOCK].T
                for q, row in enumerate(scores):
                    row[names[lo : lo + BLOCK] == ids[q]] = -np.inf
                    top = np.argpartition(-row, min(k, len(row)) - 1)[:k]
                    top = top[np.isfinite(row[top])]
                    score, name, vector = (np.concatenate([a, b]) for a, b in zip(best[q], (row[top], names[lo + top], rows[lo + top]), strict=True))
                    order = np.lexsort((name, -score))[:k]
                    best[q] = score[order], name[order], vector[order]
        n = [len(b[0]) for b in best]
        if sum(n):
            vectors = np.concatenate([b[2] for b in best])
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(n)), n)), pa.array(np.concatenate([b[1] for b in best])), pa.array(np.concatenate([b[0] for b in best])), pa.array(list(vectors), pa.list_(pa.float64()))], names=["query", "vec_id", "score", "vector"])

    return run


def ratio_for(lists: Lists, queries: np.ndarray, true: list[np.ndarray], recall: float) -> float:
    """The smallest ratio at which the lists read hold so large a share of what is truly nearest to the queries."""
    homes = [lists.homes(t) if len(t) else [] for t in true]
    wanted = sum(map(len, true))
    for ratio in RATIOS:
        hit = 0
        for q, home in zip(queries, homes, strict=True):
            read = np.zeros(len(lists.centroids), bool)
            read[lists.probe(q, ratio)] = True
            hit += sum(bool(read[h].any()) for h in home)
        if hit >= recall * wanted:
            return ratio
    raise ValueError(f"no ratio reaches a recall of {recall}")


def _search(k: int, width: int):
    """Lists and queries of a shard -> the k nearest of each query within it."""

    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        empty = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not rows.num_rows or not queries.num_rows:
            return empty
        rows = rows.sort_by([("list", "ascending"), ("vec_id", "ascending")])
        ids, of = rows.column("vec_id").to_numpy(), rows.column("list").to_numpy()
        vectors = unit_rows(rows.column("vector"))[1]
        query_ids = queries.column("query_id").to_numpy()
        asked = unit_rows(queries.column("vector"))[1]
        wants: dict[int, list[int]] = {}
        for q, lists in enumerate(queries.column("lists").to_pylist()):
            for c in lists:
                wants.setdefault(c, []).append(q)
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros(0, np.int64))] * len(asked)
        for c, q in wants.items():
            lo, hi = np.searchsorted(of, [c, c + 1])
            if lo == hi:
                continue
            for q_lo in range(0, len(q), 512):
                some = q[q_lo : q_lo + 512]
                rough = asked[some] @ vectors[lo:hi].T
                for row, one in zip(rough, some, strict=True):
                    held, at = best[one]
                    floor = held[-1] if len(held) >= k else -np.inf
                    if hi - lo > k + 1:
                        floor = max(floor, np.partition(row, -k - 1)[-k - 1])
                    new = np.flatnonzero(row >= floor - 1e-9 * (1 + abs(floor)) if np.isfinite(floor) else row > -np.inf) + lo
                    new = new[ids[new] != query_ids[one]]
                    score = np.r_[held, np.einsum("ij,j->i", vectors[new], asked[one])]
                    where = np.r_[at, new]
                    order = np.lexsort((ids[where], -score))
                    _, first = np.unique(ids[where][order], return_index=True)
                    order = order[np.sort(first)][:k]
                    best[one] = score[order], where[order]
        n = [len(s) for s, _ in best]
        return pa.table({"query_id": np.repeat(query_ids, n), "vec_id": ids[np.concatenate([w for _, w in best])], "score": np.concatenate([s for s, _ in best])})

    return run


def nearest(df: DataFrame, k: int = 20, every: int = 20, key: str = "vec_id", vector: str = "embedding", recall: float = 0.95, sample_rows: int = SAMPLE) -> DataFrame:
    """The k rows of largest inner product found for every query, a row whose key is divisible by `every`: query_id, rank, vec_id, score.

    All rows but the query's own are candidates; ties go to the smaller key. Vectors that are null, empty, zero or hold
    null or non-finite components, rows of null key, and vectors of another length than most of the sample take no part.
    Repeated rows of one key count once. Fewer candidates than k are all returned if their lists are read. The index is
    learned from at most `sample_rows` rows, taken in the order of a hash of their key; every row is indexed. TRIALS of these
    rows are compared with all rows, so that `recall` is that of the whole table as far as they tell.
    Other columns play no part. An empty table gives an empty result.
    """
    spark = df.sparkSession
    kind = df.schema[vector].dataType.simpleString()
    rows = df.where(f"`{key}` is not null and `{vector}` is not null").select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("vector"))
    picked = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).select("vector", "vec_id").toArrow()
    at, sample = unit_rows(picked.column(0))
    out = "query_id long, vec_id long, score double"
    if not len(sample):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width = sample.shape[1]
    norms = rows.select("vector").mapInArrow(_largest_norm(width), "norm double").agg(F.max("norm")).first()[0]
    lists = learn_lists(sample, float(norms))
    step = max(1, len(sample) // TRIALS)
    trials, trial_ids = sample[::step][:TRIALS], picked.column(1).to_numpy()[at][::step][:TRIALS]
    found = rows.select("vec_id", "vector").mapInArrow(_truly_nearest(trial_ids, trials, k, width), "query long, vec_id long, score double, vector array<double>")
    best = found.withColumn("r", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "vec_id"))).where(f"r <= {k}").select("query", "vector").toArrow()
    of = best.column(0).to_numpy()
    nearest_rows = np.array(best.column(1).to_pylist(), float).reshape(len(of), -1)
    lists.ratio = ratio_for(lists, trials, [nearest_rows[of == q] for q in range(len(trials))], recall)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, vectors = unit_rows(batch.column(1), width)
            for lo in range(0, len(at), 4096):
                homes = lists.homes(vectors[lo : lo + 4096])
                take = np.repeat(at[lo : lo + 4096], [len(h) for h in homes])
                if len(take):
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(homes).astype(np.int32)), *batch.take(pa.array(take)).columns], names=["list", "vec_id", "vector"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, vectors = unit_rows(batch.column(1), width)
            probes = [lists.probe(v) for v in vectors]
            yield pa.RecordBatch.from_arrays([*batch.take(pa.array(at)).columns, pa.array(probes, pa.list_(pa.int32()))], names=["query_id", "vector", "lists"])

    postings = materialize(rows.mapInArrow(assign, f"list int, vec_id long, vector {kind}"), "ann-lists")
    sizes = {r["list"]: r["count"] for r in postings.groupBy("list").count().collect()}  # one row a centroid at most
    parts = {c: -(-n // PART_ROWS) for c, n in sizes.items()}
    shards = max(1, -(-sum(sizes.values()) // SHARD_ROWS))
    loads = [(0, s) for s in range(shards)]
    layout: list[tuple[int, int, int]] = []
    for c in sorted(sizes, key=lambda c: (-sizes[c] / parts[c], c)):
        for part in range(parts[c]):
            load, shard = heapq.heappop(loads)
            layout.append((c, part, shard))
            heapq.heappush(loads, (load + sizes[c] // parts[c], shard))
    plan = spark.createDataFrame(layout, "list int, part int, shard int")
    reached = spark.createDataFrame(sorted({(c, shard) for c, _, shard in layout}), "list int, read int")
    wide = spark.createDataFrame(list(parts.items()), "list int, parts int")
    indexed = postings.join(wide, "list").withColumn("part", F.pmod(F.xxhash64("vec_id"), "parts").cast("int")).join(plan, ["list", "part"]).select("shard", "list", "vec_id", "vector")
    queries = rows.where(f"vec_id % {every} = 0").dropDuplicates(["vec_id"]).mapInArrow(ask, f"query_id long, vector {kind}, lists array<int>")
    queries = materialize(queries, "ann-queries")
    reads = materialize(queries.select("query_id", F.explode("lists").alias("list")).join(reached, "list").groupBy("query_id", "read").agg(F.collect_set("list").alias("lists")), "ann-reads")
    # A shard that many queries reach is read by several tasks, each with a share of them.
    shares = reads.groupBy("read").agg(F.ceil(F.count("*") / F.lit(SHARD_QUERIES)).cast("int").alias("shares"))
    share = F.pmod(F.xxhash64("query_id"), "shares").cast("int").alias("share")
    asked = reads.join(shares, "read").select("read", share, "query_id", "lists").join(queries.select("query_id", "vector"), "query_id").select("read", F.col("share").alias("asked_share"), "query_id", "vector", "lists")
    dealt = indexed.join(shares, F.col("shard") == F.col("read")).withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).select("shard", "share", "list", "vec_id", "vector")
    found = dealt.groupBy("shard", "share").cogroup(asked.groupBy("read", "asked_share")).applyInArrow(_search(k, width), out)
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(order)).where(f"rank <= {k}")
    result = materialize(ranked.select("query_id", "rank", "vec_id", "score"), "ann-out")
    for x in (postings, queries, reads):
        discard(x)
    return result


def _largest_norm(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = 0.0
        for batch in batches:
            rows = unit_rows(batch.column(0), width)[1]
            if len(rows):
                most = max(most, float(np.sqrt((rows * rows).sum(1)).max()))
        yield pa.RecordBatch.from_arrays([pa.array([most])], names=["norm"])

    return run
