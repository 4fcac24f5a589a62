"""Exact Jaccard self-join of documents on 5-word shingles, by token-combination prefixes.

A document is the set of 64-bit hashes of its distinct shingles. Equal sets are one class from the start. All tokens are
counted; those of more than RARE_UP_TO documents are frequent, which a bitmap of bounded size tells (a bit that stands for
two tokens changes the order, not the result). Tokens have one global order, rare ones by hash first and frequent ones by
hash last. A set that may lack at most `spare` tokens of a similar one indexes its first spare + 1 rare tokens alone. Where
it has fewer of them, its frequent tokens follow: they fall into groups by another hash, and all combinations of two of a
group are indexed. The prefix is extended until the rare tokens, and the tokens of each group but one, are spare + 1
together: two similar sets then share a rare token or two tokens of a group. The number of groups follows from the size of
a set, so combinations stay in proportion to it; a set whose partners may be of the next size class indexes those too.

Lists of rare tokens are short, and their sets are paired with what may follow the shared token as a bound. Lists of
combinations may be long: they are never collected. Each set is linked with the first of its list and size class, by an
aggregation and a join; then lists that lie within one component of the links are done. The sets of the others meet under
the first set of the list: tiles of a bounded number of sets are compared as one matrix product each, which returns a
spanning forest of the links between components, never pairs. All links are verified on the whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from panelspark.llm.common import connected_components, discard, forget, materialize, mix64, shingle_sets, sliced

#: Tokens of more documents are frequent and indexed in combinations of two.
RARE_UP_TO = 12
#: Tokens of a set for each group of frequent tokens, between this and twice as many.
GROUP_TOKENS = 8
#: Index entries of a bucket, about; more documents make more buckets, not larger ones.
BUCKET_ENTRIES, LEAST_BUCKETS = 400_000, 1024
#: Sets of a tile on either side, bytes of tokens that small groups bring to a task together, about, and tokens that a tile multiplies at once.
TILE, TASK_BYTES, COLUMNS = 1024, 16_000_000, 4096
#: Bits of the largest bitmap of documents or tokens, 16 MB; bits of a set's own bitmap at most.
SLOTS, SET_BITS = 1 << 27, 4096


def _set_id(s: np.ndarray) -> int:
    """A 64-bit name of a set of tokens; 0 for the empty set."""
    if not len(s):
        return 0
    h = mix64(np.array([mix64(s).sum(dtype=np.uint64) ^ np.uint64(len(s) * 0x9E3779B97F4A7C15 % 2**64)], np.uint64))
    return int(h.view(np.int64)[0]) or 1


def _sketch(s: np.ndarray) -> bytes:
    """A bitmap of the set, at least four bits a token up to SET_BITS; longer bitmaps fold to shorter ones."""
    size = min(SET_BITS, 1 << max(6, int(4 * len(s) - 1).bit_length()))
    at = np.unique((s >> np.uint64(7)) % np.uint64(size))
    bits = np.zeros(size // 8, np.uint8)
    np.bitwise_or.at(bits, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
    return bits.tobytes()


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, id) -> (id, set, n, bits)."""
    forget()
    for batch in sliced(batches):
        names, sizes, bits = [], [], []
        for s in shingle_sets(batch.column(0)):
            names.append(_set_id(s))
            sizes.append(len(s))
            bits.append(_sketch(s))
        yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(names, pa.int64()), pa.array(sizes, pa.int64()), pa.array(bits, pa.binary())], names=["id", "set", "n", "bits"])


def _met(buckets: int):
    """(text) -> (bucket, tokens): the tokens of this batch's different sets by bucket, three bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            met = {_set_id(s): s for s in shingle_sets(batch.column(0))}
            token = np.concatenate([*met.values(), np.zeros(0, np.uint64)])
            if len(token):
                bucket, (packed,) = _dealt(_bucket(token, buckets), [token.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3]])
                yield pa.RecordBatch.from_arrays([bucket, packed], names=["bucket", "tokens"])

    return run


def _bucket(token: np.ndarray, buckets: int) -> np.ndarray:
    return ((token >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)


def _dealt(bucket: np.ndarray, columns: list[np.ndarray]) -> tuple[pa.Array, list[pa.Array]]:
    """(bucket, packed columns): what falls into each bucket, one row a bucket."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    spans = list(zip(starts.tolist(), np.r_[starts[1:], len(bucket)].tolist(), strict=True))
    packed = []
    for x in columns:
        x = np.ascontiguousarray(x[order])
        packed.append(pa.array([x[a:b].tobytes() for a, b in spans], pa.binary()))
    return pa.array(bucket[starts]), packed


def _slot(bucket: np.ndarray, token: np.ndarray, slots: int) -> np.ndarray:
    """The bit of a token, by its bucket and lower 24 bits."""
    return mix64((bucket.astype(np.uint64) << np.uint64(32)) | (token.astype(np.uint64) & np.uint64(0xFFFFFF))) % np.uint64(slots)


def _often(slots: int):
    """A bucket's tokens -> (word, bits) of the bits of those that are frequent."""

    def run(table: pa.Table) -> pa.Table:
        three = np.frombuffer(b"".join(table.column("tokens").to_pylist()), np.uint8).reshape(-1, 3)
        token = np.zeros((len(three), 4), np.uint8)
        token[:, :3] = three
        token, counts = np.unique(token.view("<u4").ravel(), return_counts=True)
        token = token[counts > RARE_UP_TO]
        slot = np.unique(_slot(np.full(len(token), table.column("bucket")[0].as_py()), token, slots)).astype(np.int64)
        words, at = np.unique(slot >> 5, return_inverse=True)
        bits = np.zeros(len(words), np.int64)
        np.bitwise_or.at(bits, at, np.int64(1) << (slot & 31))
        return pa.table({"word": words, "bits": bits})

    return run


def _bitmap(words: DataFrame, slots: int) -> np.ndarray:
    """A bitmap from rows (word, bits): what reaches the driver is bounded by its size."""
    found = words.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(slots // 32, np.uint32)
    out[found.column(0).to_numpy()] = found.column(1).to_numpy().astype(np.uint32)
    return out


def _slots(n: int) -> int:
    return min(SLOTS, max(1 << 16, 1 << int(16 * n).bit_length()))


def _need(n: np.ndarray | int, percent: int):
    """Least intersection of a set of n tokens with any set that is similar enough: n * percent / 100, rounded up."""
    return -(-n * percent // 100)


def _groups(n: int) -> int:
    """Groups of the frequent tokens of sets of n tokens, a power of two; it at most doubles from a set to a similar one."""
    return 1 << max(0, (n // GROUP_TOKENS).bit_length() - 1)


def _combinations(often: np.ndarray, groups: int, missing: int) -> np.ndarray:
    """Names of all pairs of tokens of one group, of as many tokens in their order as hold `missing` beside the first of each group."""
    group = mix64(often ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(groups)
    _, first = np.unique(group, return_index=True)
    beside = np.ones(len(often), bool)
    beside[first] = False
    end = int(np.searchsorted(np.cumsum(beside), missing)) + 1
    often, group = often[:end], group[:end]
    order = np.argsort(group, kind="stable")
    often, group = often[order], group[order]
    made, step = [], 1
    while True:  # neighbours at each distance within a group
        same = group[step:] == group[:-step]
        if not same.any():
            break
        made.append(mix64(often[:-step][same] * np.uint64(3) + mix64(often[step:][same])))
        step += 1
    return np.concatenate(made) if made else np.zeros(0, np.uint64)


def _entries(often_bits: np.ndarray, buckets: int, percent: int):
    """(text) -> rows (bucket, kind, tokens, sets, sizes, places), packed: kind 0 rare tokens by token, kind 1 combinations by set."""
    slots = 32 * len(often_bits)
    small = int((100 / percent) ** 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rare_of, made_of, met = [], [], set()
            for s in shingle_sets(batch.column(0)):
                n, name = len(s), _set_id(s)
                if not n or name in met:
                    continue
                met.add(name)
                length = n - _need(n, percent) + 1
                look = s
                while True:  # a stretch of the set in hash order, doubled until it holds enough rare tokens
                    look = s[: min(n, max(2 * length, 64) if look is s else 2 * len(look))]
                    slot = _slot(_bucket(look, buckets), look, slots)
                    often = (often_bits[slot >> np.uint64(5)] >> (slot & np.uint64(31)).astype(np.uint32)) & np.uint32(1) > 0
                    if len(look) == n or len(look) - often.sum() >= length:
                        break
                rare, often = look[~often][:length], look[often]
                rare_of.append((rare, name, n))
                if len(rare) < length:
                    groups = _groups(n)
                    parts = [_combinations(often, groups, length - len(rare))]
                    if _groups(n * 100 // percent) > groups:  # partners of the next class have twice the groups
                        parts.append(_combinations(often, 2 * groups, length - len(rare)))
                    if n <= small:
                        parts.append(often)
                    made_of.append((np.unique(np.concatenate(parts)), name, n))
            for kind, of in ((0, rare_of), (1, made_of)):
                count = [len(x[0]) for x in of]
                if not sum(count):
                    continue
                token = np.concatenate([x[0] for x in of])
                sets, sizes = np.repeat(np.array([x[1] for x in of], np.int64), count), np.repeat(np.array([x[2] for x in of], np.int32), count)
                places = np.concatenate([np.arange(c).clip(0, 65535) for c in count]).astype(np.uint16)
                bucket = _bucket(sets.view(np.uint64) if kind else token, buckets)
                bucket, packed = _dealt(bucket, [token if kind else token.astype(np.uint32), sets, sizes, *([] if kind else [places])])
                packed += [pa.nulls(len(bucket), pa.binary())] * kind
                yield pa.RecordBatch.from_arrays([bucket, pa.array(np.full(len(bucket), kind, np.int32)), *packed], names=["bucket", "kind", "tokens", "sets", "sizes", "places"])

    return run


def _pair_up(percent: int):
    """A bucket's entries -> rows (0, a, b, 0) of pairs by rare tokens, (1, combination, set, n) of the combinations."""

    def run(table: pa.Table) -> pa.Table:
        kinds = np.array(table.column("kind").to_pylist())

        def joined(column: str, kind: int, dtype) -> np.ndarray:
            rows = table.column(column).to_pylist()
            return np.frombuffer(b"".join(rows[k] for k in np.flatnonzero(kinds == kind)), dtype)

        token, name, n, place = joined("tokens", 0, np.uint32), joined("sets", 0, np.int64), joined("sizes", 0, np.int32), joined("places", 0, np.uint16)
        order = np.lexsort((name, token))
        token, name, n, place = token[order], name[order], n[order].astype(np.int64), place[order].astype(np.int64)
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (name[1:] != name[:-1])
        token, name, n, place = token[new], name[new], n[new], place[new]
        left, right, step = [], [], 1
        while True:  # neighbours at each distance within a list; names ascend
            same = np.flatnonzero(token[step:] == token[:-step])
            if not len(same):
                break
            i, j = same, same + step
            # What two sets share from their first shared token on; lists of later shared tokens may only say less.
            fits = np.minimum(n[i] - place[i], n[j] - place[j]) * (100 + percent) >= percent * (n[i] + n[j])
            fits &= 100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])
            left.append(name[i[fits]])
            right.append(name[j[fits]])
            step += 1
        pairs = np.unique(np.stack([np.concatenate([*x, np.zeros(0, np.int64)]) for x in (left, right)], 1), axis=0)
        made, made_set, made_n = joined("tokens", 1, np.int64), joined("sets", 1, np.int64), joined("sizes", 1, np.int32)
        return pa.table(
            {
                "kind": np.r_[np.zeros(len(pairs), np.int32), np.ones(len(made), np.int32)],
                "a": np.r_[pairs[:, 0], made],
                "b": np.r_[pairs[:, 1], made_set],
                "n": np.r_[np.zeros(len(pairs), np.int64), made_n.astype(np.int64)],
            }
        )

    return run


def _fold(bits: bytes, size: int) -> np.ndarray:
    return np.bitwise_or.reduce(np.frombuffer(bits, np.uint8).reshape(-1, size), axis=0)


def _possible(percent: int):
    """(a, b, na, nb, bits_a, bits_b) -> (a, b) of the pairs whose bitmaps allow enough shared tokens: a bit that one set lacks is a token that it lacks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            good = np.zeros(batch.num_rows, bool)
            for k, (x, y) in enumerate(zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)):
                size = min(len(x), len(y))
                x, y = _fold(x, size), _fold(y, size)
                most = min(na[k] - int(np.bitwise_count(x & ~y).sum()), nb[k] - int(np.bitwise_count(y & ~x).sum()))
                good[k] = most * (100 + percent) >= percent * (na[k] + nb[k])
            yield batch.select([0, 1]).filter(pa.array(good))

    return run


def _pack(s: np.ndarray) -> bytes:
    """The upper six bytes of each token: 48 bits tell the tokens of two documents apart."""
    return np.ascontiguousarray(s.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:]).tobytes()


def _unpack(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, 2:] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _sets(wanted: np.ndarray):
    """(text, id, slot) -> (id, set, tokens) of the documents whose slot is wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            slot = batch.column(2).to_numpy()
            some = batch.take(pa.array(np.flatnonzero(wanted[slot >> 3] >> (slot & 7).astype(np.uint8) & 1)))
            names, packed = [], []
            for s in shingle_sets(some.column(0)):
                names.append(_set_id(s))
                packed.append(_pack(s))
            yield pa.RecordBatch.from_arrays([some.column(1), pa.array(names, pa.int64()), pa.array(packed, pa.binary())], names=["id", "set", "tokens"])

    return run


def _verified(percent: int):
    """(ia, ib, left, right) -> (a, b), the ids of pairs whose sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, before, s = [], None, np.zeros(0, np.uint64)
            for k in range(batch.num_rows):
                left = batch.column(2)[k].as_py()
                if left != before:
                    before, s = left, _unpack(left)
                t = _unpack(batch.column(3)[k].as_py())
                both = len(s) + len(t) - len(np.union1d(s, t))
                if 100 * both >= percent * (len(s) + len(t) - both):
                    good.append(k)
            yield batch.select([0, 1]).take(pa.array(good, pa.int64())).rename_columns(["a", "b"])

    return run


def _shared(tokens: list[np.ndarray], cut: int) -> np.ndarray:
    """How many tokens each of the first `cut` sets shares with each of the others, COLUMNS tokens multiplied at a time."""
    size = [len(s) for s in tokens]
    row = np.repeat(np.arange(len(tokens)), size)
    _, column, count = np.unique(np.concatenate(tokens), return_inverse=True, return_counts=True)
    many = count[column] > 1
    row, column = row[many], (np.cumsum(count > 1) - 1)[column[many]]
    out = np.zeros((cut, len(tokens) - cut), np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, [lo, lo + COLUMNS])
        m = np.zeros((len(tokens), COLUMNS), np.float32)
        m[row[a:b], column[a:b] - lo] = 1
        out += m[:cut] @ m[cut:].T
    return out


def _tile(percent: int):
    """Rows (home, x, y, block, id, comp, tokens) of tiles -> (a, b): for each tile a spanning forest of the links between components."""

    def run(table: pa.Table) -> pa.Table:
        home, id_, comp, block, x, y = (table.column(c).to_numpy() for c in ("home", "id", "comp", "block", "x", "y"))
        raw = table.column("tokens")
        found_a, found_b = [], []
        order = np.lexsort((id_, block, y, x, home))
        edge = np.flatnonzero(np.r_[True, (home[order][1:] != home[order][:-1]) | (x[order][1:] != x[order][:-1]) | (y[order][1:] != y[order][:-1])])
        for lo, hi in zip(edge.tolist(), [*edge[1:].tolist(), len(order)], strict=True):
            rows = order[lo:hi]
            if len(np.unique(comp[rows])) < 2:
                continue
            same = x[rows[0]] == y[rows[0]]
            tokens = [_unpack(raw[int(k)].as_py()) for k in rows]
            n = np.array([len(t) for t in tokens])
            if same:
                first = second = np.arange(len(rows))
                both = _shared(tokens + tokens, len(rows))
            else:
                cut = int((block[rows] == x[rows]).sum())
                first, second = np.arange(cut), np.arange(cut, len(rows))
                both = _shared(tokens, cut)
            linked = both * (100 + percent) >= percent * (n[first][:, None] + n[second][None])
            linked &= comp[rows][first][:, None] != comp[rows][second][None]
            top: dict[int, int] = {}

            def root(c: int, top: dict = top) -> int:
                while top.setdefault(c, c) != c:
                    top[c] = top[top[c]]
                    c = top[c]
                return c

            for i, j in zip(*np.nonzero(linked), strict=True):
                p, q = rows[first[i]], rows[second[j]]
                u, v = root(int(comp[p])), root(int(comp[q]))
                if u != v:
                    top[u] = v
                    found_a.append(int(id_[p]))
                    found_b.append(int(id_[q]))
        return pa.table({"a": pa.array(found_a, pa.int64()), "b": pa.array(found_b, pa.int64())})

    return run


def size_hint(docs: DataFrame) -> int:
    """Bytes of the input by Spark's own statistics of its files; 0 where there are none."""
    return min(int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()), 1 << 50)


def jaccard_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 75) -> DataFrame:
    """One row for each row of docs: key, n_shingles, component_id.

    Two rows link when 100 * intersection >= percent * union of their shingle sets (percent from 50 on); component_id is the
    smallest key that links reach, the row's own included. Rows without words (null, empty or white text) and rows of null
    key link with nothing; a null key has a null component. Repeated rows come back repeated. Rows of one key but different
    texts are one node through the text that stands for its class, else their own. Keys are whole numbers. Other columns,
    whatever their names, play no part.
    """
    if not 50 <= percent <= 100:
        raise ValueError("percent must be from 50 to 100")
    texts = docs.select(F.col(text).alias("text"), F.col(key).cast("long").alias("id"))
    # As many buckets as the bytes ask for: a bucket holds a bounded number of entries, however many documents there are.
    buckets = max(LEAST_BUCKETS, int(size_hint(docs) / 24) // BUCKET_ENTRIES)
    rows = materialize(texts.mapInArrow(_described, "id long, set long, n long, bits binary"), "ngram-rows")
    n_docs, n_tokens = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    token_slots = _slots(n_tokens // 64)
    often = _bitmap(texts.select("text").mapInArrow(_met(buckets), "bucket int, tokens binary").groupBy("bucket").applyInArrow(_often(token_slots), "word long, bits long"), token_slots)

    heads = materialize(rows.where("set <> 0 and id is not null").groupBy("set").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("bits").alias("bits")), "ngram-heads")
    entries = texts.where("id is not null").select("text").mapInArrow(_entries(often, buckets, percent), "bucket int, kind int, tokens binary, sets binary, sizes binary, places binary")
    made = materialize(entries.groupBy("bucket").applyInArrow(_pair_up(percent), "kind int, a long, b long, n long"), "ngram-pairs")

    def tokens_of(ids: DataFrame) -> DataFrame:
        """(id, set, tokens) of ids. A bitmap of a size that ends at SLOTS bits spares other documents the way; beyond that size it only lets more of them pass."""
        slots = _slots(n_docs)
        slot = F.pmod(F.xxhash64("id"), F.lit(slots))
        words = ids.select(slot.alias("slot")).select(F.shiftright("slot", 5).alias("word"), F.expr("shiftleft(1L, cast(slot & 31 as int))").alias("bits"))
        wanted = _bitmap(words, slots)
        return texts.where("id is not null").select("text", "id", slot.alias("slot")).mapInArrow(_sets(wanted.view(np.uint8)), "id long, set long, tokens binary")

    # Combinations of several sets; each set with the first one of its list and size class.
    listed = made.where("kind = 1").select(F.col("a").alias("list"), F.col("b").alias("set"), "n", (F.floor(F.log(100 / percent, F.col("n"))) if percent < 100 else F.col("n")).alias("class"))
    listed = listed.dropDuplicates(["list", "set"])
    firsts = listed.groupBy("list", "class").agg(F.min("set").alias("first"), F.count("*").alias("sets")).where("sets > 1")
    starred = listed.join(firsts.select("list", "class", "first"), ["list", "class"]).where("set <> first").select(F.col("first").alias("a"), F.col("set").alias("b"))
    pairs = made.where("kind = 0").select("a", "b").unionByName(starred).distinct()
    side = lambda c: heads.select(F.col("set").alias(c), F.col("n").alias(f"n{c}"), F.col("bits").alias(f"bits_{c}"), F.col("id").alias(f"i{c}"))
    known = pairs.join(side("a"), "a").join(side("b"), "b")
    ids = heads.select("set", "id")
    possible = materialize(known.select("a", "b", "na", "nb", "bits_a", "bits_b").mapInArrow(_possible(percent), "a long, b long"), "ngram-possible")
    named = possible.join(ids.select(F.col("set").alias("a"), F.col("id").alias("ia")), "a").join(ids.select(F.col("set").alias("b"), F.col("id").alias("ib")), "b")
    sets = tokens_of(named.select(F.explode(F.array("ia", "ib")).alias("id")))
    left = sets.select(F.col("id").alias("ia"), F.col("set").alias("a"), F.col("tokens").alias("left"))
    right = sets.select(F.col("id").alias("ib"), F.col("set").alias("b"), F.col("tokens").alias("right"))
    both = named.join(left, ["ia", "a"]).join(right, ["ib", "b"])
    links = materialize(both.select("ia", "ib", "left", "right").mapInArrow(_verified(percent), "a long, b long").distinct(), "ngram-links")
    done = [rows, heads, made, possible, links]

    across = _across(listed, ids, links, tokens_of, percent, done)
    comps = materialize(connected_components(links if across is None else links.unionByName(across), "ngram-cc"), "ngram-comps")
    done.append(comps)
    by_set = ids.join(comps, ids["id"] == comps["node"], "left").select("set", F.coalesce("component", "id").alias("component"))
    out = rows.join(by_set, "set", "left")
    component = F.when(F.col("id").isNull() | (F.col("set") == 0), F.col("id")).otherwise(F.col("component"))
    result = materialize(out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id")), "ngram-out")
    for df in done:
        discard(df)
    return result


def representatives(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 75) -> DataFrame:
    """The rows of docs that stand for their component, that of the smallest key; all columns. Rows of one key stay or go together; rows of null key stay.

    Only rows whose key falls on a bit of a dropped one meet the dropped keys in a join, so the others' texts are not
    shuffled; the bitmap ends at SLOTS bits, beyond which more rows take that way.
    """
    classes = jaccard_classes(docs, key, text, percent)
    gone = materialize(classes.where(F.col("component_id") != F.col(key)).select(F.col(key).cast("long").alias("__gone")).distinct(), "ngram-gone")
    slots = _slots(classes.count())
    slot = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(slots)).cast("long")
    words = gone.select(slot("__gone").alias("slot")).select(F.shiftright("slot", 5).alias("word"), F.expr("shiftleft(1L, cast(slot & 31 as int))").alias("bits"))
    marked = docs.sparkSession.sparkContext.broadcast(_bitmap(words, slots).view(np.uint8))

    names = [*docs.columns, "__met"]

    def meets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = marked.value
        for batch in batches:
            at = batch.column(batch.num_columns - 1).to_numpy()
            met = (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(met)], names=names)

    rows = docs.withColumn("__slot", F.coalesce(slot(key), F.lit(0))).mapInArrow(meets, StructType([*docs.schema.fields, StructField("__met", BooleanType())]))
    met = F.col("__met") & F.col(key).isNotNull()
    doubted = rows.where(met).drop("__met").withColumn("__key", F.col(key).cast("long"))
    left = doubted.join(gone.hint("merge"), F.col("__key") == F.col("__gone"), "left_anti").drop("__key")
    return rows.where(~met).drop("__met").unionByName(left)


def _across(listed: DataFrame, ids: DataFrame, links: DataFrame, tokens_of, percent: int, done: list) -> DataFrame | None:
    """Links between components of sets that share a combination: all lists that span several components are compared, under their first set as home."""
    comps = materialize(connected_components(links, "ngram-cc1"), "ngram-comps1")
    placed = ids.join(comps, ids["id"] == comps["node"], "left").select("set", "id", F.coalesce("component", "id").alias("comp"))
    rows = materialize(listed.join(placed, "set").select("list", "set", "id", "comp"), "ngram-listed")
    done += [comps, rows]
    homes = rows.groupBy("list").agg(F.min("set").alias("home"), F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y").select("list", "home")
    members = materialize(rows.join(homes, "list").select("home", "set", "id", "comp").distinct(), "ngram-members")
    done.append(members)
    n = members.count()
    if not n:
        return None
    blocks = members.groupBy("home").agg(F.ceil(F.count("*") / F.lit(TILE)).cast("int").alias("blocks"))
    tiles = members.join(blocks, "home").withColumn("block", F.pmod(F.xxhash64("set"), "blocks").cast("int"))
    tiles = tiles.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = tiles.select("home", "set", "id", "comp", "block", "blocks", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"))
    whole = tiles.join(tokens_of(members.select("id")), ["id", "set"])
    # Small groups go to a task together; a tile of a large one stands for itself.
    tasks = max(12, n * 4000 // TASK_BYTES)
    deal = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("home"), F.lit(tasks))).otherwise(F.xxhash64("home", "x", "y"))
    found = whole.select(deal.alias("deal"), "home", "x", "y", "block", "id", "comp", "tokens").groupBy("deal").applyInArrow(_tile(percent), "a long, b long")
    across = materialize(found, "ngram-across")
    done.append(across)
    return across
