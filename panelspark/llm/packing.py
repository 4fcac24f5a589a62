"""Packing documents into windows of a fixed number of tokens by best-fit decreasing, a block of documents at a time.

Each task tokenises and packs its own rows, so nothing is shuffled and no source or key meets in one place. A block is
BLOCK_TOKENS tokens: about a thousand windows, of which the last few would stay open and are filled up by cutting.
"""

from __future__ import annotations

import re
import struct
import unicodedata
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import remembered, sliced

WINDOW, END = 4096, 2
#: Tokens that are packed together, and words whose ids a worker remembers.
BLOCK_TOKENS, REMEMBERED = 4_000_000, 500_000
#: A gap of more than this part of a window is filled up by cutting pieces of the emptiest windows.
GAP_PART = 128

SCHEMA = "key long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, padded_to long"
#: Characters below this are split here; in them no mark joins the letter before it, and lower case does not look at neighbours.
PLAIN = 0x250
_SPACE = r"\t-\r \x85\xa0"


def _pieces() -> re.Pattern:
    """The vocabulary's split of lower-cased text: English endings, letters, single digits, runs of all else."""
    lowered = {x for c in range(PLAIN) for x in chr(c).lower()}
    of = lambda kind: "".join(re.escape(c) for c in sorted(lowered) if unicodedata.category(c)[0] == kind)
    letter, number = of("L"), of("N")
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{number}]|[^{_SPACE}{letter}{number}]+")


PIECES = _pieces()
_OTHER = rf"\x00-{chr(PLAIN - 1)}"
OTHER = re.compile(f"[^{_OTHER}]")
#: A word, at ASCII white space, that holds any other character; looked for at the starts of words alone.
OTHER_WORD = re.compile(rf"((?<![^\t-\r ])[\x00-\x08\x0e-\x1f!-{chr(PLAIN - 1)}]*+[^{_OTHER}][^\t-\r ]*+)")
PRINTED = re.compile(r"[!-~]*")


class Words(dict):
    """Ids of pieces, as unsigned 32-bit little-endian bytes, by a word tokenizer file; at most so many are remembered.

    No piece spans white space and no normal form joins what it parts, so the ids of a text are those of its words in
    order. Words of characters below PLAIN are split here, others by the file's own normalizer and pre-tokenizer; the ids
    of each piece are the file's model's.
    """

    def __init__(self, path: str, most: int = REMEMBERED):
        from tokenizers import Tokenizer, pre_tokenizers

        super().__init__()
        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.tokenizer.encode_special_tokens = True
        self.spelled = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)

    def __missing__(self, piece: str) -> bytes:
        spelled = piece if PRINTED.fullmatch(piece) else self.spelled.pre_tokenize_str(piece)[0][0]
        found = self[piece] = self._ids(spelled)
        return found

    def _ids(self, spelled: str) -> bytes:
        ids = [t.id for t in self.tokenizer.model.tokenize(spelled)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        if len(self) > self.most:
            self.clear()
        made = []
        for i, run in enumerate(OTHER_WORD.split(text) if OTHER.search(text) else (text,)):
            if i % 2:
                normal = self.tokenizer.normalizer.normalize_str(run)
                made += [self._ids(p) for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)]
            else:
                made += map(self.__getitem__, PIECES.findall(run.lower()))
        return b"".join(made)


class OpenWindows:
    """Open windows in a segment tree over their remaining capacity: the tightest that still takes a piece, in the tree's height."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.at: list[list[int]] = [[] for _ in range(window + 1)]

    def _add(self, capacity: int, n: int) -> None:
        node = capacity + self.leaves
        while node:
            self.count[node] += n
            node >>= 1

    def put(self, capacity: int, window: int) -> None:
        self.at[capacity].append(window)
        self._add(capacity, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """(capacity, window) of the least capacity of need or more, taken out; None if no window has it."""
        node = need + self.leaves
        if not self.count[node]:
            # Up to the first right neighbour that holds a window, then down to its least leaf.
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node + (not self.count[2 * node])
        capacity = node - self.leaves
        self._add(capacity, -1)
        return capacity, self.at[capacity].pop()


def best_fit_decreasing(lengths: list[int], window: int = WINDOW) -> list[list[tuple[int, int, int]]]:
    """Windows of pieces (document, start, length): full windows cut from the long, the rest by best-fit decreasing."""
    windows, rest = [], []
    for doc, n in enumerate(lengths):
        whole = n - n % window
        windows += [[(doc, start, window)] for start in range(0, whole, window)]
        if n > whole:
            rest.append((n - whole, doc, whole))
    tree = OpenWindows(window)
    for n, doc, start in sorted(rest, key=lambda r: (-r[0], r[1])):
        found = tree.take(n)
        if found is None:
            capacity, place = window, len(windows)
            windows.append([])
        else:
            capacity, place = found
        windows[place].append((doc, start, n))
        if capacity > n:
            tree.put(capacity - n, place)
    return windows


def filled_up(windows: list[list[tuple[int, int, int]]], window: int = WINDOW, gap: int = WINDOW // GAP_PART) -> list[list[tuple[int, int, int]]]:
    """The windows with gaps of more than gap filled from the emptiest ones; what is left of the last is cut at powers of two."""
    size = lambda w: sum(p[2] for p in w)
    full = [w for w in windows if size(w) >= window - gap]
    open_ = sorted((w for w in windows if size(w) < window - gap), key=lambda w: (-size(w), w))
    while len(open_) > 1:
        room, taker = window - size(open_[0]), open_[0]
        while room and len(open_) > 1:
            doc, start, n = open_[-1].pop()
            if n > room:
                open_[-1].append((doc, start, n - room))
                start, n = start + n - room, room
            taker.append((doc, start, n))
            room -= n
            if not open_[-1]:
                open_.pop()
        if room:
            break
        full.append(open_.pop(0))
    for last in open_:
        left = size(last)
        for bit in range(window.bit_length(), -1, -1):
            part, room = [], left & 1 << bit
            while room:
                doc, start, n = last.pop(0)
                if n > room:
                    last.insert(0, (doc, start + room, n - room))
                    n = room
                part.append((doc, start, n))
                room -= n
            if part:
                full.append(part)
    return full


def pack(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", window: int = WINDOW, end: int = END, block: int = BLOCK_TOKENS, most: int = REMEMBERED) -> DataFrame:
    """One row per piece: key, start (ids of its document before it), length, ids (unsigned 32-bit little-endian), doc_tokens
    (with the end id), sequence_id, offset (its place in the sequence) and padded_to (the sequence's length with padding:
    its own if that is a power of two, else the window).

    A document is its ids and an end id, so a null or empty text is one token. Every row is a document of its own: repeated
    and null keys are packed as often as they come. Documents longer than a window are cut into whole windows first. A
    table without rows gives none; columns beside key and text are not read. Sequence ids are unique, and the same in a
    rerun over the same files.
    """

    def packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = remembered(f"packing {path}", lambda: Words(path, most))
        ticket = TaskContext.get().partitionId() << 33
        for keys, ids in _blocks(batches, words.encode, end, block):
            windows = filled_up(best_fit_decreasing([len(x) // 4 for x in ids], window), window, window // GAP_PART)
            yield from _batches(windows, keys, ids, ticket, window)
            ticket += len(windows)

    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(packed, SCHEMA).withColumnRenamed("key", key)


def _blocks(batches: Iterable[pa.RecordBatch], encode: Callable[[str], bytes], end: int, block: int) -> Iterator[tuple[list, list[bytes]]]:
    """Keys and ids of so many documents that a block's tokens are reached."""
    keys, ids, size = [], [], 0
    last = struct.pack("<I", end)
    for batch in sliced(batches, 500):
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            own = encode(text.as_py()) + last
            keys.append(key)
            ids.append(own)
            size += len(own) // 4
            if size >= block:
                yield keys, ids
                keys, ids, size = [], [], 0
    if keys:
        yield keys, ids


def _batches(windows: list, keys: list, ids: list[bytes], ticket: int, window: int, rows: int = 2_000) -> Iterator[pa.RecordBatch]:
    made: list[tuple] = []
    for n, pieces in enumerate(windows):
        offset, filled = 0, sum(p[2] for p in pieces)
        padded = filled if filled & (filled - 1) == 0 else window
        for doc, start, length in pieces:
            own = ids[doc]
            made.append((keys[doc], start, length, own[4 * start : 4 * (start + length)], len(own) // 4, ticket + n, offset, padded))
            offset += length
        if len(made) >= rows:
            yield _batch(made)
            made = []
    if made:
        yield _batch(made)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = "key start length ids doc_tokens sequence_id offset padded_to".split()
    return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if n == "ids" else pa.int64()) for n, c in zip(names, zip(*rows, strict=True), strict=True)], names=names)
