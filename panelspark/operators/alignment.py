"""Sequential matching within a document: aligning blocks, greedy one-to-one matches, fuzzy diffs, quantile regression.

These are inherently sequential, so each runs as one Arrow-backed function over the rows of a document.
"""

from __future__ import annotations

import math
import re
from array import array
from bisect import bisect_left
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.functions.textops import MASKED_WORDS
from panelspark.session import spread

#: As textops.mask, for texts at hand.
_NUMBERS, _BETWEEN = re.compile(rf"[0-9][0-9,./:-]*|\b(?:{'|'.join(MASKED_WORDS)})\b", re.A), re.compile(r"[^a-z#]+")

#: Offsets of a block up to which plain Python is faster than arrays; both find the same.
FEW = 8


def longest_chain(candidates: list[list[int]], held: int | None = None) -> list[int | None]:
    """One offset for each block, ascending, for as many blocks as possible; None for blocks left out."""
    return chain_of([sorted(set(offsets)) for offsets in candidates], held)


def chain_of(offsets: list[list[int] | np.ndarray], held: int | None = None) -> list[int | None]:
    """longest_chain of ascending, distinct offsets; many are an array that blocks alike can share.

    About `held` of the chains' ends are kept at a time; on the way back, those of earlier blocks are found anew from a mark.
    """
    held = held or max(1 << 18, len(offsets) * math.isqrt(len(offsets)))
    tails: list[int] = []  # the least end of the chains of each length so far

    def on(block: int, stop: int, most: float) -> list[tuple]:
        """What go_on says of each block from this one on, until it is more than most."""
        found, n = [], 0
        while block < stop and n <= most:
            found.append(go_on(tails, offsets[block]))
            n += len(found[-1][0])
            block += 1
        return found

    marks, block, found = [], 0, None
    while block < len(offsets):
        marks.append((block, np.array(tails, np.int64)))
        found = on(block, len(offsets), held)
        block += len(found)
    out: list[int | None] = [None] * len(offsets)
    k, stop = len(tails) - 1, len(offsets)
    for block, before in reversed(marks):
        if found is None:
            tails[:] = before.tolist()
            found = on(block, stop, math.inf)
        for i in range(stop - 1, block - 1, -1):  # the last of the blocks before that ends a chain of this length
            lengths, ends = found[i - block]
            at = bisect_left(lengths, k)
            if at < len(lengths) and lengths[at] == k:
                out[i] = int(ends[at])
                k -= 1
        stop, found = block, None
    return out


def go_on(tails: list[int], offsets: list[int] | np.ndarray) -> tuple:
    """Chains go on with one of a block's offsets where that is no later an end than in tails: their lengths, ascending, and ends, which go to tails."""
    if len(offsets) == 1:
        k = bisect_left(tails, offsets[0])
        tails[k : k + 1] = offsets
        return [k], offsets
    if len(offsets) <= FEW:
        least = {bisect_left(tails, offset): offset for offset in reversed(offsets)}
        for k, offset in least.items():
            tails[k : k + 1] = [offset]
        return [*least][::-1], [*least.values()][::-1]
    known, offsets = np.array(tails, np.int64), np.asarray(offsets, np.int64)
    if len(offsets) <= len(known):
        lengths, first = np.unique(np.searchsorted(known, offsets), return_index=True)
        ends = offsets[first]
    else:
        after = np.concatenate(([0], np.searchsorted(offsets, known, "right")))
        after = offsets[after[after < len(offsets)]]  # for each length, the first offset after a chain one shorter
        lengths = np.flatnonzero(after <= np.append(known, np.iinfo(np.int64).max)[: len(after)])
        ends = after[lengths]
    known = np.append(known, 0)[: max(len(known), lengths[-1] + 1)]
    known[lengths] = ends
    tails[:] = known.tolist()
    return lengths.astype(np.int32), ends


def folded(text: str) -> tuple[str, np.ndarray]:
    """Lower-cased a-z, digits and points of a text, and the place of each in it."""
    low = text.lower()
    points = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.flatnonzero((points == 46) | ((points >= 48) & (points <= 57)) | ((points >= 97) & (points <= 122)))
    place = np.arange(len(text)) if len(low) == len(text) else np.repeat(np.arange(len(text)), [len(c.lower()) for c in text])
    return points[at].astype(np.uint8).tobytes().decode("ascii"), place[at]


def places(text: str, piece: str) -> list[int] | np.ndarray:
    """Every place of a piece in a text, overlapping ones too, ascending."""
    found, at = array("q"), text.find(piece)
    while at >= 0:
        found.append(at)
        at = text.find(piece, at + 1)
    return np.array(found, np.int64) if len(found) > FEW else found.tolist()


def in_order(text: str, sought: list[list[str]]) -> list[int | None] | None:
    """Each block at the first place of its piece after the block before; None if one that occurs has no such place.

    That is the longest chain where it goes through all blocks, without their other places.
    """
    at, out = -1, []
    for pieces in sought:
        out.append(None)
        for piece in pieces:
            if (after := text.find(piece, at + 1)) >= 0:
                out[-1] = at = after
                break
            if text.find(piece, 0, at + len(piece)) >= 0:
                return None
    return out


def aligned(text: str, blocks: list[str | None]) -> list[int | None]:
    """Where each block stands in a text, by the first of its pieces that occurs there; see align_blocks."""
    text, place = folded(text)
    sought = [[b[:120], b[:40]] if len(b) > 40 else [b] if b else [] for b in (folded(x or "")[0] for x in blocks)]
    placed = in_order(text, sought)
    if placed is None:
        known = {}  # blocks alike share an array
        found = []
        for pieces in sought:
            for piece in pieces:
                if piece not in known:
                    known[piece] = places(text, piece)
                if len(known[piece]):
                    break
            found.append(known[piece] if pieces else [])
        placed = [None] * len(found)
        todo = [i for i, offsets in enumerate(found) if len(offsets)]
        while todo:  # each pass places at least one
            for i, offset in zip(todo, chain_of([found[i] for i in todo]), strict=True):
                placed[i] = offset
            todo = [i for i in todo if placed[i] is None]
    return [None if x is None else int(place[x]) for x in placed]


def align_blocks(docs: DataFrame, blocks: DataFrame) -> DataFrame:
    """docs (doc, text), blocks (doc, ordinal, block) -> (doc, ordinal, offset): where each block stands in its document; null if it is nowhere in it.

    Both are folded to letters, digits and points; a block is sought by its first 120 of these, else by its first 40, at all
    their places. The longest chain in order is placed, then that of the blocks left, and so on until none is left.
    """

    def run(batches):
        for batch in batches:
            for rows in (batch.slice(at, 200) for at in range(0, batch.num_rows, 200)):
                doc, ordinal, offset = [], [], []
                for r in rows.to_pylist():
                    doc += [r["doc"]] * len(r["blocks"])
                    ordinal += [b["ordinal"] for b in r["blocks"]]
                    offset += aligned(r["text"] or "", [b["block"] for b in r["blocks"]])
                yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(ordinal, pa.int32()), pa.array(offset, pa.int64())], names=["doc", "ordinal", "offset"])

    # A document and its blocks are one row; a frame made for each of them would cost more than the alignment.
    block = F.struct("ordinal", "block")
    rows = docs.select("doc", "text", F.lit(None).cast(blocks.select(block).schema[0].dataType).alias("b")).unionByName(blocks.select("doc", F.lit(None).cast("string").alias("text"), block.alias("b")))
    told = rows.groupBy("doc").agg(F.first("text", ignorenulls=True).alias("text"), F.array_sort(F.collect_list("b")).alias("blocks")).where(F.size("blocks") > 0)
    return told.mapInArrow(run, "doc long, ordinal int, offset long")


def greedy_match(left: DataFrame, right: DataFrame, tolerance: float) -> DataFrame:
    """left, right (doc, tag, pos) -> (doc, tag, left_pos, right_pos): each left mark with the nearest unused right one of its tag within the tolerance."""

    named = {f"{side}_{c}": c for side in ("left", "right") for c in ("doc", "tag", "pos")}

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if not len(a) or not len(b):
            return pd.DataFrame(rows, columns=["doc", "tag", "left_pos", "right_pos"])
        for tag, marks in a.sort_values("pos").groupby("tag", sort=True):
            free = sorted(b.loc[b["tag"] == tag, "pos"])
            for pos in marks["pos"]:
                best = min(free, key=lambda p: (abs(p - pos), p), default=None)
                if best is not None and abs(best - pos) <= tolerance:
                    free.remove(best)
                    rows.append((a["doc"].iloc[0], tag, pos, best))
        return pd.DataFrame(rows, columns=["doc", "tag", "left_pos", "right_pos"])

    # Columns of their own: both sides may come from one table.
    left, right = (x.select(*[F.col(c).alias(f"{side}_{c}") for c in ("doc", "tag", "pos")]) for side, x in (("left", left), ("right", right)))
    return left.groupBy("left_doc").cogroup(right.groupBy("right_doc")).applyInPandas(lambda a, b: run(a.rename(columns=named), b.rename(columns=named)), "doc long, tag string, left_pos double, right_pos double")


def fuzzy_diff(pairs: DataFrame, least: float = 0.6) -> DataFrame:
    """(key, old array, new array) -> (key, kept, changed, added, dropped): items matched one to one, equal ones first, then by similarity.

    With columns old_heads and new_heads, arrays of a heading for each item, and headings on more than half of the items of
    both sides, headings at least 0.85 similar match first, and texts of the rest at 0.8; else texts match at least. Texts
    are compared whole, numbers masked. Null items are none.
    """
    headed = {"old_heads", "new_heads"} <= set(pairs.columns)

    def masked(text: str) -> str:
        return _BETWEEN.sub(" ", _NUMBERS.sub("#", text.lower())).strip() or text

    def matches(old: list[str], new: list[str], floor: float) -> list[tuple[int, int]]:
        """Each old item with the free new one most similar to it, the first of equals; empty ones match nothing."""
        out, free = [], {i: SequenceMatcher(None, "", x, autojunk=False) for i, x in enumerate(new) if x}
        for i, x in enumerate(old):
            best, most = None, 0.0
            for j, m in free.items() if x else ():
                if most == 1.0:
                    break  # nothing is nearer, and of equals the first counts
                if m.b == x:
                    best, most = j, 1.0
                    continue
                m.set_seq1(x)
                # Both are bounds from above, so nothing is lost.
                if all(bound() >= floor and bound() > most for bound in (m.real_quick_ratio, m.quick_ratio)) and (ratio := m.ratio()) > most:
                    best, most = j, ratio
            if best is not None and most >= floor:
                out.append((i, best))
                del free[best]
        return out

    def run(batches):
        for pdf in batches:
            rows = []
            heads = zip(pdf["old_heads"], pdf["new_heads"], strict=True) if headed else [([], [])] * len(pdf)
            for key, old, new, (old_heads, new_heads) in zip(pdf["key"], pdf["old"], pdf["new"], heads, strict=True):
                old, new = ([(x, h or "") for x, h in zip(xs, hs if len(hs) else [""] * len(xs), strict=True) if x is not None] for xs, hs in ((old, old_heads), (new, new_heads)))
                use_heads = all(2 * sum(h != "" for _, h in side) > len(side) for side in (old, new))
                kept = changed = 0
                for item in list(old):
                    if item in new:
                        old.remove(item)
                        new.remove(item)
                        kept += 1
                passes = [(lambda x: x[1], 0.85)] if use_heads else []
                for told, floor in [*passes, (lambda x: masked(x[0]), 0.8 if use_heads else least)]:
                    found = matches([told(x) for x in old], [told(x) for x in new], floor)
                    changed += sum(old[i][0] != new[j][0] for i, j in found)
                    kept += sum(old[i][0] == new[j][0] for i, j in found)
                    gone, taken = {i for i, _ in found}, {j for _, j in found}
                    old, new = [x for i, x in enumerate(old) if i not in gone], [x for j, x in enumerate(new) if j not in taken]
                rows.append((key, kept, changed, len(new), len(old)))
            yield pd.DataFrame(rows, columns=["key", "kept", "changed", "added", "dropped"])

    # Short rows of long work: a few tasks would hold them all.
    return spread(pairs.select("key", "old", "new", *(["old_heads", "new_heads"] if headed else []))).mapInPandas(run, "key long, kept long, changed long, added long, dropped long")
