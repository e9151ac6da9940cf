"""Packing documents into sequences by minimum bin slack."""

from __future__ import annotations

import zlib
from struct import pack as packed

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aeolis.llm.common import bound_batches, stage, text_slices
from aeolis.llm.tokens import SLICE, encoder

WINDOW = 2048


def padding(filled: int, window: int = WINDOW) -> int:
    """A sequence is padded to the window, except at a power of two."""
    return 0 if filled & (filled - 1) == 0 else window - filled


def fill(counts: dict[int, int], room: int, window: int = WINDOW) -> list[tuple[int, int]]:
    """The multiset of lengths, at most ``counts`` of each, that leaves least padding with what the window already holds.

    Bit s of ``sums`` says that the lengths seen so far can add up to s; a length that may be used c times enters in steps of
    1, 2, 4, ... copies. The steps are undone from the last to count the copies of each length.
    """
    sums, steps, mask = 1, [], (1 << (room + 1)) - 1
    for length in sorted((n for n in counts if n <= room), reverse=True):
        left, copies = min(counts[length], room // length), 1
        while left > 0 and not sums >> room & 1:
            copies = min(copies, left)
            steps.append((length, copies, sums))
            sums = (sums | sums << length * copies) & mask
            left, copies = left - copies, copies * 2
        if sums >> room & 1:
            break
    used = window - room
    best = min((s for s in range(room + 1) if sums >> s & 1), key=lambda s: (padding(used + s, window), -s))
    chosen: dict[int, int] = {}
    for length, copies, before in reversed(steps):
        if not before >> best & 1:
            best -= length * copies
            chosen[length] = chosen.get(length, 0) + copies
    return sorted(chosen.items(), reverse=True)


def plan(totals: dict[int, int], window: int = WINDOW) -> np.ndarray:
    """Rows (length, first rank, end rank, copies in a sequence, offset of the first, first sequence), sorted by length and rank.

    Works on the count of each length alone, so it has the size of the window, not of the corpus. The longest length
    left opens a window, ``fill`` closes it, and the pattern is repeated while the counts last.
    """
    rows, sequence = [], totals.get(window, 0)
    if sequence:
        rows.append((window, 0, sequence, 1, 0, 0))
    left = {n: c for n, c in totals.items() if n < window and c}
    taken = dict.fromkeys(left, 0)
    while left:
        longest = max(left)
        rest = {n: c - (n == longest) for n, c in left.items() if c > (n == longest)}
        uses = dict(fill(rest, window - longest, window))
        uses[longest] = uses.get(longest, 0) + 1
        times, offset = min(left[n] // u for n, u in uses.items()), 0
        for n in sorted(uses, reverse=True):
            rows.append((n, taken[n], taken[n] + times * uses[n], uses[n], offset, sequence))
            taken[n] += times * uses[n]
            left[n] -= times * uses[n]
            offset += n * uses[n]
        left = {n: c for n, c in left.items() if c}
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 6)


def pieces(docs: DataFrame, tokenizer: str, end_id: int, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """Each document's ids cut into whole windows and a rest, with (part, nth): the piece's place among its length in its task."""
    bound_batches(docs.sparkSession)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "nth"]

    def cut(batches):
        part, tool, end, seen = TaskContext.get().partitionId(), encoder(tokenizer), packed("<I", end_id), np.zeros(window + 1, np.int64)
        for batch in text_slices(batches, "text", SLICE):
            out = []
            for doc_id, b in zip(batch["doc_id"].to_pylist(), tool.encode(batch["text"]), strict=True):
                b += end
                n = len(b) // 4
                for at in range(0, n, window):
                    ids = b[4 * at : 4 * (at + window)]
                    length = len(ids) // 4
                    out.append((doc_id, at, length, zlib.crc32(ids), n, part, seen[length], *([np.frombuffer(ids, "<u4").tolist()] if with_ids else [])))
                    seen[length] += 1
            kinds = [pa.int64()] * 7 + [pa.list_(pa.int64())] * with_ids
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names + ["ids"] * with_ids)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(cut, ", ".join(f"{n} long" for n in names) + ", ids array<long>" * with_ids)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """Place every id of every document in exactly one sequence of at most ``window`` ids, with little padding.

    A document's ids are those of its text and ``end_id``. Whole windows are sequences of their own; the rests are packed by
    minimum bin slack over the counts of their lengths, and each rest's rank among its length (place in its task plus what
    earlier tasks hold) says which sequence and offset it takes. Nothing but counts is shuffled or gathered.

    Returns per piece doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and the ids on demand). NULL text is
    empty: the end id alone. NULL and repeated ids are rows like any other. Other columns are left out. An empty table gives
    an empty result.
    """
    rows = stage(pieces(docs, tokenizer, end_id, window, with_ids), "pack-pieces")
    held = rows.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")
    base = stage(held.select("part", "length", "n", before.alias("base")), "pack-counts")
    totals = {r["length"]: r["n"] for r in base.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # one row for a length
    table = plan(totals, window)
    span = int(table[:, 1:3].max(initial=0)) + 1
    starts = table[:, 0] * span + table[:, 1]

    def locate(batches):
        for b in batches:
            length, rank = b["length"].to_numpy(), b["rank"].to_numpy()
            row = table[np.searchsorted(starts, length * span + rank, side="right") - 1] if len(table) else np.zeros((0, 6), np.int64)
            nth, slot = np.divmod(rank - row[:, 1], row[:, 3])
            keep = [c for c in b.schema.names if c != "rank"]
            yield pa.record_batch([*(b[c] for c in keep), pa.array(row[:, 5] + nth), pa.array(row[:, 4] + slot * length)], [*keep, "sequence_id", "offset"])

    ranked = rows.join(base.select("part", "length", "base"), ["part", "length"]).withColumn("rank", F.col("base") + F.col("nth")).drop("part", "nth", "base")
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids
    kinds = ", ".join(f"{n} {'array<long>' if n == 'ids' else 'long'}" for n in names)
    return ranked.select(*names, "rank").mapInArrow(locate, f"{kinds}, sequence_id long, offset long")
