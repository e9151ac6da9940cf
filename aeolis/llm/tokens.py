"""Token ids of whole texts, each distinct piece of text encoded once per task, and their binary shards with a keyed index."""

from __future__ import annotations

import io
import os
import uuid
import zlib
from struct import pack, unpack

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aeolis.llm.common import bound_batches, mix64, stage, text_slices
from aeolis.session import shared_dir

#: Distinct pieces of text whose ids a worker keeps; beyond, it forgets all but those that it meets often.
KEPT = 600_000
#: A control character that stands between pieces.
MARK = "\x01"
#: Bytes of text that are cut at once.
SLICE = 16 << 20
#: White space other than single spaces and line feeds, runs of it, or white space at either end; and the characters that mark cuts and pieces.
_WHOLE = "[\\x00\\x01\\t\\x0b\\x0c\\r\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]|[ \\n][ \\n]|\\A[ \\n]|[ \\n]\\z"
#: Marks that don't follow a letter or digit, and underscores.
_MARKS = "(?:\\A|[^\\pL\\pN])[.,]|_"


class Encoder:
    """Ids of texts by a tokenizer file of the ``tokenizers`` library, without special tokens.

    A text is cut before a single space, around a single line feed, and around a full stop or comma that stands between a
    letter or digit and such a place. The pre-tokenizers in use never join characters across these places, so the ids of the
    pieces, joined, are the ids of the text. Texts with any other white space (runs, tabs, at either end) are encoded whole.
    Texts are cut and pieces numbered in Arrow; the library sees every distinct piece once, as long as it is kept.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        mark = self.tokenizer.encode(f" {MARK} ", add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        #: The pieces met; the ids of each lie in ``pool`` between two of ``ends``. How often each was met.
        self.known = pa.array([], pa.string())
        self.ends, self.pool = np.zeros(1, np.int64), np.empty(0, np.uint32)
        self.met = np.empty(0, np.int64)

    def _ids(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of known pieces, one piece behind the other, and where each begins (and the last one ends)."""
        lists = pa.LargeListArray.from_arrays(self.ends, self.pool).take(pa.array(number))
        return lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()

    def forget(self) -> None:
        """Keep at most half of ``KEPT``, the pieces met most often, and no piece that was met once; older meetings count half."""
        often = np.flatnonzero(self.met > 1)
        if len(often) > KEPT // 2:
            often = np.sort(often[np.argsort(-self.met[often], kind="stable")[: KEPT // 2]])
        self.pool, self.ends = self._ids(often)
        self.known, self.met = self.known.take(pa.array(often)), self.met[often] // 2

    def _joined(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As :meth:`_library`, for short pieces: many in a text, where a mark between white space is one id of its own."""
        if self.mark is None:
            return self._library(pieces)
        between, parts = f" {MARK} ", [np.empty(0, np.uint32)]
        for at in range(0, len(pieces), 20_000):
            some, ids = pieces[at : at + 20_000], []
            for e in self.tokenizer.encode_batch_fast([between.join(some[i : i + 128]) for i in range(0, len(some), 128)], add_special_tokens=False):
                ids += e.ids
                ids.append(self.mark)
            parts.append(np.array(ids, np.uint32))
        ids = np.concatenate(parts)
        ends = np.flatnonzero(ids == self.mark)
        if len(ends) != len(pieces):  # other characters have the mark's id
            return self._library(pieces)
        return ids[ids != self.mark], np.diff(ends, prepend=-1) - 1

    def _library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts, one behind the other, and how many each has."""
        parts, n = [np.empty(0, np.uint32)], []
        for at in range(0, len(texts), 20_000):
            ids: list[int] = []
            for e in self.tokenizer.encode_batch_fast(texts[at : at + 20_000], add_special_tokens=False):
                own = e.ids
                n.append(len(own))
                ids += own
            parts.append(np.array(ids, np.uint32))
        return np.concatenate(parts), np.array(n, np.int64)

    def _numbers(self, pieces: pa.Array, times: np.ndarray) -> np.ndarray:
        """The places of distinct pieces, each met so many times, among the known ones; new ones are encoded."""
        at = pc.index_in(pieces, self.known)
        if len(self.known) + at.null_count > KEPT and len(self.known):
            self.forget()
            at = pc.index_in(pieces, self.known)
        if at.null_count:
            new = pieces.filter(pc.is_null(at))
            ids, n = self._joined(new.to_pylist())
            fresh = pa.array(np.arange(len(self.known), len(self.known) + len(new), dtype=np.int32))
            at = pc.replace_with_mask(at, pc.is_null(at), fresh)
            self.known = pa.concat_arrays([self.known, new])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(n)])
            self.pool = np.concatenate([self.pool, ids])
            self.met = np.concatenate([self.met, np.zeros(len(new), np.int64)])
        number = at.to_numpy()
        self.met[number] += times
        return number

    def flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one text behind the other, and the place where each text begins (and the last one ends)."""
        whole = pc.match_substring_regex(texts, _WHOLE).to_numpy(zero_copy_only=False)
        n = np.zeros(len(texts), np.int64)
        parts = {}
        if whole.any():
            parts[True], n[whole] = self._library(texts.filter(pa.array(whole)).to_pylist())
        if not whole.all():
            parts[False], n[~whole] = self._pieces(texts.filter(pa.array(~whole)))
        ids = np.empty(int(n.sum()), np.uint32)
        side = np.repeat(whole, n)
        for w, found in parts.items():
            ids[side == w] = found
        return ids, np.concatenate([[0], np.cumsum(n)])

    def _pieces(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        cut = pc.replace_substring(pc.replace_substring(texts, "\n", "\x00\n\x00"), " ", "\x00 ")
        marks = pc.match_substring_regex(texts, _MARKS)
        split = pc.replace_substring(pc.replace_substring(cut, ",\x00", "\x00,\x00"), ".\x00", "\x00.\x00")
        lists = pc.split_pattern(pc.if_else(marks, cut, split), "\x00")
        coded = lists.flatten().dictionary_encode()
        code = coded.indices.to_numpy()
        number = self._numbers(coded.dictionary, np.bincount(code, minlength=len(coded.dictionary)))
        ids, last = self._ids(number[code])
        ends = lists.offsets.to_numpy()
        return ids, np.diff(last[ends - ends[0]])

    def encode(self, texts: pa.Array | list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        ids, starts = self.flat(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
        data = ids.astype("<u4").tobytes()
        return [data[4 * a : 4 * b] for a, b in zip(starts, starts[1:], strict=False)]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each tokenizer file and Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


# ---------------------------------------------------------------------------------------------------------------------
# Shards: header, ids, offsets of the documents. Index: minimal perfect hash of (doc_id, ordinal of the shard) -> place.

MAGIC = b"IDSHARD1"
#: Ids after which a shard is closed (a document never spans shards).
SHARD_IDS = 8_000_000
#: Keys of one index file on average.
INDEX_KEYS = 32_768
GAMMA, LEVELS = 1.5, 48


def place(folder: str):
    """File system and path of a folder named as Spark names it."""
    return fs.FileSystem.from_uri(folder if "://" in folder else "file://" + os.path.abspath(folder))


def put(folder: str, name: str, chunks: list[bytes]) -> None:
    """Write a file under another name and move it into place: readers and repeated tasks never meet half a file."""
    files, root = place(folder)
    files.create_dir(root, recursive=True)
    own = f"{root}/.{name}.{uuid.uuid4().hex}"
    with files.open_output_stream(own) as out:
        for c in chunks:
            out.write(c)
    files.move(own, f"{root}/{name}")


def pack_shard(ids: list[bytes], width: int) -> tuple[list[bytes], np.ndarray]:
    """Chunks of a shard file and the offsets of its documents."""
    offsets = np.concatenate([[0], np.cumsum([len(b) // 4 for b in ids])]).astype("<i8")
    payload = np.frombuffer(b"".join(ids), "<u4").astype(f"<u{width}")
    head = MAGIC + pack("<IIQQ", width, 0, len(ids), int(offsets[-1]))
    return [head, offsets.tobytes(), payload.tobytes()], offsets


class Shard:
    """Read access to one shard."""

    def __init__(self, folder: str, shard: int):
        files, root = place(folder)
        with files.open_input_file(f"{root}/shard-{shard:016x}.bin") as f:
            data = f.read()
        if data[:8] != MAGIC:
            raise ValueError(f"no shard of token ids: {root}/shard-{shard:016x}.bin")
        width, _, docs, n = unpack("<IIQQ", data[8:32])
        self.offsets = np.frombuffer(data, "<i8", docs + 1, 32)
        self.ids = np.frombuffer(data, f"<u{width}", n, 32 + 8 * (docs + 1))

    def document(self, at: int) -> np.ndarray:
        return self.ids[self.offsets[at] : self.offsets[at + 1]].astype("<u4")


def key_of(doc_id: np.ndarray, known: np.ndarray, nth: np.ndarray) -> np.ndarray:
    """64 bits of a key; NULL ids have keys of their own."""
    with np.errstate(over="ignore"):
        base = mix64(np.where(known, doc_id, 0).astype(np.int64).view(np.uint64)) + np.where(known, 0, 0x9E3779B97F4A7C15).astype(np.uint64)
        return mix64(base + (nth.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1B54A32D192ED03))


def _slot(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix64(keys + np.uint64((level + 1) * 0x632BE59BD9B4E019 % (1 << 64))) % np.uint64(size)).astype(np.int64)


def build_index(keys: np.ndarray, values: np.ndarray) -> dict[str, np.ndarray]:
    """Minimal perfect hash of distinct keys by levels of bits, with a fingerprint and a row of values for each key.

    At a level every key left sets a bit of its own, if no other key wants it; the others go on to the next level. A key's
    number is the count of bits before its own. Keys that no level places are listed with the table.
    """
    bits, sizes, left, order = [], [], np.arange(len(keys)), []
    for level in range(LEVELS):
        if not len(left):
            break
        size = max(64, int(GAMMA * len(left)))
        slot = _slot(keys[left], level, size)
        alone = np.bincount(slot, minlength=size) == 1
        mine = alone[slot]
        order.append(left[mine][np.argsort(slot[mine])])
        bits.append(alone)
        sizes.append(size)
        left = left[~mine]
    flat = np.concatenate(bits) if bits else np.zeros(0, bool)
    order = np.concatenate([*order, left]).astype(np.int64) if len(keys) else np.zeros(0, np.int64)
    ranks = np.concatenate([[0], np.cumsum(np.add.reduceat(flat, np.arange(0, len(flat), 64), dtype=np.int64))]) if len(flat) else np.zeros(1)
    return {"bits": np.packbits(flat), "sizes": np.array(sizes, np.int64), "ranks": ranks.astype(np.int64), "prints": (keys[order] >> np.uint64(32)).astype(np.uint32), "values": values[order], "rest": keys[left]}


def search_index(index: dict[str, np.ndarray], keys: np.ndarray) -> np.ndarray:
    """Row number of every key, -1 if its fingerprint isn't the stored one."""
    found, open_, base = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
    flat = np.unpackbits(index["bits"])[: int(index["sizes"].sum())]
    for level, size in enumerate(index["sizes"]):
        at = base + _slot(keys[open_], level, int(size))
        hit = flat[at] == 1
        word = at[hit] // 64
        inside = np.arange(64)[None, :] + word[:, None] * 64
        before = ((inside < at[hit][:, None]) & (flat[np.minimum(inside, len(flat) - 1)] == 1)).sum(axis=1)
        found[open_[hit]] = index["ranks"][word] + before
        open_, base = open_[~hit], base + int(size)
    placed = len(index["prints"]) - len(index["rest"])
    for i in open_:
        same = np.flatnonzero(index["rest"] == keys[i])
        found[i] = placed + same[0] if len(same) else -1
    ok = (found >= 0) & (found < len(index["prints"]))
    ok[ok] = index["prints"][found[ok]] == (keys[ok] >> np.uint64(32)).astype(np.uint32)
    return np.where(ok, found, -1)


def write_ids(docs: DataFrame, tokenizer: str, end_id: int, name: str = "ids", shard_ids: int = SHARD_IDS) -> tuple[str, DataFrame]:
    """Write the ids of every document, in ascending order of id, as shards; return their folder and (doc_id, shard, at, n).

    The rows are dealt to tasks by ranges of the id (NULL first; rows with one id by a hash of the text and their place, so that
    one id can't fill a task). Ids are stored in two bytes where the vocabulary allows, else in four.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    folder = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    dealt = rows.repartitionByRange("doc_id", "h", "row").sortWithinPartitions("doc_id", "h", "row").select("doc_id", "text")

    def write(batches):
        part, nth, ids, held = TaskContext.get().partitionId(), 0, [], 0
        tool = encoder(tokenizer)
        width = 2 if max(tool.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        end = pack("<I", end_id)

        def close():
            shard = (part << 24) + nth
            chunks, _ = pack_shard(ids, width)
            put(folder, f"shard-{shard:016x}.bin", chunks)

        for batch in text_slices(batches, "text", SLICE):
            keys, out = batch["doc_id"], []
            for b in tool.encode(batch["text"]):
                if ids and held + len(b) // 4 + 1 > shard_ids:
                    close()
                    nth, ids, held = nth + 1, [], 0
                out.append(((part << 24) + nth, len(ids), len(b) // 4 + 1))
                ids.append(b + end)
                held += len(b) // 4 + 1
            cols = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)]
            yield pa.record_batch([keys, *cols], ["doc_id", "shard", "at", "n"])
        if ids:
            close()

    return folder, stage(dealt.mapInArrow(write, "doc_id long, shard long, at long, n long"), f"{name}-entries")


def write_index(folder: str, entries: DataFrame, index_keys: int = INDEX_KEYS) -> int:
    """Write the index files of the shards; returns their number. Keys are (doc_id, how many shards with that id come before)."""
    spans = entries.groupBy("doc_id", "shard").agg(F.min("at").alias("at"), F.count("*").alias("copies"))
    spans = spans.withColumn("nth", (F.row_number().over(Window.partitionBy("doc_id").orderBy("shard")) - 1).cast("long"))  # hashed as in look_up
    more = spans.groupBy("doc_id").agg(F.count("*").alias("shards")).where("shards > 1").withColumnRenamed("doc_id", "of")
    spans = spans.join(more, F.col("doc_id").eqNullSafe(F.col("of")), "left").select("doc_id", "shard", "at", "copies", "nth", F.coalesce("shards", F.lit(1)).alias("shards"))
    files = max(1, -(-entries.count() // index_keys))
    keyed = spans.withColumn("file", F.pmod(F.xxhash64("doc_id", "nth"), F.lit(files)))

    def build(key, t):
        known = ~t["doc_id"].is_null().to_numpy()
        keys = key_of(t["doc_id"].fill_null(0).to_numpy(), known, t["nth"].to_numpy())
        values = np.stack([t[c].to_numpy() for c in ("shard", "at", "copies", "shards")], axis=1)
        held = io.BytesIO()
        np.savez(held, **build_index(keys, values))
        put(folder, f"index-{key[0].as_py():08x}.npz", [held.getvalue()])
        return pa.table({"file": pa.array([key[0].as_py()], pa.int64())})

    keyed.groupBy("file").applyInArrow(build, "file long").count()
    return files


def look_up(folder: str, files: int, keys: DataFrame) -> DataFrame:
    """Places of the keys (doc_id, nth) by the index: shard, at, copies, shards; keys that aren't stored have no row."""

    def find(key, t):
        fsys, root = place(folder)
        with fsys.open_input_file(f"{root}/index-{key[0].as_py():08x}.npz") as f:
            index = dict(np.load(io.BytesIO(f.read())))
        known = ~t["doc_id"].is_null().to_numpy()
        at = search_index(index, key_of(t["doc_id"].fill_null(0).to_numpy(), known, t["nth"].to_numpy()))
        hit = at >= 0
        found = index["values"][at[hit]].reshape(-1, 4)
        cols = {c: pa.array(found[:, i], pa.int64()) for i, c in enumerate(("shard", "at", "copies", "shards"))}
        return pa.table({"doc_id": t["doc_id"].filter(pa.array(hit)).combine_chunks(), "nth": t["nth"].filter(pa.array(hit)).combine_chunks()} | cols)

    keyed = keys.select("doc_id", F.col("nth").cast("long").alias("nth")).withColumn("file", F.pmod(F.xxhash64("doc_id", "nth"), F.lit(files)))
    return keyed.groupBy("file").applyInArrow(find, "doc_id long, nth long, shard long, at long, copies long, shards long")


def read_ids(folder: str, files: int, keys: DataFrame, with_ids: bool = False) -> DataFrame:
    """Read the documents of the given ids back from the shards: one row per stored document.

    ``keys`` has distinct doc_id. Returns doc_id, shard, start in the shard, n_tokens, ids_crc32 and, on demand, the ids.
    """
    first = stage(look_up(folder, files, keys.select("doc_id", F.lit(0).alias("nth"))), "ids-places")
    rest = first.where("shards > 1").select("doc_id", F.explode(F.sequence(F.lit(1), F.col("shards") - 1)).alias("nth"))
    places = first.unionByName(look_up(folder, files, rest))

    def read(key, t):
        shard, out = Shard(folder, key[0].as_py()), []
        for doc_id, at, copies in zip(t["doc_id"].to_pylist(), t["at"].to_pylist(), t["copies"].to_pylist(), strict=True):
            for i in range(at, at + copies):
                ids = shard.document(i)
                out.append((doc_id, key[0].as_py(), int(shard.offsets[i]), len(ids), zlib.crc32(ids.tobytes()), *([ids.tolist()] if with_ids else [])))
        cols = zip(*out, strict=True)
        kinds = [pa.int64()] * 5 + [pa.list_(pa.int64())] * with_ids
        names = ["doc_id", "shard", "begin", "n_tokens", "ids_crc32", "ids"]
        return pa.table({n: pa.array(c, k) for n, c, k in zip(names, cols, kinds, strict=False)})

    schema = "doc_id long, shard long, begin long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    return places.groupBy("shard").applyInArrow(read, schema)


def shard_starts(entries: DataFrame) -> DataFrame:
    """(shard, first): ids in all shards before. One row per shard, so that the running sum is small."""
    sizes = entries.groupBy("shard").agg(F.sum("n").alias("n"))
    return sizes.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("first"))


def binary_round_trip(docs: DataFrame, tokenizer: str, end_id: int = 2, shard_ids: int = SHARD_IDS, index_keys: int = INDEX_KEYS) -> DataFrame:
    """Write the ids of all documents as shards with an index, then fetch every document by its key and describe what was read.

    Returns doc_id, start (ids of all documents before it, in ascending order of id), n_tokens (with the end id) and ids_crc32.
    NULL text is empty: the end id alone. NULL ids come first and share one key; repeated rows and ids are all stored, next to
    each other, and all returned. Other columns are left out. An empty table gives an empty result.
    """
    folder, entries = write_ids(docs, tokenizer, end_id, shard_ids=shard_ids)
    files = write_index(folder, entries, index_keys)
    found = read_ids(folder, files, entries.select("doc_id").distinct())
    starts = stage(shard_starts(entries), "ids-starts")
    return found.join(starts, "shard").select("doc_id", (F.col("first") + F.col("begin")).alias("start"), "n_tokens", "ids_crc32")
