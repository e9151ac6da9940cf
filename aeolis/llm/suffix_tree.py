"""Language-model scores by a probabilistic suffix tree over words, learned and applied in blocks of documents."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aeolis.llm.common import bound_batches, fold, mix64, stage
from aeolis.llm.tokens import place, put
from aeolis.session import STAGED, shared_dir

#: Bytes of text of a block; words of the longest context; occurrences in training that a context needs.
BLOCK, DEPTH, LEAST = 16 << 20, 3, 50
#: A context is kept if its next symbols diverge from those of its suffix by so many nats an occurrence, each left out in turn.
GAIN = 0.02
#: Weights of the shorter context's distribution, as shares of a context's occurrences; the tests choose one for each context.
RATES = (1 / 64, 1 / 16, 1 / 4, 1.0, 4.0)
#: Sums of gains are whole numbers of 1e-6, which add up to the same in any order; log probabilities travel in thousandths.
UNIT, THOUSAND = 1e6, 1000.0
#: Occurrences of a context that one part counts, about.
HOT = 200_000
#: The end of a document, as a word; the start, as a context alone.
END, START = " ", np.int64(1) << 62

PAIRS, CONTEXTS, GAINS, KEPT, TOTALS = range(5)
ROWS = "kind int, to long, block long, part long, data binary"


def squeeze(**columns) -> bytes:
    """Columns as compressed Arrow bytes; numbers with their bytes sorted by place, which compresses well."""
    sink = pa.BufferOutputStream()
    arrays, names = [], []
    for name, c in columns.items():
        if isinstance(c, np.ndarray):
            names.append(f"{c.dtype.str}:{len(c)}:{name}")
            flat = np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.itemsize)
            arrays.append(pa.array([flat.T.tobytes()], pa.large_binary()))
        else:
            names.append(f"words::{name}")
            arrays.append(pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c))
    batch = pa.record_batch(arrays, names)
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def spread(data: bytes) -> dict:
    """The columns of :func:`squeeze`."""
    batch, out = pa.ipc.open_stream(data).read_next_batch(), {}
    for name, c in zip(batch.schema.names, batch.columns, strict=True):
        kind, n, name = name.split(":")
        if kind == "words":
            out[name] = c.flatten()
        else:
            flat = np.frombuffer(c[0].as_buffer(), np.uint8)
            out[name] = np.ascontiguousarray(flat.reshape(-1, int(n)).T).view(kind).reshape(-1) if int(n) else np.empty(0, kind)
    return out


def rows(out: list[tuple]) -> pa.Table:
    kinds = pa.schema([("kind", pa.int32()), ("to", pa.int64()), ("block", pa.int64()), ("part", pa.int64()), ("data", pa.binary())])
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), kinds, strict=True)], schema=kinds) if out else kinds.empty_table()


def words_of(texts: pa.Array):
    """Distinct words, each token's word, and the tokens before each document.

    The most frequent words come first, so that most tokens are numbers of a byte or two, and are alphabetical like the others, which
    compresses well.
    """
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat, ends = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    real = pc.greater(pc.binary_length(flat), 0)  # white space at either end leaves empty strings
    before = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])
    coded = flat.filter(real).dictionary_encode()
    often = np.argsort(-np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary)), kind="stable")
    tier = np.zeros(len(often), np.int8)
    tier[often[1 << 8 :]], tier[often[1 << 16 :]] = 1, 2
    order = pc.sort_indices(coded.dictionary).to_numpy()
    order = order[np.argsort(tier[order], kind="stable")]
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order))
    return coded.dictionary.take(pa.array(order)), place[coded.indices.to_numpy()], before[ends - ends[0]]


def placed(to: np.ndarray, parts: int):
    """What goes to each part, in the order at hand, and where each part begins."""
    order = np.argsort(to.astype(np.uint16) if parts <= 1 << 16 else to, kind="stable")
    return order, np.concatenate([[0], np.cumsum(np.bincount(to, minlength=parts))])


def deal(out: list, kind: int, block: int, to: np.ndarray, parts: int, columns: dict) -> None:
    """Add a row for each part that gets anything; a part's rows keep their order."""
    order, ends = placed(to, parts)
    for p in np.flatnonzero(np.diff(ends)):
        at = order[ends[p] : ends[p + 1]]
        out.append((kind, int(p), block, -1, squeeze(**{n: c.take(pa.array(at)) if isinstance(c, pa.Array) else c[at] for n, c in columns.items()})))


def dealt(answers: dict[int, dict], to: np.ndarray, parts: int, name: str, kind: type) -> np.ndarray:
    """A column of the answers of all parts in the order in which the block asked."""
    out = np.zeros(len(to), kind)
    if len(to):
        out[placed(to, parts)[0]] = np.concatenate([answers[p][name] for p in sorted(answers)])
    return out


def numbered(answer: dict, least: int) -> dict:
    """Only what occurs often enough has an id; the others get -1."""
    ids = np.full(len(answer["n"]), -1, np.int64)
    ids[answer["n"] >= least] = answer["id"]
    return answer | {"id": ids}


def hashed(*columns: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = np.zeros(len(columns[0]), np.uint64)
        for c in columns:
            h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + c.astype(np.int64).view(np.uint64))
    return h


def word_parts(words: pa.Array, parts: int) -> np.ndarray:
    return (pd.util.hash_array(words.to_numpy(zero_copy_only=False), categorize=False) % np.uint64(parts)).astype(np.int64) if len(words) else np.empty(0, np.int64)


def vocabulary(part: np.ndarray, count: np.ndarray, size: np.ndarray, tokens: int, words: int) -> tuple:
    """What a :class:`Vocabulary` holds, from how many words of each count each part has."""
    order = np.lexsort((part, -count))
    begin = (np.cumsum(size[order]) - size[order]).astype(np.int64)
    counts, first = np.unique(-count[order], return_index=True)
    wide = int(count.max()) + 1
    key = part[order] * wide + count[order]
    by_key = np.argsort(key)
    return -counts, begin[first], key[by_key], begin[by_key], wide, tokens + words + 1.0


class Vocabulary:
    """Numbers of all words in order of their counts; a number tells its count.

    Words that occur equally often follow one another by part, and within a part as the part lists them (their serial).
    """

    def __init__(self, counts: np.ndarray, firsts: np.ndarray, keys: np.ndarray, begins: np.ndarray, wide: int, whole: float):
        self.counts, self.firsts, self.keys, self.begins, self.wide, self.whole = counts, firsts, keys, begins, wide, whole

    def number(self, part: np.ndarray, count: np.ndarray, serial: np.ndarray) -> np.ndarray:
        return self.begins[np.searchsorted(self.keys, part * self.wide + count)] + serial

    def root(self, number: np.ndarray) -> np.ndarray:
        """What the root gives the words of these numbers, in thousandths."""
        return thousandths(np.log((self.counts + 1.0) / self.whole))[np.searchsorted(self.firsts, number, side="right") - 1]


def thousandths(log_p: np.ndarray) -> np.ndarray:
    return np.rint(-THOUSAND * log_p).astype(np.uint16)


class Block:
    """A block's documents: tokens as numbers of its own words, the end of each document included."""

    def __init__(self, folder: str, block: int, parts: int, least: int, most: int = HOT):
        self.folder, self.block, self.parts, self.least, self.most = folder, block, parts, least, most
        held = spread(self.read("words"))
        self.words = pa.concat_arrays([held["words"], pa.array([END])])
        self.doc_id, self.known, self.train = held["doc_id"], held["known"].astype(bool), held["train"].astype(bool)
        n = len(self.doc_id)
        self.ends = held["before"][1:] + np.arange(n)  # place of each document's end
        self.starts = np.concatenate([[0], self.ends + 1])[:n]
        self.seq = np.full(len(held["token"]) + n, len(self.words) - 1, np.int64)
        mine = np.ones(len(self.seq), bool)
        mine[self.ends] = False
        self.seq[mine] = held["token"]
        self.of = np.repeat(np.arange(n), self.ends - self.starts + 1)

    def read(self, name: str) -> bytes:
        files, root = place(self.folder)
        with files.open_input_file(f"{root}/{name}-{self.block:016x}.bin") as f:
            return f.read()

    def keep(self, name: str, data: bytes) -> None:
        put(self.folder, f"{name}-{self.block:016x}.bin", [data])

    def ask_words(self) -> list[tuple]:
        n = np.bincount(self.seq[self.train[self.of]], minlength=len(self.words))
        out: list[tuple] = []
        deal(out, PAIRS, self.block, word_parts(self.words, self.parts), self.parts, {"words": self.words, "n": n.astype(np.int32)})
        return out

    def begin(self, totals: tuple[int, int, int], answer: dict) -> None:
        """Log probability of every token by the root, from the counts of the block's words; then the contexts of one word."""
        self.root = thousandths(np.log((answer["n"] + 1.0) / (totals[0] + totals[1] + 1.0)))
        n_tokens, n_words, self.n_docs = totals
        self.count, self.ids, self.level = answer["n"], answer["id"], 1
        self.log_p = np.log((self.count + 1.0) / (n_tokens + n_words + 1.0))[self.seq]
        self._next(np.where(self.count >= self.least, self.ids, -1)[self.seq], self.count[self.seq])

    def _next(self, child: np.ndarray, seen: np.ndarray) -> None:
        """Contexts of this level, which are what each token's predecessor continued, and the distinct (context, word) pairs."""
        state, n = np.full(len(self.seq), -1, np.int64), np.zeros(len(self.seq), np.int64)
        state[1:], n[1:] = child[:-1], seen[:-1]
        # The document's start is a context of the first level.
        state[self.starts], n[self.starts] = (START, self.n_docs) if self.level == 1 and self.n_docs >= self.least else (-1, 0)
        self.at = np.flatnonzero(state >= 0)
        which, self.contexts = pd.factorize(state[self.at])
        code, pairs = pd.factorize(which * np.int64(len(self.words)) + self.seq[self.at])
        context, word = np.divmod(pairs, len(self.words))
        order = np.argsort(context * (self.ids.max() + 1) + self.ids[word])  # a context's pairs lie together, frequent words first
        place = np.empty(len(pairs), np.int64)
        place[order] = np.arange(len(pairs))
        self.pair, self.context = place[code], context[order]
        self.first = np.empty(len(pairs), np.int64)
        self.first[self.pair] = self.at  # any token of the pair
        self.state, self.n = state[self.first], n[self.first]

    def advance(self, answer: dict) -> None:
        """Mix the kept contexts' counts with what their suffixes give, and go on to contexts of one word more."""
        rate, p = answer["rate"][self.context], np.exp(self.log_p[self.first])
        back = np.array([*RATES, 0.0])[rate] * self.n
        kept = rate >= 0
        new = self.log_p[self.first]
        new[kept] = np.log((answer["n"][kept] + back[kept] * p[kept]) / (self.n[kept] + back[kept]))
        self.log_p[self.at] = new[self.pair]
        child, seen = np.full(len(self.seq), -1, np.int64), np.zeros(len(self.seq), np.int64)
        child[self.at], seen[self.at] = np.where(answer["n"] >= self.least, answer["id"], -1)[self.pair], answer["n"][self.pair]
        self.level += 1
        self._next(child, seen)

    def own(self) -> np.ndarray:
        """How often each pair of this level occurs in the block's training documents."""
        return np.bincount(self.pair[self.train[self.of][self.at]], minlength=len(self.first))

    def runs(self):
        """For each part that gets any: it, its pairs, and which of these begin a context's run."""
        order, ends = placed(self.pair_parts(), self.parts)
        for p in np.flatnonzero(np.diff(ends)):
            at = order[ends[p] : ends[p + 1]]
            yield int(p), at, np.flatnonzero(np.diff(self.context[at], prepend=-1))

    def ask(self) -> list[tuple]:
        """The pairs of this level to the parts that count them, the contexts of many parts to those that test them.

        A pair's probability by the suffix travels as what it differs by from that of the root, which the word's number tells.
        """
        n, out = self.own().astype(np.int32), []
        word = self.seq[self.first]
        w, q = self.ids[word], thousandths(self.log_p[self.first]) - self.root[word]
        for p, at, new in self.runs():
            runs = np.diff(new, append=len(at)).astype(np.int32)  # a context once, with the length of its run
            step = np.diff(w[at], prepend=0)  # words ascend within a run
            step[new] = w[at[new]]
            total = self.n[at[new]]
            data = squeeze(s=self.state[at[new]], total=np.where(total < self.most, 0, total), run=runs, step=step, n=n[at], q=q[at])
            out.append((PAIRS, p, self.block, -1, data))
        deal(out, CONTEXTS, self.block, self.context_parts(), self.parts, {"s": self.contexts[self.hot()]})
        return out

    def hear(self, pairs: dict[int, dict], verdicts: dict[int, dict]) -> dict:
        """Counts, numbers and verdicts of this level from the answers of the parts."""
        own, rate, found = self.own(), np.full(len(self.contexts), -1, np.int8), {}
        for p, at, new in self.runs():
            found[p] = numbered(pairs[p] | {"n": pairs[p]["n"] + own[at]}, self.least)
            rate[self.context[at[new]]] = pairs[p]["rate"]
        to = self.pair_parts()
        here = {c: dealt(found, to, self.parts, c, np.int64) for c in ("n", "id")}
        rate[self.hot()] = dealt(verdicts, self.context_parts(), self.parts, "rate", np.int8)
        return here | {"rate": rate}

    def hot(self) -> np.ndarray:
        """The contexts whose pairs are spread over parts."""
        total = np.zeros(len(self.contexts), np.int64)
        total[self.context] = self.n
        return np.flatnonzero(total >= self.most)

    def pair_parts(self) -> np.ndarray:
        """Pairs are dealt by context; contexts that occur often are spread over the more parts, so that none fills a part."""
        salt = hashed(self.ids[self.seq[self.first]]) % (self.n // self.most + 1).astype(np.uint64)
        return (hashed(self.state, salt) % np.uint64(self.parts)).astype(np.int64)

    def context_parts(self) -> np.ndarray:
        return (hashed(self.contexts[self.hot()]) % np.uint64(self.parts)).astype(np.int64)


def gains(n: np.ndarray, total: np.ndarray, log_p: np.ndarray) -> np.ndarray:
    """For each rate, what a pair adds to the log likelihood of its context over that of the suffix, every occurrence left out in turn."""
    p, out = np.exp(log_p), []
    for r in RATES:
        back = r * total
        out.append(n * (np.log((n - 1) / p + back) - np.log(total - 1 + back)))
    return np.rint(np.stack(out, axis=1) * UNIT).astype(np.int64)


def count_words(part: int, asked: list[dict]) -> list[tuple]:
    codes = pa.concat_arrays([a["words"] for a in asked]).dictionary_encode()
    code = codes.indices.to_numpy().astype(np.int64)
    n = np.bincount(code, np.concatenate([a["n"] for a in asked]), len(codes.dictionary)).astype(np.int64)  # whole numbers below 2^53
    order = np.argsort(-n, kind="stable")
    count, first, size = np.unique(-n[order], return_index=True, return_counts=True)
    serial = np.empty(len(n), np.int64)  # among the part's words of the same count
    serial[order] = np.arange(len(n)) - np.repeat(first, size)
    out, at = [(TOTALS, 0, -1, part, squeeze(count=-count, size=size.astype(np.int64)))], 0
    for a in asked:
        mine = code[at : at + len(a["n"])]
        out.append((PAIRS, -1, a["block"], part, squeeze(n=n[mine], serial=serial[mine])))
        at += len(a["n"])
    return out


def count_pairs(part: int, asked: list[dict], parts: int, least: int, least_gain: float, vocabulary: Vocabulary) -> list[tuple]:
    step, n, q = (np.concatenate([a[c] for a in asked]) for c in ("step", "n", "q"))
    own, states = pd.factorize(np.concatenate([a["s"] for a in asked]))
    runs = np.concatenate([a["run"] for a in asked])
    total = np.empty(len(states), np.int64)
    total[own] = np.concatenate([a["total"] for a in asked])
    sums, new = np.cumsum(step), np.cumsum(runs) - runs
    state, (word, words) = np.repeat(own, runs), pd.factorize(sums - np.repeat(sums[new] - step[new], runs))
    code, pairs = pd.factorize(state * np.int64(len(words)) + word)
    count = np.bincount(code, n, len(pairs)).astype(np.int64)  # whole numbers below 2^53
    log_p = np.empty(len(pairs))
    log_p[code] = (q + vocabulary.root(words)[word]) / -THOUSAND  # the same for all blocks that ask
    which, seen = pairs // len(words), count > 0
    whole = total == 0  # all occurrences of a context that is not spread are here, each of them before a word
    total[whole] = np.bincount(which, count, len(states)).astype(np.int64)[whole]
    gain = np.zeros((len(states), len(RATES)), np.int64)
    np.add.at(gain, which[seen], gains(count[seen], total[which[seen]], log_p[seen]))
    rate = np.where(whole, verdict(gain, total, least_gain), -1).astype(np.int8)
    out, at, run = [], 0, 0
    for a in asked:
        mine = code[at : at + len(a["n"])]
        c = count[mine]
        others = c - a["n"]  # mostly none
        ids = (np.int64(part) << 32) + mine[c >= least]
        answer = squeeze(n=others.astype(np.int32) if not len(c) or c.max() < 1 << 31 else others, id=ids, rate=rate[own[run : run + len(a["run"])]])
        out.append((PAIRS, -1, a["block"], part, answer))
        at, run = at + len(a["n"]), run + len(a["run"])
    cut, gain = np.flatnonzero(~whole), gain[~whole]
    to = (hashed(states[cut]) % np.uint64(parts)).astype(np.int64)
    deal(out, GAINS, -1, to, parts, {"s": states[cut], "total": total[cut], **{f"g{j}": gain[:, j].copy() for j in range(len(RATES))}})
    return out


def verdict(gain: np.ndarray, total: np.ndarray, least_gain: float) -> np.ndarray:
    """The rate that gains most, or -1 if the context isn't kept."""
    gain = gain / UNIT
    return np.where(gain.max(axis=1) >= least_gain * total, gain.argmax(axis=1), -1).astype(np.int8)


def judge_contexts(part: int, gained: list[dict], asked: list[dict], least_gain: float) -> list[tuple]:
    """Whether each context that is spread over parts is kept, and with which weight of its suffix."""
    s = np.concatenate([g["s"] for g in gained] or [np.empty(0, np.int64)])
    states, which = np.unique(s, return_inverse=True)
    gain, total = np.zeros((len(states) + 1, len(RATES)), np.int64), np.ones(len(states) + 1)
    if gained:
        np.add.at(gain, which, np.stack([np.concatenate([g[f"g{j}"] for g in gained]) for j in range(len(RATES))], axis=1))
        total[which] = np.concatenate([g["total"] for g in gained])
    rate = verdict(gain, total, least_gain)
    rate[-1] = -1
    out = []
    for a in asked:
        at = np.searchsorted(states, a["s"])
        hit = states[np.minimum(at, len(states) - 1)] == a["s"] if len(states) else np.zeros(len(a["s"]), bool)
        out.append((KEPT, -1, a["block"], part, squeeze(rate=rate[np.where(hit, at, len(states))])))
    return out


# ---------------------------------------------------------------------------------------------------------------------


def write_blocks(docs: DataFrame, block: int) -> tuple[str, DataFrame]:
    """Write the documents' tokens in blocks of about ``block`` bytes of text into the shared folder; return it and (block, docs, size)."""
    spark = docs.sparkSession
    bound_batches(spark)
    folder = f"{shared_dir(spark)}/suffix-tree-{uuid.uuid4().hex[:12]}"
    STAGED.append(folder)
    train = F.coalesce(fold(F.col("doc_id"), 7) != 2, F.lit(True))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), train.alias("train"), F.coalesce("text", F.lit("")).alias("text"))

    def write(batches):
        part, nth, held, size = TaskContext.get().partitionId(), 0, [], 0

        def close():
            t = pa.Table.from_batches(held).combine_chunks()
            words, token, before = words_of(t["text"].combine_chunks() if t["text"].num_chunks != 1 else t["text"].chunk(0))
            doc_id = t["doc_id"]
            columns = {"words": words, "token": token, "before": before, "doc_id": doc_id.fill_null(0).to_numpy(), "known": doc_id.is_valid().to_numpy().astype(np.uint8)}
            columns["train"] = t["train"].to_numpy().astype(np.uint8)
            put(folder, f"words-{(part << 24) + nth:016x}.bin", [squeeze(**columns)])
            train = columns["train"].astype(bool)
            return pa.record_batch([pa.array([(part << 24) + nth]), pa.array([int(train.sum())]), pa.array([size])], ["block", "docs", "size"])

        for batch in batches:
            at = 0
            ends = np.cumsum(pc.binary_length(batch["text"]).to_numpy())
            while at < batch.num_rows:
                base = int(ends[at - 1]) if at else 0
                stop = max(at + 1, int(np.searchsorted(ends, base + block - size, side="right")))
                held.append(batch.slice(at, stop - at))
                size, at = size + int(ends[stop - 1]) - base, stop
                if size >= block or at < batch.num_rows:
                    yield close()
                    nth, held, size = nth + 1, [], 0
        if held:
            yield close()

    return folder, stage(texts.mapInArrow(write, "block long, docs long, size long"), "suffix-tree-blocks")


def score(docs: DataFrame, depth: int = DEPTH, least: int = LEAST, gain: float = GAIN, block: int = BLOCK, hot: int = HOT) -> DataFrame:
    """Log10 probability of every document by a probabilistic suffix tree over words.

    The root gives every word (its training count + 1) / (N + V + 1); all unknown words are one symbol. A context of up to ``depth``
    words (the document's start counts as one) that occurs ``least`` times is a candidate. It is kept if its next-symbol
    distribution, with every occurrence left out in turn, diverges from that of its longest kept suffix by ``gain`` nats an
    occurrence or more; the weight of the suffix's distribution in its own comes from the same test. A token is scored by the longest kept
    suffix of what precedes it. Kept contexts and counts grow with the corpus: thresholds are absolute, nothing is capped.

    Blocks of documents are written once. For each length of context, blocks send their distinct (context, word) pairs to parts dealt by
    hash, parts count and test them, and counts and verdicts go back to the blocks; a block then looks only at its own answers. Only the
    pairs of contexts that occur ``hot`` times are spread over parts; those contexts are tested on the sums of all parts. Blocks times parts rows travel, so blocks should grow with very large tables.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score. Learns from documents in no held-out fold; those
    without an id are in none. NULL and empty texts are one end. Repeated rows and ids count each. A text longer than a block
    is a block of its own. Without training documents every token has the base probability 1. Other columns are left out. An empty
    table gives an empty result.
    """
    folder, blocks = write_blocks(docs, block)
    n_blocks, n_docs, size = blocks.agg(F.count("*"), F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("size"), F.lit(0))).first()
    n_blocks, parts = max(1, n_blocks), -(-size // block) + 1

    def begin(batches):
        for b in batches:
            for i in b["block"].to_pylist():
                yield from rows(Block(folder, i, parts, least, hot).ask_words()).to_batches()

    def collect(t: pa.Table, kind: int) -> list[dict]:
        mine = t.filter(pc.equal(t["kind"], kind))
        got = sorted(zip(mine["block"].to_pylist(), mine["part"].to_pylist(), mine["data"].to_pylist(), strict=True))
        return [{"block": b, "part": p} | spread(d) for b, p, d in got]

    def counting(level: int, held):
        def count(key, t):
            part, asked = key[0].as_py(), collect(t, PAIRS)
            out = [] if not asked else count_words(part, asked) if level == 0 else count_pairs(part, asked, parts, least, gain, Vocabulary(*held.value))
            lists = t.filter(pc.equal(t["kind"], CONTEXTS))
            return pa.concat_tables([rows(out), lists.select(rows([]).schema.names).cast(rows([]).schema)])

        return count

    def judge(key, t):
        return rows(judge_contexts(key[0].as_py(), collect(t, GAINS), collect(t, CONTEXTS), gain))

    def walk(key, t, level: int, totals, held) -> Block:
        """The block with the answers of a level, which it keeps, and of all before it."""
        b = Block(folder, key[0].as_py(), parts, least, hot)
        pairs, verdicts = ({a["part"]: a for a in collect(t, k)} for k in (PAIRS, KEPT))
        if level:
            first = spread(b.read("answers-0"))
        else:
            to = word_parts(b.words, parts)
            n, serial = (dealt(pairs, to, parts, c, np.int64) for c in ("n", "serial"))
            first = here = {"n": n, "id": Vocabulary(*held.value).number(to, n, serial)}
        b.begin(totals, first)
        for k in range(1, level):
            b.advance(numbered(spread(b.read(f"answers-{k}")), least))
        if level:
            here = b.hear(pairs, verdicts)
        if level < depth:
            b.keep(f"answers-{level}", squeeze(**here | {"id": here["id"][here["id"] >= 0]}))
        if level:
            b.advance(here)
        return b

    def asking(level: int, totals, held):
        return lambda key, t: rows(walk(key, t, level, totals, held).ask())

    def finish(totals, held):
        def results(key, t):
            b = walk(key, t, depth, totals, held)
            n_tokens, n_words, _ = totals
            count = b.count[b.seq]
            base = np.log10((b.count + 1.0) / (n_tokens + n_words + 1.0))[b.seq]
            add = lambda x: np.add.reduceat(x, b.starts)  # noqa: E731  every document has its end
            cols = [
                pa.array(b.doc_id, mask=~b.known), pa.array(~b.train), pa.array(b.ends - b.starts + 1, pa.int64()), pa.array(add((count > 0).astype(np.int64))),
                pa.array(np.full(len(b.doc_id), n_tokens, np.int64)), pa.array(add(base)), pa.array(add(b.log_p / np.log(10.0))),
            ]
            return pa.table(cols, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

        return results

    # Payloads are small for the work they mean, so that partitions are as many as blocks or parts and not merged by size.
    by = lambda df, key: df.repartition(n_blocks if key == "block" else parts, key).groupBy(key)
    # A block's own row always comes along, as it may have nothing to ask.
    none = lambda kind: F.lit(-1).cast(kind)
    every = blocks.select(none("int").alias("kind"), none("long").alias("to"), "block", none("long").alias("part"), F.lit(b"").alias("data"))
    asked = blocks.select("block").repartition(n_blocks).mapInArrow(begin, ROWS)
    totals, held = (0, 0, n_docs), None
    for level in range(depth + 1):
        counted = stage(by(asked, "to").applyInArrow(counting(level, held), ROWS), f"suffix-tree-counts-{level}")
        answers = counted.where(F.col("kind") == PAIRS).unionByName(every)
        if level == 0:
            # How many words of each count each part has: as large as the distinct counts.
            sizes = sorted((r["part"], spread(r["data"])) for r in counted.where(F.col("kind") == TOTALS).collect())
            part = np.repeat(np.array([p for p, _ in sizes], np.int64), [len(x["size"]) for _, x in sizes])
            count, size = (np.concatenate([np.empty(0, np.int64), *(x[c] for _, x in sizes)]) for c in ("count", "size"))
            totals = (int(count @ size), int(size[count > 0].sum()), n_docs)
            if len(count):
                held = docs.sparkSession.sparkContext.broadcast(vocabulary(part, count, size, *totals[:2]))
        else:
            tests = counted.where(F.col("kind").isin(GAINS, CONTEXTS))
            answers = answers.unionByName(by(tests, "to").applyInArrow(judge, ROWS))
        if level < depth:
            asked = by(answers, "block").applyInArrow(asking(level, totals, held), ROWS)
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return by(answers, "block").applyInArrow(finish(totals, held), schema)
