"""Language identification: scripts narrow the candidates, Viterbi with a switching penalty labels spans of mixed texts."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aeolis.llm.common import bound_batches, fold, stage, text_slices, without

#: Bound of the sample that the model is fitted on: about so many documents of each language, chosen by a hash of the id.
SAMPLE = 1500
#: Cost of changing the language between two words, in units of log-likelihood; what each character n-gram is smoothed with.
SWITCH, SMOOTH = 12.0, 0.5
#: A language writes the scripts that make up at least this share of its letters.
LEAST_SCRIPT = 0.02
#: First and last code point of common scripts.
SCRIPTS = (
    ("latin", 0x0041, 0x024F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x0370, 0x03FF), ("greek", 0x1F00, 0x1FFF), ("cyrillic", 0x0400, 0x052F),
    ("armenian", 0x0530, 0x058F), ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x077F), ("devanagari", 0x0900, 0x097F),
    ("bengali", 0x0980, 0x09FF), ("tamil", 0x0B80, 0x0BFF), ("thai", 0x0E00, 0x0E7F), ("georgian", 0x10A0, 0x10FF),
    ("hangul", 0x1100, 0x11FF), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF), ("hangul", 0xAC00, 0xD7AF), ("han", 0x20000, 0x2FA1F),
)
WORD = re.compile(r"[^\W\d_]+")
#: A text without any of these has Latin letters alone. Letters of a piece: longer runs of letters are several words.
FOREIGN = re.compile("[^\x00-\u024f\u1e00-\u1eff\u2000-\u2bff]")
PIECE = 64


@lru_cache(65_536)
def script(letter: str) -> str:
    point = ord(letter)
    return next((name for name, low, high in SCRIPTS if low <= point <= high), "other")


def cut(word: str) -> list[str]:
    """A run of letters in pieces of one script and of at most ``PIECE`` letters; letters of no listed script stay where they are."""
    out, at, now = [], 0, None
    for i, c in enumerate(word):
        kind = script(c)
        if kind == "other":
            kind = now
        if i - at == PIECE or now is not None and kind != now:
            out.append(word[at:i])
            at = i
        now = kind
    return [*out, word[at:]]


def words_of(text: str) -> list[str]:
    """Runs of letters, lower-cased, long ones and those of several scripts in pieces; numerals that aren't letters don't make a word."""
    low = text.lower()
    found = WORD.findall(low)
    if not text.isascii():
        found = [w for w in found if w.isalpha() or any(map(str.isalpha, w))]
    if max(map(len, found), default=0) > PIECE or not low.isascii() and FOREIGN.search(low):
        found = [p for w in found for p in cut(w)]
    return found


def grams(word: str) -> list[str]:
    """Character trigrams with the word's ends, the last two characters of context each."""
    w = f"  {word} "
    return [w[i : i + 3] for i in range(len(w) - 2)]


@dataclass
class Model:
    """Log-likelihoods of trigrams given their first two characters, a row for each trigram, a column for each language."""

    langs: list[str]
    row: dict[str, int]
    table: np.ndarray
    contexts: dict[str, int]
    floor: np.ndarray
    scripts: dict[str, np.ndarray]
    known: dict[str, int] = field(default_factory=dict)
    able: dict[str, np.ndarray | None] = field(default_factory=dict)

    def __post_init__(self):
        # Trigrams, then their contexts for trigrams never met, then a row of zeros for contexts never met.
        self.rows = np.concatenate([self.table, self.floor, np.zeros((1, len(self.langs)), np.float32)])
        self.scores, self.letters = np.zeros((0, len(self.langs)), np.float32), np.zeros(0, np.int64)
        self.kept = max(20_000, min(600_000, 40_000_000 // (16 + 4 * len(self.langs))))

    def words(self, words: list[str]) -> np.ndarray:
        """Log-likelihoods of the words in each language; languages that don't write a word's script are out."""
        row, contexts, first, none = self.row, self.contexts, len(self.table), len(self.rows) - 1
        at, starts = [], []
        for w in words:
            starts.append(len(at))
            for g in grams(w):
                i = row.get(g)
                if i is None:
                    j = contexts.get(g[:2])
                    i = none if j is None else first + j
                at.append(i)
        out = np.add.reduceat(self.rows[at], starts, axis=0) if words else np.zeros((0, len(self.langs)), np.float32)
        for c in {w[0] for w in words} - self.able.keys():
            self.able[c] = self.scripts.get(script(c))
        for i, w in enumerate(words):
            able = self.able[w[0]]
            if able is None:
                out[i] = 0
            elif not able.all():
                out[i, ~able] = -1e6
        return out

    def numbers(self, words: list[str]) -> np.ndarray:
        """Row of every word in ``scores`` and ``letters``; words not met lately are scored first."""
        met = set(words)
        if len(self.known) + len(met) > self.kept:
            self.known, self.scores, self.letters = {}, self.scores[:0], self.letters[:0]
        new = [w for w in met if w not in self.known]
        if new:
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
            self.scores = np.concatenate([self.scores, self.words(new)])
            self.letters = np.concatenate([self.letters, np.array([len(w) for w in new], np.int64)])
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))


def viterbi(scores: list[np.ndarray], penalty: float) -> list[np.ndarray]:
    """Best language of every word of several texts, in step: one array operation a word, over all texts still running."""
    order = np.argsort([-len(s) for s in scores], kind="stable")
    sizes = np.array([len(scores[i]) for i in order])
    if not len(order) or not sizes[0]:
        return [np.zeros(0, np.int64) for _ in scores]
    first = np.cumsum(sizes) - sizes
    flat = np.concatenate([scores[i] for i in order])
    came = np.zeros(len(flat), np.int16)  # language before, where the best way changes there; else -1
    stay = np.zeros((len(flat), flat.shape[1]), bool)
    live = int((sizes > 0).sum())
    best, ends = flat[first[:live]].astype(np.float64), np.zeros(len(order), np.int64)
    state = best
    for t in range(int(sizes[0])):
        n = int(np.searchsorted(-sizes, -t, side="left"))  # texts with more than t words
        if t:
            done = np.arange(n, len(state))
            ends[done] = state[done].argmax(axis=1)
            state = state[:n]
            at = first[:n] + t
            top = state.argmax(axis=1)
            over = state[np.arange(n), top] - penalty
            keep = state >= over[:, None]
            came[at], stay[at] = top, keep
            state = np.where(keep, state, over[:, None]) + flat[at]
            state -= state.max(axis=1, keepdims=True)
    ends[: len(state)] = state.argmax(axis=1)
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(scores)
    for k, i in enumerate(order):
        size, lang = int(sizes[k]), int(ends[k])
        path = np.empty(size, np.int64)
        # Walk back from change to change: between two changes the language stays.
        end = size
        while end > 0:
            held = stay[first[k] + 1 : first[k] + end, lang]
            breaks = np.flatnonzero(~held)
            begin = int(breaks[-1]) + 1 if len(breaks) else 0
            path[begin:end] = lang
            lang = int(came[first[k] + begin]) if begin else lang
            end = begin
        out[i] = path
    return out


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Fit on documents with a language outside the held-out fold; None if there is none. Rows without id or lang take no part."""
    bound_batches(docs.sparkSession)
    usable = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id"), 4) != 2))
    sizes = stage(usable.groupBy("lang").agg(F.count("*").alias("size")).withColumnRenamed("lang", "of"), "lang-sizes")
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / 1_000_003.0
    chosen = usable.select("doc_id", "text", "lang").withColumn("place", place).join(sizes, F.col("lang") == F.col("of"))
    chosen = chosen.where(F.col("place") < F.lit(float(sample)) / F.col("size")).select("lang", "text")

    def count(batches):
        held: defaultdict[str, Counter] = defaultdict(Counter)
        for b in batches:
            for lang, text in zip(b["lang"].to_pylist(), b["text"].to_pylist(), strict=True):
                for w, n in Counter(words_of(text)).items():
                    for g in grams(w):
                        held[lang][g] += n
                    held[lang][f"#{script(w[0])}"] += n
        rows = [(lang, g, n) for lang, c in held.items() for g, n in c.items()]
        cols = list(zip(*rows, strict=True)) or [(), (), ()]
        yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64()), strict=True)], ["lang", "g", "n"])

    counted = chosen.mapInArrow(count, "lang string, g string, n long").groupBy("lang", "g").agg(F.sum("n").alias("n"))
    rows = counted.toArrow()  # trigrams of the bounded sample
    return build(list(zip(*(rows[c].to_pylist() for c in ("lang", "g", "n")), strict=True)))


def build(rows: list[tuple[str, str, int]]) -> Model | None:
    langs = sorted({r[0] for r in rows})
    if not langs:
        return None
    column = {name: i for i, name in enumerate(langs)}
    row: dict[str, int] = {}
    contexts: dict[str, int] = {}
    for _, g, _ in rows:
        if g[0] != "#" or len(g) == 3 and g[1] == " ":
            row.setdefault(g, len(row))
            contexts.setdefault(g[:2], len(contexts))
    n, c, by = np.zeros((len(row), len(langs))), np.zeros((len(contexts), len(langs))), {}
    for lang, g, k in rows:
        if g in row:
            n[row[g], column[lang]] += k
            c[contexts[g[:2]], column[lang]] += k
        else:
            by.setdefault(g[1:], np.zeros(len(langs)))[column[lang]] += k
    letters = len({g[2] for g in row}) + 1
    whole = c + SMOOTH * letters
    of = np.array([contexts[g[:2]] for g in row], np.int64)
    total = np.sum(list(by.values()), axis=0)
    scripts = {s: v >= LEAST_SCRIPT * total for s, v in by.items() if (v >= LEAST_SCRIPT * total).any()}
    return Model(langs, row, np.log((n + SMOOTH) / whole[of]).astype(np.float32), contexts, np.log(SMOOTH / whole).astype(np.float32), scripts)


def identify(docs: DataFrame, model: Model | None, penalty: float = SWITCH) -> DataFrame:
    """``docs`` with lang_pred, score and spans (lang, begin, end; in words of letters, of which long runs
    without a space and those of several scripts make several).

    lang_pred is the language of most letters (ties: the first in alphabetical order), score its share of the letters, scaled by
    how sure the words in its spans are of it against the runner-up. Texts that are NULL or have no letter get ``und`` and score
    0, as does everything without a model. Only the text is read. Other columns are kept, except those of these names.
    """
    bound_batches(docs.sparkSession)
    base = without(docs, ["lang_pred", "score", "spans"])
    kept = base.columns
    text = next((c for c in kept if c.lower() == "text"), None)
    parts = (model.langs, model.row, model.table, model.contexts, model.floor, model.scripts) if model else None

    def run(batches):
        own = Model(*parts) if parts else None
        for b in text_slices(batches, text, 2_000_000):
            texts = b[text].to_pylist()
            found = [words_of(t or "") for t in texts] if own else [[] for _ in texts]
            cuts = np.cumsum([len(ws) for ws in found])[:-1] if found else []
            at = own.numbers([w for ws in found for w in ws]) if own else np.zeros(0, np.int64)
            scores = np.split(own.scores[at], cuts) if own else [np.zeros((0, 1))] * len(texts)
            sizes = np.split(own.letters[at], cuts) if own else scores
            out = [decide(own, p, s, z) if len(p) else ("und", 0.0, []) for p, s, z in zip(viterbi(scores, penalty), scores, sizes, strict=True)]
            kinds = (pa.string(), pa.float64(), pa.list_(pa.struct([("lang", pa.string()), ("begin", pa.int64()), ("end", pa.int64())])))
            cols = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], names=[*kept, "lang_pred", "score", "spans"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields)
    return base.mapInArrow(run, schema + ", lang_pred string, score double, spans array<struct<lang:string,begin:long,end:long>>")


def decide(model: Model, path: np.ndarray, scores: np.ndarray, sizes: np.ndarray) -> tuple[str, float, list[dict]]:
    weight = np.bincount(path, weights=sizes, minlength=len(model.langs))
    lang = int(weight.argmax())
    sums = scores[path == lang].sum(axis=0)
    rival = np.delete(sums, lang).max() if len(sums) > 1 else -math.inf
    sure = 1 / (1 + math.exp(-min(50.0, max(-50.0, float(sums[lang] - rival)))))
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(path)) + 1, [len(path)]])
    spans = [{"lang": model.langs[path[i]], "begin": int(i), "end": int(j)} for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
    return model.langs[lang], float(weight[lang] / weight.sum() * sure), spans


def identified_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document (a document without id is never held out)."""
    model = fit(docs)
    rows = docs.select("doc_id", "text", F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"))
    return identify(rows, model).select("doc_id", "held_out", "lang_pred", "score", F.size("spans").alias("n_spans"))
