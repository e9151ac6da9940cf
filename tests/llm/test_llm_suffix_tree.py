"""Scores of the suffix tree against a plain one."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from aeolis.llm import suffix_tree as st
from aeolis.session import STAGED

START, END = "<s>", "</s>"


def tokens(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower), END]


def held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def brute(rows, depth, least, gain):
    docs = [(i, tokens(t), held_out(i)) for i, t in rows]
    words, after = Counter(), defaultdict(Counter)
    for _, seq, out in docs:
        if not out:
            words.update(seq)
            whole = (START, *seq)
            for n in range(1, depth + 1):
                for j in range(max(1, n), len(whole)):
                    after[whole[j - n : j]][whole[j]] += 1
    n_tokens, n_words = sum(words.values()), len(words)
    root = lambda w: math.log((words[w] + 1) / (n_tokens + n_words + 1))
    kept = {}

    def log_p(context, word):
        """By the longest kept suffix of ``context``."""
        for at in range(len(context)):
            s = context[at:]
            if s in kept:
                back, total = kept[s] * sum(after[s].values()), sum(after[s].values())
                return math.log((after[s][word] + back * math.exp(log_p(s[1:], word))) / (total + back))
        return root(word)

    for n in range(1, depth + 1):
        for s in [s for s in after if len(s) == n]:
            total = sum(after[s].values())
            if total >= least:
                sums = [0.0] * len(st.RATES)
                for w, c in after[s].items():
                    p = math.exp(-round(-1000 * log_p(s[1:], w)) / 1000)  # tests read thousandths
                    for j, r in enumerate(st.RATES):
                        sums[j] += round(c * (math.log((c - 1) / p + r * total) - math.log(total - 1 + r * total)) * st.UNIT) / st.UNIT
                if max(sums) >= gain * total:
                    kept[s] = st.RATES[max(range(len(sums)), key=lambda j: (sums[j], -j))]
    out = []
    for i, seq, held in docs:
        whole = (START, *seq)
        score = sum(log_p(whole[max(0, j - depth) : j], whole[j]) for j in range(1, len(whole))) / math.log(10)
        base = sum(root(w) for w in seq) / math.log(10)
        out.append((i, held, len(seq), sum(words[w] > 0 for w in seq), n_tokens, base, score))
    return out, kept


def same(got, want):
    key = lambda r: ((r[0] is not None, r[0] or 0), r[2], r[3], round(r[5], 6), round(r[6], 6))
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for a, b in zip(got, want, strict=True):
        assert a[5] == pytest.approx(b[5], rel=1e-9, abs=1e-9) and a[6] == pytest.approx(b[6], rel=1e-6, abs=1e-6)


def language(n, seed=1):
    """Documents of a chain of words in which two words back matter."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(12)]
    rows = []
    for i in range(n):
        seq = [rng.choice(words)]
        while len(seq) < 60 and rng.random() > 0.02:
            seq.append(rng.choice(words) if rng.random() < 0.3 else words[(int(seq[-1][1:]) * 5 + (int(seq[-2][1:]) if len(seq) > 1 else 0)) % 12])
        rows.append((i, " ".join(seq)))
    return rows


def test_words_are_those_of_the_contract():
    texts = ["  A b\tÄ c ", "", " ", "x\x1cy\xa0z\x0bÉ\r\n\n B", "a" * 50, "\x00 q"]
    words, token, before = st.words_of(pa.array(texts))
    names = words.to_pylist()
    assert [[names[t] for t in token[a:b]] for a, b in zip(before, before[1:])] == [tokens(t)[:-1] for t in texts]
    assert st.words_of(pa.array(texts).slice(3))[2].tolist() == [0, 3, 4, 6]


def test_columns_survive_squeezing():
    columns = {"a": np.arange(5) - 2, "b": np.array([1.5, -2], np.float32), "c": np.empty(0, np.int8), "w": pa.array(["x", "", "é"])}
    back = st.spread(st.squeeze(**columns))
    assert all(np.array_equal(back[k], v) and back[k].dtype == v.dtype for k, v in columns.items() if k != "w") and back["w"].to_pylist() == ["x", "", "é"]


@pytest.mark.parametrize("block, depth", [(1 << 24, 3), (700, 3), (700, 1)])
def test_scores_equal_a_plain_tree(spark, block, depth):
    rows = language(150)
    want, kept = brute(rows, depth, 20, 0.02)
    assert {len(s) for s in kept} == set(range(1, depth + 1))
    got = st.score(spark.createDataFrame(rows, "doc_id long, text string"), depth, 20, 0.02, block).collect()
    same(got, want)
    held = [r for r in got if r["held_out"]]
    # One word back alone tells next to nothing here.
    assert depth == 1 or sum(r["score"] for r in held) > 0.9 * sum(r["base_score"] for r in held)


@pytest.mark.parametrize("hot, kinds", [(st.HOT, {st.PAIRS}), (40, {st.PAIRS, st.GAINS, st.CONTEXTS})])
def test_only_contexts_of_many_parts_are_tested_apart(spark, hot, kinds):
    """Other contexts are judged by the part that counts their pairs: neither their list nor their gains travel."""
    rows, before = language(150), len(STAGED)
    same(st.score(spark.createDataFrame(rows, "doc_id long, text string"), 2, 20, 0.02, 700, hot).collect(), brute(rows, 2, 20, 0.02)[0])
    for level in (1, 2):
        [path] = [p for p in STAGED[before:] if f"suffix-tree-counts-{level}-" in p]
        assert {r["kind"] for r in spark.read.parquet(path).select("kind").distinct().collect()} == kinds


def test_numbers_of_words_tell_their_counts():
    rng = np.random.default_rng(3)
    part = np.repeat(np.arange(4), 50)
    n = rng.integers(0, 9, 200) ** 3
    keys, size = np.unique(np.stack([part, n]), axis=1, return_counts=True)
    words = st.Vocabulary(*st.vocabulary(keys[0], keys[1], size, int(n.sum()), int((n > 0).sum())))
    serial = np.array([np.sum((part[:i] == part[i]) & (n[:i] == n[i])) for i in range(200)])
    ids = words.number(part, n, serial)
    assert sorted(ids) == list(range(200))
    assert (np.diff(n[np.argsort(ids)]) <= 0).all()
    root = np.log((n + 1.0) / (n.sum() + (n > 0).sum() + 1.0))
    assert (words.root(ids) == st.thousandths(root)).all()


def test_first_contexts_send_no_probabilities(spark, monkeypatch):
    """What the root gives a word follows from its number, so that the column is empty of information."""
    texts = pa.array([t for _, t in language(40)])
    words, token, before = st.words_of(texts)
    held = {"words": words, "token": token, "before": before, "doc_id": np.arange(40), "known": np.ones(40, np.uint8), "train": np.ones(40, np.uint8)}
    monkeypatch.setattr(st.Block, "read", lambda self, name: st.squeeze(**held))
    b = st.Block("", 0, 3, 5)
    n = np.bincount(b.seq, minlength=len(b.words))
    b.begin((len(b.seq), len(b.words), 40), {"n": n, "id": np.argsort(np.argsort(-n, kind="stable"))})
    asked = [st.spread(r[4]) for r in b.ask()]
    assert sum(len(a["q"]) for a in asked) == len(b.first) and not any(a["q"].any() for a in asked)


@pytest.mark.parametrize("block", [1 << 24, 300])
def test_odd_rows(spark, edge, edge_rows, empty, block):
    got = st.score(edge, 2, 5, 0.02, block)
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    same(got.collect(), brute([r[:2] for r in edge_rows], 2, 5, 0.02)[0])
    assert st.score(empty).count() == 0


def test_nothing_to_learn_from(spark):
    out = next(i for i in range(100) if held_out(i))
    [row] = st.score(spark.createDataFrame([(out, "a b")], "doc_id long, text string")).collect()
    assert tuple(row) == (out, True, 3, 0, 0, 0.0, 0.0)
