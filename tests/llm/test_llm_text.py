"""Toxicity, language and personal data: the searches against brute force, the models on held-out documents."""

import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest

from aeolis.llm import language, pii, toxicity
from aeolis.llm.common import table

SF = "/root/testdata/sf0.001"


def maximal(scores):
    """All maximal scoring segments by their definition: the best segment, then those of what lies left and right of it."""
    best = None
    for b in range(len(scores)):
        for e in range(b + 1, len(scores) + 1):
            s = sum(scores[b:e])
            if s > 0 and (best is None or s > best[2] or s == best[2] and e - b < best[1] - best[0]):
                best = (b, e, s)
    if best is None:
        return []
    b, e, s = best
    return maximal(scores[:b]) + [best] + [(x + e, y + e, z) for x, y, z in maximal(scores[e:])]


def test_segments_are_all_maximal_ones():
    rng = random.Random(4)
    for _ in range(400):
        scores = [round(rng.gauss(-0.2, 1), 3) for _ in range(rng.randint(0, 14))]
        found = toxicity.segments(np.array(scores))
        assert [(b, e) for b, e, _ in found] == [(b, e) for b, e, _ in maximal(scores)], scores


def test_toxicity_on_held_out(spark):
    sf = SF.replace("0.001", "0.01")
    rows = toxicity.scored_documents(table(spark, sf, "documents"), table(spark, sf, "labels"))
    labels = {r["doc_id"]: r["toxic"] for r in table(spark, sf, "labels").collect()}
    got = [(labels[r["doc_id"]], r["predicted"], r["score"]) for r in rows.collect() if r["doc_id"] in labels and r["held_out"]]
    toxic, clean = [g for g in got if g[0] == 1], [g for g in got if g[0] == 0]
    assert all(0 <= g[2] <= 1 and g[1] == (g[2] >= 0.7) for g in got)
    assert np.mean([a[2] > b[2] for a in toxic for b in clean]) > 0.7  # a few dozen toxic documents to learn from
    assert np.mean([g[1] for g in clean]) < 0.05


def test_toxicity_of_odd_rows(spark, edge, empty, edge_rows, edge_labels):
    model = toxicity.fit(edge, edge_labels)
    out = toxicity.score(edge, model)
    assert [c.lower() for c in out.columns].count("score") == 1 and {"Copy", "rank", "spans", "predicted"} <= set(out.columns)
    rows = out.collect()
    assert len(rows) == len(edge_rows) and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["text"] in (None, "")}) == 1
    assert toxicity.scored_documents(edge, edge_labels.where("toxic = 0")).where("predicted = 1").count() == 0
    assert toxicity.scored_documents(empty, edge_labels.limit(0)).count() == 0


def test_viterbi_is_the_best_labelling():
    rng = np.random.default_rng(1)
    texts = [rng.normal(0, 2, (n, 3)) for n in (5, 0, 7, 1, 4)]
    for path, s in zip(language.viterbi(texts, 1.5), texts, strict=True):
        value = lambda p: sum(s[i][k] for i, k in enumerate(p)) - 1.5 * sum(a != b for a, b in itertools.pairwise(p))  # noqa: B023, E731
        if len(s):
            assert value(path.tolist()) == pytest.approx(max(map(value, itertools.product(range(3), repeat=len(s)))))


def test_language_on_held_out(spark):
    docs = table(spark, SF.replace("0.001", "0.01"), "documents")
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    got = [(truth[r["doc_id"]], r["lang_pred"], r["score"]) for r in language.identified_documents(docs).collect() if r["held_out"]]
    assert np.mean([a == b for a, b, _ in got]) > 0.97 and all(0 <= s <= 1 for *_, s in got)


def test_spans_of_mixed_text(spark):
    docs = table(spark, SF.replace("0.001", "0.01"), "documents")
    model = language.fit(docs)
    pick = {lang: docs.where(f"lang = '{lang}' and length(text) > 2000").first()["text"][:900].rsplit(" ", 1)[0] for lang in ("en", "de")}
    mixed = spark.createDataFrame([(1, f"{pick['en']} {pick['de']}")], "doc_id long, text string")
    row = language.identify(mixed, model).first()
    assert [s["lang"] for s in row["spans"]] == ["en", "de"]
    assert abs(row["spans"][0]["end"] - len(language.words_of(pick["en"]))) <= 3


def test_scripts_narrow():
    rows = [("el", g, 5) for g in language.grams("λογος")] + [("en", g, 5) for g in language.grams("logos")] + [("el", "#greek", 5), ("en", "#latin", 5)]
    model = language.build(rows)
    assert model.words(["λα", "la"]).argmax(axis=1).tolist() == [0, 1] and not model.words(["мир"]).any()


def test_language_of_odd_rows(spark, edge, empty, edge_rows):
    rows = language.identify(edge, language.fit(edge)).collect()
    assert len(rows) == len(edge_rows)
    assert {r["lang_pred"] for r in rows if not r["text"] or not any(map(str.isalpha, r["text"]))} == {"und"}
    assert {r["lang_pred"] for r in rows if r["text"] and any(map(str.isalpha, r["text"]))} <= {"en", "de"}
    assert language.identified_documents(empty).count() == 0
    assert {r["lang_pred"] for r in language.identified_documents(edge.where("lang is null")).collect()} == {"und"}


EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(text):
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d[::-1])) % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]


def test_base_spans():
    rng = random.Random(6)
    for k in range(20_000):
        text = "".join(rng.choices("ab.@1234+ -(_%" if k % 2 else "0123 .-+@a", k=rng.randint(1, 40)))
        assert pii.base_spans(text) == plain_spans(text), text
    assert pii.base_spans("9" * 200_000 + "a" * 200_000 + "@@" + "1" * 200_000) == []  # in linear time


def test_windows_cover_every_marked_word():
    rng = random.Random(7)
    for _ in range(5000):
        text = "".join(rng.choices("ab1@ \n", k=rng.randint(1, 50)))
        words = [m.span() for m in re.finditer(r"\S+", text)]
        found = [w for run in pii.windows(text) for w in run]
        assert found == sorted(found) and set(found) <= set(words), text
        assert {w for w in words if re.search("[0-9@]", text[slice(*w)])} <= set(found), text


def test_field_against_enumeration():
    rng = np.random.default_rng(2)
    e, step = rng.normal(size=(1, 4, 5)), rng.normal(size=(5, 5))
    ways = np.array(list(itertools.product(range(5), repeat=4)))
    value = e[0][np.arange(4), ways].sum(axis=1) + step[ways[:, :-1], ways[:, 1:]].sum(axis=1)
    p = np.exp(value - value.max()) / np.exp(value - value.max()).sum()
    single, pairs, norm = pii.marginals(e, np.array([4]), step)
    assert norm[0] == pytest.approx(np.log(np.exp(value).sum()))
    for t, y in itertools.product(range(4), range(5)):
        assert single[0, t, y] == pytest.approx(p[ways[:, t] == y].sum())
    assert pairs.sum() == pytest.approx(3)
    field = pii.Field({f"{t}": t for t in range(4)}, e[0], step)
    path, _ = field.decode([[[f"{t}"] for t in range(4)]])
    assert path[0].tolist() == ways[value.argmax()].tolist()


def test_field_adds_and_keeps(spark, edge, empty, edge_rows):
    model = pii.fit(edge)
    lines = ["ring 555-867-5309 after noon", "write to ann.b@mail.example.de now", "nothing here at all", "version 3.14.15 of 2024 has 12 parts"]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in pii.find(docs, model, redact=True).collect()}
    assert rows[0]["spans"] == "phone:5:17" and rows[0]["text"] == "ring <PHONE> after noon"
    assert rows[1]["spans"] == "email:9:30" and rows[1]["n_email"] == 1 and rows[2]["spans"] == rows[3]["spans"] == ""
    out = pii.find(edge, model)
    assert [c.lower() for c in out.columns].count("spans") == 1
    found = out.collect()
    assert len(found) == len(edge_rows)
    for r in found:
        want = plain_spans(r["text"] or "")
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in want) for k in pii.KINDS]
        assert set(pii.listed(want).split(",")) - {""} <= set(r["spans"].split(","))
    assert pii.found_documents(empty).count() == 0


def test_long_runs_of_letters_are_read_whole(spark):
    """The language of the many letters behind the first 64 wins; pieces have one script and leave nothing out."""
    rows = [(lang, g, n) for lang, w in (("x", "ab" * 8), ("y", "cd" * 8)) for g, n in Counter(language.grams(w)).items()]
    model = language.build([*rows, ("x", "#latin", 1), ("y", "#latin", 1)])
    got = language.identify(spark.createDataFrame([("ab" * 32 + "cd" * 1000,)], "text string"), model).first()
    assert got["lang_pred"] == "y" and [s["lang"] for s in got["spans"]] == ["x", "y"]
    text = "\u4f60\u597d" * 500 + "hello\u3053\u3093"
    words = language.words_of(text)
    assert "".join(words) == text and words[-2:] == ["hello", "\u3053\u3093"] and max(map(len, words)) <= 64


def test_long_words_are_labelled_whole():
    """What lies behind the first 60 characters of a word reaches the field."""

    class Mails:
        def decode(self, sentences):
            paths = [np.array([int(any(f.startswith("@1") for f in names)) for names in s]) for s in sentences]
            return paths, [np.ones(len(p)) for p in paths]

    text = "see " + "x" * 70 + "," + "y" * 59 + ",q@zz,1 end"
    assert pii.added_spans([text], [[]], Mails()) == [[("email", text.index("q@"), text.index("q@") + 6)]]
    run = [(0, 3), (4, len(text) - 4)]
    cut = pii.pieces(text, run)
    assert "".join(text[b:e] for b, e in cut) == "".join(text[b:e] for b, e in run) and max(e - b for b, e in cut) <= 60
