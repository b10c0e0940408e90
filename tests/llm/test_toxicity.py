"""Toxicity: exact inference against enumeration, held-out accuracy, defined results."""

from __future__ import annotations

import itertools
import random
import zlib

import numpy as np

from quillon.llm import toxic_crf
from quillon.llm.common import table


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(0)
    chain = toxic_crf.Chain(np.zeros((3, 4)), rng.normal(size=(2, 2)), 0.3)
    lengths = np.array([3, 0, 1, 6])
    odds = rng.normal(size=int(lengths.sum()))
    got = toxic_crf.forward_backward(odds, lengths, chain)[2]
    at = 0
    for n in lengths.tolist():
        own = odds[at : at + n]
        total, on = 0.0, np.zeros(n)
        for y in itertools.product((0, 1), repeat=n):
            weight = np.exp(sum(o for o, s in zip(own, y, strict=True) if s) + (chain.start * y[0] if n else 0) + sum(chain.transition[a, b] for a, b in zip(y, y[1:], strict=False)))
            total += weight
            on += weight * np.array(y)
        assert np.allclose(got[at : at + n], on / total)
        at += n


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    known = {r["doc_id"]: r["toxic"] for r in table(spark, sf, "labels").collect()}
    rows = toxic_crf.query(spark, sf).collect()
    assert len(rows) == table(spark, sf, "documents").count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
    pairs = [(r["predicted"], known[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in known]
    hit = [p for p, y in pairs if y == 1]
    wrong = [p for p, y in pairs if y == 0]
    assert np.mean(hit) > 0.7 and np.mean(wrong) < 0.02


def fixture(spark):
    rng = random.Random(0)
    words = [f"{a}{b}" for a in ("gar", "bir", "tre", "sun", "win", "sto") for b in ("den", "ds", "es", "ny", "dow", "ne")]
    clean = [" ".join(rng.choices(words, k=20)) for _ in range(200)]
    toxic = [" ".join(w + " " + rng.choice(["idiot", "vile", "liar", "stupid"]) * (k % 6 == 3) for k, w in enumerate(rng.choices(words, k=20))) for _ in range(200)]
    rows = [(k, t) for k, t in enumerate(clean + toxic)]
    docs = spark.createDataFrame([(*r, "x", 0.5) for r in rows], "doc_id long, text string, label string, score double")
    labels = spark.createDataFrame([(k, int(k >= 200)) for k in range(400)] + [(1, None), (None, 1), (2, 7)], "doc_id long, toxic int")
    return docs, labels


def test_odd_rows_and_spans(spark):
    docs, labels = fixture(spark)
    model = toxic_crf.fit(docs, labels)
    odd = [(1, None), (2, ""), (3, "..."), (None, "a vile idiot"), (4, "garden birds " * 20_000 + "vile idiot"), (4, "x"), (5, "İİ birds vile idiot sunny")]
    frame = spark.createDataFrame(odd, "doc_id long, text string")
    got = toxic_crf.score(frame, model).collect()
    assert len(got) == len(odd) and all(0 <= r["score"] <= 1 for r in got)
    by = {r["doc_id"]: r["score"] for r in got}
    assert by[1] == by[2] == by[3] < 0.5
    spans = [tuple(r) for r in toxic_crf.toxic_spans(frame, model).where("doc_id = 5").collect()]
    assert spans and all(odd[6][1][a:b] for _, a, b in spans)
    kept = toxic_crf.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == set(range(200))


def test_a_labelled_identifier_that_repeats_trains_a_bounded_number_of_rows(spark, monkeypatch):
    docs, labels = fixture(spark)
    many = spark.range(3000).selectExpr("150L AS doc_id", "concat('garden birds ', id % 50) AS text", "'x' AS label", "0.5D AS score")
    seen = []
    monkeypatch.setattr(toxic_crf, "TRAIN_DOCS", 60)
    monkeypatch.setattr(toxic_crf, "train", lambda texts, toxic: seen.append((texts, toxic)))
    toxic_crf.fit(docs.unionByName(many), labels)
    texts, toxic = seen[0]
    assert (toxic == 0).sum() == 60 and (toxic == 1).sum() == 60 and len(set(texts)) == len(texts)


def test_blocks_of_windows_give_the_whole_gradient(monkeypatch):
    rng = random.Random(3)
    windows = [[rng.choice("abcdefgh") for _ in range(rng.randrange(1, 9))] for _ in range(50)]
    labels = [np.array([w in "ab" for w in ws]) for ws in windows]
    whole = toxic_crf.train_chain(windows, labels)
    monkeypatch.setattr(toxic_crf, "BLOCK_WINDOWS", 7)
    parts = toxic_crf.train_chain(windows, labels)
    assert np.allclose(whole.weights, parts.weights) and np.allclose(whole.transition, parts.transition) and np.isclose(whole.start, parts.start)


def log_likelihood(windows: list[list[str]], labels: list[np.ndarray], chain: toxic_crf.Chain) -> float:
    """Mean log probability of the labels, by enumeration of all labelings."""
    total = 0.0
    for words, own in zip(windows, labels, strict=True):
        def weight(k: int, word: str) -> float:
            return sum(chain.weights[k][at] for at in toxic_crf._hashed(word))

        odds = [weight(0, w) + (weight(1, words[i - 1]) if i else 0) + (weight(2, words[i + 1]) if i + 1 < len(words) else 0) for i, w in enumerate(words)]

        def logit(y: tuple) -> float:
            return sum(o for o, s in zip(odds, y, strict=True) if s) + chain.start * y[0] + sum(chain.transition[a, b] for a, b in zip(y, y[1:], strict=False))

        every = [logit(y) for y in itertools.product((0, 1), repeat=len(words))]
        total += logit(tuple(int(v) for v in own)) - np.logaddexp.reduce(every)
    return total / len(windows)


def test_training_follows_the_gradient_of_the_likelihood(monkeypatch):
    """Block gradients against differences of the enumerated likelihood."""
    rng = random.Random(4)
    windows = [[rng.choice(["good", "vile", "ab", "cd"]) for _ in range(rng.randrange(1, 6))] for _ in range(6)]
    labels = [np.array([w == "vile" for w in ws]) for ws in windows]
    chain = toxic_crf.Chain(np.random.default_rng(5).normal(size=(3, toxic_crf.HASH)), np.array([[0.1, -0.2], [0.3, 0.4]]), -0.3)
    numbers: dict[str, int] = {}
    words = np.array([numbers.setdefault(w, len(numbers)) for ws in windows for w in ws], dtype=np.int32)
    rows = [toxic_crf._hashed(w) for w in numbers]
    sums = np.array([[chain.weights[k][r].sum() for r in rows] for k in range(3)])
    y, lengths = np.concatenate(labels).astype(float), np.array([len(w) for w in windows])
    per_word, pairs, begin = toxic_crf._gradient(sums, words, y, lengths, chain)
    step, base = 1e-5, log_likelihood(windows, labels, chain)
    for word, n in numbers.items():
        for k in range(3):
            at = toxic_crf._hashed(word)[0]  # the word itself: a feature of no other word here
            chain.weights[k][at] += step
            assert np.isclose((log_likelihood(windows, labels, chain) - base) / step, per_word[k][n] / len(windows), atol=1e-4)
            chain.weights[k][at] -= step
    for a in (0, 1):
        for b in (0, 1):
            chain.transition[a, b] += step
            assert np.isclose((log_likelihood(windows, labels, chain) - base) / step, pairs[2 * a + b] / len(windows), atol=1e-4)
            chain.transition[a, b] -= step
    chain.start += step
    assert np.isclose((log_likelihood(windows, labels, chain) - base) / step, begin / len(windows), atol=1e-4)


def test_without_labels_nothing_is_toxic(spark):
    docs, labels = fixture(spark)
    assert toxic_crf.fit(docs, labels.limit(0)) is None
    assert {r["score"] for r in toxic_crf.score(docs, None).collect()} == {0.0}
    assert toxic_crf.drop_toxic(docs, labels.limit(0)).count() == docs.count()
    assert toxic_crf.score(docs.limit(0), None).count() == 0
