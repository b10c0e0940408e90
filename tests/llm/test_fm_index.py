"""Decontamination against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest

from quillon.llm import fm_index
from quillon.llm.common import table
from quillon.llm.wavelet import WaveletMatrix

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text: str | None) -> list[str]:
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs: list[tuple], items: list[tuple]) -> list[tuple]:
    windows: dict[tuple, set] = {}
    for item_id, text in items:
        w = split(text)
        for k in range(max(1, len(w) - 7)) if w else ():
            windows.setdefault(tuple(w[k : k + 8]), set()).add("" if item_id is None else str(item_id))
    out = []
    for doc_id, text in docs:
        w, hit, found = split(text), set(), set()
        for size in {len(p) for p in windows}:
            for k in range(len(w) - size + 1):
                if own := windows.get(tuple(w[k : k + size])):
                    hit |= set(range(k, k + size))
                    found |= own
        names = sorted(found)
        out.append((doc_id, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), len(names) >= 2))
    return sorted(out, key=repr)


COLUMNS = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def test_query_on_all_documents(spark, sf_dir):
    docs = [tuple(r) for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    items = [tuple(r) for r in table(spark, sf_dir, "benchmark").select("item_id", "text").collect()]
    got = fm_index.query(spark, sf_dir).select(*COLUMNS).collect()
    assert sorted(map(tuple, got), key=repr) == brute(docs, items)
    assert any(r["n_hit"] for r in got)


def odd(spark) -> tuple:
    rng = random.Random(2)
    words = list("abcdé") + ["A", "B"]
    docs = [(k, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 60)))) for k in range(60)]
    docs += [(100, None), (101, ""), (102, "..."), (None, "a b c d a b c d e"), (7, docs[7][1]), (103, "a " * 60_000), (104, "x-a-b-c-d-x")]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 14)))) for k in range(40)]
    items += [(50, None), (51, ""), (52, "a"), (53, "a"), (None, "a b c d"), (54, "a a a a a a a a a a a a")]
    return docs, items, spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


def test_odd_texts(spark, monkeypatch):
    monkeypatch.setattr(fm_index, "SLICE_PAIRS", 7)
    docs, items, frame, bench = odd(spark)
    rows = fm_index.contamination(frame, bench).collect()
    got = sorted(
        (r["doc_id"], r["n_words"], r["n_hit"], len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), len(r["items"]) >= 2)
        for r in rows
        if r["doc_id"] is not None
    )
    assert got == sorted(r for r in brute(docs, items) if r[0] is not None)
    assert len(rows) == len(docs)
    texts = dict(docs)
    for r in rows:
        if r["doc_id"] is not None:
            text = texts[r["doc_id"]] or ""
            cut = "".join(text[a["end"] : b] for a, b in zip([{"end": 0}, *r["spans"]], [s["start"] for s in r["spans"]] + [len(text)], strict=True))
            assert len(split(text)) - len(split(cut)) == r["n_hit"]
    assert fm_index.contamination(frame.limit(0), bench).count() == 0
    assert {r["n_hit"] for r in fm_index.contamination(frame, bench.limit(0)).collect()} == {0}


def test_decontaminate_cuts_spans_and_drops_contaminated(spark):
    passage = "one two three four five six seven eight nine"
    bench = spark.createDataFrame([(1, passage), (2, "alpha beta gamma delta epsilon zeta eta theta")], "item_id long, text string")
    docs = spark.createDataFrame(
        [(1, f"Keep this. {passage.upper()}! And this.", 0), (2, f"{passage} alpha beta gamma delta epsilon zeta eta theta", 0), (3, None, 0), (4, "clean", 5)],
        "doc_id long, text string, n_chars long",
    )
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in fm_index.decontaminate(docs, bench).collect()}
    assert got == {1: ("Keep this. ! And this.", 22), 3: (None, 0), 4: ("clean", 5)}


@pytest.mark.parametrize("seed", range(4))
def test_index_search_and_locate(seed):
    rng = np.random.default_rng(seed)
    docs = [rng.integers(1, 4, rng.integers(0, 50)).astype(np.uint32) for _ in range(20)]
    index = fm_index.FMIndex(docs, 3)
    for length in (1, 2, 3, 5):
        phrases = rng.integers(1, 4, (30, length))
        low, high = index.search(phrases)
        for p, a, b in zip(phrases, low, high, strict=True):
            want = sorted(int(s) + k for s, d in zip(index.starts, docs, strict=True) for k in range(len(d) - length + 1) if (d[k : k + length] == p).all())
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_wavelet_matrix():
    rng = np.random.default_rng(0)
    values = rng.integers(0, 37, 1000)
    matrix = WaveletMatrix.build(values.astype(np.uint32), 6)
    assert matrix.decode().tolist() == values.tolist()
    assert matrix.access(np.arange(1000))[0].tolist() == values.tolist()
    for v in (0, 5, 36, 40):
        assert matrix.occurrences(v).tolist() == np.flatnonzero(values == v).tolist()
        assert matrix.count(v, 100, 700) == int((values[100:700] == v).sum())
        assert matrix.rank(np.full(3, v), np.array([0, 500, 1000])).tolist() == [int((values[:k] == v).sum()) for k in (0, 500, 1000)]
