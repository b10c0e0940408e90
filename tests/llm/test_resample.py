"""Importance resampling against a plain computation."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import common, resample
from quillon.llm.common import table


def bucket_list(text: str | None) -> list[int]:
    words = re.findall(r"\w+|[^\w\s]+", (text or "").lower())
    mask = (1 << 64) - 1
    h = [zlib.crc32(w.encode()) << 32 | zlib.crc32(w.encode(), 0x5BD1E995) for w in words]
    pairs = []
    for a, b in zip(h, h[1:], strict=False):
        m = (a * 0x9E3779B97F4A7C15 & mask) ^ (b * 0xC2B2AE3D27D4EB4F & mask)
        pairs.append((m ^ m >> 29) % resample.BUCKETS)
    return [x % resample.BUCKETS for x in h] + pairs


def test_weights_and_choice_on_all_documents(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    texts = {r["doc_id"]: bucket_list(r["text"]) for r in docs.collect()}
    quality = {r["doc_id"]: r["quality"] for r in labels.collect()}
    raw, target = Counter(), Counter()
    for i, found in texts.items():
        raw.update(found)
        if quality.get(i) == 1:
            target.update(found)
    s, b = resample.SMOOTHING, resample.BUCKETS
    ratio = [
        math.log((target[k] + s) / (target.total() + s * b)) - math.log((raw[k] + s) / (raw.total() + s * b)) for k in range(b)
    ]
    rows = resample.query(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        found = texts[r["doc_id"]]
        weight = sum(ratio[k] for k in found)
        assert r["n_grams"] == len(found) and r["log_weight"] == pytest.approx(weight, abs=1e-6)
    share = sum(q == 1 for q in quality.values()) / len(quality)
    best = sorted((r["perturbed"] for r in rows), reverse=True)[: round(share * len(rows))]
    assert {r["doc_id"] for r in rows if r["kept"]} == {r["doc_id"] for r in rows if r["perturbed"] >= best[-1]}


@pytest.mark.parametrize("temper", [None, 100])
def test_junk_goes_and_clean_text_stays(spark, temper):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    labels = table(spark, "/root/testdata/sf0.01", "labels")
    fitted = resample.resample(docs, labels.where("doc_id % 2 = 0"), temper=temper).join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    clean = [r["kept"] for r in fitted if r["quality"] == 1]
    junk = [r["kept"] for r in fitted if r["quality"] == 0]
    print(f"temper {temper}: of held-out labels {np.mean(clean):.3f} of the clean and {np.mean(junk):.3f} of the junk documents stay")
    assert np.mean(clean) > 0.9 and np.mean(junk) < 0.3


def test_equal_texts_have_equal_weights_wherever_they_stand(spark):
    text = "some words, and some more of them " * 3
    rows = [(k, text if k % 3 == 0 else f"other {k} " * (k % 17)) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    ratios = np.random.default_rng(0).normal(size=resample.BUCKETS)
    found = {r["log_weight"] for r in resample.log_weights(docs, ratios).where("doc_id % 3 = 0").collect()}
    assert len(found) == 1


@pytest.mark.parametrize("k", [-1, 0, 1, 2, 7, 499, 500, 501])
def test_kth_highest(spark, k):
    rng = np.random.default_rng(k + 1)
    values = [int(v) for v in rng.integers(-(10**14), 10**14, 300)] + [5] * 100 + list(range(100))
    df = spark.createDataFrame([(v,) for v in values], "v long")
    got = resample.kth_highest(df, "v", k)
    ranked = sorted(values, reverse=True)
    assert got == (None if k < 1 else ranked[min(k, len(values)) - 1])


def test_gumbel_noise_is_standard(spark):
    got = np.array([r[0] for r in spark.range(20000).select(resample.gumbel(F.col("id"))).collect()])
    assert abs(got.mean() - 0.5772) < 0.04 and abs(got.var() - math.pi**2 / 6) < 0.1


@pytest.mark.parametrize("limit", [None, 0], ids=["broadcast", "shuffle"])
def test_odd_rows(spark, monkeypatch, limit):
    if limit is not None:
        monkeypatch.setattr(common, "BROADCAST_BYTES", limit)
    schema = "doc_id long, text string, good boolean, perturbed double"
    docs = spark.createDataFrame([(1, None, True, 0.0), (2, "", None, 0.0), (None, "a b", True, 0.0), (3, "x " * 50_000, True, 0.0), (3, "x " * 50_000, True, 0.0)], schema)
    none = spark.createDataFrame([], "doc_id long, quality int, text string")
    rows = resample.resample(docs, none).collect()
    assert len(rows) == 5 and all(r["kept"] and r["log_weight"] == 0 for r in rows)
    assert sorted(r["n_grams"] for r in rows) == [0, 0, 3, 99_999, 99_999]
    labels = spark.createDataFrame([(3, 1), (1, None), (None, 1)], "doc_id long, quality int")
    assert resample.select(docs, labels, share=1.0).count() == 5
    assert resample.select(docs, labels, share=0.0).count() == 0
    assert resample.resample(docs.limit(0), labels).count() == 0
