"""The pipeline's stages against brute force, each on what the one before kept."""

from __future__ import annotations

import hashlib

import corpus_pipeline
from pyspark.sql import functions as F
from quillon.llm import toxic_crf
from quillon.llm.common import table, written

from tests.llm.test_dedup import brute_components, brute_exact, brute_fingerprint, normal
from tests.llm.test_fm_index import brute as brute_hits
from tests.llm.test_tokens import want

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, sf_dir):
    import public_tokenizers
    import sentencepiece

    docs = table(spark, sf_dir, "documents")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept: list[dict] = []
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, sf_dir), f"test-{name}")
        if name != "sentencepiece":
            assert docs.columns == COLUMNS
            kept.append({r["doc_id"]: r["text"] for r in docs.collect()})
    toxic, exact, near, clean = kept
    labels = table(spark, sf_dir, "labels")
    model = toxic_crf.fit(table(spark, sf_dir, "documents"), labels)
    scores = {r["doc_id"]: r["score"] for r in toxic_crf.score(table(spark, sf_dir, "documents"), model).collect()}
    assert toxic == {i: t for i, t in rows.items() if scores[i] < toxic_crf.THRESHOLD}
    assert exact == {i: toxic[i] for i, *_, stays, _ in brute_exact(list(toxic.items())) if stays}
    made = [(i, brute_fingerprint(t)) for i, t in exact.items()]
    assert near == {i: exact[i] for (i, _), c in zip(made, brute_components(made), strict=True) if i == c}
    items = [tuple(r) for r in table(spark, sf_dir, "benchmark").select("item_id", "text").collect()]
    found = brute_hits(list(near.items()), items)
    assert set(clean) == {r[0] for r in found if not r[5]}
    assert all(clean[r[0]] == near[r[0]] for r in found if not r[2])
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in docs.collect()}
    assert got == {i: want(library, t) for i, t in clean.items()}


def test_run_gives_the_last_stage(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def odd_documents(spark, sf_dir):
    """All documents and rows with nulls, repeated rows and identifiers, ties, very long texts; columns with the operators' own names."""
    plain = [tuple(r) for r in table(spark, sf_dir, "documents").select(*COLUMNS).collect()]
    long = " ".join(f"long{k} text{k * 7}" for k in range(60_000))
    odd = [
        (None, None, None, None, None), (None, "", "en", None, 0), (None, None, None, None, None), (9001, None, None, "s", None),
        (9002, "one and the same text of several words here", "en", "s", 1), (9002, "one and the same text of several words here", "en", "s", 1),
        (9002, "another text under the same identifier, quite different", "en", "s", 1), (9003, "one  and the same\ttext of several words here", "en", "s", 1),
        (None, "one and the same text of several words here", "en", "s", 1), (9004, long, "en", "s", len(long)), (9005, long, "en", "s", len(long)),
        (9006, "🙂 " * 2000, "xx", "s", 4000), (None, "a text without any identifier that stays by itself", "en", "s", 1),
    ]
    names = ["digest", "seq", "fp", "hash", "group_digest", "component", "score", "own", "bits", "spans", "ids", "toxic"]
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    frame = spark.createDataFrame(plain + odd, kinds)
    for k, name in enumerate(names):
        frame = frame.withColumn(name, F.concat(F.lit(f"{k}:"), F.coalesce("source", F.lit("none"))))
    return frame, plain + odd


def test_stages_on_odd_rows_and_clashing_columns(spark, sf_dir):
    docs, rows = odd_documents(spark, sf_dir)
    names = docs.columns
    kept: dict[str, list[tuple]] = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, sf_dir), f"odd-{name}")
        if name != "sentencepiece":
            assert docs.columns == names
            found = docs.collect()
            assert all(r[c] == f"{k}:{r['source'] or 'none'}" for r in found for k, c in enumerate(names[5:]))
            kept[name] = [(r["doc_id"], r["text"]) for r in found]
    toxic = kept["toxicity"]
    assert {t for i, t in toxic if i is None or i > 9000} == {t for i, *rest in rows for t in rest[:1] if i is None or i > 9000}
    # Of equal normalised texts one row stays, the smallest identifier, null last.
    first: dict[str, tuple] = {}
    for i, t in toxic:
        body = normal(t)
        if body not in first or (i is None, i or 0) < (first[body] is None, first[body] or 0):
            first[body] = i
    exact = kept["exact_dedup"]
    assert sorted(((i, normal(t)) for i, t in exact), key=repr) == sorted(((i, b) for b, i in first.items()), key=repr)
    # Of near copies one row stays; a row that shares its identifier with a dropped one of other text stays too.
    near = kept["simhash"]
    made = [brute_fingerprint(t) for _, t in exact]
    groups: dict[int, list[tuple]] = {}
    numbered = [(k, f) for k, f in enumerate(made)]
    for (k, _), c in zip(numbered, brute_components(numbered), strict=True):
        groups.setdefault(c, []).append(exact[k])
    want = [min(g, key=lambda r: (r[0] is None, r[0] or 0, hashlib.sha256((r[1] or "").encode()).digest())) for g in groups.values()]
    assert sorted(near, key=repr) == sorted(want, key=repr)
    assert sum(i == 9002 for i, _ in near) == 2
    items = [tuple(r) for r in table(spark, sf_dir, "benchmark").select("item_id", "text").collect()]
    found = brute_hits(list(enumerate(t for _, t in near)), items)
    clean = sorted((near[r[0]][0] for r in found if not r[5]), key=repr)
    assert sorted((i for i, _ in kept["decontaminate"]), key=repr) == clean
    assert sorted((r["doc_id"] for r in docs.collect()), key=repr) == clean


def test_empty_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert docs.count() == 0
