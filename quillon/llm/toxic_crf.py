"""Toxic spans by a linear-chain conditional random field.

Labels are of documents, so token labels are induced first: in a toxic training
document a word is marked if one of its features (the word, a prefix, its end)
occurs in toxic training documents so much more often than in others that the
lower confidence bound of the log odds clears a threshold.  A two-state chain
with features of the word and its neighbours is then trained by the exact
gradient of the conditional likelihood (forward-backward), so that it tags
words by form and context.

Forward-backward marginals of whole texts are aggregated to a document's score
by a small logistic model; words with high marginals give the offending offsets.
The aggregation is fitted on marginals of chains that have not seen the document.

Training uses at most ``TRAIN_DOCS`` rows of each label, those with the smallest
hash of doc_id and, within one doc_id, of the text; equal rows count once.  All
windows of these rows train; gradients are summed over blocks of windows, so that
memory holds one block besides the words.  Scoring reads every document whole.

Defined results: null, empty and wordless texts get the aggregation's score of
no evidence; texts of any length are scored whole; without training rows of both
labels every score is 0; rows with a null label or doc_id don't train; a doc_id
with both labels counts as toxic; repeated rows are scored each by itself; other
columns, whatever their names, are no input of a score and pass ``drop_toxic``
untouched; an empty table gives an empty result.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import fresh_dir, get_bytes, per_text, put_bytes, slices, table, tidied, written

THRESHOLD = 0.7
FOLDS, HELD_OUT = 3, 1
TRAIN_DOCS = 3000
WINDOW = 48
#: Windows of a block of the gradient.
BLOCK_WINDOWS = 3000
#: Hash space of features.
HASH = 1 << 17
#: Induced labels: standard deviations below the log odds, what must remain, documents at least.
BOUND, CLEAR, SUPPORT = 2.5, 0.7, 4
ROUNDS, RATE, DECAY = 12, 0.3, 1e-6
#: Words whose weights a task keeps; words scored together.
CACHE_WORDS = 200_000
CHUNK_WORDS = 500_000
#: Words of training documents scored together on the driver.
TRAIN_WORDS = 150_000
_WORD = re.compile(r"[^\W_]+")


def _lowered(text: str) -> str:
    """Lower case with one code point for each, so that offsets hold for the text itself."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower()[0] for c in text)


def word_features(word: str) -> list[str]:
    """The word, its prefixes of 3 to 6 characters and its last 4."""
    found = [f"={word}"]
    found += [f"^{word[:k]}" for k in range(3, 7) if len(word) > k]
    if len(word) > 4:
        found.append(f"${word[-4:]}")
    return found


def _hashed(word: str) -> list[int]:
    return [zlib.crc32(f.encode("utf-8", "surrogatepass")) % HASH for f in word_features(word)]


@dataclass
class Chain:
    """Weights: word, word before, word behind (difference of the two states), transitions, start."""

    weights: np.ndarray  # (3, HASH)
    transition: np.ndarray  # (2, 2), from and to
    start: float


@dataclass
class Model:
    chain: Chain
    aggregate: np.ndarray  # bias and weights of evidence()
    scale: np.ndarray


class Words:
    """Word numbers and, for each, its weight sums as word, word before and word behind."""

    def __init__(self, chain: Chain):
        self.chain = chain
        self.clear()

    def clear(self) -> None:
        words = self

        class Numbers(dict):
            def __missing__(self, word: str) -> int:
                self[word] = number = len(self)
                words.pending.append(word)
                return number

        self.pending: list[str] = []
        self.numbers = Numbers()
        self.table = np.empty((3, 0), dtype=np.float32)

    def of(self, text: str | None) -> np.ndarray:
        found = _WORD.findall(_lowered(text)) if text else []
        return np.fromiter(map(self.numbers.__getitem__, found), dtype=np.int32, count=len(found))

    def sums(self) -> np.ndarray:
        if self.pending:
            rows = [_hashed(w) for w in self.pending]
            at = np.concatenate(rows)
            edge = np.cumsum([0] + [len(r) for r in rows[:-1]])
            made = [np.add.reduceat(self.chain.weights[k][at], edge) for k in range(3)]
            self.table = np.concatenate((self.table, np.array(made, dtype=np.float32)), axis=1)
            self.pending = []
        return self.table


def _emissions(sums: np.ndarray, words: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Log odds of each word's own and neighbours' weights; sequences lie one behind the other."""
    out = sums[0][words].copy()
    first = np.zeros(len(words), dtype=bool)
    starts = (np.cumsum(lengths) - lengths)[lengths > 0]
    first[starts] = True
    before = sums[1][words[:-1]]
    behind = sums[2][words[1:]]
    out[1:] += np.where(first[1:], 0, before)
    out[:-1] += np.where(first[1:], 0, behind)
    return out


def forward_backward(odds: np.ndarray, lengths: np.ndarray, chain: Chain) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(forward, backward log odds, marginals) of sequences that lie one behind the other.

    All sequences advance together, the longest first, so that a step is one
    vector operation over those that are still running.
    """
    t = chain.transition
    order = np.argsort(-lengths, kind="stable")
    starts = (np.cumsum(lengths) - lengths)[order]
    sizes = lengths[order]
    steps = int(sizes[0]) if len(sizes) else 0
    # running[s]: sequences longer than s
    running = np.searchsorted(-sizes, -np.arange(steps), side="left")
    forward, backward = np.empty(len(odds)), np.zeros(len(odds))
    now = np.empty(0)
    for s in range(steps):
        k = running[s]
        at = starts[:k] + s
        if s:
            past = now[:k]
            now = odds[at] + np.logaddexp(t[0, 1], t[1, 1] + past) - np.logaddexp(t[0, 0], t[1, 0] + past)
        else:
            now = odds[at] + chain.start
        forward[at] = now
    ahead = np.empty(0)
    for s in range(steps - 1, 0, -1):
        k = running[s]
        more = k - len(ahead)
        if more:
            ahead = np.concatenate((ahead, np.zeros(more)))
        next_ = odds[starts[:k] + s] + ahead
        ahead = np.logaddexp(t[1, 0], t[1, 1] + next_) - np.logaddexp(t[0, 0], t[0, 1] + next_)
        backward[starts[:k] + s - 1] = ahead
    marginal = 1 / (1 + np.exp(-np.clip(forward + backward, -60, 60)))
    return forward, backward, marginal


def evidence(marginal: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Per sequence: expected toxic words (log), highest marginal, likely toxic words (log), their density."""
    out = np.zeros((len(lengths), 4))
    full = np.flatnonzero(lengths > 0)
    if len(full):
        starts = (np.cumsum(lengths) - lengths)[full]
        expected = np.add.reduceat(marginal, starts)
        out[full, 0] = np.log1p(expected)
        out[full, 1] = np.maximum.reduceat(marginal, starts)
        out[full, 2] = np.log1p(np.add.reduceat((marginal > 0.5).astype(float), starts))
        out[full, 3] = expected / np.sqrt(lengths[full])
    return out


def _contexts(docs: list[list[str]]) -> dict[str, int]:
    """Distinct pairs of neighbours that each word has: copied passages count once."""
    numbers: dict[str, int] = {}
    flat = np.array([n for d in docs for n in [0, *(numbers.setdefault(w, len(numbers) + 1) for w in d), 0]], dtype=np.uint64)
    if len(flat) < 3:
        return {}
    mixed = flat[:-2] * np.uint64(0x9E3779B97F4A7C15) ^ flat[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) ^ flat[2:] * np.uint64(0x165667B19E3779F9)
    counts = np.bincount(flat[1:-1][np.unique(mixed, return_index=True)[1]].astype(np.int64), minlength=len(numbers) + 1)
    return {w: int(counts[n]) for w, n in numbers.items()}


def induced_labels(docs: list[list[str]], toxic: np.ndarray) -> list[np.ndarray]:
    """Token labels: words of toxic documents with a feature whose log odds are surely high.

    Features are tried from the most specific one (the word) to the shortest
    prefix, each on the words that none before has marked, so that a prefix
    isn't taken for toxic because of one word that has it.  A feature counts in
    toxic documents as often as it has distinct neighbours there at most, so
    that words of a passage that copies share don't pass for toxic ones.
    """
    contexts = _contexts([d for d, y in zip(docs, toxic.tolist(), strict=True) if y])
    n1, n0 = int(toxic.sum()), int(len(toxic) - toxic.sum())
    numbers: dict[str, int] = {}
    own = [np.unique(np.fromiter((numbers.setdefault(w, len(numbers)) for w in d), dtype=np.int32, count=len(d))) for d in docs]
    around = np.fromiter((contexts.get(w, 0) for w in numbers), dtype=np.int64, count=len(numbers))
    marked = np.zeros(len(numbers), dtype=bool)
    for size in (None, 6, 5, 4, 3):
        codes: dict[str, int] = {}
        feature = np.fromiter(
            (codes.setdefault(w if size is None else w[:size], len(codes)) if size is None or len(w) > size else -1 for w in numbers),
            dtype=np.int64, count=len(numbers),
        )
        seen, near = np.zeros((2, len(codes))), np.zeros(len(numbers), dtype=bool)
        for words, y in zip(own, toxic.tolist(), strict=True):
            found = np.unique(feature[words])
            seen[y, found[found >= 0]] += 1
            if y:
                near[words] = True
        near &= feature >= 0
        k = np.minimum(seen[1], np.bincount(feature[near], around[near], len(codes)))
        odds = np.log((k + 0.5) / (n1 + 1)) - np.log((seen[0] + 0.5) / (n0 + 1))
        strong = (k >= SUPPORT) & (odds - BOUND * np.sqrt(1 / (k + 0.5) + 1 / (seen[0] + 0.5)) >= CLEAR)
        new = np.append(strong, False)[feature]  # -1 is none
        if new.any():
            marked |= new
            own = [words[~new[words]] for words in own]
    return [
        np.fromiter((marked[numbers[w]] for w in words), dtype=bool, count=len(words)) if y else np.zeros(len(words), dtype=bool)
        for words, y in zip(docs, toxic.tolist(), strict=True)
    ]


def _windows(docs: list[list[str]], labels: list[np.ndarray], toxic: np.ndarray) -> tuple[list[list[str]], list[np.ndarray]]:
    """Windows with marked words first, then all windows of documents that aren't toxic."""
    marked, clean = [], []
    for words, y, bad in zip(docs, labels, toxic.tolist(), strict=True):
        for at in range(0, len(words), WINDOW):
            pair = words[at : at + WINDOW], y[at : at + WINDOW]
            if pair[1].any():
                marked.append(pair)
            elif not bad:  # what isn't marked in a toxic document may still be toxic
                clean.append(pair)
    kept = marked + clean
    return [k[0] for k in kept], [k[1] for k in kept]


def train_chain(windows: list[list[str]], labels: list[np.ndarray]) -> Chain:
    """Adagrad on the conditional log likelihood of all windows, whose gradient is summed block by block."""
    chain = Chain(np.zeros((3, HASH)), np.zeros((2, 2)), 0.0)
    numbers: dict[str, int] = {}
    words = np.fromiter((numbers.setdefault(w, len(numbers)) for ws in windows for w in ws), dtype=np.int32, count=sum(map(len, windows)))
    marks = np.concatenate(labels) if labels else np.zeros(0, dtype=bool)
    lengths = np.array([len(w) for w in windows], dtype=np.int64)
    if not len(words):
        return chain
    rows = [_hashed(w) for w in numbers]
    sizes = np.array([len(r) for r in rows])
    at, edge = np.concatenate(rows), np.cumsum(sizes) - sizes
    squares, moved, started = np.full((3, HASH), 1e-8), np.full((2, 2), 1e-8), 1e-8
    stops = np.cumsum(lengths)
    for _ in range(ROUNDS):
        sums = np.array([np.add.reduceat(chain.weights[k][at], edge) for k in range(3)])
        per_word, pairs, begin = np.zeros((3, len(numbers))), np.zeros(4), 0.0
        for low in range(0, len(windows), BLOCK_WINDOWS):
            own = lengths[low : low + BLOCK_WINDOWS]
            part = slice(int(stops[low] - lengths[low]), int(stops[low + len(own) - 1]))
            found = _gradient(sums, words[part], marks[part].astype(float), own, chain)
            per_word, pairs, begin = per_word + found[0], pairs + found[1], begin + found[2]
        for k in range(3):
            step = np.bincount(at, np.repeat(per_word[k], sizes), HASH) / len(windows) - DECAY * chain.weights[k]
            squares[k] += step**2
            chain.weights[k] += RATE * step / np.sqrt(squares[k])
        step = pairs.reshape(2, 2) / len(windows)
        moved += step**2
        chain.transition = chain.transition + RATE * step / np.sqrt(moved)
        begin /= len(windows)
        started += begin**2
        chain.start += RATE * begin / np.sqrt(started)
    return chain


def _gradient(sums: np.ndarray, words: np.ndarray, y: np.ndarray, lengths: np.ndarray, chain: Chain) -> tuple[np.ndarray, np.ndarray, float]:
    """Gradient of a block's log likelihood: by word as itself, word before and word behind; by transition; of the start."""
    first = np.zeros(len(words), dtype=bool)
    first[np.cumsum(lengths) - lengths] = True
    inner = ~first[1:]
    odds = _emissions(sums, words, lengths)
    forward, backward, p = forward_backward(odds, lengths, chain)
    wrong, count = y - p, sums.shape[1]
    per_word = np.array(
        [
            np.bincount(words, wrong, count),
            np.bincount(words[:-1][inner], wrong[1:][inner], count),
            np.bincount(words[1:][inner], wrong[:-1][inner], count),
        ]
    )
    # Pair marginals of neighbours, in log space.
    a0, a1 = -np.logaddexp(0, forward[:-1]), -np.logaddexp(0, -forward[:-1])
    b = odds[1:] + backward[1:]
    t = chain.transition
    joint = np.stack([a0 + t[0, 0], a0 + t[0, 1] + b, a1 + t[1, 0], a1 + t[1, 1] + b])[:, inner]
    joint = np.exp(joint - np.logaddexp.reduce(joint, axis=0))
    pair = (y[:-1] * 2 + y[1:])[inner].astype(int)
    return per_word, np.bincount(pair, minlength=4) - joint.sum(axis=1), float(wrong[first].sum())


def _evidence_of(docs: list[list[str]], chain: Chain) -> np.ndarray:
    words, parts, held, size = Words(chain), [], [], 0
    for k, d in enumerate(docs):
        held.append(np.fromiter(map(words.numbers.__getitem__, d), dtype=np.int32, count=len(d)))
        size += len(d)
        if size >= TRAIN_WORDS or k == len(docs) - 1:
            parts.append(_scored(held, words.sums(), chain)[0])
            held, size = [], 0
    return np.concatenate(parts) if parts else np.zeros((0, 4))


def _scored(arrays: list[np.ndarray], sums: np.ndarray, chain: Chain) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(a) for a in arrays], dtype=np.int64)
    joined = np.concatenate(arrays) if arrays else np.zeros(0, dtype=np.int32)
    if not len(joined):
        return np.zeros((len(arrays), 4)), np.zeros(0)
    marginal = forward_backward(_emissions(sums, joined, lengths), lengths, chain)[2]
    return evidence(marginal, lengths), marginal


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Newton's method with a light ridge."""
    x = np.column_stack((np.ones(len(x)), x))
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-6] + [0.05] * (x.shape[1] - 1))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge, x.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def train(texts: list[str | None], toxic: np.ndarray) -> Model | None:
    """Model from labelled texts; None unless both labels occur."""
    toxic = toxic.astype(int)
    if len(set(toxic.tolist())) < 2:
        return None
    known: dict[str, str] = {}  # one object for each distinct word
    docs = [[known.setdefault(w, w) for w in _WORD.findall(_lowered(t))] if t else [] for t in texts]

    def chain_of(part: np.ndarray) -> Chain:
        own = [docs[i] for i in part]
        labels = induced_labels(own, toxic[part])
        return train_chain(*_windows(own, labels, toxic[part]))

    half = np.array([zlib.crc32(" ".join(d).encode("utf-8", "surrogatepass")) & 1 for d in docs])  # copies stay together
    seen = np.zeros((len(docs), 4))
    for side in (0, 1):
        fit, other = np.flatnonzero(half == side), np.flatnonzero(half != side)
        seen[other] = _evidence_of([docs[i] for i in other], chain_of(fit))
    scale = np.maximum(seen.std(axis=0), 1e-3)
    return Model(chain_of(np.arange(len(docs))), _logistic(seen / scale, toxic.astype(float)), scale)


def _probability(model: Model, seen: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(model.aggregate[0] + (seen / model.scale) @ model.aggregate[1:], -40, 40)))


class Scorer:
    """Scores lists of texts with a bounded cache and bounded batches."""

    def __init__(self, model: Model):
        self.model, self.words = model, Words(model.chain)

    def _each(self, texts: list[str | None]) -> Iterator[tuple[int, list[np.ndarray], np.ndarray, np.ndarray]]:
        at = held = 0
        arrays: list[np.ndarray] = []
        for k, text in enumerate(texts):
            arrays.append(self.words.of(text))
            held += len(arrays[-1])
            if held >= CHUNK_WORDS or k == len(texts) - 1:
                yield at, arrays, *_scored(arrays, self.words.sums(), self.model.chain)
                at, held, arrays = k + 1, 0, []
                if len(self.words.numbers) > CACHE_WORDS:
                    self.words.clear()

    def scores(self, texts: list[str | None]) -> np.ndarray:
        parts = [_probability(self.model, seen) for _, _, seen, _ in self._each(texts)]
        return np.concatenate(parts) if parts else np.zeros(0)

    def spans(self, texts: list[str | None], least: float = 0.5) -> list[list[tuple[int, int]]]:
        """Offending (start, end) code points: runs of words with marginals of at least ``least``."""
        out: list[list[tuple[int, int]]] = []
        for at, arrays, _, marginal in self._each(texts):
            stop = 0
            for k, own in enumerate(arrays):
                bad = marginal[stop : stop + len(own)] >= least
                stop += len(own)
                runs: list[tuple[int, int]] = []
                if bad.any():
                    previous = False
                    for m, b in zip(_WORD.finditer(_lowered(texts[at + k])), bad.tolist(), strict=True):
                        if b:
                            runs.append((runs.pop()[0], m.end()) if previous else m.span())
                        previous = b
                out.append(runs)
        return out


def fold(doc_id: Column) -> Column:
    """crc32 of the identifier's text modulo FOLDS; a null identifier counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(FOLDS))


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Train on the documented bounded sample of labelled rows outside the held-out fold.

    Rows, not identifiers, are chosen: however often a labelled doc_id repeats,
    the driver gets ``TRAIN_DOCS`` texts of each label at most.
    """
    known = labels.where("toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = docs.select("doc_id").distinct().where(fold(F.col("doc_id")) != HELD_OUT)  # texts stay where they are
    known = written(ids.join(known, "doc_id"), "labelled")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    parts = [known.where(F.col("toxic") == mark).orderBy(*order).limit(TRAIN_DOCS) for mark in (0, 1)]
    sample = written(parts[0].unionByName(parts[1]), "sample")  # 2 * TRAIN_DOCS identifiers at most
    digest = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("digest")
    found = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    marked = found.select("doc_id", "toxic", digest).distinct()
    marked = [marked.where(F.col("toxic") == mark).orderBy(*order, "digest").limit(TRAIN_DOCS) for mark in (0, 1)]
    chosen = written(marked[0].unionByName(marked[1]), "rows")  # 2 * TRAIN_DOCS rows at most
    rows = found.select("doc_id", "text", digest).join(F.broadcast(chosen), ["doc_id", "digest"])
    rows = rows.groupBy("doc_id", "toxic", "digest").agg(F.first("text").alias("text"))
    rows = sorted(rows.drop("digest").collect(), key=lambda r: (r["toxic"], str(r["doc_id"]), r["text"] or ""))
    texts, marks = [r["text"] for r in rows], [r["toxic"] for r in rows]
    del rows
    return train(texts, np.array(marks, dtype=int))


def _model_uri(spark: SparkSession, model: Model | None) -> str:
    uri = f"{fresh_dir(spark, 'crf')}/model.pickle"
    put_bytes(uri, pickle.dumps(model))
    return uri


_SCORERS: dict[str, Scorer | None] = {}


def _scorer(uri: str) -> Scorer | None:
    """One scorer for each worker process and model."""
    if uri not in _SCORERS:
        _SCORERS.clear()
        model = pickle.loads(get_bytes(uri))
        _SCORERS[uri] = None if model is None else Scorer(model)
    return _SCORERS[uri]


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, score) of every document."""
    uri = _model_uri(docs.sparkSession, model)

    def make(texts: list[str | None]) -> tuple[np.ndarray]:
        scorer = _scorer(uri)
        return (np.zeros(len(texts)) if scorer is None else scorer.scores(texts),)

    return per_text(docs, "score double", make)


def toxic_spans(docs: DataFrame, model: Model | None, least: float = 0.5) -> DataFrame:
    """(doc_id, start, end) of every offending run of words, in code points."""
    uri = _model_uri(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(uri)
        for batch in (p for b in batches for p in slices(b)):
            found = scorer.spans(batch.column(1).to_pylist(), least) if scorer else []
            at = np.repeat(np.arange(len(found)), [len(f) for f in found])
            flat = [s for f in found for s in f]
            ids = batch.column(0).take(pa.array(at, pa.int64()))
            start, end = (pa.array([s[k] for s in flat], pa.int64()) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([ids, start, end], ["doc_id", "start", "end"])

    docs = docs.select("doc_id", "text")
    return docs.mapInArrow(run, f"doc_id {docs.dtypes[0][1]}, start long, end long")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score below ``threshold``, with all their columns."""
    uri = _model_uri(docs.sparkSession, fit(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(uri)
        for batch in tidied(batches):
            if scorer is None:
                yield batch
                continue
            for part in slices(batch):
                yield part.filter(pa.array(scorer.scores(part.column("text").to_pylist()) < threshold))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id",
        (fold(F.col("doc_id")) == HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


QUERIES = {"op10_toxicity": query}
ORACLE_SQL: dict[str, str] = {}
