"""SentencePiece encoding and decoding by a prefix table.

BPE output has the prefix property: every prefix of a chunk has one last token,
and the tokens of the prefix before it are the prefix's own.  For each prefix
the table holds that token: among the pieces that end there (found by one
automaton), the one whose pair with the last token of the prefix before it is
compatible, i.e. merging the two pieces' characters gives back exactly the
pair.  Ids are then recovered backwards from the whole chunk.

Pieces that plain merging never outputs are left out of the automaton.  Should
a prefix of known pieces have no or several candidates (pieces of equal score
can do that), the chunk is merged plainly, so the result is always the library's.

A text is cut where no merge can cross: before a space that follows a
non-space, since no piece holds a space after another character, around
characters of no piece, which become bytes, and between a word's letters and a
punctuation mark that no piece holds behind a letter.  Distinct chunks are encoded
once for each task and cached up to a bound.

Defined results: null and empty texts have no pieces, only the end id; the
text's length does not matter, chunks are joined as they come (a chunk itself
is linear in its length); null ids decode to an empty text; doc_ids of any type,
null ones too, pass as they are, and repeated rows are returned as often as they
occur.  Other columns, whatever their names, are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import string

import ahocorasick
from pyspark.sql import DataFrame, SparkSession

from quillon.llm.common import per_text, table, utf8

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
#: Letters at whose end a word may be cut.
LETTER = "[A-Za-zÀ-ÖØ-öø-ÿ]"
#: Chunks whose encodings a task keeps: seen again, seen once.
CACHE, FRESH = 250_000, 150_000
#: Longer chunks are not cached.
CACHED_CHARS = 64
#: Up to so many characters, merging scans all pairs instead of keeping a heap.
SHORT = 32


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class PieceCodec:
    """Encoder and decoder for a BPE model with byte fallback and identity normalisation."""

    def __init__(self, path: str | None = None):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path or model_path())
        size = model.get_piece_size()
        self.end, self.unknown = model.eos_id(), model.unk_id()
        self.pieces = [model.id_to_piece(i) for i in range(size)]
        self.byte = {int(self.pieces[i][3:5], 16): i for i in range(size) if model.is_byte(i)}
        special = {i for i in range(size) if model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)}
        self.ids = {self.pieces[i]: i for i in range(size) if i not in special}
        self.score = {p: model.get_score(i) for p, i in self.ids.items()}
        self.hidden = {i for i in special if not model.is_byte(i)}
        self.value = {i: b for b, i in self.byte.items()}
        if any(SPACE in p[1:] and p.strip(SPACE) for p in self.ids):
            raise ValueError("pieces hold spaces after other characters: texts can't be cut at spaces")
        self.known = {p for p in self.ids if len(p) == 1}
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            if self.merge(piece) == [piece]:
                self.automaton.add_word(piece, (len(piece), i))
        self.automaton.make_automaton()
        self.compatible: dict[tuple[int, int], bool] = {}
        odd = re.escape("".join(sorted({c for c in "\n\t\r" if c not in self.known})))
        marks = re.escape("".join(sorted(self._marks())))
        # A chunk: spaces with the letters up to a mark, or with what follows; or one of the usual characters of no piece.
        kinds = [f"{SPACE}*{LETTER}++(?=[{marks}])"] if marks else []
        kinds += [f"{SPACE}*[^{SPACE}{odd}]+", *([f"[{odd}]"] if odd else []), f"{SPACE}+"]
        self.chunks = re.compile("|".join(kinds))
        # Chunks seen again, and chunks seen once.
        self.cache: dict[str, tuple[int, bytes, bytes]] = {}
        self.fresh: dict[str, tuple[int, bytes, bytes]] = {}

    def _marks(self) -> set[str]:
        """Punctuation marks that no piece holds behind a letter."""
        return set(string.punctuation) - {b for p in self.ids for a, b in zip(p, p[1:], strict=False) if re.fullmatch(LETTER, a)}

    def merge(self, text: str) -> list[str]:
        """Plain merging: the best-scored adjacent pair first, the leftmost of equals."""
        parts, score = list(text), self.score
        if len(parts) <= SHORT:
            none = float("-inf")
            gain = [score.get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
            while gain and (best := max(gain)) > none:
                k = gain.index(best)
                parts[k] += parts.pop(k + 1)
                del gain[k]
                if k:
                    gain[k - 1] = score.get(parts[k - 1] + parts[k], none)
                if k < len(gain):
                    gain[k] = score.get(parts[k] + parts[k + 1], none)
            return parts
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap: list[tuple[float, int, str]] = []

        def offer(a: int) -> None:
            b = after[a]
            if b < len(parts) and (both := parts[a] + parts[b]) in score:
                heapq.heappush(heap, (-score[both], a, both))

        for a in range(len(parts) - 1):
            offer(a)
        while heap:
            _, a, both = heapq.heappop(heap)
            b = after[a] if parts[a] else len(parts)
            if b >= len(parts) or parts[a] + parts[b] != both:
                continue
            parts[a], parts[b] = both, ""
            after[a] = after[b]
            if after[b] < len(parts):
                before[after[b]] = a
            offer(a)
            if before[a] >= 0:
                offer(before[a])
        return [p for p in parts if p]

    def _pair(self, a: int, b: int) -> bool:
        found = self.compatible.get((a, b))
        if found is None:
            x, y = self.pieces[a], self.pieces[b]
            found = self.compatible[a, b] = self.merge(x + y) == [x, y]
            if len(self.compatible) > 4 * CACHE:
                self.compatible.clear()
        return found

    def _table(self, text: str) -> list[int] | None:
        """Ids of a chunk of known characters; None if a prefix has no unique last token."""
        last = [-1] * (len(text) + 1)
        compatible, pair = self.compatible, self._pair
        for end, (size, token) in self.automaton.iter(text):
            start = end + 1 - size
            if start:
                previous = last[start]
                if previous < 0:
                    continue
                fits = compatible.get((previous, token))
                if not (pair(previous, token) if fits is None else fits):
                    continue
            if last[end + 1] >= 0:
                return None
            last[end + 1] = token
        ids, at = [], len(text)
        while at:
            token = last[at]
            if token < 0:
                return None
            ids.append(token)
            at -= len(self.pieces[token])
        ids.reverse()
        return ids

    def _chunk_ids(self, chunk: str) -> list[int]:
        if self.known.issuperset(chunk):
            found = self._table(chunk)
            return found if found is not None else [self.ids[p] for p in self.merge(chunk)]
        ids: list[int] = []
        start = 0
        for k in [k for k, c in enumerate(chunk) if c not in self.known] + [len(chunk)]:
            if part := chunk[start:k]:
                found = self._table(part)
                ids += found if found is not None else [self.ids[p] for p in self.merge(part)]
            if k < len(chunk):
                ids += [self.byte[b] for b in utf8(chunk[k])] if self.byte else [self.unknown]
            start = k + 1
        return ids

    def chunk(self, chunk: str) -> tuple[int, bytes, bytes]:
        """(number of ids, decimal ids joined by spaces, decoded bytes) of a chunk."""
        found = self.cache.get(chunk)
        if found is None:
            found = self.fresh.pop(chunk, None)
            if found is not None:
                if len(self.cache) >= CACHE:
                    self.cache.clear()
                self.cache[chunk] = found
                return found
            ids = self._chunk_ids(chunk)
            # Pieces of known characters are the chunk itself.
            text = chunk.replace(SPACE, " ") if self.known.issuperset(chunk) else self._decoded(ids)
            found = len(ids), " ".join(map(str, ids)).encode(), utf8(text)
            if len(chunk) <= CACHED_CHARS:
                if len(self.fresh) >= FRESH:
                    self.fresh.clear()
                self.fresh[chunk] = found
        return found

    def split(self, text: str | None) -> list[str]:
        """Chunks of a text behind the dummy prefix; none if it is empty."""
        return self.chunks.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for c in self.split(text) for i in self.chunk(c)[1].split()] + [self.end]

    def _decoded(self, ids: list[int]) -> str:
        """Text of ids with spaces for marks; runs of bytes are UTF-8, with replacement of what isn't."""
        out: list[str] = []
        run = bytearray()
        for i in ids:
            if i in self.value:
                run.append(self.value[i])
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run.clear()
            if i not in self.hidden:
                out.append(self.pieces[i])
        out.append(run.decode("utf-8", "replace"))
        return "".join(out).replace(SPACE, " ")

    def decode(self, ids: list[int]) -> str:
        text = self._decoded(ids)
        return text[1:] if text.startswith(" ") else text

    def digest(self, text: str | None) -> tuple[int, str, str]:
        """(number of ids, SHA-256 of the ids, SHA-256 of the decoded text), chunk by chunk.

        A chunk holds only whole characters, so that decoding chunk by chunk
        equals decoding all ids.
        """
        n, decoded, ids = 1, hashlib.sha256(), hashlib.sha256()
        found = list(map(self.chunk, self.split(text)))
        for at in range(0, len(found), 1 << 16):
            part = found[at : at + (1 << 16)]
            n += sum([f[0] for f in part])
            ids.update(b" ".join([f[1] for f in part]) + b" ")
            body = b"".join([f[2] for f in part])
            decoded.update(body if at else body.removeprefix(b" "))
        ids.update(str(self.end).encode())
        return n, ids.hexdigest(), decoded.hexdigest()


_CODECS: dict[str, PieceCodec] = {}


def codec(path: str | None = None) -> PieceCodec:
    """One codec for each worker process."""
    path = path or model_path()
    if path not in _CODECS:
        _CODECS[path] = PieceCodec(path)
    return _CODECS[path]


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids) of every document, end id included."""

    def make(texts: list[str | None]) -> tuple[list[list[int]]]:
        return ([codec(path).encode(t) for t in texts],)

    return per_text(docs, "ids array<int>", make)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); null ids give an empty text."""

    def make(rows: list[list[int] | None]) -> tuple[list[str]]:
        return ([codec(path).decode(i or []) for i in rows],)

    return per_text(encoded, "text string", make, text="ids")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document."""

    def make(texts: list[str | None]) -> tuple:
        return tuple(zip(*map(codec(path).digest, texts), strict=True)) if texts else ((), (), ())

    return per_text(docs, "n_tokens long, ids_sha256 string, decoded_sha256 string", make)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


QUERIES = {"op5_sentencepiece": query}
ORACLE_SQL: dict[str, str] = {}
