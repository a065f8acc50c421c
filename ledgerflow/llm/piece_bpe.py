"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies by a score-ordered agenda
of adjacent symbol pairs, checked against the sentencepiece library in Arrow batches.

A text becomes symbols (code points, spaces as U+2581, one of them put in front); the pair whose
joined piece scores highest is merged first, the leftmost among equals, until no adjacent pair is a
piece; symbols outside the vocabulary fall back to bytes. No piece of such a vocabulary has U+2581
after another character, so texts are cut before each run of U+2581 and every distinct chunk is
encoded once per task: many short chunks in step (each round pops the head of every chunk's
agenda), long ones with a heap in O(n log n). Each distinct chunk is also encoded by the library.
The decoded text of a row is the library's ``decode`` of all its ids, so a fault where chunks meet
would show. A difference to the library's ids, or of the decoded text to the text, raises.

Narrow: one pass, no shuffle; memory is a slice of texts, the tables of the vocabulary (a fixed
file) and a cache of ``CACHE`` chunks and those of two slices, emptied after a task.

Defined results: a null or empty text has no ids and decodes to the empty string; a literal U+2581
reads as a space; repeated rows each get their row; other columns pass through.
"""
from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerflow.llm.common import table, with_struct

MODEL = "piece_bpe_32k.model"
#: Chunks with more code points than this are encoded one by one with a heap.
LONG = 48
CACHE = 240_000
#: Text encoded at once; the pieces of a text take many times its size as Python objects.
SLICE = 1 << 20
SPACE = "▁"
_CHUNK = re.compile(f"{SPACE}+[^{SPACE}]*")
_NONE = np.int64(1) << 40

ENCODED = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())),
                        T.StructField("decoded", T.StringType())])


class Vocabulary:
    """Merge tables of a model file. Symbol numbers are piece ids; characters that only occur
    inside longer pieces get numbers after them, all other characters -1."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(self.size)]
        normal = [i for i in range(self.size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        if any(SPACE in self.pieces[i].lstrip(SPACE) for i in normal):
            raise ValueError("a piece has U+2581 after another character: chunks would not be independent")
        self.byte_id = {int(self.pieces[i][3:5], 16): i for i in range(self.size) if sp.is_byte(i)}
        self.id_byte = {i: b for b, i in self.byte_id.items()}
        number = {self.pieces[i]: i for i in normal}
        self.known = set(number.values())
        self.shared = list(range(self.size))
        for i in normal:
            for c in self.pieces[i]:
                number.setdefault(c, self.size + len(number))
        self.number = number
        self.char = {n: c for c, n in number.items()}
        self.chars = {c: n for c, n in number.items() if len(c) == 1}
        order = {s: k for k, s in enumerate(sorted({sp.get_score(i) for i in normal}, reverse=True))}
        self.wide = max(number.values()) + 1
        merges = {}
        for i in normal:
            piece = self.pieces[i]
            for cut in range(1, len(piece)):
                a, b = number.get(piece[:cut]), number.get(piece[cut:])
                if a is not None and b is not None:
                    merges[a * self.wide + b] = (order[sp.get_score(i)], i)
        self.merges = merges
        self.bits = 20
        self._index(np.array(list(merges), np.int64), np.array(list(merges.values()), np.int64).reshape(-1, 2))

    def _index(self, keys: np.ndarray, values: np.ndarray) -> None:
        """A hash table with linear probing; ``probes`` is the longest probe."""
        slots = 1 << self.bits
        self.keys = np.full(slots + 64, -1, np.int64)
        self.at = np.zeros((slots + 64, 2), np.int64)
        self.probes = 1
        for key, value, slot in zip(keys.tolist(), values, self._slot(keys).tolist()):
            k = 0
            while self.keys[slot + k] >= 0:
                k += 1
            self.keys[slot + k], self.at[slot + k] = key, value
            self.probes = max(self.probes, k + 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged symbol) of pairs; rank _NONE if the joined text is no piece."""
        key = np.where((left < 0) | (right < 0), -2, left * self.wide + right)
        slot = self._slot(key)
        rank, merged = np.full(len(key), _NONE), np.full(len(key), -1, np.int64)
        for k in range(self.probes):
            found = self.keys[slot + k] == key
            rank[found], merged[found] = self.at[slot[found] + k].T
        return rank, merged

    def ids_of(self, symbol: int, char: str) -> list[int]:
        if symbol in self.known:
            return [symbol]
        return [self.byte_id[b] for b in char.encode()]

    def one(self, chunk: str) -> list[int]:
        """Ids of one chunk, the agenda as a heap of (rank, position, left, right)."""
        symbols = [self.chars.get(c, -1) for c in chunk]
        n = len(symbols)
        after, before, live = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        agenda: list[tuple[int, int, int, int, int]] = []

        def offer(i: int, j: int) -> None:
            if 0 <= i and j < n and symbols[i] >= 0 and symbols[j] >= 0:
                found = self.merges.get(symbols[i] * self.wide + symbols[j])
                if found:
                    heapq.heappush(agenda, (found[0], i, symbols[i], symbols[j], found[1]))

        for i in range(n - 1):
            offer(i, i + 1)
        while agenda:
            _, i, left, right, merged = heapq.heappop(agenda)
            j = after[i]
            if not live[i] or symbols[i] != left or j >= n or symbols[j] != right:
                continue
            symbols[i], live[j], after[i] = merged, False, after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(before[i], i)
            offer(i, after[i])
        out: list[int] = []
        for i in range(n):
            if live[i]:
                out += self.ids_of(symbols[i], chunk[i])
        return out

    def many(self, chunks: list[str]) -> list[list[int]]:
        """Ids of short chunks, all agendas in step: each round merges every chunk's best pair."""
        n = len(chunks)
        sizes = np.fromiter(map(len, chunks), np.int64, n)
        text = "".join(chunks)
        get = self.chars.get
        symbol = np.fromiter((get(c, -1) for c in text), np.int64, len(text))
        place = np.arange(len(text))
        own = np.repeat(np.arange(n), sizes)
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        rank, merged = np.full(len(text), _NONE), np.full(len(text), -1, np.int64)
        inner = np.flatnonzero(own[:-1] == own[1:]) if len(text) else np.zeros(0, np.int64)
        rank[inner], merged[inner] = self.pair(symbol[inner], symbol[inner + 1])
        while len(symbol):
            start = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            head = np.minimum.reduceat(rank * (1 << 22) + np.arange(len(rank)) % (1 << 22), start)
            ended = head >= _NONE * (1 << 22)
            if ended.any():
                length = np.diff(np.r_[start, len(symbol)])
                out = np.repeat(ended, length)
                done.append((own[out], symbol[out], place[out]))
                keep = ~out
                symbol, place, own, rank, merged = (x[keep] for x in (symbol, place, own, rank, merged))
                continue
            at = start + ((head - start) % (1 << 22))
            symbol[at] = merged[at]
            keep = np.ones(len(symbol), bool)
            keep[at + 1] = False
            symbol, place, own, rank, merged = (x[keep] for x in (symbol, place, own, rank, merged))
            at = at - np.arange(len(at))
            rank[at], merged[at] = _NONE, -1
            left = at[at > 0] - 1
            stale = np.concatenate([left[own[left] == own[left + 1]], at[at + 1 < len(own)]])
            stale = stale[own[stale] == own[stale + 1]]
            rank[stale], merged[stale] = self.pair(symbol[stale], symbol[stale + 1])
        result: list[list[int]] = [[] for _ in range(n)]
        for owners, symbols, places in done:
            for o, s, p in zip(owners.tolist(), symbols.tolist(), places.tolist()):
                if s in self.known:
                    result[o].append(s)
                else:
                    result[o] += self.ids_of(s, text[p])
        return result

    def raw(self, ids: list[int]) -> str:
        """The pieces of ids joined, runs of byte pieces read as UTF-8, U+2581 as spaces."""
        out: list[str] = []
        pending = bytearray()
        for i in ids:
            if i in self.id_byte:
                pending.append(self.id_byte[i])
                continue
            if pending:
                out.append(pending.decode("utf-8", "replace"))
                pending.clear()
            out.append(self.pieces[i])
        if pending:
            out.append(pending.decode("utf-8", "replace"))
        return "".join(out).replace(SPACE, " ")

    def decode(self, ids: list[int]) -> str:
        return self.raw(ids).removeprefix(" ")

    def encode(self, texts: list[str], known: "Known") -> list[list[str]]:
        """The chunks of each text; ``known`` then holds the ids of each."""
        cut = [_CHUNK.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        new = known.lacking({c for one in cut for c in one})
        for k in range(0, len(new), 20_000):
            part = new[k:k + 20_000]
            short = [c for c in part if len(c) <= LONG]
            got = dict(zip(short, self.many(short)))
            got.update((c, self.one(c)) for c in part if len(c) > LONG)
            for chunk, want in zip(part, self.library.encode([c[1:] for c in part], num_threads=1)):
                ids = got[chunk]
                # a lone U+2581 is the empty text to the library, which gives that no ids
                if want != ids and chunk != SPACE:
                    raise ValueError(f"differs from the library: {chunk!r}: {ids} and {want}")
                known.young[chunk] = tuple([self.shared[i] for i in ids]), ",".join(map(str, ids))
        return cut


class Known:
    """Chunks with their ids, as numbers and in decimal. When half of ``CACHE`` chunks are young they
    become the old ones, of which those that are met again become young: frequent chunks stay."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.young: dict[str, tuple[tuple[int, ...], str]] = {}
        self.old: dict[str, tuple[tuple[int, ...], str]] = {}

    def lacking(self, chunks: set[str]) -> list[str]:
        """The chunks that have to be encoded; the others are young from now on."""
        if len(self.young) > CACHE // 2:
            self.old, self.young = self.young, {}
        new = []
        for chunk in chunks.difference(self.young):
            ids = self.old.get(chunk)
            if ids is None:
                new.append(chunk)
            else:
                self.young[chunk] = ids
        return new


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@lru_cache(2)
def _cache(path: str) -> Known:
    return Known()


def _encoded(path: str, column: pa.Array) -> Iterator[tuple[int, str, str]]:
    """(number of ids, ids in decimal, the library's decoding of all these ids) of each text."""
    known, vocab = _cache(path), vocabulary(path)
    texts = [t or "" for t in column.to_pylist()]
    for text, chunks in zip(texts, vocab.encode(texts, known)):
        found = [known.young[c] for c in chunks]
        numbers = list(chain.from_iterable([n for n, _ in found]))
        decoded = vocab.library.decode(numbers) if numbers else ""
        if decoded != text.replace(SPACE, " "):
            raise ValueError(f"ids do not decode to their text: {text[:200]!r}")
        yield len(numbers), ",".join([i for _, i in found]), decoded


def encode_struct(path: str, column: pa.Array) -> dict[str, pa.Array]:
    n, ids, decoded = zip(*_encoded(path, column))
    flat = np.concatenate([np.array(x.split(","), np.int32) for x in ids if x] or [np.zeros(0, np.int32)])
    at = pa.array(np.cumsum([0, *n]).astype(np.int32))
    return {"n_tokens": pa.array(n, pa.int64()), "ids": pa.ListArray.from_arrays(at, pa.array(flat)),
            "decoded": pa.array(decoded, pa.string())}


def digest_struct(path: str, column: pa.Array) -> dict[str, pa.Array]:
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    n, ids, decoded = zip(*((n, sha(i), sha(d)) for n, i, d in _encoded(path, column)))
    return {"n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids, pa.string()), "decoded_sha256": pa.array(decoded, pa.string())}


DIGEST = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()),
                       T.StructField("decoded_sha256", T.StringType())])


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL)


def encode(docs: DataFrame, *, model: str | None = None, text: str = "text", name: str = "__pieces") -> DataFrame:
    """``docs`` plus a struct column ``name``: n_tokens, ids, decoded."""
    path = model or default_model()
    return with_struct(docs, text, name, ENCODED, lambda column: encode_struct(path, column), limit=SLICE, finish=lambda: _cache(path).clear())


def digests(docs: DataFrame, *, model: str | None = None, text: str = "text", name: str = "__pieces") -> DataFrame:
    """As ``encode``, with sha256 digests in place of ids and decoded text, and without the text."""
    path = model or default_model()
    return with_struct(docs, text, name, DIGEST, lambda column: digest_struct(path, column), drop=True, limit=SLICE,
                       finish=lambda: _cache(path).clear())


def op10_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digests(docs).select("doc_id", "__pieces.n_tokens", "__pieces.ids_sha256", "__pieces.decoded_sha256")
