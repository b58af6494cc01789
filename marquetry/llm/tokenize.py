"""Encoding of texts with a public byte-level BPE vocabulary by merge replay.

The vocabulary's merges are applied to a whole batch of different words at once, in order of rank: an inverted index leads
from each pair of neighbouring tokens to the positions where it stands, a merge visits just those, and only the pairs with the
touched neighbours enter the index anew. Words seen before come from a cache, so the replay runs over the vocabulary of the
corpus, not over its text. Encoding needs no exchange: it is one pass over the scan.
"""

from __future__ import annotations

import heapq
import json
import os
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.json"
# Fixed value: how byte-level vocabularies of this kind split text into words.
WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words that a worker remembers, none of more than LONG_WORD characters; longer ones are replayed whenever they occur.
CACHE_WORDS = 400_000
LONG_WORD = 64


def _byte_symbols() -> dict[str, int]:
    """Symbol -> byte: printable bytes stand for themselves, the others for the code points from 256 on, in order."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Replay:
    """Merges of a vocabulary file in the format of the `tokenizers` library (model BPE, byte level)."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab: dict[str, int] = model["vocab"]
        self.first = [0] * 256
        for symbol, byte in _byte_symbols().items():
            self.first[byte] = vocab[symbol]
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for r, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.rank.setdefault((vocab[a], vocab[b]), (r, vocab[a + b]))
        self.words: dict[str, list[int]] = {}

    def replay(self, words: list[str]) -> list[list[int]]:
        """Ids of each word."""
        token: list[int] = []
        after: list[int] = []
        before: list[int] = []
        starts: list[int] = []
        index: dict[tuple[int, int], list[int]] = {}
        for w in words:
            at = len(token)
            starts.append(at)
            token += [self.first[b] for b in w.encode("utf-8", "replace")]
            n = len(token)
            before.append(-1)
            before += range(at, n - 1)
            after += range(at + 1, n)
            after.append(-1)
            for i in range(at, n - 1):
                pair = (token[i], token[i + 1])
                if pair in self.rank:
                    index.setdefault(pair, []).append(i)
        heap = [(self.rank[p][0], p) for p in index]
        heapq.heapify(heap)
        while heap:
            _, pair = heapq.heappop(heap)
            places = index.pop(pair, None)
            if places is None:
                continue
            a, b = pair
            new = self.rank[pair][1]
            places.sort()
            for i in places:
                j = after[i]
                if token[i] != a or j < 0 or token[j] != b:
                    continue  # an earlier merge took one of them
                token[i], token[j] = new, -1
                k = after[j]
                after[i] = k
                h = before[i]
                if k >= 0:
                    before[k] = i
                    self._enter(index, heap, (new, token[k]), i)
                if h >= 0:
                    self._enter(index, heap, (token[h], new), h)
        out = []
        for s in starts:
            ids, i = [], s
            while i >= 0:
                ids.append(token[i])
                i = after[i]
            out.append(ids)
        return out

    def _enter(self, index: dict, heap: list, pair: tuple[int, int], at: int) -> None:
        r = self.rank.get(pair)
        if r is not None:
            places = index.get(pair)
            if places is None:
                index[pair] = [at]
                heapq.heappush(heap, (r[0], pair))
            else:
                places.append(at)

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        split = [_PATTERN.findall(t) if t else [] for t in texts]
        missing = list(dict.fromkeys(w for ws in split for w in ws if w not in self.words))
        if len(self.words) + len(missing) > CACHE_WORDS:
            self.words.clear()
            missing = list(dict.fromkeys(w for ws in split for w in ws))
        fresh = dict(zip(missing, self.replay(missing)))
        known = self.words
        known.update((w, ids) for w, ids in fresh.items() if len(w) <= LONG_WORD)
        return [list(chain.from_iterable([known.get(w) or fresh[w] for w in ws])) for ws in split]


_PATTERN = regex.compile(WORDS)


@lru_cache(2)
def _replay(path: str) -> Replay:
    return Replay(path)


def _pieces(texts: list, most: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Runs of texts of about `most` characters together, so a batch of long texts is encoded bit by bit."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size > most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _encode(path: str, count_only: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay = _replay(path)
        for b in batches:
            texts = b.column(b.num_columns - 1).to_pylist()
            for a, z in _pieces(texts):
                ids = replay.encode(texts[a:z])
                last = pa.array([len(x) for x in ids], pa.int64()) if count_only else pa.array(ids, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*(c.slice(a, z - a) for c in b.columns[:-1]), last], names=[*b.schema.names[:-1], "tokens" if count_only else "ids"])

    return run


def _ddl(df: DataFrame, columns: list[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)


def encoded(df: DataFrame, keep: list[str], text: str, tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """The kept columns and `ids` (array<int>), one row per row of df.

    Null and empty texts give an empty list. Strings that look like special tokens are ordinary text. Unpaired surrogates count
    as U+FFFD's replacement '?'. Line ends, scripts and lengths are taken as they are.
    """
    return df.select(*keep, text).mapInArrow(_encode(os.path.join(tokenizers, vocabulary), False), _ddl(df, keep) + ", ids array<int>")


def token_counts(df: DataFrame, keep: list[str], text: str, tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """The kept columns and `tokens` (bigint), the number of ids of encoded; the ids never leave the worker."""
    return df.select(*keep, text).mapInArrow(_encode(os.path.join(tokenizers, vocabulary), True), _ddl(df, keep) + ", tokens bigint")
