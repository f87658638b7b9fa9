"""Encoding texts with a byte-level BPE vocabulary: a two-tier lookup of whole pre-tokens.

Tier one: pre-tokens are hashed where they stand, each distinct one is resolved once per
slice through a minimal perfect hash over the vocabulary. Tier two: what is not a whole
token is merged by a heap over linked bytes, and remembered by the worker.
"""

from __future__ import annotations

import heapq
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topospark.llm.vocabulary import DEFAULT_VOCABULARY, Vocabulary, hash_spans

SPACE, LETTER, NUMBER, OTHER, EDGE = range(5)
# The code points of the Unicode property White_Space.
WHITE_SPACE = [
    0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680,
    *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
]
# The endings split off after an apostrophe, as in the published pattern
# 's|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+
ONE_LETTER_ENDINGS = "stmd"
TWO_LETTER_ENDINGS = ("re", "ve", "ll")

SLICE_CHARS = 1 << 20
REMEMBERED = 1 << 19

_classes: np.ndarray | None = None


def char_classes() -> np.ndarray:
    """Class of every code point; built once per worker from the Unicode categories."""
    global _classes
    if _classes is None:
        first = {"L": LETTER, "N": NUMBER}
        table = np.fromiter(
            (first.get(unicodedata.category(chr(i))[0], OTHER) for i in range(0x110000)), dtype=np.uint8, count=0x110000
        )
        table[WHITE_SPACE] = SPACE
        _classes = table
    return _classes


def pretoken_starts(points: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the pre-tokens in an array of code points, and the class of each start.

    ``edges`` are the places of separators between texts; each is a span of its own.
    """
    kind = char_classes()[points]
    kind[edges] = EDGE
    change = np.empty(len(kind), dtype=bool)
    change[:1] = True
    np.not_equal(kind[1:], kind[:-1], out=change[1:])
    change[edges] = True
    blank = points == 32
    blank[edges] = False
    after_blank = np.zeros(len(kind), dtype=bool)
    after_blank[1:] = blank[:-1]
    space = kind == SPACE
    before_word = np.zeros(len(kind), dtype=bool)
    np.less(space[1:].view(np.uint8), (kind[1:] != EDGE).view(np.uint8), out=before_word[:-1])
    start = change & ~(after_blank & ~space & (kind != EDGE))
    start |= space & before_word
    apostrophes = np.flatnonzero((points[:-1] == 39) & change[:-1] & ~after_blank[:-1] & (kind[1:] == LETTER))
    apostrophes = apostrophes[kind[apostrophes] == OTHER]
    if len(apostrophes):
        padded = np.concatenate([points, [0, 0]])
        one = np.isin(padded[apostrophes + 1], [ord(c) for c in ONE_LETTER_ENDINGS])
        two = np.zeros(len(apostrophes), dtype=bool)
        for a, b in TWO_LETTER_ENDINGS:
            two |= (padded[apostrophes + 1] == ord(a)) & (padded[apostrophes + 2] == ord(b))
        two &= ~one
        hit = one | two
        ends = (apostrophes + np.where(one, 2, 3))[hit]
        start[apostrophes[hit] + 1] = False
        start[ends[ends < len(start)]] |= kind[ends[ends < len(start)]] == LETTER
    starts = np.flatnonzero(start)
    return starts, kind[starts]


def merge_bytes(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Byte-pair merges of one pre-token, lowest rank first, leftmost among equals.

    Pairs wait in a heap, parts form a doubly linked list, so the work is n log n
    however long an unbroken text is.
    """
    n = len(word)
    end = list(range(1, n + 1))  # where the part that begins here ends; -1 once swallowed
    before = list(range(-1, n - 1))
    get = ranks.get
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        middle = end[i]
        if middle < 0 or middle >= n or end[middle] != stop:
            continue
        end[i], end[middle] = stop, -1
        if stop < n:
            before[stop] = i
            if (r := get(word[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (p := before[i]) >= 0 and (r := get(word[p:stop])) is not None:
            heapq.heappush(heap, (r, p, stop))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[word[i : end[i]]])
        i = end[i]
    return ids


@dataclass
class Spans:
    """The pre-tokens of a slice of texts, with the ids of each distinct one."""

    text: np.ndarray  # which text of the slice
    start: np.ndarray  # first character, from the start of its text
    code: np.ndarray  # which distinct pre-token
    counts: np.ndarray  # number of ids of each distinct pre-token
    flat: np.ndarray  # ids of all distinct pre-tokens, one after another

    def sizes(self) -> np.ndarray:
        """Number of ids of each pre-token."""
        return self.counts[self.code]

    def ids(self) -> np.ndarray:
        """All ids of the slice in order."""
        sizes = self.sizes()
        first = (np.cumsum(self.counts) - self.counts)[self.code]
        place = np.arange(int(sizes.sum()), dtype=np.int64)
        place += np.repeat(first - (np.cumsum(sizes) - sizes), sizes)
        return self.flat[place]


class Encoder:
    """Encodes slices of texts with one vocabulary; one per Python worker."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self.remembered: dict[str, list[int]] = {}

    def _ids(self, word: str) -> list[int]:
        ids = self.remembered.get(word)
        if ids is None:
            if len(self.remembered) >= REMEMBERED:
                self.remembered.clear()
            whole = self.vocabulary.ranks.get(raw := word.encode())
            ids = [whole] if whole is not None else merge_bytes(raw, self.vocabulary.ranks)
            if len(word) <= 64:
                self.remembered[word] = ids
        return ids

    def spans(self, texts: list[str]) -> Spans:
        """Pre-tokens of the texts; an empty text has none."""
        joined = "\n".join([*texts, ""])
        points = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        edges = np.cumsum(lengths + 1) - 1
        if len(points) == len(texts):  # nothing but separators
            none = np.zeros(0, dtype=np.int64)
            return Spans(none, none, none, none, none)
        starts, kinds = pretoken_starts(points, edges)
        sizes = np.diff(starts, append=len(points))
        hashes = hash_spans(points, starts, sizes)
        kept = kinds != EDGE
        starts, sizes, hashes = starts[kept], sizes[kept], hashes[kept]
        code, distinct = pd.factorize(hashes)
        first = np.empty(len(distinct), dtype=np.int64)
        first[code[::-1]] = np.arange(len(code) - 1, -1, -1)
        begin, stop = starts[first], starts[first] + sizes[first]
        words = [joined[a:b] for a, b in zip(begin.tolist(), stop.tolist(), strict=True)]
        whole = self.vocabulary.whole.find(distinct).tolist()
        text_of = self.vocabulary.text_of
        found = [
            [w] if w >= 0 and text_of[w] == word else self._ids(word) for w, word in zip(whole, words, strict=True)
        ]
        counts = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        flat = np.fromiter((i for ids in found for i in ids), dtype=np.int32, count=int(counts.sum()))
        text = np.searchsorted(edges, starts, side="right")
        return Spans(text, starts - (edges - lengths)[text], code, counts, flat)


def slices(texts: list[str | None], chars: int = SLICE_CHARS) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about ``chars`` characters, with the index of the first; null reads as empty."""
    begin, held, run = 0, 0, []
    for i, text in enumerate(texts):
        run.append(text or "")
        held += len(run[-1]) + 1
        if held >= chars:
            yield begin, run
            begin, held, run = i + 1, 0, []
    if run:
        yield begin, run


_encoders: dict[int, Encoder] = {}


def encoder(shared) -> Encoder:
    """The worker's encoder for a broadcast vocabulary."""
    key = shared.value.ranks.__len__(), id(shared.value)
    if key not in _encoders:
        _encoders[key] = Encoder(shared.value)
    return _encoders[key]


def vocabulary(df: DataFrame, path: str):
    """Reads the vocabulary on the driver and broadcasts it; its size does not depend on the data."""
    return df.sparkSession.sparkContext.broadcast(Vocabulary.read(path))


def encode(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``(id, ids array<int>)`` for each row, without special tokens.

    Null and empty texts give an empty list; rows are kept one for one, repeated or null ids
    included; a text that looks like a special token is ordinary text. Nothing is shuffled.
    """
    shared = vocabulary(df, path)
    kind = df.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(shared)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for begin, part in slices(texts):
                spans = own.spans(part)
                per_text = np.bincount(spans.text, weights=spans.sizes(), minlength=len(part)).astype(np.int64)
                offsets = np.concatenate([[0], np.cumsum(per_text)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(spans.ids().astype(np.int32), pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, len(part)), lists], ["id", "ids"])

    rows = df.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_column)


def count_tokens(df: DataFrame, keep: list[str], text_column: str = "text", path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """The columns ``keep`` and ``n_tokens``, the number of ids of each text (0 for null or empty)."""
    shared = vocabulary(df, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(shared)
        for batch in batches:
            sizes = [
                np.bincount(spans.text, weights=spans.sizes(), minlength=len(part)).astype(np.int64)
                for _, part in slices(batch.column(0).to_pylist())
                for spans in [own.spans(part)]
            ]
            total = np.concatenate(sizes) if sizes else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(total)], [*keep, "n_tokens"])

    rows = df.select(F.col(text_column).cast("string").alias("__text"), *keep)
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(run, f"{schema}, n_tokens bigint")
