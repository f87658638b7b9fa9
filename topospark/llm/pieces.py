"""Cutting long texts into overlapping pieces along their own structure.

A text is read as a tree: parts below headings (nested as their marks say), below them numbered
paragraphs and lists (nested as their styles of numbering open one inside the other), blocks
between blank lines, sentences, lines, words. Whole sibling subtrees are merged up to the limit,
bottom-up; only a node over the limit is descended into.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topospark.llm.tokens import encoder, slices, vocabulary
from topospark.llm.vocabulary import DEFAULT_VOCABULARY

PART, PARAGRAPH, BLOCK, SENTENCE, LINE, WORD, TOKEN = range(7)
KINDS = ["part", "paragraph", "block", "sentence", "line", "word", "token"]
END = "end"

DEPTHS = 16  # strength of a break: kind * DEPTHS + depth within the kind

_LINE = re.compile(r"[^\s][^\n]*")
_MARKER = re.compile(
    r"(?P<label>¶|§+|Rn\.|Rz\.|Nr\.|No\.|[Nn][°º]|Ziff\.|[Pp]ara\.?|Art\.)?\s*(?P<open>[\[(]?)"
    r"(?:(?P<digits>\d{1,4}(?:\.\d{1,3}){0,5})[a-z]?|(?P<roman>[IVXLC]{1,6}|[ivx]{1,5})|(?P<letter>[a-zA-Z]))"
    r"(?P<close>[\])]?[.):]?)\s+\S"
)
_BULLET = re.compile(r"(?P<mark>[-*•–])\s+\S")
_HASHES = re.compile(r"(#{1,6}) ")
_HEADING = re.compile(r"[^\W\d_][^|\t]{0,58}[^\s.;:,!?…|-]$")
_PAGE = re.compile(r"\W*(?:page|seite|pág(?:ina)?|p)\b\.?\s*\d", re.IGNORECASE)
_SENTENCE = re.compile(r"([.!?;…]+[\"'”»)\]]*)\s+(?=[^\W\d_a-z]|[\"“«(\[—])")
_ABBREVIATION = re.compile(r"(?:^|.*[^\w])(?:\w|[A-Z]\w{1,2})$", re.DOTALL)  # v. / P. / Mw. / Kmk.
_CLOSED = tuple(".!?;:…)]\"”»")
_WRAPPED = 60  # a line at least this long that ends in mid-sentence was wrapped by its writer


def style_of(line: str, indent: int) -> tuple | None:
    """The style of numbering a line begins with, None if it begins with none."""
    if m := _BULLET.match(line):
        return ("bullet", m["mark"], indent // 2)
    if not (m := _MARKER.match(line)):
        return None
    around = m["label"] or "", m["open"], m["close"]
    if m["digits"]:
        return ("digits", m["digits"].count("."), *around)
    bracket = m["open"] or ")" in m["close"] or "]" in m["close"]
    if m["roman"] and (bracket or (m["close"] and m["roman"].isupper())):
        return ("roman", m["roman"].isupper(), *around)
    return ("letter", m["letter"].isupper(), *around) if m["letter"] and bracket else None


class Nesting:
    """Depths of the numbering styles that are open; a new style opens inside the last, a known one closes those inside it."""

    def __init__(self) -> None:
        self.open: list[tuple] = []

    def depth(self, style: tuple) -> int:
        if style in self.open:
            del self.open[self.open.index(style) + 1 :]
        else:
            # 1.2 lies inside 1., also where 1.2.1 came first
            while style[0] == "digits" and self.open and self.open[-1][0] == "digits" and self.open[-1][1] > style[1]:
                self.open.pop()
            self.open.append(style)
        return min(len(self.open), DEPTHS) - 1


def breaks(text: str) -> list[tuple[int, int]]:
    """``(character, strength)`` of every natural break, in order of the characters, the strongest only; smaller is stronger."""
    at: dict[int, int] = {}
    for m in _SENTENCE.finditer(text):
        dot = m.start()
        if text[dot] != "." or not _ABBREVIATION.match(text[max(0, dot - 4) : dot]):
            at[m.end(1)] = SENTENCE * DEPTHS
    previous_end, closed, nesting = 0, True, Nesting()
    for m in _LINE.finditer(text):
        line, start = m.group().rstrip(), m.start()
        blank = start - previous_end > 1 and text.count("\n", previous_end, start) > 1
        kind, depth = (BLOCK if blank else LINE), 0
        if (closed or blank) and not _PAGE.match(line):
            indent = start - text.rfind("\n", 0, start) - 1
            if hashes := _HASHES.match(line):
                kind, depth, nesting = PART, len(hashes[1]) - 1, Nesting()
            elif style := style_of(line, indent):
                kind, depth = PARAGRAPH, nesting.depth(style)
            elif len(line) <= _WRAPPED and _HEADING.match(line):
                kind, nesting = PART, Nesting()
        if start:
            at[start] = kind * DEPTHS + depth
        closed = line.endswith(_CLOSED) or len(line) < _WRAPPED
        previous_end = m.end()
    return sorted(at.items())


def pack_tree(breaks_at: np.ndarray, strengths: np.ndarray, words: np.ndarray, total: int, limit: int) -> list[int]:
    """Ends of the pieces of ``total`` tokens, each piece at most ``limit`` long.

    ``breaks_at`` are token positions of the breaks with their ``strengths``; ``words`` are the
    token positions at which words begin. The children of a node lie between its breaks of one
    strength. Whole children join the piece before them while it stays under the limit; below
    the parts also the ends of a child that was cut do, so that no scrap is left alone.
    """
    known = np.unique(strengths).tolist()
    own = [breaks_at[strengths == k] for k in known]

    def descend(low: int, high: int, level: int) -> list[int]:
        if high - low <= limit:
            return [high]
        while level < len(known):
            inner = own[level][np.searchsorted(own[level], low, side="right") : np.searchsorted(own[level], high, side="left")].tolist()
            if inner:
                break
            level += 1
        else:
            ends, here = [], low
            while high - here > limit:
                word = words[np.searchsorted(words, here + limit, side="right") - 1]
                here = int(word) if word > here else here + limit
                ends.append(here)
            return [*ends, high]
        ends: list[int] = []
        begin = open_from = low  # open_from: where the piece that may still grow begins
        loose, before_whole = known[level] >= PARAGRAPH * DEPTHS, True
        for child_end in [*inner, high]:
            child = descend(begin, child_end, level + 1)
            whole = len(child) == 1
            for end in child:
                if ends and end - open_from <= limit and (loose or (whole and before_whole)):
                    ends[-1] = end
                else:
                    open_from = ends[-1] if ends else low
                    ends.append(end)
            begin, before_whole = child_end, whole
        return ends

    return descend(0, total, 0)


def split_long(
    df: DataFrame,
    limit: int = 512,
    overlap: int = 64,
    id_column: str = "doc_id",
    text_column: str = "text",
    path: str = DEFAULT_VOCABULARY,
) -> DataFrame:
    """Pieces of every text of more than ``limit`` tokens; shorter, empty and null texts give none.

    Columns: the id, ``piece_no`` from 0, ``token_start`` and ``token_end`` (places among the
    tokens of the whole text), ``n_tokens`` (at most ``limit``), ``ends_at`` (the kind of break
    at the end) and ``text``. Every piece but the first begins exactly ``overlap`` tokens before
    the end of the one before. Where that falls inside a character, the text begins with the
    whole character. Repeated and null ids are kept row for row. Nothing is shuffled.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than limit")
    shared = vocabulary(df, path)
    fresh = limit - overlap
    id_type = df.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(shared)
        word_of = {rank: token for token, rank in own.vocabulary.ranks.items()}
        for batch in batches:
            for begin, part in slices(batch.column(1).to_pylist()):
                spans = own.spans(part)
                sizes = spans.sizes()
                first_of_code = np.cumsum(spans.counts) - spans.counts
                bounds = np.searchsorted(spans.text, np.arange(len(part) + 1))
                out: list[tuple] = []
                for i, text in enumerate(part):
                    a, b = int(bounds[i]), int(bounds[i + 1])
                    ends_after = np.cumsum(sizes[a:b])
                    total = int(ends_after[-1]) if b > a else 0
                    if total <= limit:
                        continue
                    words = np.concatenate([[0], ends_after])
                    chars = np.append(spans.start[a:b], len(text))
                    found = breaks(text)
                    at = words[np.searchsorted(chars, [c for c, _ in found])] if found else np.zeros(0, dtype=np.int64)
                    strengths = np.array([k for _, k in found], dtype=np.int64)
                    cuts = pack_tree(at, strengths, words, total, fresh)
                    if len(cuts) > 1 and cuts[1] <= limit:  # the first piece has nothing to share
                        del cuts[0]
                    strongest: dict[int, int] = {}
                    for place, k in zip(at.tolist(), (strengths // DEPTHS).tolist(), strict=True):
                        strongest[place] = min(k, strongest.get(place, TOKEN))

                    def char(place: int, a=a, words=words, chars=chars) -> int:
                        w = int(np.searchsorted(words, place, side="right")) - 1
                        if words[w] == place:
                            return int(chars[w])
                        f = int(first_of_code[spans.code[a + w]])
                        raw = b"".join(word_of[t] for t in spans.flat[f : f + place - int(words[w])].tolist())
                        return int(chars[w]) + len(raw.decode("utf-8", "ignore"))

                    before = 0
                    known = set(words.tolist())
                    for n, end in enumerate(cuts):
                        low = max(0, before - overlap) if n else 0
                        kind = END if end == total else KINDS[strongest.get(end, WORD if end in known else TOKEN)]
                        out.append((begin + i, n, low, end, end - low, kind, text[char(low) : char(end)]))
                        before = end
                if out:
                    row, *columns = zip(*out, strict=True)
                    types = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string()]
                    arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), *arrays], names)

    names = ["id", "piece_no", "token_start", "token_end", "n_tokens", "ends_at", "text"]
    rows = df.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    schema = f"id {id_type}, piece_no int, token_start bigint, token_end bigint, n_tokens int, ends_at string, text string"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_column)
