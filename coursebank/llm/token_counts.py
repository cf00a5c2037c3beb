"""Token counts that follow edits: a segment tree of pre-tokens per document, re-encoded only where an edit touches it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from coursebank.llm.byte_bpe import read_ranks
from coursebank.llm.common import slices

LEAF = 32  # pre-tokens a leaf
CACHE_WORDS = 700_000

EDITS = "array<struct<start:int,length:int,text:string>>"
# What the redaction replaces, and by what.
REDACTIONS = (
    (r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+", "<EMAIL>"),
    (r"(?<!\d)\d{1,3}(?:\.\d{1,3}){3}(?!\d)", "<IP>"),
    (r"\d[\d -]{5,}\d", "<NUMBER>"),
    (r"\b[A-Za-z0-9_]{32,}\b", "<SECRET>"),
)


class CountTree:
    """Pre-tokens of one text under a binary tree whose nodes hold the sums of characters and tokens below them."""

    def __init__(self, text: str, split: Callable[[str], list[str]], count: Callable[[list[str]], list[int]]):
        self.split, self.count, self.recounted = split, count, 0
        pieces = split(text)
        self._build(pieces, count(pieces))

    def _build(self, pieces: list[str], counts: list[int]) -> None:
        self.leaves = [(pieces[i:i + LEAF], counts[i:i + LEAF]) for i in range(0, len(pieces), LEAF)] or [([], [])]
        self.width = 1 << (len(self.leaves) - 1).bit_length()
        self.sums = np.zeros((2 * self.width, 2), np.int64)
        for i, (p, c) in enumerate(self.leaves):
            self.sums[self.width + i] = sum(map(len, p)), sum(c)
        level = self.width
        while level > 1:
            self.sums[level // 2:level] = self.sums[level:2 * level:2] + self.sums[level + 1:2 * level:2]
            level //= 2

    @property
    def chars(self) -> int:
        return int(self.sums[1, 0])

    @property
    def tokens(self) -> int:
        """Tokens of the whole text: the sum at the root."""
        return int(self.sums[1, 1])

    def text(self) -> str:
        return "".join("".join(p) for p, _ in self.leaves)

    def _find(self, at: int) -> tuple[int, int]:
        """Leaf that holds character ``at``, and the place of its first character."""
        node, start = 1, 0
        while node < self.width:
            node *= 2
            if at >= start + self.sums[node, 0] and self.sums[node + 1, 0]:
                start += int(self.sums[node, 0])
                node += 1
        return min(node - self.width, len(self.leaves) - 1), start

    def _put(self, leaf: int, pieces: list[str], counts: list[int]) -> None:
        self.leaves[leaf] = pieces, counts
        node = self.width + leaf
        delta = np.array([sum(map(len, pieces)), sum(counts)], np.int64) - self.sums[node]
        while node:
            self.sums[node] += delta
            node //= 2

    def replace(self, start: int, length: int, text: str) -> None:
        """Replace ``length`` characters at ``start``.

        A pre-token depends on its own text and the character after it, so those that end before start - 1 stay.
        Splitting goes on from there until a new boundary meets an old one behind the edit; the rest stays too.
        """
        stop = start + length
        first, begin = self._find(max(start - 2, 0))
        last, upto, reach = first, begin, 1
        pieces: list[str] = []
        counts: list[int] = []
        while True:
            while last < len(self.leaves) and (upto <= stop or reach > 0):
                if upto > stop:
                    reach -= 1
                p, c = self.leaves[last]
                pieces, counts, upto, last = pieces + p, counts + c, upto + sum(map(len, p)), last + 1
            ends = np.cumsum([begin, *map(len, pieces)])
            at_end = last >= len(self.leaves)
            keep = int(np.searchsorted(ends[1:], max(start - 1, begin), "left")) if start > begin else 0
            old = "".join(pieces[keep:])
            base = int(ends[keep])
            fresh_text = old[:start - base] + text + old[stop - base:]
            fresh = self.split(fresh_text)
            shift, place, met = len(text) - length, base, None
            old_ends = {int(e): i for i, e in enumerate(ends) if e >= stop}
            for i, piece in enumerate(fresh):
                place += len(piece)
                if place - shift in old_ends and (at_end or place + 1 < base + len(fresh_text)):
                    met = i + 1, old_ends[place - shift]
                    break
            if met or at_end:
                break
            reach = 4
        n, rest = met or (len(fresh), len(pieces))
        new = fresh[:n]
        self.recounted += len(new)
        pieces = pieces[:keep] + new + pieces[rest:]
        counts = counts[:keep] + self.count(new) + counts[rest:]
        if len(pieces) > 8 * LEAF * (last - first):
            every = self.leaves[:first] + [(pieces, counts)] + self.leaves[last:]
            self._build([x for p, _ in every for x in p], [x for _, c in every for x in c])
            return
        share = -(-len(pieces) // (last - first)) or 1
        for i in range(last - first):
            self._put(first + i, pieces[i * share:(i + 1) * share], counts[i * share:(i + 1) * share])


_loaded: dict[tuple[str, str], tuple] = {}


def _counter(ranks: str, pattern: str):
    """Splitter of a pattern and counter of a rank file, kept by the worker process."""
    if (ranks, pattern) not in _loaded:
        import tiktoken

        code = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=read_ranks(ranks), special_tokens={})
        known: dict[str, int] = {}

        def count(pieces: list[str]) -> list[int]:
            if len(known) > CACHE_WORDS:
                known.clear()
            for p in set(pieces):
                if p not in known:
                    known[p] = len(code.encode_ordinary(p))
            return [*map(known.__getitem__, pieces)]

        _loaded[ranks, pattern] = regex.compile(pattern).findall, count
    return _loaded[ranks, pattern]


def ordered_edits(edits, n_chars: int) -> list[tuple[int, int, str]]:
    """Usable edits from last to first: null, negative or outside starts go; lengths end at the next edit or the text."""
    good = sorted({(e["start"], max(e["length"] or 0, 0), e["text"] or "") for e in edits or []
                   if e and e["start"] is not None and 0 <= e["start"] <= n_chars})
    out, limit = [], n_chars
    for start, length, text in reversed(good):
        out.append((start, min(length, limit - start), text))
        limit = start
    return out


def merged(found: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Overlapping matches (start, end, mark) as one from the least start to the greatest end, with the longest's mark."""
    out: list[tuple[int, int, str]] = []
    longest = 0
    for start, end, mark in sorted(found):
        if out and start < out[-1][1]:
            a, b, m = out[-1]
            out[-1] = a, max(b, end), mark if end - start > longest else m
            longest = max(longest, end - start)
        else:
            out.append((start, end, mark))
            longest = end - start
    return out


def redactions(docs: DataFrame) -> DataFrame:
    """Add ``edits``: replacements of mail and IP addresses, long numbers and long secrets by a mark, none overlapping."""
    find = [(regex.compile(p), mark) for p, mark in REDACTIONS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            rows = []
            for text in part.column(1).to_pylist():
                found: list[tuple[int, int, str]] = []
                for pattern, mark in find:
                    found += [(m.start(), m.end(), mark) for m in pattern.finditer(text or "")]
                rows.append([{"start": a, "length": b - a, "text": mark} for a, b, mark in merged(found)])
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(rows, kind)],
                                             names=["doc_id", "text", "edits"])

    kind = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("text", pa.string())]))
    id_kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_kind}, text string, edits {EDITS}")


def count_edited(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """Token counts of every document before and after its edits.

    Takes ``doc_id``, ``text`` and ``edits`` (start and length in characters of the text, replacement). A null text is
    empty, null edits are none; an edit that reaches into the next one ends where that begins. Returns ``doc_id``,
    ``n_before``, ``n_edits``, ``n_recounted`` (pre-tokens encoded again), ``n_after``. Documents are independent, so
    nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, count = _counter(ranks, pattern)
        for part in slices(batches, 1):
            rows = []
            for text, edits in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                if edits:
                    tree = CountTree(text or "", split, count)
                    before, todo = tree.tokens, ordered_edits(edits, tree.chars)
                    for edit in todo:
                        tree.replace(*edit)
                    rows.append((before, len(todo), tree.recounted, tree.tokens))
                else:
                    n = sum(count(split(text or "")))
                    rows.append((n, 0, 0, n))
            columns = [pa.array(list(c), pa.int64()) for c in zip(*rows)]
            yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=[
                "doc_id", "n_before", "n_edits", "n_recounted", "n_after"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", "edits").mapInArrow(
        run, f"doc_id {kind}, n_before long, n_edits long, n_recounted long, n_after long")
