"""Byte-level BPE by DuckDB: recursive contraction of token-position rows, ordered aggregation back to bytes."""

from __future__ import annotations

import base64
import gc
import heapq
from array import array
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from coursebank.llm.common import give_back, slices

CACHE_BYTES = 50_000_000  # of coded words that a task keeps, about
WORD_BYTES = 160  # of a coded word in the cache, besides its characters and ids
DUCK_MEMORY = "200MB"
LEARN_WORDS = 10_000
ENCODE_BYTES = 2_000_000
LONG = 200  # bytes, under 256

# Token-position rows (word, pos, id) with their right neighbour. Each step joins them with the merge table, finds the
# leftmost pair of least rank of every word (rank and place in one number), and contracts it; words without such a
# pair leave the recursion. A word's last step holds its result.
CONTRACT = """
WITH RECURSIVE c(step, word, pos, id, next_id, next_pos) AS (
  SELECT 0, word, pos, id, lead(id) OVER w, lead(pos) OVER w
  FROM start_rows WINDOW w AS (PARTITION BY word ORDER BY pos)
  UNION ALL
  (WITH least AS (
     SELECT word, min(m.id * 256::BIGINT + pos) AS pair
     FROM c JOIN merges m ON m.l = c.id AND m.r = c.next_id GROUP BY word
   ), pair AS (
     SELECT word, (pair >> 8)::INT AS merged, pos AS here, next_pos AS gone
     FROM least JOIN c USING (word) WHERE pos = pair & 255
   ), found AS (
     SELECT pair.*, c.next_id AS then_id, c.next_pos AS then_pos
     FROM pair JOIN c ON c.word = pair.word AND c.pos = gone)
  SELECT step + 1, word, pos, CASE WHEN pos = here THEN merged ELSE id END,
         CASE WHEN pos = here THEN then_id WHEN next_pos = here THEN merged ELSE next_id END,
         CASE WHEN pos = here THEN then_pos ELSE next_pos END
  FROM c JOIN found USING (word) WHERE pos <> gone)
), last AS (SELECT word, max(step) AS step FROM c GROUP BY word)
SELECT c.word, c.pos, c.id FROM c JOIN last USING (word, step)
"""


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def _heap_merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same contraction for a very long word, whose rows times steps would be quadratic."""
    n = len(word)
    nxt, prev, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    alive = [True] * n

    def pair(i: int):
        j = nxt[i]
        return ranks.get(word[i:end[j]]) if j < n else None

    heap = [(r, i, i + 2) for i in range(n - 1) if (r := pair(i)) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, to = heapq.heappop(heap)
        j = nxt[i]
        if not alive[i] or j >= n or end[j] != to:
            continue
        alive[j], end[i], nxt[i] = False, to, nxt[j]
        if nxt[j] < n:
            prev[nxt[j]] = i
        for k in (prev[i], i):
            if k >= 0 and (r := pair(k)) is not None:
                heapq.heappush(heap, (r, k, end[nxt[k]]))
    return [ranks[word[i:end[i]]] for i in range(n) if alive[i]]


class Sequences:
    """Sequences of numbers end to end, each found by its place: no object for any of them."""

    def __init__(self, kind: str):
        self.flat, self.ends = array(kind), array("q", [0])

    def __len__(self) -> int:
        return len(self.ends) - 1

    def add(self, some: list[int] | bytes) -> None:
        self.flat.extend(some)
        self.ends.append(len(self.flat))

    def joined(self, places: np.ndarray) -> np.ndarray:
        """The sequences at these places, one after the other."""
        ends = np.asarray(self.ends)
        lo = ends[places]
        n = ends[places + 1] - lo
        return np.asarray(self.flat)[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())]

    def kept(self, places: np.ndarray) -> Sequences:
        """Only the sequences at these places."""
        out, ends = Sequences(self.flat.typecode), np.asarray(self.ends)
        out.flat.frombytes(self.joined(places).tobytes())
        out.ends.frombytes(np.cumsum(ends[places + 1] - ends[places]).tobytes())
        return out


class Bpe:
    """Merge table and vocabulary in a DuckDB of the task, and the words it has coded."""

    def __init__(self, path: str, pattern: str):
        self.ranks = read_ranks(path)
        self.split = regex.compile(pattern).findall
        merges = array("i", (x for t, r in self.ranks.items() for k in range(1, len(t))
                             if t[:k] in self.ranks and t[k:] in self.ranks for x in (self.ranks[t[:k]], self.ranks[t[k:]], r)))
        l, r, i = (pa.array(x) for x in np.asarray(merges).reshape(-1, 3).T)
        self.tables = {"merges": {"l": l, "r": r, "id": i}, "vocabulary": {
            "id": pa.array(list(self.ranks.values()), pa.int32()), "hex": pa.array([t.hex() for t in self.ranks])}}
        self.byte_id = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.con = None
        self.forget()

    def forget(self) -> None:
        """An empty cache: words by place, and at each place the ids and the bytes decoded from them."""
        self.known: dict[str, int] = {}
        self.ids, self.raw = Sequences("i"), Sequences("B")

    def size(self) -> int:
        """Bytes of the cache, about; a word's characters and its decoded bytes are as many."""
        return WORD_BYTES * len(self.known) + 4 * len(self.ids.flat) + 2 * len(self.raw.flat)

    def open(self) -> None:
        """A database in memory with the merge table and the vocabulary, for one task."""
        self.con = duckdb.connect(config={"threads": 1})
        self.con.execute(f"SET memory_limit = '{DUCK_MEMORY}'")
        for name, columns in self.tables.items():
            self._table(name, columns)

    def close(self) -> None:
        """Give back the database and the words; between tasks a worker only holds the ranks."""
        self.con.close()
        self.con = None
        self.forget()

    def _table(self, name: str, columns: dict) -> None:
        self.con.register("arriving", pa.table(columns))
        self.con.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM arriving")
        self.con.unregister("arriving")

    def learn(self, new: list[str]) -> None:
        """Contract words not seen before; keep their ids, and the bytes that ordered aggregation decodes from these."""
        raw = [w.encode("utf-8", "surrogatepass") for w in new]
        word, pos, ids, short = [], [], [], []
        for i, b in enumerate(raw):
            if b in self.ranks:  # a whole token is never split
                done = [self.ranks[b]]
            elif len(b) > LONG:
                done = _heap_merge(b, self.ranks)
            else:
                short.append(i)
                continue
            word += [i] * len(done)
            pos += range(len(done))
            ids += done
        self._table("done_rows", {"word": pa.array(word, pa.int32()), "pos": pa.array(pos, pa.int32()),
                                  "id": pa.array(ids, pa.int32())})
        lens = np.array([len(raw[i]) for i in short], np.int64)
        flat = np.frombuffer(b"".join(raw[i] for i in short), np.uint8)
        at = np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)
        self._table("start_rows", {"word": pa.array(np.repeat(np.array(short, np.int64), lens), pa.int32()),
                                   "pos": pa.array(at, pa.int32()), "id": pa.array(self.byte_id[flat], pa.int32())})
        rows = self.con.execute(f"""
            SELECT word, list(id ORDER BY pos), string_agg(hex, '' ORDER BY pos)
            FROM (FROM done_rows UNION ALL FROM ({CONTRACT})) JOIN vocabulary USING (id) GROUP BY word""").fetchall()
        for i, ids, hexed in rows:
            self.known[new[i]] = len(self.ids)
            self.ids.add(ids)
            self.raw.add(bytes.fromhex(hexed))

    def encode(self, texts: list[str]) -> tuple[list[bytes], list[bytes]]:
        """Per text the ids as 32-bit integers, and the bytes that the ids decode to."""
        place = defaultdict(count().__next__)  # of a word in this slice; texts are held as places, not as strings
        pieces = [array("i", map(place.__getitem__, self.split(t))) for t in texts]
        words = [*place]
        del place
        if self.size() > CACHE_BYTES:  # words of this slice that an earlier one had are likely to come again
            again = [w for w in words if w in self.known]
            at = np.array([self.known[w] for w in again], np.int64)
            self.ids, self.raw = self.ids.kept(at), self.raw.kept(at)
            self.known = {w: i for i, w in enumerate(again)}
            if self.size() > CACHE_BYTES // 2:
                self.forget()
        new = [w for w in words if w not in self.known]
        for lo in range(0, len(new), LEARN_WORDS):
            self.learn(new[lo:lo + LEARN_WORDS])
        at = np.array([self.known[w] for w in words], np.int64)
        docs = [at[np.asarray(doc)] for doc in pieces]
        return [self.ids.joined(doc).tobytes() for doc in docs], [self.raw.joined(doc).tobytes() for doc in docs]


_loaded: dict[tuple[str, str], Bpe] = {}


def loaded(path: str, pattern: str) -> Bpe:
    """The worker's coder for a rank file; its ranks are kept between tasks, its database and words are not."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = Bpe(path, pattern)
    return _loaded[path, pattern]


def encode_documents(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """``doc_id``, ``ids`` (int array) and ``decoded`` (binary, made from the ids) of every document.

    Takes ``doc_id`` and ``text``; a null text counts as empty and has no ids. Rows are independent: nothing is
    shuffled, and a lost task is run again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = loaded(ranks, pattern)
        gc.disable()  # no cycles are made here, and a large cache makes every collection long
        coder.open()
        try:
            for part in slices(batches, 1, ENCODE_BYTES):
                ids, raw = coder.encode([t or "" for t in part.column(1).to_pylist()])
                ends = pa.array(np.cumsum([0, *map(len, ids)]) // 4, pa.int32())
                lists = pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(b"".join(ids), np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(raw, pa.binary())],
                                                 names=["doc_id", "ids", "decoded"])
        finally:
            gc.enable()
            coder.close()
            give_back()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded binary")
