"""Benchmark decontamination with suffix arrays.

Each slice of training documents is a shard. Its words become numbers in the
tests' vocabulary (any other word ends a suffix, as no match goes beyond it),
and all its suffixes are sorted to their full depth: by the words that fit
into 64 bits first, then by doubling. Every test suffix is looked up in it by
binary search: the range of shard suffixes that begin with its first window
(or with all of a shorter item) is where it occurs. For every such place the
longest verbatim match is found by binary search among the test suffixes that
begin with that window, which are sorted too.

Nothing is shuffled: test items travel to the documents. A benchmark of one
block is broadcast (``block_bytes`` and one item bound it); of a larger one
the blocks are files in the shared folder, and each task reads one at a time,
for ``CHUNK_BYTES`` of documents.

Defined results: null, empty or wordless texts have no hits; texts of any
length are read whole; items without words are ignored; an item id that occurs
twice counts once; a null item id is listed as ``null``; an empty benchmark
leaves every document clean, an empty table gives none; rows that share a
doc_id, repeated rows too, are judged separately; columns of any name stay as
they are.
"""

from __future__ import annotations

import hashlib
import pickle
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm import wordhash as W
from kinfold.llm.common import shared_dir

#: Consecutive words of an item that make a match.
WINDOW = 10
#: Bytes of benchmark text in a block; a larger benchmark takes more blocks.
BLOCK_BYTES = 16 << 20
#: Bytes of documents that meet a block each time it is read.
CHUNK_BYTES = 32 << 20

SCHEMA = (
    "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, "
    "longest_match long, items array<string>, hit_spans array<struct<start: long, length: long>>"
)


class Suffixes:
    """Words as numbers (0: none of the vocabulary) and their suffixes in order.

    ``run[p]`` is how many words from p on lie in one text and in the
    vocabulary; ``key[p]`` packs the first ``per`` of them.
    """

    def __init__(self, ids: np.ndarray, first: np.ndarray, bits: int):
        n = len(ids)
        self.bits, self.per = bits, 64 // bits
        at = np.arange(n)
        other = np.append(np.flatnonzero(ids == 0), n)
        self.run = np.minimum(other[np.searchsorted(other, at)], np.repeat(first[1:], np.diff(first))) - at
        self.key = np.zeros(n, W.U64)
        wide = np.concatenate((ids.astype(W.U64), np.zeros(self.per, W.U64)))
        for j in range(self.per):
            self.key = (self.key << W.U64(bits)) | np.where(self.run > j, wide[j : j + n], W.U64(0))
        self.order = self._sorted()
        self.head = self.key[self.order]

    def later(self, p: np.ndarray, depth: int | np.ndarray) -> np.ndarray:
        """The key ``depth`` words on."""
        return np.where(self.run[p] > depth, self.key[np.minimum(p + depth, max(len(self.key) - 1, 0))], W.U64(0))

    def _sorted(self) -> np.ndarray:
        some = np.flatnonzero(self.run)
        order = some[np.argsort(self.key[some], kind="stable")]
        rank = np.zeros(len(self.key) + 1, np.int64)  # 1 + the first place of the suffixes that agree so far
        tied, depth = self._ranked(order, np.arange(len(order)), self.key[order], np.zeros(len(order), np.int64), rank, self.per), self.per
        while len(tied):
            p = order[tied]
            more = rank[np.where(self.run[p] > depth, p + depth, len(self.key))]
            by = np.lexsort((more, rank[p]))
            order[tied] = p[by]
            depth *= 2
            tied = self._ranked(order, tied, more[by], rank[p[by]], rank, depth)
        return order

    def _ranked(self, order: np.ndarray, places: np.ndarray, key: np.ndarray, group: np.ndarray, rank: np.ndarray, depth: int) -> np.ndarray:
        """Set the ranks of the suffixes at ``places``, which are sorted by ``group`` and ``key``; those that are still to be told apart."""
        if not len(places):
            return places
        new = np.ones(len(places), bool)
        new[1:] = (key[1:] != key[:-1]) | (group[1:] != group[:-1])
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(places)))
        rank[order[places]] = 1 + np.repeat(places[first], size)
        goes_on = np.logical_or.reduceat(self.run[order[places]] > depth, first)
        return places[np.repeat((size > 1) & goes_on, size)]

    def find(self, other: Suffixes, at: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By suffix ``at`` of ``other``, the range of the order whose suffixes begin with its first ``length`` words."""
        lo = hi = np.zeros(len(at), np.int64)
        done = 0
        live = np.arange(len(at))
        while len(live):
            width = np.minimum(length[live] - done, self.per)
            low = W.U64(self.bits) * (self.per - width).astype(W.U64)
            key = other.later(at[live], done)
            floor = (key >> low) << low
            top = floor | ((W.U64(1) << low) - W.U64(1))
            if done == 0:
                lo, hi = np.searchsorted(self.head, floor, "left"), np.searchsorted(self.head, top, "right")
            else:
                a, b = lo[live], hi[live]
                lo[live], hi[live] = self._bound(a, b, floor, done, False), self._bound(a, b, top, done, True)
            done += self.per
            live = live[(length[live] > done) & (lo[live] < hi[live])]
        return lo, hi

    def _bound(self, a: np.ndarray, b: np.ndarray, key: np.ndarray, depth: int, beyond: bool) -> np.ndarray:
        a, b = a.copy(), b.copy()
        while (a < b).any():
            mid = (a + b) >> 1
            x = self.later(self.order[np.minimum(mid, len(self.order) - 1)], depth)
            right = (a < b) & ((x <= key) if beyond else (x < key))
            a, b = np.where(right, mid + 1, a), np.where((a < b) & ~right, mid, b)
        return a


class Spans:
    """Hashes of any span of words, and common lengths by binary search."""

    def __init__(self, hashes: np.ndarray):
        self.sums = np.concatenate(([W.U64(0)], np.cumsum(hashes * W.powers(len(hashes))[0][: len(hashes)], dtype=W.U64)))

    def of(self, at: np.ndarray, length: np.ndarray) -> np.ndarray:
        return (self.sums[at + length] - self.sums[at]) * W.powers(len(self.sums))[1][at]

    def common(self, at: np.ndarray, other: Spans, there: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many words from ``at`` and from ``there`` on agree, up to ``most``."""
        a, b = np.zeros(len(at), np.int64), most.copy()
        while (a < b).any():
            mid = (a + b + 1) >> 1
            same = (a < b) & (self.of(at, mid) == other.of(there, mid))
            a, b = np.where(same, mid, a), np.where((a < b) & ~same, mid - 1, b)
        return a


@dataclass
class TestBlock:
    """A block of test items: their vocabulary, their suffixes, and the distinct windows that begin these."""

    vocabulary: np.ndarray  # sorted word hashes; a word's number is its place and 1
    suffixes: Suffixes
    spans: Spans
    at: np.ndarray  # a place of each window
    length: np.ndarray
    begin: np.ndarray  # range of the order that begins with the window
    end: np.ndarray
    item_of: np.ndarray  # item number of each occurrence, by window
    offsets: np.ndarray  # occurrences of window u: offsets[u] to offsets[u + 1]
    items: list[str]


def test_block(items: list[str], texts: list[str | None], window: int = WINDOW) -> TestBlock | None:
    w = W.split(W.as_strings(pa.array(texts, pa.large_string())), W.ALNUM)
    n = np.diff(w.first)
    doc, inside = w.doc(), np.arange(len(w.hash)) - np.repeat(w.first[:-1], n)
    left = np.repeat(n, n) - inside
    at = np.flatnonzero((left >= window) | (inside == 0))
    if not len(at):
        return None
    length = np.minimum(left[at], window)
    hashes = W.span_hash(w, at, length)
    order = np.argsort(hashes, kind="stable")
    at, length = at[order], length[order]
    _, first = np.unique(hashes[order], return_index=True)
    vocabulary, ids = np.unique(w.hash, return_inverse=True)
    suffixes = Suffixes(ids + 1, w.first, len(vocabulary).bit_length())
    begin, end = suffixes.find(suffixes, at[first], length[first])
    return TestBlock(vocabulary, suffixes, Spans(w.hash), at[first], length[first], begin, end, doc[at], np.append(first, len(at)), items)


def test_blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int, window: int) -> Iterator[TestBlock]:
    """Blocks of items, streamed through the driver one at a time."""
    items: list[str] = []
    texts: list[str] = []
    size = 0
    rows = benchmark.select(F.col(item_col).cast("string"), F.col(text_col).cast("string")).toLocalIterator()
    for item, text in rows:
        items.append("null" if item is None else item)
        texts.append(text or "")
        size += len(texts[-1])
        if size >= block_bytes:
            if block := test_block(items, texts, window):
                yield block
            items, texts, size = [], [], 0
    if items and (block := test_block(items, texts, window)):
        yield block


class Shard:
    """A slice of documents and what was found in it."""

    def __init__(self, rows: pa.Array):
        self.w = W.split(rows, W.ALNUM)
        self.edge = np.zeros(len(self.w.hash) + 1, np.int64)
        self.items: list[set[str]] = [set() for _ in range(self.w.n_docs)]
        self.longest = np.zeros(self.w.n_docs, np.int64)
        self.doc = self.w.doc()

    def search(self, block: TestBlock, whole: bool) -> None:
        """Mark every verbatim occurrence of a window; with ``whole`` also the items and the longest matches."""
        if not len(self.w.hash):
            return
        number = np.minimum(np.searchsorted(block.vocabulary, self.w.hash), len(block.vocabulary) - 1)
        ids = np.where(block.vocabulary[number] == self.w.hash, number + 1, 0)
        own = Suffixes(ids, self.w.first, block.suffixes.bits)
        lo, hi = own.find(block.suffixes, block.at, block.length)
        found = np.flatnonzero(lo < hi)
        if not len(found):
            return
        count = (hi - lo)[found]
        place, window = own.order[W.ranges(lo[found], count)], np.repeat(found, count)
        np.add.at(self.edge, place, 1)
        np.add.at(self.edge, place + block.length[window], -1)
        if not whole:
            return
        np.maximum.at(self.longest, self.doc[place], self._longest(own, place, window, block))
        pair = np.unique(self.doc[place] * len(block.length) + window)
        of, window = np.divmod(pair, len(block.length))
        count = block.offsets[window + 1] - block.offsets[window]
        pair = np.unique(np.repeat(of, count) * len(block.items) + block.item_of[W.ranges(block.offsets[window], count)])
        for d, i in zip(*np.divmod(pair, len(block.items)), strict=True):
            self.items[d].add(block.items[i])

    def _longest(self, own: Suffixes, place: np.ndarray, window: np.ndarray, block: TestBlock) -> np.ndarray:
        """The longest match from each place on: binary search among the test suffixes that begin with its window, whose neighbours agree longest."""
        mine, tests = Spans(self.w.hash), block.suffixes
        a, b = block.begin[window].copy(), block.end[window].copy()

        def agree(k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            there = tests.order[k]
            return there, mine.common(place, block.spans, there, np.minimum(own.run[place], tests.run[there]))

        while (a < b).any():
            mid = (a + b) >> 1
            there, n = agree(np.minimum(mid, len(tests.order) - 1))
            right = (a < b) & (tests.later(there, n) < own.later(place, n))
            a, b = np.where(right, mid + 1, a), np.where((a < b) & ~right, mid, b)
        before, after = np.maximum(a - 1, block.begin[window]), np.minimum(a, block.end[window] - 1)
        return np.maximum(agree(before)[1], agree(after)[1])

    def hits(self) -> np.ndarray:
        """Words in matches, by document."""
        return np.diff(np.concatenate(([0], np.cumsum(np.cumsum(self.edge[:-1]) > 0)))[self.w.first])

    def rows(self) -> Iterator[tuple]:
        hit, n_hit, w = np.cumsum(self.edge[:-1]) > 0, self.hits(), self.w
        for d in range(w.n_docs):
            found = sorted(self.items[d])
            spans = []
            if found:
                flags = np.concatenate(([False], hit[w.first[d] : w.first[d + 1]], [False])).astype(np.int8)
                turn = np.flatnonzero(np.diff(flags))
                spans = [{"start": int(a), "length": int(b - a)} for a, b in zip(turn[::2], turn[1::2], strict=True)]
            sha = hashlib.sha256(",".join(found).encode()).hexdigest()
            yield int(w.first[d + 1] - w.first[d]), int(n_hit[d]), len(found), sha, bool(n_hit[d]), int(self.longest[d]), found, spans


def _shared(docs: DataFrame, benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int, window: int) -> tuple[Callable[[], Iterator[TestBlock]], bool]:
    """How a task reads the blocks, and whether there are several."""
    spark = docs.sparkSession
    blocks = test_blocks(benchmark, item_col, text_col, block_bytes, window)
    first, second = next(blocks, None), next(blocks, None)
    if second is None:
        one = spark.sparkContext.broadcast(first)
        return lambda: iter([one.value] if one.value else []), False
    uri = f"{shared_dir(spark)}/benchmark-{uuid.uuid4().hex}"
    fs, folder = pafs.FileSystem.from_uri(uri)
    fs.create_dir(folder, recursive=True)
    count = 0
    for block in (b for part in ([first, second], blocks) for b in part):
        with fs.open_output_stream(f"{folder}/{count}") as out:
            out.write(pickle.dumps(block))
        count += 1

    def load() -> Iterator[TestBlock]:
        fs, folder = pafs.FileSystem.from_uri(uri)
        for i in range(count):
            with fs.open_input_file(f"{folder}/{i}") as file:
                yield pickle.loads(file.read())

    return load, True


def _searched(strings: pa.Array, load: Callable[[], Iterator[TestBlock]], several: bool, whole: bool) -> Iterator[Shard]:
    for _, chunk in W.slices(strings, CHUNK_BYTES if several else 1 << 20):
        shards = [Shard(rows) for _, rows in W.slices(chunk)]
        for block in load():
            for shard in shards:
                shard.search(block, whole)
        yield from shards


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    window: int = WINDOW, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """For each document, the words inside a verbatim copy of ``window`` consecutive words of a benchmark item, the items, the longest match and where the hits lie."""
    load, several = _shared(docs, benchmark, item_col, item_text_col, block_bytes, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for shard in _searched(W.as_strings(batch.column("text")), load, several, True) for r in shard.rows()]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 8
            yield pa.record_batch([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True))], names=_NAMES)

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(run, SCHEMA)


_SPAN = pa.struct([("start", pa.int64()), ("length", pa.int64())])
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.list_(pa.string()), pa.list_(_SPAN)]
_NAMES = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest_match", "items", "hit_spans"]


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` without a hit, every column as it is; rows leave where they are scanned, so nothing is shuffled."""
    load, several = _shared(docs, benchmark, item_col, item_text_col, block_bytes, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = [shard.hits() == 0 for shard in _searched(W.as_strings(batch.column(text_col)), load, several, False)]
            yield batch.filter(pa.array(np.concatenate(clean) if clean else np.zeros(0, bool), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
