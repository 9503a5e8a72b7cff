"""N-gram Jaccard self-join with rare-first prefix filtering.

A document is the set of its distinct shingles (64-bit hashes). Documents with
equal sets are one class, named by 128 bits of the set (of the words
themselves where a set has one shingle); the join is between classes.

1. One pass over the texts deals every shingle hash into buckets, as packed
   sorted arrays. A hash that several sets of a batch hold is dealt once, with
   their number; which ones they are stays with the batch.
2. A bucket counts document frequencies and sends those of repeated shingles
   back to their batches.
3. A batch orders each document's repeated shingles rare-first. A partner
   shares at least ceil(0.8 n) of a document's n shingles, so only documents
   with that many repeated shingles go on, usually a small part of the corpus.
4. Classes that share a shingle of their prefixes are candidates; connected
   candidates form clusters. Clusters of many shingles are cut into blocks,
   and pairs of blocks are verified apart, so no task holds more than two.
5. Within a pair of blocks, prefix postings give candidates, the length,
   positional and suffix filters thin them, and every pair left is verified
   once against marked shingles. Links join the blocks' components.

Copies cost one entry per batch, and a passage in very many documents one
entry per batch in one bucket. With ``count`` every link is counted: a cluster
of m distinct near copies costs m * m / 2 comparisons, spread over the pairs
of its blocks. Without it only components are asked for: pairs that are
connected already are skipped. Every block is first compared with itself and
one block, which connects near copies in about m comparisons; only what is
left outside a cluster's largest component is then compared with all of it.

What is joined by a key that may be hot (class, root, shingle) is joined with
a written table: a small one is broadcast, else Spark can split the key.

Defined results: null, empty and wordless texts have no shingles and link with
nothing; a text with fewer words than a shingle is one shingle; texts of any
length are read whole; rows that share a doc_id are separate documents, equal
rows link; with a null doc_id, component_id is the smallest id that is there
(null if none); an empty table gives none; other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm import wordhash as W
from kinfold.llm.common import free_names, materialize, parallelism, partitions, text_bytes
from kinfold.llm.components import components, whole
from kinfold.llm.substring_dedup import deal, pack, unpack

#: Words of a shingle, and similarity in per cent.
SHINGLE, PERCENT = 5, 80
#: Shingles and distinct sets of a batch, at most (a single document may have more).
BATCH_SHINGLES, BATCH_DOCS = 1 << 21, (1 << 16) - 1
#: Shingles of a bucket, about.
BUCKET_SHINGLES = 1 << 20
#: Repeated shingles of a block of a cluster, about, and as how many a class counts at least.
BLOCK_SHINGLES, LEAST_SHINGLES = 1 << 18, 1 << 9
#: Stands for the document's number where several sets of a batch hold a hash.
_SEVERAL = (1 << 16) - 1


def shingle_sets(strings: pa.Array, size: int) -> Iterator[tuple[np.ndarray, bytes]]:
    """The sorted distinct shingle hashes of each text, and its class (empty without shingles)."""
    for _, rows in W.slices(strings):
        w = W.split(rows, W.SPACED)
        at, h = W.windows(w, size)
        n = np.diff(w.first)
        short = np.flatnonzero((n > 0) & (n < size))
        h = np.concatenate((h, W.span_hash(w, w.first[short], n[short])))
        d = np.concatenate((w.doc()[at], short))
        order = np.lexsort((h, d))
        h, d = h[order], d[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
        h, d = h[new], d[new]
        cut = np.searchsorted(d, np.arange(w.n_docs + 1))
        for i, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
            own = h[a:b]
            if len(own) == 1:
                words = range(w.first[i], min(w.first[i] + size, w.first[i + 1]))
                yield own, _digest(b" ".join(w.data[w.start[k] : w.end[k]].tobytes() for k in words))
            else:
                yield own, _digest(own.tobytes()) if len(own) else b""


def _digest(raw: bytes) -> bytes:
    return hashlib.blake2b(raw, digest_size=16).digest()


def needed(n: np.ndarray | int, percent: int = PERCENT):
    """Shingles that a partner of a set of n must share."""
    return -(-n * percent // 100)


def _squeeze(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(a.tobytes() for a in arrays))


def _expand(blob: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(blob)


def _stored(table: pa.RecordBatch) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(table)
    return out.getvalue().to_pybytes()


def _row_table(columns: dict[str, tuple[list, pa.DataType]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(v, k) for v, k in columns.values()], names=list(columns))


class _Batch:
    """Documents of one task until they are dealt out."""

    def __init__(self):
        self.ids: list[int | None] = []
        self.keys: list[bytes | None] = []
        self.n: list[int] = []
        self.cls: list[bytes | None] = []  # at a class's first document
        self.number: list[int] = []
        self.known: dict[bytes, int] = {}
        self.sets: list[np.ndarray] = []
        self.size = 0

    def add(self, doc_id: int | None, key: bytes | None, shingles: np.ndarray, cls: bytes) -> None:
        fresh = bool(cls) and cls not in self.known
        if fresh:
            self.known[cls] = len(self.known)
            self.sets.append(shingles)
            self.size += len(shingles)
        self.ids.append(doc_id)
        self.keys.append(key)
        self.n.append(len(shingles))
        self.cls.append(cls if fresh else None)
        self.number.append(self.known[cls] if cls else -1)

    def full(self) -> bool:
        return self.size >= BATCH_SHINGLES or len(self.known) >= BATCH_DOCS

    def rows(self, batch: int, bits: int) -> pa.RecordBatch:
        info = _stored(_row_table({"id": (self.ids, pa.int64()), "key": (self.keys, pa.binary()), "n": (self.n, pa.int64()), "cls": (self.cls, pa.binary()), "number": (self.number, pa.int32())}))
        h = np.concatenate(self.sets) if self.sets else np.zeros(0, W.U64)
        of = np.repeat(np.arange(len(self.sets), dtype=np.uint16), [len(s) for s in self.sets])
        order = np.lexsort((of, h))
        h, of = h[order], of[order]
        first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
        count = np.diff(np.append(first, len(h)))
        several = count > 1
        holders = of[W.ranges(first[several], count[several])]
        held = _stored(_row_table({"h": ([h[first[several]].tobytes()], pa.binary()), "count": ([count[several].astype(np.int64).tobytes()], pa.binary()), "of": ([holders.tobytes()], pa.binary())}))
        h, one = h[first], np.where(several, _SEVERAL, of[first]).astype(np.uint16)
        buckets, a, b, at = [batch % (1 << bits)], [info], [held], 0
        for bucket, part in deal(h, bits):
            here = slice(at, at + len(part))
            at += len(part)
            buckets.append(bucket)
            a.append(pack(part))
            b.append(_squeeze(one[here], count[here][several[here]].astype(np.uint32)))
        return pa.record_batch([pa.array(buckets, pa.int64()), pa.array([batch] * len(buckets), pa.int64()), pa.array([True] + [False] * (len(buckets) - 1)), pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["bucket", "batch", "info", "a", "b"])


def _frequencies(table: pa.Table) -> pa.Table:
    """Step 2, for one bucket: by batch, the repeated shingles with their document numbers and frequencies."""
    rows = list(zip(*(table.column(c).to_pylist() for c in ("batch", "info", "a", "b")), strict=True))
    out = [r for r in rows if r[1]]
    batches, sets, ones, counts = [], [], [], []
    for batch, info, a, b in rows:
        if not info:
            h, raw = unpack(a), _expand(b)
            one = np.frombuffer(raw, np.uint16, len(h))
            count = np.ones(len(h), np.int64)
            count[one == _SEVERAL] = np.frombuffer(raw, np.uint32, -1, 2 * len(h))
            batches.append(batch)
            sets.append(h)
            ones.append(one)
            counts.append(count)
    if sets:
        h, one, of = np.concatenate(sets), np.concatenate(ones), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(h, kind="stable")
        first = np.flatnonzero(np.concatenate(([True], h[order][1:] != h[order][:-1])))
        sums = np.add.reduceat(np.concatenate(counts)[order], first)
        df = np.empty(len(h), np.uint16)
        df[order] = np.repeat(np.minimum(sums, 0xFFFF), np.diff(np.append(first, len(h))))
        again = np.flatnonzero(df > 1)
        h, one, df = h[again], one[again], df[again]
        cut = np.searchsorted(of[again], np.arange(len(sets) + 1))
        for batch, a, b in zip(batches, cut[:-1], cut[1:], strict=True):
            if a < b:
                out.append((batch, False, pack(h[a:b]), _squeeze(one[a:b], df[a:b])))
    columns = list(zip(*out, strict=True)) if out else [()] * 4
    kinds = (pa.int64(), pa.bool_(), pa.binary(), pa.binary())
    return pa.table({n: pa.array(c, k) for n, c, k in zip(("batch", "info", "a", "b"), columns, kinds, strict=True)})


_STATE = "doc_id long, key binary, n long, cls binary, repeated boolean, prefix long, size long, shingles binary"


def _order(table: pa.Table, percent: int) -> pa.Table:
    """Step 3, for one batch: every document's set size and class; for those that may have a partner, the repeated shingles rare-first."""
    info = table.column("info").to_pylist()
    a, b = table.column("a").to_pylist(), table.column("b").to_pylist()
    own = info.index(True)
    docs, held = pa.ipc.open_stream(a[own]).read_all(), pa.ipc.open_stream(b[own]).read_all()
    marked, count, holders = (np.frombuffer(held.column(c)[0].as_py(), k) for c, k in (("h", W.U64), ("count", np.int64), ("of", np.uint16)))
    begin = np.cumsum(count) - count
    hashes, owners, freqs = [], [], []
    for is_info, x, y in zip(info, a, b, strict=True):
        if is_info:
            continue
        h, raw = unpack(x), _expand(y)
        one, df = np.frombuffer(raw, np.uint16, len(h)), np.frombuffer(raw, np.uint16, len(h), 2 * len(h))
        alone = one != _SEVERAL
        at = np.searchsorted(marked, h[~alone])
        hashes += [h[alone], np.repeat(h[~alone], count[at])]
        owners += [one[alone], holders[W.ranges(begin[at], count[at])]]
        freqs += [df[alone], np.repeat(df[~alone], count[at])]
    n, number = docs.column("n").to_numpy(), docs.column("number").to_numpy()
    first = docs.column("cls").is_valid().to_numpy()
    own = np.flatnonzero(first)  # by class, its first document
    prefix, size, blobs = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64), [None] * len(n)
    if hashes:
        h, of, df = np.concatenate(hashes), np.concatenate(owners), np.concatenate(freqs)
        order = np.lexsort((h, df, of))
        h, of, df = h[order], of[order], df[order]
        cut = np.searchsorted(of, np.arange(len(own) + 1))
        r, least = np.diff(cut), needed(n[own], percent)
        for k in np.flatnonzero((r >= least) & (r > 0)):
            here = slice(cut[k], cut[k + 1])
            blobs[own[k]] = _squeeze(h[here], df[here])
            size[own[k]] = r[k]
            prefix[own[k]] = r[k] - least[k] + 1  # what the unrepeated ones leave of the prefix
    names = docs.column("cls").combine_chunks().take(pa.array(own)) if len(own) else pa.array([], pa.binary())
    cls = names.take(pa.array(np.where(number < 0, None, number).tolist(), pa.int32()))
    return pa.table(
        {
            "doc_id": docs.column("id"), "key": docs.column("key"), "n": pa.array(n), "cls": cls, "repeated": pa.array([b is not None for b in blobs]),
            "prefix": pa.array(prefix), "size": pa.array(size), "shingles": pa.array(blobs, pa.binary()),
        }
    )


def _sorted_set(blob: bytes, size: int) -> tuple[np.ndarray, np.ndarray]:
    raw = _expand(blob)
    return np.frombuffer(raw, W.U64, size), np.frombuffer(raw, np.uint16, size, 8 * size)


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = [_sorted_set(b, n)[0][:p] for b, n, p in zip(*(batch.column(c).to_pylist() for c in ("shingles", "size", "prefix")), strict=True)]
        if keys:
            node = np.repeat(batch.column("node").to_numpy(), [len(k) for k in keys])
            yield pa.record_batch([pa.array(np.concatenate(keys).view(np.int64)), pa.array(node)], names=["h", "node"])


class _Sets:
    """Step 5, for the classes of one pair of blocks.

    A pair is compared if one member is on the left and the other on the
    right; of two late members (which may meet in two tasks), only with the
    smaller one on the left.
    """

    def __init__(self, table: pa.Table, percent: int):
        table = table.sort_by([("n", "ascending"), ("node", "ascending")])
        self.percent = percent
        self.node, self.n, self.prefix, self.size, self.weight, label = (table.column(c).to_numpy() for c in ("node", "n", "prefix", "size", "weight", "label"))
        self.left, self.right, self.late = (table.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("left", "right", "late"))
        self.label = np.unique(label, return_inverse=True)[1]
        sets = [_sorted_set(b, n) for b, n in zip(table.column("shingles").to_pylist(), self.size, strict=True)]
        self.at = np.concatenate(([0], np.cumsum(self.size)))
        keys, freq = np.concatenate([h for h, _ in sets]), np.concatenate([f for _, f in sets])
        order = np.lexsort((keys, freq))
        new = np.ones(len(keys), np.int64)
        new[1:] = keys[order][1:] != keys[order][:-1]
        self.number = np.empty(len(keys), np.int64)
        self.number[order] = np.cumsum(new) - 1
        self.universe = int(new.sum())
        rows = W.ranges(self.at[:-1], self.prefix)
        of, number = np.repeat(np.arange(len(sets)), self.prefix), self.number[rows]
        order = np.lexsort((of, number))
        self.post_of, self.post_place = of[order], (rows - self.at[of])[order]
        self.post_at = np.searchsorted(number[order], np.arange(self.universe + 1))

    def below(self, members: np.ndarray, number: int) -> np.ndarray:
        """How many of each member's shingles come before the shingle ``number`` in the order; by binary search."""
        lo, hi = self.at[members].copy(), self.at[members + 1].copy()
        while (lo < hi).any():
            mid = (lo + hi) >> 1
            less = (lo < hi) & (self.number[np.minimum(mid, len(self.number) - 1)] < number)
            lo, hi = np.where(less, mid + 1, lo), np.where((lo < hi) & ~less, mid, hi)
        return lo - self.at[members]

    def meant(self, x: int, y: np.ndarray) -> np.ndarray:
        """Whether this task compares x with each of y."""
        less, both = self.node[x] < self.node[y], self.late[x] & self.late[y]
        return (self.left[x] & self.right[y] & (less | ~both)) | (self.right[x] & self.left[y] & (~less | ~both))

    def candidates(self, x: int, apart: bool) -> np.ndarray:
        """Later members that share a prefix shingle with x and pass the length, positional and suffix filters; with ``apart`` only those of other labels."""
        own = self.number[self.at[x] : self.at[x] + self.prefix[x]]
        count = self.post_at[own + 1] - self.post_at[own]
        rows = W.ranges(self.post_at[own], count)
        y, place = self.post_of[rows], self.post_place[rows]
        mine = np.repeat(np.arange(len(own)), count)
        ok = (y > x) & (self.n[x] * 100 >= self.n[y] * self.percent)
        if apart:
            ok &= self.label[y] != self.label[x]
        y, place, mine = y[ok], place[ok], mine[ok]
        y, first = np.unique(y, return_index=True)  # the first shingle in common
        place, mine = place[first], mine[first]
        least = -(-(self.n[x] + self.n[y]) * self.percent // (100 + self.percent))
        ok = self.meant(x, y) & (1 + np.minimum(self.size[x] - mine - 1, self.size[y] - place - 1) >= least)
        y, least = y[ok], least[ok]
        if len(y):
            middle = self.size[x] // 2
            before = self.below(y, self.number[self.at[x] + middle])
            ok = np.minimum(before, middle) + np.minimum(self.size[y] - before, self.size[x] - middle) >= least
            y = y[ok]
        return y

    def links(self, apart: bool) -> Iterator[tuple[int, np.ndarray]]:
        mark = np.zeros(self.universe, bool)
        for x in range(len(self.n)):
            y = self.candidates(x, apart)
            if not len(y):
                continue
            own = self.number[self.at[x] : self.at[x + 1]]
            mark[own] = True
            hits = mark[self.number[W.ranges(self.at[y], self.size[y])]]
            both = np.add.reduceat(hits, np.cumsum(self.size[y]) - self.size[y], dtype=np.int64)
            mark[own] = False
            y = y[both * 100 >= self.percent * (self.n[x] + self.n[y] - both)]
            if len(y):
                yield x, y

    def join(self, x: int, y: int) -> None:
        """Give all of both labels the smaller of these."""
        a, b = sorted((self.label[x], self.label[y]))
        self.label[self.label == b] = a


def _verify(table: pa.Table, percent: int, count: bool) -> pa.Table:
    """Links that connect what had different labels, as stars; with ``count``, also how many documents each class links with."""
    s = _Sets(table, percent)
    own, links = s.label.copy(), np.zeros(len(s.n), np.int64)
    for x, ys in s.links(not count):
        links[x] += s.weight[ys].sum()
        links[ys] += s.weight[x]
        while len(ys):
            s.join(x, int(ys[0]))
            ys = ys[s.label[ys] != s.label[x]]
    least = np.full(own.max() + 1, np.iinfo(np.int64).max)  # of each label at first, its smallest node
    np.minimum.at(least, own, s.node)
    now = np.zeros(len(least), np.int64)
    now[own] = s.label
    root = np.full(len(least), np.iinfo(np.int64).max)
    np.minimum.at(root, now, least)
    moved = np.flatnonzero(root[now] != least)
    some = np.flatnonzero(links) if count else moved[:0]
    none = [None] * len(some)
    return pa.table({"node": pa.array([*least[moved].tolist(), *s.node[some].tolist()], pa.int64()), "other": pa.array([*root[now[moved]].tolist(), *none], pa.int64()), "links": pa.array([0] * len(moved) + links[some].tolist(), pa.int64())})


_MEMBER = ("node", "label", "late", "n", "prefix", "size", "weight", "shingles")


def _compared(members: DataFrame, keys: list[str], percent: int, count: bool) -> DataFrame:
    """node, other, links of the groups of ``members``, written."""
    dealt = members.select(*keys, *_MEMBER, "left", "right").groupBy(*keys).applyInArrow(lambda t: _verify(t, percent, count), "node long, other long, links long")
    return materialize(dealt, "links")


def _block(of: str, blocks: str, seed: int):
    return F.pmod(F.xxhash64(of, F.lit(seed)), F.col(blocks)).cast("int")


def _linked(alive: DataFrame, clusters: DataFrame, percent: int, count: bool) -> tuple[DataFrame, DataFrame | None]:
    """(node, root) of the linked classes, and with ``count`` (node, links)."""
    spark = alive.sparkSession
    sizes = clusters.join(alive.select("node", "size"), "node").groupBy("root").agg(F.sum(F.greatest("size", F.lit(LEAST_SHINGLES))).alias("m"))
    total = alive.agg(F.sum("size")).first()[0] or 0
    large = materialize(sizes.where(F.col("m") > 2 * BLOCK_SHINGLES).select("root", F.ceil(F.col("m") / BLOCK_SHINGLES).cast("int").alias("blocks")), "large-clusters")
    members = clusters.join(large, "root", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).join(alive, "node")
    members = members.withColumns({"block": _block("node", "blocks", 3), "label": F.col("node"), "late": F.lit(False)})
    # clusters of one block are dealt into bins
    bins = partitions(spark, max(2 * parallelism(spark), total // (8 * BLOCK_SHINGLES)))
    some = members.withColumn("root", F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("root"), F.lit(bins))).otherwise(F.col("root")))
    if count:  # every pair of blocks
        some = some.withColumn("pair", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        some = some.withColumns({"lo": F.least("block", "pair"), "hi": F.greatest("block", "pair"), "left": F.col("block") <= F.col("pair"), "right": F.col("block") >= F.col("pair")})
        found = _compared(some, ["root", "blocks", "lo", "hi"], percent, True)
        joined = components(found.where("other is not null"), "node", "other")
        return whole(joined), found.where("other is null").groupBy("node").agg(F.sum("links").alias("links"))
    # every block with itself and with the first
    every = F.when(F.col("block") == 0, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))
    some = some.withColumn("hi", F.explode(every)).withColumns({"left": F.lit(True), "right": F.col("hi") == F.col("block")})
    found = _compared(some, ["root", "blocks", "hi"], percent, False).select("node", "other")
    joined = whole(components(found, "node", "other"))
    # what isn't in the largest part of its cluster yet, with all that is in another part
    parts = clusters.join(large, "root").join(joined.select("node", F.col("root").alias("label")), "node", "left")
    parts = materialize(parts.select("node", "root", "blocks", F.coalesce("label", "node").alias("label")), "cluster-parts")
    by_label = parts.groupBy("root", "label").agg(F.count("*").alias("k"))
    open_ = by_label.groupBy("root").agg(F.max(F.struct("k", "label")).alias("top"), F.sum("k").alias("k")).where("top.k < k")
    open_ = materialize(open_.select("root", F.col("top.label").alias("top"), (F.col("k") - F.col("top.k")).alias("left_over"), "k"), "open-clusters")
    if open_.isEmpty():
        return joined, None
    again = parts.join(open_, "root").withColumns({"late": F.col("label") != F.col("top"), "late_blocks": F.ceil(F.col("left_over") * F.col("blocks") / F.col("k")).cast("int")})
    again = again.withColumns({"block": _block("node", "blocks", 3), "late_block": _block("node", "late_blocks", 5)})
    mine = F.when(F.col("late"), F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.col("late_block").alias("i"), j.alias("j"))))
    theirs = F.transform(F.sequence(F.lit(0), F.col("late_blocks") - 1), lambda i: F.struct(i.alias("i"), F.col("block").alias("j")))
    again = again.withColumn("to", F.explode(F.array_distinct(F.when(F.col("late"), F.concat(mine, theirs)).otherwise(theirs))))
    again = again.withColumns({"i": F.col("to.i"), "j": F.col("to.j")}).withColumns({"left": F.col("late") & (F.col("late_block") == F.col("i")), "right": F.col("block") == F.col("j")})
    more = _compared(again.drop("blocks").join(alive, "node"), ["root", "i", "j"], percent, False).select("node", "other")
    return whole(components(found.unionByName(more), "node", "other")), None


def _solved(docs: DataFrame, id_col: str, text_col: str, size: int, percent: int, count: bool, keyed: bool) -> tuple[DataFrame, DataFrame]:
    """(documents with their class, classes that hold or are linked with several documents), both written."""
    spark = docs.sparkSession
    _, total = text_bytes(docs, text_col)
    bits = max(1, int(np.ceil(np.log2(max(2 * parallelism(spark), total / 6 / BUCKET_SHINGLES)))))

    def deal_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 32, _Batch()
        for batch in batches:
            ids, keys = batch.column("doc_id").to_pylist(), batch.column("key").to_pylist()
            for doc_id, key, (shingles, cls) in zip(ids, keys, shingle_sets(W.as_strings(batch.column("text")), size), strict=True):
                held.add(doc_id, key, shingles, cls)
                if held.full():
                    yield held.rows(number, bits)
                    number, held = number + 1, _Batch()
        if held.ids:
            yield held.rows(number, bits)

    text = F.col(text_col).cast("string")
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), (_text_key(text) if keyed else F.lit(None).cast("binary")).alias("key"))
    dealt = own.mapInArrow(deal_out, "bucket long, batch long, info boolean, a binary, b binary")
    counted = dealt.repartition(partitions(spark, 1 << bits), "bucket").groupBy("bucket").applyInArrow(_frequencies, "batch long, info boolean, a binary, b binary")
    ordered = counted.repartition(partitions(spark, total // 6 // BATCH_SHINGLES), "batch").groupBy("batch").applyInArrow(lambda t: _order(t, percent), _STATE)
    state = materialize(ordered, "shingle-state")

    classes = state.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("least"), F.count("*").alias("weight"))
    alive = state.where("repeated").groupBy("cls").agg(*(F.first(c).alias(c) for c in ("n", "prefix", "size", "shingles")))
    alive = materialize(alive.join(classes, "cls").withColumn("node", F.monotonically_increasing_id()), "shingle-sets")
    postings = materialize(alive.select("node", "prefix", "size", "shingles").mapInArrow(_postings, "h long, node long"), "postings")
    stars = materialize(postings.groupBy("h").agg(F.min("node").alias("b"), F.count("*").alias("k")).where("k > 1").select("h", "b"), "stars")
    clusters = whole(components(postings.join(stars, "h").select(F.col("node").alias("a"), "b")))
    linked, links = _linked(alive, clusters, percent, count)

    named = linked.join(alive.select("node", "cls", "least"), "node")
    if links is not None:
        named = named.join(links, "node", "left")
    named = materialize(named, "linked-classes")
    least = materialize(named.groupBy("root").agg(F.min("least").alias("component_id")), "least-ids")
    named = named.join(least, "root").select("cls", F.col("root").cast("string").alias("root"), "component_id", *(["links"] if count else []))
    answers = classes.join(named, "cls", "left").where("weight > 1 or root is not null")
    more = F.coalesce("links", F.lit(0)) if count else F.lit(0)
    answers = answers.select("cls", F.coalesce("root", F.hex("cls")).alias("part"), F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"), (more + F.col("weight") - 1).alias("n_links"))
    return state, materialize(answers, "classes")


def _text_key(text):
    return F.unhex(F.md5(text.cast("binary")))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT, count: bool = True) -> DataFrame:
    """By document: doc_id, n_shingles, component_id (the smallest doc_id reachable by links), class_id, and with ``count`` n_links (documents it links with)."""
    state, answers = _solved(docs, id_col, text_col, size, percent, count, False)
    out = state.select("doc_id", F.col("n").alias("n_shingles"), F.col("cls").alias("class_id")).join(answers.withColumnRenamed("cls", "class_id"), "class_id", "left")
    component = F.when(F.col("part").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    return out.select("doc_id", "n_shingles", component, *([F.coalesce("n_links", F.lit(0)).alias("n_links")] if count else []), F.lower(F.hex("class_id")).alias("class_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row of each component, every column as it is: the smallest id (null last), of these the text with the smallest MD5, of equal rows any one.

    Rows without shingles (null, empty or wordless texts) all stay. Rows of
    one id with texts that don't link are different documents.
    """
    state, answers = _solved(docs, id_col, text_col, size, percent, False, True)
    grouped = materialize(state.where("n > 0").join(answers.select("cls", "part"), "cls").select("doc_id", "key", "part"), "grouped")
    first = grouped.groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first")).select("first.doc_id", "first.key")
    rows = grouped.groupBy("doc_id", "key").agg(F.count("*").alias("k"))
    mark = first.select(F.col("doc_id").alias("x"), F.col("key").alias("y"))
    rows = rows.join(mark, F.col("doc_id").eqNullSafe(F.col("x")) & (F.col("key") == F.col("y")), "left")
    of_id, of_key, once = free_names(docs.columns, ["of_id", "of_key", "once"], "dropped")
    gone = rows.where(F.col("y").isNull() | (F.col("k") > 1)).select(F.col("doc_id").alias(of_id), F.col("key").alias(of_key), F.col("y").isNotNull().alias(once))
    gone = materialize(gone, "dropped")
    same = docs[id_col].cast("long").eqNullSafe(gone[of_id]) & (_text_key(docs[text_col].cast("string")) == gone[of_key])
    kept = docs.join(gone, same, "left_anti")
    if gone.where(F.col(once)).isEmpty():
        return kept
    again = docs.join(gone.where(F.col(once)), same, "inner").dropDuplicates([of_id, of_key])  # rows with an equal id and text
    return kept.unionByName(again.select(*(docs[c] for c in docs.columns)))
