"""Removal of repeated passages by Rabin-Karp hashes of every word window.

1. Documents are dealt into ranges of doc_id (quantile boundaries, then equal
   widths inside), so that a smaller range holds only smaller ids. Rows
   without an id, and rows of an id that fills several quantiles, never remove
   from each other: they are dealt anyhow, into parts of one range.
2. Each part hashes every window of its documents, keeps each hash once and
   deals the sorted hashes into buckets by their leading bits.
3. A bucket counts, per hash, the ranges that hold it. Parts of all ranges but
   the smallest get the hash back.
4. Each part marks the windows whose hash came back, or that a smaller id of
   its own holds, merges them into maximal intervals and cuts those.

A hot passage is one hash per part however many documents hold it, so no
group grows with the number of copies. Hashes have 64 bits: with n windows in
all, a window is removed wrongly with probability n / 2**64.

Defined results: a null text has no words and stays null, an empty one stays
empty; texts of any length are read whole; rows that share a doc_id (repeated
rows too) never remove from each other; a null doc_id counts as larger than
every id; an empty table gives none; columns of any name stay as they are.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinfold.llm import wordhash as W
from kinfold.llm.common import free_names, parallelism, partitions, text_bytes

#: Consecutive words of a window.
WINDOW = 13
#: Bytes of text in a range, as a target.
RANGE_BYTES = 8 << 20
#: Quantile boundaries at most; beyond, ranges are cut into equal widths of ids.
BOUNDARIES = 4096
#: A part's number is its range's number times this, and its number in the range.
PARTS = 1 << 20


def pack(values: np.ndarray) -> bytes:
    """Sorted 64-bit values as compressed byte planes: the leading bytes of neighbours are nearly equal."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T[::-1])
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes[::-1].T).view(W.U64).reshape(-1)


def deal(values: np.ndarray, bits: int) -> Iterator[tuple[int, np.ndarray]]:
    """Runs of sorted 64-bit values that share their leading ``bits``."""
    if len(values):
        lead = values >> W.U64(64 - bits)
        cut = np.concatenate(([0], np.flatnonzero(np.diff(lead)) + 1, [len(values)]))
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            yield int(lead[a]), values[a:b]


def hashed(strings: pa.Array, window: int) -> Iterator[tuple[int, W.Words, np.ndarray, np.ndarray]]:
    """(first row, words, window starts, window hashes) of each slice."""
    for lo, rows in W.slices(strings):
        w = W.split(rows, W.SPACED, lower=False)
        yield lo, w, *W.windows(w, window)


def part_column(docs: DataFrame, id_col: str, text_col: str, n: int):
    """Number of the part of a range of doc_id; at least about ``n`` parts hold rows. ``id_col`` is a long."""
    k = min(n, BOUNDARIES)
    found = Counter(min(max(int(c), -(1 << 63)), (1 << 63) - 1) for c in docs.approxQuantile(id_col, [i / k for i in range(k + 1)], 1 / (8 * k)))
    inner = max(1, -(-n // k))
    # an id on several boundaries fills whole quantiles: its rows are a range of their own, in parts by text
    hot = {c: m * inner for c, m in found.items() if m > 2}
    shares = lambda m: F.pmod(F.xxhash64(text_col), m.cast("long"))
    none = F.lit(PARTS * (2 * max(1, len(found)) * inner + 1)) + shares(F.lit(n))
    if not found:
        return none
    place = _searched(sorted(found), inner, sorted(hot))(F.col(id_col))
    if hot:
        few = F.create_map(*(F.lit(v) for c, m in hot.items() for v in (c, min(m, PARTS))))
        place = place + F.when(F.col(id_col).isin(*hot), shares(F.try_element_at(few, F.col(id_col)))).otherwise(F.lit(0))
    return F.when(F.col(id_col).isNull(), none).otherwise(place).cast("long")


def _searched(cuts: list[int], inner: int, hot: list[int]):
    """The first part of each id's range. From each boundary on lie ``inner`` ranges of equal width; a hot id, which is a boundary, is a range before them."""

    @F.pandas_udf(T.LongType())
    def search(ids):
        import pandas as pd

        c = np.array(cuts, np.int64)
        x = ids.fillna(0).to_numpy(np.int64)
        r = np.searchsorted(c, x, "right") - 1
        a, b = (c[np.clip(r + j, 0, len(c) - 1)].astype(float) for j in (0, 1))  # as floats: ids may span more than 63 bits
        share = np.clip(((x.astype(float) - a) * inner / np.maximum(1.0, b - a)).astype(np.int64), 0, inner - 1)
        number = 2 * r * inner + np.where((r >= 0) & (r < len(c) - 1), share, 0)
        return pd.Series((number - np.where(np.isin(x, hot), share + 1, 0)) * PARTS)

    return search


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``docs`` with ``text`` replaced by what is left of it, and after its columns n_words, n_removed, kept_sha256 and removed (maximal word intervals).

    Where ``docs`` has a column of such a name, it stays and the new one is
    called ``dedup_n_words`` and so on. Untouched texts stay as they are; in
    others the kept words are joined by one space.
    """
    return _deduped(docs, id_col, text_col, window, range_bytes, True, None)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None, window: int = WINDOW, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``docs`` with ``text`` replaced by what is left of it and, in rows where words went, ``length_col`` by its characters; no other change."""
    return _deduped(docs, id_col, text_col, window, range_bytes, False, length_col)


def _deduped(docs: DataFrame, id_col: str, text_col: str, window: int, range_bytes: int, report: bool, length_col: str | None) -> DataFrame:
    spark = docs.sparkSession
    _, size = text_bytes(docs, text_col)
    wide = 2 * parallelism(spark)
    n_parts = max(wide, size // range_bytes)
    bits = max(1, int(np.ceil(np.log2(max(wide, size // (6 << 20))))))
    key, part = free_names(docs.columns, ["id", "part"], "dedup")
    base = docs.withColumn(key, F.col(id_col).cast("long"))
    n_dealt = partitions(spark, n_parts)
    keyed = base.withColumn(part, part_column(base, key, text_col, n_parts)).repartition(n_dealt, part)
    own = list(docs.columns)

    def hashes(table: pa.Table) -> pa.Table:
        r = table.column(part)[0].as_py()
        parts = [np.unique(h) for _, _, _, h in hashed(W.as_strings(table.column(text_col)), window)]
        rows = list(deal(np.unique(np.concatenate(parts)) if parts else np.zeros(0, W.U64), bits))
        return pa.table({"bucket": pa.array([b for b, _ in rows], pa.int64()), "part": pa.array([r] * len(rows), pa.int64()), "hashes": pa.array([pack(v) for _, v in rows], pa.binary())})

    def count(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        sets, parts = [unpack(b) for b in table.column("hashes").to_pylist()], table.column("part").to_numpy()
        values, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(values, kind="stable")  # by hash, then by part
        values, of = values[order], of[order]
        first = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
        level = (parts // PARTS)[of]
        again = level > np.repeat(level[first], np.diff(np.append(first, len(values))))
        values, of = values[again], of[again]
        order = np.argsort(of, kind="stable")
        values, of = values[order], of[order]
        cut = np.searchsorted(of, np.arange(len(sets) + 1))
        some = [i for i in range(len(sets)) if cut[i] < cut[i + 1]]
        return pa.table({"part": pa.array([int(parts[i]) for i in some], pa.int64()), "hashes": pa.array([pack(values[cut[i] : cut[i + 1]]) for i in some], pa.binary())})

    names = free_names(own, ["n_words", "n_removed", "kept_sha256", "removed"], "dedup") if report else []
    kinds = (T.LongType(), T.LongType(), T.StringType(), T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType())])))
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, k) for n, k in zip(names, kinds[: len(names)], strict=True))])
    if not isinstance(docs.schema[text_col].dataType, T.StringType):
        raise TypeError(f"{text_col} is no string column")

    def cut_out(table: pa.Table, answers: pa.Table) -> pa.Table:
        back = [unpack(b) for b in answers.column("hashes").to_pylist()]
        known = np.sort(np.concatenate(back)) if back else np.zeros(0, W.U64)
        made = _cut(table, known, key, text_col, window, length_col)
        return pa.table([*(made[0].column(c) for c in own), *(made[1][:4] if report else [])], names=[*own, *names])

    seen = keyed.groupBy(part).applyInArrow(hashes, "bucket long, part long, hashes binary")
    found = seen.repartition(partitions(spark, 1 << bits), "bucket").groupBy("bucket").applyInArrow(count, "part long, hashes binary")
    return keyed.groupBy(part).cogroup(found.repartition(n_dealt, "part").groupBy("part")).applyInArrow(cut_out, schema)


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))


def _cut(table: pa.Table, known: np.ndarray, id_col: str, text_col: str, window: int, length_col: str | None = None) -> tuple[pa.Table, list[pa.Array]]:
    """The last step for one part: its rows with their new texts, and n_words, n_removed, kept_sha256, removed. ``known``: sorted hashes that a smaller range holds."""
    ids = table.column(id_col).cast(pa.int64()).combine_chunks()
    value = ids.fill_null(0).to_numpy(zero_copy_only=False)
    rank = np.where(ids.is_null().to_numpy(zero_copy_only=False), 1, 0)
    order = np.lexsort((value, rank))
    new = np.ones(len(order), bool)
    new[1:] = (value[order][1:] != value[order][:-1]) | (np.diff(rank[order]) != 0)
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(new) - 1  # equal for equal ids
    strings = W.as_strings(table.column(text_col))
    parts = [(lo, h, lo + w.doc()[at]) for lo, w, at, h in hashed(strings, window)]
    h = np.concatenate([h for _, h, _ in parts]) if parts else np.zeros(0, W.U64)
    owner = place[np.concatenate([d for _, _, d in parts])] if parts else np.zeros(0, np.int64)
    by = np.argsort(h, kind="stable")
    new = np.ones(len(h), bool)
    new[1:] = h[by][1:] != h[by][:-1]
    least = np.minimum.reduceat(owner[by], np.flatnonzero(new)) if len(h) else owner
    gone = np.empty(len(h), bool)
    gone[by] = owner[by] > np.repeat(least, np.diff(np.append(np.flatnonzero(new), len(h)))) if len(h) else False
    if len(known) and len(h):
        there = np.minimum(np.searchsorted(known, h), len(known) - 1)
        gone |= known[there] == h
    n_words, n_removed, sha, removed, texts = [], [], [], [], []
    done = 0
    for lo, w, at, hs in hashed(strings, window):
        edge = np.zeros(len(w.hash) + 1, np.int64)
        bad = at[gone[done : done + len(hs)]]
        done += len(hs)
        edge[bad] += 1
        np.add.at(edge, bad + window, -1)
        covered = np.cumsum(edge[:-1]) > 0
        total = np.concatenate(([0], np.cumsum(covered)))
        joined = _joined(w, ~covered)
        for d in range(w.n_docs):
            a, b = w.first[d], w.first[d + 1]
            out = int(total[b] - total[a])
            n_words.append(int(b - a))
            n_removed.append(out)
            sha.append(hashlib.sha256(joined[d]).hexdigest())
            if out:
                flags = np.concatenate(([0], covered[a:b], [0])).astype(np.int8)
                turn = np.flatnonzero(np.diff(flags))
                removed.append([{"start": int(x), "length": int(y - x)} for x, y in zip(turn[::2], turn[1::2], strict=True)])
                texts.append((lo + d, bytes(joined[d])))
            else:
                removed.append([])
    if texts:
        rows, left = [i for i, _ in texts], [t.decode("utf-8") for _, t in texts]
        changes = [(text_col, left)] + ([(length_col, [len(t) for t in left])] if length_col else [])
        for name, new_values in changes:
            column = table.column(name).to_pylist()
            for i, v in zip(rows, new_values, strict=True):
                column[i] = v
            table = table.set_column(table.column_names.index(name), name, pa.array(column, table.schema.field(name).type))
    kinds = (pa.int64(), pa.int64(), pa.string(), _SPANS)
    return table, [pa.array(v, k) for v, k in zip((n_words, n_removed, sha, removed), kinds, strict=True)]


def _joined(w: W.Words, keep: np.ndarray) -> list[memoryview]:
    """By document, the kept words joined by one space, as UTF-8."""
    which = np.flatnonzero(keep)
    length = (w.end - w.start)[which] + 1
    out = np.full(int(length.sum()), 0x20, np.uint8)
    at = np.cumsum(length) - length
    out[W.ranges(at, length - 1)] = w.data[W.ranges(w.start[which], length - 1)]
    upto = np.concatenate(([0], np.cumsum(length)))[np.searchsorted(which, w.first)]
    view = memoryview(out)
    return [view[a : max(a, b - 1)] for a, b in zip(upto[:-1], upto[1:], strict=True)]
