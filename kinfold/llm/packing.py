"""Mixture-controlled packing of token streams by deficit round-robin.

Every source is a queue of tokens, cut into quanta of 256. Source s has
weight p(s). Its deficit after n quanta is n * p(s) less what it was served,
and the next quantum goes to the source whose deficit first reaches half a
quantum. Quantum j of s is thus due at the virtual time (2j + 1) / (2 p(s)),
ties by queue, and an exhausted queue drops out. Its place in the output is
the number of quanta due earlier, a sum of one integer division per queue: the
deficits carry across windows and partitions without any task waiting for
another, and nothing is sorted or dealt by source.

1. Documents are tokenised once, each task numbering the tokens of each
   source from 0; the table is written to the shared folder.
2. Sums by (source, task) give each task's start in each queue.
3. Documents join their start and are cut at quanta; neighbours that stay
   neighbours are one piece.

Quanta fill windows exactly; what each queue holds beyond whole quanta follows
at the end, so only the last sequence is padded. More than 256 sources are
taken in nodes of 255, by falling size, and nodes of nodes: a node deals its
members (and the stream of what they hold beyond whole quanta) by the same
closed form, and is a queue with the sum of their targets in the level above.
The driver and the tasks hold a few numbers a source.

Defined results: a null or empty text is the end token alone; a text of any
length is encoded whole and cut over as many sequences as it takes; a null
source is a source; rows that share a doc_id, repeated rows too, are packed
each for itself; no documents give no pieces; only id, text and source are
read, so names of other columns can't clash.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinfold.llm import wordhash as W
from kinfold.llm.common import materialize

SEQUENCE = 2048
QUANTUM = 256
END = 1
QUEUES = 256
#: Weights are whole numbers of about this sum.
WEIGHT_SUM = 1 << 20
#: Tokens that are cut at a time, about.
PART = 1 << 20
#: Bytes of text that are encoded at a time, about: encoding needs many times a text's bytes.
SLICE = 1 << 20
#: Distinct stretches of text whose ids a worker remembers before it starts anew.
CACHE = 1 << 18

#: How byte-level BPE vocabularies of this kind split text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids of texts under a byte-level BPE vocabulary.

    Texts are cut before white space that follows other characters, where a
    token always begins; equal stretches are encoded once and remembered. The
    vocabulary's added tokens are one id each wherever their content stands.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        added = spec.get("added_tokens", ())
        special = {t["content"] for t in added}
        if any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip", "normalized")) or any(re.search(r"\s", c) for c in special):
            raise ValueError(f"{path}: added tokens that hold or take in white space, or depend on what stands around")
        # the printable stand-ins of bytes: printable Latin-1 characters themselves, the others from 256 on
        plain = [b for b in range(256) if 0x21 <= b <= 0x7E or (0xA1 <= b <= 0xFF and b != 0xAD)]
        stand_in = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        ranks = {bytes(stand_in[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
        merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if any(a >= b for a, b in zip(merged, merged[1:], strict=False)) or spec["normalizer"] or model.get("dropout"):
            raise ValueError(f"{path}: ids don't follow the order of merges")
        self.added = {t["content"].encode(): t["id"] for t in added}
        # the longest of those that begin at one place, as the tokenizer takes them
        self.added_at = re.compile(b"|".join(re.escape(c) for c in sorted(self.added, key=len, reverse=True)) or b"(?!)")
        self.size = max([*ranks.values(), *self.added.values()]) + 1
        self.bpe = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.token_bytes = np.zeros(self.size, np.int64)
        for t, i in ranks.items():
            self.token_bytes[i] = len(t)
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.at = np.zeros(1 << 12, np.int64)
        self.count = self.used = 0

    def _append(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        while self.count + len(lengths) + 1 > len(self.at):
            self.at = np.concatenate((self.at, np.zeros_like(self.at)))
        self.ids[self.used : self.used + len(ids)] = ids
        self.at[self.count + 1 : self.count + 1 + len(lengths)] = self.used + np.cumsum(lengths)
        self.used += len(ids)
        self.count += len(lengths)

    def learn(self, stretches: list[bytes]) -> None:
        """Encode what isn't known yet; stretches that begin with white space and end without are encoded in one text."""
        joint, alone = [], []
        for s in stretches:
            text = s.decode("utf-8")
            (joint if s[0] <= 0x20 and _WHITE[s[0]] and not text[-1].isspace() and not self.added_at.search(s) else alone).append((s, text))
        for s, _ in joint:
            self.number[s] = len(self.number)
        if joint:
            ids = np.array(self.bpe.encode_ordinary("".join(t for _, t in joint)), np.int64)
            ends = np.cumsum(self.token_bytes[ids])
            upto = np.searchsorted(ends, np.cumsum([len(s) for s, _ in joint])) + 1
            self._append(ids, np.diff(np.concatenate(([0], upto))))
        for s, _ in alone:
            self.number[s] = len(self.number)
            ids = np.array(self._alone(s), np.int64)
            self._append(ids, np.array([len(ids)]))

    def _alone(self, stretch: bytes) -> list[int]:
        """Ids of one stretch; what stands on either side of an added token is encoded by itself."""
        ids, upto = [], 0
        for m in self.added_at.finditer(stretch):
            ids += [*self.bpe.encode_ordinary(stretch[upto : m.start()].decode("utf-8")), self.added[m[0]]]
            upto = m.end()
        return ids + self.bpe.encode_ordinary(stretch[upto:].decode("utf-8"))

    def encode(self, strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and each text's offsets in them."""
        data, at = W.bytes_of(strings)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(at), np.int64)
        cut = stretches(data)
        starts = np.union1d(at[:-1][np.diff(at) > 0], cut).astype(np.int64)
        offsets = np.append(starts, len(data))
        chunks = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
        coded = chunks.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(self.number) > CACHE:
            self.clear()
        self.learn([s for s in distinct if s not in self.number])
        number = np.fromiter((self.number[s] for s in distinct), np.int64, len(distinct))[coded.indices.to_numpy()]
        length = self.at[number + 1] - self.at[number]
        upto = np.concatenate(([0], np.cumsum(length)))
        return self.ids[W.ranges(self.at[number], length)], upto[np.searchsorted(starts, at)]


def stretches(data: np.ndarray) -> np.ndarray:
    """Where white space follows a character that surely isn't: there a token begins whatever stands around."""
    n = len(data)
    before = data[:-1]
    sure = (before > 0x20) & (before < 0x80)
    two = np.concatenate(([0], data[: n - 2])) if n > 1 else data[:0]
    three = np.concatenate(([0, 0], data[: n - 3])) if n > 2 else np.zeros(max(0, n - 1), np.uint8)
    # white space beyond ASCII lies among these leading bytes
    maybe = (two == 0xC2) | ((three == 0xE1) & (two == 0x9A)) | ((three == 0xE2) & (two <= 0x81)) | ((three == 0xE3) & (two == 0x80))
    sure |= (before >= 0x80) & ~maybe
    return np.flatnonzero(_WHITE[data[1:]] & sure) + 1


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def forget() -> None:
    """Free what this worker's encoders remember: a worker that tokenised goes on to other work."""
    for own in _encoders.values():
        own.clear()
    pa.default_memory_pool().release_unused()


def tokenize(docs: DataFrame, id_col: str, text_col: str, source_col: str, vocabulary: str, end: int = END) -> DataFrame:
    """doc_id, source, part (task), at (token number in the task's stream of the source), n and ids (little-endian unsigned 16 or 32 bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary)
        kind = np.uint16 if max(own.size, end + 1) <= 1 << 16 else np.uint32
        part, used = TaskContext.get().partitionId(), {}
        for batch in batches:
            source = batch.column("source").to_pylist()
            texts = W.as_strings(batch.column("text"))
            for lo, rows in W.slices(texts, SLICE):
                ids, at = own.encode(rows)
                n = np.diff(at)
                out = np.full(len(ids) + len(n), end, kind)
                begin = at[:-1] + np.arange(len(n))
                out[W.ranges(begin, n)] = ids
                starts = np.zeros(len(n), np.int64)
                for i, s in enumerate(source[lo : lo + len(n)]):
                    starts[i] = used.get(s, 0)
                    used[s] = int(starts[i]) + int(n[i]) + 1
                width = out.itemsize
                blobs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(np.append(begin, len(out)) * width), pa.py_buffer(out)])
                yield pa.record_batch(
                    [batch.column("doc_id").slice(lo, len(n)), batch.column("source").slice(lo, len(n)), pa.array(np.full(len(n), part, np.int32)), pa.array(starts), pa.array(n + 1), pa.array(np.full(len(n), width, np.int32)), blobs.cast(pa.binary())],
                    names=["doc_id", "source", "part", "at", "n", "width", "ids"],
                )

    source = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit(""))
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), source.alias("source"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, source string, part int, at long, n long, width int, ids binary")


def places(queue: np.ndarray, quantum: np.ndarray, weight: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Output place of each quantum (queue, number), given all queues' weights and numbers of whole quanta."""
    out = np.zeros(len(queue), np.int64)
    own = weight[queue]
    due = 2 * quantum + 1
    for q in range(len(weight)):
        x = due * weight[q]
        m = np.where(q < queue, x, x - 1) // own  # the largest odd-or-even number of half steps that is due no later
        out += np.where(q == queue, quantum, np.minimum((m + 1) // 2, whole[q]))
    return out


def places_in(node: np.ndarray, queue: np.ndarray, quantum: np.ndarray, weight: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """``places`` of quanta of several nodes, one row of ``weight`` and ``whole`` a node."""
    out = np.zeros(len(queue), np.int64)
    for lo in range(0, len(queue), 4096):
        n, q, j = (v[lo : lo + 4096, None] for v in (node, queue, quantum))
        w, most, every = weight[n[:, 0]], whole[n[:, 0]], np.arange(weight.shape[1])
        m = ((2 * j + 1) * w - (every >= q)) // np.take_along_axis(w, q, 1)
        out[lo : lo + 4096] = np.where(every == q, j, np.minimum((m + 1) // 2, most)).sum(1)
    return out


class Level:
    """Queues in nodes of at most ``width``, each node a queue of the next level.

    A node's last column is the stream of what its members hold beyond whole
    quanta; its first quantum begins with the first member's.
    """

    def __init__(self, total: np.ndarray, share: np.ndarray, width: int, quantum: int):
        self.width, nodes = width, -(-len(total) // width)
        n, p = (np.append(v, np.zeros(nodes * width - len(v), v.dtype)).reshape(nodes, width) for v in (total, share))
        rest = n % quantum
        self.rest_at = np.cumsum(rest, 1) - rest
        self.whole = np.column_stack((n, rest.sum(1))) // quantum
        part = p * rest / np.maximum(n, 1)
        self.weight = np.stack([weights_of(n, v) for n, v in zip(self.whole, np.column_stack((p - part, part.sum(1))), strict=True)])
        self.total, self.share = n.sum(1), p.sum(1)

    def rise(self, pieces: tuple, quantum: int) -> tuple:
        """Pieces (document, from, to, queue, place in the queue) with their node and their place in it."""
        doc, a, b, queue, at = pieces
        node, column = queue // self.width, queue % self.width
        beyond = at - self.whole[node, column] * quantum
        rest = beyond >= 0
        at, column = np.where(rest, self.rest_at[node, column] + beyond, at), np.where(rest, self.width, column)
        doc, a, b, at, node, column = parted((doc, a, b, at, node, column), quantum)  # a rest may lie across two quanta
        number = at // quantum
        full = number < self.whole[node, column]
        place = self.whole[node].sum(1) * quantum + at - self.whole[node, column] * quantum
        place[full] = places_in(node[full], column[full], number[full], self.weight, self.whole) * quantum + (at % quantum)[full]
        return doc, a, b, node, place


def parted(pieces: tuple, size: int) -> tuple:
    """Pieces (document, from, to, place, ...) of at most ``size`` tokens, cut where a multiple of ``size`` lies inside."""
    doc, a, b, place, *more = pieces
    over = np.minimum(b - a, size - place % size)
    split = np.flatnonzero(over < b - a)
    ends = np.where(over < b - a, a + over, b)
    again = lambda v: np.concatenate((v, v[split]))
    return again(doc), np.concatenate((a, (a + over)[split])), np.concatenate((ends, b[split])), np.concatenate((place, (place + over)[split])), *map(again, more)


def levels_of(total: np.ndarray, share: np.ndarray, queues: int, quantum: int) -> tuple[list[Level], np.ndarray, np.ndarray]:
    """The levels below the last, and the totals and shares of the last one's at most ``queues`` queues."""
    levels = []
    while len(total) > queues:
        levels.append(Level(total, share, max(2, queues - 1), quantum))
        total, share = levels[-1].total, levels[-1].share
    return levels, total, share


def weights_of(totals: np.ndarray, target: list[float] | None = None) -> np.ndarray:
    """Whole-number weights in proportion to ``target``, or to the queues' tokens."""
    share = np.asarray(target if target is not None else totals, float)
    return np.maximum(1, np.rint(share / max(share.sum(), 1e-300) * WEIGHT_SUM)).astype(np.int64)


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", vocabulary: str | None = None,
    mixture: dict[str, float] | None = None, length: int = SEQUENCE, quantum: int = QUANTUM, queues: int = QUEUES, end: int = END,
) -> DataFrame:
    """Pieces of documents with their place in the packed sequences: doc_id, source, start, length, ids (little-endian unsigned 32 bits), doc_tokens, sequence_id, offset.

    ``mixture`` maps sources to target proportions (others: what their tokens
    hold of all); by default every window holds the corpus's own proportions.
    """
    if length % quantum:
        raise ValueError("a sequence holds whole quanta")
    spark = docs.sparkSession
    tokens = materialize(tokenize(docs, id_col, text_col, source_col, vocabulary or default_vocabulary(), end), "tokens")
    sums = tokens.groupBy("source", "part").agg(F.sum("n").alias("n"))
    sums = materialize(sums, "token-sums")
    ranked = sums.groupBy("source").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "source").collect()
    total = np.array([r["n"] for r in ranked], np.int64)
    share = total / max(1, total.sum())
    if mixture is not None:
        share = np.array([mixture.get(r["source"][1:], own) for r, own in zip(ranked, share, strict=True)], float)
    number = spark.createDataFrame([(r["source"], i) for i, r in enumerate(ranked)], "source string, queue long")
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("source", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin")).join(number, "source")
    starts = materialize(starts, "token-starts")  # of known size, so that a small one is broadcast
    levels, total, share = levels_of(total, share, max(2, queues), quantum)
    weight, whole = weights_of(total, share if mixture is not None else None), total // quantum
    rest = np.cumsum(total - whole * quantum) - (total - whole * quantum) + whole.sum() * quantum

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for part in _parts(batch):
                yield _pieces(part, levels, weight, whole, rest, quantum, length)

    placed = tokens.join(starts, ["source", "part"]).select("doc_id", "source", "queue", (F.col("begin") + F.col("at")).alias("at"), "n", "width", "ids")
    return placed.mapInArrow(cut, "doc_id long, source string, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of rows that hold at most PART tokens, or a single row: cutting needs many times a token's bytes."""
    upto, lo = np.cumsum(batch.column("n").to_numpy()), 0
    while lo < batch.num_rows:
        done = upto[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(upto, done + PART, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def _pieces(batch: pa.RecordBatch, levels: list[Level], weight: np.ndarray, whole: np.ndarray, rest: np.ndarray, quantum: int, length: int) -> pa.RecordBatch:
    queue, at, n, width = (batch.column(c).to_numpy().astype(np.int64) for c in ("queue", "at", "n", "width"))
    count = (at + n - 1) // quantum - at // quantum + 1
    doc = np.repeat(np.arange(len(n)), count)
    number = W.ranges(at // quantum, count)
    a, b = np.maximum(at[doc], number * quantum), np.minimum((at + n)[doc], (number + 1) * quantum)
    q, at_q = queue[doc], a
    for level in levels:
        doc, a, b, q, at_q = level.rise((doc, a, b, q, at_q), quantum)
    number = at_q // quantum
    full = number < whole[q]
    place = np.where(full, 0, rest[q] + at_q - whole[q] * quantum)
    place[full] = places(q[full], number[full], weight, whole) * quantum + (at_q % quantum)[full]
    doc, a, b, place = parted((doc, a, b, place), length)  # a rest may lie across two sequences
    order = np.lexsort((a, doc))
    doc, a, b, place = doc[order], a[order], b[order], place[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (place[1:] != place[:-1] + (b - a)[:-1]) | (place[1:] % length == 0)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    doc, start, size, place = doc[first], (a - at[doc])[first], b[last] - a[first], place[first]
    strings = batch.column("ids")
    _, offsets, data = strings.buffers()
    raw = np.frombuffer(data, np.uint8)
    base = np.frombuffer(offsets, np.int32, len(strings), strings.offset * 4).astype(np.int64)
    kind = np.uint16 if width[0] == 2 else np.uint32
    low = base.min()
    ids = raw[low : low + int(n.sum()) * width[0]].view(kind)
    wide = ids[W.ranges((base[doc] - low) // width[0] + start, size)].astype("<u4")
    edges = np.concatenate(([0], np.cumsum(size))) * 4
    blobs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(edges), pa.py_buffer(wide)])
    take = pa.array(doc)
    return pa.record_batch(
        [batch.column("doc_id").take(take), batch.column("source").take(take), pa.array(start), pa.array(size), blobs.cast(pa.binary()), pa.array(n[doc]), pa.array(place // length), pa.array(place % length)],
        names=["doc_id", "source", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
    )


def sequences(pieces: DataFrame, length: int = SEQUENCE, pad: int = 0) -> DataFrame:
    """The packed sequences themselves: sequence_id, n_tokens, ids (hex of little-endian unsigned 32 bits, padded to ``length``). A group holds at most ``length`` tokens."""
    parts = F.array_sort(F.collect_list(F.struct("offset", F.hex("ids").alias("ids"))))
    joined = F.array_join(F.transform(parts, lambda p: p["ids"]), "")
    fill = f"{pad & 0xFF:02X}{pad >> 8 & 0xFF:02X}{pad >> 16 & 0xFF:02X}{pad >> 24 & 0xFF:02X}"
    out = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), joined.alias("ids"))
    return out.withColumn("ids", F.concat("ids", F.repeat(F.lit(fill), (F.lit(length) - F.col("n_tokens")).cast("int"))))
