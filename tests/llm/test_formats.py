"""Chat formatting, media and packing: exact round trips."""

import hashlib
import math
import struct
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinfold.llm import chat_format, media, packing
from tests.llm.helpers import messy, sentence

CONTROL = st.text(alphabet="<|\\>im_endstar\nx", max_size=30)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a\nb", "x\\n<|", ""]), CONTROL), min_size=1, max_size=4))
def test_chat_round_trip(turns):
    roles, texts = (pa.array(c, pa.large_string()) for c in zip(*turns, strict=True))
    made, to, length = chat_format.assemble(roles, texts, np.array([0, len(turns)]))
    text = made[0].as_py()
    assert chat_format.parse(text) == turns
    raw = text.encode()
    assert [chat_format.unescape(raw[a : a + n].decode()) for a, n in zip(to, length, strict=True)] == [t for _, t in turns]


def test_chats_of_messy_turns(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (None, 0, "assistant", "<|im_end|>"), (2, 0, None, "é日"), (2, 0, None, "é日"), (3, None, "assistant", "")] + [(4, i, "assistant", f"t{i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    got = {r["conv_id"]: r for r in chat_format.read_back(chat_format.format_chats(df)).collect()}
    assert len(got) == 5
    assert got[1]["turns_sha256"] == hashlib.sha256(b"user\n\nassistant\nb\n").hexdigest()
    assert (got[None]["loss_chars"], got[2]["n_turns"], got[2]["loss_chars"]) == (10, 2, 0)
    loss = "".join(f"t{i}" for i in range(3000))
    assert (got[4]["n_turns"], got[4]["loss_sha256"]) == (3000, hashlib.sha256(loss.encode()).hexdigest())
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_format.read_back(chat_format.format_chats(none)).count() == 0


def test_chats_in_small_batches(spark, monkeypatch):
    """A conversation longer than a batch, and many short ones beside it."""
    rows = [(c, t, "assistant" if t % 2 else "user", "<|x|>é" * (1 + (c == 3) * 5000)) for c in range(9) for t in range(20)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole = {r["conv_id"]: r for r in chat_format.read_back(chat_format.format_chats(df)).collect()}
    monkeypatch.setattr(chat_format, "BATCH_BYTES", 1000)
    assert {r["conv_id"]: r for r in chat_format.read_back(chat_format.format_chats(df)).collect()} == whole and len(whole) == 9
    assert whole[3]["loss_sha256"] == hashlib.sha256(("<|x|>é" * 50010).encode()).hexdigest()
    monkeypatch.setattr(chat_format, "MOST_BYTES", 5000)
    with pytest.raises(Exception, match="conversation 3 has more"):
        chat_format.format_chats(df).count()


def plain_png(payload):
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    lines = b"".join(b"\0" + payload[i : i + 576] for i in range(0, len(payload), 576))
    head = struct.pack(">II5B", 576, len(payload) // 576, 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(lines, media.LEVEL)) + part(b"IEND", b"")


def test_media_of_nothing_and_of_long_texts(spark):
    none = media.store(spark.createDataFrame([], "doc_id long, text string"))
    assert media.read_back(media.metadata(none)).count() == 0 and media.catalogue(none).count() == 0
    long = "x" * 3_000_000 + "é"
    df = spark.createDataFrame([(1, long), (2, long), (None, None)], "doc_id long, text string").withColumns({"digest": F.lit("own"), "width": F.lit(1)})
    got = {r["doc_id"]: r for r in media.read_back(media.metadata(media.store(df))).collect()}
    assert got[1]["n_bytes"] == 3_000_002 and got[1]["payload_sha256"] == got[2]["payload_sha256"] and got[1]["feature"] == got[2]["feature"]
    assert got[None]["payload_bytes"] == 576
    with pytest.raises(ValueError, match="called like results"):
        media.metadata(media.metadata(media.store(df)))


def test_media_round_trip(spark):
    df = messy(spark)
    index = media.store(df)
    meta = media.metadata(index)
    got = media.read_back(meta).collect()
    texts = sorted((str(r["doc_id"]), r["text"] or "") for r in df.collect())
    assert len(got) == len(texts)
    by = {}
    for r in got:
        by.setdefault(str(r["doc_id"]), r)
        assert r["digest"] == r["payload_sha256"] and (r["width"], r["depth"], r["height"] * 576) == (576, 8, r["payload_bytes"])
    for i, t in texts:
        raw = t.encode()
        payload = raw.ljust(max(1, -(-len(raw) // 576)) * 576, b"\xff")
        r = by[i]
        assert (r["n_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        stored = plain_png(payload)
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
        value = [payload.count(bytes([b])) for b in range(256)]
        mean = sum(payload) / len(payload)
        spread = (sum(n * (b - mean) ** 2 for b, n in enumerate(value)) / len(payload)) ** 0.5
        entropy = -sum(n / len(payload) * math.log2(n / len(payload)) for n in value if n)
        told = {k: float(v) for k, v in (x.split("=") for x in r["feature"].split(";"))}
        assert told == pytest.approx({"mean": mean, "std": spread, "entropy": abs(entropy), "distinct": sum(map(bool, value))}, abs=6e-4)
    once = media.catalogue(index)
    assert once.count() == len({r["payload_sha256"] for r in got}) and once.agg(F.sum("n_refs")).first()[0] == len(got)
    with pytest.raises(ValueError):
        media.header(b"\0" * 33)


@pytest.fixture(scope="module")
def tokenizer():
    return pytest.importorskip("tokenizers").Tokenizer.from_file(packing.default_vocabulary())


ODD = st.text(alphabet=st.sampled_from("ab'sLl 1\n\t  　é日\x85\x1c.!"), max_size=40)


def test_encoders_forget_and_encode_the_same():
    own, texts = packing.encoder(packing.default_vocabulary()), pa.array([f"word{i} and{i * 7}" for i in range(30_000)], pa.large_string())
    ids, at = own.encode(texts)
    assert len(own.number) > 30_000 and len(own.ids) > 1 << 16
    packing.forget()
    assert not own.number and len(own.ids) == 1 << 16
    again, again_at = own.encode(texts)
    assert (again == ids).all() and (again_at == at).all()
    packing.forget()


@settings(max_examples=300, deadline=None)
@given(st.lists(ODD, min_size=1, max_size=5))
def test_ids_equal_the_tokenizer(tokenizer, texts):
    ids, at = packing.encoder(packing.default_vocabulary()).encode(pa.array(texts, pa.large_string()))
    want = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == want


WITH_ADDED = st.lists(st.sampled_from(["<|endoftext|>", "<|endof", "text|>", "<|", " ", "  ", "\n", "foo", " bar", "'s", "é", "\x85", "\u3000", "1"]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(WITH_ADDED, min_size=1, max_size=5))
def test_ids_of_added_tokens_equal_the_tokenizer(tokenizer, texts):
    texts = ["foo <|endoftext|> bar", *texts]
    ids, at = packing.encoder(packing.default_vocabulary()).encode(pa.array(texts, pa.large_string()))
    want = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == want


def test_packing_keeps_added_tokens(spark, tokenizer):
    texts = ["foo <|endoftext|> bar", "<|endoftext|><|endoftext|>x", "a\n\n<|endoftext|>  b", "plain"]
    ids = {i: np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], "<u4") for i, t in enumerate(texts)}
    assert 50256 in ids[0]
    check_packing(packing.pack(spark.createDataFrame([(i, t, "a") for i, t in enumerate(texts)], "doc_id long, text string, source string")), ids)


def test_places_are_a_weighted_order():
    weight, whole = np.array([3, 1, 2]), np.array([30, 10, 5])
    q = np.repeat(np.arange(3), whole)
    j = np.concatenate([np.arange(n) for n in whole])
    place = packing.places(q, j, weight, whole)
    assert sorted(place) == list(range(whole.sum()))
    order = q[np.argsort(place)]
    for n in range(1, 16):  # while all queues last, no deficit passes one quantum
        served = np.bincount(order[:n], minlength=3)
        assert (abs(n * weight / 6 - served) <= 1).all()


def brute_places(rows, quantum=256):
    """The source of every token in order, by deficits one quantum at a time: (source, part, at, n) of documents."""
    total = {}
    for source, *_, n in rows:
        total[source] = total.get(source, 0) + n
    queues = sorted(total, key=lambda s: (-total[s], s))
    weight = packing.weights_of(np.array([total[q] for q in queues])).tolist()
    whole = [total[q] // quantum for q in queues]
    served, out = [0] * len(queues), []
    for _ in range(sum(whole)):
        # the deficit of a queue reaches half a quantum at (2 served + 1) / (2 weight)
        q = min((Fraction(2 * served[i] + 1, weight[i]), i) for i in range(len(queues)) if served[i] < whole[i])[1]
        out += [queues[q]] * quantum
        served[q] += 1
    for q, n in zip(queues, whole, strict=True):
        out += [q] * (total[q] - n * quantum)
    return out


def check_packing(pieces, ids):
    rows = pieces.collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for n, parts in by_sequence.items():
        upto = 0
        for at, size in sorted(parts):
            assert at == upto
            upto += size
        assert upto == 2048 or (n == len(by_sequence) - 1 and upto <= 2048)
    for (doc, total), parts in by_doc.items():
        if doc in ids:
            whole = ids[doc]
            assert total == len(whole)
            for r in parts:
                assert r["ids"] == whole[r["start"] : r["start"] + r["length"]].tobytes()
            assert sum(r["length"] for r in parts) % total == 0


def test_packing_of_messy_rows(spark, tokenizer):
    df = messy(spark)
    ids = {r["doc_id"]: np.array([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4") for r in df.collect()}
    pieces = packing.pack(df)
    check_packing(pieces, ids)
    out = packing.sequences(pieces).orderBy("sequence_id").collect()
    assert all(len(r["ids"]) == 2048 * 8 for r in out)
    few = packing.pack(df, queues=2)
    check_packing(few, ids)
    check_packing(packing.pack(df, mixture={"a": 0.7, "b": 0.1}), ids)


def test_packing_keeps_the_mixture(spark):
    rows = [(i, " ".join(sentence(i, 300)), "big" if i % 4 else "small") for i in range(80)]
    pieces = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    total = {r["source"]: r["n"] for r in pieces.groupBy("source").agg(F.sum("length").alias("n")).collect()}
    share = total["=small"] / sum(total.values())
    wide = pieces.groupBy("sequence_id").agg((F.sum(F.when(F.col("source") == "=small", F.col("length")).otherwise(0)) / F.sum("length")).alias("s"), F.sum("length").alias("n")).where("n = 2048").collect()
    assert len(wide) > 10 and all(abs(r["s"] - share) <= 2 * 256 / 2048 for r in wide[:-1])


def test_packing_keeps_the_mixture_of_many_sources(spark):
    rows = [(i, " ".join(sentence(i, 300)), f"s{i % 12:02}") for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for mixture in (None, {f"s{i:02}": 3.0 if i == 11 else 1.0 for i in range(12)}):
        pieces = packing.pack(docs, queues=4, mixture=mixture).collect()
        check_packing_rows(pieces)
        total = sum(r["length"] for r in pieces)
        for s in range(12):
            ends = sorted((r["sequence_id"] * 2048 + r["offset"], r["length"]) for r in pieces if r["source"] == f"=s{s:02}")
            for at in range(0, total // 4, 2048):  # no source is used up before
                served = sum(min(n, max(0, at - p)) for p, n in ends)
                want = at * (mixture[f"s{s:02}"] / sum(mixture.values()) if mixture else sum(n for _, n in ends) / total)
                assert abs(served - want) <= 4 * 256, (mixture, s, at, served, want)


def check_packing_rows(rows):
    """Every place is taken once, and every document's tokens are there once."""
    upto = 0
    for at, n in sorted((r["sequence_id"] * 2048 + r["offset"], r["length"]) for r in rows):
        assert at == upto
        upto += n
    by = {}
    for r in rows:
        by.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], r["length"]))
    for (_, total), parts in by.items():
        upto = 0
        for start, n in sorted(parts):
            assert start == upto
            upto += n
        assert upto == total


def test_packing_of_nothing(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
