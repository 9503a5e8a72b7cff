"""N-gram join, substring dedup, decontamination and licence scan against brute force and SQL."""

import hashlib
import re
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfold.llm import queries, sql
from kinfold.llm.components import components
from kinfold.llm.decontaminate import Suffixes, decontaminate, remove_contaminated
from kinfold.llm.license_scan import TEMPLATES, anchors, scan
from kinfold.llm.ngram_join import jaccard_components, keep_one
from kinfold.llm.substring_dedup import dedup_substrings, pack, remove_repeats, unpack
from tests.llm.helpers import ALNUM, CLASHING, SPACED, lower, messy, rows_of, sentence
from tests.oracle import assert_same, connect


@pytest.mark.parametrize("name", sorted(sql.ORACLE))
def test_matches_sql(spark, sf, name):
    assert_same(queries.QUERIES[name](spark, sf), connect(sf), sql.ORACLE[name])


def brute_components(rows, size=5, percent=80):
    sets = []
    for _, text in rows:
        w = re.findall(SPACED, lower(text))
        sets.append({tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} - {()})
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    links = [0] * len(rows)
    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                links[i] += 1
                links[j] += 1
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    least = defaultdict(list)
    for i in range(len(rows)):
        if rows[i][0] is not None:
            least[root(i)].append(rows[i][0])
    return sorted(((d, len(s), min(least[root(i)], default=None), n) for i, ((d, _), s, n) in enumerate(zip(rows, sets, links, strict=True))), key=str)


def test_ngram_join_on_messy_rows(spark):
    df = messy(spark)
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    got = rows_of(jaccard_components(df), "doc_id", "n_shingles", "component_id", "n_links")
    assert got == brute_components(rows)


def near_copies(n):
    """A chain of near copies, which spans several blocks, and others."""
    base = sentence(21, 80)
    rows = []
    for i in range(n):
        w = list(base)
        for k in range(i // 6):
            w[(k * 7) % 80] = f"z{k}"
        w[(i * 13) % 80] = f"y{i}"
        rows.append((1000 - i, " ".join(w)))
    return rows + [(i, " ".join(sentence(500 + i, 40))) for i in range(5)]


@pytest.mark.parametrize("size", [300, 1 << 18])
def test_ngram_join_of_many_near_copies(spark, monkeypatch, size):
    from kinfold.llm import ngram_join

    monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", size)
    monkeypatch.setattr(ngram_join, "LEAST_SHINGLES", 1)
    rows = near_copies(60)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_components(rows)
    assert rows_of(jaccard_components(df), "doc_id", "n_shingles", "component_id", "n_links") == want
    assert rows_of(jaccard_components(df, count=False), "doc_id", "n_shingles", "component_id") == sorted((r[:3] for r in want), key=str)


def test_ngram_join_of_one_large_batch_of_boilerplate(spark):
    """A passage in every document, in documents that are alike and in some that aren't."""
    passage = sentence(3, 90)
    rows = [(i, " ".join([*passage, *sentence(i // 2 * 2 + 100, 10 if i % 5 else 200)])) for i in range(70)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert rows_of(jaccard_components(df), "doc_id", "n_shingles", "component_id", "n_links") == brute_components(rows)


def test_pairs_of_short_texts_are_told_apart(spark):
    """Words of a Thue-Morse pattern, whose polynomial hashes would be equal whatever the base."""
    a = "a"
    for _ in range(11):
        a += a.translate(str.maketrans("ab", "ba"))
    rows = [(1, a), (2, a.translate(str.maketrans("ab", "ba"))), (3, a)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(jaccard_components(df), "doc_id", "component_id") == [(1, 1), (2, 2), (3, 1)]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string, lang string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert jaccard_components(none).count() == 0
    assert dedup_substrings(none).count() == 0
    assert decontaminate(none, bench).count() == 0
    assert scan(none).count() == 0
    assert rows_of(decontaminate(messy(spark), bench).where("contaminated"), "doc_id") == []


def brute_keep_one(rows):
    """Indexes of the rows that stay, but of equal rows any one: the rows themselves."""
    sets = [brute_components([r])[0][1] for r in rows]
    kept, group = [], {}
    found = [i for i, n in enumerate(sets) if n]
    up = {i: i for i in found}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in found:
        for j in found:
            if i < j and brute_components([(0, rows[i][1]), (1, rows[j][1])])[1][2] == 0:
                up[max(root(i), root(j))] = min(root(i), root(j))
    for i in found:
        rank = (rows[i][0] is None, rows[i][0] or 0, hashlib.md5(rows[i][1].encode()).hexdigest())
        group[root(i)] = min(group.get(root(i), (rank, rows[i])), (rank, rows[i]), key=lambda x: x[0])
    kept += [r for _, r in group.values()] + [r for r, n in zip(rows, sets, strict=True) if not n]
    return sorted(kept, key=str)


def test_keep_one(spark):
    df = messy(spark)
    extra = [(1, "one two three"), (2, "one two three"), (2, "another text altogether"), (None, "alone"), (None, "alone"), (3, None), (3, None), (21, "six seven"), (21, "Six  seven")]
    more = df.where("doc_id = 7").crossJoin(spark.createDataFrame(extra, "a long, b string")).withColumns({"doc_id": F.col("a"), "text": F.col("b")}).drop("a", "b")
    df = df.unionByName(more)
    kept = keep_one(df)
    assert kept.columns == df.columns
    want = brute_keep_one([(r["doc_id"], r["text"]) for r in df.collect()])
    assert rows_of(kept, "doc_id", "text") == want
    before = {tuple(r) for r in df.collect()}
    assert all(tuple(r) in before for r in kept.collect())
    assert keep_one(df.limit(0)).count() == 0
    single = spark.createDataFrame([(1, "A a"), (2, "A a"), (2, "B b")], "doc_id long, text string")
    assert rows_of(keep_one(single), "doc_id", "text") == [(1, "A a"), (2, "B b")]


def test_components_of_a_long_path(spark):
    n = 300
    order = np.random.RandomState(1).permutation(n).tolist()
    edges = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)] + [(1000, 1001), (7, 7), (None, 3)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, n)}, 1001: 1000}


def brute_dedup(rows, window=13):
    first = {}
    words = [re.findall(SPACED, t or "") for _, t in rows]
    for (d, _), w in zip(rows, words, strict=True):
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            rank = (d is None, d or 0)
            first[key] = min(first.get(key, rank), rank)
    out = []
    for (d, _), w in zip(rows, words, strict=True):
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < (d is None, d or 0):
                gone[k : k + window] = [True] * window
        kept = " ".join(a for a, g in zip(w, gone, strict=True) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def test_substring_dedup_on_messy_rows(spark):
    df = messy(spark)
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    out = dedup_substrings(df)
    assert out.columns == [*df.columns, "dedup_n_words", "n_removed", "kept_sha256", "dedup_removed"]
    assert rows_of(out, "doc_id", "dedup_n_words", "n_removed", "kept_sha256") == brute_dedup(rows)
    assert rows_of(out, *CLASHING) == rows_of(df, *CLASHING)
    for r in out.collect():
        assert sum(s["length"] for s in r["dedup_removed"]) == r["n_removed"]
        if r["n_removed"]:
            assert hashlib.sha256(r["text"].encode()).hexdigest() == r["kept_sha256"]
    left = remove_repeats(df, length_col="n_chars")
    assert left.columns == df.columns and rows_of(left, *CLASHING, "text") == rows_of(out, *CLASHING, "text")
    assert all(r["n_chars"] == len(r["text"] or "") for r in left.collect())
    assert remove_repeats(df.limit(0)).count() == 0


def test_substring_dedup_of_hot_and_missing_ids(spark):
    """One id on half of the rows, and many rows without one: they never remove from each other."""
    passage = sentence(99, 30)
    text = lambda i: " ".join([*sentence(i, 9), *passage[i % 7 :], *sentence(i + 1, 9)])
    for ids in ([5] * 60 + list(range(20)) + [None] * 30, [5] * 60 + [None] * 30, [None] * 20, [9] * 20 + list(range(10)), [0] * 20 + list(range(10)), [-(2**63), 2**63 - 1, 0, 0]):
        rows = [(d, text(i)) for i, d in enumerate(ids)]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        assert rows_of(dedup_substrings(df), "doc_id", "n_words", "n_removed", "kept_sha256") == brute_dedup(rows)


def test_packed_hashes():
    h = np.sort(np.random.RandomState(0).randint(0, 2**63, 1000).astype(np.uint64))
    assert (unpack(pack(h)) == h).all() and len(unpack(pack(h[:0]))) == 0


def brute_leaks(rows, items, window=10):
    at = defaultdict(set)
    for item, text in items:
        w = re.findall(ALNUM, lower(text))
        for k in range(max(len(w) - window + 1, 1)) if w else ():
            at[tuple(w[k : k + window])].add("null" if item is None else str(item))
    sizes = {len(k) for k in at}
    out = []
    for d, text in rows:
        w = re.findall(ALNUM, lower(text))
        hit, found = [0] * len(w), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (key := tuple(w[k : k + n])) in at:
                    found |= at[key]
                    hit[k : k + n] = [1] * n
        out.append((d, len(w), sum(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), sum(hit) > 0))
    return sorted(out, key=str)


@pytest.mark.parametrize("block_bytes", [1 << 24, 60])
def test_decontaminate_on_messy_rows(spark, block_bytes):
    df = messy(spark)
    items = [(1, " ".join(sentence(99, 20))), (2, "ONE two"), (2, "one two"), (3, None), (4, " ... "), (None, " ".join(sentence(5, 40)[20:])), (10, " ".join(sentence(7, 60)[5:16])), (11, "日本語 日本語 日本語")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    out = decontaminate(df, bench, block_bytes=block_bytes)
    assert rows_of(out, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == brute_leaks(rows, items)
    most = {r["doc_id"]: r["longest_match"] for r in out.collect()}
    assert most[10] == 20 and most[7] == 2 and most[3] == 0 and most[13] == 20
    kept = remove_contaminated(df, bench, block_bytes=block_bytes)
    clean = {d for d, *_, bad in brute_leaks(rows, items) if not bad}
    assert kept.columns == df.columns
    assert sorted(map(str, kept.collect())) == sorted(str(r) for r in df.collect() if r["doc_id"] in clean)


def brute_suffixes(ids, first):
    ends = [next(e for e in first if e > p) for p in range(len(ids))]
    out = []
    for p, e in enumerate(ends):
        stop = next((q for q in range(p, e) if ids[q] == 0), e)
        if stop > p:
            out.append(tuple(ids[p:stop]))
    return sorted(out)


def test_suffix_arrays_are_sorted_to_full_depth():
    r = np.random.RandomState(4)
    for k in range(150):
        ids = r.randint(0, 1 + [1, 2, 3, 20][k % 4] + 1, r.randint(1, 60))
        first = np.unique(np.concatenate(([0, len(ids)], r.randint(0, len(ids) + 1, 3))))
        for bits in (20, int(ids.max()).bit_length() or 1):
            s = Suffixes(ids, first, bits)
            assert [tuple(ids[p : p + s.run[p]]) for p in s.order] == brute_suffixes(ids.tolist(), first.tolist())


def test_longest_matches(spark):
    """Matches longer than a window, in texts that repeat themselves, found from each place by one search."""
    item = sentence(5, 300)
    items = [(1, " ".join(item)), (2, " ".join([*item[100:160], "other", *item[161:200]])), (3, " ".join(["la"] * 50)), (4, " ".join(item[10:30]))]
    rows = [(1, " ".join(["x", *item[20:277], "y"])), (2, " ".join([*item[90:160], "other", *item[161:175]])), (3, " ".join(["la"] * 33)), (4, " ".join(item[:9])), (5, " ".join([*item[150:165], "no", *item[40:60]]))]
    bench, df = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(rows, "doc_id long, text string")
    out = {r["doc_id"]: r for r in decontaminate(df, bench).collect()}
    assert [out[i]["longest_match"] for i in range(1, 6)] == [257, 75, 33, 0, 20]
    assert [(s["start"], s["length"]) for s in out[1]["hit_spans"]] == [(1, 257)] and out[3]["items"] == ["3"]
    assert rows_of(decontaminate(df, bench), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == brute_leaks(rows, items)


def test_licence_scan(spark):
    rows = [
        (1, "Licensed under the MIT License. mit license"), (2, "licensed under apache license version 2"), (3, "cc-by 4.0, all rights reserved by us"), (4, None), (5, "GNU General Public License"),
        (6, "gnu lesser general public license"), (7, "mozilla public license, version 2"), (8, "general public license"), (9, "by all 2 under version"), (10, "license " * 3000 + "mit license"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"words": F.lit(1), "word": F.lit("x"), "hits": F.lit(2), "at0": F.lit(3)})
    got = {r["doc_id"]: r for r in scan(df).collect()}
    assert [got[i]["base_labels"] for i in range(1, 11)] == ["mit", "apache", "cc-by", "", "gpl", "", "", "", "", "mit"]
    assert (got[1]["n_base"], got[1]["first_word"], got[1]["last_word"]) == (2, 3, 5)
    assert [got[i]["labels"] for i in (2, 3, 6, 7)] == ["apache,apache-2", "all-rights-reserved,cc-by", "lgpl", "mpl"]
    assert (got[10]["first_word"], got[10]["n_words"], got[4]["score"]) == (3000, 3002, 0.0)


def test_licence_texts_with_gaps(spark):
    """Long templates with words left out, put in and changed; key phrases must be whole, and the others near."""
    by = {t.label: t for t in TEMPLATES}
    mit, bsd = by["mit-text"].words, by["bsd"].words
    fill = sentence(8, 40)
    texts = {
        1: [*fill, *mit, *fill], 2: [*mit[:40], "inserted", "words", *mit[40:80], *mit[83:]], 3: [*mit[:3], "refused", *mit[4:]], 4: [*mit[:20], *fill, *mit[20:]],
        5: [*mit[:30]], 6: [*bsd, *fill, *mit], 7: [w for i, w in enumerate(bsd) if i % 9 != 8 or 20 < i < 40], 8: mit[6:], 9: [w if i < 8 else "x" for i, w in enumerate(bsd)],
    }
    df = spark.createDataFrame([(k, " ".join(v)) for k, v in texts.items()], "doc_id long, text string")
    got = {r["doc_id"]: r for r in scan(df).collect()}
    assert [got[i]["labels"] for i in (1, 2, 3, 4, 5, 6, 8, 9)] == ["mit-text", "mit-text", "", "", "", "bsd,mit-text", "", ""]
    assert got[1]["score"] == pytest.approx(len(mit) / (len(mit) + 2), abs=1e-6) and [m["place"] for m in got[1]["matches"]] == [40]
    assert 0.9 < got[2]["matches"][0]["share"] < 1
    db = duckdb.connect()
    db.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    db.executemany("INSERT INTO documents VALUES (?, ?)", [(k, " ".join(v)) for k, v in texts.items()])
    assert_same(scan(df).drop("matches"), db, sql.ORACLE["op7_license_scan"])


def test_anchors_follow_the_frequencies():
    assert anchors("a b c b".split(), {"a": 1.0, "b": 3.0, "c": 2.0}) == [(1, "b"), (2, "c")]
    assert all(t.words[p : p + len(w)] == w for t in TEMPLATES for p, w in t.phrases)
