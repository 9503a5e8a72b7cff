"""Blocking: candidate pairs from an inverted index, exact keys, word sets and dense vectors.

Queries and pool records are rows keyed by (country, src, id). The sparse
views of a run are one plan: the view is a column of one inverted index
(``sparse_views``), and so are country and source.

A term's posting list is bounded by the document-frequency cap before any
join, and a key's bucket by the key cap. What is joined by a term comes from
exchanges of its own on either side, so that Spark can split a term that very
many queries share; keys are salted. Top-k keeps at most k rows per query and
is pushed below the final window by Catalyst.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinfold.functions.similarity import dot

RRF_K = 60
MISSING_RANK = 1e6
FLAG_GAIN = 0.01
#: Share of words in common, as a fraction, from which two word sets are similar.
SHARE = (1, 5)
#: A word of more than one in so many texts of a block is kept as a mark for each text, others as places.
_DENSE = 64
#: Records that a query is compared with at once, and queries that are compared at once.
_RECORDS, _QUERIES = 32768, 64
#: Similarities, besides the least, above which alone pairs are looked at once k others reach them.
_LEVELS = (1 / 5, 1 / 4, 2 / 7, 1 / 3, 5 / 13, 1 / 2, 3 / 5, 4 / 5)
#: Partitions for pairs of blocks, as a multiple of the shuffle's.
_PARTS = 4
#: Parts that the queries of one key are dealt to.
SALTS = 8


def word_terms(text: Column, longest: int = 1) -> Column:
    """Words and, up to ``longest`` words, word n-grams."""
    w = F.filter(F.split(text, " "), lambda x: x != "")
    out = w
    for n in range(2, longest + 1):
        starts = F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - (n - 1))).otherwise(F.array().cast("array<int>"))
        out = F.concat(out, F.transform(starts, lambda i: F.array_join(F.slice(w, i, n), " ")))
    return out


def char_terms(text: Column, shortest: int = 3, longest: int = 4) -> Column:
    """Character n-grams of each word with a blank on either side; a padded word shorter than n is one term of that length."""
    padded = F.transform(F.filter(F.split(text, " "), lambda x: x != ""), lambda x: F.concat(F.lit(" "), x, F.lit(" ")))

    def grams(w: Column, n: int) -> Column:
        return F.when(F.length(w) <= n, F.when(F.length(w) == n, F.array(w)).otherwise(F.array().cast("array<string>"))).otherwise(
            F.transform(F.sequence(F.lit(1), F.length(w) - (n - 1)), lambda i: F.substring(w, i, n))
        )

    return F.flatten(F.transform(padded, lambda w: F.concat(*(grams(w, n) for n in range(shortest, longest + 1)))))


def term_counts(df: DataFrame, terms: Column, keys: list[str]) -> DataFrame:
    """keys, term, tf; counted inside the row, without a shuffle."""
    own = df.select(*keys, F.array_sort(terms).alias("__s")).withColumn("__t", F.array_distinct("__s"))
    first = F.transform("__t", lambda x: F.array_position("__s", x))
    own = own.select(*keys, "__t", first.alias("__at"), F.size("__s").alias("__n"))
    tf = F.transform("__t", lambda x, i: F.struct(x.alias("term"), (F.coalesce(F.get("__at", i + 1), F.col("__n") + 1) - F.get("__at", i)).alias("tf")))
    return own.select(*keys, F.explode(tf).alias("__e")).select(*keys, "__e.term", F.col("__e.tf").cast("long").alias("tf"))


def index(counts: DataFrame, n_docs: DataFrame, block: list[str], doc: list[str], cap: int | Column, least: int | Column = 1) -> tuple[DataFrame, DataFrame]:
    """(terms, postings) of a pool.

    terms: block, term, df, idf for least <= df <= cap. postings: block, doc,
    term, weight with tf 1 + ln(tf), idf ln((1 + n) / (1 + df)) + 1, rows at
    length 1. ``n_docs``: block, n.
    """
    df = counts.groupBy(*block, "term").agg(F.count("*").alias("df")).join(n_docs, block)
    terms = df.where((F.col("df") >= least) & (F.col("df") <= cap)).withColumn("idf", F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).drop("n")
    return terms, weighted(counts, terms, [*block, "term"], [*block, *doc])


def weighted(counts: DataFrame, terms: DataFrame, on: list[str], row: list[str]) -> DataFrame:
    """row, term, weight: the terms of each row at length 1. A row's terms are one short array, so their norm takes no join."""
    raw = counts.join(terms.drop("df"), on).select(*row, F.struct("term", ((1 + F.log("tf")) * F.col("idf")).alias("w")).alias("e"))
    rows = raw.groupBy(*row).agg(F.collect_list("e").alias("es"), F.sqrt(F.sum(F.col("e.w") * F.col("e.w"))).alias("norm"))
    return rows.select(*row, "norm", F.explode("es").alias("e")).select(*row, "e.term", (F.col("e.w") / F.col("norm")).alias("weight"))


def sparse_scores(queries: DataFrame, postings: DataFrame, block: list[str], query_id: str, doc_id: str) -> DataFrame:
    """block, query, doc, score (rounded to six places): the sum of products over shared terms."""
    q = queries.withColumnRenamed("weight", "wq")
    d = postings.withColumnRenamed("weight", "wd")
    return q.join(d, [*block, "term"]).groupBy(*block, query_id, doc_id).agg(F.round(F.sum(F.col("wq") * F.col("wd")), 6).alias("score"))


def top_k(scores: DataFrame, by: list[str], k: int, tie: list[str], score: str = "score", rank: str = "rank") -> DataFrame:
    """The k best rows of each group, ranks from 1; ties go to the smallest id."""
    w = Window.partitionBy(*by).orderBy(F.desc(score), *tie)
    return scores.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def sparse_pairs(s1: DataFrame, pool: DataFrame, views: dict[str, Column], cap: int | None = None, max_df_frac: float = 0.0015, least_cap: int = 50, least: dict[str, int] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(queries, postings, scores) of all sparse views of every S1 row against each source of its country; view, country and src come first.

    ``s1``: country, s1_id and what the terms of ``views`` read; ``pool``:
    country, src, rec_id and the same. Without ``cap`` it is
    max(50, 0.0015 * pool size).
    """
    block = ["view", "country", "src"]
    every = F.flatten(F.array(*(F.transform(terms, _marked(v)) for v, terms in views.items())))

    def counted(df: DataFrame, keys: list[str]) -> DataFrame:
        cut = F.split("term", "\u0001", 2)
        return term_counts(df, every, keys).select(cut[0].alias("view"), *keys, cut[1].alias("term"), "tf")

    counts = counted(pool, ["country", "src", "rec_id"])
    n = pool.groupBy("country", "src").agg(F.count("*").alias("n")).withColumn("view", F.explode(F.array(*map(F.lit, views))))
    limit = F.lit(cap) if cap else F.greatest(F.lit(least_cap), F.floor(F.lit(max_df_frac) * F.col("n")))
    at_least = F.lit(1)
    for view, k in (least or {}).items():
        at_least = F.when(F.col("view") == view, F.lit(k)).otherwise(at_least)
    kept, postings = index(counts, n, block, ["rec_id"], limit, at_least)
    queries = weighted(counted(s1, ["country", "s1_id"]), kept, ["view", "country", "term"], [*block, "s1_id"])
    return queries, postings, sparse_scores(queries, postings, block, "s1_id", "rec_id")


def _marked(view: str):
    return lambda term: F.concat(F.lit(f"{view}\u0001"), term)


def sparse_views(s1: DataFrame, pool: DataFrame, views: dict[str, Column], k: int, **options) -> DataFrame:
    """view, country, src, s1_id, rec_id, score, rank: the k best records of every view, from one inverted index."""
    return top_k(sparse_pairs(s1, pool, views, **options)[2], ["view", "country", "src", "s1_id"], k, ["rec_id"])


def tfidf_top_k(s1: DataFrame, pool: DataFrame, terms: Column, k: int, cap: int | None = None, max_df_frac: float = 0.0015, least_cap: int = 50, least: int = 1) -> DataFrame:
    """``sparse_views`` of one view, without the column view."""
    return sparse_views(s1, pool, {"one": terms}, k, cap=cap, max_df_frac=max_df_frac, least_cap=least_cap, least={"one": least}).drop("view")


def reverse_top_k(s1: DataFrame, pool: DataFrame, terms: Column, k: int, **options) -> DataFrame:
    """country, src, rec_id, s1_id, score, rank: the k best queries of every record."""
    return top_k(sparse_pairs(s1, pool, {"one": terms}, **options)[2].drop("view"), ["country", "src", "rec_id"], k, ["s1_id"])


def nearest(queries: DataFrame, pool: DataFrame, columns: list[str], k: int, owned: float, share: tuple[int, int] = SHARE, query_rows: int = 8192, pool_rows: int = 131072, at_once: int = _RECORDS) -> DataFrame:
    """country, src, s1_id, rec_id, prob, owner: of the pairs whose word sets in one of ``columns`` have a Jaccard similarity of ``share`` or more, the k best records of each query and source (owner false), and each record's best query from ``owned`` on (owner true).

    prob is the mean of the columns' similarities, rounded to six places; ties
    go to the smallest id. Both sides are cut into blocks, and a pair of blocks
    is one pass over the words of either: what two texts share is counted by
    posting lists and never becomes rows, so neither a frequent word nor a
    large group of near copies makes more than k rows a query and block. No
    word and no pair is left out.
    """
    block, ids = ["country", "src"], ["s1_id", "rec_id"]
    asked = queries.where(F.col("country").isNotNull()).join(pool.select(*block).distinct(), "country")
    a, b = _dealt(asked, pool, block, *ids, query_rows, pool_rows)
    fields = {f.name: f.dataType.simpleString() for f in [*asked.schema.fields, *pool.schema.fields]}
    schema = ", ".join(f"{n} {fields[n]}" for n in [*block, *ids]) + ", prob double, owner boolean"

    def product(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.sort_by("s1_id"), right.sort_by("rec_id")
        rows_a, rows_b, probs, owners = _nearest(*([t.column(c) for c in columns] for t in (left, right)), left.num_rows, right.num_rows, k, owned, share, at_once)
        out = {n: left.column(n).take(rows_a) for n in (*block, "s1_id")} | {"rec_id": right.column("rec_id").take(rows_b)}
        return pa.table(out | {"prob": pa.array(probs), "owner": pa.array(owners)})

    keys = [*block, "__q", "__d"]
    # few rows make much work here, so blocks aren't to be put together by their bytes
    parts = _PARTS * int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    a, b = a.repartition(parts, *keys), b.repartition(parts, *keys)
    found = a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInArrow(product, schema)
    # one window for both kinds, so that the products are made once
    mine, other = (F.when(F.col("owner"), F.col(x)).otherwise(F.col(y)) for x, y in (("rec_id", "s1_id"), ("s1_id", "rec_id")))
    best = top_k(found.withColumns({"__own": mine, "__other": other}), ["__own", "owner", *block], k, ["__other"], "prob")
    return best.where("NOT owner OR rank = 1").drop("rank", "__own", "__other")


def _words_of(texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(row, word) of every distinct word of every text, by row, and the words."""
    lists = pc.split_pattern(pc.fill_null(texts.combine_chunks(), ""), " ")
    flat, rows = pc.list_flatten(lists), pc.list_parent_indices(lists)
    some = pc.not_equal(flat, "")
    coded = flat.filter(some).dictionary_encode()
    many = max(1, len(coded.dictionary))
    own = np.sort(rows.filter(some).to_numpy().astype(np.int64) * many + coded.indices.to_numpy().astype(np.int64))
    own = own[np.diff(own, prepend=-1) > 0]
    return own // many, own % many, coded.dictionary


def _marks(places: np.ndarray, n: int, kind: np.dtype) -> np.ndarray:
    out = np.zeros(n, kind)
    out[places] = 1
    return out


class _Column:
    """The words of one column on either side of a product: postings of the records, and how many words a query and a record must share."""

    def __init__(self, x: tuple[np.ndarray, np.ndarray, pa.Array], y: pa.ChunkedArray, n: int, m: int):
        row, word, names = x
        their_row, their_word, vocabulary = _words_of(y)
        self.postings = their_row[np.argsort(their_word, kind="stable")]
        self.many = np.bincount(their_word, minlength=len(vocabulary))
        self.start = np.cumsum(self.many) - self.many
        self.theirs = np.bincount(their_row, minlength=m)
        self.top = int(self.theirs.max()) + 1
        self.kind = np.min_scalar_type(self.top)
        often = np.flatnonzero(self.many * _DENSE >= m)
        self.marks = {w: _marks(self.postings[self.start[w] : self.start[w] + self.many[w]], m, self.kind) for w in often.tolist()}
        known = np.array(pc.fill_null(pc.index_in(names, value_set=vocabulary), -1), np.int64)[word]
        self.mine = np.bincount(row, minlength=n)
        self.sizes = self.mine.tolist()
        frequent = np.zeros(len(vocabulary) + 1, bool)
        frequent[often] = True
        # (query, word) of the words kept as marks, and of those kept as places
        self.marked, self.placed = ((row[some], known[some], np.searchsorted(row[some], np.arange(n + 1))) for some in (frequent[known], (known >= 0) & ~frequent[known]))
        self.dense = np.diff(self.marked[2]) > 0
        self.least: dict[tuple, np.ndarray] = {}
        self.held = np.zeros((_QUERIES, m), self.kind)
        self.left: tuple[np.ndarray, list[int]] = np.empty(0, np.int64), []

    def count(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """The words that queries from lo to hi share with every record, a row a query, until the next call; and the places in it that queries without a word kept as marks reach."""
        m, out = len(self.theirs), self.held
        flat = out.reshape(-1)
        flat[self.left[0]] = 0
        out[self.left[1]] = 0
        row, word, at = self.marked
        for i, w in zip((row[at[lo] : at[hi]] - lo).tolist(), word[at[lo] : at[hi]].tolist()):
            out[i] += self.marks[w]
        row, word, at = self.placed
        row, word = row[at[lo] : at[hi]] - lo, word[at[lo] : at[hi]]
        many = self.many[word]
        places = self.postings[np.arange(many.sum()) + np.repeat(self.start[word] - (np.cumsum(many) - many), many)]
        rows = np.repeat(row, many)
        places += rows * m
        np.add.at(flat, places, self.kind.type(1))
        alone = places[~self.dense[lo:hi][rows]]
        self.left = alone, np.flatnonzero(self.dense[lo:hi]).tolist()
        return out, alone

    def needed(self, i: int, share: tuple[int, int] | float) -> np.ndarray:
        """Words to share with query i for a similarity of ``share``; a number that isn't reached where a set is empty."""
        key = self.sizes[i], share
        if key not in self.least:
            both = key[0] + self.theirs
            some = np.ceil(share * both / (1 + share) - 1e-9) if isinstance(share, float) else -(-share[0] * both // sum(share))
            self.least[key] = np.minimum(np.where(self.theirs > 0, some, self.top), self.top).astype(self.kind)
        return self.least[key]


def _nearest(left: list[pa.ChunkedArray], right: list[pa.ChunkedArray], n: int, m: int, k: int, owned: float, share: tuple[int, int], at_once: int = _RECORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``nearest`` of two blocks whose rows are in the order of their ids: rows of either, prob, owner.

    Queries meet ``at_once`` records at a time, fewer at first: those
    of later ones that can't be among the k best any more are left out early.
    """
    none = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    best, owners = [none for _ in range(0, n, _QUERIES)], [none]
    last = np.full(n, -1.0)  # the k-th best prob of each query so far
    cuts, size = [0] if n and m else [], max(1, at_once // 16)
    while cuts and cuts[-1] < m:
        cuts.append(min(cuts[-1] + size, m))
        size = min(4 * size, at_once)
    asked = [_words_of(x) for x in left]
    for lo, hi in zip(cuts, cuts[1:]):
        columns = [_Column(x, y.slice(lo, hi - lo), n, hi - lo) for x, y in zip(asked, right)]
        for j, first in enumerate(range(0, n, _QUERIES)):
            mine, theirs, prob = _alike(columns, first, min(first + _QUERIES, n), share, last, owned)
            sure = np.flatnonzero(prob >= owned)
            owners.append(_leaders(mine[sure], theirs[sure] + lo, prob[sure]))
            kept = np.flatnonzero(prob > last[mine])  # the smaller id comes first and stays
            mine, theirs, prob = (np.concatenate([a, b]) for a, b in zip(best[j], (mine[kept], theirs[kept] + lo, prob[kept])))
            order = np.argsort((mine - first) * 2_000_001 - np.rint(prob * 1e6).astype(np.int64), kind="stable")
            many = np.bincount(mine - first, minlength=_QUERIES)
            place = np.arange(len(mine)) - np.repeat(np.cumsum(many) - many, many)
            full = order[place == k - 1]
            last[mine[full]] = prob[full]
            best[j] = tuple(a[order[place < k]] for a in (mine, theirs, prob))
    led = _leaders(*(np.concatenate(c) for c in zip(*owners)))
    rows_a, rows_b, probs = (np.concatenate(c) for c in zip(none, *best, led))
    return rows_a, rows_b, probs, np.arange(len(probs)) >= len(probs) - len(led[0])


def _leaders(mine: np.ndarray, theirs: np.ndarray, prob: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each record the most probable query, of equal ones the first."""
    order = np.lexsort((mine, -prob, theirs))
    order = order[np.diff(theirs[order], prepend=-1) > 0]
    return mine[order], theirs[order], prob[order]


def _alike(columns: list[_Column], lo: int, hi: int, share: tuple[int, int], last: np.ndarray, owned: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, record, prob) of the similar pairs of the queries from lo to hi, by query and record.

    Of the pairs that share words in one column only, whose prob is that
    column's similarity divided by the number of columns, those whose prob
    isn't above ``last`` and not ``owned`` may be missing.
    """
    shared, reached = zip(*(c.count(lo, hi) for c in columns))
    m = shared[0].shape[1]
    near = np.zeros((hi - lo) * m + -(hi - lo) * m % 8, bool)
    held, seen, several = np.empty((3, m), bool)
    levels = [x + len(columns) * 4e-7 for x in _LEVELS if x * share[1] >= share[0] and x < len(columns) * owned]
    bounds = [share, *levels]
    level = np.searchsorted(levels, len(columns) * (last[lo:hi] + 4e-7) + 1e-12, "right").tolist()
    for i, row in enumerate(near[: (hi - lo) * m].reshape(hi - lo, m)):
        # a query whose words of a column are all rare reaches few records by it: these are looked at one by one
        wide = [(c, counts[i]) for c, counts in zip(columns, shared) if c.dense[lo + i]]
        for k, (c, counts) in enumerate(wide):
            np.greater_equal(counts, c.needed(lo + i, bounds[level[i]]), out=held if k else row)
            if k:
                row |= held
        if level[i] and len(wide) > 1:
            several[:] = False
            np.greater(wide[0][1], 0, out=seen)
            for _, counts in wide[1:]:
                np.greater(counts, 0, out=held)
                several |= seen & held
                seen |= held
            seen[:] = False
            for c, counts in wide:
                seen |= np.greater_equal(counts, c.needed(lo + i, share), out=held)
            several &= seen
            row |= several
    for places in reached:
        near[places] = True
    # few are similar: eight marks are one number
    eights = np.flatnonzero(near.view(np.uint64) != 0)
    which, place = np.nonzero(near.reshape(-1, 8)[eights])
    at = eights[which] * 8 + place
    mine = at // m
    theirs = at - mine * m
    common = [counts.reshape(-1)[at].astype(np.int64) for counts in shared]
    both = [c.theirs[theirs] + c.mine[mine + lo] for c in columns]
    alike = np.flatnonzero(np.any([(x > 0) & (sum(share) * x >= share[0] * y) for x, y in zip(common, both)], axis=0))
    prob = 0.0
    for x, y in zip(common, both):
        prob = prob + 1 / len(columns) * (x[alike] / np.maximum(y[alike] - x[alike], 1))
    return mine[alike] + lo, theirs[alike], np.floor(prob * 1e6 + 0.5) / 1e6


def sparse_cosine(pairs: DataFrame, queries: DataFrame, postings: DataFrame, block: list[str]) -> DataFrame:
    """Cosine of given pairs (block, s1_id, rec_id), 0 where no term is shared."""
    scored = pairs.select(*block, "s1_id", "rec_id").join(queries.withColumnRenamed("weight", "wq"), [*block, "s1_id"])
    scored = scored.join(postings.withColumnRenamed("weight", "wd"), [*block, "rec_id", "term"])
    scored = scored.groupBy(*block, "s1_id", "rec_id").agg(F.round(F.sum(F.col("wq") * F.col("wd")), 6).alias("cos"))
    return pairs.join(scored, [*block, "s1_id", "rec_id"], "left").fillna(0.0, ["cos"])


def key_join(s1: DataFrame, pool: DataFrame, key: str, cap: int = 50) -> DataFrame:
    """country, src, s1_id, rec_id of equal keys that aren't empty, for keys of at most ``cap`` pool records of a source."""
    block = ["country", "src", key]
    few = pool.where(F.col(key) != "").groupBy(*block).agg(F.count("*").alias("__n")).where(F.col("__n") <= cap).select(*block)
    # at most ``cap`` records stand against each part of the queries of a key
    rare = pool.join(few, block, "left_semi").select(*block, "rec_id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__salt"))
    asked = s1.where(F.col(key) != "").select("country", key, "s1_id", F.pmod(F.xxhash64("s1_id"), F.lit(SALTS)).cast("int").alias("__salt"))
    return asked.join(rare, ["country", key, "__salt"]).select("country", "src", "s1_id", "rec_id")


def fuse(views: DataFrame | None, names: tuple[str, ...], flags: dict[str, DataFrame], keep: int = 45) -> DataFrame:
    """Reciprocal-rank fusion: one row a pair with rank and score of each view, flags of each key, n_views and rrf; the best ``keep`` of each query (0: all).

    ``views``: the rows of ``sparse_views`` for the views ``names``. Views and
    flags are stacked and aggregated once, instead of joined one by one.
    """
    pair = ["country", "src", "s1_id", "rec_id"]
    parts = [views.select(*pair, "view", F.col("rank").cast("double").alias("rank"), "score")] if views is not None else []
    parts += [f.select(*pair, F.lit(name).alias("view"), F.lit(None).cast("double").alias("rank"), F.lit(None).cast("double").alias("score")) for name, f in flags.items()]
    stacked = parts[0]
    for p in parts[1:]:
        stacked = stacked.unionByName(p)
    aggs = []
    for name in names:
        of = F.col("view") == name
        aggs += [F.coalesce(F.min(F.when(of, F.col("rank"))), F.lit(MISSING_RANK)).alias(f"rank_{name}"), F.coalesce(F.max(F.when(of, F.col("score"))), F.lit(0.0)).alias(f"sc_{name}")]
    aggs += [F.max(F.when(F.col("view") == name, 1).otherwise(0)).cast("long").alias(f"in_{name}") for name in flags]
    out = stacked.groupBy(*pair).agg(*aggs)
    rrf = sum((F.lit(1.0) / (RRF_K + F.col(f"rank_{v}")) for v in names), F.lit(0.0)) + sum((FLAG_GAIN * F.col(f"in_{f}") for f in flags), F.lit(0.0))
    found = sum(((F.col(f"rank_{v}") < MISSING_RANK).cast("long") for v in names), F.lit(0))
    out = out.withColumn("n_views", found.cast("long")).withColumn("rrf", F.round(rrf, 6))
    return best(out, "rrf", keep) if keep else out


def best(pairs: DataFrame, score: str, keep: int) -> DataFrame:
    """The best ``keep`` pairs of each query and source."""
    return top_k(pairs, ["country", "src", "s1_id"], keep, ["rec_id"], score, "__rank").drop("__rank")


def unite(lexical: DataFrame, dense: DataFrame, keep: int = 60) -> DataFrame:
    """Full union of lexical and dense candidates with fused = rrf + 1 / (60 + dense rank); absent ranks are 1e6, other absent values 0."""
    pair = ["country", "src", "s1_id", "rec_id"]
    d = dense.select(*pair, F.col("rank").cast("double").alias("rank_dense"), F.col("score").alias("cos_dense"))
    both = lexical.join(d, pair, "full")
    ranks = {c: MISSING_RANK for c in both.columns if c.startswith("rank_")}
    both = both.fillna(ranks).fillna(0)
    both = both.withColumn("fused", F.round(F.col("rrf") + 1.0 / (RRF_K + F.col("rank_dense")), 6))
    return best(both, "fused", keep) if keep else both


def _dealt(queries: DataFrame, pool: DataFrame, block: list[str], query_id: str, doc_id: str, query_rows: int, pool_rows: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with __q and __d, the numbers of a query block and a pool block of a block: each row once for every block of the other side."""

    def blocks(df: DataFrame, own_id: str, rows: int, own: str) -> tuple[DataFrame, DataFrame]:
        sizes = df.groupBy(*block).agg(F.ceil(F.count("*") / rows).cast("int").alias("__m"))
        return df.join(F.broadcast(sizes), block).withColumn(own, F.pmod(F.xxhash64(own_id), F.col("__m")).cast("int")).drop("__m"), sizes

    (q, many_q), (d, many_d) = blocks(queries, query_id, query_rows, "__q"), blocks(pool, doc_id, pool_rows, "__d")
    every = F.explode(F.sequence(F.lit(0), F.col("__m") - 1))
    # rows of one block key stay where they are: the sizes are one row a key
    q, d = q.join(F.broadcast(many_d), block).withColumn("__d", every).drop("__m"), d.join(F.broadcast(many_q), block).withColumn("__q", every).drop("__m")
    # new names of the same: the sides may come from one table
    return tuple(x.select(*(F.col(c).alias(c) for c in x.columns)) for x in (q, d))


def dense_top_k(queries: DataFrame, pool: DataFrame, k: int, query_id: str = "s1_id", doc_id: str = "rec_id", block: list[str] | None = None, vector: str = "vector", block_rows: int = 8192) -> DataFrame:
    """The k pool vectors of largest inner product of every query: block, query, doc, score, rank.

    Both sides are cut into blocks of ``block_rows`` vectors, and each pair of
    blocks is one matrix product that returns at most k rows a query; a final
    window merges them. No side is broadcast, whatever its size; each vector
    is shuffled once for every block of the other side, the price of an exact
    search.
    """
    if not block:
        one = F.lit(0).alias("__all")
        return dense_top_k(queries.select("*", one), pool.select("*", one), k, query_id, doc_id, ["__all"], vector, block_rows).drop("__all")

    q, d = _dealt(queries.select(*block, query_id, F.col(query_id).alias("id"), F.col(vector).alias("v")), pool.select(*block, doc_id, F.col(doc_id).alias("id"), F.col(vector).alias("v")), block, query_id, doc_id, block_rows, block_rows)
    q, d = (x.select(*block, "__q", "__d", "id", "v") for x in (q, d))
    kinds = {f.name: f.dataType.simpleString() for f in queries.select(*block, query_id).schema.fields} | {doc_id: pool.schema[doc_id].dataType.simpleString()}
    schema = ", ".join(f"{n} {kinds[n]}" for n in [*block, query_id, doc_id]) + ", score double"

    def product(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({n: pa.array([], left.schema.field(n).type if n in block else (left if n == query_id else right).schema.field("id").type) for n in [*block, query_id, doc_id]} | {"score": pa.array([], pa.float64())})
        a, b = (_matrix(t.column("v")) for t in (left, right))
        right_ids = right.column("id").to_pylist()
        order = sorted(range(len(right_ids)), key=lambda i: right_ids[i])  # ties go to the smallest id
        scores = np.round(a @ b[order].T, 6) + 0.0
        top = np.argsort(-scores, axis=1, kind="stable")[:, :k]
        rows = np.repeat(np.arange(len(a)), top.shape[1])
        take = pa.array(np.array(order)[top].ravel())
        out = {n: left.column(n).combine_chunks().take(pa.array(rows)) for n in block}
        out |= {query_id: left.column("id").combine_chunks().take(pa.array(rows)), doc_id: right.column("id").combine_chunks().take(take)}
        return pa.table(out | {"score": pa.array(np.take_along_axis(scores, top, 1).ravel())})

    keys = [*block, "__q", "__d"]
    found = q.groupBy(*keys).cogroup(d.groupBy(*keys)).applyInArrow(product, schema)
    return top_k(found, [*block, query_id], k, [doc_id])


def _matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as the rows of a matrix, without Python lists."""
    one = vectors.combine_chunks()
    return one.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(one), -1)


def pair_cosine(pairs: DataFrame, left: DataFrame, right: DataFrame, a: str, b: str, vector: str = "vector") -> DataFrame:
    """``pairs`` with the inner product of the two records' vectors (-1 where one is missing)."""
    x = left.select(F.col(a), F.col(vector).alias("__a"))
    y = right.select(F.col(b), F.col(vector).alias("__b"))
    return pairs.join(x, a, "left").join(y, b, "left").withColumn("cos", F.coalesce(F.round(dot(F.col("__a"), F.col("__b")), 6), F.lit(-1.0))).drop("__a", "__b")


def hard_negatives(pairs: DataFrame, label: str, score: str = "rrf", wrong: int = 2) -> DataFrame:
    """By S1 row: its true records and the ``wrong`` best-ranked false ones."""
    bad = top_k(pairs.where(F.col(label) == 0), ["country", "s1_id"], wrong, ["rec_id"], score, "__rank").drop("__rank")
    both = pairs.where(F.col(label) == 1).unionByName(bad)
    ids = lambda y: F.array_join(F.array_sort(F.collect_list(F.when(F.col(label) == y, F.col("rec_id")))), ",")
    return both.groupBy("country", "s1_id").agg(ids(1).alias("positives"), ids(0).alias("negatives"))

