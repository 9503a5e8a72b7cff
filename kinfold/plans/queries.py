"""Registered linkage queries with their SQL: normalisation, blocking, features."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.functions import similarity as sim
from kinfold.functions import strings
from kinfold.functions.normalize import alias_rewrite, first_number, has_alias_marker, has_native, pair_text, slug
from kinfold.functions.segment import segment_key, vocabulary
from kinfold.operators import aliases, blocking, compete, decide, evaluate, refine, sampling, sibling, validate
from kinfold.plans import fixtures as x
from kinfold.plans.fixtures import SCORED_SQL, jaccard_sql, normed_sql, words_sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with SQL where SQL can express it."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


# --- normalisation -----------------------------------------------------------------------


@query(f"WITH {normed_sql('probed')} SELECT entity_id, name_lat, name_core, legal FROM normed")
def norm_name_core(spark, sf):
    return x.normed(spark, sf, True).select("entity_id", "name_lat", "name_core", "legal")


@query(f"WITH {normed_sql('probed')} SELECT entity_id, name_key FROM normed")
def name_key(spark, sf):
    return x.normed(spark, sf, True).select("entity_id", "name_key")


@query(f"WITH {normed_sql('probed')} SELECT entity_id, name_skel FROM normed")
def phonetic_skeleton(spark, sf):
    return x.normed(spark, sf, True).select("entity_id", "name_skel")


@query(f"WITH {normed_sql('probed')} SELECT entity_id, addr_norm, nums, CAST(addr_missing AS INTEGER) AS addr_missing FROM normed")
def addr_tokens_nums(spark, sf):
    return x.normed(spark, sf, True).select("entity_id", "addr_norm", "nums", "addr_missing")


@query(
    rf"""WITH {normed_sql("probed")} SELECT entity_id, regexp_matches(business_name, '[^\x00-\x{{24F}}]') AS native, nums,
  coalesce(TRY_CAST(string_split(nums, ' ')[1] AS DOUBLE), -1.0) AS first_num,
  regexp_matches(business_name, '(?i)\b(?:f/?k/?a|formerly|d/?b/?a|doing business as|trading as|t/a|a/?k/?a|also known as)\b') AS alias_marker,
  regexp_replace(business_name, '[^A-Za-z0-9]', '_', 'g') AS slug, 'query: ' || business_name || ' | ' || business_address AS pair_text FROM normed"""
)
def scalar_marks(spark, sf):
    n, a = F.col("business_name"), F.col("business_address")
    return x.normed(spark, sf, True).select("entity_id", has_native(n).alias("native"), "nums", first_number(F.col("nums")).alias("first_num"), has_alias_marker(n).alias("alias_marker"), slug(n).alias("slug"), pair_text(n, a, True).alias("pair_text"))


_ALIASES = {"the of": "thof", "and": "et", "in": "dans"}


@query(
    f"""WITH RECURSIVE {normed_sql()}, t AS (SELECT entity_id, string_split(addr_norm, ' ') AS w FROM normed),
step AS (SELECT entity_id, w, 1 AS i, []::VARCHAR[] AS out FROM t UNION ALL
  SELECT entity_id, w, CASE WHEN w[i] || ' ' || w[i + 1] = 'the of' THEN i + 2 ELSE i + 1 END,
    list_append(out, CASE WHEN w[i] || ' ' || w[i + 1] = 'the of' THEN 'thof' WHEN w[i] = 'and' THEN 'et' WHEN w[i] = 'in' THEN 'dans' ELSE w[i] END)
  FROM step WHERE i <= len(w))
SELECT entity_id, array_to_string(out, ' ') AS rewritten FROM step WHERE i > len(w)"""
)
def alias_rewriting(spark, sf):
    w = F.split("addr_norm", " ")
    return x.normed(spark, sf).select("entity_id", F.array_join(alias_rewrite(w, _ALIASES), " ").alias("rewritten"))


@query(
    f"WITH {x.RECORDS_SQL}, w AS (SELECT unnest(list_filter(regexp_extract_all(lower(business_name), '[a-z]+'), lambda w: length(w) >= 3)) AS word FROM records WHERE src = 1) SELECT word, count(*) AS n FROM w GROUP BY word HAVING count(*) >= 3"
)
def vocab_counts(spark, sf):
    return vocabulary(x.records(spark, sf).where("src = 1"), min_count=3)


@query(
    f"""WITH {normed_sql()}, v AS (SELECT unnest(list_filter(regexp_extract_all(lower(business_name), '[a-z]+'), lambda w: length(w) >= 3)) AS word FROM s1),
vc AS (SELECT word, count(*) AS n FROM v GROUP BY word), w AS (SELECT entity_id, unnest(list_filter(string_split(name_core, ' '), lambda w: w <> '')) AS word FROM normed),
s AS (SELECT entity_id, round(avg(CASE WHEN coalesce(n, 0) < 3 THEN 1.0 ELSE 0.0 END), 6) AS oov FROM w LEFT JOIN vc USING (word) GROUP BY entity_id)
SELECT normed.entity_id, coalesce(oov, 0.0) AS oov FROM normed LEFT JOIN s USING (entity_id)"""
)
def oov_share(spark, sf):
    n = x.normed(spark, sf)
    return refine.oov_share(n, vocabulary(n.where("src = 1"), min_count=1), ["entity_id"], "name_core")


@query(f"WITH {normed_sql()} SELECT entity_id, array_to_string(list_sort({words_sql('name_lat')}), ' ') AS seg_key FROM normed")
def segment_keys(spark, sf):
    return x.normed(spark, sf).select("entity_id", segment_key(F.col("name_lat")).alias("seg_key"))


# --- blocking ----------------------------------------------------------------------------


@query(
    f"WITH {normed_sql()}, t AS (SELECT DISTINCT country, src, rec_id, unnest({words_sql('addr_norm')}) AS term FROM pool) SELECT country, src, term, count(*) AS df FROM t JOIN (SELECT country, src, count(*) AS n FROM pool GROUP BY ALL) USING (country, src) GROUP BY country, src, term, n HAVING count(*) <= greatest(50, floor(0.0015 * n))"
)
def term_df(spark, sf):
    _, pool = x.sides(x.normed(spark, sf))
    counts = blocking.term_counts(pool, blocking.word_terms(F.col("addr_norm")), ["country", "src", "rec_id"])
    n = pool.groupBy("country", "src").agg(F.count("*").alias("n"))
    terms, _ = blocking.index(counts, n, ["country", "src"], ["rec_id"], F.greatest(F.lit(50), F.floor(F.lit(0.0015) * F.col("n"))))
    return terms.select("country", "src", "term", "df")


def _tfidf_sql(terms: str, k: int, final: str) -> str:
    return f"""WITH {normed_sql()},
pt AS (SELECT country, src, rec_id, unnest({terms}) AS term FROM pool), pc AS (SELECT country, src, rec_id, term, count(*) AS tf FROM pt GROUP BY ALL),
nn AS (SELECT country, src, count(*) AS n FROM pool GROUP BY ALL),
df AS (SELECT country, src, term, count(*) AS df FROM pc JOIN nn USING (country, src) GROUP BY country, src, term, n HAVING count(*) <= greatest(50, floor(0.0015 * n))), idf AS (SELECT df.*, ln((1 + n) / (1.0 + df)) + 1 AS idf FROM df JOIN nn USING (country, src)),
pw AS (SELECT country, src, rec_id, term, (1 + ln(tf)) * idf AS w FROM pc JOIN idf USING (country, src, term)),
pn AS (SELECT country, src, rec_id, sqrt(sum(w * w)) AS norm FROM pw GROUP BY ALL),
qt AS (SELECT country, s1_id, unnest({terms}) AS term FROM s1), qc AS (SELECT country, s1_id, term, count(*) AS tf FROM qt GROUP BY ALL),
qw AS (SELECT country, src, s1_id, term, (1 + ln(tf)) * idf AS w FROM qc JOIN idf USING (country, term)),
qn AS (SELECT country, src, s1_id, sqrt(sum(w * w)) AS norm FROM qw GROUP BY ALL),
sc AS (SELECT qw.country, qw.src, qw.s1_id, pw.rec_id, round(sum(qw.w / qn.norm * (pw.w / pn.norm)), 6) AS score FROM qw JOIN qn USING (country, src, s1_id)
  JOIN pw ON pw.country = qw.country AND pw.src = qw.src AND pw.term = qw.term JOIN pn ON pn.country = pw.country AND pn.src = pw.src AND pn.rec_id = pw.rec_id GROUP BY ALL),
topk AS (SELECT *, row_number() OVER (PARTITION BY country, src, s1_id ORDER BY score DESC, rec_id) AS rank FROM sc QUALIFY rank <= {k})
{final}"""


_WORDS_ALL = "list_filter(string_split({}, ' '), lambda w: w <> '')"
_ADDR_12 = f"list_concat({_WORDS_ALL.format('addr_norm')}, list_transform(range(1, len({_WORDS_ALL.format('addr_norm')})), lambda i: ({_WORDS_ALL.format('addr_norm')})[i] || ' ' || ({_WORDS_ALL.format('addr_norm')})[i + 1]))"
_CHARS = f"flatten(list_transform({_WORDS_ALL.format('name_core')}, lambda w: list_concat(list_transform(range(1, greatest(length(w) + 1, 1)), lambda i: substr(' ' || w || ' ', i, 3)), list_transform(range(1, greatest(length(w), 1)), lambda i: substr(' ' || w || ' ', i, 4)))))"
_ALL = "SELECT country, src, s1_id, rec_id, score, rank FROM topk"


@query(_tfidf_sql(_ADDR_12, 25, _ALL))
def tfidf_topk_word(spark, sf):
    s1, pool = x.sides(x.normed(spark, sf))
    return blocking.tfidf_top_k(s1, pool, blocking.word_terms(F.col("addr_norm"), 2), 25).withColumn("rank", F.col("rank").cast("long"))


@query(_tfidf_sql(_CHARS, 25, _ALL))
def tfidf_topk_char(spark, sf):
    s1, pool = x.sides(x.normed(spark, sf))
    return blocking.tfidf_top_k(s1, pool, blocking.char_terms(F.col("name_core")), 25).withColumn("rank", F.col("rank").cast("long"))


@query(_tfidf_sql(_CHARS.replace("name_core", "addr_norm"), 25, _ALL))
def tfidf_topk_addr_char(spark, sf):
    s1, pool = x.sides(x.normed(spark, sf))
    return blocking.tfidf_top_k(s1, pool, blocking.char_terms(F.col("addr_norm")), 25).withColumn("rank", F.col("rank").cast("long"))


@query(_tfidf_sql(_ADDR_12, 1, "SELECT country, src, rec_id, s1_id, score, row_number() OVER (PARTITION BY country, src, rec_id ORDER BY score DESC, s1_id) AS rank FROM sc QUALIFY rank <= 25"))
def reverse_topk(spark, sf):
    s1, pool = x.sides(x.normed(spark, sf))
    return blocking.reverse_top_k(s1, pool, blocking.word_terms(F.col("addr_norm"), 2), 25).withColumn("rank", F.col("rank").cast("long"))


_KEYS = "SELECT b.country, b.src, a.s1_id, b.rec_id FROM s1 a JOIN pool b ON a.country = b.country AND a.{k} = b.{k} WHERE b.{k} <> '' AND (SELECT count(*) FROM pool c WHERE c.country = b.country AND c.src = b.src AND c.{k} = b.{k}) <= 50"


@query(f"WITH {normed_sql()} {_KEYS.format(k='name_key')}")
def key_join_capped(spark, sf):
    s1, pool = x.sides(x.normed(spark, sf))
    return blocking.key_join(s1, pool, "name_key")


def _fused(spark, sf, keep=45):
    s1, pool = x.sides(x.normed(spark, sf))
    views = blocking.sparse_views(s1, pool, {"addr": blocking.word_terms(F.col("addr_norm"), 2), "name": blocking.word_terms(F.col("name_core"))}, 25)
    flags = {"key": blocking.key_join(s1, pool, "name_key"), "skel": blocking.key_join(s1, pool, "name_skel")}
    return blocking.fuse(views, ("addr", "name"), flags, keep)


def _fused_ctes() -> str:
    base = _tfidf_sql(_ADDR_12, 25, "").strip()
    name = _tfidf_sql(_WORDS_ALL.format("name_core"), 25, "").split("pt AS", 1)[1]
    name = "pt AS" + name
    for cte in ("pt", "pc", "nn", "df", "idf", "pw", "pn", "qt", "qc", "qw", "qn", "sc", "topk"):
        import re

        name = re.sub(rf"\b{cte}\b(?= AS \(| USING|\.|,| JOIN| GROUP| ON| QUALIFY|\)| WHERE)", f"{cte}_n", name)
        name = re.sub(rf"(FROM|JOIN) {cte}\b", rf"\1 {cte}_n", name)
    name = name.replace("count(*) AS df_n", "count(*) AS df").replace("0.0015 * n_n", "0.0015 * n").replace("(1.0 + df_n)", "(1.0 + df)").replace("* idf_n AS w", "* idf AS w").replace("+ 1 AS idf_n", "+ 1 AS idf")
    return f"""{base}, {name.strip()},
ik AS ({_KEYS.format(k="name_key")}), isk AS ({_KEYS.format(k="name_skel")}),
long AS (SELECT country, src, s1_id, rec_id, rank AS ra, score AS sa, NULL AS rn, NULL AS sn, 0 AS k, 0 AS s FROM topk UNION ALL SELECT country, src, s1_id, rec_id, NULL, NULL, rank, score, 0, 0 FROM topk_n
  UNION ALL SELECT country, src, s1_id, rec_id, NULL, NULL, NULL, NULL, 1, 0 FROM ik UNION ALL SELECT country, src, s1_id, rec_id, NULL, NULL, NULL, NULL, 0, 1 FROM isk),
wide AS (SELECT country, src, s1_id, rec_id, coalesce(min(ra), 1e6)::DOUBLE AS rank_addr, coalesce(max(sa), 0.0) AS sc_addr, coalesce(min(rn), 1e6)::DOUBLE AS rank_name, coalesce(max(sn), 0.0) AS sc_name, max(k)::BIGINT AS in_key, max(s)::BIGINT AS in_skel FROM long GROUP BY ALL),
lex AS (SELECT *, ((rank_addr < 1e6)::INT + (rank_name < 1e6)::INT)::BIGINT AS n_views, round(1.0 / (60 + rank_addr) + 1.0 / (60 + rank_name) + (0.01 * in_key + 0.01 * in_skel), 6) AS rrf FROM wide)"""


_FUSED_SQL = _fused_ctes()


@query(f"{_FUSED_SQL} SELECT * FROM lex QUALIFY row_number() OVER (PARTITION BY country, src, s1_id ORDER BY rrf DESC, rec_id) <= 45")
def rrf_union(spark, sf):
    return _fused(spark, sf)


_DENSE_SQL = """v AS (SELECT vec_id, embedding, label FROM embeddings), q AS (SELECT * FROM v WHERE vec_id % 3 = 0), d AS (SELECT * FROM v WHERE vec_id % 3 <> 0),
p AS (SELECT q.vec_id AS s1_id, d.vec_id AS rec_id, round(list_sum(list_transform(range(1, len(q.embedding) + 1), lambda i: q.embedding[i]::DOUBLE * d.embedding[i]::DOUBLE)), 6) AS score FROM q, d)"""


def _vectors(spark, sf):
    v = x.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vector"), "label")
    return v.where("vec_id % 3 = 0").withColumnRenamed("vec_id", "s1_id"), v.where("vec_id % 3 <> 0").withColumnRenamed("vec_id", "rec_id")


@query(f"WITH {_DENSE_SQL} SELECT s1_id, rec_id, score, row_number() OVER (PARTITION BY s1_id ORDER BY score DESC, rec_id) AS rank FROM p QUALIFY rank <= 10")
def dense_topk(spark, sf):
    q, d = _vectors(spark, sf)
    return blocking.dense_top_k(q, d, 10).withColumn("rank", F.col("rank").cast("long"))


@query(f"WITH {_DENSE_SQL} SELECT q.vec_id AS s1_id, d.vec_id AS rec_id, p.score AS cos FROM q JOIN d ON d.vec_id = q.vec_id + 1 JOIN p ON p.s1_id = q.vec_id AND p.rec_id = d.vec_id")
def pair_cosine(spark, sf):
    q, d = _vectors(spark, sf)
    pairs = q.select("s1_id", (F.col("s1_id") + 1).alias("rec_id")).join(d.select("rec_id"), "rec_id", "left_semi")
    return blocking.pair_cosine(pairs, q, d, "s1_id", "rec_id").select("s1_id", "rec_id", "cos")


_LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789"
_HISTOGRAM = f"list_transform(string_split('{_LETTERS}', ''), lambda c: length(name_core) - length(replace(name_core, c, '')))"


def _histogram(df):
    """Counts of each letter and digit in the name, at length 1: a dense view that SQL can follow."""
    n = F.col("name_core")
    return df.withColumn("vector", sim.unit(F.array(*(F.length(n) - F.length(F.replace(n, F.lit(c), F.lit(""))) for c in _LETTERS))))


_UNION_SQL = f"""{_FUSED_SQL}, lexk AS (SELECT * FROM lex QUALIFY row_number() OVER (PARTITION BY country, src, s1_id ORDER BY rrf DESC, rec_id) <= 45),
hv AS (SELECT *, {_HISTOGRAM} AS h FROM (SELECT s1_id AS id, country, 1 AS src, name_core FROM s1 UNION ALL SELECT rec_id, country, src, name_core FROM pool)),
hu AS (SELECT id, country, src, list_transform(h, lambda v: CASE WHEN list_sum(list_transform(h, lambda y: y * y)) > 0 THEN v / sqrt(list_sum(list_transform(h, lambda y: y * y))::DOUBLE) ELSE 0.0 END) AS u FROM hv),
dp AS (SELECT a.country, b.src, a.id AS s1_id, b.id AS rec_id, round(list_dot_product(a.u, b.u), 6) AS score FROM hu a JOIN hu b ON a.country = b.country AND a.src = 1 AND b.src > 1),
dns AS (SELECT *, row_number() OVER (PARTITION BY country, src, s1_id ORDER BY score DESC, rec_id) AS rank FROM dp QUALIFY rank <= 25),
un AS (SELECT country, src, s1_id, rec_id, coalesce(rank_addr, 1e6) AS rank_addr, coalesce(sc_addr, 0) AS sc_addr, coalesce(rrf, 0) AS rrf, coalesce(rank::DOUBLE, 1e6) AS rank_dense, coalesce(score, 0) AS cos_dense FROM lexk FULL JOIN dns USING (country, src, s1_id, rec_id)),
fu AS (SELECT *, round(rrf + 1.0 / (60 + rank_dense), 6) AS fused FROM un)
SELECT * FROM fu QUALIFY row_number() OVER (PARTITION BY country, src, s1_id ORDER BY fused DESC, rec_id) <= 60"""


@query(_UNION_SQL)
def lex_dense_union(spark, sf):
    """Lexical views and an exact dense one, united."""
    s1, pool = x.sides(x.normed(spark, sf))
    asked = _histogram(s1).withColumn("src", F.explode(F.array(F.lit(2).cast("long"), F.lit(3).cast("long"))))
    dense = blocking.dense_top_k(asked, _histogram(pool), 25, block=["country", "src"])
    out = blocking.unite(_fused(spark, sf), dense, 60)
    return out.select("country", "src", "s1_id", "rec_id", "rank_addr", "sc_addr", "rrf", "rank_dense", "cos_dense", "fused")


@query(
    f"""WITH {SCORED_SQL}, m AS (SELECT *, CASE WHEN prob >= 0.5 THEN 1 ELSE 0 END AS y FROM scored),
b AS (SELECT * FROM m WHERE y = 0 QUALIFY row_number() OVER (PARTITION BY country, s1_id ORDER BY prob DESC, rec_id) <= 2), u AS (SELECT country, s1_id, rec_id, y FROM b UNION ALL SELECT country, s1_id, rec_id, y FROM m WHERE y = 1)
SELECT country, s1_id, coalesce(string_agg(CASE WHEN y = 1 THEN rec_id END, ',' ORDER BY rec_id), '') AS positives, coalesce(string_agg(CASE WHEN y = 0 THEN rec_id END, ',' ORDER BY rec_id), '') AS negatives FROM u GROUP BY ALL"""
)
def hard_negatives(spark, sf):
    pairs = x.pairs(spark, sf).withColumn("y", (F.col("prob") >= 0.5).cast("int"))
    return blocking.hard_negatives(pairs, "y", "prob")


# --- pair features -----------------------------------------------------------------------

_PAIR = ["country", "src", "s1_id", "rec_id"]
_IDS = ", ".join(_PAIR)


def _overlap_sql(a: str, b: str, p: str, symmetric: bool = False) -> str:
    u, v = words_sql(a), words_sql(b)
    some = f"({a} <> '' AND {b} <> '')"
    inter = f"len(list_intersect({u}, {v}))"
    ea, eb = (f"len(list_filter({m}, lambda w: NOT list_contains({n}, w)))" for m, n in ((u, v), (v, u)))
    out = f"CASE WHEN {some} THEN {inter} ELSE 0 END::BIGINT AS {p}_inter, round({jaccard_sql(a, b)}, 6) AS {p}_jac, CASE WHEN {some} THEN round({inter}::DOUBLE / least(len({u}), len({v})), 6) ELSE -1.0 END AS {p}_contain"
    if symmetric:
        return f"{out}, CASE WHEN {some} THEN {ea} + {eb} ELSE 0 END::BIGINT AS {p}_extra"
    return f"{out}, CASE WHEN {some} THEN {ea} ELSE 0 END::BIGINT AS {p}_extra_a, CASE WHEN {some} THEN {eb} ELSE 0 END::BIGINT AS {p}_extra_b"


@query(f"WITH {SCORED_SQL} SELECT {_IDS}, {_overlap_sql('s1_name_core', 'rec_name_core', 'tok')}, {_overlap_sql('s1_addr_norm', 'rec_addr_norm', 'adr', True)} FROM scored")
def token_set_features(spark, sf):
    w = lambda c: sim.words(F.col(c))
    cols = sim.overlap(w("s1_name_core"), w("rec_name_core"), "tok") | sim.overlap(w("s1_addr_norm"), w("rec_addr_norm"), "adr", True)
    return x.scored(spark, sf).select(*_PAIR, *(c.alias(n) for n, c in cols.items()))


_AFTER_NORMED = SCORED_SQL.removeprefix(normed_sql()).lstrip(",\n ")
_A, _B = words_sql("s1_name_core"), words_sql("rec_name_core")
_BOTH = f"len(list_intersect({_A}, {_B}))"


@query(
    f"""WITH {SCORED_SQL} SELECT {_IDS}, (len({_A}) > 0 AND {_BOTH} = len({_A}) AND len({_A}) < len({_B}))::BIGINT AS core_sub, (len({_B}) > 0 AND {_BOTH} = len({_B}) AND len({_B}) < len({_A}))::BIGINT AS core_sup,
  {_BOTH}::BIGINT AS core_common, len({_A})::BIGINT AS ntok_a, len({_B})::BIGINT AS ntok_b FROM scored"""
)
def subset_flags(spark, sf):
    cols = sim.subset_flags(sim.words(F.col("s1_name_core")), sim.words(F.col("rec_name_core")))
    return x.scored(spark, sf).select(*_PAIR, *(c.alias(n) for n, c in cols.items()))


@query(_tfidf_sql(_ADDR_12, 1, f", {_AFTER_NORMED} SELECT p.country, p.src, p.s1_id, p.rec_id, coalesce(sc.score, 0.0) AS cos FROM scored p LEFT JOIN sc USING (country, src, s1_id, rec_id)"))
def sparse_pair_cosine(spark, sf):
    """The sparse cosine of given pairs, whether the view retrieved them or not."""
    s1, pool = x.sides(x.normed(spark, sf))
    queries, postings, _ = blocking.sparse_pairs(s1, pool, {"addr": blocking.word_terms(F.col("addr_norm"), 2)})
    pairs = x.pairs(spark, sf).select(*_PAIR).withColumn("view", F.lit("addr"))
    return blocking.sparse_cosine(pairs, queries, postings, ["view", "country", "src"]).select(*_PAIR, "cos")


_NUM_SQL = f"d AS (SELECT {_IDS}, {words_sql('s1_nums')} AS a, {words_sql('rec_nums')} AS b FROM scored)"
_EACH = "flatten(list_transform({a}, lambda p: list_transform({b}, lambda q: {e})))"


@query(
    f"""WITH {SCORED_SQL}, {_NUM_SQL} SELECT {_IDS}, len(list_intersect(a, b))::BIGINT AS num_inter, CASE WHEN len(a) > 0 AND len(b) > 0 THEN round(len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))), 6) ELSE 0.0 END AS num_jac,
  coalesce(list_min({_EACH.format(a="list_filter(a, lambda w: length(w) >= 2)", b="list_filter(b, lambda w: length(w) >= 2)", e="abs(CAST(p AS HUGEINT) - CAST(q AS HUGEINT))")})::DOUBLE, -1.0) AS num_mindiff,
  coalesce(list_max({_EACH.format(a="list_filter(a, lambda w: length(w) > 1)", b="list_filter(b, lambda w: length(w) > 1)", e="CASE WHEN p <> q AND (ends_with(p, q) OR ends_with(q, p)) THEN 1 ELSE 0 END")}), 0)::BIGINT AS num_sub FROM d"""
)
def number_features(spark, sf):
    cols = sim.number_overlap(F.col("s1_nums"), F.col("rec_nums"))
    return x.beside(spark, sf, nums=sim.words(F.col("nums"))).select(*_PAIR, *(c.alias(n) for n, c in cols.items()))


@query(f"WITH {SCORED_SQL}, {_NUM_SQL} SELECT {_IDS}, coalesce(list_min({_EACH.format(a='a', b='b', e='levenshtein(p, q)')}), -1)::BIGINT AS num_lev FROM d")
def levenshtein_numbers(spark, sf):
    return x.scored(spark, sf).select(*_PAIR, sim.least_edits(sim.words(F.col("s1_nums")), sim.words(F.col("rec_nums"))).alias("num_lev"))


_IDF_SQL = f"""WITH {SCORED_SQL}, nn AS (SELECT country, count(*) AS n FROM pool GROUP BY country), pt AS (SELECT country, rec_id, unnest({words_sql("name_core")}) AS word FROM pool),
idf AS (SELECT country, word, ln((n + 1) / (count(*) + 1.0)) + 1 AS idf FROM pt JOIN nn USING (country) GROUP BY country, word, n),
l AS (SELECT {_IDS}, {words_sql("s1_name_core")} AS a, {words_sql("rec_name_core")} AS b FROM scored WHERE s1_name_core <> '' AND rec_name_core <> ''),
e AS (SELECT {_IDS}, a, b, unnest(list_distinct(list_concat(a, b))) AS word FROM l),
w AS (SELECT e.*, coalesce(idf, ln(n + 1) + 1) AS w, list_contains(a, e.word) AS ia, list_contains(b, e.word) AS ib FROM e JOIN nn ON nn.country = e.country LEFT JOIN idf ON idf.country = e.country AND idf.word = e.word),
s AS (SELECT {_IDS}, round(sum(CASE WHEN ia AND ib THEN w ELSE 0 END) / sum(w), 6) AS a_nm_idf, round(sum(CASE WHEN ia AND NOT ib THEN w ELSE 0 END), 6) AS a_nm_idf_miss FROM w GROUP BY {_IDS})
SELECT {_IDS}, coalesce(a_nm_idf, -1.0) AS a_nm_idf, coalesce(a_nm_idf_miss, 0.0) AS a_nm_idf_miss FROM scored LEFT JOIN s USING ({_IDS})"""


@query(_IDF_SQL)
def idf_jaccard(spark, sf):
    _, pool = x.sides(x.normed(spark, sf))
    return refine.weighted_jaccard(x.scored(spark, sf), pool, "name_core", "s1_name_core", "rec_name_core", "a_nm_idf").select(*_PAIR, "a_nm_idf", "a_nm_idf_miss")


_FIRST = "coalesce(TRY_CAST(string_split({}, ' ')[1] AS DOUBLE), -1.0)"
_EXTRA = "len(list_filter({}, lambda w: NOT list_contains({}, w)))::BIGINT"


@query(
    f"""WITH {SCORED_SQL} SELECT {_IDS}, (s1_legal = rec_legal)::BIGINT AS legal_eq, (s1_legal <> rec_legal AND s1_legal <> '' AND rec_legal <> '')::BIGINT AS legal_conflict,
  CASE WHEN s1_legal = '' OR rec_legal = '' THEN -1 ELSE (s1_legal = rec_legal)::INT END::BIGINT AS a_legal, (s1_name_key = rec_name_key)::BIGINT AS key_eq, (s1_name_skel = rec_name_skel)::BIGINT AS skel_eq,
  CASE WHEN {_FIRST.format("s1_nums")} < 0 OR {_FIRST.format("rec_nums")} < 0 THEN -1 ELSE ({_FIRST.format("s1_nums")} = {_FIRST.format("rec_nums")})::INT END::BIGINT AS a_num,
  {_EXTRA.format(words_sql("rec_name_core"), words_sql("s1_name_core"))} AS a_extra, {_EXTRA.format(words_sql("s1_name_core"), words_sql("rec_name_core"))} AS a_drop,
  round((length(s1_name_lat) + 1.0) / (length(rec_name_lat) + 1.0), 6) AS len_ratio, abs(length(s1_name_lat) - length(rec_name_lat))::BIGINT AS len_absdiff FROM scored"""
)
def legal_flags(spark, sf):
    c = F.col
    la, lb = F.length("s1_name_lat"), F.length("rec_name_lat")
    cols = sim.legal_flags(c("s1_legal"), c("rec_legal")) | sim.agreement(c("s1_name_core"), c("rec_name_core"), c("s1_nums"), c("rec_nums"), c("s1_legal"), c("rec_legal"))
    cols |= {"key_eq": (c("s1_name_key") == c("rec_name_key")).cast("long"), "skel_eq": (c("s1_name_skel") == c("rec_name_skel")).cast("long")}
    cols |= {"len_ratio": F.round((la + 1) / (lb + 1), 6), "len_absdiff": F.abs(la - lb).cast("long")}
    return x.scored(spark, sf).select(*_PAIR, *(v.alias(k) for k, v in cols.items()))


@query(f"WITH {SCORED_SQL} SELECT {_IDS}, round(CASE WHEN s1_name_lat = '' OR rec_name_lat = '' THEN 0.0 ELSE jaro_winkler_similarity(s1_name_lat, rec_name_lat) END, 6) AS name_jw FROM scored")
def jaro_winkler(spark, sf):
    return x.scored(spark, sf).select(*_PAIR, F.round(strings.score("jaro_winkler", F.col("s1_name_lat"), F.col("rec_name_lat")), 6).alias("name_jw"))


_LCS = """list_reduce(list_transform(string_split(a, ''), lambda c: list_transform(range(1, length(b) + 1), lambda j: CASE WHEN contains(substr(b, 1, j), c) THEN j - strpos(reverse(substr(b, 1, j)), c) + 1 ELSE 0 END)),
  lambda prev, last: list_transform(range(1, length(b) + 1), lambda j: greatest(prev[j], CASE WHEN last[j] > 0 THEN coalesce(prev[last[j] - 1], 0) + 1 ELSE 0 END)), list_transform(range(1, length(b) + 1), lambda j: 0::BIGINT))[length(b)]"""


def scores_sql(scores) -> str:
    """CTEs up to ``fuzzy``: ratios, token-sort and token-set ratios of the pairs, from the longest common subsequence of every distinct pair of strings, row by row of its table."""
    sort = lambda c: f"array_to_string(list_sort({_WORDS_ALL.format(c)}), ' ')"
    plain = [f"SELECT {_IDS}, '{n}' AS f, s1_{c} AS a, rec_{c} AS b FROM scored" for n, c, k in scores if k == "ratio"]
    plain += [f"SELECT {_IDS}, '{n}' AS f, {sort(f's1_{c}')} AS a, {sort(f'rec_{c}')} AS b FROM scored" for n, c, k in scores if k == "token_sort"]
    sets = [f"SELECT {_IDS}, '{n}' AS f, {words_sql(f's1_{c}')} AS u, {words_sql(f'rec_{c}')} AS v FROM scored" for n, c, k in scores if k == "token_set"]
    none = [f"SELECT {_IDS}, '' AS f, ['']::VARCHAR[] AS u, ['']::VARCHAR[] AS v FROM scored WHERE false"]
    text = lambda *lists: f"array_to_string(list_concat({', '.join(lists)}), ' ')" if len(lists) > 1 else f"array_to_string({lists[0]}, ' ')"
    wide = ", ".join(f"round(max(CASE WHEN f = '{n}' THEN r END), 6) AS {n}" for n, _, k in scores if k in ("ratio", "token_sort", "token_set"))
    return f"""ts AS ({" UNION ALL ".join(sets or none)}),
tc AS (SELECT {_IDS}, f, list_sort(list_intersect(u, v)) AS c, list_sort(list_filter(u, lambda w: NOT list_contains(v, w))) AS x, list_sort(list_filter(v, lambda w: NOT list_contains(u, w))) AS y FROM ts),
tk AS (SELECT *, CASE WHEN len(c) + len(x) = 0 OR len(c) + len(y) = 0 THEN 0.0 WHEN len(c) > 0 AND (len(x) = 0 OR len(y) = 0) THEN 100.0 END AS r FROM tc),
fq AS ({" UNION ALL ".join([*plain, f"SELECT {_IDS}, f, {text('c', 'x')} AS a, {text('c', 'y')} AS b FROM tk WHERE r IS NULL", f"SELECT {_IDS}, f, {text('c')}, {text('c', 'x')} FROM tk WHERE r IS NULL AND len(c) > 0", f"SELECT {_IDS}, f, {text('c')}, {text('c', 'y')} FROM tk WHERE r IS NULL AND len(c) > 0"])}),
fl AS (SELECT a, b, CASE WHEN a = '' AND b = '' THEN 100.0 WHEN a = '' OR b = '' THEN 0.0 ELSE 200.0::DOUBLE * ({_LCS}) / (length(a) + length(b)) END AS r FROM (SELECT DISTINCT a, b FROM fq)),
fa AS (SELECT {_IDS}, f, r FROM fq JOIN fl USING (a, b) UNION ALL SELECT {_IDS}, f, r FROM tk WHERE r IS NOT NULL), fuzzy AS (SELECT {_IDS}, {wide} FROM fa GROUP BY {_IDS})"""


_FUZZ = tuple(x for x in strings.PAIR_SCORES if x[2] != "partial")


@query(
    f"""WITH {SCORED_SQL}, {scores_sql(_FUZZ)} SELECT fuzzy.*, round(CASE WHEN s1_name_lat = '' OR rec_name_lat = '' THEN 0.0 ELSE jaro_winkler_similarity(s1_name_lat, rec_name_lat) END, 6) AS name_jw FROM fuzzy JOIN scored USING ({_IDS})"""
)
def fuzz_scores(spark, sf):
    """The edit-based pair features in one Arrow round trip, but for the partial ratios."""
    out = x.scored(spark, sf).withColumn("f", strings.pair_scores("s1_", "rec_", _FUZZ))
    return out.select(*_PAIR, *(F.round(f"f.{n}", 6).alias(n) for n, _, _ in _FUZZ))


# --- competition -------------------------------------------------------------------------


def _runner(value: str, part: str, order: str) -> str:
    """SQL of the best value among the others of a partition."""
    w = f"(PARTITION BY {part} ORDER BY {value} DESC, {order} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    return f"CASE WHEN row_number() OVER (PARTITION BY {part} ORDER BY {value} DESC, {order}) = 1 THEN coalesce(nth_value({value}, 2) OVER {w}, 0.0) ELSE first_value({value}) OVER {w} END"


_REC, _ONE, _S1 = "country, src, rec_id", "country, src, s1_id", "country, s1_id"


@query(
    f"""WITH {SCORED_SQL} SELECT {_IDS}, max(prob) OVER (PARTITION BY {_REC}) AS rec_best, count(*) OVER (PARTITION BY {_REC}) AS rec_n,
  round(CASE WHEN row_number() OVER (PARTITION BY {_REC} ORDER BY prob DESC, s1_id) = 1 THEN prob - ({_runner("prob", _REC, "s1_id")}) ELSE prob - max(prob) OVER (PARTITION BY {_REC}) END, 6) AS rec_margin,
  row_number() OVER (PARTITION BY {_ONE} ORDER BY prob DESC, rec_id) AS s1_rank, max(prob) OVER (PARTITION BY {_ONE}) AS s1_best, round(prob - max(prob) OVER (PARTITION BY {_ONE}), 6) AS s1_gap FROM scored"""
)
def group_competition(spark, sf):
    return compete.retrieval(x.pairs(spark, sf), "prob").select(*_PAIR, "rec_best", "rec_n", "rec_margin", "s1_rank", "s1_best", "s1_gap")


def _stage2_sql() -> str:
    out = ["(prob >= 0.5)::BIGINT AS p_strong", f"row_number() OVER (PARTITION BY {_ONE} ORDER BY prob DESC, rec_id) AS p_rank"]
    for n, p in (("p", _ONE), ("pa", _S1), ("d", _REC)):
        w = f"OVER (PARTITION BY {p})"
        out += [f"max(prob) {w} AS {n}_best", f"round(prob - max(prob) {w}, 6) AS {n}_gap", f"(sum(CASE WHEN prob >= 0.5 THEN 1 ELSE 0 END) {w})::BIGINT AS {n}_cnt"]
        out += [f"round(sum(prob) {w}, 6) AS {n}_sum"] if n != "d" else ["count(*) OVER (PARTITION BY country, src, rec_id) AS d_n"]
    return f"WITH {SCORED_SQL} SELECT {_IDS}, {', '.join(out)} FROM scored"


_STAGE2 = ["p_strong", "p_rank", *(f"{n}_{c}" for n in ("p", "pa", "d") for c in ("best", "gap", "cnt", *(["sum"] if n != "d" else ["n"])))]


@query(_stage2_sql())
def stage2_competition(spark, sf):
    return compete.stage_two(x.pairs(spark, sf)).select(*_PAIR, *_STAGE2)


@query(
    f"""WITH {SCORED_SQL} SELECT {_IDS}, row_number() OVER (PARTITION BY {_ONE} ORDER BY prob DESC, rec_id) AS s1_rank_p, round(sum(prob) OVER (PARTITION BY {_ONE}), 6) AS s1_sum_p, max(prob) OVER (PARTITION BY {_ONE}) AS s1_best_p, round(prob - max(prob) OVER (PARTITION BY {_ONE}), 6) AS s1_gap_p, max(prob) OVER (PARTITION BY {_REC}) AS rec_best_p,
  round(CASE WHEN row_number() OVER (PARTITION BY {_REC} ORDER BY prob DESC, s1_id) = 1 THEN prob - ({_runner("prob", _REC, "s1_id")}) ELSE prob - max(prob) OVER (PARTITION BY {_REC}) END, 6) AS rec_margin_p,
  (sum(CASE WHEN prob > 0.5 THEN 1 ELSE 0 END) OVER (PARTITION BY {_ONE}))::BIGINT AS s1_n_hi, (sum(CASE WHEN prob > 0.5 THEN 1 ELSE 0 END) OVER (PARTITION BY {_REC}))::BIGINT AS rec_n_hi FROM scored"""
)
def stage2_short(spark, sf):
    return compete.stage_two_short(x.pairs(spark, sf)).select(*_PAIR, "s1_rank_p", "s1_sum_p", "s1_best_p", "s1_gap_p", "rec_best_p", "rec_margin_p", "s1_n_hi", "rec_n_hi")


@query(
    f"""WITH {SCORED_SQL}, o AS (SELECT country, src, s1_id, max(prob) AS b, sum(CASE WHEN prob >= 0.5 THEN 1 ELSE 0 END) AS c FROM scored GROUP BY ALL)
SELECT s.country, s.src, s.s1_id, s.rec_id, coalesce(o.b, 0.0) AS oth_best, coalesce(o.c, 0)::BIGINT AS oth_cnt FROM scored s LEFT JOIN o ON o.country = s.country AND o.s1_id = s.s1_id AND o.src = 5 - s.src"""
)
def other_source(spark, sf):
    return compete.other_source(x.pairs(spark, sf)).select(*_PAIR, "oth_best", "oth_cnt")


@query(f"WITH {SCORED_SQL} SELECT {_IDS}, {_runner('prob', _S1, 'src, rec_id')} AS xs_other, {_runner('prob', _REC, 's1_id')} AS r_other FROM scored")
def leave_one_out_best(spark, sf):
    return compete.across_sources(x.pairs(spark, sf)).select(*_PAIR, "xs_other", "r_other")


@query(
    f"""WITH {SCORED_SQL} SELECT {_IDS}, row_number() OVER (PARTITION BY {_S1} ORDER BY prob DESC, src, rec_id) AS xs_rank, (sum(CASE WHEN prob >= 0.5 THEN 1 ELSE 0 END) OVER (PARTITION BY {_S1}))::BIGINT AS xs_n50,
  (sum(CASE WHEN prob >= 0.9 THEN 1 ELSE 0 END) OVER (PARTITION BY {_S1}))::BIGINT AS xs_n90, round(sum(prob) OVER (PARTITION BY {_S1}), 6) AS xs_sum, (sum(CASE WHEN prob >= 0.5 THEN 1 ELSE 0 END) OVER (PARTITION BY {_REC}))::BIGINT AS r_n50,
  row_number() OVER (PARTITION BY {_REC} ORDER BY prob DESC, s1_id) AS r_rank, coalesce(CASE WHEN src = 2 THEN max(CASE WHEN src = 3 THEN prob END) OVER (PARTITION BY {_S1}) ELSE max(CASE WHEN src = 2 THEN prob END) OVER (PARTITION BY {_S1}) END, 0.0) AS xs_other_src FROM scored"""
)
def across_sources(spark, sf):
    return compete.across_sources(x.pairs(spark, sf)).select(*_PAIR, "xs_rank", "xs_n50", "xs_n90", "xs_sum", "r_n50", "r_rank", "xs_other_src")


# --- siblings ----------------------------------------------------------------------------

_GROUP_SQL = f"""gk AS (SELECT country, src, rec_id, array_to_string(list_sort({words_sql("addr_norm")}), ' ') AS group_key FROM pool WHERE addr_norm <> ''),
gs AS (SELECT country, src, group_key, count(*) AS group_size FROM gk GROUP BY ALL HAVING count(*) BETWEEN 2 AND 12), grp AS (SELECT country, src, rec_id, group_key, group_size FROM gk JOIN gs USING (country, src, group_key))"""


def _groups(spark, sf):
    return sibling.groups(x.sides(x.normed(spark, sf))[1])


@query(f"WITH {normed_sql()}, {_GROUP_SQL} SELECT * FROM grp")
def sibling_groups(spark, sf):
    return _groups(spark, sf)


@query(
    f"""WITH {SCORED_SQL}, {_GROUP_SQL}, few2 AS (SELECT * FROM scored WHERE prob >= 0.5), want AS (SELECT DISTINCT s.country, s.src, s.s1_id, g.group_key FROM few2 s JOIN grp g USING (country, src, rec_id) WHERE s.prob >= 0.9),
new AS (SELECT DISTINCT w.country, w.src, w.s1_id, g.rec_id FROM want w JOIN grp g USING (country, src, group_key)), fresh AS (SELECT * FROM new ANTI JOIN few2 USING (country, src, s1_id, rec_id))
SELECT country, src, s1_id, rec_id FROM fresh QUALIFY row_number() OVER (PARTITION BY country, s1_id ORDER BY rec_id) <= 4"""
)
def sibling_expand(spark, sf):
    """Mates of confident records that aren't likely records themselves."""
    return sibling.expand(decide.by_threshold(x.pairs(spark, sf), 0.5), _groups(spark, sf)).select(*_PAIR)


@query(
    f"""WITH {SCORED_SQL}, {_GROUP_SQL}, j AS (SELECT s.*, g.group_key FROM scored s LEFT JOIN grp g USING (country, src, rec_id)),
k AS (SELECT *, count(*) OVER w AS n, sum(prob) OVER w AS t, {_runner("prob", "country, src, s1_id, group_key", "rec_id")} AS ru FROM j WINDOW w AS (PARTITION BY country, src, s1_id, group_key))
SELECT {_IDS}, CASE WHEN group_key IS NULL THEN 0 ELSE n - 1 END::BIGINT AS sib_cnt, CASE WHEN group_key IS NULL OR n = 1 THEN 0.0 ELSE round((t - prob) / (n - 1), 6) END AS sib_mean, CASE WHEN group_key IS NULL THEN 0.0 ELSE ru END AS sib_max FROM k"""
)
def sibling_loo(spark, sf):
    return sibling.leave_one_out(x.pairs(spark, sf), _groups(spark, sf)).select(*_PAIR, "sib_cnt", "sib_mean", "sib_max")


# --- refinement --------------------------------------------------------------------------


@query(
    f"""WITH {SCORED_SQL}, pk AS (SELECT country, name_key AS k, count(*) AS n FROM pool GROUP BY ALL), pa AS (SELECT country, addr_norm AS k, count(*) AS n FROM pool WHERE addr_norm <> '' GROUP BY ALL), sk AS (SELECT country, name_key AS k, count(*) AS n FROM s1 GROUP BY ALL)
SELECT s.country, s.src, s.s1_id, s.rec_id, round(ln(1 + coalesce(a.n, 0)), 6) AS k_pool_rec, round(ln(1 + coalesce(b.n, 0)), 6) AS k_pool_s1, CASE WHEN s.rec_addr_norm = '' THEN -1.0 ELSE round(ln(1 + coalesce(c.n, 0)), 6) END AS k_addr_rec,
  round(ln(1 + coalesce(d.n, 0)), 6) AS k_s1a_rec, round(ln(1 + coalesce(e.n, 0)), 6) AS k_s1a_s1, round(ln(1 + greatest(coalesce(d.n, 0) - (s.rec_name_key = s.s1_name_key)::INT, 0)), 6) AS k_s1a_rec_other
FROM scored s LEFT JOIN pk a ON a.country = s.country AND a.k = s.rec_name_key LEFT JOIN pk b ON b.country = s.country AND b.k = s.s1_name_key LEFT JOIN pa c ON c.country = s.country AND c.k = s.rec_addr_norm
  LEFT JOIN sk d ON d.country = s.country AND d.k = s.rec_name_key LEFT JOIN sk e ON e.country = s.country AND e.k = s.s1_name_key"""
)
def rarity_log1p(spark, sf):
    s1, pool = x.sides(x.normed(spark, sf))
    pairs = x.scored(spark, sf).select(*_PAIR, F.col("s1_name_key").alias("s1_key"), F.col("rec_name_key").alias("rec_key"), F.col("rec_addr_norm").alias("rec_addr"))
    return refine.rarity(pairs, s1, pool).select(*_PAIR, "k_pool_rec", "k_pool_s1", "k_addr_rec", "k_s1a_rec", "k_s1a_s1", "k_s1a_rec_other")


_CONF_SQL = "conf AS (SELECT * FROM scored WHERE prob >= 0.8 QUALIFY row_number() OVER (PARTITION BY country, s1_id ORDER BY prob DESC, src, rec_id) <= 8)"


def _consensus_sql(name: str, mine: str, theirs: str, missing: str) -> str:
    """CTE ``name``: the pairs with whether the record agrees with the most frequent value."""
    return f"""{name}_v AS (SELECT DISTINCT country, s1_id, {mine} AS v FROM scored UNION ALL SELECT country, s1_id, {theirs} FROM conf), {name}_c AS (SELECT country, s1_id, v, count(*) AS c FROM {name}_v WHERE v <> {missing} GROUP BY ALL),
{name}_m AS (SELECT country, s1_id, v AS mode FROM {name}_c QUALIFY row_number() OVER (PARTITION BY country, s1_id ORDER BY c DESC, v) = 1),
{name} AS (SELECT s.country, s.src, s.s1_id, s.rec_id, CASE WHEN {theirs} = {missing} OR mode IS NULL THEN -1 ELSE ({theirs} = mode)::INT END::BIGINT AS {name} FROM scored s LEFT JOIN {name}_m m ON m.country = s.country AND m.s1_id = s.s1_id)"""


@query(
    f"""WITH {SCORED_SQL}, {_CONF_SQL}, {_consensus_sql("agrees", "s1_name_key", "rec_name_key", "''")}, {_consensus_sql("cons_legal", "s1_legal", "rec_legal", "''")}, {_consensus_sql("cons_num", _FIRST.format("s1_nums"), _FIRST.format("rec_nums"), "-1.0")}
SELECT {_IDS}, agrees, cons_num, cons_legal FROM agrees JOIN cons_legal USING ({_IDS}) JOIN cons_num USING ({_IDS})"""
)
def consensus_mode(spark, sf):
    pairs = x.scored(spark, sf, "name_key", "nums", "legal").withColumns({"s1_num": first_number(F.col("s1_nums")), "rec_num": first_number(F.col("rec_nums"))})
    out = refine.consensus(pairs, "s1_name_key", "rec_name_key", "", "agrees")
    out = refine.consensus(out, "s1_num", "rec_num", -1.0, "cons_num")
    return refine.consensus(out, "s1_legal", "rec_legal", "", "cons_legal").select(*_PAIR, "agrees", "cons_num", "cons_legal")


@query(
    f"""WITH {SCORED_SQL}, {_CONF_SQL}, sn AS (SELECT *, coalesce(TRY_CAST(string_split(rec_nums, ' ')[1] AS DOUBLE), -1.0) AS rec_num FROM scored), cn AS (SELECT *, coalesce(TRY_CAST(string_split(rec_nums, ' ')[1] AS DOUBLE), -1.0) AS rec_num FROM conf),
j AS (SELECT a.*, 100 * ({jaccard_sql("a.rec_name_core", "b.rec_name_core")}) AS nm, CASE WHEN a.rec_addr_norm <> '' AND b.rec_addr_norm <> '' THEN 100 * ({jaccard_sql("a.rec_addr_norm", "b.rec_addr_norm")}) ELSE -1.0 END AS ad, b.prob AS mp, b.src AS msrc, a.rec_num >= 0 AND b.rec_num >= 0 AS nh, a.rec_num = b.rec_num AS ne, a.rec_legal <> '' AND b.rec_legal <> '' AS lh, a.rec_legal = b.rec_legal AS le
  FROM sn a JOIN cn b ON a.country = b.country AND a.s1_id = b.s1_id AND (a.src <> b.src OR a.rec_id <> b.rec_id)),
m AS (SELECT {_IDS}, count(*) AS m_cnt, round(max(nm), 6) AS m_nm_max, round(avg(nm), 6) AS m_nm_mean, round(max(nm * mp), 6) AS m_nm_wmax, max((nm >= 99.5)::INT)::BIGINT AS m_nm_eq, round(max(ad), 6) AS m_ad_max, sum(nh::INT)::BIGINT AS m_num_has,
  sum((nh AND ne)::INT)::BIGINT AS m_num_agree, sum((nh AND NOT ne)::INT)::BIGINT AS m_num_dis, sum(lh::INT)::BIGINT AS m_leg_has, sum((lh AND le)::INT)::BIGINT AS m_leg_agree, round(max(CASE WHEN src <> msrc THEN nm ELSE 0.0 END), 6) AS m_x_nm_max FROM j GROUP BY {_IDS})
SELECT {_IDS}, coalesce(m_cnt, 0) AS m_cnt, coalesce(m_nm_max, 0.0) AS m_nm_max, coalesce(m_nm_mean, 0.0) AS m_nm_mean, coalesce(m_nm_wmax, 0.0) AS m_nm_wmax, coalesce(m_nm_eq, 0) AS m_nm_eq, coalesce(m_ad_max, -1.0) AS m_ad_max, coalesce(m_num_has, 0) AS m_num_has,
  coalesce(m_num_agree, 0) AS m_num_agree, coalesce(m_num_dis, 0) AS m_num_dis, coalesce(m_leg_has, 0) AS m_leg_has, coalesce(m_leg_agree, 0) AS m_leg_agree, coalesce(m_x_nm_max, 0.0) AS m_x_nm_max FROM scored LEFT JOIN m USING ({_IDS})"""
)
def mate_agg(spark, sf):
    """Mates by word Jaccard; the scorer is a parameter (token-set ratio in ``refined``)."""

    def jaccard(a, b):
        u, v = sim.words(a), sim.words(b)
        return 100 * F.when((F.size(u) == 0) | (F.size(v) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(u, v)) / F.size(F.array_union(u, v)))

    pairs = x.scored(spark, sf, "name_core", "addr_norm", "nums", "legal").withColumns({"rec_name": F.col("rec_name_core"), "rec_addr": F.col("rec_addr_norm"), "rec_num": first_number(F.col("rec_nums"))})
    return refine.mates(pairs, jaccard, jaccard).select(*_PAIR, "m_cnt", "m_nm_max", "m_nm_mean", "m_nm_wmax", "m_nm_eq", "m_ad_max", "m_num_has", "m_num_agree", "m_num_dis", "m_leg_has", "m_leg_agree", "m_x_nm_max")


# --- decisions ---------------------------------------------------------------------------


def _owner_sql(margin: float) -> str:
    lead = "" if margin == 0 else f" AND round(prob - coalesce(lead(prob) OVER (PARTITION BY {_REC} ORDER BY prob DESC, s1_id), 0.0), 9) >= {margin}"
    return f"SELECT {_IDS}, prob FROM scored QUALIFY row_number() OVER (PARTITION BY {_REC} ORDER BY prob DESC, s1_id) = 1{lead}"


@query(f"WITH {SCORED_SQL} {_owner_sql(0)}")
def one_owner(spark, sf):
    return decide.one_owner(x.pairs(spark, sf)).select(*_PAIR, "prob")


@query(f"WITH {SCORED_SQL} {_owner_sql(0.05)}")
def one_owner_margin(spark, sf):
    return decide.one_owner(x.pairs(spark, sf), margin=0.05).select(*_PAIR, "prob")


@query(f"WITH {SCORED_SQL} SELECT {_IDS}, prob FROM scored QUALIFY row_number() OVER (PARTITION BY {_S1} ORDER BY prob DESC, src, rec_id) <= 3")
def cap_per_entity(spark, sf):
    return decide.cap_per_query(x.pairs(spark, sf), 3).select(*_PAIR, "prob")


@query(f"WITH {SCORED_SQL} SELECT {_IDS}, prob FROM scored WHERE prob >= 0.02 QUALIFY row_number() OVER (PARTITION BY {_ONE} ORDER BY prob DESC, rec_id) <= 8")
def prune_floor(spark, sf):
    return sampling.prune(x.pairs(spark, sf)).select(*_PAIR, "prob")


_F05 = "CASE WHEN n_pred = 0 AND n_true = 0 THEN 1.0 WHEN tp = 0 THEN 0.0 ELSE 1.25 * (tp / n_pred::DOUBLE) * (tp / n_true::DOUBLE) / (0.25 * (tp / n_pred::DOUBLE) + tp / n_true::DOUBLE) END"
_GRID_T, _GRID_M = [0.3, 0.5, 0.7], [0.0, 0.05]


@query(
    f"""WITH {SCORED_SQL}, g AS (SELECT t AS threshold, m AS margin FROM (VALUES (0.3::DOUBLE), (0.5), (0.7)) a(t), (VALUES (0.0::DOUBLE), (0.05)) b(m)),
o AS (SELECT {_IDS}, prob, round(prob - coalesce(lead(prob) OVER (PARTITION BY {_REC} ORDER BY prob DESC, s1_id), 0.0), 9) AS ld, row_number() OVER (PARTITION BY {_REC} ORDER BY prob DESC, s1_id) AS n FROM scored),
h AS (SELECT o.*, g.threshold, g.margin, (t.rec_id IS NOT NULL)::INT AS hit FROM o JOIN g ON o.ld >= g.margin LEFT JOIN truth t ON t.s1_id = o.s1_id AND t.rec_id = o.rec_id WHERE n = 1),
c AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY country, s1_id, threshold, margin ORDER BY prob DESC, src, rec_id) <= 11), k AS (SELECT s1_id, threshold, margin, count(*) AS n_pred, sum(hit) AS tp FROM c WHERE prob >= threshold GROUP BY ALL),
tr AS (SELECT s1_id, count(*) AS n_true FROM truth GROUP BY s1_id), e AS (SELECT s1.s1_id, g.threshold, g.margin, coalesce(n_true, 0) AS n_true, coalesce(n_pred, 0) AS n_pred, coalesce(tp, 0) AS tp FROM s1 CROSS JOIN g LEFT JOIN tr USING (s1_id) LEFT JOIN k ON k.s1_id = s1.s1_id AND k.threshold = g.threshold AND k.margin = g.margin)
SELECT threshold, margin, round(avg({_F05}), 6) AS macro_f05 FROM e GROUP BY ALL"""
)
def threshold_grid(spark, sf):
    pairs = x.pairs(spark, sf)
    return decide.tune(pairs, x.truth(spark, sf), x.sides(x.normed(spark, sf))[0], _GRID_T, _GRID_M)


@query(
    f"""WITH {SCORED_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY {_REC} ORDER BY prob DESC, s1_id) AS a, row_number() OVER (PARTITION BY {_ONE} ORDER BY prob DESC, rec_id) AS b FROM scored), g AS (SELECT {_IDS}, prob FROM r WHERE a = 1 AND b = 1 AND prob >= 0.9),
l AS (SELECT {_IDS}, prob FROM scored WHERE prob < 0.5 AND (country, s1_id) IN (SELECT (country, s1_id) FROM g) QUALIFY row_number() OVER (PARTITION BY {_S1} ORDER BY prob DESC, src, rec_id) <= 2)
SELECT *, 1::BIGINT AS y FROM g UNION ALL SELECT *, 0::BIGINT FROM l"""
)
def mutual_best(spark, sf):
    return decide.mutual_best(x.pairs(spark, sf), sure=0.9).select(*_PAIR, "prob", "y")


_CHOSEN_SQL = f"chosen AS (SELECT * FROM ({_owner_sql(0)}) WHERE prob >= 0.6)"


def _chosen(pairs):
    return decide.by_threshold(decide.cap_per_query(decide.one_owner(pairs)), 0.6)


@query(f"WITH {SCORED_SQL}, {_CHOSEN_SQL}, l AS (SELECT s1_id, string_agg(DISTINCT rec_id, ',' ORDER BY rec_id) AS ids FROM chosen GROUP BY s1_id) SELECT s1.s1_id, coalesce(ids, '') AS matched_entity_ids FROM s1 LEFT JOIN l USING (s1_id)")
def match_lists(spark, sf):
    return decide.match_lists(x.sides(x.normed(spark, sf))[0], _chosen(x.pairs(spark, sf)))


@query(f"WITH {SCORED_SQL}, l AS (SELECT s1_id, string_agg(DISTINCT rec_id, ',' ORDER BY rec_id) AS ids FROM scored GROUP BY s1_id) SELECT s1.s1_id, coalesce(ids, '') AS candidate_entity_ids FROM s1 LEFT JOIN l USING (s1_id)")
def candidate_lists(spark, sf):
    return decide.match_lists(x.sides(x.normed(spark, sf))[0], x.pairs(spark, sf), "candidate_entity_ids")


_ADDED = "list_transform(range(1, len({d}) + 2), lambda j: coalesce({d}[j], 0.0) * (1 - r.prob) + coalesce(CASE WHEN j > 1 THEN {d}[j - 1] END, 0.0) * r.prob)"


@query(
    f"""WITH RECURSIVE {SCORED_SQL}, o AS ({_owner_sql(0)}),
r AS (SELECT *, row_number() OVER (PARTITION BY {_S1} ORDER BY prob DESC, src, rec_id) AS i, count(*) OVER (PARTITION BY {_S1}) AS n FROM o),
head AS (SELECT DISTINCT country, s1_id, 0::BIGINT AS i, [1.0::DOUBLE] AS d FROM r UNION ALL SELECT head.country, head.s1_id, r.i, {_ADDED.format(d="head.d")} FROM head JOIN r ON r.country = head.country AND r.s1_id = head.s1_id AND r.i = head.i + 1),
rest AS (SELECT DISTINCT country, s1_id, n AS i, [1 - {decide.MISS_RATE}::DOUBLE, {decide.MISS_RATE}::DOUBLE] AS d FROM r UNION ALL SELECT rest.country, rest.s1_id, r.i - 1, {_ADDED.format(d="rest.d")} FROM rest JOIN r ON r.country = rest.country AND r.s1_id = rest.s1_id AND r.i = rest.i),
f AS (SELECT country, s1_id, head.i AS k, round(CASE WHEN head.i = 0 THEN rest.d[1] ELSE list_sum(flatten(list_transform(range(0, len(head.d)), lambda h: list_transform(range(0, len(rest.d)), lambda m: head.d[h + 1] * rest.d[m + 1] * 1.25 * h / (0.25 * (h + m) + head.i))))) END, 9) AS f
  FROM head JOIN rest USING (country, s1_id, i)),
b AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY country, s1_id ORDER BY f DESC, k) = 1)
SELECT r.country, r.s1_id, r.src, r.rec_id, r.prob, round(b.f, 6) AS expected_f FROM r JOIN b ON b.country = r.country AND b.s1_id = r.s1_id AND r.i <= b.k"""
)
def expected_f05(spark, sf):
    return decide.expected_selection(decide.one_owner(x.pairs(spark, sf))).select("country", "s1_id", "src", "rec_id", "prob", "expected_f")


# --- evaluation --------------------------------------------------------------------------

_COUNTS_SQL = f"""{SCORED_SQL}, {_CHOSEN_SQL}, pc AS (SELECT s1_id, count(*) AS n_pred FROM chosen GROUP BY s1_id), tc AS (SELECT s1_id, count(*) AS n_true FROM truth GROUP BY s1_id),
hc AS (SELECT c.s1_id, count(*) AS tp FROM chosen c JOIN truth t ON t.s1_id = c.s1_id AND t.rec_id = c.rec_id GROUP BY c.s1_id),
cnt AS (SELECT s1.country, s1.s1_id, coalesce(n_pred, 0) AS n_pred, coalesce(n_true, 0) AS n_true, coalesce(tp, 0) AS tp FROM s1 LEFT JOIN pc USING (s1_id) LEFT JOIN tc USING (s1_id) LEFT JOIN hc USING (s1_id)), f AS (SELECT *, round({_F05}, 6) AS f05 FROM cnt)"""


def _evaluated(spark, sf):
    pairs = x.pairs(spark, sf)
    return evaluate.by_query(x.sides(x.normed(spark, sf))[0], _chosen(pairs), x.truth(spark, sf))


@query(f"WITH {_COUNTS_SQL} SELECT * FROM f")
def f05_per_entity(spark, sf):
    return _evaluated(spark, sf)


@query(f"WITH {_COUNTS_SQL} SELECT country, round(avg(f05), 6) AS macro_f05, count(*) AS n FROM f GROUP BY country")
def macro_f05_by_country(spark, sf):
    return evaluate.macro(_evaluated(spark, sf), "country")


@query(f"WITH {_COUNTS_SQL} SELECT least(n_true, 6) AS n_true_bin, round(avg(f05), 6) AS macro_f05, count(*) AS n FROM f GROUP BY ALL")
def macro_f05_by_size(spark, sf):
    return evaluate.by_size(_evaluated(spark, sf))


_VIEWS_SQL = f"WITH {SCORED_SQL}, vk AS ({_KEYS.format(k='name_key')}), va AS ({_KEYS.format(k='addr_norm')}), vw AS (SELECT * FROM vk UNION SELECT * FROM va)"


def _key_views(spark, sf):
    s1, pool = x.sides(x.normed(spark, sf))
    return blocking.fuse(None, (), {"key": blocking.key_join(s1, pool, "name_key"), "addr": blocking.key_join(s1, pool, "addr_norm")}, 0)


@query(
    f"""{_VIEWS_SQL} SELECT t.country, count(*) AS n_true, round(avg((a.s1_id IS NOT NULL)::INT), 6) AS recall_key, round(avg((b.s1_id IS NOT NULL)::INT), 6) AS recall_addr, round(avg((a.s1_id IS NOT NULL OR b.s1_id IS NOT NULL)::INT), 6) AS recall_union
FROM truth t LEFT JOIN vk a ON a.s1_id = t.s1_id AND a.rec_id = t.rec_id LEFT JOIN va b ON b.s1_id = t.s1_id AND b.rec_id = t.rec_id GROUP BY t.country"""
)
def recall_by_view(spark, sf):
    return evaluate.view_recall(_key_views(spark, sf), x.truth(spark, sf), {"key": F.col("in_key") == 1, "addr": F.col("in_addr") == 1})


@query(
    f"""{_VIEWS_SQL}, h AS (SELECT t.s1_id, count(*) AS n_true, count(w.s1_id) AS hits FROM truth t LEFT JOIN vw w ON w.s1_id = t.s1_id AND w.rec_id = t.rec_id GROUP BY t.s1_id), e AS (SELECT s1.country, coalesce(n_true, 0) AS n_true, coalesce(hits, 0) AS hits FROM s1 LEFT JOIN h USING (s1_id))
SELECT country, count(*) AS n, round(avg(CASE WHEN n_true = 0 THEN 1.0 WHEN hits = 0 THEN 0.0 ELSE 1.25 * (hits / n_true::DOUBLE) / (0.25 + hits / n_true::DOUBLE) END), 6) AS ceiling,
  coalesce(round(sum((n_true > 0 AND hits = n_true)::INT) / nullif(sum((n_true > 0)::INT), 0)::DOUBLE, 6), 0.0) AS fully_recovered, coalesce(round(sum((n_true > 0 AND hits = 0)::INT) / nullif(sum((n_true > 0)::INT), 0)::DOUBLE, 6), 0.0) AS zero_hit FROM e GROUP BY country"""
)
def oracle_ceiling(spark, sf):
    return evaluate.ceiling(x.sides(x.normed(spark, sf))[0], _key_views(spark, sf), x.truth(spark, sf))


@query(
    f"""{_VIEWS_SQL}, {_CHOSEN_SQL}, m AS (SELECT t.country, t.src, CASE WHEN c.rec_id IS NOT NULL THEN 'hit' WHEN w.rec_id IS NULL THEN 'a_not_retrieved' WHEN k.rec_id IS NULL THEN 'b_pruned_away' ELSE 'c_scored_low' END AS fate
  FROM truth t LEFT JOIN chosen c ON c.s1_id = t.s1_id AND c.rec_id = t.rec_id LEFT JOIN vw w ON w.s1_id = t.s1_id AND w.rec_id = t.rec_id LEFT JOIN va k ON k.s1_id = t.s1_id AND k.rec_id = t.rec_id),
n AS (SELECT country, src, sum((fate = 'hit')::INT)::BIGINT AS hit, sum((fate = 'a_not_retrieved')::INT)::BIGINT AS a_not_retrieved, sum((fate = 'b_pruned_away')::INT)::BIGINT AS b_pruned_away, sum((fate = 'c_scored_low')::INT)::BIGINT AS c_scored_low, count(*) AS n FROM m GROUP BY ALL)
SELECT *, round(hit / n::DOUBLE, 6) AS share_hit, round(a_not_retrieved / n::DOUBLE, 6) AS share_a_not_retrieved, round(b_pruned_away / n::DOUBLE, 6) AS share_b_pruned_away, round(c_scored_low / n::DOUBLE, 6) AS share_c_scored_low FROM n"""
)
def miss_taxonomy(spark, sf):
    pairs = x.pairs(spark, sf)
    views = _key_views(spark, sf)
    return evaluate.fate_shares(evaluate.taxonomy(x.truth(spark, sf), views, views.where("in_addr = 1"), _chosen(pairs)), "country", "src")


@query(f"WITH {SCORED_SQL}, {_CHOSEN_SQL} SELECT c.country, count(*) AS false_positives FROM chosen c ANTI JOIN truth t ON t.s1_id = c.s1_id AND t.rec_id = c.rec_id GROUP BY c.country")
def false_positives(spark, sf):
    pairs = x.pairs(spark, sf)
    return evaluate.false_positives(decide.by_threshold(decide.one_owner(pairs), 0.4), x.truth(spark, sf))


ORACLE["false_positives"] = ORACLE["false_positives"].replace("prob >= 0.6", "prob >= 0.4")


@query(
    f"""WITH {SCORED_SQL}, s2 AS (SELECT s1_id FROM truth GROUP BY s1_id HAVING count(*) > 1)
SELECT p.rec_id, (t.s1_id IS NOT NULL AND t.s1_id NOT IN (SELECT s1_id FROM s2))::BIGINT AS oth FROM pool p LEFT JOIN truth t USING (rec_id)"""
)
def owned_outside(spark, sf):
    """Records whose owner isn't among the S1 rows with several records."""
    _, pool = x.sides(x.normed(spark, sf))
    truth = x.truth(spark, sf)
    owner = pool.select("rec_id").join(truth.select("rec_id", F.col("s1_id").alias("owner")), "rec_id", "left").na.fill("", ["owner"])
    return evaluate.owned_outside(pool.select("rec_id"), owner, truth.groupBy("s1_id").count().where("count > 1"))


# --- validation, mining, sampling --------------------------------------------------------


@query(
    f"""WITH {SCORED_SQL}, {_CHOSEN_SQL}, l AS (SELECT s1_id, string_agg(rec_id, ',' ORDER BY rec_id) AS ids, count(*) AS n FROM chosen GROUP BY s1_id),
r AS (SELECT s1.s1_id, CASE WHEN n IS NULL THEN s1.s1_id WHEN n = 1 THEN ids || ',' || ids WHEN n = 2 THEN ids || ',X-1,S3-x' ELSE ids END AS l FROM s1 LEFT JOIN l USING (s1_id) WHERE coalesce(n, 0) < 4),
f AS (SELECT s1_id, unnest(list_filter(string_split(l, ','), lambda w: w <> '')) AS rec_id FROM r)
SELECT 'empty_id' AS rule, 0::BIGINT AS n UNION ALL SELECT 'duplicate_row', 0 UNION ALL SELECT 'repeated_id_in_list', count(*) FROM r WHERE len(list_distinct(string_split(l, ','))) < len(string_split(l, ','))
UNION ALL SELECT 'self_match', count(*) FROM f WHERE starts_with(rec_id, 'S1-') UNION ALL SELECT 'wrong_prefix', count(*) FROM f WHERE NOT regexp_matches(rec_id, '^S[123]-')
UNION ALL SELECT 'missing_row', count(*) FROM s1 WHERE s1_id NOT IN (SELECT s1_id FROM r) UNION ALL SELECT 'unexpected_row', 0 UNION ALL SELECT 'unknown_id', count(*) FROM f WHERE rec_id NOT IN (SELECT rec_id FROM pool)"""
)
def validate_rules(spark, sf):
    """Match lists that were spoilt: empty ones hold their own id, single ones their record twice, pairs unknown ids; the longest are missing."""
    s1, pool = x.sides(x.normed(spark, sf))
    chosen, ids = _chosen(x.pairs(spark, sf)), F.col("matched_entity_ids")
    n = F.when(ids == "", F.lit(0)).otherwise(F.size(F.split(ids, ",")))
    lists = decide.match_lists(s1, chosen).withColumn("n", n).where("n < 4")
    spoilt = F.when(F.col("n") == 0, F.col("s1_id")).when(F.col("n") == 1, F.concat(ids, F.lit(","), ids)).when(F.col("n") == 2, F.concat(ids, F.lit(",X-1,S3-x"))).otherwise(ids)
    return validate.validate(lists.select("s1_id", spoilt.alias("matched_entity_ids")), s1, pool).select("rule", "n")


_REST_SQL = f"""{SCORED_SQL}, l AS (SELECT list_filter(string_split(s1_addr_norm, ' '), lambda w: w <> '' AND NOT list_contains(string_split(rec_addr_norm, ' '), w)) AS a, list_filter(string_split(rec_addr_norm, ' '), lambda w: w <> '' AND NOT list_contains(string_split(s1_addr_norm, ' '), w)) AS b FROM scored WHERE prob >= 0.3),
r AS (SELECT array_to_string(a, ' ') AS l, array_to_string(b, ' ') AS r FROM l WHERE len(a) BETWEEN 1 AND 2 AND len(b) BETWEEN 1 AND 2), t AS (SELECT * FROM r WHERE regexp_full_match(l, '[a-z ]+') AND regexp_full_match(r, '[a-z ]+'))"""


@query(
    f"""WITH {_REST_SQL}, p AS (SELECT l, r, count(*) AS n FROM t GROUP BY ALL), s AS (SELECT l, count(*) AS nl FROM t GROUP BY l), q AS (SELECT w, count(*) AS f FROM (SELECT l AS w FROM t UNION ALL SELECT r FROM t) GROUP BY w)
SELECT CASE WHEN a.f <= b.f THEN p.l ELSE p.r END AS src, CASE WHEN a.f <= b.f THEN p.r ELSE p.l END AS dst, n FROM p JOIN s ON s.l = p.l JOIN q a ON a.w = p.l JOIN q b ON b.w = p.r WHERE n >= 1 AND n / nl::DOUBLE >= 0.4"""
)
def alias_pairs(spark, sf):
    pairs = x.scored(spark, sf).where("prob >= 0.3")
    return aliases.alias_pairs(aliases.leftovers(pairs, "s1_addr_norm", "rec_addr_norm"), 1)


@query("SELECT c_custkey, CAST((c_custkey + 3) % 5 AS BIGINT) AS grp FROM customer")
def hash_group_split(spark, sf):
    return x.table(spark, sf, "customer").select("c_custkey", sampling.group_of(F.col("c_custkey"), 5, 3).alias("grp"))


@query("SELECT o_orderkey, CAST(o_orderstatus = 'F' AS INTEGER) AS y FROM orders WHERE o_orderstatus = 'F' OR (o_orderkey * 7919) % 100 < 25")
def neg_sample(spark, sf):
    """Negatives kept by an arithmetic lot, which any engine can follow."""
    o = x.table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderstatus") == "F").cast("int").alias("y"))
    return sampling.keep_positives(o, "y", 0.25, by=F.pmod(F.col("o_orderkey") * 7919, F.lit(100)) / 100)


@query(f"WITH {SCORED_SQL} SELECT {_IDS}, prob, round(ln(greatest(least(prob, 0.9999), 0.0001) / (1 - greatest(least(prob, 0.9999), 0.0001))), 6) AS logit FROM scored WHERE prob BETWEEN 0.03 AND 0.97")
def uncertainty_gate(spark, sf):
    return sampling.gate(x.pairs(spark, sf)).select(*_PAIR, "prob", refine.logit(F.col("prob")).alias("logit"))


@query(f"WITH {x.RECORDS_SQL} SELECT country, entity_id, doc_id FROM records QUALIFY row_number() OVER (PARTITION BY country ORDER BY doc_id) <= 10")
def inspection_sample(spark, sf):
    return sampling.inspection(x.records(spark, sf), "country", "doc_id", 10).select("country", "entity_id", "doc_id")


@query()
def mini_dataset(spark, sf):
    pairs = x.pairs(spark, sf)
    s1, pool = x.sides(x.normed(spark, sf))
    few, records = sampling.mini(s1, pool, x.truth(spark, sf), 20, 50)
    return few.select(F.col("s1_id").alias("entity_id"), "country", F.lit(1).cast("long").alias("src")).unionByName(records.select(F.col("rec_id").alias("entity_id"), "country", "src"))


@query()
def id_splits(spark, sf):
    s1, _ = x.sides(x.normed(spark, sf))
    return sampling.folds(sampling.splits(s1.select("s1_id", "country"), "s1_id", {"fit": 0.12, "holdout": 0.2, "hold2": 0.2, "hold3": 0.2}), "s1_id", "country")
