"""Invariants of the operators, sources, the whole run and streaming."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfold.catalogue import QUERIES
from kinfold.operators import blocking, decide, evaluate, models, sampling, validate
from kinfold.plans import fixtures as x
from kinfold.plans.linkage import Run, Settings
from kinfold.sources import tsv
from kinfold.sources.store import Store
from kinfold.streaming.linkage import link_stream


@pytest.fixture(scope="module")
def pairs(spark, sf):
    return x.scored(spark, sf)


def test_one_owner_and_cap(pairs):
    own = decide.cap_per_query(decide.one_owner(pairs), 3)
    assert own.groupBy("country", "src", "rec_id").count().where("count > 1").count() == 0
    assert own.groupBy("s1_id").count().where("count > 3").count() == 0


def test_repartitioning_changes_nothing(pairs):
    a = decide.expected_selection(decide.one_owner(pairs)).orderBy("rec_id").collect()
    b = decide.expected_selection(decide.one_owner(pairs.repartition(7))).orderBy("rec_id").collect()
    assert a == b


def _expected(p, miss):
    """Expected F0.5 of every prefix, by all numbers of matches among the first k and among the others."""

    def chances(part):
        out = np.ones(1)
        for q in part:
            out = np.convolve(out, [1 - q, q])
        return out

    found = [chances([*p, miss])[0]]
    for k in range(1, len(p) + 1):
        head, rest = chances(p[:k]), chances([*p[k:], miss])
        found.append(sum(a * b * 1.25 * h / (0.25 * (h + m) + k) for h, a in enumerate(head) for m, b in enumerate(rest)))
    return np.round(found, 9)


def test_expected_selection_of_long_lists(spark):
    """A query's records all count: those that are taken, and those that are missed."""
    lists = {"S1-a": [0.9] * 40, "S1-b": [0.9] * 3 + [0.28] * 30, "S1-c": [0.01] * 25, "S1-d": [0.8], "S1-e": [i / 20 for i in range(20, 0, -1)]}
    rows = [("x", 2 + i % 2, q, f"{q}-{i:02d}", p) for q, ps in lists.items() for i, p in enumerate(ps)]
    pairs = spark.createDataFrame(rows, "country string, src int, s1_id string, rec_id string, prob double").repartition(3)
    for most in (None, 11):
        got = decide.expected_selection(pairs) if most is None else decide.select(pairs, "expected", cap=most)
        taken, value = {q: [] for q in lists}, {}
        for r in got.collect():
            taken[r["s1_id"]].append(r["prob"])
            value[r["s1_id"]] = r["expected_f"]
        for q, ps in lists.items():
            scores = _expected(ps, decide.MISS_RATE)[: None if most is None else most + 1]
            k = int(scores.argmax())
            assert sorted(taken[q], reverse=True) == ps[:k]
            assert k == 0 or value[q] == pytest.approx(scores[k], abs=1e-6)
        assert len(taken["S1-a"]) == (40 if most is None else most)


def _log_loss(y, p):
    p = np.clip(np.array(p, float), 1e-7, 1 - 1e-7)
    return float(-np.where(np.array(y) == 1, np.log(p), np.log(1 - p)).mean())


def test_log_loss_of_odd_rows(spark):
    """Rows without a label or a probability have no loss and aren't counted."""
    rows = [(0, 1, 0.9, 0.6), (0, 0, 0.2, 0.4), (0, 1, None, 0.5), (0, None, 0.5, 0.5), (0, 0, float("nan"), 0.5), (1, 1, 0.0, 0.5), (1, 0, 0.0, 0.5), (2, 0, None, 0.5)]
    df = spark.createDataFrame(rows, "fold int, y int, p double, b double")
    plain = {r["fold"]: r for r in models.log_loss(df, "p", "y", "fold").collect()}
    assert (plain[0]["log_loss"], plain[0]["n"]) == pytest.approx((_log_loss([1, 0], [0.9, 0.2]), 2), abs=1e-6)
    got = {r["fold"]: r for r in models.log_loss(df, "p", "y", "fold", before="b").collect()}
    assert tuple(got[0])[1:] == pytest.approx((_log_loss([1, 0], [0.9, 0.2]), _log_loss([1, 0], [0.6, 0.4]), 0.5, 2), abs=1e-6)
    assert tuple(got[1])[1:] == pytest.approx((_log_loss([1, 0], [0.0, 0.0]), _log_loss([1, 0], [0.5, 0.5]), 0.5, 2), abs=1e-6)
    assert tuple(got[2])[1:] == (None, None, None, 0)


def test_cross_fit_oof_of_every_pair(spark, sf):
    got = QUERIES["cross_fit_oof"](spark, sf).collect()
    key = ["country", "src", "s1_id", "rec_id", "prob"]
    assert sorted(tuple(r[c] for c in key) for r in got) == sorted(map(tuple, x.pairs(spark, sf).select(key).collect()))
    assert len({(r["country"], r["s1_id"]) for r in got}) == len({(r["country"], r["s1_id"], r["fold"]) for r in got})
    assert {r["fold"] for r in got} == {0, 1} and all(0 <= r["prob_oof"] <= 1 for r in got)
    for k in (0, 1):
        rows = [r for r in got if r["fold"] == k]
        y = [r["y"] for r in rows]
        want = _log_loss(y, [r["prob_oof"] for r in rows]), _log_loss(y, [r["prob"] for r in rows]), sum(y) / len(y), len(y)
        assert {(r["log_loss"], r["log_loss_before"], r["prior"], r["n"]) for r in rows} == {tuple(rows[0][c] for c in ("log_loss", "log_loss_before", "prior", "n"))}
        assert tuple(rows[0][c] for c in ("log_loss", "log_loss_before", "prior", "n")) == pytest.approx(want, abs=1e-4)


def test_matches_are_candidates(spark, sf, pairs):
    s1, pool = x.sides(x.normed(spark, sf))
    chosen = decide.select(pairs, "expected")
    report = validate.validate(decide.match_lists(s1, chosen), s1, pool, decide.match_lists(s1, pairs))
    assert validate.passes(report) and report.where("n > 0").count() == 0


def test_top_k_ranks(spark, sf):
    s1, pool = x.sides(x.normed(spark, sf))
    top = blocking.tfidf_top_k(s1, pool, blocking.word_terms(F.col("addr_norm")), 5, 50)
    agg = top.groupBy("country", "src", "s1_id").agg(F.max("rank").alias("m"), F.count("*").alias("n")).where("m <> n or m > 5")
    assert agg.count() == 0


def test_dense_top_k_in_blocks(spark, sf):
    v = x.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    q, d = v.where("vec_id % 3 = 0").withColumnRenamed("vec_id", "s1_id"), v.where("vec_id % 3 <> 0").withColumnRenamed("vec_id", "rec_id")
    one = blocking.dense_top_k(q, d, 4).orderBy("s1_id", "rank").collect()
    many = blocking.dense_top_k(q, d, 4, block_rows=37).orderBy("s1_id", "rank").collect()
    assert one == many and len(one) == 4 * q.count()


def _texts(n, src):
    """Rows that nearly all share frequent words, with copies, empty texts and rows without a country."""
    rng = random.Random(src)
    draw = lambda k: " ".join(f"w{min(int(rng.expovariate(0.1)), 60)}" for _ in range(rng.randint(0, k)))
    rows = [(rng.choice(["x", "x", "y", None]), src, f"S{src}-{i}", draw(6), "the of to " + draw(9) if i % 7 else draw(3)) for i in range(n)]
    return rows + [(r[0], r[1], f"{r[2]}-copy", *r[3:]) for r in rows[:40]]


def test_nearest_is_exact_in_any_blocks(spark):
    schema = "country string, src long, {} string, name_core string, addr_norm string"
    s1, pool = _texts(150, 1), _texts(200, 2) + _texts(100, 3)
    asked, held = spark.createDataFrame(s1, schema.format("s1_id")).drop("src"), spark.createDataFrame(pool, schema.format("rec_id"))
    words = lambda t: {w for w in t.split(" ") if w}
    by_query, by_record = {}, {}
    for country, _, i, *mine in s1:
        for other, src, j, *theirs in pool:
            if country is None or country != other:
                continue
            both = [(len(words(a) & words(b)), len(words(a) | words(b))) for a, b in zip(mine, theirs)]
            if any(5 * c >= u and c for c, u in both):
                prob = round(sum(0.5 * (c / u if u else 0.0) for c, u in both), 6)
                by_query.setdefault((i, src), []).append((-prob, j))
                by_record.setdefault(j, []).append((-prob, i))
    want = {(i, j, -p, False) for (i, _), found in by_query.items() for p, j in sorted(found)[:5]}
    want |= {(i, j, -p, True) for j, found in by_record.items() for p, i in sorted(found)[:1] if -p >= 0.5}
    for rows in ((8192, 32768), (37, 23)):
        got = blocking.nearest(asked, held, ["name_core", "addr_norm"], 5, 0.5, query_rows=rows[0], pool_rows=rows[1]).collect()
        assert len(got) == len(want) and {(r["s1_id"], r["rec_id"], r["prob"], r["owner"]) for r in got} == want


def test_no_pair_of_texts_becomes_a_row(spark):
    n = 1500
    both = [spark.range(n).select(F.lit("x").alias("country"), F.lit(s).cast("long").alias("src"), F.concat(F.lit(f"S{s}-"), "id").alias(i), F.concat(F.lit("n"), "id").alias("name_core"), F.lit("to a of").alias("addr_norm")) for s, i in ((1, "s1_id"), (2, "rec_id"))]
    out = blocking.nearest(both[0].drop("src"), both[1], ["name_core", "addr_norm"], 25, 0.5)
    assert out.where("NOT owner").count() == 25 * n and out.where("owner").count() == n
    assert out._jdf.queryExecution().optimizedPlan().toString().count("FlatMapCoGroupsInArrow") == 1


def test_f_half(spark):
    s1 = spark.createDataFrame([("x", "a"), ("x", "b"), ("x", "c")], "country string, s1_id string")
    chosen = spark.createDataFrame([("a", "1"), ("a", "2"), ("c", "9")], "s1_id string, rec_id string")
    truth = spark.createDataFrame([("a", "1")], "s1_id string, rec_id string")
    got = {r["s1_id"]: r["f05"] for r in evaluate.by_query(s1, chosen, truth).collect()}
    assert got == {"a": pytest.approx(0.555556, abs=1e-6), "b": 1.0, "c": 0.0}


def test_file_rules(spark, tmp_path):
    (tmp_path / "good.tsv").write_text("s1_id\tmatched_entity_ids\nS1-1\tS2-1,S3-2\nS1-2\t\n")
    (tmp_path / "bad.tsv").write_text("S1-1,S2-1\nS1-2\n\nS1-3\ta\tb\nS1-4\tS2-1, S2-3\nS1-5\tS2-1,\n")
    header = ("s1_id", "matched_entity_ids")
    rules = lambda f: {r["rule"]: r["n"] for r in validate.file_rules(spark, str(tmp_path / f), header).collect()}
    assert set(rules("good.tsv").values()) == {0}
    assert rules("bad.tsv") == {"missing_header": 1, "comma_separated": 1, "malformed_row": 3, "malformed_list": 2}


def test_splits_are_disjoint(spark):
    df = sampling.splits(spark.range(2000).withColumn("s", F.col("id").cast("string")), "s", {"fit": 0.2, "hold": 0.3})
    n = {r["split"]: r["count"] for r in df.groupBy("split").count().collect()}
    assert sum(n.values()) == 2000 and 300 < n["fit"] < 500 and 450 < n["hold"] < 750


def test_em_prior_moves_to_the_share(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 300, 0.95).otherwise(0.02).alias("p"))
    assert models.em_prior(df, "p", 0.1) > 0.25


def test_tsv_round_trip(spark, tmp_path):
    (tmp_path / "r.tsv").write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\nS2-1\tA "quoted" name\t\tUS\nS2-2\t\tx\tIN\n')
    (tmp_path / "t.tsv").write_text("s1\tids\nS1-1\tS2-1,S3-4\nS1-2\t\n")
    r = tsv.read_records(spark, str(tmp_path / "r.tsv"), 2)
    assert [tuple(v) for v in r.orderBy("entity_id").collect()] == [("S2-1", 'A "quoted" name', "", "US", 2), ("S2-2", "", "x", "IN", 2)]
    t = tsv.read_truth(spark, str(tmp_path / "t.tsv"))
    assert {v["s1_id"]: v["rec_ids"] for v in t.collect()} == {"S1-1": ["S2-1", "S3-4"], "S1-2": []}
    assert {v["entity_id"]: v["owner"] for v in tsv.owners(r, t).collect()} == {"S2-1": "S1-1", "S2-2": ""}
    tsv.write_lists(spark.createDataFrame([("S1-1", "S2-1"), ("S1-2", "")], "s1_id string, matched_entity_ids string"), str(tmp_path / "out"), "s1_id", True)
    (part,) = (tmp_path / "out").glob("part-*")
    assert part.read_text() == "s1_id\tmatched_entity_ids\nS1-1\tS2-1\nS1-2\t\n"


def test_whole_run_and_resume(spark, tmp_path, monkeypatch):
    """Every stage is written, a second run trains nothing, and the holdout has no part in any choice."""
    wide = "/root/testdata/sf0.01"
    records, truth = x.records(spark, wide), x.truth(spark, wide).select("s1_id", "rec_id")
    store = Store(spark, str(tmp_path))
    settings = Settings(k=5, keep=10, keep_union=10, min_count=3, trees=2, depth=3, negatives=1.0, bags=2, alias_count=1, thresholds=[0.3, 0.5], margins=[0.0])
    asked, among = [], Run.among
    monkeypatch.setattr(Run, "among", lambda self, df, *groups: asked.append(groups) or among(self, df, *groups))
    run = Run(store, records, truth, settings)
    state = run.decision()
    held = [i for i, g in enumerate(asked) if "holdout" in g]
    assert held and min(held) == len(asked) - len(held)  # only the last step, the score of what was chosen
    ids = {(r["s1_id"], r["rec_id"]) for r in run.chosen().collect()}
    assert {"prune", "judge", "stack", "curve", "refine-0", "refine-1"} == set(run.trained)
    assert all(store.done(store.path(t)) for t in ("prep", "retrieved", "cand", "expanded", "pruned", "judged", "scored", "refine-features", "refined", "chosen"))
    assert state["mode"] in ("threshold", "expected") and 0 <= state["macro_f05"] <= 1 and isinstance(store.get_state("aliases"), dict)
    again = Run(store, records, truth, settings)
    assert {(r["s1_id"], r["rec_id"]) for r in again.chosen().collect()} == ids and again.decision() == state and not again.trained
    s1, pool = run.sides()
    assert validate.passes(validate.validate(decide.match_lists(s1, run.chosen()), s1, pool, decide.match_lists(s1, run.candidate_pairs())))
    assert set(run.diagnosis()) == {"recall", "ceiling", "fates"} and run.errors(5).count() <= 10


def test_groups_are_disjoint(spark):
    run = Run(None, None, None, Settings())
    s1 = spark.range(3000).select(F.concat(F.lit("S1-"), "id").alias("s1_id"))
    parts = [{r["s1_id"] for r in run.among(s1, g).collect()} for g in Settings().groups]
    assert sum(map(len, parts)) == 3000 == len(set().union(*parts)) and all(parts)
    assert {r["s1_id"] for r in run.fitting(s1).where("hold").collect()} == parts[1]


def test_tables_without_rows(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    none = store.stage(store.path("none"), lambda: spark.createDataFrame([], "country string, src long, v double"), ("country", "src"))
    assert none.count() == 0 and set(none.columns) == {"country", "src", "v"}


def test_stream(spark, sf, tmp_path):
    r = x.records(spark, sf).select("entity_id", "src", "country", "business_name", "business_address")
    r.where("src > 1").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(r.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = link_stream(stream, r.where("src = 1"), str(tmp_path / "out"), str(tmp_path / "ck"))
    query.awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() > 0 and out.groupBy("rec_id").count().where("count > 1").count() == 0


def test_mean_pool(spark):
    from kinfold.operators.dense import mean_pool

    df = spark.createDataFrame([([[3.0, 0.0, 9.0], [0.0, 4.0, 9.0], [5.0, 5.0, 5.0]], [1, 1, 0])], "v array<array<double>>, m array<int>")
    assert df.select(mean_pool(F.col("v"), F.col("m"), 2)).first()[0] == pytest.approx([0.6, 0.8])


def test_pairs_carry_no_text(spark, sf):
    """Queries on probabilities alone neither join nor write the records' texts."""
    ids = ["country", "src", "s1_id", "rec_id", "prob"]
    assert x.pairs(spark, sf).columns == ids
    plan = QUERIES["match_lists"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "rec_name_lat" not in plan and "rec_addr_norm" not in plan
    few = x.scored(spark, sf, "nums")
    assert few.columns == [*ids, "s1_nums", "rec_nums"]
    wide = x.scored(spark, sf)
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, wide.select(few.columns).collect())) and wide.count() == x.pairs(spark, sf).count()


def test_pairs_of_blocks_are_tasks_of_their_own(spark):
    schema = "country string, src long, {} string, name_core string, addr_norm string"
    held = spark.createDataFrame(_texts(50, 2), schema.format("rec_id"))
    out = blocking.nearest(spark.createDataFrame(_texts(50, 1), schema.format("s1_id")).drop("src"), held, ["name_core", "addr_norm"], 5, 0.5)
    parts = blocking._PARTS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert out._jdf.queryExecution().optimizedPlan().toString().count(f", {parts}") == 2


def test_records_of_a_block_in_parts():
    """Pairs that can't be among the best any more are left out early, but no other; owners neither."""
    import pyarrow as pa

    rng = random.Random(5)
    word = lambda: rng.choice("abcdefghij") if rng.random() < 0.7 else str(rng.randrange(40))
    text = lambda most: " ".join(word() for _ in range(rng.randrange(most)))
    asked, held = ([(text(5), text(8)) for _ in range(m)] for m in (90, 400))
    found = {}
    for i, mine in enumerate(asked):
        for j, theirs in enumerate(held):
            both = [(len({*a.split()} & {*b.split()}), len({*a.split()} | {*b.split()})) for a, b in zip(mine, theirs)]
            if any(5 * c >= u and c for c, u in both):
                found[i, j] = round(sum(0.5 * (c / u if u else 0.0) for c, u in both), 6)
    want = {(i, j, p, False) for a in range(90) for i, j, p in sorted(((i, j, p) for (i, j), p in found.items() if i == a), key=lambda r: (-r[2], r[1]))[:4]}
    for b in range(400):
        want |= {(i, j, p, True) for i, j, p in sorted(((i, j, p) for (i, j), p in found.items() if j == b and p >= 0.5), key=lambda r: (-r[2], r[0]))[:1]}
    sides = [[pa.chunked_array([[r[c] for r in rows]]) for c in (0, 1)] for rows in (asked, held)]
    for at_once in (1, 13, 100, 1000):
        out = blocking._nearest(*sides, 90, 400, 4, 0.5, (1, 5), at_once)
        assert len(out[0]) == len(want) and {*zip(*(c.tolist() for c in out))} == want


def test_sizes_of_blocks_move_no_rows(spark):
    """Rows aren't gathered by country and source before they are dealt to blocks."""
    schema = "country string, src long, {} string, name_core string, addr_norm string"
    asked, held = spark.createDataFrame(_texts(50, 1), schema.format("s1_id")).drop("src"), spark.createDataFrame(_texts(50, 2), schema.format("rec_id"))
    q, d = blocking._dealt(asked.withColumn("src", F.lit(2).cast("long")), held, ["country", "src"], "s1_id", "rec_id", 8192, 32768)
    for side in (q, d):
        assert side._jdf.queryExecution().optimizedPlan().toString().count("strategy=broadcast") == 2


def test_pairs_for_models_are_made_once(spark, sf):
    """A fit goes through them many times: neither joins nor texts are left in what it reads."""
    from kinfold.plans import model_queries

    pairs = model_queries._pairs(spark, sf)
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "array_intersect" not in plan
    words = lambda t: set(t.split(" "))
    for r in x.scored(spark, sf).join(pairs.drop("prob"), ["country", "src", "s1_id", "rec_id"]).collect():
        assert (r["tok"], r["adr"]) == (len(words(r["s1_name_core"]) & words(r["rec_name_core"])), len(words(r["s1_addr_norm"]) & words(r["rec_addr_norm"])))
        assert r["key_eq"] == (r["s1_name_key"] == r["rec_name_key"])


def test_words_of_queries_are_cut_once_for_all_parts(monkeypatch):
    import pyarrow as pa

    seen, cut = [], blocking._words_of
    monkeypatch.setattr(blocking, "_words_of", lambda texts: seen.append(len(texts)) or cut(texts))
    asked, held = (pa.chunked_array([[f"a b{i}" for i in range(n)]]) for n in (3, 100))
    out = blocking._nearest([asked], [held], 3, 100, 4, 0.5, (1, 5), 16)
    assert len(out[0]) >= 12 and seen.count(3) == 1 and sum(seen) == 103


def test_competition_sorts_by_ids_first(spark):
    """The first bytes of a country are those of most rows."""
    from kinfold.operators import compete

    pairs = spark.createDataFrame([("x", 2, "S1-1", "S2-1", 0.5)], "country string, src long, s1_id string, rec_id string, prob double")
    plan = compete.across_sources(pairs).select("xs_other", "r_other")._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(s1_id#" in plan and "windowspecdefinition(rec_id#" in plan and "windowspecdefinition(country#" not in plan
