"""Classifiers: held-out accuracy on the shared tables, and odd rows."""

import numpy as np
import pytest
import zstandard

from kinfold.llm import labelled, language, quality, queries, toxicity
from tests.llm.helpers import held_out, messy

WIDE = "/root/testdata/sf0.01"


def area(y, p):
    """Area under the ROC curve."""
    y, p = np.array(y), np.array(p)
    less = (p[y == 1][:, None] > p[y == 0][None]).mean()
    return less + (p[y == 1][:, None] == p[y == 0][None]).mean() / 2


@pytest.mark.parametrize(("name", "label", "least"), [("op2_quality_classifier", "quality", 0.95), ("op4_toxicity", "toxic", 0.8)])
def test_held_out_labels(spark, name, label, least):
    rows = queries.QUERIES[name](spark, WIDE).join(spark.read.parquet(f"{WIDE}/labels.parquet"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == held_out(r["doc_id"], 4, 2) for r in rows)
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert area([r[label] for r in held], [r["score"] for r in held]) > least


def test_held_out_languages(spark):
    docs = spark.read.parquet(f"{WIDE}/documents.parquet")
    rows = queries.QUERIES["op3_language_id"](spark, WIDE).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.97


def test_languages_of_odd_rows(spark):
    p = language.Profiles({"xx": language.profile(["the cat and the dog"]), "yy": language.profile(["der hund und die katze"])})
    df = messy(spark)
    got = {r["doc_id"]: r for r in language.identify(df, p).collect()}
    assert got[3]["lang_pred"] == got[4]["lang_pred"] == got[6]["lang_pred"] == "und" and got[3]["score"] == 0
    assert p.predict(["The dog", "DIE KATZE", "12 34"])[0] == ["xx", "yy", "und"]
    assert language.Profiles({}).predict(["a"])[0] == ["und"]
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert language.identify(none, language.learn(none)).count() == 0


def test_ngrams_by_hand():
    _, rank, gram, alphabet = language.ranked(["Ab ab"])
    assert [language.spelled(int(g), alphabet) for g in gram[np.argsort(rank)]] == ["a", "b", " a", "ab", "b ", " ab", "ab "]


def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in (5, 2, 9, 3, 7, 8, 10, 11, 13, 15)] + [(None, 1, 0), (4, None, None)], "doc_id long, quality int, toxic int")


def test_classifiers_on_odd_rows(spark):
    df, y = messy(spark), labels(spark)
    for out, names in ((quality.score_quality(df, y), ["difference", "quality_score", "quality_predicted"]), (toxicity.score_toxicity(df, y), ["toxicity_score", "toxicity_predicted"])):
        assert out.columns == [*df.columns, *names]
        rows = out.collect()
        assert sorted(map(str, out.select(*df.columns).collect())) == sorted(map(str, df.collect()))
        assert all(0 <= r[names[-2]] <= 1 and r[names[-1]] in (0, 1) for r in rows)
        for texts in ({r[names[-2]] for r in rows if r["doc_id"] == 9}, {r[names[-2]] for r in rows if not (r["text"] or "").strip()}):
            assert len(texts) == 1 or names[0] == "difference"  # white space has a size
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["quality_score"] for r in quality.score_quality(df, none).collect()} == {0.5}
    assert {r["toxicity_score"] for r in toxicity.score_toxicity(df, none).collect()} == {0.0}
    assert quality.score_quality(df.limit(0), y).count() == toxicity.score_toxicity(df.limit(0), y).count() == 0


def test_keep_good_keeps_rows_as_they_are(spark):
    df, y = messy(spark), labels(spark)
    kept = quality.keep_good(df, y)
    want = quality.score_quality(df, y).where("quality_predicted = 1").select(*df.columns)
    assert kept.columns == df.columns
    assert sorted(map(str, kept.collect())) == sorted(map(str, want.collect()))
    assert quality.keep_good(df.limit(0), y).count() == 0


def test_quality_against_plain_compression(spark):
    """Every text's difference by zstandard alone, block by block."""
    df, y = messy(spark), labels(spark)
    model = quality.fit(labelled.sample(df, y, "quality", "doc_id", "text"), labelled.counts(y, "quality", "doc_id"))
    packers = [zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False) for d in (model.good, model.bad)]
    for r in quality.score_quality(df, y).collect():
        raw = (r["text"] or "").encode()
        good, bad = (sum(len(p.compress(raw[a : a + 1024])) for a in range(0, len(raw), 1024)) for p in packers)
        sure = len(raw) / (len(raw) + quality.HALF_SURE)
        x = np.array([[sure * (bad - good) / len(raw), sure * min(good, bad) / len(raw) + (1 - sure) / 2]]) if raw else np.array([[0, 0.5]])
        assert (r["difference"], r["quality_score"]) == pytest.approx((x[0, 0], float(model.curve(x)[0])), abs=1e-9)


def test_long_labelled_texts_are_not_fetched(spark):
    df = spark.createDataFrame([(5, "a" * 50), (2, "b" * 9), (9, "c"), (3, None)], "doc_id long, text string")
    rows = labelled.sample(df, labels(spark), "quality", "doc_id", "text", text_bytes=20)
    assert sorted(t for _, t in rows) == ["b" * 9, "c"]


def test_three_hundred_languages(spark):
    """Each has its own letters; all are learned, whatever their names and sizes."""
    word = lambda k, i: "".join(chr(0x4E00 + 40 * k + (i * j) % 37) for j in range(1, 5))
    rows = [(1000 * k + i, " ".join(word(k, i + j) for j in range(8)), f"lang{k:03}") for k in range(300) for i in range(12 if k < 299 else 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = language.identify(df, language.learn(df, per_language=5)).join(df.select("doc_id", "lang"), "doc_id")
    assert found.where("lang_pred = lang").count() == len(rows)
    names, likes = toxicity.language_words([(0, t, g) for _, t, g in rows], [np.array([k + 1]) for k in range(300) for _ in range(12 if k < 299 else 40)], 301)
    assert len(names) == 300 and (likes[1:].argmax(1) == np.arange(300)).all()
    model = toxicity.Model(np.arange(300), [], np.zeros(0), np.zeros(0), 0.0, names, likes, np.zeros((301, 3)))
    assert (model.likelihoods(np.arange(1, 301), np.arange(301)).argmax(1) == np.arange(300)).all()


def test_repeated_rows_fill_no_profile(spark):
    df = spark.createDataFrame([(1, "aaa bbb", "x")] * 500 + [(i, f"der hund {i}", "y") for i in range(9)], "doc_id long, text string, lang string")
    p = language.learn(df, per_language=3)
    assert set(p.names) <= {"x", "y"} and "y" in p.names


def test_gradient_of_the_network():
    """A step against the gradient lowers the loss."""
    r = np.random.RandomState(0)
    docs = [r.randint(1, 30, r.randint(1, 20)) for _ in range(40)]
    y = np.array([float(7 in d) for d in docs])
    net = toxicity._Net(30, np.zeros(30, np.float32))

    def loss():
        rows, first = np.concatenate(docs), np.concatenate(([0], np.cumsum([len(d) for d in docs])))
        best = [toxicity.pooled(rows, first, t, b) for t, b in zip(net.tables(), np.split(net.p["b"], 3), strict=True)]
        z = np.concatenate(best, axis=1) @ net.p["o"] + net.p["c"]
        return np.logaddexp(0, -(2 * y - 1) * z).mean()

    before = loss()
    for _ in range(150):
        net.step(docs, y, np.ones(len(y)))
    assert loss() < before / 2
