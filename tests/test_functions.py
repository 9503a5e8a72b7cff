import hashlib
import math
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinfold.functions import normalize as n
from kinfold.functions import strings, words
from kinfold.functions.segment import Splitter
from kinfold.operators.decide import expected_scores
from kinfold.plans import fixtures

TEXT = st.text(alphabet="abc ", max_size=12)


def naive_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(TEXT, TEXT)
def test_lcs(a, b):
    assert strings.lcs(a, b) == naive_lcs(a, b)
    assert strings.ratio(a, b) == strings.ratio(b, a)


def plain_partial(a, b):
    if not a or not b:
        return 100.0 if a == b else 0.0
    a, b = (a, b) if len(a) <= len(b) else (b, a)
    return max(strings.ratio(a, b[max(0, i) : i + len(a)]) for i in range(1 - len(a), len(b)))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(TEXT, TEXT) | st.tuples(st.text(alphabet="abé日", min_size=50, max_size=140), st.text(alphabet="abé日", max_size=140)), max_size=6))
def test_scores_of_many_pairs_are_those_of_each(pairs):
    assert strings.lcs_all(pairs).tolist() == [naive_lcs(a, b) for a, b in pairs]
    assert strings.ratio_all(pairs).tolist() == [strings.ratio(a, b) for a, b in pairs]
    assert strings.set_all(pairs).tolist() == [strings.token_set_ratio(a, b) for a, b in pairs]
    assert strings.sort_all(pairs).tolist() == [strings.token_sort_ratio(a, b) for a, b in pairs]


@settings(max_examples=100, deadline=None)
@given(TEXT, TEXT)
def test_partial_ratio(a, b):
    assert strings.partial_ratio(a, b) == pytest.approx(plain_partial(a, b))


def test_scores_by_hand():
    assert strings.ratio("abcd", "abxd") == 75.0
    assert strings.token_sort_ratio("b a", "a b") == 100.0
    assert strings.token_set_ratio("acme tools", "acme tools ltd") == 100.0
    assert strings.token_set_ratio("", "a") == 0.0
    assert strings.partial_ratio("huff", "huff and co") == 100.0
    assert strings.jaro_winkler("martha", "marhta") == pytest.approx(0.961111, abs=1e-6)
    assert strings.jaro_winkler("", "") == 0.0


def test_splitter():
    s = Splitter({"akshaya": 20, "gases": 30, "gas": 5, "wilford": 4})
    assert s.text("akshayagases") == "akshaya gases"
    assert s.text("gases wilford unknownwordhere") == "gases wilford unknownwordhere"
    assert Splitter({}).text("akshayagases") == "akshayagases"


def test_phonetic(spark):
    row = spark.range(1).select(n.phonetic(F.lit("maharashtra")).alias("a"), n.phonetic(F.lit("mhaaraassttr")).alias("b")).first()
    assert row["a"] == row["b"] == "mhrstr"


def test_normal_forms_by_hand(spark):
    rows = [(1, "The Acme Manufacturing, Inc.", "12 High Street, Suite 4"), (2, None, None), (3, "S.N.C.F. 5551234567", "22nd Rd"), (4, "日本 GmbH", "St")]
    df = spark.createDataFrame(rows, "id int, business_name string, business_address string")
    got = {r["id"]: r for r in n.normalize(df).collect()}
    assert (got[1]["name_core"], got[1]["legal"], got[1]["addr_norm"], got[1]["nums"]) == ("acme mfg", "inc", "12 high st 4", "12 4")
    assert (got[2]["name_key"], got[2]["addr_missing"], got[2]["native"]) == ("", 1, 0)
    assert (got[3]["name_lat"], got[3]["addr_norm"]) == ("sncf", "22 rd")
    assert (got[4]["native"], got[4]["name_core"]) == (1, "gmbh")


def test_fold_any(spark):
    df = spark.createDataFrame([("Crème BRÛLÉE ß",), ("Ω",), (None,)], "t string")
    assert [r[0] for r in df.select(n.fold_any("t")).collect()] == ["creme brulee ss", "o", ""]


def test_normal_forms_of_any_script(spark):
    """Romanised names and addresses, and the same forms as by Latin folding where that suffices."""
    rows = [(1, "Αλφα Βητα ΕΠΕ", "Οδος 12"), (2, "Société Générale S.A.R.L", "12 High Street"), (3, "ООО Ромашка", "улица 5"), (4, "ﬁne ＡＣＭＥ Ltd", None), (5, "मुंबई ३", "")]
    df = spark.createDataFrame(rows, "id int, business_name string, business_address string")
    got = {r["id"]: r for r in n.normalize(df, any_script=True).collect()}
    latin = {r["id"]: r for r in n.normalize(df).collect()}
    assert got[1]["name_core"].split()[:2] == ["alpha", "beta"] and got[1]["nums"] == "12" and got[1]["native"] == 1
    assert got[2] == latin[2]
    assert got[3]["name_core"].split()[1] == "romashka"
    assert (got[4]["name_core"], got[4]["legal"]) == ("fine acme", "ltd")
    assert got[5]["name_core"].isascii() and got[5]["name_core"].endswith("3")


def test_alias_rewrite(spark):
    w = F.array(*map(F.lit, ["new", "york", "new", "st"]))
    got = spark.range(1).select(n.alias_rewrite(w, {"new york": "ny", "new": "nw", "st": "street"})).first()[0]
    assert got == ["ny", "nw", "street"]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.floats(0, 1), min_size=0, max_size=5))
def test_expected_scores_against_enumeration(p):
    p = np.sort(np.array(p, float))[::-1]
    miss, want = 0.1, np.zeros(len(p) + 1)
    for world in range(2 ** (len(p) + 1)):
        bits = [(world >> i) & 1 for i in range(len(p) + 1)]
        chance = math.prod(q if b else 1 - q for q, b in zip([*p, miss], bits, strict=True))
        total = sum(bits)
        for k in range(len(p) + 1):
            f = float(total == 0) if k == 0 else 1.25 * sum(bits[:k]) / (0.25 * total + k)
            want[k] += chance * f
    assert expected_scores(p, miss) == pytest.approx(want, abs=1e-9)


def _drawn(text):
    found = re.findall("[a-z0-9]+", text)
    longest = sorted(f"{str(99_999 - len(w))[:5]:0>5}{w}" for w in set(found))[:6]
    dealt = sorted(hashlib.md5(w.encode()).hexdigest() + w for w in set(found))[:8]
    return {"words": len(found), "longest": " ".join(w[5:] for w in longest), "dealt": " ".join(w[32:] for w in dealt)}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab1 -é", max_size=40), max_size=6))
def test_drawn_words(texts):
    both = pa.array(["b1 a", *texts])
    assert words.draw(both, 6, 8).to_pylist() == [_drawn(t) for t in both.to_pylist()]
    assert words.draw(both.slice(1), 6, 8).to_pylist() == [_drawn(t) for t in texts]


def test_drawn_words_of_any_length():
    odd = ["", None, "x" * 100_001 + " " + "y" * 100_000 + " a " + "z" * 99_999, "-", "12 12"]
    assert words.draw(pa.array(odd), 6, 8).to_pylist() == [_drawn(t or "") for t in odd]


def test_records_are_drawn_in_batches(spark, sf):
    plan = fixtures._records(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan and plan.count("ArrowEvalPython") == 1


LONG = st.text(alphabet="abé", max_size=150)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(LONG, LONG), max_size=5), LONG)
def test_bit_vectors_of_several_words(pairs, c):
    pairs = [*pairs, *((a, a + c) for a, _ in pairs), *((b + "ab" * 40, c * 2) for _, b in pairs)]
    assert strings.lcs_all(pairs).tolist() == [naive_lcs(*p) for p in pairs]
    assert strings.jaro_all(pairs).tolist() == [strings.jaro_winkler(*p) for p in pairs]


def test_only_very_long_strings_are_compared_alone(monkeypatch):
    alone = []
    monkeypatch.setattr(strings, "lcs", lambda a, b: alone.append(len(a)) or 7)
    monkeypatch.setattr(strings, "jaro_winkler", lambda a, b: alone.append(len(b)) or 0.5)
    pairs = [("ab" * 50, "ba" * 200), ("a" * 512, "ba" * 256), ("ab" * 300, "b" * 513)]
    assert strings.lcs_all(pairs).tolist() == [100, 256, 7] and strings.jaro_all(pairs)[2] == 0.5
    assert alone == [513, 513]


def test_texts_are_folded_in_batches(spark):
    """As ``normalize.fold`` does in the JVM: accents, ligatures, characters that become shorter, and ends of texts."""
    rng = np.random.default_rng(3)
    odd = [chr(c) for c in range(0x80, 0x250)] + list("AZaz09 -İKÅẞⱾℨ中😀́")
    texts = [None, "", "É", "ßæ", "K", "Straße ÆON Œuvre Łódź Ångström ẞX xİy", *("".join(rng.choice(odd, 40)) for _ in range(300))]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = [r["w"].asDict() for r in df.select("i", words.drawn_words(F.col("t"), 6, 8).alias("w")).orderBy("i").collect()]
    plain = [r[0] for r in df.orderBy("i").select(n.fold(F.col("t"))).collect()]
    assert got == [_drawn(t) for t in plain]
    assert words.draw(pa.array(texts).slice(3), 6, 8, fold=True).to_pylist() == got[3:]


def test_digests_of_many_words():
    names = [b"x" * i for i in range(130)] + [str(i).encode() for i in range(9000)]
    want = np.frombuffer(b"".join(hashlib.md5(w).digest() for w in names), ">u8").reshape(-1, 2)
    assert (words._digests(pa.array(names, pa.large_binary())) == want).all()


def test_long_batches_are_cut_in_parts(monkeypatch):
    texts = pa.array(["Añb c", None, "x" * 50 + " 1", "", "É É a", "b-b"])
    want = words.draw(texts, 6, 8, fold=True).to_pylist()
    monkeypatch.setattr(words, "_PART", 7)
    assert words.draw(texts, 6, 8, fold=True).to_pylist() == want


def test_windows_are_not_compared_one_by_one(monkeypatch):
    """All windows of a pair come from one comparison, whatever the lengths in a batch."""
    rng = np.random.default_rng(9)
    text = lambda most, letters: "".join(rng.choice(list(letters), rng.integers(0, most)))
    pairs = [("", ""), ("", "a"), ("ab", "ab"), ("xaby", "ab"), ("a", "b" * 300), ("ab" * 150, "ba" * 20 + "c")]
    pairs += [(text(14, "ab c"), text(16, "abd \0")) for _ in range(150)] + [(text(40, "abcdé "), text(70, "abcdez ")) for _ in range(12)]

    def plain(a, b):
        a, b = sorted((a, b), key=len)
        found = {b[max(0, j) : j + len(a)] for j in range(1 - len(a), len(b))} if a else set()
        return max((200.0 * naive_lcs(a, w) / (len(a) + len(w)) for w in found), default=0.0 if b else 100.0)

    def never(pairs):
        raise AssertionError("a window by itself")

    monkeypatch.setattr(strings, "lcs_all", never)
    for most in (1 << 16, 64):
        monkeypatch.setattr(strings, "_STRANDS", most)
        assert strings.partial_all(pairs).tolist() == [plain(*p) for p in pairs]


def test_number_features_of_one_number_each(spark):
    """They take neither lists nor lambdas, and give what lists of the same numbers give."""
    from kinfold.functions import similarity as sim

    texts = ["7", "07", "12", "112", "3412", "9" * 40, "1" + "0" * 20, "", "12 5"]
    df = spark.createDataFrame([(a, b) for a in texts for b in texts], "a string, b string")
    for r in df.select("a", "b", *(c.alias(n) for n, c in sim.number_overlap(sim.words(F.col("a")), sim.words(F.col("b"))).items())).collect():
        a, b = ({*r[n].split()} for n in "ab")
        gaps = [abs(int(x) - int(y)) for x in a for y in b if all(1 < len(n) <= 38 for n in (x, y))]
        sub = any(x != y and len(x) > 1 and len(y) > 1 and (x.endswith(y) or y.endswith(x)) for x in a for y in b)
        assert tuple(r)[2:] == (len(a & b), round(len(a & b) / len(a | b), 6) if a and b else 0.0, float(min(gaps, default=-1)), int(sub)), r


def test_number_features_split_words_before_the_join(spark, sf):
    from kinfold import catalogue

    plan = catalogue.QUERIES["number_features"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and "split(" not in plan[: plan.index("Join")] and "split(" in plan
