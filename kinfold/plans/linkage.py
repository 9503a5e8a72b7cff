"""The whole linkage: normalise, block, fuse, describe, score, judge, stack, refine, decide, evaluate.

Stages are tables, models and states of a ``Store``; one that is there isn't
made again. S1 rows fall into five groups by a hash of their id: models are
trained on the first, stopped early by the second and calibrated on the third;
threshold and margin are chosen on the fourth, and the score that is reported
comes from the fifth, which nothing else has seen.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.functions import similarity as sim
from kinfold.functions import strings
from kinfold.functions.normalize import first_number, has_alias_marker, normalize
from kinfold.functions.segment import Splitter, collected, segment_key, segmented, vocabulary
from kinfold.operators import aliases, blocking, compete, decide, evaluate, models, refine, sampling, sibling
from kinfold.sources.store import Store

PAIR = ["country", "src", "s1_id", "rec_id"]
VIEWS = ("addr", "addrc", "name", "nword", "skel")
KEYS = ("key", "skel", "seg")
_TEXT = ("name_lat", "name_core", "name_key", "name_skel", "legal", "addr_norm", "nums", "name_seg", "seg_key", "native", "addr_missing", "business_name", "business_address")


@dataclass
class Settings:
    k: int = 25
    keep: int = 45
    keep_union: int = 60
    key_cap: int = 50
    df_cap: int | None = None
    min_count: int = 10
    trees: int = 50
    depth: int = 6
    negatives: float = 0.25
    floor: float = 0.02
    prune_keep: int = 8
    cap: int = decide.CAP
    miss_rate: float = decide.MISS_RATE
    expand_threshold: float = 0.9
    expand_per_s1: int = 4
    judge_low: float = 0.03
    judge_high: float = 0.97
    bags: int = 3
    prior_shift: bool = True
    mine_aliases: bool = True
    alias_count: int = aliases.LEAST_COUNT
    cand_from: str = "union"
    groups: dict[str, float] = field(default_factory=lambda: {"train": 0.5, "validate": 0.1, "calibrate": 0.15, "tune": 0.1, "holdout": 0.15})
    thresholds: list[float] = field(default_factory=lambda: [round(0.05 * i, 2) for i in range(6, 19)])
    margins: list[float] = field(default_factory=lambda: [0.0, 0.02, 0.05, 0.1])


def prepare(records: DataFrame, names: DataFrame | None = None, settings: Settings | None = None, aliases: dict[str, str] | None = None) -> DataFrame:
    """Records with normal forms and segmented names; the vocabulary is mined from ``names`` (default: the S1 rows)."""
    s = settings or Settings()
    df = normalize(records, aliases=aliases, any_script=True)
    vocab = collected(vocabulary(names if names is not None else records.where("src = 1"), min_count=s.min_count))
    df = df.withColumn("name_seg", segmented(F.col("name_lat"), Splitter(vocab)))
    return df.withColumn("seg_key", segment_key(F.col("name_seg")))


def split(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return df.where("src = 1").withColumnRenamed("entity_id", "s1_id").drop("src"), df.where("src > 1").withColumnRenamed("entity_id", "rec_id")


def candidates(s1: DataFrame, pool: DataFrame, settings: Settings, dense: DataFrame | None = None) -> DataFrame:
    """Pairs of all views: five sparse ones, three keys, and a dense one if it is given."""
    address, name = F.col("addr_norm"), F.col("name_core")
    terms = {
        "addr": blocking.word_terms(address, 2), "addrc": blocking.char_terms(address, 4, 4), "name": blocking.char_terms(name),
        "nword": blocking.word_terms(name), "skel": blocking.char_terms(F.col("name_skel")),
    }
    views = blocking.sparse_views(s1, pool, terms, settings.k, cap=settings.df_cap, least={"addrc": 2, "name": 2, "skel": 2})
    columns = {"key": "name_key", "skel": "name_skel", "seg": "seg_key"}
    flags = {k: blocking.key_join(s1, pool, columns[k], settings.key_cap) for k in KEYS}
    lexical = blocking.fuse(views, VIEWS, flags, settings.keep)
    none = lexical.select(*PAIR, F.lit(None).cast("int").alias("rank"), F.lit(None).cast("double").alias("score")).where(F.lit(False))
    return blocking.unite(lexical, dense if dense is not None else none, settings.keep_union)


def described(pairs: DataFrame, s1: DataFrame, pool: DataFrame) -> DataFrame:
    """Pairs with both sides' columns and all pair and retrieval features."""
    a = s1.select("s1_id", *(F.col(c).alias(f"a_{c}") for c in _TEXT))
    b = pool.select("rec_id", *(F.col(c).alias(f"b_{c}") for c in _TEXT))
    df = pairs.join(a, "s1_id").join(b, "rec_id")
    w = lambda c: sim.words(F.col(c))
    cols = sim.overlap(w("a_name_core"), w("b_name_core"), "tok") | sim.overlap(w("a_addr_norm"), w("b_addr_norm"), "adr", True)
    cols |= sim.number_overlap(w("a_nums"), w("b_nums")) | sim.legal_flags(F.col("a_legal"), F.col("b_legal"))
    la, lb = F.length("a_name_lat"), F.length("b_name_lat")
    cols |= {
        "key_eq": (F.col("a_name_key") == F.col("b_name_key")).cast("int"), "skel_eq": (F.col("a_name_skel") == F.col("b_name_skel")).cast("int"),
        "seg_key_eq": (F.col("a_seg_key") == F.col("b_seg_key")).cast("int"), "len_ratio": (la + 1) / (lb + 1), "len_absdiff": F.abs(la - lb),
        "a_missing": F.col("a_addr_missing"), "b_missing": F.col("b_addr_missing"),
        "sim": compete.similarity([f"sc_{v}" for v in VIEWS] + ["cos_dense"]),
    }
    df = compete.retrieval(df.withColumns(cols))
    scores = (*strings.PAIR_SCORES, ("seg_tset", "name_seg", "token_set"))
    return df.withColumn("__f", strings.pair_scores("a_", "b_", scores)).select(*df.columns, "__f.*")


# Names of model inputs, which are columns of the operators' outputs.
PAIR_FEATURES = [
    *(f"rank_{v}" for v in VIEWS), *(f"sc_{v}" for v in VIEWS), *(f"in_{k}" for k in KEYS), "n_views", "rrf", "cos_dense", "rank_dense", "fused",
    "tok_inter", "tok_jac", "tok_contain", "tok_extra_a", "tok_extra_b", "adr_inter", "adr_jac", "adr_contain", "adr_extra", "num_inter", "num_jac", "num_mindiff", "num_sub",
    "legal_eq", "legal_conflict", "key_eq", "skel_eq", "seg_key_eq", "len_ratio", "len_absdiff", "a_missing", "b_missing", "a_native", "b_native", "src",
    "sim", "rec_best", "rec_n", "rec_margin", "s1_rank", "s1_best", "s1_gap", *(n for n, _, _ in strings.PAIR_SCORES), "seg_tset",
]
STAGE_TWO = [
    "prob1", "p_rank", "p_best", "p_gap", "p_sum", "p_cnt", "pa_best", "pa_sum", "pa_cnt", "pa_gap", "d_best", "d_gap", "d_n", "d_cnt",
    "sib_cnt", "sib_mean", "sib_max", "oth_best", "oth_cnt", "xs_rank", "xs_n50", "xs_n90", "xs_other", "xs_other_src", "r_other", "r_n50", "r_rank",
]
JUDGED = ["ce_logit", "ce_run"]
REFINED = [
    "prob", "logit", "src", "name_tset", "addr_tset", "a_missing", "b_missing", "a_num", "legal_agree", "a_extra", "a_drop",
    "xs_rank", "xs_n50", "xs_n90", "xs_sum", "xs_other", "xs_other_src", "r_other", "r_n50", "r_rank",
    "k_pool_rec", "k_pool_s1", "k_addr_rec", "k_s1a_rec", "k_s1a_s1", "k_s1a_rec_other", "a_nm_idf", "a_nm_idf_miss", "a_ad_idf", "a_ad_idf_miss",
    "m_cnt", "m_nm_max", "m_nm_mean", "m_nm_wmax", "m_nm_eq", "m_ad_max", "m_num_has", "m_num_agree", "m_num_dis", "m_x_nm_max", "m_leg_has", "m_leg_agree",
    "cons_num", "cons_legal", "rec_oov", "s1_oov", "rec_alias", "s1_alias",
]


def late(pairs: DataFrame, pool: DataFrame, prob: str = "prob1") -> DataFrame:
    """Competition and sibling features of first-stage probabilities; made before any sampling."""
    members = sibling.groups(pool)
    out = sibling.leave_one_out(pairs, members, prob)
    return compete.across_sources(compete.other_source(compete.stage_two(out, prob), prob), prob)


def evidence(pairs: DataFrame, s1_all: DataFrame, pool: DataFrame, prob: str = "prob") -> DataFrame:
    """Scored pairs that carry both sides' columns (a_*, b_*), with competition, agreement and vocabulary evidence."""
    df = compete.across_sources(pairs.drop(*(c for c in pairs.columns if c.startswith(("xs_", "r_")))), prob)
    agree = sim.agreement(*(F.col(c) for c in ("a_name_core", "b_name_core", "a_nums", "b_nums", "a_legal", "b_legal")))
    words = vocabulary(s1_all, min_count=1)
    for rows, own, name in ((pool, "rec_id", "rec_oov"), (s1_all, "s1_id", "s1_oov")):
        df = df.join(refine.oov_share(rows, words, [own], "name_core").withColumnRenamed("oov", name), own)
    return df.withColumns(
        {
            "a_num": agree["a_num"], "legal_agree": agree["a_legal"], "a_extra": agree["a_extra"], "a_drop": agree["a_drop"],
            "rec_alias": has_alias_marker(F.col("b_business_name")).cast("int"), "s1_alias": has_alias_marker(F.col("a_business_name")).cast("int"),
            "rec_name": F.col("b_name_core"), "rec_addr": F.col("b_addr_norm"), "rec_legal": F.col("b_legal"), "rec_num": first_number(F.col("b_nums")), "s1_num": first_number(F.col("a_nums")),
            "s1_key": F.col("a_name_key"), "rec_key": F.col("b_name_key"), "s1_legal": F.col("a_legal"), "logit": refine.logit(F.col(prob)),
        }
    )


def weights(pairs: DataFrame, s1_all: DataFrame, pool: DataFrame) -> DataFrame:
    """``pairs`` with how rare their keys are, and similarities by the rarity of words."""
    df = refine.rarity(pairs, s1_all, pool)
    df = refine.weighted_jaccard(df, pool, "name_core", "a_name_core", "b_name_core", "a_nm_idf")
    return refine.weighted_jaccard(df, pool, "addr_norm", "a_addr_norm", "b_addr_norm", "a_ad_idf")


def cluster(pairs: DataFrame, prob: str = "prob") -> DataFrame:
    """``pairs`` against the query's other confident records."""
    token_set = lambda a, b: strings.score("token_set", a, b)
    df = refine.mates(pairs, token_set, token_set, prob)
    df = refine.consensus(df, "s1_num", "rec_num", -1.0, "cons_num", prob)
    return refine.consensus(df, "s1_legal", "rec_legal", "", "cons_legal", prob)


def labelled(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """``pairs`` with y: whether the record belongs to the query."""
    mark = truth.select("s1_id", "rec_id").distinct().withColumn("y", F.lit(1))
    return pairs.join(mark, ["s1_id", "rec_id"], "left").na.fill(0, ["y"])


class Run:
    """One linkage run over a store; every stage makes those it needs."""

    def __init__(self, store: Store, records: DataFrame, truth: DataFrame, settings: Settings | None = None, force: bool = False):
        self.store, self.records, self.truth, self.s, self.force = store, records, truth, settings or Settings(), force
        self.trained: list[str] = []  # what this run had to fit
        self._fresh: set[str] = set()

    def table(self, name: str, make: Callable[[], DataFrame], by: tuple[str, ...] = ("country", "src")) -> DataFrame:
        """A stage's table; with ``force`` it is made anew, once."""
        path = self.store.path(name)
        again = self.force and name not in self._fresh
        self._fresh.add(name)
        return self.store.stage(path, make, by, again)

    def model(self, name: str, load: Callable[[str], object], fit: Callable[[str], object]):
        """A saved model, or one that is fitted, saved and marked."""
        path = self.store.path("models", name)
        if self.store.marked(path) and not (self.force and name not in self._fresh):
            return load(path)
        self._fresh.add(name)
        made = fit(path)
        self.store.mark(path)
        self.trained.append(name)
        return made

    def trees(self, name: str, columns: list[str], rows: Callable[[], DataFrame], validate: bool = True, seed: int = 0) -> models.Trees:
        """Boosted trees on the rows that ``rows`` gives, with y and the boolean hold of rows that only stop the training."""
        new = models.Trees(columns, self.s.trees, self.s.depth, least_rows=5, seed=seed)

        def fit(path: str) -> models.Trees:
            new.fit(rows(), "y", validate="hold" if validate else None)
            new.save(path)
            return new

        return self.model(name, new.load, fit)

    def curve(self, name: str, rows: Callable[[], DataFrame], prob: str) -> models.Calibrator:
        state = None if self.force and name not in self._fresh else self.store.get_state(name)
        self._fresh.add(name)
        if state is None:
            state = models.Calibrator().fit(rows(), prob, "y").state()
            self.store.put_state(name, state)
            self.trained.append(name)
        return models.Calibrator.of_state(state)

    def among(self, df: DataFrame, *groups: str) -> DataFrame:
        """Rows whose S1 row is in one of the groups."""
        return sampling.splits(df, "s1_id", self.s.groups, 1).where(F.col("split").isin(*groups)).drop("split")

    def fitting(self, df: DataFrame) -> DataFrame:
        """Rows of the first two groups; hold marks those of the second."""
        out = sampling.splits(df, "s1_id", self.s.groups, 1).where(F.col("split").isin("train", "validate"))
        return out.withColumn("hold", F.col("split") == "validate").drop("split")

    def aliases(self) -> dict[str, str]:
        """Mined address aliases of the training group, if they are asked for."""
        if not self.s.mine_aliases:
            return {}
        found = None if self.force and "aliases" not in self._fresh else self.store.get_state("aliases")
        self._fresh.add("aliases")
        if found is None:
            s1, pool = split(normalize(self.records, any_script=True))
            one = aliases.first_match(self.among(self.truth, "train"))
            pairs = one.join(s1.select("s1_id", F.col("addr_norm").alias("s1_addr")), "s1_id").join(pool.select("rec_id", F.col("addr_norm").alias("rec_addr")), "rec_id")
            found = aliases.greedy(aliases.alias_pairs(aliases.leftovers(pairs), self.s.alias_count))
            self.store.put_state("aliases", found)
        return found

    def sides(self) -> tuple[DataFrame, DataFrame]:
        return split(self.table("prep", lambda: prepare(self.records, settings=self.s, aliases=self.aliases())))

    def union(self) -> DataFrame:
        """Described and labelled candidates."""

        def make() -> DataFrame:
            s1, pool = self.sides()
            return labelled(described(self.table("retrieved", lambda: candidates(s1, pool, self.s)), s1, pool), self.truth)

        return self.table("cand", make)

    def pruner(self) -> models.Trees:
        return self.trees("prune", PAIR_FEATURES, lambda: sampling.keep_positives(self.fitting(self.union()), "y", self.s.negatives, "s1_id", "rec_id"))

    def expanded(self) -> DataFrame:
        """First-stage probabilities of all candidates, and of the address mates of confident ones."""

        def make() -> DataFrame:
            s1, pool = self.sides()
            first = self.pruner()
            known = first.predict(self.union(), "prob1")
            mates = sibling.expand(known, sibling.groups(pool), "prob1", self.s.expand_threshold, self.s.expand_per_s1)
            empty = {c: blocking.MISSING_RANK for c in known.columns if c.startswith("rank_")} | {c: 0.0 for c in known.columns if c.startswith(("sc_",)) or c in ("rrf", "fused", "cos_dense")}
            empty |= {c: 0 for c in known.columns if c.startswith("in_") or c == "n_views"}
            new = self.table("siblings", lambda: mates.withColumns({c: F.lit(v).cast(known.schema[c].dataType) for c, v in empty.items()}))
            more = first.predict(labelled(described(new, s1, pool), self.truth), "prob1")
            return known.withColumn("is_sib", F.lit(0)).unionByName(more.withColumn("is_sib", F.lit(1)))

        return self.table("expanded", make)

    def pruned(self) -> DataFrame:
        """The pairs that go on, with features of all their competitors."""
        return self.table("pruned", lambda: sampling.prune(late(self.expanded(), self.sides()[1]), self.s.floor, self.s.prune_keep, "prob1"))

    def judged(self) -> DataFrame:
        """``pruned`` with the judge's logits of uncertain pairs."""

        def fit(path: str) -> PipelineModel:
            made = models.judge(sampling.gate(self.among(self.pruned(), "train"), self.s.judge_low, self.s.judge_high, "prob1"), PAIR_FEATURES, "y")
            made.write().overwrite().save(path)
            return made

        def make() -> DataFrame:
            return models.judged(self.pruned(), self.model("judge", PipelineModel.load, fit), self.s.judge_low, self.s.judge_high, "prob1")

        return self.table("judged", make)

    def scored(self) -> DataFrame:
        """Calibrated second-stage probabilities."""

        def make() -> DataFrame:
            second = self.trees("stack", [*PAIR_FEATURES, *STAGE_TWO, *JUDGED], lambda: self.fitting(self.judged()))
            raw = second.predict(self.judged(), "raw")
            curve = self.curve("curve", lambda: second.predict(self.among(self.judged(), "calibrate"), "raw"), "raw")
            return raw.withColumn("prob", F.round(curve.apply(F.col("raw"), F.col("country")), 6)).drop("raw")

        return self.table("scored", make)

    def features(self) -> DataFrame:
        """Evidence beyond the pair, in three tables, so that no plan holds all of it."""

        def known() -> DataFrame:
            return self.table("refine-pairs", lambda: evidence(self.scored(), *self.sides()))

        def weighed() -> DataFrame:
            return self.table("refine-weights", lambda: weights(known(), *self.sides()))

        return self.table("refine-features", lambda: cluster(weighed()))

    def refined(self) -> DataFrame:
        """The mean of bagged trees on evidence beyond the pair, moved to the share of positives that it implies."""

        def rows() -> DataFrame:
            return self.among(self.features(), "train", "validate", "calibrate")

        def make() -> DataFrame:
            bags = [self.trees(f"refine-{i}", REFINED, rows, False, i) for i in range(self.s.bags)]
            out = models.bagged(self.features().withColumnRenamed("prob", "stacked").withColumn("prob", F.col("stacked")), bags, "prob")
            if self.s.prior_shift:
                share = rows().agg(F.avg("y")).first()[0]
                out = models.prior_shift(out, share) if share and 0 < share < 1 else out
            return out.select(*PAIR, F.round("prob", 6).alias("prob"), "stacked", "y")

        return self.table("refined", make)

    def cross_checked(self) -> DataFrame:
        """Log loss of two refiners, each on the fold that it wasn't trained on, and of the probability that they refine."""
        out, _ = models.cross_fit(self.among(self.features(), "train", "validate", "calibrate"), lambda: models.Trees(REFINED, self.s.trees, self.s.depth, least_rows=5), "y", ["s1_id", "country"])
        return models.log_loss(out, "prob_oof", "y", "fold", before="prob")

    def grid(self) -> DataFrame:
        """Macro F0.5 of every threshold and margin, on the tuning group."""
        s1 = self.among(self.sides()[0], "tune")
        return decide.tune(self.among(self.refined(), "tune"), self.among(self.truth, "tune"), s1, self.s.thresholds, self.s.margins, cap=self.s.cap)

    def score(self, chosen: DataFrame, group: str) -> float:
        s1 = self.among(self.sides()[0], group)
        return evaluate.macro(evaluate.by_query(s1, self.among(chosen, group), self.among(self.truth, group))).first()["macro_f05"]

    def decision(self) -> dict:
        """mode, threshold and margin, chosen on the tuning group, and macro_f05 of the group that nothing has seen."""
        found = None if self.force and "decision" not in self._fresh else self.store.get_state("decision")
        self._fresh.add("decision")
        if found is None:
            top = self.grid().orderBy(F.desc("macro_f05"), "threshold", "margin").first()
            found = {"mode": "threshold", "threshold": top["threshold"], "margin": top["margin"], "tuned_f05": top["macro_f05"]}
            wise = self.score(self.select(found | {"mode": "expected"}), "tune")
            if wise is not None and wise > top["macro_f05"]:
                found |= {"mode": "expected", "tuned_f05": wise}
            found["macro_f05"] = self.score(self.select(found), "holdout")
            self.store.put_state("decision", found)
        return found

    def select(self, how: dict) -> DataFrame:
        out = decide.select(self.refined(), how["mode"], how["threshold"], how["margin"], self.s.cap, self.s.miss_rate)
        return out.select(*PAIR, "prob")

    def chosen(self) -> DataFrame:
        return self.table("chosen", lambda: self.select(self.decision()))

    def candidate_pairs(self) -> DataFrame:
        """The candidates that are reported: those that were scored, or all retrieved ones and these."""
        scored = self.refined().select("s1_id", "rec_id")
        return scored if self.s.cand_from == "scored" else self.union().select("s1_id", "rec_id").unionByName(scored).distinct()

    def diagnosis(self) -> dict[str, DataFrame]:
        """Recall by view, ceiling, and where true pairs of the holdout were lost."""
        s1, pool = self.sides()
        s1, known = self.among(s1, "holdout"), self.union()
        true = self.among(self.truth, "holdout").join(pool.select("rec_id", "src"), "rec_id").join(s1.select("s1_id", "country"), "s1_id")
        views = {v: F.col(f"rank_{v}") < blocking.MISSING_RANK for v in VIEWS} | {k: F.col(f"in_{k}") == 1 for k in KEYS}
        fates = evaluate.taxonomy(true, known, self.refined(), self.chosen())
        return {"recall": evaluate.view_recall(known, true, views), "ceiling": evaluate.ceiling(s1, known, true), "fates": evaluate.fate_shares(fates, "country", "src")}

    def errors(self, n: int = 300) -> DataFrame:
        """The most probable wrong pairs and the least probable missed ones of the holdout, ``n`` of each."""
        pairs = self.among(self.refined(), "holdout").join(self.chosen().select(*PAIR, F.lit(1).alias("taken")), PAIR, "left").na.fill(0, ["taken"])
        wrong = pairs.where("taken = 1 and y = 0").withColumns({"kind": F.lit("wrong"), "order": -F.col("prob")})
        missed = pairs.where("taken = 0 and y = 1").withColumns({"kind": F.lit("missed"), "order": F.col("prob")})
        return sampling.inspection(wrong.unionByName(missed), "kind", "order", n).drop("order")

    def pseudo(self) -> DataFrame:
        return self.table("pseudo", lambda: decide.mutual_best(self.refined().select(*PAIR, "prob")))


def link(store: Store, records: DataFrame, truth: DataFrame, settings: Settings | None = None, force: bool = False) -> DataFrame:
    """The chosen pairs of a whole run; the state ``decision`` holds how they were chosen and what the holdout scores."""
    return Run(store, records, truth, settings, force).chosen()
