"""Train and predict: the whole linkage from raw sources to written lists.

Stages that are used more than once are tables, kept per set of parameters
(``sources.stages``), so a run that was stopped goes on where it was.

    python -m linkloom.plans.linkage train   --data DIR --work DIR
    python -m linkloom.plans.linkage predict --data DIR --work DIR --out DIR
    python -m linkloom.plans.linkage validate --data DIR --out DIR [--check-ids]

DIR/train has train_source{1,2,3}.tsv and train_ground_truth.tsv, DIR/test the test sources.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions.text import prepare
from linkloom.operators import blocking, context, decide, expand, features, labels, learn, model, validate
from linkloom.sources import tsv
from linkloom.sources.stages import Stages

DEFAULTS = {"limit": 500_000, "validation": 150_000, "rounds2": 300, "rounds3": 300, "nb_k": 25, "pre_k": blocking.TOP, "max_df": blocking.MAX_DF, "k2": 12, "loss2": 0.003, "least": 100, "depth": 7}
STAGE2 = [*features.CHEAP, *features.BLOCKING, "c_ctx_gap", "c_ctx_rank"]
STAGE3 = [*features.FULL, *features.BLOCKING, "p2", "i_rank", "i_gap", "i_n", "i_sum", "j_rank", "j_gap", "j_n", "j_margin", "sib_nm", "sib_ad", "sib_best", "sib_n90", "n_anchor", "expanded"]


class Linkage:
    """The stages of one data set."""

    def __init__(self, spark: SparkSession, work: str, split: str, left: DataFrame, right: DataFrame, **parameters):
        self.spark, self.split = spark, split
        self.parameters = DEFAULTS | parameters
        self.stages = Stages(spark, work, split=split, **self.parameters)
        self.models = Stages(spark, work, split="train", **self.parameters)
        self.raw_left, self.raw_right = left, right
        self.translit = self.component = None
        self._read = None

    # dictionaries and records
    def learn(self, truth: DataFrame) -> None:
        """Dictionaries from labelled pairs; bounded, and kept as tables."""
        pairs = learn.labelled_records(self.raw_left, self.raw_right, truth)
        self.models.table("translit", lambda: learn.learn_translit(learn.token_align(pairs)))
        self.models.table("component", lambda: learn.learn_component(learn.component_cooc(pairs)))

    def dictionaries(self) -> None:
        read = lambda name: self.spark.read.parquet(self.models.path(name))
        self.translit = learn.as_map(read("translit"), "token", "target")
        self.component = learn.as_map(learn.rekeyed(read("component"), self.translit), "component", "target")

    def _prepared(self, name: str, raw: DataFrame) -> DataFrame:
        return self.stages.table(name, lambda: prepare(raw, self.translit, self.component))

    @property
    def left(self) -> DataFrame:
        return self._prepared("left", self.raw_left)

    @property
    def right(self) -> DataFrame:
        return self._prepared("right", self.raw_right)

    # pairs
    def stage1(self) -> DataFrame:
        make = lambda: context.k_context(blocking.block(self.left, self.right, self.parameters["max_df"], self.parameters["pre_k"]).drop("rank"))
        return self.stages.table("stage1", make)

    def matrix2(self, pairs: DataFrame) -> DataFrame:
        with_features = features.cheap_features(pairs, self.left, self.right)
        return context.name_context(with_features, F.col("c_nm_tset") + F.col("c_ad_tset"))

    def neighbours(self) -> DataFrame:
        return self.stages.table("neighbours", lambda: blocking.neighbours(self.right, self.parameters["nb_k"], self.parameters["max_df"]))

    def expanded(self, pruned: DataFrame, model2) -> DataFrame:
        """Pruned pairs and the near copies of their confident ones."""
        hops = expand.sibling_hop(expand.anchors(pruned), self.neighbours(), pruned)
        new = model.score(model2, self.matrix2(expand.like_siblings(hops, self.right)), STAGE2, "p2")
        keep = ["i", "j", *features.BLOCKING, "p2"]
        return pruned.select(*keep, F.lit(0.0).alias("expanded")).unionByName(new.select(*keep, F.lit(1.0).alias("expanded")))

    def matrix3(self, pairs: DataFrame) -> DataFrame:
        anchor = expand.anchors(pairs)
        like = expand.likeness(expand.anchor_pairs(pairs, anchor), self.right)
        around = context.j_margin(context.competition(expand.sibling_features(pairs, anchor, like)))
        return features.pair_features(around, self.left, self.right)

    # models
    def _model(self, name: str, fit) -> GBTClassificationModel:
        path = self.models.path(name)
        if not self.models.exists(f"{path}/metadata"):
            fit().write().overwrite().save(path)
        return GBTClassificationModel.load(path)

    def train(self, truth: DataFrame) -> dict:
        """Fits both models and finds the decision; returns it."""
        p = self.parameters
        self.learn(truth)
        self.dictionaries()
        true_pairs = self.stages.table("truth", lambda: labels.known_truth(truth, self.left, self.right))
        n = self.left.count()
        v = min(p["validation"], n // 5)
        t = min(p["limit"], n * 2 // 5)
        groups = self.stages.table("groups", lambda: tsv.split_groups(self.left.select("entity_id"), {"A": 0, "T": t, "V": v}, "entity_id").select(F.col("entity_id").alias("i"), "grp"))
        labelled = self.stages.table("labelled", lambda: labels.label_pairs(self.matrix2(self.stage1()), true_pairs).join(groups, "i"))
        first = labelled.where("grp = 'A'")
        how = {"least": p["least"], "depth": p["depth"]}
        oof = self.stages.table("oof", lambda: model.out_of_fold(first, STAGE2, p["rounds2"], **how).select("i", "j", "y", "oof"))
        model2 = self._model("model2", lambda: model.fit(first, STAGE2, p["rounds2"], **how))
        tau = labels.order_statistic(oof.where("y"), "oof", p["loss2"]).first()
        tau2 = float(tau["tau"]) if tau is not None and tau["tau"] is not None else 0.0

        def pruned():
            scored = model.score(model2, labelled, STAGE2, "p2").join(oof.select("i", "j", "oof"), ["i", "j"], "left")
            return model.prune(scored, tau2, p["k2"], "oof").select("i", "j", *features.BLOCKING, "p2")

        pairs = self.stages.table("pruned", pruned)
        pairs = self.stages.table("expanded", lambda: self.expanded(pairs, model2))
        third = self.stages.table("matrix3", lambda: labels.label_pairs(self.matrix3(pairs), true_pairs).join(groups, "i"))
        stop = F.pmod(F.xxhash64("i"), F.lit(10)) == 0  # whole left records, a tenth, say when to stop
        model3 = self._model("model3", lambda: model.fit(third.where("grp = 'T'").withColumn("stop", stop), STAGE3, p["rounds3"], validation="stop", **how))
        held = third.where("grp = 'V'")
        everyone = groups.where("grp = 'V'").select("i")
        known = true_pairs.join(everyone, "i", "left_semi")
        scored = self.stages.table("scored", lambda: decide.exclusive(model.score(model3, held, STAGE3, "p").select("i", "j", "p")))
        rows = [r.asDict() for r in decide.grid(scored, known, everyone).collect()]
        best = max(rows, key=lambda r: (r["f05"], r["mode"] == "exp", -r["tau"]))
        ceiling = decide.f05(held.where("y").select("i", "j"), known, everyone).first()["f05"]
        found = labels.recall(labelled, true_pairs, self.left).first()
        config = {"tau2": tau2, "mode": best["mode"], "tau": best["tau"], "exclusive": True, "val_f05": best["f05"], "ceiling": ceiling, "blocking_recall": found["recall"], "pairs_per_left": found["pairs_per_left"],
                  "importance": model.importance(model3, STAGE3), "k2": p["k2"], "pre_k": p["pre_k"], "max_df": p["max_df"]}
        return self.models.document("config", lambda: config)

    def predict(self, out: str) -> DataFrame:
        """Writes candidates and matches below ``out``; returns the matches."""
        config = self.models.document("config", dict)
        if not config:
            raise RuntimeError("train first, with the same parameters")
        self.dictionaries()
        model2 = GBTClassificationModel.load(self.models.path("model2"))
        model3 = GBTClassificationModel.load(self.models.path("model3"))
        pruned = self.stages.table("pruned", lambda: model.prune(model.score(model2, self.matrix2(self.stage1()), STAGE2, "p2"), config["tau2"], config["k2"]).select("i", "j", *features.BLOCKING, "p2"))
        pairs = self.stages.table("expanded", lambda: self.expanded(pruned, model2))
        tsv.write_tsv(tsv.listed(self.left, pairs, "candidate_entity_ids", "p2"), f"{out}/candidate_pairs.tsv")
        scored = self.stages.table("scored", lambda: model.score(model3, self.matrix3(pairs), STAGE3, "p").select("i", "j", "p"))
        if config["exclusive"]:
            scored = decide.exclusive(scored)
        chosen = decide.select_expected(scored, config["tau"]) if config["mode"] == "exp" else decide.select_threshold(scored, config["tau"])
        lists = tsv.listed(self.left, chosen, "matched_entity_ids")
        tsv.write_tsv(lists, f"{out}/matching_results.tsv")
        return lists


def sources(spark: SparkSession, folder: str, split: str) -> tuple[DataFrame, DataFrame]:
    read = lambda k: tsv.read_tsv(spark, f"{folder}/{split}/{split}_source{k}.tsv")
    return read(1), tsv.union_right(read(2), read(3))


def check(spark: SparkSession, out: str, left: DataFrame, right: DataFrame | None) -> tuple[DataFrame, bool]:
    """Findings about the written lists, and whether they pass; a candidate file may be absent, ids may go unchecked."""
    found, tables = None, {}
    for name, column in (("matching_results", "matched_entity_ids"), ("candidate_pairs", "candidate_entity_ids")):
        path = f"{out}/{name}.tsv"
        if name == "candidate_pairs" and not validate.there(spark, path):
            found, tables[name] = found.unionByName(validate.warned(spark, "no candidate file", path)), None
            continue
        one = validate.file_findings(spark, path, ("source1_entity_id", column))
        found = one if found is None else found.unionByName(one)
        tables[name] = tsv.read_tsv(spark, path, f"source1_entity_id STRING, {column} STRING") if validate.there(spark, path) else None
    if right is None:
        found = found.unionByName(validate.warned(spark, "ids are not checked", "no records of the linked sources"))
    if not found.where("severity = 'fatal'").limit(1).count():
        found = found.unionByName(validate.report(tables["matching_results"], tables["candidate_pairs"], left, right))
    return found, validate.passed(found)


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("command", choices=["train", "predict", "validate"])
    parser.add_argument("--data", required=True)
    parser.add_argument("--work", default="work")
    parser.add_argument("--out", default="out")
    parser.add_argument("--check-ids", action="store_true")
    for name, default in DEFAULTS.items():
        parser.add_argument(f"--{name.replace('_', '-')}", type=type(default), default=default)
    told = parser.parse_args(args)
    spark = SparkSession.builder.appName("linkage").getOrCreate()
    split = "train" if told.command == "train" else "test"
    left, right = sources(spark, told.data, split)
    if told.command == "validate":
        found, ok = check(spark, told.out, left, right if told.check_ids else None)
        found.show(100, truncate=False)
        print("PASS" if ok else "FAIL")
        return 0 if ok else 1
    link = Linkage(spark, told.work, split, left, right, **{k: getattr(told, k) for k in DEFAULTS})
    if told.command == "train":
        print(json.dumps(link.train(tsv.read_tsv(spark, f"{told.data}/train/train_ground_truth.tsv", tsv.TRUTH))))
    else:
        link.predict(told.out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
