"""The evaluation as one job: pairs to scores, out-of-fold model, metrics, report."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from onoma.operators import evaluate as ev
from onoma.operators import model as md
from onoma.operators.features import FEATURES
from onoma.operators.matchers import BASELINES, LABELS
from onoma.plans import dataset
from onoma.plans.scoring import score_pairs

ALGORITHMS = (*BASELINES, "learned")


def scored_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs with ord, fold, baseline scores and features (plain feature names)."""
    scored = score_pairs(md.numbered(pairs, "pair_id"))
    plain = scored.select(*pairs.columns, "ord", *[F.col(k).alias(f"s_{k}") for k in BASELINES], *[F.col(f"f_{f}").alias(f) for f in FEATURES])
    return plain


def score_sets(df: DataFrame, folds: int = md.FOLDS, *, use_cv: bool = True) -> DataFrame:
    """(algorithm, pair_id, ord, score, label, category): the baselines and the learned arm, long.

    The learned arm's scores are out of fold, or with use_cv false those of one model on its own rows.
    """
    if use_cv:
        wide = md.cross_validated(md.with_folds(df, folds), FEATURES, folds)
    else:
        m = md.fit(df, FEATURES)
        wide = df.withColumn("learned", m.probability([F.col(f) for f in FEATURES]))
    wide = wide.withColumnRenamed("learned", "s_learned")
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("algorithm"), F.col(f"s_{k}").alias("score")) for k in ALGORITHMS]))
    return wide.select("pair_id", "ord", "label", "category", each.alias("x")).select("x.algorithm", "pair_id", "ord", "x.score", "label", "category")


@dataclass
class Analysis:
    """All tables of an evaluation, collected: each has a row per algorithm and little more."""

    profile: list = field(default_factory=list)
    points: dict = field(default_factory=dict)
    tables: dict = field(default_factory=dict)
    bootstrap: dict = field(default_factory=dict)
    fold_losses: list = field(default_factory=list)
    model: md.LogisticModel | None = None


def analyse(pairs: DataFrame, folds: int = md.FOLDS) -> Analysis:
    df = scored_pairs(pairs).cache()
    long = ev.validate(score_sets(df, folds)).cache()
    at = ev.curve(long).cache()
    g = ev.grid(at).cache()
    rows = lambda d: [r.asDict() for r in d.collect()]
    out = Analysis(profile=rows(dataset.profile(pairs).orderBy("label", "category")))
    best = {r["algorithm"]: r for r in rows(ev.with_metrics(ev.operating_points(g)))}
    out.points = best
    bands = {r["algorithm"]: r for r in rows(ev.band_report(at, g))}
    cuts = F.create_map(*[x for k, b in bands.items() for x in (F.lit(k), F.struct(F.lit(float(b["reject_below"])).alias("lo"), F.lit(float(b["approve_at_or_above"])).alias("hi")))])
    cut = cuts[F.col("algorithm")]
    out.tables = {
        "areas": rows(ev.pr_auc(at).join(ev.roc_auc(at), "algorithm")),
        "precision_at_recall": rows(ev.precision_at_recall(at)),
        "at_recall_floor": rows(ev.with_metrics(ev.points_at_recall(g))),
        "zero_fp": rows(ev.with_metrics(ev.zero_fp_points(at))),
        "bands": list(bands.values()),
        "band_sizes": rows(ev.three_bands(long.withColumns({"lo": cut["lo"], "hi": cut["hi"]}), F.col("lo"), F.col("hi"))),
        "sweep": rows(ev.cost_sweep(g)),
        "categories": rows(ev.matched_recall_table(long, g).orderBy("category")),
        "identities": rows(dataset.distinct_people(pairs)),
    }
    ranked = sorted(best.values(), key=lambda r: r["cost_per_pair"])
    if len(ranked) > 1:
        a, b = ranked[0], ranked[1]
        two = long.filter(F.col("algorithm").isin(a["algorithm"], b["algorithm"])).groupBy("ord", "label").pivot("algorithm", [a["algorithm"], b["algorithm"]]).agg(F.first("score"))
        two = two.select("ord", "label", F.col(a["algorithm"]).alias("score_a"), F.col(b["algorithm"]).alias("score_b"))
        out.bootstrap = {"a": a["algorithm"], "b": b["algorithm"], **ev.bootstrap_as_published(two, a["threshold"], b["threshold"])}
    out.fold_losses = [r["final_loss"] for r in md.fold_models(md.with_folds(df, folds), FEATURES, folds).orderBy("fold").collect()]
    out.model = md.fit(df, FEATURES)
    for held in (g, at, long, df):
        held.unpersist()
    return out


def ablation(pairs: DataFrame, folds: int = md.FOLDS) -> list[dict]:
    """Cost of the cheapest threshold without each feature, against that with all; the largest rise first."""
    df = md.with_folds(scored_pairs(pairs), folds).cache()
    g = ev.grid(ev.curve(md.ablation_scores(df, FEATURES, folds), "mask"), "mask")
    best = {r["mask"]: r for r in ev.with_metrics(ev.operating_points(g, "mask")).collect()}
    base, weights = best[""]["cost_per_pair"], dict(md.fit(df, FEATURES).coefficients())
    df.unpersist()
    rows = [
        {"feature": f, "cost_per_pair": best[f]["cost_per_pair"], "delta": best[f]["cost_per_pair"] - base, "fp": best[f]["fp"], "fn": best[f]["fn"], "weight": weights[f]}
        for f in FEATURES
    ]
    return [{"feature": "", "cost_per_pair": base, "delta": 0.0}, *sorted(rows, key=lambda r: -r["delta"])]


def train(spark: SparkSession, pairs: DataFrame, path: str) -> md.LogisticModel:
    m = md.fit(scored_pairs(pairs), FEATURES)
    m.save(path)
    return m


def label_of(algorithm: str) -> str:
    return LABELS[algorithm]
