"""Evaluation of scores against labels, all from one table: the threshold curve.

Rows of (algorithm, score, label) are folded to one row per distinct score. Running sums from the top
give the confusion at every decision "score >= threshold", and every metric is an aggregate over
those rows. Windows run inside a range of distinct scores of an algorithm.
"""

from __future__ import annotations

import math
import random

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Costs of the two errors, levels and targets of the report.
COST_FP, COST_FN = 1.0, 25.0
RECALL_LEVELS = (0.50, 0.70, 0.90, 0.95, 0.99)
RECALL_FLOOR, TARGET_PRECISION = 0.90, 0.99
COST_RATIOS = (1, 3, 5, 10, 25, 50, 100)
ABOVE = 1e-9
BOOTSTRAP_ROUNDS, BOOTSTRAP_SEED = 2000, 20260101
#: Rows of an evaluation set that the published draws take.
MOST_BOOTSTRAP_ROWS = 100_000
NAN = float("nan")


def violations(scored: DataFrame) -> DataFrame:
    """Counts of rows that can't be evaluated: scores that are not finite, labels other than 0 and 1."""
    s = F.col("score")
    return scored.agg(
        F.count_if(s.isNull() | F.isnan(s) | (F.abs(s) == float("inf"))).alias("bad_scores"),
        F.count_if(F.col("label").isNull() | ~F.col("label").isin(0, 1)).alias("bad_labels"),
    )


def validate(scored: DataFrame) -> DataFrame:
    bad = violations(scored).first()
    if bad["bad_scores"] or bad["bad_labels"]:
        raise ValueError(f"scores must be finite and labels 0 or 1: {bad.asDict()}")
    return scored


def score_all(rows: DataFrame, scores: dict[str, Column]) -> DataFrame:
    """Rows once for each scorer: (algorithm, score) and all columns of ``rows``."""
    each = F.array(*[F.struct(F.lit(k).alias("algorithm"), c.cast("double").alias("score")) for k, c in scores.items()])
    return rows.select("*", F.explode(each).alias("__x")).select("__x.algorithm", "__x.score", *rows.columns)


def _ratio(a: Column, b: Column, otherwise: float) -> Column:
    return F.when(b != 0, a / F.nullif(b, F.lit(0)).cast("double")).otherwise(F.lit(otherwise))


def precision(tp: Column = None, fp: Column = None) -> Column:
    """NaN if nothing is predicted."""
    tp, fp = (F.col("tp"), F.col("fp")) if tp is None else (tp, fp)
    return _ratio(tp, tp + fp, NAN)


def recall() -> Column:
    return _ratio(F.col("tp"), F.col("tp") + F.col("fn"), 0.0)


def f1() -> Column:
    p, r = precision(), recall()
    return F.when(F.isnan(p), F.lit(NAN)).when(p + r == 0, 0.0).otherwise(2 * p * r / F.nullif(p + r, F.lit(0.0)))


def accuracy() -> Column:
    return _ratio(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn"), 0.0)


def cost(fp_cost: float | Column = COST_FP, fn_cost: float | Column = COST_FN) -> Column:
    return F.col("fp") * fp_cost + F.col("fn") * fn_cost


def cost_per_pair(fp_cost: float | Column = COST_FP, fn_cost: float | Column = COST_FN) -> Column:
    """Infinite without rows."""
    n = F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")
    return F.when(n > 0, cost(fp_cost, fn_cost) / F.nullif(n, F.lit(0))).otherwise(F.lit(float("inf")))


def with_metrics(points: DataFrame) -> DataFrame:
    return points.withColumns({"precision": precision(), "recall": recall(), "f1": f1(), "accuracy": accuracy(), "cost": cost(), "cost_per_pair": cost_per_pair()})


def confusion_at(scored: DataFrame, threshold: float | Column, by: str = "algorithm") -> DataFrame:
    """(by, tp, fp, tn, fn) of the decision score >= threshold."""
    yes, true = F.col("score") >= threshold, F.col("label") == 1
    return scored.groupBy(by).agg(
        F.count_if(yes & true).alias("tp"), F.count_if(yes & ~true).alias("fp"),
        F.count_if(~yes & ~true).alias("tn"), F.count_if(~yes & true).alias("fn"),
    )


def _score_cuts(at: DataFrame, buckets: int) -> list[float]:
    """At most ``buckets`` - 1 scores that cut the rows of ``at`` into parts of about one size."""
    shares = [k / buckets for k in range(1, buckets)]
    if not shares:
        return []
    found = at.agg(F.percentile_approx("score", shares, 10_000).alias("c")).first()["c"]
    return sorted({x for x in found or [] if math.isfinite(x)})


def curve(scored: DataFrame, by: str = "algorithm", buckets: int | None = None) -> DataFrame:
    """One row per distinct score: pos, neg at it; tp, fp, tn, fn of accepting it and all above; its neighbours.

    ``below``, ``pos_below`` and ``neg_below``: the next lower score and its rows; ``above``: the next higher
    one. Scores are cut into ``buckets`` ranges (the session's shuffle partitions) of about as many distinct
    scores each. Running sums stay inside a range, and what lies above it is added from one row per range,
    so that no task sorts more than a range, however few algorithms there are.
    """
    at = scored.groupBy(by, "score").agg(F.sum("label").cast("long").alias("pos"), F.sum(1 - F.col("label")).cast("long").alias("neg"))
    buckets = buckets or int(at.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = _score_cuts(at, buckets)
    cut_up = Bucketizer(splits=[-math.inf, *(cuts or [0.0]), math.inf], inputCol="score", outputCol="__b", handleInvalid="keep")
    placed = cut_up.transform(at)

    at_top = F.max_by(F.struct("score", "pos", "neg"), "score").alias("top")
    ranges = placed.groupBy(by, "__b").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"), F.min("score").alias("low"), at_top)
    down = W.partitionBy(by).orderBy(F.desc("__b"))
    before, whole = down.rowsBetween(W.unboundedPreceding, -1), W.partitionBy(by)
    ranges = ranges.select(
        by, "__b",
        F.coalesce(F.sum("p").over(before), F.lit(0)).alias("p0"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"),
        F.sum("p").over(whole).alias("p_all"), F.sum("n").over(whole).alias("n_all"),
        F.lead("top").over(down).alias("next"), F.lag("low").over(down).alias("last"),
    )
    inside = W.partitionBy(by, "__b").orderBy(F.desc("score"))
    upto = inside.rowsBetween(W.unboundedPreceding, 0)
    sums = placed.select(
        by, "__b", "score", "pos", "neg", F.sum("pos").over(upto).alias("p"), F.sum("neg").over(upto).alias("n"),
        F.lead(F.struct("score", "pos", "neg")).over(inside).alias("after"), F.lag("score").over(inside).alias("prior"),
    )
    # one row per range and algorithm
    joined = sums.join(F.broadcast(ranges), [by, "__b"])
    tp, fp = F.col("p0") + F.col("p"), F.col("n0") + F.col("n")
    beside = F.coalesce("after", "next")
    return joined.select(
        by, "score", "pos", "neg", tp.alias("tp"), fp.alias("fp"), (F.col("n_all") - fp).alias("tn"), (F.col("p_all") - tp).alias("fn"),
        beside["score"].alias("below"), beside["pos"].alias("pos_below"), beside["neg"].alias("neg_below"), F.coalesce("prior", "last").alias("above"),
    )


def grid(at: DataFrame, by: str = "algorithm") -> DataFrame:
    """Candidate thresholds with their confusion; at: curve.

    kind: ``all`` (the lowest score), ``mid`` (between neighbours), ``top`` (the highest score) and
    ``none`` (just above it). A midpoint of doubles that lie next to each other may fall on the lower
    one, and then admits it.
    """
    cells = ["tp", "fp", "tn", "fn"]
    low, top = F.col("below").isNull(), F.col("above").isNull()
    mid = (F.col("score") + F.col("below")) / 2.0
    falls = mid <= F.col("below")
    # what accepting the lower score too would give
    after = {"tp": F.col("tp") + F.col("pos_below"), "fp": F.col("fp") + F.col("neg_below")}
    after |= {"tn": F.col("tn") - F.col("neg_below"), "fn": F.col("fn") - F.col("pos_below")}
    up = F.expr("cast(java_method('java.lang.Math', 'nextUp', score) AS double)")
    nothing = {"tp": F.lit(0), "fp": F.lit(0), "tn": F.col("tn") + F.col("fp"), "fn": F.col("fn") + F.col("tp")}

    def point(threshold: Column, counts: dict[str, Column], kind: str) -> Column:
        return F.struct(threshold.alias("threshold"), *[counts[c].cast("long").alias(c) for c in cells], F.lit(kind).alias("kind"))

    own = {c: F.col(c) for c in cells}
    points = F.array(
        F.when(low, point(F.col("score"), own, "all")),
        F.when(~low, point(mid, {c: F.when(falls, after[c]).otherwise(F.col(c)) for c in cells}, "mid")),
        F.when(top, point(F.col("score"), own, "top")),
        F.when(top, point(up, nothing, "none")),
    )
    return at.select(by, F.explode(F.filter(points, lambda x: x.isNotNull())).alias("x")).select(by, "x.*")


POINT = ["threshold", "tp", "fp", "tn", "fn"]


def _pick(rows: DataFrame, by: list[str], key: list[Column], *, first: bool = True) -> DataFrame:
    chosen = (F.min_by if first else F.max_by)(F.struct(*POINT), F.struct(*[k.alias(f"k{n}") for n, k in enumerate(key)]))
    return rows.groupBy(*by).agg(chosen.alias("p")).select(*by, "p.*")


def operating_points(g: DataFrame, by: str = "algorithm", fp_cost: float = COST_FP, fn_cost: float = COST_FN) -> DataFrame:
    """The cheapest threshold; ties go to fewer false positives, then to the higher threshold."""
    return _pick(g, [by], [cost(fp_cost, fn_cost), F.col("fp"), -F.col("threshold")])


def cost_sweep(g: DataFrame, by: str = "algorithm", ratios: tuple = COST_RATIOS) -> DataFrame:
    """The cheapest threshold for each cost of a false negative."""
    each = g.withColumn("ratio", F.explode(F.array(*[F.lit(float(r)) for r in ratios])))
    best = _pick(each, [by, "ratio"], [cost(1.0, F.col("ratio")), F.col("fp"), -F.col("threshold")])
    return best.withColumn("cost_per_pair", cost_per_pair(1.0, F.col("ratio")))


def points_at_recall(g: DataFrame, floor: float = RECALL_FLOOR, by: str = "algorithm", *, by_cost: bool = True) -> DataFrame:
    """The cheapest threshold among those with the lowest recall that still reaches the floor.

    ``by_cost=False`` breaks ties by false positives and threshold alone. Without any positive row the
    answer is to accept nothing.
    """
    positives = F.col("tp") + F.col("fn") > 0
    usable = g.filter((positives & (F.col("kind") != "none")) | (~positives & (F.col("kind") == "none")))
    rows = usable.withColumn("r", F.when(positives, recall()).otherwise(1.0))
    reached = rows.filter(F.col("r") + ABOVE >= floor)
    lowest = reached.groupBy(by).agg(F.min("r").alias("lowest"))
    matched = reached.join(F.broadcast(lowest), by).filter(F.col("r") <= F.col("lowest") + ABOVE)
    key = [cost(), F.col("fp"), -F.col("threshold")] if by_cost else [F.col("fp"), -F.col("threshold")]
    found = _pick(matched, [by], key)
    short = _pick(rows.join(lowest, by, "left_anti"), [by], [-F.col("r"), F.col("threshold")])
    return found.unionByName(short)


def zero_fp_points(at: DataFrame, by: str = "algorithm") -> DataFrame:
    """The lowest observed score without false positives; if none, just above all scores."""
    as_point = at.withColumn("threshold", F.col("score"))
    found = _pick(as_point.filter("fp = 0"), [by], [F.col("threshold")])
    top = as_point.groupBy(by).agg(F.max("score").alias("s"), F.max(F.col("tp") + F.col("fn")).alias("p"), F.max(F.col("fp") + F.col("tn")).alias("n"))
    zero = F.lit(0).cast("long")
    none = top.join(found, by, "left_anti").select(by, (F.col("s") + ABOVE).alias("threshold"), zero.alias("tp"), zero.alias("fp"), F.col("n").alias("tn"), F.col("p").alias("fn"))
    return found.unionByName(none)


def zero_fn_points(at: DataFrame, by: str = "algorithm") -> DataFrame:
    """The highest observed score without false negatives."""
    return _pick(at.withColumn("threshold", F.col("score")).filter("fn = 0"), [by], [-F.col("threshold")])


def high_precision_points(g: DataFrame, target: float = TARGET_PRECISION, by: str = "algorithm") -> DataFrame:
    """The lowest threshold of the target precision; else the most precise one, with target_met false."""
    rows = g.filter((F.col("kind") != "none") & (F.col("tp") + F.col("fp") > 0)).withColumn("pr", precision())
    met = _pick(rows.filter(F.col("pr") >= target), [by], [F.col("fn"), F.col("threshold")]).withColumn("target_met", F.lit(True))
    other = _pick(rows.join(met.select(by), by, "left_anti"), [by], [-F.col("pr"), F.col("threshold")])
    return met.unionByName(other.withColumn("target_met", F.lit(False)))


def band_report(at: DataFrame, g: DataFrame, target: float = TARGET_PRECISION, by: str = "algorithm") -> DataFrame:
    """Cut-offs of the three bands, raw and in order, and whether the bands are of use."""
    approve = high_precision_points(g, target, by).select(by, *[F.col(c).alias(f"a_{c}") for c in POINT], "target_met")
    reject = zero_fn_points(at, by).select(by, *[F.col(c).alias(f"r_{c}") for c in POINT])
    j = approve.join(reject, by)
    collapsed = F.col("r_threshold") > F.col("a_threshold")
    approve_empty = F.col("a_tp") + F.col("a_fp") == 0
    reject_empty = F.col("r_tn") + F.col("r_fn") == 0
    return j.select(
        by,
        F.least("r_threshold", "a_threshold").alias("reject_below"), F.greatest("r_threshold", "a_threshold").alias("approve_at_or_above"),
        F.col("r_threshold").alias("raw_reject_below"), F.col("a_threshold").alias("raw_approve_at_or_above"),
        collapsed.alias("bands_collapsed"), approve_empty.alias("approve_band_empty"), reject_empty.alias("reject_band_empty"),
        (~(approve_empty | reject_empty | collapsed)).alias("three_band_pipeline_usable"), F.lit(target).alias("target_precision"),
        precision(F.col("a_tp"), F.col("a_fp")).alias("approve_precision"), F.col("target_met").alias("approve_meets_target"),
        _ratio(F.col("a_tp"), F.col("a_tp") + F.col("a_fn"), 0.0).alias("approve_coverage"),
        F.col("r_fn").alias("reject_fn"), _ratio(F.col("r_tp"), F.col("r_tp") + F.col("r_fn"), 0.0).alias("reject_coverage"),
    )


BANDS = ("approve", "review", "reject")


def three_bands(scored: DataFrame, low: Column | float, high: Column | float, by: str = "algorithm") -> DataFrame:
    """(by, band, n, pct, accuracy): approve from high, review from low, reject below; empty bands have NaN accuracy."""
    if isinstance(low, int | float) and isinstance(high, int | float) and not low <= high:
        raise ValueError("low must not be above high")
    s = F.col("score")
    band = F.when(s >= high, "approve").when(s >= low, "review").otherwise("reject")
    right = F.when(band == "approve", F.col("label") == 1).otherwise(F.col("label") == 0)
    counted = scored.groupBy(by).agg(
        F.count(F.lit(1)).alias("rows"),
        F.array(*[F.struct(F.lit(b).alias("band"), F.count_if(band == b).alias("n"), F.count_if((band == b) & right).alias("ok")) for b in BANDS]).alias("x"),
    )
    flat = counted.select(by, "rows", F.explode("x").alias("x")).select(by, "rows", "x.*")
    return flat.select(by, "band", "n", (100.0 * F.col("n") / F.col("rows")).alias("pct"), _ratio(F.col("ok"), F.col("n"), NAN).alias("accuracy"))


def pr_auc(at: DataFrame, by: str = "algorithm") -> DataFrame:
    """Average precision over distinct scores; 0 without positives."""
    total = F.max(F.col("tp") + F.col("fn"))
    s = F.sum(F.col("pos") * (F.col("tp") / (F.col("tp") + F.col("fp"))))
    return at.groupBy(by).agg(_ratio(s, total, 0.0).alias("pr_auc"))


def roc_auc(at: DataFrame, by: str = "algorithm") -> DataFrame:
    """Share of positive-negative pairs in the right order, ties half; 0.5 with a single class."""
    p, n = F.max(F.col("tp") + F.col("fn")), F.max(F.col("fp") + F.col("tn"))
    s = F.sum(F.col("pos") * (F.col("tn") + F.col("neg") / 2.0))
    return at.groupBy(by).agg(_ratio(s, p * n, 0.5).alias("roc_auc"))


def precision_at_recall(at: DataFrame, levels: tuple = RECALL_LEVELS, by: str = "algorithm") -> DataFrame:
    """(by, level, precision): the best precision at that recall or more; 0 if out of reach or the level is 0 or less."""
    r = F.round(recall(), 9)
    rows = at.select(by, r.alias("r"), precision().alias("pr"), F.explode(F.array(*[F.lit(float(x)) for x in levels])).alias("level"))
    best = F.max(F.when((F.col("r") + ABOVE >= F.col("level")) & (F.col("level") > 0), F.col("pr")))
    return rows.groupBy(by, "level").agg(F.coalesce(best, F.lit(0.0)).alias("precision"))


def per_category_errors(scored: DataFrame, threshold: float | Column, by: tuple = ("category",)) -> DataFrame:
    """Errors of each category at a threshold; rates are NaN without rows of their class."""
    yes, true = F.col("score") >= threshold, F.col("label") == 1
    g = scored.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(true).alias("n_pos"), F.count_if(~true).alias("n_neg"),
        F.count_if(true & ~yes).alias("fn"), F.count_if(~true & yes).alias("fp"),
    )
    return g.withColumns({"fn_rate": _ratio(F.col("fn"), F.col("n_pos"), NAN), "fp_rate": _ratio(F.col("fp"), F.col("n_neg"), NAN)})


def matched_recall_table(scored: DataFrame, g: DataFrame, floor: float = RECALL_FLOOR) -> DataFrame:
    """(category, then fp and fn of every algorithm) at the matched recall; floor out of reach: threshold 1."""
    reach = g.filter(F.col("kind") != "none").groupBy("algorithm").agg(F.max(recall()).alias("best"))
    points = points_at_recall(g, floor, by_cost=False).join(reach, "algorithm")
    at = points.select("algorithm", F.when(F.col("best") + ABOVE >= floor, F.col("threshold")).otherwise(1.0).alias("threshold"))
    # one row per algorithm
    errors = per_category_errors(scored.join(F.broadcast(at), "algorithm"), F.col("threshold"), ("algorithm", "category"))
    return errors.groupBy("category").pivot("algorithm").agg(F.first("fp").alias("fp"), F.first("fn").alias("fn"))


def reversals(values: DataFrame, eps: float = 0.0) -> DataFrame:
    """Algorithms of (condition, algorithm, value) that change strict order with another between conditions."""
    a, b = values.alias("a"), values.alias("b")
    both = a.join(b, (F.col("a.condition") == F.col("b.condition")) & (F.col("a.algorithm") < F.col("b.algorithm")))
    sign = F.when(F.col("a.value") < F.col("b.value") - eps, -1).when(F.col("a.value") > F.col("b.value") + eps, 1)
    flips = both.groupBy(F.col("a.algorithm").alias("x"), F.col("b.algorithm").alias("y")).agg(F.count_distinct(sign).alias("signs"))
    out = flips.filter("signs > 1")
    return out.select(F.col("x").alias("algorithm")).union(out.select("y")).distinct()


def _paid(score: str, threshold: float, fp_cost: float, fn_cost: float) -> Column:
    yes = F.col(score) >= threshold
    return F.when(yes & (F.col("label") == 0), fp_cost).when(~yes & (F.col("label") == 1), fn_cost).otherwise(0.0)


def cost_deltas(rows: DataFrame, threshold_a: float, threshold_b: float, fp_cost: float = COST_FP, fn_cost: float = COST_FN) -> DataFrame:
    """All rows of (score_a, score_b, label, ...) with ``d``: what decision B costs more than A on the row."""
    return rows.withColumn("d", _paid("score_b", threshold_b, fp_cost, fn_cost) - _paid("score_a", threshold_a, fp_cost, fn_cost))


def _interval(means: np.ndarray) -> dict[str, float]:
    low, high = np.percentile(means, [2.5, 97.5])
    return {"mean_delta": float(means.mean()), "ci_low": float(low), "ci_high": float(high), "p_a_cheaper": float((means > 0).mean())}


NO_ROWS = {"mean_delta": 0.0, "ci_low": 0.0, "ci_high": 0.0, "p_a_cheaper": 0.5}


def bootstrap_cost_delta(
    rows: DataFrame, threshold_a: float, threshold_b: float, *, rounds: int = BOOTSTRAP_ROUNDS, seed: int = BOOTSTRAP_SEED,
    fp_cost: float = COST_FP, fn_cost: float = COST_FN,
) -> dict[str, float]:
    """Paired bootstrap of cost(B) - cost(A) per pair over (score_a, score_b, label), thresholds fixed.

    A row's difference is one of a few values (two costs, two decisions), so a resample of all rows is
    a multinomial draw of how often each value comes. Only values and their counts reach the driver,
    whatever the number of rows.
    """
    if rounds <= 0:
        raise ValueError("rounds must be positive")
    found = cost_deltas(rows, threshold_a, threshold_b, fp_cost, fn_cost).groupBy("d").agg(F.count(F.lit(1)).alias("n")).orderBy("d").collect()
    if not found:
        return dict(NO_ROWS)
    value, n = np.array([r["d"] for r in found]), np.array([r["n"] for r in found])
    drawn = np.random.default_rng(seed).multinomial(n.sum(), n / n.sum(), size=rounds)
    return _interval(drawn @ value / n.sum())


def bootstrap_as_published(
    rows: DataFrame, threshold_a: float, threshold_b: float, *, rounds: int = BOOTSTRAP_ROUNDS, seed: int = BOOTSTRAP_SEED,
    fp_cost: float = COST_FP, fn_cost: float = COST_FN,
) -> dict[str, float]:
    """The same with the published draws: row by row in the order of ``ord``, for evaluation sets only.

    It gathers the differences of MOST_BOOTSTRAP_ROWS rows at most and raises beyond.
    """
    if rounds <= 0:
        raise ValueError("rounds must be positive")
    delta = cost_deltas(rows, threshold_a, threshold_b, fp_cost, fn_cost).select("ord", "d").orderBy("ord")
    found = delta.limit(MOST_BOOTSTRAP_ROWS + 1).collect()
    if len(found) > MOST_BOOTSTRAP_ROWS:
        raise ValueError("too many rows; use bootstrap_cost_delta")
    d = np.array([r["d"] for r in found])
    if not len(d):
        return dict(NO_ROWS)
    draw = random.Random(seed)
    return _interval(np.array([d[[draw.randrange(len(d)) for _ in range(len(d))]].sum() / len(d) for _ in range(rounds)]))
