"""The evaluation as JSON, as Markdown and on the console."""

from __future__ import annotations

import math
import os
from typing import Any

from onoma.operators import evaluate as ev
from onoma.plans.jobs import Analysis, label_of


def fmt(x: Any, digits: int = 3) -> str:
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "n/a"
    return f"{x:.{digits}f}" if isinstance(x, float) else str(x)


def table(header: list[str], rows: list[list[Any]], digits: int = 3) -> str:
    lines = [header, ["---"] * len(header), *[[fmt(x, digits) for x in r] for r in rows]]
    return "\n".join("| " + " | ".join(x) + " |" for x in lines)


def payload(a: Analysis) -> dict:
    """Everything the report says, as plain values."""
    return {
        "dataset": a.profile, "identities": a.tables["identities"][0]["identities"], "cost_fp": ev.COST_FP, "cost_fn": ev.COST_FN,
        "algorithms": a.points, **{k: v for k, v in a.tables.items() if k != "identities"}, "bootstrap": a.bootstrap,
        "fold_train_losses": a.fold_losses, "full_model_loss": a.model.final_loss, "coefficients": [list(x) for x in a.model.coefficients()],
    }


def _pivot(rows: list[dict], across: str, value: str, order: list[str]) -> tuple[list, list[list]]:
    keys = sorted({r[across] for r in rows})
    at = {(r["algorithm"], r[across]): r[value] for r in rows}
    return keys, [[k, *[at.get((k, c)) for c in keys]] for k in order]


def markdown(a: Analysis) -> str:
    order = [r["algorithm"] for r in sorted(a.points.values(), key=lambda r: r["cost_per_pair"])]
    t = a.tables
    by = {k: {r["algorithm"]: r for r in t[k]} for k in ("areas", "at_recall_floor", "zero_fp", "bands")}
    n = sum(r["n"] for r in a.profile)
    levels, recall_rows = _pivot(t["precision_at_recall"], "level", "precision", order)
    ratios, sweep_rows = _pivot(t["sweep"], "ratio", "cost_per_pair", order)
    flips = _reversed_in(t["sweep"], "ratio", "cost_per_pair")
    bands = {(r["algorithm"], r["band"]): r for r in t["band_sizes"]}
    cols = [c for c in t["categories"][0] if c != "category"]
    b = a.bootstrap
    parts = [
        "# Name matching: evaluation",
        f"{n} pairs of {t['identities'][0]['identities']} identities. A false match costs {ev.COST_FP:g}, a missed match {ev.COST_FN:g}. "
        f"The cheapest matcher is **{label_of(order[0])}** at {fmt(a.points[order[0]]['cost_per_pair'])} per pair.",
        "## Pairs",
        table(["category", "label", "pairs"], [[r["category"], r["label"], r["n"]] for r in a.profile]),
        "## Cheapest threshold",
        table(
            ["matcher", "cost/pair", "FP", "FN", "precision", "recall", "F1", "PR area", "ROC area", "threshold"],
            [[label_of(k), r["cost_per_pair"], r["fp"], r["fn"], r["precision"], r["recall"], r["f1"], by["areas"][k]["pr_auc"], by["areas"][k]["roc_auc"], r["threshold"]] for k in order for r in [a.points[k]]],
        ),
        "## Best precision at a recall",
        table(["matcher", *[f"{x:.2f}" for x in levels]], [[label_of(r[0]), *r[1:]] for r in recall_rows]),
        f"## Recall of {ev.RECALL_FLOOR:.2f}, matched",
        table(["matcher", "cost/pair", "FP", "recall", "precision", "threshold"], [[label_of(k), r["cost_per_pair"], r["fp"], r["recall"], r["precision"], r["threshold"]] for k in order for r in [by["at_recall_floor"][k]]]),
        "## Without any false match",
        table(["matcher", "threshold", "FN", "recall"], [[label_of(k), f"{r['threshold']:.9f}", r["fn"], r["recall"]] for k in order for r in [by["zero_fp"][k]]]),
        "## Cost per pair at other prices of a missed match",
        table(["matcher", *[f"1:{int(x)}" for x in ratios]], [[label_of(r[0]), *r[1:]] for r in sweep_rows]),
        "Matchers that change places: " + (", ".join(map(label_of, flips)) if flips else "none") + ".",
        "## Three bands",
        table(
            ["matcher", "approve", "review", "reject", "approve accuracy", "reject accuracy", "usable"],
            [[label_of(k), *[bands[k, x]["n"] for x in ev.BANDS], bands[k, "approve"]["accuracy"], bands[k, "reject"]["accuracy"], by["bands"][k]["three_band_pipeline_usable"]] for k in order],
        ),
        "## Errors by category at the matched recall",
        table(["category", *cols], [[r["category"], *[r[c] for c in cols]] for r in t["categories"]]),
        "## Is the cheapest really cheaper?",
        f"{label_of(b['b'])} minus {label_of(b['a'])}: {b['mean_delta']:+.4f} per pair, 95 % interval [{b['ci_low']:+.4f}, {b['ci_high']:+.4f}], "
        f"cheaper in {b['p_a_cheaper']:.1%} of resamples." if b else "A single matcher: nothing to compare.",
        "## The learned matcher",
        "Training loss of the folds: " + ", ".join(fmt(x, 4) for x in a.fold_losses) + f"; of all rows: {fmt(a.model.final_loss, 4)}.",
        table(["feature", "weight"], [[f, w] for f, w in a.model.coefficients()]),
    ]
    return "\n\n".join(parts) + "\n"


def _reversed_in(rows: list[dict], condition: str, value: str) -> list[str]:
    at: dict[float, dict[str, float]] = {}
    for r in rows:
        at.setdefault(r[condition], {})[r["algorithm"]] = r[value]
    names = sorted({r["algorithm"] for r in rows})
    out = set()
    for k, x in enumerate(names):
        for y in names[k + 1 :]:
            signs = {(d[x] > d[y]) - (d[x] < d[y]) for d in at.values()} - {0}
            if len(signs) > 1:
                out |= {x, y}
    return sorted(out)


def ablation_markdown(rows: list[dict]) -> str:
    base = rows[0]["cost_per_pair"]
    body = [[r["feature"], r["cost_per_pair"], f"{r['delta']:+.3f}", r["fp"], r["fn"], r["weight"]] for r in rows[1:]]
    return f"# Leaving one feature out\n\nWith all features: {fmt(base)} per pair.\n\n" + table(["feature left out", "cost/pair", "change", "FP", "FN", "weight"], body) + "\n"


def write_text(text: str, path: str) -> str:
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8", newline="\n") as f:
        f.write(text)
    return path
