"""The pair matchers, as expressions over two normalised sides.

``sides`` makes the sides from distinct names; ``with_components`` adds every intermediate quantity of
a pair once, as columns that all matchers and features then read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from onoma.functions import native, vocab
from onoma.functions.kernels import pair_kernels_udf, token_codes_udf
from onoma.operators.normalize import normalize_names


def with_side(df: DataFrame, col: str, out: str) -> DataFrame:
    """Add ``out``: the normalised struct of the name and its tokens with phonetic codes. Row by row."""
    norm = normalize_names(df, col, "__norm")
    coded = norm.withColumns({"__t": token_codes_udf("__norm.tokens"), "__c": token_codes_udf("__norm.canonical")})
    word = lambda w, codes, i: F.struct(w.alias("word"), native.soundex(w).alias("sx"), F.get(codes, i).alias("mp"))
    toks = F.transform(
        F.col("__norm.tokens"),
        lambda t, i: F.struct(
            word(t, F.col("__t"), i).alias("t"),
            word(F.get(F.col("__norm.canonical"), i), F.col("__c"), i).alias("c"),
            F.array_contains(F.col("__norm.initials"), i).alias("initial"),
        ),
    )
    return coded.withColumn(out, F.col("__norm").withField("toks", toks)).drop("__norm", "__t", "__c")


def sides(names: DataFrame, col: str = "name") -> DataFrame:
    """(name, side) of distinct names."""
    return with_side(names.select(F.coalesce(F.col(col), F.lit("")).alias("name")).distinct(), "name", "side")


def token_similarity(x: Column, y: Column, osa: Column) -> Column:
    """Similarity of two tokens; the first rule that applies decides. osa: distance of the canonical words."""
    t, u, c, d = x["t"]["word"], y["t"]["word"], x["c"]["word"], y["c"]["word"]
    shorter, longer = F.least(F.length(c), F.length(d)), F.greatest(F.length(c), F.length(d))
    shared = native.prefix_ratio(c, d)
    agreement = native.phonetic_agreement(x["c"], y["c"])
    near = F.lit(1.0) - osa / F.greatest(longer, F.lit(1)).cast("double")
    fits = F.when(native.is_prefix(t, u), vocab.INITIAL_CREDIT).otherwise(0.0)
    return (
        F.when((c == d) & (t == u), 1.0)
        .when(c == d, vocab.SAME_CLASS_CREDIT)
        .when(x["initial"] != y["initial"], fits)
        .when(x["initial"] & y["initial"], vocab.OTHER_INITIAL_CREDIT)
        .when(native.is_prefix(c, d), vocab.PREFIX_CREDIT * (0.5 * shared + 0.5 * (shorter / F.nullif(longer, F.lit(0)).cast("double"))))
        .when(agreement > 0, vocab.PHONETIC_CREDIT * agreement)
        .when((shorter >= 4) & (shared * shorter < 3), near * vocab.FEW_SHARED_CREDIT)
        .when(shorter < 4, near * vocab.SHORT_CREDIT)
        .otherwise(near)
    )


def greedy_alignment(a: Column, b: Column, osa: Column) -> Column:
    """Token pairs (i, j, sim), each token once: the most similar first, ties from the left; sorted by i."""
    width = F.size(b)
    grid = F.flatten(
        F.transform(
            a,
            lambda x, i: F.transform(
                b,
                lambda y, j: F.struct(
                    (-token_similarity(x, y, F.get(osa, i * width + j))).alias("minus"), i.alias("i"), j.alias("j")
                ),
            ),
        )
    )
    queue = F.array_sort(F.filter(grid, lambda p: p["minus"] < 0))
    empty = F.array().cast("array<struct<i:int,j:int,sim:double>>")
    taken = F.aggregate(
        queue,
        empty,
        lambda acc, p: F.when(F.exists(acc, lambda q: (q["i"] == p["i"]) | (q["j"] == p["j"])), acc).otherwise(
            F.concat(acc, F.array(F.struct(p["i"].alias("i"), p["j"].alias("j"), (-p["minus"]).alias("sim"))))
        ),
    )
    return F.array_sort(taken)


def token_weight(i: Column, n: Column) -> Column:
    return F.when((n <= 1) | (i == 0), vocab.GIVEN_WEIGHT).when(i == n - 1, vocab.FAMILY_WEIGHT).otherwise(vocab.MIDDLE_WEIGHT)


def _total(items: Column, value: Callable[[Column], Column], start: Column | None = None) -> Column:
    return F.aggregate(items, F.lit(0.0) if start is None else start, lambda s, x: s + value(x))


def _free(n: Column, aligned: Column, side: str) -> Column:
    """Places of a side's tokens that are not aligned."""
    places = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: i < n)
    return F.filter(places, lambda i: ~F.exists(aligned, lambda p: p[side] == i))


def with_components(pairs: DataFrame) -> DataFrame:
    """Add to (a, b: sides) the columns k_* that matchers and features read.

    The steps are separate projections so that each array is made once and used by name.
    """
    na, nb = F.size("a.toks"), F.size("b.toks")
    df = pairs.withColumn("__k", pair_kernels_udf("a.canonical", "b.canonical"))
    df = df.withColumn("__al", greedy_alignment(F.col("a.toks"), F.col("b.toks"), F.col("__k.osa")))
    agree = lambda x, y: native.phonetic_agreement(x["t"], y["t"])
    best = lambda xs, ys: F.transform(xs, lambda x: F.coalesce(F.array_max(F.transform(ys, lambda y: agree(x, y))), F.lit(0.0)))
    df = df.withColumns({"__ba": best(F.col("a.toks"), F.col("b.toks")), "__bb": best(F.col("b.toks"), F.col("a.toks"))})
    al = F.col("__al")
    weight = lambda p: F.least(token_weight(p["i"], na), token_weight(p["j"], nb))
    matched = _total(al, weight)
    spare = _total(_free(nb, al, "j"), lambda j: token_weight(j, nb), _total(_free(na, al, "i"), lambda i: token_weight(i, na), matched))
    df = df.withColumns(
        {
            "__matched": matched,
            "__weights": spare,
            "__similar": _total(al, lambda p: weight(p) * p["sim"]),
            "k_undecidable": (F.size("a.unreadable") > 0) | (F.size("b.unreadable") > 0),
            "k_empty": (F.size("a.canonical") == 0) | (F.size("b.canonical") == 0),
        }
    )
    mean = lambda c: F.when(F.size(c) > 0, _total(F.col(c), lambda x: x) / F.nullif(F.size(c), F.lit(0))).otherwise(0.0)
    over = lambda x, y: F.when(y > 0, x / F.nullif(y, F.lit(0.0))).otherwise(0.0)
    pair_in = lambda i, j: F.exists(al, lambda p: (p["i"] == i) & (p["j"] == j))
    order = (
        F.when(F.size(al) == 0, 0.0)
        .when((na < 2) | (nb < 2), vocab.LAST_ORDER)
        .when(pair_in(na - 1, nb - 1), vocab.LAST_ORDER)
        .when(pair_in(F.lit(0), F.lit(0)), vocab.FIRST_ORDER)
        .otherwise(vocab.NO_ORDER)
    )
    letterless = lambda side: (F.size(side) > 0) & ~F.exists(side, lambda t: t.rlike("[a-z]"))
    df = df.withColumns(
        {
            "k_jaccard": native.set_jaccard(F.col("a.canonical"), F.col("b.canonical")),
            "k_exact": native.set_equal(F.col("a.canonical"), F.col("b.canonical")),
            "k_same_order": F.col("a.canonical") == F.col("b.canonical"),
            "k_phonetic_max": F.coalesce(F.array_max("__ba"), F.lit(0.0)),
            "k_phonetic_mean": 0.5 * (mean("__ba") + mean("__bb")),
            "k_jw_sorted": F.col("__k.jw_sorted"),
            "k_jw_ordered": F.col("__k.jw_ordered"),
            "k_osa_sorted": F.col("__k.osa_sorted"),
            "k_lcs_sorted": F.col("__k.lcs_sorted"),
            "k_coverage": over(F.col("__matched"), F.col("__weights")),
            "k_agreement": over(F.col("__similar"), F.col("__matched")),
            "k_order_bonus": order,
            "k_n_aligned": F.size(al),
            "k_letterless": letterless(F.col("a.tokens")) & letterless(F.col("b.tokens")),
        }
    )
    return df.drop("__k", "__al", "__ba", "__bb", "__matched", "__weights", "__similar")


def _gated(score: Column) -> Column:
    """Unreadable names are undecided, empty ones never match."""
    return F.when(F.col("k_undecidable"), vocab.UNDECIDABLE).when(F.col("k_empty"), 0.0).otherwise(native.clamp(score))


def _exact() -> Column:
    return F.when(F.col("k_exact"), 1.0).otherwise(0.0)


def _phonetic() -> Column:
    phonetic = 0.5 * F.col("k_phonetic_max") + 0.5 * F.col("k_phonetic_mean")
    jw = F.greatest("k_jw_sorted", "k_jw_ordered")
    return F.when((phonetic == 0.0) & F.col("k_letterless"), jw).otherwise(0.5 * phonetic + (1 - 0.5) * jw)


def _aligned() -> Column:
    core = F.col("k_coverage") * F.col("k_agreement") * (vocab.ORDER_FLOOR + (1 - vocab.ORDER_FLOOR) * F.col("k_order_bonus"))
    blend = (1 - vocab.CHARACTER_WEIGHT) * core + vocab.CHARACTER_WEIGHT * F.col("k_jw_sorted")
    return F.when(F.col("k_n_aligned") == 0, 0.0).otherwise(blend)


#: key -> (label, score); ``register_matcher`` adds more.
BASELINES: dict[str, tuple[str, Callable[[], Column]]] = {
    "exact_normalized": ("Exact (normalised tokens)", _exact),
    "token_jaccard": ("Token-set Jaccard", lambda: F.col("k_jaccard")),
    "phonetic_jaro": ("Phonetic + Jaro-Winkler", _phonetic),
    "token_aligned": ("Token-aligned weighted scorer", _aligned),
}
LEARNED = "learned"
LABELS = {**{k: v[0] for k, v in BASELINES.items()}, LEARNED: "Learned combiner (logistic regression)"}


def register_matcher(key: str, label: str, score: Callable[[], Column]) -> None:
    """Add a matcher: a Column over the k_* columns, scored and gated like the others."""
    BASELINES[key] = (label, score)
    LABELS[key] = label


def matcher_names() -> list[str]:
    return [*BASELINES, LEARNED]


def _learned(model) -> Column:
    """Probability of a model (None: an unfitted one, which gives 0.5 and a warning) over the pair's features."""
    from onoma.operators.features import FEATURES, features
    from onoma.operators.model import LogisticModel

    model = model or LogisticModel.unfitted()
    if model.weights and list(model.feature_names) != list(FEATURES):
        raise ValueError("the model was fitted on other features or another order; fit it again")
    return model.probability(features())


def get_matcher(key: str, model=None) -> Callable[[], Column]:
    """The matcher's score; ``model`` is the learned one's."""
    return (lambda: _learned(model)) if key == LEARNED else BASELINES[key][1]


def matcher_scores(*keys: str, model=None) -> list[Column]:
    """One column for each matcher (all but the learned one if none is named)."""
    return [_gated(get_matcher(k, model)()).alias(k) for k in keys or BASELINES]


def _number(c: Column) -> Column:
    return c.cast("double")


def _components(key: str) -> dict[str, Column]:
    sizes = lambda name: {f"{name}_a": _number(F.size(F.array_distinct("a.canonical"))), f"{name}_b": _number(F.size(F.array_distinct("b.canonical")))}
    if key == "exact_normalized":
        return {"token_jaccard": F.col("k_jaccard"), "exact": _number(F.col("k_exact"))}
    if key == "token_jaccard":
        return {"jaccard": F.col("k_jaccard"), "same_order": _number(F.col("k_same_order")), **sizes("n_tokens")}
    if key == "phonetic_jaro":
        return {
            "phonetic_max": F.col("k_phonetic_max"), "phonetic_mean": F.col("k_phonetic_mean"),
            "jaro_winkler": F.greatest("k_jw_sorted", "k_jw_ordered"), "jaro_winkler_ordered": F.col("k_jw_ordered"),
        }
    if key == "token_aligned":
        return {
            "coverage": F.col("k_coverage"), "agreement": F.col("k_agreement"), "order_bonus": F.col("k_order_bonus"),
            "char_signal": F.col("k_jw_sorted"), "n_aligned": _number(F.col("k_n_aligned")),
            "n_left": _number(F.size("a.tokens")), "n_right": _number(F.size("b.tokens")),
        }
    if key == LEARNED:
        from onoma.operators.features import FEATURES, features

        own = dict(zip(FEATURES, features(), strict=True))
        return {**_components("phonetic_jaro"), **_components("token_aligned"), **{f"f_{k}": v for k, v in own.items()}}
    raise KeyError(key)


def explanation(key: str) -> Column:
    """What a matcher's score is made of: a map of its components; the learned one's has ``f_<feature>`` too."""
    empty = F.create_map(F.lit("empty"), F.lit(1.0))
    if key == "exact_normalized":
        empty = F.create_map(
            F.lit("empty_left"), _number(F.size("a.canonical") == 0), F.lit("empty_right"), _number(F.size("b.canonical") == 0)
        )
    whole = F.create_map(*[x for k, v in _components(key).items() for x in (F.lit(k), v)])
    return F.when(F.col("k_undecidable"), F.create_map(F.lit("unsupported_script"), F.lit(1.0))).when(F.col("k_empty"), empty).otherwise(whole)
