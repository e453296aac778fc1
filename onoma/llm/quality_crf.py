"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. A line's features describe it and its two neighbours; transition weights
tie the labels of lines that follow each other. The field is fitted on lines of labelled documents
(each line takes its document's label); forward-backward gives every line's probability of being
good, and a document's quality is their mean, weighted by line length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from onoma.llm.common import crc_mod, read_table

#: Labelled documents that a fit uses at most: those whose ids have the smallest hashes.
MOST_TRAINING_DOCUMENTS = 4000
THRESHOLD = 0.3
L2 = 1e-3
STEPS = 200
RATE = 0.1
#: Lines whose chain is worked off at a time; a longer document is a chunk alone.
CHUNK_LINES = 200_000

CLASSES = ("upper", "lower", "digit", "blank", "stop", "mark", "symbol", "beyond")


def _byte_classes() -> np.ndarray:
    out = np.full(256, CLASSES.index("symbol"), np.int64)
    for name, chars in {
        "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "blank": b" \t\r\x0b\x0c\n",
        "stop": b".,;:", "mark": b"!?", "beyond": range(128, 256),
    }.items():
        out[list(chars)] = CLASSES.index(name)
    return out


BYTE_CLASS = _byte_classes()
OWN = (
    *(f"share_{c}" for c in CLASSES), "log_bytes", "empty", "log_words", "mean_word", "odd_word", "distinct_words",
    "top_word", "distinct_bytes", "starts_upper", "ends_stop", "seen_before", "capital_words",
)
FEATURES = (*OWN, *(f"previous_{f}" for f in OWN), *(f"next_{f}" for f in OWN), "first", "last", "bias")


def line_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """A row of OWN for every line, and the lines' weights (their lengths plus one)."""
    lines = text.split("\n")
    out = np.zeros((len(lines), len(OWN)), np.float32)
    seen: set[str] = set()
    nc = len(CLASSES)
    weight = np.empty(len(lines))
    for k, line in enumerate(lines):
        raw = line.encode("utf-8", "surrogatepass")
        n = len(raw)
        weight[k] = n + 1
        row = out[k]
        if not n:
            row[nc + 1] = 1
            continue
        b = np.frombuffer(raw, np.uint8)
        row[:nc] = np.bincount(BYTE_CLASS[b], minlength=nc) / n
        words = line.split()
        m = len(words) or 1
        kinds = set(words)
        mean = n / m
        row[nc:] = (
            np.log1p(n) / 8, 0, np.log1p(m) / 8, min(mean, 40) / 10, abs(min(mean, 40) - 6) / 10, len(kinds) / m,
            _top_share(words, kinds) / m, len(set(raw)) / min(n, 64), line[0].isupper(), line[-1] in ".!?", line in seen,
            sum(map(str.isupper, words)) / m,
        )
        seen.add(line)
    return out, weight


def _top_share(words: list[str], kinds: set[str]) -> int:
    """How often a word follows itself; repetition that does not depend on the line's length."""
    return sum(map(str.__eq__, words, words[1:])) if len(kinds) < len(words) else 0


def chain_features(own: np.ndarray) -> np.ndarray:
    """FEATURES of every line of one document: its own, its neighbours' and its place."""
    n = len(own)
    zero = np.zeros((1, own.shape[1]), own.dtype)
    place = np.zeros((n, 3), own.dtype)
    place[0, 0] = place[-1, 1] = 1
    place[:, 2] = 1
    return np.hstack([own, np.vstack([zero, own[:-1]]), np.vstack([own[1:], zero]), place])


def forward_backward(unary: list[np.ndarray], transition: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Per chain the marginals of label 1; the chains' log partition values; summed pair marginals.

    unary: per chain the score of label 1 at each place (label 0 scores 0). Chains are padded to one
    length and worked off together, place by place, in the log domain.
    """
    lengths = np.array([len(u) for u in unary])
    n, longest = len(unary), int(lengths.max(initial=0))
    u = np.zeros((n, longest, 2))
    for k, x in enumerate(unary):
        u[k, : len(x), 1] = x
    alpha, beta = np.empty_like(u), np.zeros_like(u)
    alpha[:, 0] = u[:, 0]
    for t in range(1, longest):
        step = _logsum(alpha[:, t - 1, :, None] + transition, 1) + u[:, t]
        alpha[:, t] = np.where((t < lengths)[:, None], step, alpha[:, t - 1])
    for t in range(longest - 2, -1, -1):
        step = _logsum(transition + (u[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
        beta[:, t] = np.where((t + 1 < lengths)[:, None], step, beta[:, t])
    log_z = _logsum(alpha[:, -1], 1)
    marginal = np.exp(np.minimum(alpha[:, :, 1] + beta[:, :, 1] - log_z[:, None], 0))
    pairs = np.zeros((n, 2, 2))
    for t in range(longest - 1):
        p = np.exp(alpha[:, t, :, None] + transition + (u[:, t + 1] + beta[:, t + 1])[:, None, :] - log_z[:, None, None])
        pairs += p * (t + 1 < lengths)[:, None, None]
    return [marginal[k, :m] for k, m in enumerate(lengths)], log_z, pairs


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


class LineField:
    """The fitted field: feature scale, unary weights (for the label good) and transitions."""

    def __init__(self, weights: np.ndarray, transition: np.ndarray, mean: np.ndarray, scale: np.ndarray):
        self.weights, self.transition, self.mean, self.scale = weights, transition, mean, scale

    @classmethod
    def empty(cls) -> LineField:
        n = len(FEATURES)
        return cls(np.zeros(n), np.zeros((2, 2)), np.zeros(n), np.ones(n))

    @classmethod
    def fit(cls, chains: list[np.ndarray], labels: np.ndarray, steps: int = STEPS) -> LineField:
        """Adam on the chains' mean negative log-likelihood per line, with a ridge."""
        if not chains:
            return cls.empty()
        x = np.vstack(chains).astype(np.float64)
        mean, scale = x.mean(0), x.std(0)
        scale[scale < 1e-6] = 1
        mean[-1], scale[-1] = 0, 1
        x = (x - mean) / scale
        lengths = np.array([len(c) for c in chains])
        cut = np.cumsum(lengths)[:-1]
        y = np.repeat(labels, lengths).astype(float)
        share = 1 / lengths / len(chains)  # every document counts alike
        per_line = np.repeat(share, lengths)
        groups = _by_length(lengths)
        w, trans = np.zeros(x.shape[1]), np.zeros((2, 2))
        theta, m, v = np.concatenate([w, trans.ravel()]), 0.0, 0.0
        seen = np.zeros((2, 2))
        for b in (0, 1):
            seen[b, b] = ((lengths - 1) * share)[labels == b].sum()
        for step in range(1, steps + 1):
            w, trans = theta[:-4], theta[-4:].reshape(2, 2)
            unary = np.split(x @ w, cut)
            p, pairs = [np.zeros(0)] * len(chains), np.zeros((2, 2))
            for g in groups:
                found, _, pair = forward_backward([unary[k] for k in g], trans)
                for k, f in zip(g, found, strict=True):
                    p[k] = f
                pairs += (pair * share[g][:, None, None]).sum(0)
            slope = np.concatenate([x.T @ ((np.concatenate(p) - y) * per_line) + L2 * w, (pairs - seen + L2 * trans).ravel()])
            m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
            theta = theta - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return cls(theta[:-4], theta[-4:].reshape(2, 2), mean, scale)

    def score(self, texts: list[str]) -> list[float]:
        """Quality of every text, 0 to 1."""
        chains, weights = [], []
        for t in texts:
            own, weight = line_features(t)
            x = chain_features(own)
            chains.append(((x - self.mean) / self.scale) @ self.weights)
            weights.append(weight)
        out = [0.0] * len(texts)
        for g in _by_length(np.array([len(c) for c in chains], int)):
            found, _, _ = forward_backward([chains[k] for k in g], self.transition)
            for k, f in zip(g, found, strict=True):
                out[k] = float(f @ weights[k] / weights[k].sum())
        return out


def _by_length(lengths: np.ndarray) -> list[np.ndarray]:
    """Chains of like length together, so that padding stays small."""
    order = np.argsort(lengths, kind="stable")
    out, at = [], 0
    while at < len(order):
        end = at + 1
        while end < len(order) and lengths[order[end]] <= max(4, 1.5 * lengths[order[at]]) and (end - at + 1) * lengths[order[end]] <= CHUNK_LINES:
            end += 1
        out.append(order[at:end])
        at = end
    return out


def fit_quality(docs: DataFrame, labels: DataFrame, most: int = MOST_TRAINING_DOCUMENTS) -> LineField:
    """Fit on (doc_id, text) and (doc_id, quality): the ``most`` labelled ids with the smallest hashes.

    Ids are chosen from the labels alone, so texts of other documents never move. Features are made
    on the workers; what the driver gathers is bounded by ``most``. Null labels and ids are left out,
    of an id's labels the lowest counts, of its rows the text with the smallest hash; a null text is
    an empty one.
    """
    judged = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    ids = judged.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    text = F.coalesce(F.col("text"), F.lit(""))
    # the broadcast has ``most`` rows at most
    rows = docs.select("doc_id", text.alias("text")).join(F.broadcast(ids), "doc_id")
    chosen = rows.groupBy("doc_id", "quality").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [np.ascontiguousarray(line_features(t or "")[0]).tobytes() for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()), b.column(1)], ["x", "quality"])

    found = chosen.select("text", F.col("quality").cast("int").alias("quality")).mapInArrow(run, "x binary, quality int").collect()
    chains = [chain_features(np.frombuffer(r["x"], np.float32).reshape(-1, len(OWN))) for r in found]
    return LineField.fit(chains, np.array([r["quality"] for r in found], int))


def score_quality(docs: DataFrame, field: LineField, *, keep_text: bool = True) -> DataFrame:
    """All columns of ``docs`` plus ``score`` (a column of that name is replaced).

    Null text counts as one empty line. Whole texts are scored, row by row; equal texts score alike.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)
    kept = [f for f in docs.schema if f.name != "score"]
    names = [f.name for f in kept if keep_text or f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.names.index("text")
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                scores = shared.value.score([t or "" for t in part.column(at).to_pylist()])
                cols = [part.column(b.schema.names.index(n)) for n in names]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(scores, pa.float64())], [*names, "score"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept if f.name in names)
    return docs.select(*[f.name for f in kept]).mapInArrow(run, f"{ddl}, score double")


def held_out(doc_id: Column) -> Column:
    return crc_mod(doc_id, 5) == 0


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "quality").filter(~held_out(F.col("doc_id")))
    field = fit_quality(docs, labels)
    scored = score_quality(docs, field, keep_text=False)
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
