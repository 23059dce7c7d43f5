"""Quality classifier: a sparse rule ensemble over text statistics, compiled into Spark column expressions.

Boosted small trees are fitted on the statistics of a bounded sample of labelled documents; every path from a root to a node is
a rule, a conjunction of thresholds. A lasso (L1) logistic regression over the rules keeps few of them. The model is
a list of (conditions, weight), and scoring is a sum of CASE WHEN expressions over statistics that Spark computes from the whole
text: no Python runs on the corpus.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled documents that a model is fitted on, at most (about: chosen by a hash of the id).
TRAINING_ROWS = 8000
THRESHOLD = 0.7
_WORD = r"[^\x20\x09-\x0D]+"


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a whole text; an empty one has 0 everywhere."""
    words = F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda w: w != "")
    return {
        "chars": F.length(text).cast("double"),
        "words": F.size(words).cast("double"),
        "distinct_words": F.size(F.array_distinct(words)).cast("double"),
        "lines": F.size(lines).cast("double"),
        "distinct_lines": F.size(F.array_distinct(lines)).cast("double"),
        "upper": F.length(F.regexp_replace(text, r"[^\p{Lu}]+", "")).cast("double"),
        "digits": F.length(F.regexp_replace(text, r"[^0-9]+", "")).cast("double"),
        "stops": F.length(F.regexp_replace(text, r"[^.?]+", "")).cast("double"),
        "shouts": F.length(F.regexp_replace(text, r"[^!]+", "")).cast("double"),
        "signs": F.length(F.regexp_replace(text, r"[^#$%&*|<>{}\[\]=_~^+\\/@]+", "")).cast("double"),
    }


FEATURES = ["words", "letters_per_word", "distinct_share", "distinct_lines_share", "upper_share", "digit_share", "stops_per_word", "shouts_per_word", "signs_per_word", "words_per_line"]


def _features() -> dict[str, Column]:
    """The model's inputs, from the columns of statistics() under the names _q_*."""
    s = {k: F.col(f"_q_{k}") for k in ("chars", "words", "distinct_words", "lines", "distinct_lines", "upper", "digits", "stops", "shouts", "signs")}
    per = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return {
        "words": s["words"],
        "letters_per_word": per(s["chars"], s["words"]),
        "distinct_share": per(s["distinct_words"], s["words"]),
        "distinct_lines_share": per(s["distinct_lines"], s["lines"]),
        "upper_share": per(s["upper"], s["chars"]),
        "digit_share": per(s["digits"], s["chars"]),
        "stops_per_word": per(s["stops"], s["words"]),
        "shouts_per_word": per(s["shouts"], s["words"]),
        "signs_per_word": per(s["signs"], s["words"]),
        "words_per_line": per(s["words"], s["lines"]),
    }


def with_features(docs: DataFrame, text: str) -> DataFrame:
    """docs with a struct column _features; the statistics are computed once per row."""
    whole = F.coalesce(F.col(text), F.lit(""))
    counted = docs.withColumns({f"_q_{k}": c for k, c in statistics(whole).items()})
    return counted.withColumn("_features", F.struct(*[c.alias(k) for k, c in _features().items()])).drop(*[f"_q_{k}" for k in statistics(whole)])


Condition = tuple[int, bool, float]  # feature, whether above, threshold


@dataclass
class RuleEnsemble:
    """score = logistic(bias + sum of the weights of the rules that hold)."""

    bias: float
    rules: list[tuple[tuple[Condition, ...], float]]

    def column(self, features: str = "_features") -> Column:
        total = F.lit(float(self.bias))
        for conditions, weight in self.rules:
            holds = None
            for feature, above, threshold in conditions:
                value = F.col(features)[FEATURES[feature]]
                one = value > F.lit(threshold) if above else value <= F.lit(threshold)
                holds = one if holds is None else holds & one
            total = total + F.when(holds, F.lit(float(weight))).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.bias)
        for conditions, weight in self.rules:
            total += weight * _holds(x, conditions)
        return 1 / (1 + np.exp(-total))


def _holds(x: np.ndarray, conditions: Sequence[Condition]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for feature, above, threshold in conditions:
        out &= x[:, feature] > threshold if above else x[:, feature] <= threshold
    return out


def _grow(x: np.ndarray, residual: np.ndarray, weight: np.ndarray, cuts: list[np.ndarray], rows: np.ndarray, path: tuple, depth: int, least: int, found: list, step: np.ndarray) -> None:
    """Grows one regression tree depth first, noting the path to each node and the leaves' steps."""
    best = None
    if depth and len(rows) >= 2 * least:
        g, h = residual[rows], weight[rows]
        whole = g.sum() ** 2 / (h.sum() + 1e-9)
        for f, edges in enumerate(cuts):
            bins = np.searchsorted(edges, x[rows, f], "left")
            gs, hs, ns = (np.cumsum(np.bincount(bins, v, len(edges) + 1))[:-1] for v in (g, h, np.ones(len(rows))))
            gain = gs**2 / (hs + 1e-9) + (g.sum() - gs) ** 2 / (h.sum() - hs + 1e-9) - whole
            gain[(ns < least) | (len(rows) - ns < least)] = -1
            if len(gain) and gain.max() > (best[0] if best else 1e-6):
                best = (gain.max(), f, float(edges[gain.argmax()]))
    if best is None:
        step[rows] = residual[rows].sum() / (weight[rows].sum() + 1e-9)
        return
    _, f, edge = best
    for above in (False, True):
        side = rows[(x[rows, f] > edge) == above]
        longer = (*path, (f, above, edge))
        found.append(longer)
        _grow(x, residual, weight, cuts, side, longer, depth - 1, least, found, step)


def fit(x: np.ndarray, y: np.ndarray, *, trees: int = 40, depth: int = 3, rate: float = 0.3, penalty: float = 0.002, rounds: int = 400) -> RuleEnsemble:
    """Boosted trees, their paths as rules, and lasso weights by accelerated proximal gradient. Deterministic."""
    n = len(x)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0.01, 0.99, 50))) for f in range(x.shape[1])]
    mean = min(max(y.mean(), 1e-3), 1 - 1e-3)
    score = np.full(n, np.log(mean / (1 - mean)))
    rules: dict[tuple, None] = {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        step, found = np.zeros(n), []
        _grow(x, y - p, p * (1 - p), cuts, np.arange(n), (), depth, max(5, n // 400), found, step)
        rules.update(dict.fromkeys(_merged(r) for r in found))
        score += rate * np.clip(step, -4, 4)
    paths = [r for r in rules if 0 < _holds(x, r).sum() < n]
    design = np.stack([_holds(x, r) for r in paths], axis=1).astype(float) if paths else np.zeros((n, 0))
    spread = design.std(axis=0) + 1e-9
    z = (design - design.mean(axis=0)) / spread
    w, bias, look, at = np.zeros(len(paths)), float(np.log(mean / (1 - mean))), np.zeros(len(paths)), 1.0
    size = 4 * n / max(1.0, 1.05 * _largest_eigenvalue(z)) if len(paths) else 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(bias + z @ look)))
        bias -= 2 * float((p - y).mean())
        new = look - size * (z.T @ (p - y)) / n
        new = np.sign(new) * np.maximum(np.abs(new) - size * penalty, 0)
        following = (1 + np.sqrt(1 + 4 * at * at)) / 2
        look, w, at = new + (at - 1) / following * (new - w), new, following
    kept = np.flatnonzero(w)
    bias -= float((w[kept] * design.mean(axis=0)[kept] / spread[kept]).sum())
    return RuleEnsemble(bias, [(paths[i], float(w[i] / spread[i])) for i in kept.tolist()])


def _largest_eigenvalue(z: np.ndarray, rounds: int = 50) -> float:
    """Of z'z, by power iteration."""
    v, value = np.ones(z.shape[1]), 0.0
    for _ in range(rounds):
        v = z.T @ (z @ v)
        value = float(np.linalg.norm(v))
        v /= max(value, 1e-12)
    return value


def _merged(path: tuple[Condition, ...]) -> tuple[Condition, ...]:
    """The path with one lower and one upper threshold per feature, in a fixed order."""
    bounds: dict[tuple[int, bool], float] = {}
    for f, above, t in path:
        bounds[f, above] = (max if above else min)(bounds.get((f, above), t), t)
    return tuple(sorted((f, above, t) for (f, above), t in bounds.items()))


def train(docs: DataFrame, labels: DataFrame, learns: Column, *, key: str = "doc_id", text: str = "text", label: str = "quality", rows: int = TRAINING_ROWS) -> RuleEnsemble | None:
    """A model from at most ``rows`` labelled documents for which ``learns`` (a column of key) holds; None without two classes.

    Ids are drawn by hash from the labels alone; only the drawn documents' statistics reach the driver. Null labels and ids don't count.
    """
    usable = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull() & learns).select(key, F.col(label).cast("int").alias("_label"))
    usable = usable.groupBy(key).agg(F.min("_label").alias("_label"))
    drawn = usable.orderBy(F.xxhash64(F.col(key).cast("string"), F.lit("quality")), key).limit(rows)
    sample = docs.select(key, text).join(F.broadcast(drawn), key)  # at most ``rows`` ids and labels
    table = with_features(sample, text).select("_label", "_features.*", key).orderBy(key).limit(2 * rows).toPandas()
    y = table["_label"].to_numpy(float)
    if len(set(y.tolist())) < 2:
        return None
    return fit(table[FEATURES].to_numpy(float), y)


def score(docs: DataFrame, model: RuleEnsemble | None, *, text: str = "text") -> DataFrame:
    """docs with quality_score (0 to 1) and quality (1 if the score is THRESHOLD or more, else 0); the two names replace
    columns of the same name. Null texts count as empty; without a model every score is 0.5. The score depends on the text alone."""
    keep = [c for c in docs.columns if c not in ("quality_score", "quality")]
    scored = with_features(docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_row"), F.col(text).alias("_text")), "_text")
    scored = scored.withColumn("_score", model.column() if model else F.lit(0.5))
    return scored.select(*[F.col("_row")[c].alias(c) for c in keep], F.col("_score").alias("quality_score"), (F.col("_score") >= THRESHOLD).cast("int").alias("quality"))
