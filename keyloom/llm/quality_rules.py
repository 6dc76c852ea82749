"""Quality classifier: a sparse ensemble of rules.

Shallow regression trees are grown on a bounded sample of labelled documents; every path from a root to a node is a rule,
a conjunction of comparisons of text statistics. A logistic model over the rules is fitted under an L1 penalty, which
leaves a few dozen of them. The model is compiled into one Spark column: a sum of weights of the rules that hold, through
a sigmoid. Statistics and score are built-in functions, so scoring is a projection of the scan.

Statistics use the text alone; labels, lang, source and doc_id are never inputs of a score.

Defined cases: null text counts as empty, which has all statistics zero and a score like any other; labels that are null
or belong to no document are left out; without labels of both classes the score is the smoothed share of label 1 (0.5
without labels); repeated rows are scored each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, cut_lineage, fresh

#: Labelled documents that the model is fitted on, or so; twice as many at most.
SAMPLE = 20_000
TREES, DEPTH, BINS, THRESHOLD = 40, 3, 32, 0.7
#: L1 penalties tried, by the loss on a fifth of the sample.
PENALTIES = (0.03, 0.01, 0.003, 0.001)


def _rates() -> dict[str, str]:
    """Statistics over t (the text), w (its words) and l (its lines)."""
    per_char, per_word = "greatest(char_length(t), 1)", "greatest(size(w), 1)"
    kept = lambda chars: f"char_length(regexp_replace(t, '[^{chars}]+', ''))"
    return {
        "n_words": "cast(size(w) AS double)",
        "distinct_words": f"size(array_distinct(w)) / {per_word}",
        "word_length": f"char_length(t) / {per_word}",
        "symbols": f"{kept('#$%&*')} / {per_word}",
        "bars": f"{kept('|')} / {per_word}",
        "exclamations": f"{kept('!')} / {per_word}",
        "capitals": f"{kept('A-ZÀ-ÖØ-Þ')} / {per_char}",
        "digits": f"{kept('0-9')} / {per_char}",
        "points": f"{kept('.,;:')} / {per_word}",
        "words_in_line": "size(w) / greatest(size(l), 1)",
        "distinct_lines": "size(array_distinct(l)) / greatest(size(l), 1)",
    }


def with_statistics(docs: DataFrame, stats: str, text_col: str = "text") -> DataFrame:
    """The same rows with a struct of statistics under the name given; all other columns stay as they are."""
    parts = fresh(docs, "_s")
    t = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    words = F.filter(F.split(t, "[\\x20\\x09-\\x0D]+"), lambda x: x != "")
    # they are read more than once below, so it is worked out once and not copied into each statistic
    held = docs.withColumn(parts, F.struct(t.alias("t"), words.alias("w"), F.split(t, "\n").alias("l")))
    rates = [F.expr(_scoped(e, parts)).cast("double").alias(k) for k, e in _rates().items()]
    return held.withColumn(stats, F.struct(*rates)).drop(parts)


def _scoped(expression: str, parts: str) -> str:
    for name in ("t", "w", "l"):
        expression = expression.replace(f"({name})", f"({parts}.{name})").replace(f"({name},", f"({parts}.{name},")
    return expression


Condition = tuple[int, bool, float]  # statistic, whether above the cut, cut


def grow(x: np.ndarray, residual: np.ndarray, cuts: list[np.ndarray], depth: int, rng, path: tuple[Condition, ...] = ()) -> list[tuple[Condition, ...]]:
    """Paths to all nodes but the root of a least-squares tree on some of the statistics."""
    if depth == 0 or len(x) < 20:
        return []
    best = (1e-9, -1, 0.0)
    total, n = residual.sum(), len(x)
    for j in rng.permutation(x.shape[1])[: max(2, x.shape[1] // 2)]:
        above = x[:, j][:, None] > cuts[j][None, :]
        m = above.sum(axis=0)
        s = residual @ above
        ok = (m >= 5) & (m <= n - 5)
        if ok.any():
            gain = np.where(ok, s**2 / np.maximum(m, 1) + (total - s) ** 2 / np.maximum(n - m, 1) - total**2 / n, -1)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), int(j), float(cuts[j][k]))
    if best[1] < 0:
        return []
    out, above = [], x[:, best[1]] > best[2]
    for side in (True, False):
        on = above == side
        here = (*path, (best[1], side, best[2]))
        out += [here, *grow(x[on], residual[on], cuts, depth - 1, rng, here)]
    return out


def holds(rule: tuple[Condition, ...], x: np.ndarray) -> np.ndarray:
    on = np.ones(len(x), bool)
    for j, above, cut in rule:
        on &= (x[:, j] > cut) == above
    return on


def lasso_logistic(r: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[float, np.ndarray]:
    """Accelerated proximal gradient; the intercept isn't penalised."""
    a = np.column_stack([np.ones(len(r)), r])
    step = 4.0 / max(1e-9, np.linalg.norm(a, 2) ** 2 / len(a))
    w = z = np.zeros(a.shape[1])
    k = 1.0
    for _ in range(rounds):
        grad = a.T @ (1 / (1 + np.exp(-np.clip(a @ z, -30, 30))) - y) / len(a)
        new = z - step * grad
        new[1:] = np.sign(new[1:]) * np.maximum(0, np.abs(new[1:]) - step * penalty)
        k2 = (1 + np.sqrt(1 + 4 * k * k)) / 2
        z, w, k = new + (k - 1) / k2 * (new - w), new, k2
    return float(w[0]), w[1:]


@dataclass
class RuleEnsemble:
    names: list[str]
    intercept: float
    rules: list[tuple[tuple[Condition, ...], float]]

    def column(self, stats: str) -> Column:
        """Score between 0 and 1 as one expression over a struct of statistics."""
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            parts = [F.col(f"{stats}.{self.names[j]}") > cut if above else F.col(f"{stats}.{self.names[j]}") <= cut for j, above, cut in rule]
            on = parts[0]
            for p in parts[1:]:
                on = on & p
            total = total + F.when(on, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.intercept + sum((w * holds(r, x) for r, w in self.rules), np.zeros(len(x))))))


def fit_rules(x: np.ndarray, y: np.ndarray, names: list[str], seed: int = 11) -> RuleEnsemble:
    share = (y.sum() + 1) / (len(y) + 2)
    if len(y) < 40 or y.min(initial=1) == y.max(initial=0):
        return RuleEnsemble(names, float(np.log(share / (1 - share))), [])
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[:-1])) for j in range(x.shape[1])]
    # rare statistics are zero nearly everywhere: also the quantiles of what isn't
    cuts = [np.unique(np.concatenate([c, np.quantile(v, np.linspace(0, 1, BINS // 2 + 1)[:-1]) if len(v) else []])) for c, v in zip(cuts, (x[:, j][x[:, j] > 0] for j in range(x.shape[1])), strict=True)]
    fitted, paths = np.full(len(y), share), []
    for _ in range(TREES):
        some = rng.choice(len(y), min(len(y), max(200, len(y) // 2)), replace=False)
        got = grow(x[some], (y - fitted)[some], cuts, DEPTH, rng)
        paths += got
        for rule in got:  # a small step along each node's mean, for the next tree to look elsewhere
            on = holds(rule, x)
            if on.any():
                fitted[on] += 0.05 * (y - fitted)[on].mean()
    unique, seen = [], set()
    for p in dict.fromkeys(tuple(sorted(p)) for p in paths):
        on = holds(p, x)
        key = min(on.tobytes(), (~on).tobytes())
        if 0 < on.sum() < len(on) and key not in seen:
            seen.add(key)
            unique.append(p)
    r = np.column_stack([holds(p, x) for p in unique]).astype(float)
    test = rng.random(len(y)) < 0.2

    def loss(penalty):
        b, w = lasso_logistic(r[~test], y[~test], penalty)
        p = 1 / (1 + np.exp(-np.clip(b + r[test] @ w, -30, 30)))
        return -np.mean(np.log(np.where(y[test] == 1, p, 1 - p) + 1e-12))

    b, w = lasso_logistic(r, y, min(PENALTIES, key=loss), 800)
    return RuleEnsemble(names, b, [(p, float(v)) for p, v in zip(unique, w, strict=True) if abs(v) > 1e-3])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> RuleEnsemble:
    """From at most 2 * SAMPLE labelled documents that aren't held out, SAMPLE or so, chosen by a hash of their id; of rows
    that share an id one counts, by its text."""
    names = list(_rates())
    chosen = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("quality").cast("int").alias("_y")).where("_id IS NOT NULL AND _y IN (0, 1)").where(~held_out(F.col("_id"))).groupBy("_id").agg(F.max("_y").alias("_y")).withColumn("_h", F.xxhash64("_id"))
    chosen = cut_lineage(bounded_sample(chosen, "_h", SAMPLE))
    sample = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text")).join(F.broadcast(chosen), "_id")
    one = sample.groupBy("_id").agg(F.max("_y").alias("_y"), F.min("text").alias("text"))
    rows = with_statistics(one, "_q").select("_id", "_y", *[F.col(f"_q.{n}").alias(n) for n in names]).orderBy("_id").toPandas()
    return fit_rules(rows[names].to_numpy(float), rows["_y"].to_numpy(float), names)


def score_quality(docs: DataFrame, labels: DataFrame, model: RuleEnsemble | None = None, score: str = "score", predicted: str = "predicted") -> DataFrame:
    """The documents with columns score (0 to 1) and predicted (1 from THRESHOLD on) added, under the names given."""
    model = model or train(docs, labels)
    stats = fresh(docs, "_q")
    scored = with_statistics(docs, stats).withColumn(score, model.column(stats))
    return scored.withColumn(predicted, (F.col(score) >= THRESHOLD).cast("int")).drop(stats)
