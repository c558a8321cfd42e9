"""A quality classifier: a sparse ensemble of rules over statistics of a text.

Small boosted trees are grown on labelled rows; every path from a root is a rule, a conjunction of
comparisons; a lasso-penalised logistic regression gives most rules the weight zero; what is left is compiled
into Spark column expressions. Statistics and scores run inside Spark's generated code over whole texts, in
one pass without a shuffle. The fit takes at most ``most_rows`` labelled rows (those of the smallest hash of
their id), so that what reaches the driver is bounded; more rows hardly move weights of so few rules.

Only labels of rows whose crc32(doc_id as text) mod 5 is not 0 are learnt from. Labels, lang, source and
doc_id are never inputs.

Cases: a null text is empty and is scored like any other; without labels of both kinds every score is the
share of label 1 (0.5 without labels); null labels are no labels; of an id labelled twice each row counts;
ties of the hash are broken by the statistics; an empty table gives no rows; other columns stay as they are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wharfline.llm.workdir import spare_name

THRESHOLD = 0.3
FOLDS = 5
MOST_ROWS = 20_000
TREES, DEPTH, BINS, RATE = 24, 3, 48, 0.3
LASSO = 0.0015
#: Frequent words of the languages of the corpus (fixed values).
FUNCTION_WORDS = ("the", "and", "of", "to", "in", "is", "that", "for", "it", "was", "with", "de", "la", "le", "les", "et", "des", "en", "que", "un", "une", "der", "die", "das", "und", "den", "von", "zu", "ist", "el", "los", "y", "se", "no", "es", "para")


def _share(n: Column, of: Column) -> Column:
    return n.cast("double") / F.greatest(of.cast("double"), F.lit(1.0))


def statistics(docs: DataFrame, into: str = "_stats") -> tuple[DataFrame, list[str]]:
    """``docs`` with a struct of statistics of its text in a new column, and their names."""
    q = spare_name(docs, "_q")
    text = F.coalesce(F.col("text"), F.lit(""))
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"\s+"))
    lines = F.split(text, "\n")
    count = lambda pattern: F.regexp_count(text, F.lit(pattern))
    # explode keeps the optimizer from repeating what is used more than once
    once = lambda c: F.explode(F.array(c))
    raw = docs.withColumn(q, once(F.struct(
        F.length(text).alias("chars"), words.alias("words"), F.size(lines).alias("lines"), F.size(F.array_distinct(lines)).alias("distinct_lines"),
        count(r"\p{Lu}").alias("upper"), count(r"[!?]").alias("excited"), count(r"[#$%&*+/<=>@\\^_`|~{}\[\]]").alias("symbols"), count("[0-9]").alias("digits"), count("[.,;:]").alias("stops"),
    )))
    raw = raw.withColumn(q, once(F.struct(f"{q}.*", F.array_distinct(f"{q}.words").alias("vocabulary"), F.size(f"{q}.words").alias("n_words"))))
    n, chars = F.col(f"{q}.n_words"), F.col(f"{q}.chars")
    distinct = F.size(f"{q}.vocabulary")
    known = F.size(F.array_intersect(f"{q}.vocabulary", F.array(*map(F.lit, FUNCTION_WORDS))))
    stats = {
        "log_words": F.log1p(n.cast("double")),
        "word_length": _share(chars, n),
        "upper_share": _share(F.col(f"{q}.upper"), chars),
        "excited_share": _share(F.col(f"{q}.excited"), n),
        "symbol_share": _share(F.col(f"{q}.symbols"), n),
        "digit_share": _share(F.col(f"{q}.digits"), chars),
        "stop_share": _share(F.col(f"{q}.stops"), n),
        "distinct_words": _share(distinct, n),
        # copies of one word weigh less in long texts, whose distinct words grow slower than their length
        "distinct_root": distinct / F.greatest(F.sqrt(n.cast("double")), F.lit(1.0)),
        "distinct_lines": _share(F.col(f"{q}.distinct_lines"), F.col(f"{q}.lines")),
        "words_a_line": _share(n, F.col(f"{q}.lines")),
        "function_words": known.cast("double"),
        "function_share": _share(known, F.least(distinct, F.lit(60))),
    }
    return raw.withColumn(into, once(F.struct(*(c.alias(k) for k, c in stats.items())))).drop(q), list(stats)


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, is above, bound) and its weight."""

    terms: tuple[tuple[int, bool, float], ...]
    weight: float = 0.0

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for k, above, bound in self.terms:
            out &= (x[:, k] > bound) == above
        return out


@dataclass(frozen=True)
class Model:
    names: tuple[str, ...]
    intercept: float
    rules: tuple[Rule, ...]

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for r in self.rules:
            z += r.weight * r.holds(x)
        return 1 / (1 + np.exp(-z))

    def column(self, stats: str = "_stats") -> Column:
        """The score as a Spark expression."""
        z = F.lit(self.intercept)
        for r in self.rules:
            holds = F.lit(True)
            for k, above, bound in r.terms:
                value = F.col(f"{stats}.{self.names[k]}")
                holds = holds & ((value > F.lit(bound)) if above else (value <= F.lit(bound)))
            z = z + F.when(holds, F.lit(r.weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-z))


def _grow(binned: np.ndarray, bounds: list[np.ndarray], gradient: np.ndarray, hessian: np.ndarray) -> tuple[list[tuple], np.ndarray]:
    """One tree by greedy splits: its paths, and the step it adds to each row."""
    paths, step = [], np.zeros(len(binned))

    def split(rows: np.ndarray, terms: tuple, depth: int) -> None:
        g, h = gradient[rows], hessian[rows]
        best = (1e-3, 0, 0)
        if depth < DEPTH:
            for k, edges in enumerate(bounds):
                if not len(edges):
                    continue
                code = binned[rows, k]
                gs = np.cumsum(np.bincount(code, g, len(edges) + 1))[:-1]
                hs = np.cumsum(np.bincount(code, h, len(edges) + 1))[:-1]
                gr, hr = g.sum() - gs, h.sum() - hs
                gain = gs**2 / (hs + 1) + gr**2 / (hr + 1) - g.sum() ** 2 / (h.sum() + 1)
                gain[(hs < 1) | (hr < 1)] = 0
                j = int(gain.argmax())
                if gain[j] > best[0]:
                    best = (gain[j], k, j)
        if best[0] <= 1e-3:
            step[rows] = g.sum() / (h.sum() + 1)
            return
        _, k, j = best
        above = binned[rows, k] > j
        for side in (False, True):
            path = (*terms, (k, side, float(bounds[k][j])))
            paths.append(path)
            split(rows[above == side], path, depth + 1)

    split(np.arange(len(binned)), (), 0)
    return paths, step


def _lasso(x: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[float, np.ndarray]:
    """Logistic regression with an L1 penalty by accelerated proximal steps; the intercept is free."""
    n, d = x.shape
    x = np.hstack([np.ones((n, 1), x.dtype), x])
    w = np.zeros(d + 1)
    p = y.mean()
    w[0] = np.log(p / (1 - p))
    v = np.random.default_rng(0).normal(size=d + 1)
    for _ in range(30):
        v = x.T @ (x @ v)
        norm = np.linalg.norm(v)
        v /= norm
    step, look, t = 4 * n / norm, w.copy(), 1.0
    for _ in range(rounds):
        slope = x.T @ (1 / (1 + np.exp(-(x @ look))) - y) / n
        new = look - step * slope
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * penalty, 0)
        t, old = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        look, w = new + (old - 1) / t * (new - w), new
    return float(w[0]), w[1:]


def fit_rules(x: np.ndarray, y: np.ndarray, names: list[str]) -> Model:
    """Trees, their paths as rules, and lasso weights."""
    share = float(y.mean()) if len(y) else 0.5
    if not len(y) or not 0 < share < 1:
        # one kind of label only says how common it is
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Model(tuple(names), float(np.log(share / (1 - share))), ())
    bounds = []
    for k in range(x.shape[1]):
        values = np.unique(x[:, k])
        if len(values) > BINS:
            values = np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)))
        bounds.append((values[:-1] + values[1:]) / 2)
    binned = np.stack([np.searchsorted(b, x[:, k], "left") for k, b in enumerate(bounds)], 1)
    z, paths = np.full(len(y), np.log(share / (1 - share))), {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-z))
        found, step = _grow(binned, bounds, y - p, p * (1 - p))
        z += RATE * step
        paths |= dict.fromkeys(tuple(sorted(path)) for path in found)
    rules = [Rule(path) for path in paths]
    held = np.stack([r.holds(x) for r in rules], 1) if rules else np.empty((len(y), 0))
    varied = [i for i in range(len(rules)) if 0 < held[:, i].mean() < 1]
    intercept, weights = _lasso(held[:, varied].astype(float), y, LASSO)
    chosen = [Rule(rules[i].terms, float(w)) for i, w in zip(varied, weights, strict=True) if abs(w) > 1e-6]
    return Model(tuple(names), intercept, tuple(chosen))


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most_rows: int = MOST_ROWS) -> Model:
    """Fit on a sample of the labelled rows outside the held-out fold."""
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 0))
    order = F.xxhash64("doc_id")
    sample = known.select(F.col("doc_id"), F.col(label).cast("double").alias("label")).orderBy(order, "doc_id", "label").limit(most_rows)
    rows, names = statistics(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id"))  # at most most_rows rows
    got = rows.select("doc_id", "label", "_stats.*").orderBy(order, "doc_id", "label", *names).limit(most_rows).toPandas()
    return fit_rules(got[names].to_numpy(float), got["label"].to_numpy(float), names)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score`` (likelihood of label 1) and ``predicted``; columns of these names are replaced."""
    stats = spare_name(docs, "_stats")
    rows, _ = statistics(docs, stats)
    return rows.withColumn("score", model.column(stats)).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int")).drop(stats)


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each document: doc_id, held_out, score, predicted."""
    model = train(docs, labels)
    return score(docs.select("doc_id", "text"), model).select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier doesn't reject."""
    stats = spare_name(docs, "_stats")
    rows, _ = statistics(docs, stats)
    return rows.filter(train(docs, labels).column(stats) >= THRESHOLD).select(*docs.columns)
