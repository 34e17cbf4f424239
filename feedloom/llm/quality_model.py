"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics are built-in expressions, written once for all documents. The trees are grown
on a bounded sample of the labelled rows (TRAIN_ROWS, chosen by a hash of doc_id) from
gradient histograms over quantile bins, and flattened into arrays: feature, threshold,
left, right, value for all nodes of all trees. Scoring walks those arrays with numpy for a
whole Arrow batch at a time, one step a tree level.

Labels, lang, source and doc_id are never inputs of a score. Labels of rows with
crc32(doc_id) mod 3 = 1 are never learned from.

Defined cases: a null or empty text is scored by its statistics (all 0); null or missing
labels are not learned from; without two classes to learn from, every score is 0.5; equal
texts get equal scores; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_CHARS, cut, documents, free, table, words

#: The most labelled rows that are learned from.
TRAIN_ROWS = 20_000
TREES, DEPTH, BINS, RATE, MIN_LEAF, L2 = 60, 4, 64, 0.2, 10, 1.0

STATISTICS = (
    "n_chars", "n_words", "word_length", "symbols", "symbol_runs", "capitals", "letters", "digits", "exclaims",
    "line_length", "repeated_lines", "distinct_words", "doubled_words", "sentence_ends", "commas",
)
#: Their columns, named so that no column of a table clashes.
FEATURES = tuple(f"__f_{x}" for x in STATISTICS)


def statistics(text: Column, w: Column, lines: Column, letters: Column) -> dict[str, Column]:
    text = F.coalesce(text, F.lit(""))
    size = lambda x: F.length(x).cast("double")
    without = lambda chars: size(text) - size(F.translate(text, chars, ""))
    matching = lambda pattern: size(text) - size(F.regexp_replace(text, pattern, ""))
    per = lambda a, b: a / F.greatest(b, F.lit(1.0))
    n = F.size(w).cast("double")
    dense = size(text) - without(SPACE_CHARS)
    doubled = F.size(F.filter(w, lambda x, i: F.coalesce(x == F.get(w, i - 1), F.lit(False)))).cast("double")
    return {
        "n_chars": size(text), "n_words": n, "word_length": per(dense, n), "symbols": per(without("#*$%&|<>"), dense),
        "symbol_runs": per(F.regexp_count(text, F.lit("[#*$%&|<>]+")).cast("double"), n), "capitals": per(matching(r"\p{Lu}+"), letters),
        "letters": per(letters, dense), "digits": per(without("0123456789"), dense), "exclaims": per(without("!?"), dense),
        "line_length": per(size(text), F.size(lines).cast("double")), "repeated_lines": 1 - per(F.size(F.array_distinct(lines)).cast("double"), F.size(lines).cast("double")),
        "distinct_words": per(F.size(F.array_distinct(w)).cast("double"), n), "doubled_words": per(doubled, n), "sentence_ends": per(without("."), n), "commas": per(without(","), n),
    }


def features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds FEATURES to docs."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    w, lines, letters = free(docs, "__w", "__l", "__letters")
    df = docs.withColumn(w, words(text)).withColumn(lines, F.split(text, "\n"))
    df = df.withColumn(letters, (F.length(text) - F.length(F.regexp_replace(text, r"\p{L}+", ""))).cast("double"))
    return df.withColumns({f"__f_{k}": v for k, v in statistics(F.col(text_col), F.col(w), F.col(lines), F.col(letters)).items()}).drop(w, lines, letters)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


class Trees:
    """Boosted trees as flat arrays. feature is -1 at leaves, whose left and right are
    themselves."""

    def __init__(self, start: float, roots, feature, threshold, left, right, value):
        self.start, self.roots = start, np.asarray(roots, "i4")
        self.feature, self.threshold = np.asarray(feature, "i4"), np.asarray(threshold, "f8")
        self.left, self.right, self.value = np.asarray(left, "i4"), np.asarray(right, "i4"), np.asarray(value, "f8")

    def score(self, x: np.ndarray, depth: int = DEPTH) -> np.ndarray:
        total, rows = np.full(len(x), self.start), np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root, "i4")
            for _ in range(depth):
                f = self.feature[at]
                at = np.where(x[rows, np.maximum(f, 0)] <= self.threshold[at], self.left[at], self.right[at])
            total += self.value[at]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE, min_leaf: int = MIN_LEAF, l2: float = L2) -> Trees:
    """Boosting of the logistic loss. Levels are grown together: one weighted bincount a feature
    gives the histograms of all nodes of a level."""
    n, k = x.shape if len(x) else (0, len(FEATURES))
    if n == 0 or y.min() == y.max():
        return Trees(0.0, [], [-1], [0], [0], [0], [0])
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(k)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
    p = y.mean()
    start = float(np.log(p / (1 - p)))
    margin = np.full(n, start)
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def leaf(g: float, h: float) -> int:
        i = len(feature)
        for a, b in ((feature, -1), (threshold, 0.0), (left, i), (right, i), (value, -rate * g / (h + l2))):
            a.append(b)
        return i

    for _ in range(trees):
        prob = 1 / (1 + np.exp(-margin))
        grad, hess = prob - y, prob * (1 - prob)
        roots.append(leaf(grad.sum(), hess.sum()))
        node = np.full(n, roots[-1])
        level = [roots[-1]]
        for _ in range(depth):
            slot = np.full(len(feature), -1)
            slot[level] = np.arange(len(level))
            rows = np.flatnonzero(slot[node] >= 0)
            m, s = len(level), slot[node[rows]]
            best = [(1e-6, -1, -1, None)] * m
            for j in range(k):
                cell = s * (bins + 1) + binned[rows, j]
                shape = (m, bins + 1)
                g, h, c = (np.bincount(cell, wt, m * (bins + 1)).reshape(shape).cumsum(1) for wt in (grad[rows], hess[rows], None))
                gt, ht, ct = g[:, -1:], h[:, -1:], c[:, -1:]
                gain = g**2 / (h + l2) + (gt - g) ** 2 / (ht - h + l2) - gt**2 / (ht + l2)
                gain[(c < min_leaf) | (ct - c < min_leaf)] = -1
                gain = gain[:, : len(edges[j])]
                if not gain.shape[1]:
                    continue
                b = gain.argmax(1)
                for i in range(m):
                    if gain[i, b[i]] > best[i][0]:
                        best[i] = (gain[i, b[i]], j, b[i], (g[i, b[i]], h[i, b[i]], gt[i, 0], ht[i, 0]))
            following = []
            for i, (_, j, b, sums) in enumerate(best):
                if j < 0:
                    continue
                at, (g, h, gt, ht) = level[i], sums
                lo, hi = leaf(g, h), leaf(gt - g, ht - h)
                feature[at], threshold[at], left[at], right[at] = j, float(edges[j][b]), lo, hi
                own = rows[s == i]
                node[own] = np.where(binned[own, j] <= b, lo, hi)
                following += [lo, hi]
            level = following
            if not level:
                break
        margin += np.asarray(value)[node]
    return Trees(start, roots, feature, threshold, left, right, value)


def train(rows: DataFrame, limit: int = TRAIN_ROWS, **params) -> Trees:
    """rows: doc_id, FEATURES, quality. At most limit rows, by a hash of doc_id, reach the driver. A threshold on the hash
    leaves about a quarter more for the ordering, so what all tasks give out doesn't grow with the labels. Should many rows
    of one doc_id lie beyond the threshold, the sample is smaller than limit."""
    rows = rows.filter(F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    if (n := rows.count()) > 1.25 * limit:
        rows = rows.filter(F.conv(F.substring(order, 1, 8), 16, 10).cast("long") < int(1.25 * limit / n * 2**32))
    picked = rows.orderBy(order, "doc_id", *FEATURES).limit(limit)
    got = picked.select(*FEATURES, F.col("quality").cast("double").alias("quality")).toPandas().to_numpy("f8")
    return fit(got[:, :-1], got[:, -1], **params) if len(got) else fit(np.zeros((0, len(FEATURES))), np.zeros(0))


def _score(batches: Iterator, model: Trees, keep: int, name: str) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        x = np.stack([np.asarray(batch.column(keep + j)) for j in range(len(FEATURES))], 1) if batch.num_rows else np.zeros((0, len(FEATURES)))
        cols = [batch.column(j) for j in range(keep)]
        yield pa.RecordBatch.from_arrays([*cols, pa.array(model.score(x), pa.float64())], [*batch.schema.names[:keep], name])


def score(rows: DataFrame, model: Trees, name: str = "score") -> DataFrame:
    """rows with FEATURES: their other columns and the score. The model is a few thousand numbers."""
    from pyspark.sql import types as T

    other = [c for c in rows.columns if c not in FEATURES]
    rows = rows.select(*other, *FEATURES)
    schema = T.StructType([*[rows.schema[c] for c in other], T.StructField(name, T.DoubleType())])
    return rows.mapInArrow(partial(_score, model=model, keep=len(other), name=name), schema)


def classify(docs: DataFrame, labels: DataFrame, keep_columns: bool = False, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """doc_id, score and predicted (by names) of every document; with keep_columns, all columns of
    docs too, so choose names that docs hasn't."""
    docs = docs if keep_columns else docs.select("doc_id", "text")
    stats = features(docs)
    stats = cut(stats if keep_columns else stats.drop("text"), "quality")
    known = labels.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    model = train(stats.select("doc_id", *FEATURES).join(known, "doc_id"))
    return score(stats, model, names[0]).withColumn(names[1], (F.col(names[0]) >= 0.5).cast("int"))


def op4_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = classify(documents(spark, sf_dir), table(spark, sf_dir, "labels"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
