"""Quality scores from a regularised quadratic discriminant over transformed document statistics.

The statistics are built-in expressions over the whole text. A class's mean and covariance come from sums
over all labelled rows outside the held-out fold, aggregated before they are shuffled, so nothing is sampled.
Covariances are shrunk towards the pooled one and then towards a multiple of the identity; their inverse
Cholesky factors are computed once on the driver (a matrix of the number of statistics) and enter the score
as constants: the log-density difference is two sums of squares.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import SPACES, table, text_of
from tessera.session import stash

POOL = 0.1
RIDGE = 0.02
#: Ratios below this count as this before their logarithm is taken.
LEAST = 1e-3


def _count(t: Column, chars: str) -> Column:
    return (F.length(t) - F.length(F.translate(t, chars, ""))).cast("double")


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``doc_id`` and the transformed statistics x0, x1, ...: sizes and ratios on a logarithmic scale.

    Null texts count as empty; ratios of an empty text are zero.
    """
    words = F.filter(F.split(F.col("t"), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(text_col).alias("t")).select("doc_id", "t", words.alias("w"))
    chars = F.greatest(F.length("t"), F.lit(1)).cast("double")
    many = F.greatest(F.size("w"), F.lit(1)).cast("double")
    twins = F.expr("aggregate(zip_with(w, slice(w, 2, size(w)), (a, b) -> if(a = b, 1, 0)), 0, (s, x) -> s + coalesce(x, 0))")
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    sizes = [F.length("t").cast("double"), F.size("w").cast("double"), _count(F.col("t"), "\n") + 1.0]
    ratios = [
        (F.length("t") - _count(F.col("t"), SPACES)) / many / 10.0,
        _count(F.col("t"), "#*$%&<>") / chars,
        _count(F.col("t"), "|") / many,
        _count(F.col("t"), "!") / many,
        _count(F.col("t"), letters) / chars,
        _count(F.col("t"), "0123456789") / chars,
        _count(F.col("t"), ".,;:?") / many,
        F.size(F.array_distinct("w")) / many,
        twins / many,
    ]
    columns = [F.log1p(c) for c in sizes] + [F.log(c + F.lit(LEAST)) for c in ratios]
    return base.select("doc_id", *[c.alias(f"x{k}") for k, c in enumerate(columns)])


def held_out(key: Column) -> Column:
    """The fold that labels are never learnt from."""
    return F.crc32(key.cast("string").cast("binary")) % 3 == 1


def moments(rows: DataFrame, names: list[str], label: str) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """n, sum and sum of products by class: one row a class reaches the driver."""
    d = len(names)
    sums = [F.count("*").cast("double")] + [F.sum(n) for n in names]
    sums += [F.sum(F.col(names[i]) * F.col(names[j])) for i in range(d) for j in range(i + 1)]
    found = {}
    for row in rows.groupBy(label).agg(*[s.alias(f"s{k}") for k, s in enumerate(sums)]).collect():
        key, n, *rest = row
        second = np.zeros((d, d))
        second[np.tril_indices(d)] = rest[d:]
        found[int(key)] = (n, np.array(rest[:d]), second + np.tril(second, -1).T)
    return found


def fit(found: dict[int, tuple[float, np.ndarray, np.ndarray]], pool: float = POOL, ridge: float = RIDGE) -> dict[int, tuple[np.ndarray, np.ndarray, float]]:
    """By class: mean, inverse Cholesky factor of the shrunk covariance, and log prior less half the log determinant."""
    if not found:
        return {}
    total = sum(n for n, *_ in found.values())
    means = {k: s / n for k, (n, s, _) in found.items()}
    scatter = {k: q / n - np.outer(means[k], means[k]) for k, (n, _, q) in found.items()}
    pooled = sum(n / total * scatter[k] for k, (n, *_) in found.items())
    model = {}
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-6))
    for k, (n, *_) in found.items():
        shrunk = (1 - pool) * scatter[k] + pool * pooled
        unit = shrunk / np.outer(scale, scale)
        unit = (1 - ridge) * unit + ridge * max(np.trace(unit) / len(unit), 1e-3) * np.eye(len(unit))
        factor = np.linalg.cholesky(unit)
        inverse = np.linalg.solve(factor, np.diag(1 / scale))
        model[k] = (means[k], inverse, float(np.log(n / total) - np.log(np.diag(factor)).sum()))
    return model


def scored(rows: DataFrame, model: dict, names: list[str]) -> DataFrame:
    """``rows`` with ``score``, P(class 1) from the difference of the classes' log densities, instead of the statistics.

    The whitened statistics are columns of their own before they are squared, so that each stays a short expression.
    """
    rest = [c for c in rows.columns if c not in names]
    if set(model) != {0, 1}:  # one class alone, or none: its share is all that is known
        return rows.select(*rest, F.lit(float(next(iter(model), 0.5))).alias("score"))
    columns, density = [], {}
    for k, (mean, inverse, constant) in model.items():
        density[k] = F.lit(constant)
        for i in range(len(names)):
            z = sum(((F.col(names[j]) - float(mean[j])) * float(inverse[i, j]) for j in range(i + 1)), F.lit(0.0))
            columns.append(z.alias(f"z{k}_{i}"))
            density[k] = density[k] - F.col(f"z{k}_{i}") * F.col(f"z{k}_{i}") * 0.5
    whitened = rows.select(*rest, *columns)
    difference = density[0] - density[1]
    return whitened.select(*rest, (1.0 / (1.0 + F.exp(F.greatest(F.least(difference, F.lit(500.0)), F.lit(-500.0))))).alias("score"))


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document; only labels outside the held-out fold are learnt.

    Rows with a null or other label teach nothing; a label that a doc_id repeats counts as often, and one doc_id in
    several rows is scored row by row; a null doc_id is scored and not held out. Empty texts have a score like any
    other. With one class of labels the score is that class, with none 0.5. An empty table gives an empty result.
    """
    found = stash(statistics(docs), "statistics")
    names = [c for c in found.columns if c != "doc_id"]
    known = labels.select(F.col("doc_id").cast("long").alias("l_id"), F.col(label).cast("int").alias("label")).where(f"label in (0, 1)")
    taught = found.join(known.where(~held_out(F.col("l_id"))), F.col("doc_id") == F.col("l_id"))
    model = fit(moments(taught, names, "label"))
    fold = F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out")
    return scored(found.select("doc_id", fold, *names), model, names).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score. Null and empty texts are scored as empty; a null doc_id is not held out; repeated rows are
    scored alike; null labels teach nothing; an empty table gives no rows."""
    return classify(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
