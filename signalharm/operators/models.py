"""Trained task models: reduced-rank classifier, multi-target partial least squares."""

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A

C_GRID = (0.01, 0.1, 1.0, 10.0)  # fixed value
COMPONENT_GRID = (2, 4, 8, 16, 32)  # fixed value


def features(df: DataFrame, column: str = "y") -> DataFrame:
    return df.withColumn("features", array_to_vector(F.col(column)))


def train_classifier(train: DataFrame, validation: DataFrame, label: str, k: int = 20, grid=C_GRID):
    """PCA and multinomial L2 logistic regression; strength chosen on validation.

    Returns (model, chosen C, [(C, validation accuracy)]); the first best wins.
    """
    n = train.count()
    reducer = PCA(k=k, inputCol="features", outputCol="reduced").fit(features(train))
    fit, check = (reducer.transform(features(d)).select("reduced", label).persist() for d in (train, validation))
    judge = MulticlassClassificationEvaluator(labelCol=label, predictionCol="prediction", metricName="accuracy")
    scores, best = [], None
    for c in grid:
        model = LogisticRegression(
            featuresCol="reduced",
            labelCol=label,
            regParam=1.0 / (c * n),
            elasticNetParam=0.0,
            standardization=False,
            family="multinomial",
            maxIter=200,
        ).fit(fit)
        accuracy = judge.evaluate(model.transform(check))
        scores.append((c, accuracy))
        if best is None or accuracy > best[1]:
            best = (c, accuracy, model)
    fit.unpersist()
    check.unpersist()
    return PipelineModel(stages=[reducer, best[2]]), best[0], scores


def moments(df: DataFrame, x: str, y: str) -> tuple[int, np.ndarray]:
    """Row count and Gram matrix of [1, x, y]: one partial matrix per partition,
    summed by index, so only a (1+p+q)^2 table reaches the driver."""

    def partial(batches):
        total = None
        for b in batches:
            z = np.column_stack([np.ones(len(b)), np.stack(b["_x"].to_numpy()), np.stack(b["_y"].to_numpy())]) if len(b) else None
            if z is not None:
                g = z.T @ z
                total = g if total is None else total + g
        if total is not None:
            i, j = np.indices(total.shape)
            yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "g": total.ravel()})

    cells = (
        df.select(F.col(x).alias("_x"), F.col(y).alias("_y"))
        .mapInPandas(partial, "i int, j int, g double")
        .groupBy("i", "j")
        .agg(F.sum("g").alias("g"))
        .toPandas()
    )
    size = int(cells["i"].max()) + 1
    gram = np.zeros((size, size))
    gram[cells["i"], cells["j"]] = cells["g"]
    return int(round(gram[0, 0])), gram


def pls_coefficients(gram: np.ndarray, p: int, components) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Regression matrix and intercept per component count, from moments alone.

    Both sides are centred and scaled by sample deviation; weights are the
    leading left singular vector of the deflated cross product.
    """
    n = gram[0, 0]
    mean = gram[0, 1:] / n
    cov = gram[1:, 1:] - n * np.outer(mean, mean)
    scale = np.sqrt(np.diag(cov) / (n - 1))
    scale[scale == 0] = 1.0
    c = cov / np.outer(scale, scale)
    xx, xy = c[:p, :p].copy(), c[:p, p:].copy()
    w_list, p_list, q_list, out = [], [], [], {}
    for k in range(1, max(components) + 1):
        w = np.linalg.svd(xy, full_matrices=False)[0][:, 0]
        t = w @ xx @ w
        if t <= 1e-12 * np.trace(c[:p, :p]):
            break
        load, q = xx @ w / t, xy.T @ w / t
        w_list.append(w)
        p_list.append(load)
        q_list.append(q)
        xx = xx - t * np.outer(load, load)
        xy = xy - t * np.outer(load, q)
        if k in components:
            w_, p_, q_ = (np.column_stack(v) for v in (w_list, p_list, q_list))
            b = w_ @ np.linalg.pinv(p_.T @ w_) @ q_.T
            b = b * scale[p:] / scale[:p, None]
            out[k] = (b, mean[p:] - mean[:p] @ b)
    return out


def pls_predict(df: DataFrame, x: str, coefficients, intercept) -> DataFrame:
    """Add ``predicted`` (array) by dot products with literal coefficients."""
    cols = [
        A.dot(F.col(x), F.array(*[F.lit(float(v)) for v in coefficients[:, j]])) + F.lit(float(intercept[j]))
        for j in range(coefficients.shape[1])
    ]
    return A.pin(df, {"predicted": F.array(*cols)})


def macro_error(df: DataFrame, y: str, q: int) -> float:
    """Mean over targets of the range-normalised root mean squared error."""
    parts = []
    for j in range(q):
        t, p = F.get(y, F.lit(j)), F.get("predicted", F.lit(j))
        parts.append(F.sqrt(F.avg((p - t) * (p - t))) / (F.max(t) - F.min(t)))
    row = df.agg(*[c.alias(f"e{j}") for j, c in enumerate(parts)]).first()
    return float(np.mean(list(row)))


def pls_fit(train: DataFrame, validation: DataFrame, x: str, y: str, p: int, grid=COMPONENT_GRID):
    """Component count by validation error, the smaller on a tie."""
    _, gram = moments(train, x, y)
    fits = pls_coefficients(gram, p, [k for k in grid if k <= p])
    q = gram.shape[0] - 1 - p
    scores = {k: macro_error(pls_predict(validation, x, *fits[k]), y, q) for k in fits}
    best = min(scores, key=lambda k: (scores[k], k))
    return fits[best], best, scores
