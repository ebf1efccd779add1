"""Principal components, and the frame that a scatter plot needs."""

from __future__ import annotations

import importlib.util
from collections.abc import Sequence

import numpy as np
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pca(df: DataFrame, vector_col: str, k: int = 2) -> tuple[DataFrame, list[float]]:
    """df with pc (the projection of the centred vector) and what each axis explains, in percent. Axes point so that their largest loading is positive."""
    vectors = df.withColumn("__v", array_to_vector(F.transform(vector_col, lambda x: x.cast("double"))))
    centred = StandardScaler(inputCol="__v", outputCol="__c", withMean=True, withStd=False).fit(vectors).transform(vectors)
    model = PCA(k=k, inputCol="__c", outputCol="__p").fit(centred)
    axes = model.pc.toArray()
    signs = np.sign(axes[np.abs(axes).argmax(axis=0), range(k)])
    raw = model.transform(centred).withColumn("pc", vector_to_array("__p"))
    turned = F.transform(F.arrays_zip("pc", F.array(*(F.lit(float(s)) for s in signs)).alias("sign")), lambda z: z["pc"] * z["sign"])
    return raw.withColumn("pc", turned).drop("__v", "__c", "__p"), [100.0 * float(x) for x in model.explainedVariance]


def umap(df: DataFrame, vector_col: str, k: int = 2, seed: int = 42):
    """Of vectors that fit the driver, by the umap package where it is installed."""
    if importlib.util.find_spec("umap") is None:
        raise ImportError("umap-learn isn't installed; pca() needs no further package")
    import umap as package

    rows = np.array([r[0] for r in df.select(vector_col).collect()])
    return package.UMAP(n_components=k, random_state=seed).fit_transform(rows)


def plot_frame(df: DataFrame, vector_col: str, label_col: str, dims: Sequence[int] = (1, 2), explained: Sequence[float] | None = None) -> tuple[DataFrame, list[str]]:
    """(x1.., labels) and the titles of the axes."""
    if not isinstance(df, DataFrame):
        raise TypeError("a DataFrame with a vector column is needed")
    if explained is not None and len(explained) < max(dims):
        raise ValueError("explained has fewer entries than the axes that are shown")
    n = len(df.select(vector_col).first()[0])
    frame = df.select(*(F.element_at(vector_col, i + 1).alias(f"x{i + 1}") for i in range(n)), F.col(label_col).alias("labels"))
    return frame, [f"x{d}" if explained is None else f"x{d} ({explained[d - 1]:.1f}%)" for d in dims]
