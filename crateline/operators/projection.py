"""Map coordinates from principal components."""

from __future__ import annotations

from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REDUCED = 64


def reduced(df: DataFrame, k: int = REDUCED, vec: str = "vec") -> DataFrame:
    """The first k components of every vector; each axis is turned so that its largest loading is positive.

    The covariance is summed over partitions; only a square of the vector's width is held in one place.
    """
    dense = df.withColumn("_v", array_to_vector(F.col(vec).cast("array<double>")))
    model = PCA(k=k, inputCol="_v", outputCol="_p").fit(dense)
    loadings = model.pc.toArray()
    signs = [1.0 if loadings[abs(loadings[:, i]).argmax(), i] >= 0 else -1.0 for i in range(k)]
    turned = F.zip_with(vector_to_array("_p"), F.array(*[F.lit(s) for s in signs]), lambda x, s: x * s)
    return model.transform(dense).withColumn("reduced", turned).drop("_v", "_p")


def project(df: DataFrame, k: int = REDUCED, vec: str = "vec") -> DataFrame:
    """Two map coordinates per row."""
    flat = reduced(df, k, vec)
    return flat.withColumn("x", F.element_at("reduced", 1)).withColumn("y", F.element_at("reduced", 2))
