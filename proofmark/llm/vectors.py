"""What the operators on vectors share: which rows take part, and their numbers as matrices."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vector: Column) -> Column:
    """Whether a vector is there and holds finite numbers only; never null."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & good, F.lit(False))


def commonest_length(vectors: DataFrame, column: str) -> int:
    """The length that most vectors have, of equally frequent ones the largest; 0 where there is no vector."""
    lengths = vectors.select(F.size(column).alias("length")).groupBy("length").count()
    first = lengths.orderBy(F.desc("count"), F.desc("length")).first()
    return first["length"] if first else 0


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """The lists of a column, all of `width` numbers, as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
