"""Vectors stored as little-endian float32 bytes, converted in Arrow batches at the edge of the engine."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.ArrayType(T.FloatType()))
def _decode(blob: pd.Series) -> pd.Series:
    return blob.map(lambda b: None if b is None else np.frombuffer(b, dtype="<f4"))


@F.pandas_udf(T.BinaryType())
def _encode(vector: pd.Series) -> pd.Series:
    return vector.map(lambda v: None if v is None else np.asarray(v, dtype="<f4").tobytes())


def decode_vectors(rows: DataFrame, blob: str, name: str) -> DataFrame:
    return rows.withColumn(name, _decode(blob))


def encode_vectors(rows: DataFrame, vector: str, name: str) -> DataFrame:
    return rows.withColumn(name, _encode(vector))
