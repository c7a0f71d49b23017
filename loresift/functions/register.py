"""The text functions under SQL names."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.index import tokens_of
from .stem import stem


@F.pandas_udf(T.StringType())
def _stem(words: pd.Series) -> pd.Series:
    return words.map(lambda w: w if w is None else stem(w))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _tokenize(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: tokens_of(t or ""))


def register(spark: SparkSession) -> None:
    """``stem(word)`` and ``tokenize(text)`` in Spark SQL; plans use the Column functions instead."""
    spark.udf.register("stem", _stem)
    spark.udf.register("tokenize", _tokenize)
