"""Final projection shared by every registered query."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scalars import tidy


def present(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round doubles, widen integers, days into ISO text, timestamps into epoch seconds."""
    cols = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            c = tidy(c.cast("double"), digits)
        elif isinstance(field.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        elif isinstance(field.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.unix_seconds(c.cast("timestamp"))
        cols.append(c.alias(field.name))
    return df.select(*cols)
