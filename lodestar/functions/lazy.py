"""Pandas UDFs that are made when they are called: executors can import their modules."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import functions as F


def column_function(ddl: str):
    """Decorator: a function over pandas Series becomes one over columns, of type ``ddl``."""

    def wrap(f):
        @wraps(f)
        def call(*columns):
            return F.pandas_udf(f, ddl)(*columns)

        return call

    return wrap
