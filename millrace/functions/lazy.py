"""pandas functions that need no session until they are used, and values that expressions share."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column
from pyspark.sql import functions as F


def pandas_function(returns: str) -> Callable:
    def wrap(f: Callable) -> Callable[..., Column]:
        made = []

        @wraps(f)
        def call(*columns: Column | str) -> Column:
            if not made:
                made.append(F.pandas_udf(f, returns))
            return made[0](*columns)

        return call

    return wrap


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is used, inside of lambdas too."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
