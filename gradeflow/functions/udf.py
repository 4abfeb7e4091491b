"""Arrow-batched functions that need no session until a plan uses them."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, functions as F


def batched(schema: str) -> Callable[[Callable], Callable[..., Column]]:
    """Like pandas_udf, but the result type is parsed (by Spark) only when the function is called on columns."""

    def wrap(f: Callable) -> Callable[..., Column]:
        @functools.wraps(f)
        def on_columns(*columns) -> Column:
            return F.pandas_udf(f, schema)(*columns)

        return on_columns

    return wrap
