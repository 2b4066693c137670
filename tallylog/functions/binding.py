"""Computing an intermediate value once: inside one expression, or between two steps."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once.

    Inside lambda functions Spark shares no common parts, and an expression that names its parts
    many times grows with every nesting.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def computed_once(df: DataFrame) -> DataFrame:
    """The same rows, with a boundary that later filters stay above.

    Spark moves a filter below the projection that computes its column and then computes the
    column twice. That is right for cheap columns, not for parsed JSON.
    """
    return df.select(F.inline_outer(F.array(F.struct(*df.columns))))


def built_once(build: Callable):
    """Keep what ``build()`` makes of columns with fixed names.

    An expression of some hundred functions takes that many calls to the JVM. A stream would
    repeat them in every micro-batch.
    """
    made: dict[int, object] = {}

    @functools.wraps(build)
    def get():
        jvm = id(SparkContext._jvm)
        if jvm not in made:
            made[jvm] = build()
        return made[jvm]

    return get
