"""Column expressions that are built once, as a large one takes hundreds of calls to the JVM, which outweigh a small job; and values that a row computes once."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F


def kept(f: Callable) -> Callable:
    """f, a function of strings that makes a Column, remembered for as long as the JVM that its Columns live in."""
    made: dict = {}

    @wraps(f)
    def get(*args: str):
        jvm = id(SparkContext._gateway)
        if (jvm, *args) not in made:
            made[(jvm, *args)] = f(*args)
        return made[(jvm, *args)]

    return get


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once for each row: where an expression says it again in branches, Spark computes it again."""
    return F.element_at(F.transform(F.array(value), body), 1)
