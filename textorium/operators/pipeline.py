"""Linear pipelines of named steps over one table, and registries that make steps by name.

A step is a filter (a predicate), a processor (a function of a value whose failures stay with their rows) or any function of a
table. Filters mark rows rather than drop them until the end, so that one pass also tells how many each step let through.

Cases: a null predicate lets nothing through; a row that a step has failed or dropped is not given to later processors; an
empty pipeline returns its input; a name that is registered twice or not at all is an error that lists the known ones.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .filters import captured

AT, WHY = "_stopped_at", "_stopped_by"


@dataclass
class Pipeline:
    """Steps in order; `then` methods return a longer pipeline, so that common beginnings can be shared."""

    steps: tuple[tuple[str, Callable[[DataFrame], DataFrame]], ...] = field(default=())

    def then(self, name: str, step: Callable[[DataFrame], DataFrame]) -> Pipeline:
        if name in dict(self.steps):
            raise ValueError(f"two steps are called {name}")
        return Pipeline((*self.steps, (name, step)))

    def keep(self, name: str, predicate: Column) -> Pipeline:
        """Rows for which the predicate doesn't hold stop here."""
        passes = F.coalesce(predicate, F.lit(False))
        stop = F.col(AT).isNull() & ~passes
        return self.then(name, lambda d: d.withColumns({AT: F.when(stop, F.lit(name)).otherwise(F.col(AT)), WHY: F.when(stop, F.lit("filtered")).otherwise(F.col(WHY))}))

    def process(self, name: str, column: str, step: Callable, result: str = "string", into: str | None = None) -> Pipeline:
        """step(value) as a new column (the step's name unless `into`); rows for which it raises stop here with what it raised."""

        def run(d: DataFrame) -> DataFrame:
            given = d.withColumn("_given", F.when(F.col(AT).isNull(), F.struct(F.col(column).alias("v"))))
            out = captured(given.withColumn("_v", F.col("_given.v")).withColumn("_go", F.col("_given").isNotNull()), "_v", step, result)
            failed = F.col("_go") & F.col("error").isNotNull()
            out = out.withColumns({AT: F.when(failed, F.lit(name)).otherwise(F.col(AT)), WHY: F.when(failed, F.col("error")).otherwise(F.col(WHY)), into or name: F.when(F.col("_go"), F.col("result"))})
            return out.drop("_given", "_v", "_go", "result", "error")

        return self.then(name, run)

    def marked(self, rows: DataFrame) -> DataFrame:
        """All rows, with the step that stopped them and why; null for those that came through."""
        d = rows.withColumns({AT: F.lit(None).cast("string"), WHY: F.lit(None).cast("string")})
        for _, step in self.steps:
            d = step(d)
        return d

    def run(self, rows: DataFrame) -> DataFrame:
        """The rows that came through every step."""
        return self.marked(rows).filter(F.col(AT).isNull()).drop(AT, WHY)

    def report(self, rows: DataFrame) -> DataFrame:
        """(step, stopped, failed), a row per step that stopped any, from one pass."""
        g = self.marked(rows).filter(F.col(AT).isNotNull()).groupBy(F.col(AT).alias("step"))
        return g.agg(F.count("*").alias("stopped"), F.count_if(F.col(WHY) != "filtered").alias("failed"))


class Registry:
    """Makers by name: builders, scorers, chunkers, report tables."""

    def __init__(self, what: str):
        self.what, self.makers = what, {}

    def register(self, name: str, maker: Callable | None = None):
        """As a function or as a decorator."""

        def add(f):
            if name in self.makers:
                raise ValueError(f"{self.what} {name} is registered already; known: {', '.join(sorted(self.makers))}")
            self.makers[name] = f
            return f

        return add if maker is None else add(maker)

    def make(self, name: str, *args, **options):
        if name not in self.makers:
            raise KeyError(f"no {self.what} {name}; known: {', '.join(sorted(self.makers))}")
        return self.makers[name](*args, **options)
