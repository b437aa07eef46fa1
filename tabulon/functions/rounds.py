"""One reading of a table for many analyses.

An analysis states the aggregates it needs and goes on when it has their values: it is a generator that yields named aggregate expressions
over the table, is sent a dictionary of their values, and returns its result. Alone it runs them in one aggregate per step; many analyses
are run in rounds, each one aggregate of everything that is asked for, so as many tables as there are analyses are read at once.
"""

from __future__ import annotations

from collections.abc import Generator, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame

from tabulon.errors import AnalysisError
from tabulon.functions.frames import in_batches

Steps = Generator[dict[str, Column], dict[str, Any], Any]

# Expressions per reading: keeps the generated code of one pass within bounds.
AGGREGATES_PER_PASS = 400


def solve_all(df: DataFrame, analyses: Sequence[Steps]) -> list[Any]:
    """The result of each analysis, or the AnalysisError it ended in; any other error ends the run."""
    results: list[Any] = [None] * len(analyses)
    waiting: dict[int, dict[str, Column]] = {}

    def go_on(i: int, values: dict[str, Any] | None) -> None:
        try:
            waiting[i] = analyses[i].send(values)
        except StopIteration as end:
            results[i] = end.value
        except AnalysisError as problem:
            results[i] = problem

    for i in range(len(analyses)):
        go_on(i, None)
    while waiting:
        asked, waiting = waiting, {}
        values: dict[int, dict[str, Any]] = {i: {} for i in asked}
        for batch in in_batches([(i, name, part) for i, parts in asked.items() for name, part in parts.items()], AGGREGATES_PER_PASS):
            row = df.agg(*[part.alias(f"a{k}") for k, (_, _, part) in enumerate(batch)]).first()
            for k, (i, name, _) in enumerate(batch):
                values[i][name] = row[k]
        for i in asked:
            go_on(i, values[i])
    return results


def solve(df: DataFrame, steps: Steps) -> Any:
    """The result of one analysis."""
    (result,) = solve_all(df, [steps])
    if isinstance(result, AnalysisError):
        raise result
    return result


def finished(result: Any) -> Steps:
    """An analysis that asks for nothing."""
    return result
    yield
