"""A rounded moving average as an associative merge, so that one key may hold any share of the log.

One step, x -> floor((7 x + 3 ms + 5) / 10), is a rising function of x. So is any run of steps, and as each shrinks distances to 0.7 of
their size, a long run has few results: it is kept as the values it can give and the least x that leads to each. Two neighbouring runs
compose to one of the same kind. The log is dealt out in ranges of (key, time), so a hot key is spread over all tasks; each task
turns what it holds of a key into one function, and the functions of a key are composed in a tree.
"""
from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Steps up to which a run is kept as it is. After so many steps numbers below 2**53 are at most some ten apart.
PLAIN = 96
#: The largest x a run is asked about.
TOP = 1 << 53
#: Functions composed at a time.
FAN = 64
RUN = "alone bigint, plain array<bigint>, least array<bigint>, result array<bigint>"


def step(x: int, ms: int) -> int:
    return (7 * x + 3 * ms + 5) // 10


def back(y: int, ms: int) -> int:
    """The least x that a step takes to y or more."""
    return -((5 + 3 * ms - 10 * y) // 7)


class Run:
    """A run of steps: `alone` is its result without a value before; `plain` its steps, or else f(x) = result[how many of `least` are <= x]."""

    __slots__ = ("alone", "plain", "least", "result")

    def __init__(self, alone: int, plain: list[int] | None, least: list[int], result: list[int]):
        self.alone, self.plain, self.least, self.result = alone, plain, least, result

    def after(self, x: int) -> int:
        if self.plain is None:
            return self.result[bisect_right(self.least, x)]
        for ms in self.plain:
            x = step(x, ms)
        return x

    def packed(self) -> "Run":
        """The same function by its results."""
        if self.plain is None:
            return self
        low, high = self.after(0), self.after(TOP)
        least = []
        for y in range(low + 1, high + 1):
            for ms in reversed(self.plain):
                y = back(y, ms)
            least.append(y)
        return Run(self.alone, None, least, list(range(low, high + 1)))

    def then(self, ms: int) -> "Run":
        """One step more; changes this run."""
        self.alone = step(self.alone, ms)
        if self.plain is not None:
            self.plain.append(ms)
            if len(self.plain) > PLAIN:
                run = self.packed()
                self.plain, self.least, self.result = None, run.least, run.result
        else:
            self.settle([step(y, ms) for y in self.result])
        return self

    def settle(self, result: list[int]) -> None:
        """New results; those that have become equal are one."""
        keep = [i for i in range(1, len(result)) if result[i] != result[i - 1]]
        self.least, self.result = [self.least[i - 1] for i in keep], [result[0], *(result[i] for i in keep)]

    def compose(self, more: "Run") -> "Run":
        """This run and then another."""
        alone = more.after(self.alone)
        if self.plain is not None and more.plain is not None:
            run = Run(alone, self.plain + more.plain, [], [])
            return run if len(run.plain) <= PLAIN else run.packed()
        if self.plain is not None:  # back through the steps from where the other's results begin
            least = []
            for x in more.least:
                for ms in reversed(self.plain):
                    x = back(x, ms)
                least.append(x)
            return Run(alone, None, least, list(more.result))
        run = Run(alone, None, list(self.least), list(self.result))
        run.settle([more.after(y) for y in self.result])
        return run

    def fields(self) -> dict:
        return {"alone": self.alone, "plain": self.plain, "least": self.least, "result": self.result}


def runs_of(key: str):
    """For mapInPandas over rows sorted by key and time: one run per key of this task."""

    def fold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place = TaskContext.get().partitionId()
        out, held, run = [], None, None
        for part in parts:
            for k, ms in zip(part[key].tolist(), part["ms"].tolist()):
                if run is not None and k == held:
                    run.then(ms)
                    continue
                if run is not None:
                    out.append({key: held, "place": place, **run.fields()})
                held, run = k, Run(step0(ms), None, [], [])
                run.plain = [ms]
            if len(out) >= 10_000:
                yield pd.DataFrame(out)
                out = []
        if run is not None:
            out.append({key: held, "place": place, **run.fields()})
        if out:
            yield pd.DataFrame(out)

    return fold


def step0(ms: int) -> int:
    """The first value stands for itself."""
    return ms


def composed(key: str):
    """For applyInPandas: neighbouring runs of a key to one."""

    def compose(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place")
        whole = None
        for alone, plain, least, result in zip(rows["alone"], rows["plain"], rows["least"], rows["result"]):
            run = Run(int(alone), None if plain is None else [int(v) for v in plain], [int(v) for v in least], [int(v) for v in result])
            whole = run if whole is None else whole.compose(run)
        return pd.DataFrame([{key: rows[key].iloc[0], "place": int(rows["place"].iloc[0]) // FAN, **whole.fields()}])

    return compose


def moving_average(log: DataFrame, key: str, at: list[str], parts: int | None = None) -> DataFrame:
    """(key, avg_ms) over the rows of each key in the order of `at`: x' = round(0.7 x + 0.3 ms), starting at the first ms.

    Rows without a key or ms do not count. `parts` is into how many ranges the log is dealt; the session's shuffle partitions by default.
    """
    rows = log.select(key, *at, F.col("ms").cast("bigint").alias("ms")).filter(F.col(key).isNotNull() & F.col("ms").isNotNull())
    parts = parts or int(log.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = log.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, place int, {RUN}"
    runs = rows.repartitionByRange(parts, key, *at).sortWithinPartitions(key, *at).mapInPandas(runs_of(key), schema)
    while parts > 1:
        runs = runs.groupBy(key, F.floor(F.col("place") / FAN)).applyInPandas(composed(key), schema)
        parts = -(-parts // FAN)
    return runs.select(key, F.col("alone").alias("avg_ms"))
