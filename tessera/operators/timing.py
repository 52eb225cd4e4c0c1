"""A10: times and row counts recorded by the programs themselves.

``ProgramTimes`` wraps each write of a program in Spark's ``Observation``: the
rows that passed, and the first and last time a task saw one, are collected by
the tasks as the data goes by, so nothing is counted a second time.  Begin and
end of the stage are the driver's.  Every record is appended to a table, which
``train.timing_report`` turns into minutes per stage and in total.
"""

from __future__ import annotations

import time
from contextlib import contextmanager
from typing import Callable, Iterator

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

TIMES = "program string, seq int, stage string, rows bigint, begin_ms bigint, end_ms bigint, first_ms bigint, last_ms bigint"


def _now() -> int:
    return time.time_ns() // 1_000_000


class ProgramTimes:
    """Records of one program run, appended to the table at ``path``."""

    def __init__(self, spark: SparkSession, path: str, program: str):
        self.spark, self.path, self.program, self.seq = spark, path, program, 0

    def _append(self, stage: str, rows: int | None, begin: int, first: int | None = None, last: int | None = None) -> None:
        row = (self.program, self.seq, stage, rows, begin, _now(), first, last)
        self.spark.createDataFrame([row], TIMES).coalesce(1).write.mode("append").parquet(self.path)
        self.seq += 1

    def write(self, stage: str, df: DataFrame, sink: Callable[[DataFrame], object]):
        """``sink(df)`` with its rows and times observed; returns what the sink returns.

        The sink must run one action over the frame it is given.  A stage that
        fails leaves no record."""
        seen = Observation()
        clock = F.expr("java_method('java.lang.System', 'currentTimeMillis')").cast("bigint")
        begin = _now()
        out = sink(df.observe(seen, F.count(F.lit(1)).alias("rows"), F.min(clock).alias("first_ms"), F.max(clock).alias("last_ms")))
        got = seen.get
        self._append(stage, got["rows"], begin, got["first_ms"], got["last_ms"])
        return out

    @contextmanager
    def measure(self, stage: str) -> Iterator[None]:
        """Times of a block that writes nothing of its own, such as training; no record if it raises."""
        begin = _now()
        yield
        self._append(stage, None, begin)

    def table(self) -> DataFrame:
        """The records of this program, in order of ``seq``."""
        return self.spark.read.schema(TIMES).parquet(self.path).filter(F.col("program") == self.program)


__all__ = ["ProgramTimes", "TIMES"]
