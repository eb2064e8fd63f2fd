"""Outside services behind one interface: a fetcher made once per task, retries with growing pauses, verdicts as columns.

The engine never knows a service: a fetcher is any picklable callable that makes a function from a request text to a
reply. Tests and offline runs use deterministic ones.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType


class Failed(Exception):
    """A reply that isn't one; retryable ones are tried again, after `after` seconds if the service says so."""

    def __init__(self, code: str, message: str = "", retryable: bool = False, after: float | None = None):
        super().__init__(message or code)
        self.code, self.retryable, self.after = code, retryable, after


def http_failure(status: int, message: str = "", after: float | None = None, spare_busy: bool = False) -> Failed:
    """429 and 5xx may be tried again; with spare_busy (relays) 429 isn't, so that a busy service is left alone."""
    return Failed(f"HTTP_{status}", message, status >= 500 or (status == 429 and not spare_busy), after)


def with_retry(call: Callable[[str], str], tries: int = 4, first: float = 0.5, longest: float = 8.0, linear: bool = False, sleep: Callable[[float], None] = time.sleep) -> Callable[[str], tuple[str | None, int, Failed | None]]:
    """(reply, attempts, failure) of a call: pauses double from first to longest, or grow by first if linear."""

    def run(request: str) -> tuple[str | None, int, Failed | None]:
        error: Failed | None = None
        for k in range(1, tries + 1):
            try:
                return call(request), k, None
            except Failed as e:
                error = e
                if not e.retryable or k == tries:
                    return None, k, e
                pause = first * k if linear else first * 2 ** (k - 1)
                sleep(min(longest, e.after if e.after is not None else pause))
        return None, tries, error

    return run


FETCHED = "reply string, attempts int, code string, message string, retryable boolean"


def fetch(requests: DataFrame, column: str, make: Callable[[], Callable[[str], str]], tries: int = 4, pause: float = 0.5) -> DataFrame:
    """requests with the reply to a text column and what went wrong. make is called once in each task. Rows to leave out must be filtered before: a condition around a Python function doesn't keep it from being run."""

    @F.pandas_udf(FETCHED)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        call = with_retry(make(), tries, pause)
        for s in batches:
            rows = []
            for x in s:
                reply, n, e = (None, 0, Failed("EMPTY_REQUEST")) if not x else call(x)
                rows.append((reply, n, e and e.code, e and str(e), None if e is None else e.retryable))
            yield pd.DataFrame(rows, columns=["reply", "attempts", "code", "message", "retryable"])

    return requests.withColumn("_r", run(column)).select(*requests.columns, "_r.*")


def judged(rows: DataFrame, key: str, decided, prompt, make: Callable[[], Callable[[str], str]]) -> DataFrame:
    """(key, verdict): 1 for rows that a cheap column decides, the service's yes or no for the others, 0 where it fails. Only the others are sent to it."""
    from ..functions import text as T

    sure = rows.where(F.coalesce(decided, F.lit(False))).select(key, F.lit(1.0).alias("verdict"))
    ask = rows.where(~F.coalesce(decided, F.lit(False))).select(key, prompt.alias("_p"))
    return sure.unionByName(fetch(ask, "_p", make, 3).select(key, T.verdict_of(F.col("reply")).alias("verdict")))


class NumberedLines(DataSource):
    """Text files with 1-based line numbers: spark.read.format("numbered_lines").load(glob). A partition is a file."""

    @classmethod
    def name(cls) -> str:
        return "numbered_lines"

    def schema(self) -> str:
        return "file string, line_no bigint, line string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _LineReader(self.options.get("path", ""))


class _LineReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        import glob
        import os

        p = self.path.removeprefix("file://").removeprefix("file:")
        files = sorted(f for f in (glob.glob(os.path.join(p, "*")) if os.path.isdir(p) else glob.glob(p)) if os.path.isfile(f))
        return [InputPartition(f) for f in files] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.value is None:
            return
        with open(partition.value, encoding="utf-8", errors="replace", newline=None) as f:
            for n, line in enumerate(f, 1):
                yield partition.value, n, line.rstrip("\n")


def register(spark) -> None:
    """Makes the formats of this module known to a session."""
    spark.dataSource.register(NumberedLines)
