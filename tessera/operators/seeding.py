"""Seed rows by generated statements: analysed before they run, with the error fed to the next attempt."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import guard_select

NO_ROWS = "Query returned no rows"
ATTEMPTS = "case string, attempt int, statement string, error string, row string"


def statement_error(error: Exception) -> str:
    """The condition of an analysis error, the first line of any other."""
    condition = error.getCondition() if isinstance(error, PySparkException) else None
    return condition or str(error).split("\n", 1)[0]


def seed_rows(spark: SparkSession, views: dict[str, DataFrame], cases: list[str], propose: Callable[[str, int, str | None], str | None], most: int = 3) -> DataFrame:
    """All attempts to find a row for each case: (case, attempt, statement, error, row as JSON).

    propose(case, attempt, previous error) gives a statement, or None to give the case up. A statement must be a single
    SELECT that analyses against the views; a case is done with the first row that one returns. The analysis is Spark's
    own and starts no job; the statements of a round that pass run as one job, which brings one row a case at most. Cases
    are test cases to be made, so their number is the caller's; the views may be of any size."""
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    done: list[tuple] = []
    errors: dict[str, str | None] = dict.fromkeys(cases)
    for attempt in range(1, most + 1):
        found: dict[str, tuple[str, DataFrame]] = {}
        for case in list(errors):
            statement = propose(case, attempt, errors[case])
            if statement is None:
                del errors[case]
                continue
            try:
                df = spark.sql(guard_select(statement))
                found[case] = statement, df.limit(1).select(F.lit(case).alias("case"), F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("row"))
            except Exception as error:
                errors[case] = statement_error(error)
                done.append((case, attempt, statement, errors[case], None))
        rows = {r["case"]: r["row"] for r in reduce(DataFrame.unionByName, [df for _, df in found.values()]).collect()} if found else {}
        for case, (statement, _) in found.items():
            if case in rows:
                del errors[case]
            else:
                errors[case] = NO_ROWS
            done.append((case, attempt, statement, errors.get(case), rows.get(case)))
        if not errors:
            break
    return spark.createDataFrame(done, ATTEMPTS)
