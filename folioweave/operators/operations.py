"""The log of import and delete operations as a table: listings, counts, progress, cleaned parameters.

Running jobs is Spark's own work; what is kept here is the log that a user reads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import without_secrets
from ..model import OPERATIONS_PAGE

#: The states an operation can end in.
FINAL_STATES = ["COMPLETED", "CANCELLED", "FAILED"]


def of_accounts(operations: DataFrame, accounts: list[str] | None, power: bool = False) -> DataFrame:
    """Operations of the accounts; all of them for a user with full rights, none without any account."""
    return operations if power else operations.where(F.col("account").isin(accounts or []))


def listed(
    operations: DataFrame, accounts: list[str] | None = None, power: bool = False, ascending: bool = False,
    after: int | None = None, limit: int | None = None, id_col: str = "id", time_col: str = "created_at",
) -> DataFrame:
    """A page of operations by time of creation, the newest first unless ``ascending``; 300 if no size is given.

    ``after`` is the id of the last operation seen. Parameters are told without secrets.
    """
    rows = of_accounts(operations, accounts, power)
    if after is not None:
        rows = rows.where(F.col(id_col) > after if ascending else F.col(id_col) < after)
    by = [F.col(c) if ascending else F.col(c).desc() for c in (time_col, id_col)]
    page = rows.orderBy(*by).limit(max(1, limit) if limit is not None else OPERATIONS_PAGE)
    return page.withColumn("parameters", without_secrets(F.col("parameters"))) if "parameters" in page.columns else page


def counted(operations: DataFrame, accounts: list[str] | None = None, power: bool = False) -> DataFrame:
    """Operations by state, and whether the state is final."""
    rows = of_accounts(operations, accounts, power).groupBy("state").agg(F.count("*").alias("n"))
    return rows.withColumn("final", F.col("state").isin(FINAL_STATES))


def silent(operations: DataFrame, now: Column, seconds: int = 3600, id_col: str = "id", seen_col: str = "updated_at") -> DataFrame:
    """Operations that wait, or run without a sign of life for ``seconds``, the oldest first: what to take up next."""
    quiet = (F.col("state") == "PROCESSING") & (F.unix_timestamp(now) - F.unix_timestamp(F.col(seen_col)) > seconds)
    return operations.where((F.col("state") == "PENDING") | quiet).orderBy(id_col)


def progress(operations: DataFrame, began: str = "created_at", seen: str = "updated_at", records: str = "records_done", size: str = "bytes_done") -> DataFrame:
    """Operations with records and bytes a second so far; null before any time has passed."""
    took = F.unix_timestamp(seen) - F.unix_timestamp(began)
    rate = lambda c: F.when(took > 0, F.col(c) / took)
    return operations.withColumns({"records_per_second": rate(records), "bytes_per_second": rate(size)})
