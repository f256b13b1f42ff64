"""Which checks are to run, to repeat or to give up, from a ledger of outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ("file_id", "module", "config_hash")
# Fixed value: how often a check is tried.
MOST_ATTEMPTS = 3
# What an expected report can be.
RUN, REPEAT, CRASHED, DONE = "RUN", "REPEAT", "CRASHED", "DONE"


def work_states(expected: DataFrame, ledger: DataFrame, most_attempts: int = MOST_ATTEMPTS) -> DataFrame:
    """``file_id, module, config_hash, attempts, state`` of every expected report.

    ``ledger``: ``file_id, module, config_hash, attempt, status``; a null status or
    CRASHED is an attempt without a report.  A report under another configuration
    does not count, so a changed profile runs anew.  ``state`` is RUN where nothing
    was tried, REPEAT after a failed attempt, CRASHED when the attempts are used
    up, and DONE with a report.  One row a report is joined, whatever the ledger's
    length.
    """
    failed = F.coalesce(F.col("status") == CRASHED, F.lit(True))
    seen = ledger.groupBy(*KEYS).agg(F.count_distinct("attempt").alias("attempts"), F.bool_or(~failed).alias("_done"))
    rows = expected.select(*KEYS).distinct().join(seen, list(KEYS), "left")
    tried = F.coalesce(F.col("attempts"), F.lit(0))
    state = F.when(F.coalesce("_done", F.lit(False)), DONE).when(tried >= most_attempts, CRASHED).when(tried > 0, REPEAT).otherwise(RUN)
    return rows.select(*KEYS, tried.alias("attempts"), state.alias("state"))


def work_list(states: DataFrame) -> DataFrame:
    """What to do now, with the number of the attempt."""
    return states.where(F.col("state").isin(RUN, REPEAT)).select(*KEYS, (F.col("attempts") + 1).alias("attempt"))


def ghost_reports(states: DataFrame) -> DataFrame:
    """CRASHED reports for what will not be tried again, so that every file's master lists it."""
    return states.where(F.col("state") == CRASHED).select("file_id", "module", "config_hash", F.lit(CRASHED).alias("status"))
