"""Statistics tables: computed once, measured, then joined in the way their size allows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyward.session import fresh_path, working_dir

# A statistics row is a few hundred bytes, so this many stay well below executor memory.
BROADCAST_ROWS = 100_000
# Up to this many rows in a whole table, every plan is cheap and extra jobs cost more than they save.
SMALL_ROWS = 1_000_000


@dataclass(frozen=True)
class Size:
    """Measured row count of a table. Operators that keep the rows hand it on."""

    rows: int

    @property
    def small(self) -> bool:
        return self.rows <= SMALL_ROWS


def measure(df: DataFrame) -> Size:
    return Size(df.count())


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and cut its lineage.

    Every later use then reads the same rows, also after an executor was lost.
    """
    working_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stage(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write rows as a Parquet table in the shared folder and read them back.

    For row tables that several passes read: later scans fetch only the columns they need.
    """
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sized(settled: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a settled table for broadcast if its row count allows it, else leave it to a shuffle join."""
    return F.broadcast(settled) if settled.limit(limit + 1).count() <= limit else settled


def attach(
    rows: DataFrame, stats: DataFrame, on: Sequence[str], size: Size | None = None, how: str = "left"
) -> DataFrame:
    """Join per-group statistics to rows without shuffling the rows while the groups are few.

    A large table gets its statistics settled and counted first; a small one leaves the choice to
    the optimizer. A null group key matches nothing, so its rows get null statistics.
    """
    if size is not None and size.small:
        return rows.join(stats, list(on), how)
    return rows.join(sized(settle(stats)), list(on), how)
