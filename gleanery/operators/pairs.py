"""All pairs of a few chosen rows: what a user compares with one another by hand."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: As many rows as one may choose: the pairs are half its square.
MOST = 2000


def of_chosen(rows: DataFrame, key: str, most: int = MOST) -> DataFrame:
    """Each row beside every row of a larger ``key``, whose columns end in ``2``; more than ``most`` rows are refused.

    The checked side is sent to every task, so nothing is shuffled."""
    n = rows.limit(most + 1).count()
    if n > most:
        raise ValueError(f"more than {most} rows were chosen to be compared with one another")
    other = F.broadcast(rows.select(*[F.col(c).alias(f"{c}2") for c in rows.columns]))
    return rows.join(other, F.col(key) < F.col(f"{key}2"))
