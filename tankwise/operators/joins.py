"""Join helpers with explicit, checked broadcast decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Upper bound on rows of a data-derived side we are willing to ship to every
# executor.  Dimension tables derived by aggregation (per type, per metric)
# are far below it; anything above goes through a shuffle join (with AQE
# skew-join splitting for hot keys).
BROADCAST_MAX_ROWS = 200_000


def materialize_small(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (shared ``spark.checkpoint.dir``) of a small derived
    table: cuts lineage so its count and its reuse do not rescan the data, and
    survives executor loss."""
    return df.checkpoint(eager=True)


def join_checked(big: DataFrame, small: DataFrame, on, how: str = "inner",
                 max_rows: int = BROADCAST_MAX_ROWS, materialize: bool = True) -> DataFrame:
    """Broadcast ``small`` only after counting it; otherwise a shuffle join."""
    if materialize:
        small = materialize_small(small)
    n = small.count()
    if n <= max_rows:
        return big.join(F.broadcast(small), on, how)
    return big.join(small, on, how)


def join_literal_dim(big: DataFrame, dim: DataFrame, on, how: str = "left") -> DataFrame:
    """Join a dimension built from fixed literals (size known in code)."""
    return big.join(F.broadcast(dim), on, how)
