"""Size-checked joins against the corpus.

Many jobs join a small derived set (files to rewrite, expected files of the
tasks, chosen directories) with ``files``, whose rows are whole file texts.
A sort-merge join would shuffle the whole corpus for a handful of paths, and
AQE can only demote it to a broadcast once shuffle stages have run.  Here the
small side is materialised and measured first and is broadcast when its bytes
are under the bound (its rows may carry arrays of any length); above it the
join stays a shuffle join and AQE's skew handling applies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_MAX_BYTES = 64 * 1024 * 1024
#: What a row of a broadcast table takes besides its values.
ROW_BYTES = 64


def fits_broadcast(small: DataFrame, max_bytes: int = BROADCAST_MAX_BYTES) -> bool:
    """Whether the rows of ``small``, measured as JSON, stay under ``max_bytes``."""
    measured = F.sum(F.octet_length(F.to_json(F.struct("*"))) + ROW_BYTES)
    return (small.agg(measured.alias("bytes")).first()["bytes"] or 0) <= max_bytes


def bounded_broadcast(small: DataFrame, max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """``small`` with a broadcast hint when it has at most ``max_bytes`` bytes.

    The small side is materialised once (reliable checkpoint) so the size
    check and the join read the same rows and its lineage is not run twice."""
    from quarry.session import cut_lineage
    small = cut_lineage(small)
    return F.broadcast(small) if fits_broadcast(small, max_bytes) else small


def join_small(big: DataFrame, small: DataFrame, on, how: str = "inner",
               max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """``big.join(small)`` with ``small`` broadcast after a size check."""
    return big.join(bounded_broadcast(small, max_bytes), on, how)
