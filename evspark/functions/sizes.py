"""Tables that are broadcast only after their size was counted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of a table's values up to which it is broadcast; beyond that the same join shuffles.
BROADCAST_BYTES = 16 << 20


def if_small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """df, marked for broadcast if its values have at most `most` bytes, which are summed here: texts as long as they are, 16 for each other value."""
    size = F.lit(0).cast("long")
    for f in df.schema:
        size += F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0)) + 16 if f.dataType.typeName() in ("string", "binary") else F.lit(16)
    return F.broadcast(df) if (df.agg(F.sum(size)).first()[0] or 0) <= most else df
