"""Periodic refresh: a file stream whose rows are upserted into a snapshot table, the latest of each key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ..operators.mirror import current, swap

#: What a row without an order stands at, and how times are written so that they are read as they were.
LEAST = -(1 << 63)
TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def place(columns: list[str], order: str) -> list[Column]:
    """order (a long; nulls come first), tie (of rows of one order the one of the greatest digest of its values is the latest)
    and the row as JSON: values of any type pass the state's function as they are, longs beside nulls too."""
    row = F.to_json(F.struct(*columns), TIMES)
    return [F.coalesce(F.col(order).cast("long"), F.lit(LEAST)).alias("_order"), F.sha2(row, 256).alias("_tie"), row.alias("_row")]


def latest(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Hands on a key's latest row of the batch if it is later than the latest one seen; the state holds the place of that one."""
    best, found = tuple(state.get) if state.exists else None, None
    for rows in parts:
        for at in range(len(rows)):
            this = (int(rows["_order"].iloc[at]), rows["_tie"].iloc[at])
            if best is None or this > best:
                best, found = this, rows.iloc[[at]]
    if found is not None:
        state.update(best)
        yield found[["_order", "_tie", "_row"]]


def refresh(spark: SparkSession, source: str, schema: str, table: str, keys: list[str], order: str, checkpoint: str) -> StreamingQuery:
    """Reads what is new below ``source`` (parquet) and brings ``table`` up to date; ends when all is read.

    Of a key's rows the one of the greatest ``order`` (numbers, or times by the second) counts, whenever it comes: each key's place is kept as the
    stream's state (a number and a digest), so a late row goes no further. The table decides again, so a batch that runs again after a
    failure gives the same table, and a new checkpoint, which drops the state, lets no late row in."""

    columns = StructType.fromDDL(schema).names

    def apply(batch: DataFrame, _: int) -> None:
        if batch.isEmpty():
            return
        new = batch.select(F.from_json("_row", schema, TIMES).alias("row"), "_order", "_tie").select("row.*", "_order", "_tie")
        old = current(spark, table)
        if old is not None:
            new = old.select(*columns, *place(columns, order)[:2]).unionByName(new)
        # one row as a whole, never columns of several
        latest = new.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct("_order", "_tie")).alias("row"))
        swap(latest.select("row.*"), table)

    stream = spark.readStream.schema(schema).parquet(source)
    placed = stream.select(*keys, *place(columns, order))
    made = StructType([placed.schema[c] for c in ("_order", "_tie", "_row")])
    changed = placed.groupBy(*keys).applyInPandasWithState(latest, made, "place long, tie string", "append", GroupStateTimeout.NoTimeout)
    return changed.writeStream.outputMode("append").foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
