"""Changes as a stream: rows that arrive are merged into a stored module, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from brindle.engine import Engine
from brindle.operators.filters import column
from brindle.operators.validate import split_valid
from brindle.operators.writes import merged
from brindle.sources.store import Store


def newest(changes: DataFrame, key: str, order: str) -> DataFrame:
    """The last change to each key."""
    last = Window.partitionBy(key).orderBy(F.desc(order))
    return changes.withColumn("_rank", F.row_number().over(last)).filter("_rank = 1").drop("_rank")


def follow(changes: DataFrame, store: Store, engine: Engine, module: str, checkpoint: str, order: str = "updated_at", rejected: str | None = None) -> StreamingQuery:
    """Starts a query that keeps the module up to date. Each batch is one commit; a batch that Spark repeats after a
    failure leaves the rows as they are, for its number is in the manifest. Rows that break the module's rules go, before the
    commit, to the folder rejected, if there is one, with what is wrong: a folder batch=number for each batch."""

    def batch(rows: DataFrame, number: int) -> None:
        own = engine.catalog.module(module)
        good, bad = split_valid(rows, own)
        if rejected:
            bad.write.mode("overwrite").parquet(f"{rejected}/batch={number}")
        with store.writing(engine.catalog) as draft:
            done = draft.setdefault("batches", {})
            if done.get(module, -1) >= number:
                return
            new = newest(good, own.id_field.name, order).select(*(column(f.name) for f in own.columns()))
            draft["rows"][module], engine.catalog.rows[module] = store.put(module, merged(engine.catalog.rows[module], new, own.id_field.name))
            done[module] = number
        engine.changed(module)

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
