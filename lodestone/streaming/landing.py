"""Landing of batches as they arrive, resumable and with one record per key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestone.common import min_row


def _at(batch, tie) -> tuple:
    """Order of records: by batch, then tie; missing ones first."""
    return tuple((False, 0) if pd.isna(x) else (True, x) for x in (batch, tie))


def _first(frame: pd.DataFrame, keys: list[str]) -> pd.DataFrame:
    return frame.sort_values(["_batch", "_tie", "_rest"], kind="stable", na_position="first").drop_duplicates(keys)


def ingest_batches(spark: SparkSession, source: str, sink: str, checkpoint: str, schema: str, keys: list[str], batch: str, tie: str,
                   max_files: int = 64) -> list[dict]:
    """Read the JSON batch files under `source` that were not read before and add to `sink` the records whose key was not seen in
    the same or an earlier batch. Returns the rows read and the keys changed of every micro-batch.

    What is known of a key, the batch and tie of its first record, is keyed state of the stream: a micro-batch looks up and
    changes the keys it holds and never reads the sink, so its cost follows its own size. Within a task repeated keys are
    reduced before the shuffle, so a key that fills a batch is no burden. Files and state are kept in `checkpoint`; a run after a
    failure goes on where the last one stopped, and the sink shows each micro-batch once. A record of an earlier batch that
    comes late is added beside the later one; `read_landed` gives one record per key, the one of the first batch.

    For more keys than fit in executors' memory, set the session's state store provider to RocksDB.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).json(source)
    types = {f.name: f.dataType.simpleString() for f in stream.schema}
    names = list(types)
    packed = stream.select(*keys, F.col(batch).alias("_batch"), F.col(tie).alias("_tie"), F.to_json(F.struct(*names)).alias("_rest"))
    shape = ", ".join(f"`{k}` {types[k]}" for k in keys) + f", _batch {types[batch]}, _tie {types[tie]}, _rest string"

    def reduced(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield _first(frame, keys)

    def add(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best = None
        for frame in frames:
            row = frame.sort_values(["_batch", "_tie", "_rest"], kind="stable", na_position="first").iloc[:1]
            at = _at(row["_batch"].iloc[0], row["_tie"].iloc[0])
            if best is None or (at, row["_rest"].iloc[0]) < best[:2]:
                best = (at, row["_rest"].iloc[0], row)
        if best is None:
            return
        if state.exists and _at(*state.get) <= best[0]:
            return
        value = tuple(None if not known else x for known, x in best[0])
        state.update(tuple(x.item() if hasattr(x, "item") else x for x in value))
        yield pd.DataFrame({"_rest": [best[1]]})

    fresh = packed.mapInPandas(reduced, shape).groupBy(*keys).applyInPandasWithState(
        add, "_rest string", f"batch {types[batch]}, tie {types[tie]}", "append", GroupStateTimeout.NoTimeout)
    rows = fresh.select(F.from_json("_rest", schema).alias("r")).select("r.*")
    run = rows.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return [{"read": p["numInputRows"], "keys": sum(s["numRowsUpdated"] for s in p["stateOperators"])} for p in run.recentProgress if p["numInputRows"]]


def read_landed(spark: SparkSession, sink: str, schema: str, keys: list[str], batch: str, tie: str) -> DataFrame:
    """One record per key: the one of the first batch."""
    rows = spark.read.schema(schema).parquet(sink)
    rest = [c for c in rows.columns if c not in (*keys, batch, tie)]
    return rows.groupBy(*keys).agg(min_row([batch, tie, *rest]).alias("r")).select(*keys, "r.*")
