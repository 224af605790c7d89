"""Continuous ingest of nested documents: state by family, one commit a micro-batch.

What is known of a family is its state: how many versions it had and the digest
of the last. A document that is as the last version is a replay, in its own
batch or any later one, and is dropped; another text is the family's next
version and replaces it in the store. Two texts of one family in one batch have
no order: both are rejected (K1) and the state stays.

Each micro-batch is a commit of the store with the batch as its token, so a
batch that runs again after a failure changes nothing. Documents that break
rules, can't be parsed or use names that other families have are kept aside with
their reasons; the others of the batch are loaded. A rejected text is known
too: sent again, it is not rejected again.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..sources import documents as ds
from ..sources.store import Store
from ..sources.written import delete, fresh_folder, kept

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_OUT = "family string, number long, value string, reason string"


class Versions(StatefulProcessor):
    """family, digest, value -> the texts that are new for a family, with their number; the state is (number, digest)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "number long, digest string")

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:
        import pandas as pd

        number, digest = self.last.get() if self.last.exists() else (0, None)
        texts: dict[str, str] = {}
        for frame in rows:
            for d, value in zip(frame["digest"], frame["value"]):
                texts[d] = value
        fresh = {d: v for d, v in texts.items() if d != digest}
        if len(texts) > 1:
            yield pd.DataFrame({"family": key[0], "number": number, "value": list(texts.values()), "reason": "K1 family"})
        elif fresh:
            (d, value), = fresh.items()
            self.last.update((number + 1, d))
            yield pd.DataFrame({"family": [key[0]], "number": [number + 1], "value": [value], "reason": [None]})

    def close(self) -> None:
        pass


def versions(lines: DataFrame) -> DataFrame:
    """family, number, value, reason of a stream of JSON documents (value): each version of each family once. What has no name goes by its digest."""
    digest = F.sha2(F.col("value"), 256)
    named = lines.filter("value IS NOT NULL").select(F.coalesce(F.get_json_object("value", "$.name"), digest).alias("family"), digest.alias("digest"), "value")
    return named.groupBy("family").transformWithStateInPandas(statefulProcessor=Versions(), outputStructType=_OUT, outputMode="Append", timeMode="None")


def load_batch(store: Store, rows: DataFrame, token: str, permissive: bool = False, dimensions: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """Commits the documents of rows (value, reason null) that may be loaded; value, reason of the others."""
    parsed = ds.read_json(store.spark, rows.filter("reason IS NULL"), keep=True)
    good, rejects = ds.sorted_out(parsed, permissive, dimensions)
    clash = store.taken(good.drop("value"), permissive).groupBy("family").agg(F.lit("K1 stored").alias("reason"))
    why = rejects.filter("family IS NOT NULL").unionByName(clash).groupBy("family").agg(F.array_join(F.sort_array(F.collect_set("reason")), ", ").alias("why"))
    refused = parsed.withColumn("reason", ds.refused(parsed, permissive)).select(F.col("name").alias("family"), "value", "reason")
    rejected = kept(refused.join(why, "family", "left").select("value", F.coalesce("reason", "why").alias("reason")).filter("reason IS NOT NULL").unionByName(rows.filter("reason IS NOT NULL").select("value", "reason")))
    loaded = good.join(rejected.select("value"), "value", "left_anti").drop("value")
    store.begin().put(loaded, permissive, dimensions).commit(token)
    return rejected


def ingest(spark: SparkSession, folder: str, out: str, checkpoint: str, permissive: bool = False, dimensions: Mapping[str, DataFrame] | None = None, **trigger) -> StreamingQuery:
    """JSON documents (a line each) that arrive in folder -> the store at out; out/rejected (value, reason) has the others."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    store = Store(spark, out)

    def batch(rows: DataFrame, number: int) -> None:
        place = fresh_folder(spark, "batch")
        rows = kept(rows.select("family", "value", "reason"), place)
        load_batch(store, rows, f"{checkpoint}#{number}", permissive, dimensions).write.mode("overwrite").parquet(f"{out}/rejected/batch={number}")
        delete(spark, place)

    return versions(spark.readStream.text(folder)).writeStream.foreachBatch(batch).outputMode("append").option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
