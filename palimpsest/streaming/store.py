"""The keyed store as a stream: state by key, in arrival order."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "key long, seq long, op string, status string, value long, tombstone boolean"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class KeyedStore(StatefulProcessor):
    """One key's value: (value, present, touched, last_seq).

    Rows of a micro-batch are applied in seq order.  A row at or below last_seq was
    applied before a restart, so replays change nothing.  Rows are
    never late: there is no watermark.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("entry", "value long, present boolean, touched boolean, last_seq long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        value, present, touched, last = self.state.get() if self.state.exists() else (None, False, False, -1)
        out = []
        for r in pd.concat(list(rows)).sort_values("seq").itertuples():
            if r.seq <= last:
                continue
            last, status = r.seq, "Ok"
            if r.op == "upsert":
                value, present, touched = int(r.val), True, True
            elif r.op == "conditional_insert":
                if present:
                    status = "Aborted"
                else:
                    value, present = int(r.val), True
                touched = True
            elif r.op == "rmw":
                if present:
                    value += int(r.val)
                else:
                    status = "NotFound"
                touched = True
            elif r.op == "delete":
                status = "Ok" if touched else "NotFound"
                value, present = None, False
            out.append((key[0], r.seq, r.op, status, value, not present))
        self.state.update((value, present, touched, last))
        table = pd.DataFrame(out, columns=["key", "seq", "op", "status", "value", "tombstone"])
        yield table.astype({"value": "Int64"})

    def close(self) -> None:
        pass


def run_store(stream: DataFrame) -> DataFrame:
    """Results of a streaming (seq, key, op, val), one row an operation; state lies in RocksDB."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    return stream.groupBy("key").transformWithStateInPandas(KeyedStore(), OUT, "Append", "None")


def append_log(stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None):
    """Append a stream of operations to a Parquet log; the state is derived from it in batch."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()


def read_stream(spark: SparkSession, source: str, files: int = 1) -> DataFrame:
    """The Parquet folder or file ``source`` as a stream of ``files`` files a batch."""
    path = spark._jvm.org.apache.hadoop.fs.Path(source)
    folder, _, name = source.rpartition("/")
    one = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getFileStatus(path).isFile()
    read = spark.readStream.schema(spark.read.parquet(source).schema).option("maxFilesPerTrigger", files)
    return read.option("pathGlobFilter", name if one else "*.parquet").parquet(folder if one else source)


def ingest(spark: SparkSession, source: str, stream_of, path: str, checkpoint: str, files: int = 1) -> DataFrame:
    """Read ``source`` as a stream, append ``stream_of`` of it to ``path``, and return the log."""
    append_log(stream_of(read_stream(spark, source, files)), path, checkpoint).awaitTermination()
    return spark.read.parquet(path)
