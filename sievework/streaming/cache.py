"""Verdicts of one layer kept for a time under the layer, the bytes' digest and the rules' fingerprint: the state of a stream, so that the same bytes aren't inspected again while their verdict holds."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TTL = timedelta(minutes=60)
OUT = "id string, arrived timestamp, layer string, layer_name string, sha256 string, decision string, reason_code string, from_cache boolean"
_KEPT = "decision string, reason_code string, kept_at timestamp"


class Verdicts(StatefulProcessor):
    """For each key its last verdict and when it was made. It holds for what arrives less than `ttl` later; what comes then is inspected anew. A file that was rewritten is never kept: its bytes aren't those that came."""

    def __init__(self, inspect: Callable[[bytes], tuple[str, str]], ttl: timedelta):
        self.inspect, self.ttl = inspect, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        # the store forgets by the clock what is too old; whether a verdict still holds is decided by arrival
        self.state = handle.getValueState("verdict", _KEPT, ttlDurationMs=int(self.ttl.total_seconds() * 1000))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        layer, digest, _ = key
        kept = self.state.get() if self.state.exists() else None
        for batch in rows:
            done = []
            for row in batch.sort_values(["arrived", "id"]).itertuples(index=False):
                hit = kept is not None and pd.Timestamp(kept[2]) <= row.arrived < pd.Timestamp(kept[2]) + self.ttl
                decision, reason = kept[:2] if hit else self.inspect(bytes(row.content))
                if not hit and decision != "rewritten":
                    kept = (decision, reason, row.arrived.to_pydatetime())
                    self.state.update(kept)
                done.append((row.id, row.arrived, layer, f"Cached({layer})" if hit else layer, digest, decision, reason, hit))
            yield pd.DataFrame(done, columns=[c.split()[0] for c in OUT.split(", ")])

    def close(self) -> None:
        pass


def cached(uploads: DataFrame, layer: str, fingerprint: str, inspect: Callable[[bytes], tuple[str, str]], ttl: timedelta = TTL) -> DataFrame:
    """A stream of verdicts of one layer on a stream of uploads (id, arrived, content): decision (accepted, rejected or rewritten), reason_code, and from_cache, with the layer's name as it is shown, `Cached(<layer>)` for a kept verdict. `inspect` is called only where none holds; other rules (another fingerprint) find none. Null content counts as empty, null ids and times are left out."""
    uploads.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    own = uploads.where("id IS NOT NULL AND arrived IS NOT NULL").select(F.col("id").cast("string").alias("id"), "arrived", F.coalesce("content", F.lit(b"")).alias("content"))
    own = own.withColumns({"layer": F.lit(layer), "sha256": F.sha2("content", 256), "fingerprint": F.lit(fingerprint)})
    return own.groupBy("layer", "sha256", "fingerprint").transformWithStateInPandas(Verdicts(inspect, ttl), OUT, "Append", "ProcessingTime")


def shown_layer(name: str) -> F.Column:
    """The layer that a name stands for: X for Cached(X), whatever X is."""
    return F.regexp_replace(F.col(name), r"^Cached[(](.*)[)]$", "$1")
