"""Streaming upkeep: segments of transcripts to session state and index deltas."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quarryline.operators.index import Index, build_index, term_stats

EVENTS = "source_id string, session_key string, file_path string, raw_start bigint, role string, timestamp string, body_text string"
STATE = (
    "next_seq bigint, first_user string, last_user string, last_user_seq bigint, first_user_seq bigint, "
    "first_assistant string, last_assistant string, last_assistant_seq bigint, first_assistant_seq bigint, "
    "low string, high string, compact string"
)
OUTPUT = f"session_key string, {STATE.replace('compact string', 'compact_text string')}"
_FIELDS = [f.split()[0] for f in STATE.split(", ")]
#: Between the parts that ``compact`` holds.
_PART = "\x1f"


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """Stream of appended segments (JSON lines of EVENTS); a file is delivered once, so writers add files."""
    return spark.readStream.schema(EVENTS).json(path)


def drop_repeats(events: DataFrame, within: str = "7 days") -> DataFrame:
    """Each record of a file counts once, if its segment is delivered again within so long.

    The time is that of arrival, so no record is ever late; state older than ``within`` goes.
    Later repeats are left to the reducer, which knows how far it has read each file.
    """
    arrived = events.withColumn("arrived", F.current_timestamp()).withWatermark("arrived", within)
    return arrived.dropDuplicatesWithinWatermark(["file_path", "raw_start"]).drop("arrived")


class SessionReducer(StatefulProcessor):
    """Per session: the next sequence number, first and latest message of either role, time range, and distinct summaries.

    A micro-batch is put in file order first; records of a file at or before the last one seen of
    that file are repeats.  Records of role compact are summaries: they have no number.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("session", STATE)
        self.files = handle.getMapState("files", "file_path string", "last_start bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        s = dict(zip(_FIELDS, self.state.get())) if self.state.exists() else dict.fromkeys(_FIELDS) | {"next_seq": 0, "compact": ""}
        batch = pd.concat(list(rows)).sort_values(["file_path", "raw_start"], kind="stable")
        for path, records in batch.groupby("file_path", sort=True):
            last = self.files.getValue((path,))[0] if self.files.containsKey((path,)) else -1
            for r in records.itertuples(index=False):
                if r.raw_start > last:
                    last = int(r.raw_start)
                    self._take(s, r)
            self.files.updateValue((path,), (last,))
        self.state.update(tuple(s[f] for f in _FIELDS))
        shown = {f: s[f] for f in _FIELDS if f != "compact"}
        out = pd.DataFrame([{"session_key": key[0], **shown, "compact_text": s["compact"].replace(_PART, " | ")[:4000]}])
        yield out.astype({f: "Int64" for f in _FIELDS if f.endswith("seq")})

    @staticmethod
    def _take(s: dict, r) -> None:
        if not r.body_text:
            return
        if r.role == "compact":
            text = " ".join(r.body_text[:5000].split())
            # The first 4000 characters are shown, and later parts don't change them.
            if text and text not in s["compact"].split(_PART) and len(s["compact"]) <= 4000:
                s["compact"] += (_PART if s["compact"] else "") + text
        elif r.role in ("user", "assistant"):
            seq, s["next_seq"] = s["next_seq"], s["next_seq"] + 1
            if s[f"first_{r.role}"] is None:
                s[f"first_{r.role}"], s[f"first_{r.role}_seq"] = r.body_text, seq
            s[f"last_{r.role}"], s[f"last_{r.role}_seq"] = r.body_text, seq
            if r.timestamp:
                s["low"] = min(s["low"] or r.timestamp, r.timestamp)
                s["high"] = max(s["high"] or r.timestamp, r.timestamp)

    def close(self) -> None:
        pass


def reduce_sessions(events: DataFrame) -> DataFrame:
    """Stream of the touched sessions' states, update mode; needs the RocksDB state store."""
    return events.groupBy("session_key").transformWithStateInPandas(SessionReducer(), OUTPUT, "Update", "none")


def index_sink(path: str):
    """A foreachBatch function that adds each batch's documents to the index tables, once per batch id.

    A batch adds postings, lengths, and its own document frequencies and totals; ``streamed_index``
    adds these up.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        index = build_index(batch)
        totals = index.doc_stats.agg(F.count("*").alias("n"), F.sum("dl").alias("terms"))
        tables = {"postings": index.postings, "doc_stats": index.doc_stats, "term_stats": term_stats(index), "totals": totals, "chars": index.chars}
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{path}/{name}/batch={batch_id}")

    return write


def streamed_index(spark: SparkSession, path: str) -> tuple[Index, DataFrame]:
    """The index that the batches have made so far, and its term statistics (term, df)."""
    read = lambda t: spark.read.parquet(f"{path}/{t}").drop("batch")
    corpus = read("totals").agg(F.sum("n").alias("n"), (F.sum("terms") / F.sum("n")).alias("avgdl"))
    df = read("term_stats").groupBy("term").agg(F.sum("df").alias("df"))
    return Index(read("postings"), read("doc_stats"), corpus, read("chars")), df
