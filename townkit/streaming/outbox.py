"""Claims of an outbox: one dispatch of a family at a time, and a pause between two. Refused requests leave no trace."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import datetime, timedelta

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: The families that may dispatch, minutes between two claims, and the least and greatest length of a reason.
FAMILIES, COOLDOWN_MINUTES, REASON_LENGTH = ("news", "originals"), 10, (10, 1000)
CLAIMS = "family string, id string, at timestamp_ntz, claim string"
CLAIMS_ARROW = pa.schema([("family", pa.string()), ("id", pa.string()), ("at", pa.timestamp("us")), ("claim", pa.string())])


@dataclass
class Family:
    """What is kept of a family: the last granted claim, when its dispatch ends (None: not yet), and the ids granted so far."""

    at: datetime | None = None
    done_at: datetime | None = None
    granted: set[str] = field(default_factory=set)

    def claim(self, id_: str, at: datetime, done_at: datetime | None, valid: bool) -> str:
        if not valid:
            return "invalid"
        if id_ in self.granted:
            return "repeated"
        if self.at is not None and (self.done_at is None or self.done_at > at):
            return "outstanding"
        if self.at is not None and self.at > at - timedelta(minutes=COOLDOWN_MINUTES):
            return "cooldown"
        self.at, self.done_at = at, done_at
        self.granted.add(id_)
        return "granted"


def requests(rows: DataFrame, families: tuple[str, ...] | None = FAMILIES) -> DataFrame:
    """family, id, at, done_at, valid: what a claim is judged by. valid: an id, a known family, and a trimmed reason of 10 to 1,000 characters."""
    known = F.lit(True) if families is None else F.col("family").isin(*families)
    reason = F.length(F.trim(F.coalesce("reason", F.lit("")))).between(*REASON_LENGTH)
    valid = F.coalesce(known & reason & F.col("id").isNotNull() & F.col("family").isNotNull(), F.lit(False))
    return rows.select(F.col("family").cast("string").alias("family"), F.col("id").cast("string").alias("id"), F.col("at").cast("timestamp_ntz").alias("at"), F.col("done_at").cast("timestamp_ntz").alias("done_at"), valid.alias("valid"))


def claims(rows: DataFrame, families: tuple[str, ...] | None = FAMILIES) -> DataFrame:
    """family, id, at, claim of every request, as if they came one after the other (by time, then id).

    rows: family, id, at, done_at (when the dispatch that a grant starts is over, or null), reason. claim: invalid, repeated (the id was
    granted before: the answer is no error, but no second dispatch), outstanding, cooldown or granted. Ids belong to one family.

    Rows of a family are dealt to one task in order and read once, as they stand: a task holds one family's last grant and granted ids,
    of which the pause allows few, and no group of rows.
    """
    dealt = requests(rows, families).repartition("family").sortWithinPartitions("family", "at", "id")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, state = None, Family()
        for batch in batches:
            out = []
            for family, id_, at, done_at, valid in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if family != name:
                    name, state = family, Family()
                out.append(state.claim(id_, at, done_at, valid))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.string())], schema=CLAIMS_ARROW)

    return dealt.mapInArrow(fold, CLAIMS)


def claims_stream(rows: DataFrame, families: tuple[str, ...] | None = FAMILIES, forget_days: int = 30, late: str = "1 hour") -> DataFrame:
    """claims() of a stream of requests that come in the order of time from batch to batch.

    The state of a family is its last grant and the granted ids. A family that asks for nothing for so many days of event time is forgotten by a timer,
    unless its dispatch may still be under way: nothing that it could refuse is left by then.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        at, done_at, granted = kept.get if kept.exists else (None, None, "[]")
        state = Family(at and datetime.fromisoformat(at), done_at and datetime.fromisoformat(done_at), set(json.loads(granted)))
        if kept.hasTimedOut:
            if state.at is None or state.done_at is not None:
                kept.remove()
            return
        out = []
        for row in pd.concat(list(batches)).sort_values(["at", "id"]).itertuples():
            done = None if pd.isna(row.done_at) else row.done_at.to_pydatetime()
            out.append((key[0], row.id, row.at, state.claim(row.id, row.at.to_pydatetime(), done, row.valid)))
        kept.update((state.at and state.at.isoformat(), state.done_at and state.done_at.isoformat(), json.dumps(sorted(state.granted))))
        # event time: a stream of what is there ends, which it would not with timers of the clock
        kept.setTimeoutTimestamp(max(kept.getCurrentWatermarkMs(), int(max(o[2] for o in out).timestamp() * 1000)) + forget_days * 24 * 3_600_000)
        yield pd.DataFrame(out, columns=["family", "id", "at", "claim"])

    timed = requests(rows, families).withColumn("event_time", F.col("at").cast("timestamp")).withWatermark("event_time", late)
    return timed.groupBy("family").applyInPandasWithState(update, CLAIMS, "at string, done_at string, granted string", "update", GroupStateTimeout.EventTimeTimeout)
