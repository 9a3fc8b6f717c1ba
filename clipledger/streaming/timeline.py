"""The merge of candidates as a stream: claims arrive in any order within a delay, events leave once they are final.

State is kept per video and event: claims that may still have an earlier neighbour to come, and
the groups that a later claim can still join. The watermark tells both apart. Claims that
start before it are placed in order by the same rule as in a batch; a group is final once the
watermark has passed its reach and the gap, and is emitted with the claims it took.

Videos and events are dealt to ``buckets``, and a bucket is one key of the stream: a call of
Python costs far more than the few claims that a video brings with a batch.
"""

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from clipledger.operators.conflicts import OpenGroups
from clipledger.operators.timeline import GROUP

#: Columns of a candidate that travel through the state.
CLAIM = [
    "candidate_id", "window_id", "local_track_id", "global_track_id",
    "confidence", "temporal_score", "global_start_seconds", "global_end_seconds",
]
FINAL = (
    "source_video_id string, event string, candidate_id string, window_id string, local_track_id string, global_track_id string, "
    "confidence double, temporal_score double, global_start_seconds double, global_end_seconds double, `__group` string"
)
_STATE = "groups string"
#: Keys of the state, whatever the number of videos.
BUCKETS = 1 << 10


def _plain(frame: pd.DataFrame) -> Iterator[tuple]:
    """Rows of a frame as tuples, None for what is missing."""
    return zip(*([None if gone else x for x, gone in zip(frame[c].tolist(), frame[c].isna())] for c in frame.columns))


class EventMerge:
    """The state of one video and event between micro-batches."""

    def __init__(self, gap: float, waiting: str = "[]", frontier: str = "[]", placed: str = "[]"):
        self.waiting = [tuple(x) for x in json.loads(waiting)]
        self.groups = OpenGroups(gap, frontier)
        self.placed = json.loads(placed)  # per open group: its name and its claims
        for group, (name, _) in zip(self.groups.groups, self.placed):
            group["ref"] = name
        self.claims = {name: rows for name, rows in self.placed}
        self.gap = gap

    def add(self, rows: list[tuple]) -> None:
        self.waiting += rows

    def advance(self, mark: float) -> list[tuple]:
        """Place the claims that start before ``mark``; (claim..., group) of groups that are final."""
        # the windows of claims yet to come aren't known, so tracks are kept while their group is open
        ready = sorted((x for x in self.waiting if x[6] < mark), key=lambda x: (x[6], x[1], x[2], x[0]))
        self.waiting = [x for x in self.waiting if x[6] >= mark]
        for claim in ready:
            candidate, window, track, known, _, _, start, end = claim
            name = self.groups.place(candidate, window, float("inf"), track, known, start, end)
            self.claims.setdefault(name, []).append(list(claim))
        open_ = {g["ref"] for g in self.groups.groups if mark <= g["reach"] + self.gap}
        done = [name for name in self.claims if name not in open_]
        return [(*claim, name) for name in done for claim in self.claims.pop(name)]

    def state(self, mark: float) -> tuple[str, str, str]:
        frontier, names = self.groups.frontier(mark)
        return json.dumps(self.waiting), frontier, json.dumps([[x, self.claims[x]] for x in names])

    def next_mark(self) -> float | None:
        """The earliest watermark that changes something."""
        ends = [g["reach"] + self.gap for g in self.groups.groups if g["ref"] in self.claims]
        return min([x[6] for x in self.waiting] + ends, default=None)


def merge_stream(candidates: DataFrame, gap: float = 0.5, delay_seconds: float = 30.0, buckets: int = BUCKETS) -> DataFrame:
    """Candidates of final groups with ``__group``, from a stream of candidates.

    Claims may arrive up to ``delay_seconds`` of video time later than the furthest
    start seen so far; what comes later still is dropped, as streams do. Claims of one
    batch need no order. State per video and event grows with its open groups and the
    claims within the delay. A checkpoint goes with its number of ``buckets``.
    """
    if gap < 0 or delay_seconds < 0:
        raise ValueError("gap and delay must not be negative")
    # a stream's watermark begins at zero, and what isn't later than it is late: the clock starts before the videos
    shift = delay_seconds + 1.0
    clock = F.timestamp_millis(((F.col("global_start_seconds") + shift) * 1000).cast("bigint"))
    bucket = F.pmod(F.xxhash64(*GROUP), F.lit(buckets)).alias("__bucket")
    timed = candidates.select(*GROUP, *CLAIM, clock.alias("__time"), bucket)
    timed = timed.withWatermark("__time", f"{int(delay_seconds * 1000)} milliseconds")

    def merge(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else []
        mergers = {(video, event): EventMerge(gap, *parts) for video, event, *parts in held}
        for frame in frames:
            for video, event, *claim in _plain(frame[[*GROUP, *CLAIM]]):
                if (video, event) not in mergers:
                    mergers[video, event] = EventMerge(gap)
                mergers[video, event].add([tuple(claim)])
        mark = state.getCurrentWatermarkMs() / 1000 - shift
        final = [(*group, *claim) for group, merger in mergers.items() for claim in merger.advance(mark)]
        then = {group: at for group, merger in mergers.items() if (at := merger.next_mark()) is not None}
        if not then:
            state.remove()
        else:
            state.update((json.dumps([[*group, *mergers[group].state(mark)] for group in then]),))
            # a timer must lie beyond the watermark; it fires once the watermark has passed it
            state.setTimeoutTimestamp(max(int((min(then.values()) + shift) * 1000) + 1, state.getCurrentWatermarkMs() + 1))
        if final:
            yield pd.DataFrame(final, columns=[*GROUP, *CLAIM, "__group"])

    return timed.groupBy("__bucket").applyInPandasWithState(merge, FINAL, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def close_stream(candidates: DataFrame, video: str = "", event: str = "", files: int = 1) -> DataFrame:
    """A row for the end of a finished stream, beyond every claim: it moves the watermark on.

    Append it as a last file; its own group is never final, so it never comes out. Where
    a batch takes several ``files``, there is one row for each.
    """
    row = candidates.sparkSession.range(0, files, 1, files)
    far = F.lit(4e9)
    given = {"source_video_id": F.lit(video), "event": F.lit(event), "candidate_id": F.lit(""), "global_start_seconds": far, "global_end_seconds": far}
    return row.select(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in candidates.schema.fields])


def run_merge(
    spark: SparkSession, source: str, schema: StructType, target: str, checkpoint: str, gap: float = 0.5, delay_seconds: float = 30.0, files: int = 1,
    buckets: int = BUCKETS,
) -> DataFrame:
    """Merge the candidate files in ``source`` that no earlier run has seen; the claims of all final groups so far.

    The checkpoint holds finished files, open groups and the watermark, so a run goes on
    where the last one stopped, also after a crash.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    merged = merge_stream(stream, gap, delay_seconds, buckets)
    query = (
        merged.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(merged.schema).parquet(target)
