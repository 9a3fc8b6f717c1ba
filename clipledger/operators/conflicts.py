"""The ordered merge rule over long islands: segments of time that hand on their open groups.

An island with conflicts has to be decided in order, but no task has to hold it. It is cut
into segments of time. Each segment is folded from the groups that are still open where it
begins (its frontier) and tells which are open where it ends. All segments start from
an empty frontier; then those whose frontier turned out different are folded again,
until nothing changes. A frontier forgets groups that no later claim can reach and
windows that have no later claim, so it doesn't grow with the island, and a change rarely
travels far.

A frontier holds no names: its groups are numbered, and a segment says of each group that it
hands on whether the group began here (then its first claim is the name) or which number
it had before. Names follow these references at the end, in steps that double.
"""

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clipledger.session import cut_lineage

#: Seconds of an island that one task folds.
SEGMENT_SECONDS = 600.0
#: Windows that a group remembers before those without a later claim are looked for.
_MANY_WINDOWS = 64
_EMPTY = "[]"
_CLAIM = [
    "candidate_id", "window_id", "__until", "local_track_id", "global_track_id",
    "global_start_seconds", "global_end_seconds",
]


class OpenGroups:
    """The groups that a later claim can still join, newest first.

    A group has a reference (its first claim's id, or its number in the frontier), a reach,
    at most one global track, and per window the track and the last start of any claim.
    """

    def __init__(self, gap: float, frontier: str = _EMPTY):
        self.gap = gap
        self.groups = [
            {"ref": number, "reach": reach, "known": known, "tracks": {w: (t, until) for w, t, until in tracks}, "many": _MANY_WINDOWS}
            for number, (reach, known, tracks) in enumerate(json.loads(frontier))
        ]

    def place(self, candidate, window, until, track, known, start, end):
        """The reference of the group that the next claim joins or opens."""
        self.groups = [g for g in self.groups if start <= g["reach"] + self.gap]
        for group in self.groups:
            mine = group["tracks"].get(window)
            if (mine is None or mine[0] == track) and (known is None or group["known"] in (None, known)):
                break
        else:
            group = {"ref": candidate, "reach": end, "known": None, "tracks": {}, "many": _MANY_WINDOWS}
            self.groups.insert(0, group)
        group["reach"] = max(group["reach"], end)
        group["known"] = group["known"] or known
        group["tracks"][window] = (track, until)
        if len(group["tracks"]) > group["many"]:
            self._forget(group, start)
            group["many"] = max(_MANY_WINDOWS, 2 * len(group["tracks"]))
        return group["ref"]

    @staticmethod
    def _forget(group: dict, start: float) -> None:
        group["tracks"] = {w: x for w, x in group["tracks"].items() if x[1] >= start}

    def frontier(self, start: float) -> tuple[str, list]:
        """(what claims from ``start`` on can meet, the references of these groups)."""
        open_ = [g for g in self.groups if start <= g["reach"] + self.gap]
        for group in open_:
            self._forget(group, start)
        state = [[g["reach"], g["known"], sorted([w, *x] for w, x in g["tracks"].items())] for g in open_]
        return json.dumps(state), [g["ref"] for g in open_]


def assign_groups(
    rows: DataFrame, keys: list[str], order: list[str], gap: float, segment_seconds: float = SEGMENT_SECONDS
) -> DataFrame:
    """Add ``__group``, the first claim of each row's group. ``rows`` should be stored: every round reads it."""
    start = F.col("global_start_seconds")
    spans = rows.groupBy(*keys).agg(F.min(start).alias("__begin"), F.max(start).alias("__end"))
    inner = ["__until", "__part", "__edge", "__number", "__first"]
    if spans.filter(F.col("__end") - F.col("__begin") >= segment_seconds).isEmpty():
        # every island is one segment, whose frontier nobody asks for
        whole = rows.withColumns({"__until": F.lit(float("inf")), "__part": F.lit(0).cast("bigint"), "__edge": F.lit(float("inf"))})
        return _referred(whole, None, keys, order, gap).withColumn("__group", F.col("__first")).drop(*inner)
    rows = with_segments(rows, spans, keys, segment_seconds)
    segments = rows.select(*keys, "__part").distinct()
    segments = segments.withColumn("__before", F.lag("__part").over(Window.partitionBy(*keys).orderBy("__part")))
    state = settle(rows, segments, keys, order, gap)
    named = _referred(rows, state, keys, order, gap).join(_names(state, keys), [*keys, "__part", "__number"], "left")
    return named.withColumn("__group", F.coalesce("__first", "__name")).drop(*inner, "__name")


def with_segments(rows: DataFrame, spans: DataFrame, keys: list[str], segment_seconds: float) -> DataFrame:
    """Add each claim's segment, counted from its island's begin, where that ends, and its window's last start."""
    last = F.max("global_start_seconds").over(Window.partitionBy(*keys, "window_id"))
    part = F.floor((F.col("global_start_seconds") - F.col("__begin")) / F.lit(segment_seconds))
    # a microsecond early, so that rounding never puts a claim of the next segment before it
    edge = F.col("__begin") + (F.col("__part") + 1) * segment_seconds - 1e-6
    dealt = rows.join(spans.select(*keys, "__begin"), keys).withColumn("__until", last).withColumn("__part", part)
    return dealt.withColumn("__edge", edge).drop("__begin")


def settle(rows: DataFrame, segments: DataFrame, keys: list[str], order: list[str], gap: float) -> DataFrame:
    """(keys, part, before, frontier, handed, names, numbers) per segment of islands with several, once nothing changes."""
    part = [*keys, "__part"]
    several = segments.filter("__before IS NOT NULL").select(*keys).distinct()
    segments = segments.join(several, keys, "left_semi")
    rows = cut_lineage(rows.select(*dict.fromkeys([*part, "__edge", *_CLAIM, *order])).join(several, keys, "left_semi"))
    empty = segments.withColumn("frontier", F.lit(_EMPTY))
    state = cut_lineage(empty.join(_handed(rows, None, keys, order, gap), part))
    while True:
        arrives = state.select(*keys, F.col("__part").alias("__before"), F.col("handed").alias("arrives"))
        met = state.select(*part, "__before", "frontier").join(arrives, [*keys, "__before"]).filter("arrives <> frontier")
        changed = cut_lineage(met.select(*part, "__before", F.col("arrives").alias("frontier")))
        if changed.isEmpty():
            return state
        again = _handed(rows.join(changed.select(*part), part, "left_semi"), changed, keys, order, gap)
        kept = state.join(changed.select(*part), part, "left_anti")
        state = cut_lineage(kept.unionByName(changed.join(again, part)))


def _dealt(rows: DataFrame, frontiers: DataFrame | None, keys: list[str], order: list[str]) -> DataFrame:
    """Segments as sorted streams, each behind its frontier."""
    out = rows.withColumn("__kind", F.lit(1)).withColumn("frontier", F.lit(None).cast("string"))
    if frontiers is not None:
        heads = frontiers.filter(F.col("frontier") != _EMPTY)
        out = out.unionByName(heads.select(*keys, "__part", F.lit(0).alias("__kind"), "frontier"), allowMissingColumns=True)
    return out.repartition(*keys, "__part").sortWithinPartitions(*keys, "__part", "__kind", *order)


def _fold(batches: Iterator[pa.RecordBatch], keys: list[str], gap: float):
    """Per batch of a dealt stream: (batch, its rows' references, segments that ended with their open groups)."""
    now, groups, edge = None, None, None
    for batch in batches:
        names = [*keys, "__part", "__kind", "frontier", "__edge", *_CLAIM]
        columns = [batch.column(batch.schema.get_field_index(x)).to_pylist() for x in names]
        refs, ended = [], []
        for *segment, kind, frontier, ends, candidate, window, until, track, known, start, end in zip(*columns):
            if segment != now:
                if now is not None:
                    ended.append((now, edge, groups))
                now, groups = segment, OpenGroups(gap, frontier or _EMPTY)
            edge = ends  # a frontier has none, but claims follow it
            refs.append(groups.place(candidate, window, until, track, known, start, end) if kind else None)
        yield batch, refs, ended
    if now is not None:
        yield None, [], [(now, edge, groups)]


def _split(refs: list) -> tuple[list, list]:
    """Names are text, numbers of a frontier are not."""
    return [x if isinstance(x, str) else None for x in refs], [None if isinstance(x, str) else x for x in refs]


def _handed(rows: DataFrame, frontiers: DataFrame | None, keys: list[str], order: list[str], gap: float) -> DataFrame:
    """(keys, part, handed, names, numbers): what each segment hands on."""
    dealt = _dealt(rows, frontiers, keys, order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, ended in _fold(batches, keys, gap):
            out = [(*segment, state, *_split(refs)) for segment, edge, groups in ended for state, refs in [groups.frontier(edge)]]
            if out:
                *plain, names, numbers = zip(*out)
                lists = [pa.array(names, pa.list_(pa.string())), pa.array(numbers, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*map(pa.array, plain), *lists], [*keys, "__part", "handed", "names", "numbers"])

    given = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    return dealt.mapInArrow(run, f"{given}, __part bigint, handed string, names array<string>, numbers array<bigint>")


def _referred(rows: DataFrame, state: DataFrame | None, keys: list[str], order: list[str], gap: float) -> DataFrame:
    """``rows`` with the first claim of groups that begin in their segment, or the group's number in its frontier."""
    dealt, names = _dealt(rows, state, keys, order), rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, refs, _ in _fold(batches, keys, gap):
            if batch is None:
                return
            first, numbers = _split(refs)
            columns = [batch.column(batch.schema.get_field_index(x)) for x in names]
            told = pa.RecordBatch.from_arrays([*columns, pa.array(first, pa.string()), pa.array(numbers, pa.int64())], [*names, "__first", "__number"])
            yield told.filter(batch.column(batch.schema.get_field_index("__kind")).cast(pa.bool_()))

    schema = rows.withColumn("__first", F.lit(None).cast("string")).withColumn("__number", F.lit(None).cast("bigint")).schema
    return dealt.mapInArrow(run, schema)


def _names(state: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, part, number, name) of every group in a segment's frontier.

    It is what the segment before handed on under that number: a name, or a number in
    that segment's own frontier. Each step goes twice as far back.
    """
    handed = state.select(*keys, F.col("__part").alias("__before"), F.posexplode(F.arrays_zip("names", "numbers")).alias("__number", "x"))
    handed = handed.select(*keys, "__before", F.col("__number").cast("bigint").alias("__number"), F.col("x.names").alias("__name"), F.col("x.numbers").alias("__further"))
    links = state.filter("__before IS NOT NULL").select(*keys, "__part", "__before").join(handed, [*keys, "__before"])
    links = cut_lineage(links)
    while not links.filter("__name IS NULL").isEmpty():
        back = links.select(
            *keys, F.col("__part").alias("__before"), F.col("__number").alias("__further"),
            F.col("__name").alias("__n"), F.col("__before").alias("__b"), F.col("__further").alias("__f"),
        )
        far = links.join(back, [*keys, "__before", "__further"], "left")
        known = F.col("__name").isNotNull()
        links = cut_lineage(far.select(
            *keys, "__part", "__number", F.coalesce("__name", "__n").alias("__name"),
            F.when(known, F.col("__before")).otherwise(F.col("__b")).alias("__before"),
            F.when(known, F.col("__further")).otherwise(F.col("__f")).alias("__further"),
        ))
    return links.select(*keys, "__part", "__number", "__name")
