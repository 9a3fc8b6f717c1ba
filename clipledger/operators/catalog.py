"""The searchable material catalog: build, save, search, reassemble, count.

Tables (all Parquet): ``participants``, ``materials``, ``material_events`` and
``material_participants``. Events carry ``event_seq``, their insertion order.
"""

from dataclasses import dataclass, replace as dc_replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipledger.functions.text import participant_id, participant_label
from clipledger.operators.guards import stop_unless
from clipledger.vocabulary import SCHEMA_VERSION


def _event_or(column: Column, fallback: str) -> Column:
    return F.coalesce(F.nullif(column, F.lit("")), F.lit(fallback))


@dataclass(frozen=True)
class Catalog:
    """The four catalog tables as DataFrames."""

    participants: DataFrame
    materials: DataFrame
    material_events: DataFrame
    material_participants: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return {
            "participants": self.participants,
            "materials": self.materials,
            "material_events": self.material_events,
            "material_participants": self.material_participants,
        }


# ---------------------------------------------------------------- building


def _is_tag() -> Column:
    return _event_or(F.col("event"), "blank") != "blank"


def final_event_tags(events: DataFrame) -> DataFrame:
    """Catalog event rows of final materials: no background, names filled in.

    ``events`` has ``material_id, event_seq, event, confidence,
    global_track_id, participant_id, identity_status, evidence_start_seconds,
    evidence_end_seconds``.
    """
    return events.filter(_is_tag()).select(
        "material_id",
        "event_seq",
        F.col("event").alias("event_name"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        F.col("global_track_id").alias("player_id"),
        "participant_id",
        "identity_status",
        F.col("evidence_start_seconds").alias("start_seconds"),
        F.col("evidence_end_seconds").alias("end_seconds"),
    )


def build_final_materials(
    drafts: DataFrame, events: DataFrame, participants: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Material rows with status, their event tags and participant references.

    ``drafts`` has ``material_id, source_video_id, video_path, start_seconds,
    end_seconds`` and perhaps ``metadata_json``; a range without length stops the query.
    """
    tags = final_event_tags(events)
    people = _final_people(participants)
    has_event = tags.select("material_id").distinct().withColumn("__event", F.lit(True))
    materials = _final_materials(drafts.join(has_event, "material_id", "left"))
    return materials, tags, people


def _final_people(participants: DataFrame) -> DataFrame:
    return participants.filter("participant_id IS NOT NULL").withColumn(
        "track_id", _event_or(F.col("track_id"), "unknown")
    )


def _final_materials(drafts: DataFrame) -> DataFrame:
    """Material rows of drafts that know by ``__event`` whether they have an event tag."""
    drafts = stop_unless(drafts, F.col("end_seconds") > F.col("start_seconds"), F.concat(F.lit("material without length: "), "material_id"))
    metadata = F.col("metadata_json") if "metadata_json" in drafts.columns else F.lit(None).cast("string")
    return drafts.select(
        "material_id",
        "source_video_id",
        F.col("material_id").alias("segment_id"),
        "video_path",
        "start_seconds",
        "end_seconds",
        F.when(F.col("__event"), "ready").otherwise("ready_without_event").alias(
            "processing_status"
        ),
        F.coalesce(metadata, F.lit("{}")).alias("metadata_json"),
    )


def window_participants(predictions: DataFrame, identities: DataFrame | None = None) -> DataFrame:
    """Participants of window-level materials; the last prediction of an id wins.

    ``predictions`` has ``material_id, pos`` and the prediction columns;
    ``identities`` maps (material, track) to a status.
    """
    keyed = predictions.select(
        "material_id",
        "pos",
        participant_id(
            F.col("participant_id"), F.col("jersey_color"), F.col("jersey_number"), F.col("player_id")
        ).alias("participant_id"),
        _event_or(F.col("player_id"), "unknown").alias("track_id"),
        "jersey_color",
        "jersey_number",
        "player_name",
    )
    last = keyed.groupBy("material_id", "participant_id").agg(
        F.max_by(
            F.struct("track_id", "jersey_color", "jersey_number", "player_name"), "pos"
        ).alias("last")
    )
    people = last.select("material_id", "participant_id", "last.*")
    if identities is None:
        return people.withColumn("identity_status", F.lit(None).cast("string"))
    status = identities.groupBy("material_id", "track_id").agg(
        F.max_by("status", "pos").alias("identity_status")
    )
    return people.join(status, ["material_id", "track_id"], "left").select(
        *people.columns, "identity_status"
    )


def events_with_fallback(predictions: DataFrame, temporal: DataFrame) -> DataFrame:
    """Event tags per material: temporal events, or predictions where there are none.

    Person and status of a temporal event are filled from the last prediction of
    the same player.
    """
    by_player = (
        predictions.filter("player_id IS NOT NULL")
        .groupBy("material_id", "player_id")
        .agg(
            F.max_by(F.struct("participant_id", "identity_status"), "pos").alias("__meta")
        )
    )
    # A player without an id is looked up under the empty id.
    wanted = temporal.filter(_event_or(F.col("event"), "blank") != "blank").withColumn(
        "__player", F.coalesce("player_id", F.lit(""))
    )
    joined = wanted.join(
        by_player.withColumnRenamed("player_id", "__player"), ["material_id", "__player"], "left"
    )
    tags = joined.select(
        "material_id",
        F.col("pos").alias("event_seq"),
        F.col("event").alias("event_name"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        "player_id",
        F.coalesce(F.nullif("participant_id", F.lit("")), "__meta.participant_id").alias(
            "participant_id"
        ),
        F.coalesce(F.nullif("identity_status", F.lit("")), "__meta.identity_status").alias(
            "identity_status"
        ),
        F.col("start_time").alias("start_seconds"),
        F.col("end_time").alias("end_seconds"),
    )
    fallback = (
        predictions.filter(_event_or(F.col("event"), "blank") != "blank")
        .join(wanted.select("material_id").distinct(), "material_id", "left_anti")
        .select(
            "material_id",
            F.col("pos").alias("event_seq"),
            F.col("event").alias("event_name"),
            F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
            "player_id",
            "participant_id",
            "identity_status",
            F.lit(None).cast("double").alias("start_seconds"),
            F.lit(None).cast("double").alias("end_seconds"),
        )
    )
    return tags.unionByName(fallback)


def build_window_materials(
    windows: DataFrame,
    predictions: DataFrame,
    temporal: DataFrame,
    identities: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Window-level materials with their tags and participants.

    ``windows`` has ``source_video_id, segment_id, video_path, start_seconds,
    end_seconds``; the other tables are keyed by ``material_id``, which is
    ``source_video_id:segment_id``.
    """
    tags = events_with_fallback(predictions, temporal)
    people = window_participants(predictions, identities)
    end = F.when(F.col("end_seconds") >= F.col("start_seconds"), F.col("end_seconds")).otherwise(
        F.raise_error(F.concat(F.lit("window ends before it starts: "), "segment_id")).cast("double")
    )
    has_event = tags.select("material_id").distinct().withColumn("__event", F.lit(True))
    materials = (
        windows.withColumn("material_id", F.concat_ws(":", "source_video_id", "segment_id"))
        .join(has_event, "material_id", "left")
        .select(
            "material_id",
            "source_video_id",
            "segment_id",
            "video_path",
            "start_seconds",
            end.alias("end_seconds"),
            F.when(F.col("__event"), "ready").otherwise("ready_without_event").alias(
                "processing_status"
            ),
        )
    )
    return materials, tags, people


def summarize_reports(reports: DataFrame, predictions: DataFrame, temporal: DataFrame) -> DataFrame:
    """Overall totals of prediction reports, one row.

    ``reports`` has one row per clip. The three global aggregates are single
    rows, stacked and folded into one.
    """
    event = _event_or(F.col("event"), "unknown")
    totals = predictions.agg(
        F.count(F.lit(1)).alias("player_prediction_count"),
        F.count_if(event != "blank").alias("non_background_prediction_count"),
        F.avg("confidence").alias("mean_confidence"),
    )
    clips = reports.agg(F.count(F.lit(1)).alias("clip_count"))
    evidence = temporal.agg(F.count(F.lit(1)).alias("temporal_event_count"))
    stacked = clips.unionByName(totals, allowMissingColumns=True).unionByName(
        evidence, allowMissingColumns=True
    )
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def count_reports(predictions: DataFrame) -> DataFrame:
    """Prediction counts by event and by participant label, in one pass."""
    shaped = predictions.select(
        _event_or(F.col("event"), "unknown").alias("event"),
        participant_label(F.col("jersey_color"), F.col("jersey_number"), F.col("player_id")).alias(
            "participant"
        ),
    )
    grouped = shaped.groupingSets([["event"], ["participant"]], "event", "participant").agg(
        F.count(F.lit(1)).alias("n"), F.grouping("event").alias("__g")
    )
    return grouped.select(
        F.when(F.col("__g") == 0, "event").otherwise("participant").alias("kind"),
        F.when(F.col("__g") == 0, F.col("event")).otherwise(F.col("participant")).alias("name"),
        "n",
    )


def finalize(
    drafts: DataFrame,
    events: DataFrame,
    event_identities: DataFrame,
    material_references: DataFrame,
) -> tuple[DataFrame, DataFrame]:
    """Event rows and participant references of the materials to register.

    ``drafts`` has ``source_video_id, material_id, event_ids``. A video with any
    event identity uses those; otherwise the cross-material references.
    """
    joined, references, fallback = _final_parts(drafts, events, event_identities, material_references)
    return joined, references.unionByName(fallback)


def _final_parts(
    drafts: DataFrame, events: DataFrame, event_identities: DataFrame, material_references: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Event rows, the references that come from them, and those that stand in for videos without any."""
    links = drafts.select(
        "source_video_id", "material_id", F.posexplode("event_ids").alias("event_seq", "event_id")
    )
    related = links.join(events.drop("source_video_id"), "event_id")
    identity = event_identities.select(
        "event_id",
        F.col("participant_id").alias("participant_id"),
        F.col("status").alias("identity_status"),
        "jersey_color",
        "jersey_number",
        "player_name",
        F.coalesce(
            F.get("track_references", F.lit(0)), F.nullif("track_id", F.lit("")), "event_id"
        ).alias("track_id"),
    )
    joined = related.select(
        "source_video_id", "material_id", "event_seq", "event_id", "event", "confidence",
        "global_track_id", "evidence_start_seconds", "evidence_end_seconds",
    ).join(identity, "event_id", "left")

    references = joined.filter("participant_id IS NOT NULL").select(
        "source_video_id", "material_id", "event_seq", "participant_id", "track_id",
        "jersey_color", "jersey_number", "player_name", "identity_status",
    )
    # The first event of a material decides the attributes of a repeated pair.
    references = references.groupBy(
        "source_video_id", "material_id", "participant_id", "track_id"
    ).agg(
        F.min_by(
            F.struct("jersey_color", "jersey_number", "player_name", "identity_status"), "event_seq"
        ).alias("first")
    ).select("source_video_id", "material_id", "participant_id", "track_id", "first.*")

    with_identity = (
        events.select("event_id", "source_video_id")
        .join(event_identities.select("event_id"), "event_id", "left_semi")
        .select("source_video_id")
        .distinct()
    )
    fallback = material_references.join(
        with_identity, "source_video_id", "left_anti"
    ).select(*references.columns).join(
        drafts.select("material_id"), "material_id", "left_semi"
    )
    return joined, references, fallback


def register_final(
    catalog: Catalog,
    exported: DataFrame,
    events: DataFrame,
    event_identities: DataFrame,
    material_references: DataFrame,
    now: Column,
) -> Catalog:
    """What to save for exported materials: rows with metadata, tags, references, and the persons upserted.

    ``exported`` has the columns of drafts for ``finalize`` and ``build_final_materials``.
    A person's last reference wins, in order of video, material and track. Its ``materials``
    are the registered ones; pass the result to ``save_materials`` or ``save_keyed``.
    """
    joined, own, fallback = _final_parts(exported, events, event_identities, material_references)
    references = own.unionByName(fallback)
    # what a material's row says of its tags and references, in one pass over both
    told = joined.select("material_id", _is_tag().alias("__event"), F.col("participant_id").isNotNull().alias("__known"))
    stand_in = fallback.select("material_id", F.lit(False).alias("__event"), F.lit(True).alias("__known"))
    found = told.unionByName(stand_in).groupBy("material_id").agg(F.max("__event").alias("__event"), F.max("__known").alias("__known"))
    metadata = F.to_json(F.struct(
        "event_ids", F.lit("event_timeline").alias("boundary_source"),
        F.coalesce("__known", F.lit(False)).alias("identity_available"),
    ))
    materials = _final_materials(exported.join(found, "material_id", "left").withColumn("metadata_json", metadata))
    tags, people = final_event_tags(joined), _final_people(references.drop("source_video_id"))
    persons = references.filter("participant_id IS NOT NULL").select(
        "participant_id",
        F.struct("source_video_id", "material_id", "track_id").alias("pos"),
        F.col("player_name").alias("display_name"),
        "jersey_color",
        "jersey_number",
        F.to_json(F.struct("identity_status")).alias("metadata_json"),
    )
    return Catalog(save_participants(catalog.participants, persons, now), materials, tags, people)


def material_index(exported: DataFrame, drafts: DataFrame, events: DataFrame) -> DataFrame:
    """Exported materials with times falling back to their drafts, events nested."""
    times = drafts.select(
        "material_id",
        F.col("start_seconds").alias("__start"),
        F.col("end_seconds").alias("__end"),
    )
    nested = (
        exported.select("material_id", F.posexplode("event_ids").alias("pos", "event_id"))
        .join(events.select("event_id", F.struct("event_id", "event", "confidence").alias("item")), "event_id")
        .groupBy("material_id")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "item"))).getField("item").alias("events"))
    )
    return (
        exported.join(times, "material_id", "left")
        .join(nested, "material_id", "left")
        .select(
            "material_id",
            F.coalesce("video_path", F.lit("")).alias("video_path"),
            F.coalesce("start_seconds", "__start", F.lit(0.0)).alias("start_seconds"),
            F.coalesce("end_seconds", "__end", F.lit(0.0)).alias("end_seconds"),
            "events",
        )
    )


# ------------------------------------------------------------------ saving


def material_violations(source: DataFrame, target: DataFrame, replace: bool) -> DataFrame:
    """Rows of ``source`` that must not be saved, with the broken rule."""
    backwards = source.filter("end_seconds < start_seconds").select(
        "material_id", F.lit("end_before_start").alias("violation")
    )
    repeated = (
        source.groupBy("material_id")
        .count()
        .filter("count > 1")
        .select("material_id", F.lit("duplicate_in_source").alias("violation"))
    )
    kept = target.select("material_id", "source_video_id", "segment_id")
    if replace:
        kept = kept.join(source.select("material_id"), "material_id", "left_anti")
    both = kept.unionByName(source.select("material_id", "source_video_id", "segment_id"))
    segments = both.groupBy("source_video_id", "segment_id").agg(
        (F.min("material_id") != F.max("material_id")).alias("__clash")
    )
    segment = source.join(
        segments.filter("__clash"), ["source_video_id", "segment_id"], "left_semi"
    ).select("material_id", F.lit("duplicate_segment").alias("violation"))
    result = backwards.unionByName(repeated).unionByName(segment)
    if not replace:
        existing = source.join(target.select("material_id"), "material_id", "left_semi").select(
            "material_id", F.lit("duplicate_material").alias("violation")
        )
        result = result.unionByName(existing)
    return result.distinct()


def save_materials(catalog: Catalog, source: Catalog, replace: bool = False) -> Catalog:
    """The next catalog version after saving ``source``.

    Replaced materials lose their old events and participants. Check
    ``material_violations`` first; the caller writes the returned tables.
    """
    incoming = source.materials.select("material_id")

    def merged(old: DataFrame, new: DataFrame) -> DataFrame:
        kept = old.join(incoming, "material_id", "left_anti") if replace else old
        return kept.unionByName(new, allowMissingColumns=True)

    return dc_replace(
        catalog,
        materials=merged(catalog.materials, source.materials),
        material_events=merged(catalog.material_events, source.material_events),
        material_participants=merged(
            catalog.material_participants, source.material_participants
        ),
    )


def save_participants(
    target: DataFrame, source: DataFrame, now: Column, replace: bool = True
) -> DataFrame:
    """Upsert person records; the last source row of an id wins.

    ``source`` has ``participant_id, pos, display_name, jersey_color,
    jersey_number, metadata_json``. An existing id keeps ``created_at``.
    Without ``replace`` an existing id stops the query.
    """
    fields = ["display_name", "jersey_color", "jersey_number", "metadata_json"]
    latest = (
        source.groupBy("participant_id")
        .agg(F.max_by(F.struct(*fields), "pos").alias("new"), F.count(F.lit(1)).alias("__n"))
    )
    old = target.select(
        "participant_id",
        F.struct(*fields).alias("old"),
        "created_at",
        "updated_at",
        F.lit(True).alias("__exists"),
    )
    joined = old.join(latest, "participant_id", "full_outer")
    arrives = F.col("new").isNotNull()
    exists = F.coalesce("__exists", F.lit(False))
    person = F.col("participant_id")
    if not replace:
        clash = arrives & (exists | (F.col("__n") > 1))
        joined = stop_unless(joined, ~F.coalesce(clash, F.lit(False)), F.concat(F.lit("participant exists: "), "participant_id"))
    return joined.select(
        person.alias("participant_id"),
        *[F.when(arrives, F.col(f"new.{f}")).otherwise(F.col(f"old.{f}")).alias(f) for f in fields],
        F.coalesce("created_at", now).alias("created_at"),
        F.when(arrives, now).otherwise(F.col("updated_at")).alias("updated_at"),
    )


# --------------------------------------------------------------- searching


def find_materials(
    catalog: Catalog,
    event: str | None = None,
    person: str | None = None,
    minimum_confidence: float = 0.0,
    ordered: bool = True,
) -> DataFrame:
    """Materials by event, by person, or both on the same event row.

    The confidence only counts together with an event. All shapes are semi
    joins on filtered key sets, so a material appears once.
    """
    events = catalog.material_events
    found = catalog.materials
    if event is not None:
        hit = (F.col("event_name") == event) & (F.col("confidence") >= float(minimum_confidence))
        if person is not None:
            hit = hit & (F.col("participant_id") == person)
        found = found.join(events.filter(hit).select("material_id"), "material_id", "left_semi")
    elif person is not None:
        mine = F.col("participant_id") == person
        keys = events.filter(mine).select("material_id").union(
            catalog.material_participants.filter(mine).select("material_id")
        )
        found = found.join(keys, "material_id", "left_semi")
    return found.orderBy("source_video_id", "start_seconds") if ordered else found


def nest_materials(materials: DataFrame, catalog: Catalog) -> DataFrame:
    """Attach events (insertion order) and participants (by id, track) to materials.

    Restricted to the requested materials by semi joins before nesting.
    """
    ids = materials.select("material_id")
    events = (
        catalog.material_events.join(ids, "material_id", "left_semi")
        .groupBy("material_id")
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct(
                        "event_seq",
                        "event_name",
                        "confidence",
                        "player_id",
                        "participant_id",
                        "identity_status",
                        "start_seconds",
                        "end_seconds",
                    )
                )
            ).alias("events")
        )
    )
    people = (
        catalog.material_participants.join(ids, "material_id", "left_semi")
        .groupBy("material_id")
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct(
                        "participant_id",
                        "track_id",
                        "jersey_color",
                        "jersey_number",
                        "player_name",
                        "identity_status",
                    )
                )
            ).alias("participants")
        )
    )
    return materials.join(events, "material_id", "left").join(people, "material_id", "left")


def get_material(catalog: Catalog, material_id: str) -> DataFrame:
    return nest_materials(catalog.materials.filter(F.col("material_id") == material_id), catalog)


def list_materials(catalog: Catalog) -> DataFrame:
    return find_materials(catalog)


def get_participant(participants: DataFrame, person: str) -> DataFrame:
    return participants.filter(F.col("participant_id") == person)


def find_participants_by_jersey(participants: DataFrame, color: str, number: str) -> DataFrame:
    """Exact search; only the arguments are normalised, not the stored values."""
    return participants.filter(
        (F.col("jersey_color") == color.strip().lower())
        & (F.col("jersey_number") == number.strip())
    ).orderBy("participant_id")


def status(catalog: Catalog, versions: DataFrame | None = None) -> DataFrame:
    """Row count per table, and the stored schema version."""
    result = None
    for name, table in catalog.tables().items():
        count = table.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("item"), "n")
        result = count if result is None else result.unionByName(count)
    if versions is not None:
        newest = versions.agg(F.coalesce(F.max("version"), F.lit(0)).cast("bigint").alias("n"))
        result = result.unionByName(newest.select(F.lit("schema_version").alias("item"), "n"))
    return result


def migrate_events(material_events: DataFrame, version: int) -> DataFrame:
    """Bring an older event table to the current layout; refuse a newer one."""
    if version > SCHEMA_VERSION:
        raise ValueError(f"catalog version {version} is newer than {SCHEMA_VERSION}")
    out = material_events
    for name in ("participant_id", "identity_status"):
        if name not in out.columns:
            out = out.withColumn(name, F.lit(None).cast("string"))
    return out


