"""Text normalisation as native column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from clipledger.vocabulary import CONFIDENCE_WORDS, LABEL_ALIASES, LABELS, REPORT_ALIASES, TEAM_ALIASES


def literal_map(values: dict) -> Column:
    """A constant lookup table; it lives inside the expression, so no join."""
    return F.create_map(*[F.lit(item) for pair in values.items() for item in pair])


def lookup(values: dict, key: Column) -> Column:
    return F.try_element_at(literal_map(values), key)


def strip(value: Column) -> Column:
    """Trim every kind of ASCII white space, not only blanks."""
    return F.btrim(value, F.lit(" \t\n\r\x0b\x0c"))


def collapse(value: Column) -> Column:
    return F.trim(F.regexp_replace(value, r"\s+", " "))


def blank_to_null(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def numbered(prefix: Column | str, index: Column | str, digits: int) -> Column:
    """Prefix and zero-padded number, longer numbers in full.

    Same text as a ``%0Nd`` format, but compiled instead of run by a formatter.
    """
    number = (F.col(index) if isinstance(index, str) else index).cast("string")
    return F.concat(prefix, F.lpad(number, F.greatest(F.lit(digits), F.length(number)), "0"))


def normalize_color(value: Column, collapse_inner: bool = True) -> Column:
    """Lower-cased colour or NULL; optionally keep inner white space as it is."""
    lowered = F.lower(value)
    return blank_to_null(collapse(lowered) if collapse_inner else strip(lowered))


def normalize_jersey_number(value: Column, kind: str = "string") -> Column:
    """One or two ASCII digits, keeping ``0`` and ``00`` apart; else NULL.

    ``kind`` names the column type: ``string``, ``integer``, ``double`` (whole
    numbers only) or ``boolean`` (never a number).
    """
    if kind == "boolean":
        return F.lit(None).cast("string")
    if kind == "double":
        text = F.when(value == F.floor(value), F.floor(value).cast("bigint").cast("string"))
    elif kind == "integer":
        text = value.cast("string")
    else:
        text = strip(value)
    return F.when(text.rlike("^[0-9]{1,2}$"), text)


def normalize_confidence(value: Column) -> Column:
    """Number clamped to [0, 1]; low/medium/high as words; anything else 0."""
    word = F.lower(strip(value))
    number = value.try_cast("double")
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), number))
    return F.coalesce(
        F.when(number.isNotNull() & ~F.isnan(number), clamped),
        lookup(CONFIDENCE_WORDS, word),
        F.lit(0.0),
    )


def strict_confidence(value: Column) -> Column:
    """Number in [0, 1], or NULL when it is missing, outside or not finite."""
    number = value.try_cast("double")
    return F.when((number >= 0.0) & (number <= 1.0), number)


def known_event(value: Column) -> Column:
    """Canonical label, or NULL for an unknown one."""
    names = {name.lower(): name for name in LABELS} | LABEL_ALIASES
    return lookup(names, F.lower(strip(value)))


def event_name(value: Column) -> Column:
    """Canonical label; an unknown one stops the query, it is never background."""
    return F.coalesce(
        known_event(value),
        F.raise_error(F.concat(F.lit("unknown event label: "), F.coalesce(value, F.lit("NULL")))).cast("string"),
    )


def report_event_name(value: Column) -> Column:
    """Small alias set used when comparing one report; unknown names pass."""
    return F.coalesce(lookup(REPORT_ALIASES, collapse(F.lower(value))), strip(value))


def identifier(value: Column) -> Column:
    """Lower-case slug safe inside an id, ``unknown`` when nothing is left."""
    slug = F.regexp_replace(F.lower(strip(value)), "[^0-9a-z_.-]+", "-")
    slug = F.regexp_replace(slug, "^-+|-+$", "")
    return F.coalesce(blank_to_null(slug), F.lit("unknown"))


def participant_id(stable: Column, color: Column, number: Column, player: Column) -> Column:
    """Stable id, else ``color#number``, else the player id, else ``color#unknown``."""
    shade = strip(F.lower(F.coalesce(blank_to_null(color), F.lit("unknown"))))
    digits = blank_to_null(strip(number))
    return F.coalesce(
        blank_to_null(strip(stable)),
        F.concat(shade, F.lit("#"), digits),
        blank_to_null(player),
        F.concat(shade, F.lit("#unknown")),
    )


def participant_label(color: Column, number: Column, player: Column) -> Column:
    shade = F.lower(F.coalesce(blank_to_null(color), F.lit("unknown")))
    digits = blank_to_null(strip(number))
    return F.coalesce(
        F.concat(shade, F.lit(" #"), digits),
        blank_to_null(player),
        F.concat(shade, F.lit(" unknown")),
    )


def parse_track_reference(reference: Column) -> Column:
    """Struct (window_id, track_id) split at the last slash; NULL when malformed."""
    window = strip(F.regexp_extract(reference, r"(?s)^(.*)/([^/]*)$", 1))
    track = strip(F.regexp_extract(reference, r"(?s)^(.*)/([^/]*)$", 2))
    return F.when(
        (window != "") & (track != ""),
        F.struct(window.alias("window_id"), track.alias("track_id")),
    )


def query_value(url: Column, name: str) -> Column:
    """First non-empty value of a URL query field, decoded and trimmed."""
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    raw = F.regexp_extract(query, rf"(?:^|&){name}=([^&]+)", 1)
    decoded = F.coalesce(F.try_url_decode(raw), F.replace(raw, F.lit("+"), F.lit(" ")))
    return blank_to_null(strip(decoded))


def parse_event_url(url: Column) -> Column:
    return F.struct(
        query_value(url, "GameID").alias("game_id"),
        query_value(url, "GameEventID").alias("game_event_id"),
        query_value(url, "Season").alias("season"),
        query_value(url, "title").alias("description"),
    )


def game_id(game: Column, strict: bool = True) -> Column:
    """The trailing ten digits of a game folder name."""
    digits = blank_to_null(F.regexp_extract(game, r"([0-9]{10})$", 1))
    if not strict:
        return digits
    return F.coalesce(
        digits, F.raise_error(F.concat(F.lit("no ten-digit game id in: "), game)).cast("string")
    )


def game_team_codes(game: Column, strict: bool = True) -> Column:
    """Two roster team codes of a folder such as ``aaa-vs-bbb-0000000000``."""
    matchup = F.regexp_replace(game, "-[^-]*$", "")

    def code(group: int) -> Column:
        raw = F.regexp_extract(matchup, r"^(.*?)-vs-(.*)$", group)
        return F.coalesce(lookup(TEAM_ALIASES, raw), F.upper(raw))

    pair = F.when(matchup.contains("-vs-"), F.array(code(1), code(2)))
    if not strict:
        return pair
    return F.coalesce(
        pair,
        F.raise_error(F.concat(F.lit("no teams in game folder: "), game)).cast("array<string>"),
    )


def normalize_video_key(value: Column) -> Column:
    """Forward-slash relative path without empty or ``.`` steps."""
    path = F.regexp_replace(F.translate(value, "\\", "/"), "/+", "/")
    path = F.regexp_replace(path, r"/(\./)+", "/")
    path = F.regexp_replace(path, r"^(\./)+|/\.?$", "")
    return F.when(path == "", F.lit(".")).otherwise(path)
