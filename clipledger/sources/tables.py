"""Delimited metadata, captions and action literals."""

import ast
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clipledger.functions.text import normalize_video_key, strip
from clipledger.operators.prefix import with_position

_ACTION = T.StructType(
    [
        T.StructField("player", T.StringType()),
        T.StructField("color", T.StringType()),
        T.StructField("action", T.StringType()),
        T.StructField("result", T.BooleanType()),
        T.StructField("assisted", T.BooleanType()),
        T.StructField("other_player", T.StringType()),
    ]
)
_FLAGS = {"result", "assisted"}
_ACTIONS = T.StructType(
    [T.StructField("actions", T.ArrayType(_ACTION)), T.StructField("error", T.StringType())]
)


def read_semicolon_csv(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Semicolon text with a header; every column is a string, a BOM is dropped.

    Quoted fields may hold line breaks, so a file is one split: write large
    tables as many files. Empty fields are empty texts. Give ``columns`` to skip
    reading the header first.
    """
    reader = spark.read.option("sep", ";").option("header", True).option("escape", '"').option("multiLine", True)
    if columns:
        table = reader.schema(", ".join(f"`{c}` string" for c in columns)).csv(path)
    else:
        table = reader.csv(path)
    return table.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c.lstrip("﻿")) for c in table.columns])


def _with_row_index(table: DataFrame) -> DataFrame:
    """Row number over the files in path order.

    Spark may read file splits in any order, so rows are numbered inside their
    split and the splits are ordered by path and offset.
    """
    located = table.select(
        F.struct(
            F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_block_start").alias("offset"),
        ).alias("__split"),
        *[F.col(f"`{c}`") for c in table.columns],
    ).withColumn("__row", F.monotonically_increasing_id()).withColumn("__all", F.lit(0))
    return with_position(
        located, ["__all"], [F.col("__row")], F.col("__split"), name="row_index"
    ).drop("__split", "__row", "__all")


def pair_by_position(source: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pair two tables read from files row by row, and list what does not fit.

    Both have ``urls, actions``; ``paths`` also ``numerosity``. Returns the
    records and the anomalies (``row_index, code``): no partner, other actions,
    or a ``numerosity`` that is no whole number.
    """
    left = _with_row_index(source).select(
        "row_index", F.col("urls").alias("event_url"), F.col("actions").alias("__a"), F.lit(True).alias("__left")
    )
    right = _with_row_index(paths).select(
        "row_index", F.col("urls").alias("path"), F.col("actions").alias("__b"), "numerosity", F.lit(True).alias("__right")
    )
    joined = left.join(right, "row_index", "full_outer")
    code = (
        F.when(F.col("__left").isNull() | F.col("__right").isNull(), "ROW_COUNT_MISMATCH")
        .when(~F.col("__a").eqNullSafe(F.col("__b")), "ACTION_MISMATCH")
        .when(strip(F.col("numerosity").cast("string")).try_cast("int").isNull(), "BAD_NUMEROSITY")
    )
    checked = joined.withColumn("code", code)
    key = normalize_video_key(F.col("path"))
    records = checked.filter("code IS NULL").select(
        "row_index",
        key.alias("video_key"),
        F.split(key, "/")[0].alias("game"),
        "event_url",
        F.col("__b").alias("actions"),
        strip(F.col("numerosity").cast("string")).try_cast("int").alias("numerosity"),
    )
    return records, checked.filter("code IS NOT NULL").select("row_index", "code")


def last_assistant_answer(turns: DataFrame, key: str = "video") -> DataFrame:
    """Last trimmed assistant turn per conversation.

    ``turns`` has ``key, turn, role, text``. One partial aggregate.
    """
    spoken = turns.filter(F.col("role").isin("gpt", "assistant"))
    answer = strip(F.coalesce("text", F.lit("")))
    return spoken.groupBy(key).agg(F.max_by(answer, "turn").alias("answer"))


def load_metadata(source: DataFrame, paths: DataFrame, captions: DataFrame) -> dict[str, DataFrame]:
    """Clip records with their caption, the clips without one, and anomalies.

    ``captions`` has ``video, turn, role, text``. A later row of the same video
    replaces an earlier one.
    """
    records, anomalies = pair_by_position(source, paths)
    fields = ["game", "event_url", "actions", "numerosity"]
    unique = records.groupBy("video_key").agg(
        F.max_by(F.struct(*fields), "row_index").alias("r")
    ).select("video_key", "r.*")
    answers = last_assistant_answer(
        captions.withColumn("video", normalize_video_key(F.col("video")))
    ).select(F.col("video").alias("video_key"), F.nullif("answer", F.lit("")).alias("gt_caption"))
    full = unique.join(answers, "video_key", "left")
    return {
        "records": full,
        "missing_captions": full.filter("gt_caption IS NULL").select("video_key", "game"),
        "anomalies": anomalies,
    }


_ARROW = [pa.field(f.name, pa.bool_() if f.dataType == T.BooleanType() else pa.string()) for f in _ACTION]

# The usual literal: one line, objects of plain texts, small whole numbers and constants.
_TEXT = r"""(?:'[^'\\\r\n\0]*+'|"[^"\\\r\n\0]*+")"""
_PAIR = rf"{_TEXT}: *+(?:{_TEXT}|True|False|None|0|[1-9][0-9]{{0,17}}+)"
_OBJECT = rf"\{{(?:{_PAIR}(?:, *+{_PAIR})*+)?+\}}"
_PLAIN = re.compile(rf"\[(?:{_OBJECT}(?:, *+{_OBJECT})*+)?+\]")
_PART = re.compile(r"""(?:'([^']*+)'|"([^"]*+)"): *+(?:'([^']*+)'|"([^"]*+)"|(True|False)|(None)|([0-9]++))|(\})""")


def _plain_literal(raw: str) -> list[tuple] | None:
    """What ``_literal`` gives for a usual literal; None for any other text."""
    if not _PLAIN.fullmatch(raw):
        return None
    rows, row = [], {}
    for single, double, one, two, flag, nothing, number, end in _PART.findall(raw):
        if end:
            rows.append(tuple(map(row.get, _ACTION.names)))
            row = {}
            continue
        name = single or double
        if name in _FLAGS:
            row[name] = flag == "True" if flag else None
        else:
            row[name] = None if nothing else one or two or flag or number
    return rows


def _literal(raw: str) -> list[tuple]:
    value = ast.literal_eval(raw)
    if not isinstance(value, list) or not all(isinstance(item, dict) for item in value):
        raise ValueError("actions must be a list of objects")
    rows = []
    for item in value:
        row = []
        for name in _ACTION.names:
            field = item.get(name)
            if name in _FLAGS:
                row.append(field if isinstance(field, bool) else None)
            elif isinstance(field, float) and field.is_integer():
                row.append(str(int(field)))
            else:
                row.append(None if field is None else str(field))
        rows.append(tuple(row))
    return rows


@F.arrow_udf(_ACTIONS)
def _parse_literals(texts: pa.Array) -> pa.Array:
    """All actions of a batch as one column per field, cut into lists by text."""
    rows, ends, errors = [], [0], []
    for text in texts.to_pylist():
        try:
            found = None if text is None else _plain_literal(text)
            rows += _literal(text) if found is None else found
            errors.append(None)
        except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError) as problem:
            errors.append(f"{type(problem).__name__}: {problem}")
        ends.append(len(rows))
    columns = zip(*rows) if rows else [()] * len(_ARROW)
    items = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW)], fields=_ARROW)
    failed = pa.array([e is not None for e in errors])
    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items, mask=failed)
    return pa.StructArray.from_arrays([lists, pa.array(errors, pa.string())], names=_ACTIONS.names)


# Spark runs a deterministic function again for each filter on its result.
_parse_once = _parse_literals.asNondeterministic()


def parse_actions(raw: Column) -> Column:
    """Struct (actions, error) from a Python-literal list of objects."""
    return _parse_once(raw)
