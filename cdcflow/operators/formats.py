"""Event serializers: key and value text in five wire formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.decode import KEEP_NULLS, json_text
from .events import DELETE, INSERT, SNAPSHOT, UPDATE

FORMATS = ("ENVELOPE", "CANAL_JSON", "COMPATIBLE_DEBEZIUM_JSON", "MAXWELL_JSON", "OGG_JSON")


def chosen_format(name: str | None) -> str:
    """Blank means ENVELOPE; an unknown name is an error."""
    name = (name or "").strip() or FORMATS[0]
    if name not in FORMATS:
        raise ValueError(f"unknown format: {name}")
    return name


def after_image() -> Column:
    return F.when(F.col("op") != DELETE, F.col("data"))


def row_image() -> Column:
    return F.when(F.col("op") == DELETE, F.col("before")).otherwise(F.col("data"))


def _text(value: Column) -> Column:
    """A JSON string or null."""
    quoted = F.to_json(F.struct(value.alias("v")), KEEP_NULLS)
    return F.substring(quoted, F.lit(6), F.length(quoted) - 6)


def _object(**members: Column) -> Column:
    """Members are JSON texts; a null one is left out."""
    return F.concat(F.lit("{"), F.concat_ws(",", *[F.when(v.isNotNull(), F.concat(F.lit(f'"{k}":'), v)) for k, v in members.items()]), F.lit("}"))


def old_values(columns: list[str], kind: T.StructType) -> Column:
    """JSON object of the columns whose value before is to be told: those that differ, and those whose value after is null."""
    told = []
    for c in columns:
        was, now = F.col(f"before.{c}"), F.col(f"data.{c}")
        one = json_text(F.struct(was.alias(c)), T.StructType([kind[c]]))
        told.append(F.when(now.isNull() | ~was.eqNullSafe(now), F.substring(one, F.lit(2), F.length(one) - 2)))
    return F.concat(F.lit("{"), F.concat_ws(",", *told), F.lit("}"))


def serialize(events: DataFrame, keys: list[str], name: str | None = None) -> DataFrame:
    """events with value: the text in the named format. key is the key text in every format; times are the event's."""
    name = chosen_format(name)
    kind = events.schema["data"].dataType
    columns = kind.names
    _json = lambda image: F.coalesce(json_text(image, kind), F.lit("null"))
    op, es = F.col("op"), F.col("event_ms")
    old = F.when(op == UPDATE, F.when(F.col("before").isNull(), "{}").otherwise(old_values(columns, kind)))
    names = F.lit("[" + ",".join(f'"{k}"' for k in keys) + "]")
    number = lambda c: c.cast("long").cast("string")
    if name == "ENVELOPE":
        source = _object(database=_text(F.col("sourceDatabase")), table=_text(F.col("sourceTable")))
        value = _object(op=_text(op), key=F.col("key"), data=_json(row_image()), before=_json(F.col("before")), source=source, sourceEventTime=_text(F.col("sourceEventTime")), phase=_text(F.col("phase")))
    elif name == "CANAL_JSON":
        rows = F.concat(F.lit("["), F.coalesce(json_text(row_image(), kind), F.lit("{}")), F.lit("]"))
        value = _object(
            type=_text(op), database=_text(F.col("sourceDatabase")), table=_text(F.col("sourceTable")), es=number(es), ts=number(es), data=rows, old=F.concat(F.lit("["), old, F.lit("]")),
            pkNames=names, isDdl=F.lit("false"), sql=F.lit('""'),
        )
    elif name == "COMPATIBLE_DEBEZIUM_JSON":
        code = F.when((op == INSERT) & (F.col("phase") == SNAPSHOT), "r").when(op == INSERT, "c").when(op == UPDATE, "u").otherwise("d")
        source = _object(db=_text(F.col("sourceDatabase")), table=_text(F.col("sourceTable")), ts_ms=number(es), snapshot=F.when(F.col("phase") == SNAPSHOT, F.lit('"true"')))
        value = _object(before=_json(F.col("before")), after=_json(after_image()), op=_text(code), ts_ms=number(es), source=source, transaction=F.lit("null"))
    elif name == "MAXWELL_JSON":
        value = _object(
            database=_text(F.col("sourceDatabase")), table=_text(F.col("sourceTable")), type=_text(F.lower(op)), ts=number(F.floor(es / 1000)), data=_json(row_image()), old=old, primary_key_columns=names,
        )
    else:
        code = F.when(op == INSERT, "I").when(op == UPDATE, "U").otherwise("D")
        at = F.date_format(F.timestamp_millis(es), "yyyy-MM-dd HH:mm:ss.SSSSSS")
        value = _object(
            table=_text(F.concat_ws(".", "sourceDatabase", "sourceTable")), op_type=_text(code), op_ts=_text(at), before=_json(F.col("before")), after=_json(after_image()), primary_keys=names,
        )
    return events.withColumn("value", value)
