"""Payloads exported by BI tools, one payload per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: A field of delimited text (1) and what ends it (2). A quoted one may hold separators and line breaks, its quotes doubled;
#: text behind its closing quote belongs to it, and without a closing quote it runs to the end. Every repeat is possessive.
_FIELD = r'(?<![^,\r\n])("(?:[^"]|"")*+(?:"[^,\r\n]*+|\z)|[^,\r\n]*+)(,|\r\n|\n|\r|\z)'
_QUOTED = r'(?s)^"((?:[^"]|"")*+)"?(.*)$'


def parse_export(
    df: DataFrame, body_col: str, format: str, schema: StructType | str, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Rows of every payload, typed by ``schema``, next to the ``keep`` columns.

    ``csv`` payloads carry a header line, and columns are matched to it by name, the last of equal names. Blank lines are no
    records, missing fields are null, surplus ones are dropped. ``json`` payloads are a list of
    objects, an object with a ``data`` list, or a single object. Both are expressions: no payload leaves the engine.
    """
    struct = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    body = F.col(body_col)
    if format == "json":
        ddl = struct.simpleString()
        rows = F.when(F.ltrim(body).startswith("["), F.from_json(body, f"array<{ddl}>")).otherwise(
            F.coalesce(F.from_json(F.get_json_object(body, "$.data"), f"array<{ddl}>"), F.array(F.from_json(body, ddl)))
        )
        return df.select(*keep, F.explode(rows).alias("row")).select(*keep, "row.*")
    if format == "csv":
        names = [f"__k{i}" for i in range(len(keep))]
        cut = df.select(*[F.col(k).alias(n) for k, n in zip(keep, names, strict=True)], *_cut(body))
        places = F.transform("__ends", lambda end, i: F.when(end != ",", i))
        cut = cut.withColumn("__last", F.filter(places, lambda i: i.isNotNull())).withColumn("__records", _records())
        rows = cut.select(*names, F.get("__records", F.lit(0)).alias("__header"), F.explode(F.slice("__records", 2, F.greatest(F.size("__records") - 1, F.lit(0)))).alias("__row"))
        header = F.transform("__header", _plain)
        places = [F.size("__header") - F.array_position(F.reverse(header), f.name) for f in struct.fields]
        known = rows.select(*names, "__row", *[F.when(F.array_contains(header, f.name), place).alias(f"__p{i}") for i, (f, place) in enumerate(zip(struct.fields, places, strict=True))])
        cells = [_plain(F.get("__row", F.col(f"__p{i}").cast("int"))).try_cast(f.dataType).alias(f.name) for i, f in enumerate(struct.fields)]
        return known.select(*[F.col(n).alias(k) for k, n in zip(keep, names, strict=True)], *cells)
    raise ValueError(f"unknown export format {format!r}")


def _cut(body: Column) -> list[Column]:
    """All fields of a payload as they stand, and what ends each."""
    return [F.regexp_extract_all(body, F.lit(_FIELD), F.lit(group)).alias(name) for group, name in ((1, "__fields"), (2, "__ends"))]


def _records() -> Column:
    """The fields between one line end and the next, without blank lines; ``__last`` holds the place of each line's last field."""

    def record(end: Column, place: Column) -> Column:
        begin = F.when(place == 0, F.lit(0)).otherwise(F.get("__last", place - 1) + 1)
        return F.slice("__fields", begin + 1, end - begin + 1)

    return F.filter(F.transform("__last", record), lambda r: (F.size(r) > 1) | (F.get(r, F.lit(0)) != ""))


def _plain(field: Column) -> Column:
    """What a field says: without its outer quotes, doubled quotes made single."""
    inner, rest = (F.regexp_extract(field, _QUOTED, group) for group in (1, 2))
    return F.when(field.startswith('"'), F.concat(F.replace(inner, F.lit('""'), F.lit('"')), rest)).otherwise(field)
