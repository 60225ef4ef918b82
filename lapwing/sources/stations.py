"""Hourly readings of weather stations from delimited files, one of a station and month each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# How the columns that are read begin; whatever follows, such as a unit, may be written in any way.
BEGINNINGS = {"hour": "date/time", "temp_c": "temp (", "dew_point_c": "dew point temp (", "humidity_pct": "rel hum", "wind_kmh": "wind spd", "wind_tens": "wind dir"}


def fields(line: Column) -> Column:
    """The fields of a line; those in quotes may hold commas and doubled quotes."""
    found = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(r',("(?:[^"]|"")*"|[^,]*)'), F.lit(1))
    return F.transform(found, lambda x: F.trim(F.when(x.startswith('"'), F.regexp_replace(F.regexp_replace(x, '^"|"$', ""), '""', '"')).otherwise(x)))


def station_in(year: Column, stations: tuple[tuple[str, int, int], ...]) -> Column:
    """The first station (name, first year, last year) that reports in a year; null if none does."""
    return F.coalesce(*[F.when(year.between(first, last), name) for name, first, last in stations], F.lit(None).cast("string"))


def readings(files: DataFrame) -> DataFrame:
    """``file_id, hour, temp_c, dew_point_c, humidity_pct, wind_kmh, wind_from_deg, problem`` of each line of the files (file_id, body).

    ``hour`` is the printed hour. A value that is no number, such as a flag, is
    null; a line without an hour is left out. A file without any temperature, as
    a station outside its years sends, is one row with a ``problem`` instead of
    blank hours; a null file gives none.
    """
    lines = F.split(F.regexp_replace("body", r"\r\n?", "\n"), "\n")
    read = files.where("body is not null").select("file_id", lines.alias("lines"))
    heads = read.select("file_id", "lines", F.transform(fields(F.element_at("lines", 1)), lambda h: F.lower(h)).alias("heads"))
    place = lambda start: F.array_position(F.transform("heads", lambda h: h.startswith(start)), True).cast("int")
    # Places are found once a file, below the explode; a column that the file doesn't have is at place 0, before the first field.
    places = [place(start).alias(f"_{name}") for name, start in BEGINNINGS.items()]
    rows = heads.select("file_id", *places, F.explode_outer(F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(0)))).alias("line"))
    value = lambda name: F.get("cells", F.col(f"_{name}") - 1)
    stamp = F.substring(value("hour"), 1, 16)
    rows = rows.withColumn("cells", fields(F.col("line"))).select(
        "file_id", F.when(stamp.rlike(r"^\d{4}-\d\d-\d\d \d\d:\d\d$"), F.try_to_timestamp(stamp, F.lit("yyyy-MM-dd HH:mm"))).alias("hour"),
        *[value(name).try_cast("double").alias(name) for name in ("temp_c", "dew_point_c", "humidity_pct", "wind_kmh")],
        (value("wind_tens").try_cast("double") * 10).alias("wind_from_deg"),
    )
    usable = F.col("hour").isNotNull() & F.col("temp_c").isNotNull()
    rows = rows.withColumns({"some": F.max(usable).over(Window.partitionBy("file_id")), "turn": F.row_number().over(Window.partitionBy("file_id").orderBy("hour"))})
    kept = rows.where((F.col("some") & F.col("hour").isNotNull()) | (~F.col("some") & (F.col("turn") == 1)))
    return kept.select("file_id", *[F.when(F.col("some"), F.col(c)).alias(c) for c in ("hour", "temp_c", "dew_point_c", "humidity_pct", "wind_kmh", "wind_from_deg")], F.when(~F.col("some"), "no temperature in the file").alias("problem"))
