"""Queries that write lines of orders as files of weather stations and read them back. An order has few lines, so no file is large."""

from __future__ import annotations

from pyspark.sql import functions as F

from lapwing.plans.registry import query
from lapwing.sources import stations
from lapwing.sources.results import table

_STATIONS = (("OLD FIELD", 1955, 1994), ("NEW FIELD", 1995, 2100))
_HOURS = """ h AS (SELECT l_orderkey AS file_id, CASE WHEN l_partkey % 13 > 0 THEN l_shipdate + l_linenumber * INTERVAL 1 HOUR END AS hour, CASE WHEN l_partkey % 5 > 1 AND l_orderkey % 10 > 0 THEN l_quantity::DOUBLE END AS temp_c,
  (l_suppkey % 20)::DOUBLE AS dew_point_c, CASE WHEN l_suppkey % 3 > 0 THEN (l_suppkey % 100)::DOUBLE END AS humidity_pct, l_linenumber * 3.5::DOUBLE AS wind_kmh, CASE WHEN l_partkey % 4 > 0 THEN (l_suppkey % 36 * 10)::DOUBLE END AS wind_from_deg FROM lineitem
), kept AS (SELECT * FROM h WHERE hour IS NOT NULL), warm AS (SELECT DISTINCT file_id FROM kept WHERE temp_c IS NOT NULL
), readings AS (SELECT *, NULL::VARCHAR AS problem FROM kept SEMI JOIN warm USING (file_id) UNION ALL SELECT file_id, NULL, NULL, NULL, NULL, NULL, NULL, 'no temperature in the file' FROM (SELECT DISTINCT file_id FROM h) ANTI JOIN warm USING (file_id))"""


def _files(spark, sf_dir):
    """One file an order, all fields in quotes; of each tenth order no line has a temperature."""
    part, supp = F.col("l_partkey"), F.col("l_suppkey")
    text = lambda c: c.cast("string")
    at = F.when(part % 13 > 0, F.date_format(F.col("l_shipdate").cast("timestamp") + F.make_dt_interval(hours=F.col("l_linenumber").cast("int")), "yyyy-MM-dd HH:mm")).otherwise("later")
    temp = F.when((F.col("l_orderkey") % 10 == 0) | (part % 5 == 0), "").when(part % 5 == 1, "M").otherwise(text(F.col("l_quantity").cast("double")))
    cells = [F.lit('say ""x"", y'), at, temp, text(supp % 20), F.when(supp % 3 > 0, text(supp % 100)).otherwise("E"), F.when(part % 4 > 0, text(supp % 36)).otherwise(""), text(F.col("l_linenumber") * F.lit(3.5))]
    line = F.concat(F.lit('"'), F.concat_ws('","', *cells), F.lit('"'))
    head = '"Station, name","Date/Time (LST)","Temp (°C)","Dew Point Temp (°C)","Rel Hum (%)","Wind Dir (10s deg)","Wind Spd (km/h)"\r\n'
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file_id"), line.alias("line")).groupBy("file_id").agg(F.concat(F.lit(head), F.array_join(F.sort_array(F.collect_list("line")), "\r\n"), F.lit("\r\n")).alias("body"))


@query(_HOURS + " SELECT * FROM readings", with_results=False)
def station_readings(spark, sf_dir):
    return stations.readings(_files(spark, sf_dir))


@query(_HOURS + " SELECT CASE WHEN year(hour) <= 1994 THEN 'OLD FIELD' WHEN hour IS NOT NULL THEN 'NEW FIELD' END AS station, count(*) AS rows, count(temp_c) AS temperatures, round(avg(temp_c), 6) AS temp_c FROM readings GROUP BY ALL", with_results=False)
def station_years(spark, sf_dir):
    """What each station has of the readings of its years; files without a temperature by themselves."""
    rows = stations.readings(_files(spark, sf_dir)).withColumn("station", stations.station_in(F.year("hour"), _STATIONS))
    return rows.groupBy("station").agg(F.count("*").alias("rows"), F.count("temp_c").alias("temperatures"), F.round(F.avg("temp_c"), 6).alias("temp_c"))
