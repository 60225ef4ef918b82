"""Files of weather stations against their printed lines."""

from datetime import datetime

from lapwing.sources import stations


def test_readings(spark):
    head = '﻿"Longitude (x)","Station, name","Date/Time (LST)","Temp (°C)","Temp Flag","Dew Point Temp (°C)","Rel Hum (%)","Wind Dir (10s deg)","Wind Spd (km/h)"\n'
    body = head + '"1","A, ""B""","2024-06-02 07:00","11.5","","9","80","33","20"\r\n' + "1,A,2024-06-02 08:00,M,,-3.5,,,\n" + '"1","A","June 2","5","","","","",""\n\n'
    files = spark.createDataFrame([("a", body, 0), ("b", head + '"1","A","2024-06-02 07:00","","M","","","",""\n', 1), ("c", None, 2), ("d", "", 3), ("e", "Temp (C),Date/Time\n4,2024-01-01 00:00:00", 4)], "file_id string, body string, temp_c int")
    got = sorted((tuple(r) for r in stations.readings(files).collect()), key=str)
    assert got == sorted([
        ("a", datetime(2024, 6, 2, 7), 11.5, 9.0, 80.0, 20.0, 330.0, None),
        ("a", datetime(2024, 6, 2, 8), None, -3.5, None, None, None, None),
        ("b", None, None, None, None, None, None, "no temperature in the file"),
        ("d", None, None, None, None, None, None, "no temperature in the file"),
        ("e", datetime(2024, 1, 1), 4.0, None, None, None, None, None),
    ], key=str)
    assert stations.readings(files.limit(0)).count() == 0
