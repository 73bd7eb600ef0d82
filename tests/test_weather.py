from tripweave.plans.weather import daily_weather
from tripweave.sources.lookups import read_weather

HEADER = "date,tmax,tmin,tavg,departure,HDD,CDD,precipitation,new_snow,snow_depth\n"
# The first two lines are published readings and what they become.
LINES = [
    ("1/1/19,60,40,50,13.9,15,0,0.08,0,0", ("2019-01-01", 10.0, 0, 1)),
    ("2/1/19,41,35,38,2.1,27,0,0,0,0", ("2019-01-02", 3.333333333333333, 0, 0)),
    ("15/12/19,41,35,32,2.1,27,0,T,T,T", ("2019-12-15", 0.0, 0, 0)),
    ("16/12/19,41,35,32,2.1,27,0,0,1.5,0", ("2019-12-16", 0.0, 1, 0)),
    ("17/12/19,41,35,32,2.1,27,0,T,0,3", ("2019-12-17", 0.0, 1, 0)),
]


def test_readings_with_byte_order_mark(spark, tmp_path):
    path = tmp_path / "weather.csv"
    path.write_text("﻿" + HEADER + "\n".join(line for line, _ in LINES) + "\n", encoding="utf-8")
    found = daily_weather(read_weather(spark, str(path))).orderBy("date").collect()
    assert [(str(r.date), r.tavg, r.has_snow, r.has_rain) for r in found] == [w for _, w in LINES]


def test_a_year_of_readings(spark, tmp_path):
    """365 days: values by a rule in the test, not by the code under test."""
    import datetime

    days = [datetime.date(2019, 1, 1) + datetime.timedelta(n) for n in range(365)]
    lines, want = [], []
    for n, day in enumerate(days):
        rain = "T" if n % 7 == 0 else "0.25" if n % 5 == 0 else "0"
        snow = "1.5" if n % 11 == 0 else "T" if n % 4 == 0 else "0"
        depth = "2" if n % 17 == 0 else "0"
        lines.append(f"{day.day}/{day.month}/{day:%y},90,10,{20 + n % 70},0,0,0,{rain},{snow},{depth}")
        has_snow = int(n % 11 == 0 or n % 17 == 0)
        want.append((str(day), (20 + n % 70 - 32) / 1.8, has_snow, int(n % 7 != 0 and n % 5 == 0)))
    path = tmp_path / "year.csv"
    path.write_text(HEADER + "\n".join(lines) + "\n", encoding="utf-8")
    found = daily_weather(read_weather(spark, str(path))).orderBy("date").collect()
    assert [(str(r.date), r.has_snow, r.has_rain) for r in found] == [(d, s, r) for d, _, s, r in want]
    assert all(abs(r.tavg - t) < 1e-9 for r, (_, t, _, _) in zip(found, want))
