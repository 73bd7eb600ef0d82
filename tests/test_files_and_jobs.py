"""Drifting raw files, sinks that can be rerun, and every command line job end to end."""

import csv
import glob
import os
import shutil

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from tripweave import jobs
from tripweave.plans import cleaning, speed, zone_counts
from tripweave.sources import sample_tables, sinks, tripdata, views


def write_as(df, path, name):
    """Write one Parquet file under a given name."""
    df.coalesce(1).write.parquet(f"{path}/{name}")


@pytest.fixture(scope="module")
def mixed_dir(spark, small, raw_dir, tmp_path_factory):
    """The same months, one of them a folder of part files."""
    root = str(tmp_path_factory.mktemp("mixed"))
    for file in glob.glob(f"{raw_dir}/*.parquet"):
        name = os.path.basename(file)
        if name == "yellow_tripdata_2018-04.parquet":
            spark.read.parquet(file).repartition(3).write.parquet(f"{root}/year/{name}")
        else:
            shutil.copy(file, root)
    return root


@pytest.fixture(scope="module")
def raw_dir(spark, small, tmp_path_factory):
    """Monthly files whose column types and columns differ from file to file."""
    root = tmp_path_factory.mktemp("raw")
    wanted = [("yellow", 2018, 3), ("yellow", 2018, 4), ("green", 2018, 3), ("green", 2019, 12),
              ("yellow", 2016, 5)]
    parts = dict(zip(("yellow", "green"), sample_tables.raw_colors(spark, small)))
    for i, (color, year, month) in enumerate(wanted):
        part = parts[color].filter((F.col("file_year") == year) & (F.col("file_month") == month))
        part = part.drop("color", "file_year", "file_month")
        if i % 2:
            part = part.withColumn("passenger_count", F.col("passenger_count").cast("double"))
            part = part.withColumn("payment_type", F.col("payment_type").cast("int"))
        if i == 0:
            part = part.drop("airport_fee").withColumn("congestion_surcharge", F.lit(None).cast("int"))
        write_as(part, str(root), f"{color}_tripdata_{year}-{month:02d}.parquet.dir")
    for folder in glob.glob(f"{root}/*.dir"):
        shutil.copy(glob.glob(f"{folder}/part-*.parquet")[0], folder[: -len(".dir")])
        for file in glob.glob(f"{folder}/*") + glob.glob(f"{folder}/.*"):
            os.remove(file)
        os.rmdir(folder)
    return str(root)


def expected_rows(spark, small, *months):
    raw = tripdata.union_trips(sample_tables.raw_colors(spark, small))
    keep = F.lit(False)
    for color, year, month in months:
        keep = keep | ((F.col("color") == color) & (F.col("file_year") == year)
                       & (F.col("file_month") == month))
    return raw.filter(keep)


IN_WINDOW = [("yellow", 2018, 3), ("yellow", 2018, 4), ("green", 2018, 3), ("green", 2019, 12)]


def test_drifting_files_become_one_table(spark, small, raw_dir):
    got = tripdata.read_trip_files(spark, raw_dir)
    want = expected_rows(spark, small, *IN_WINDOW)
    assert {f.name: f.dataType for f in got.schema} == {f.name: f.dataType for f in want.schema}
    shared = ["color", "file_year", "file_month", "pickup_datetime", "total_amount", "payment_type",
              "passenger_count"]
    assert got.select(shared).exceptAll(want.select(shared)).count() == 0
    assert got.count() == want.count() > 0
    only = tripdata.list_trip_files(spark, raw_dir, colors=["green"], years=[2019])
    assert [path.rsplit("/", 1)[1] for path in only] == ["green_tripdata_2019-12.parquet"]
    with pytest.raises(FileNotFoundError):
        tripdata.read_trip_files(spark, raw_dir, years=[2021])


def test_rerun_replaces_only_its_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(1, 2018, 1), (2, 2018, 2)], "v int, year int, month int")
    sinks.write_table(rows, path, "year", "month")
    sinks.write_table(rows, path, "year", "month")
    assert spark.read.parquet(path).count() == 2
    sinks.write_table(rows.filter("month = 2").withColumn("v", F.lit(9)), path, "year", "month")
    assert sorted(r.v for r in spark.read.parquet(path).collect()) == [1, 9]


def test_registered_tables_answer_sql(spark):
    views.register(rides=spark.range(3), places=spark.range(2))
    assert spark.sql("SELECT count(*) AS n FROM rides JOIN places USING (id)").first().n == 2
    views.register(rides=spark.range(1))
    assert spark.table("rides").count() == 1


def csv_rows(path):
    rows = []
    for name in sorted(glob.glob(f"{path}/**/part-*.csv", recursive=True)):
        with open(name, newline="") as file:
            rows += list(csv.DictReader(file))
    return rows


def test_report_is_one_sorted_file(spark, tmp_path):
    path = str(tmp_path / "r")
    df = spark.range(50).select((F.col("id") * 7 % 50).alias("k"))
    sinks.write_report(df.groupBy("k").count(), path, ["k"])
    assert len(glob.glob(f"{path}/part-*.csv")) == 1
    assert [int(r["k"]) for r in csv_rows(path)] == list(range(50))
    with pytest.raises(Exception, match="ALREADY_EXISTS"):
        sinks.write_report(df, path, mode="errorifexists")


@pytest.fixture(scope="module")
def tables(spark, small, tmp_path_factory):
    """Inputs of the jobs as files: trips, zones, lookup, stops, lots, weather."""
    root = str(tmp_path_factory.mktemp("tables"))
    trips = sample_tables.trips(spark, small)
    trips.write.parquet(f"{root}/trips")
    cleaning.clean_time(sample_tables.raw_colors(spark, small)).write.parquet(f"{root}/time")
    for name, table in (
        ("zones", sample_tables.zones(spark, small)),
        ("lookup", sample_tables.zone_lookup(spark, small)),
        ("stops", sample_tables.bus_stops(spark, small)),
        ("lots", sample_tables.parking_lots(spark, small)),
        ("weather", sample_tables.weather(spark, small)),
    ):
        table.write.option("header", True).csv(f"{root}/{name}")
    return root


def run(job, **options):
    words = [job]
    for name, value in options.items():
        words.append(f"--{name.replace('_', '-')}")
        words += [str(v) for v in (value if isinstance(value, list) else [value])]
    jobs.main(words)


ALL_MONTHS = [*IN_WINDOW, ("yellow", 2016, 5)]
RULES = {
    "general": (IN_WINDOW, cleaning.clean_general),
    "payment": (IN_WINDOW, cleaning.clean_by_payment),
    "time": (IN_WINDOW, cleaning.clean_time),
    "speed": (ALL_MONTHS, lambda parts: cleaning.clean_speed(tripdata.union_trips(parts))),
    "union": (ALL_MONTHS, tripdata.trips_union),
}


@pytest.mark.parametrize("kind", sorted(RULES))
def test_clean_job_is_the_query_over_its_months(spark, small, mixed_dir, tmp_path, kind):
    months, rules = RULES[kind]
    run("clean", raw=mixed_dir, out=tmp_path / kind, kind=kind)
    got = spark.read.parquet(str(tmp_path / kind))
    wanted = F.lit(False)
    for color, year, month in months:
        wanted |= (F.col("color") == color) & (F.col("file_year") == year) & (F.col("file_month") == month)
    want = rules([part.filter(wanted) for part in sample_tables.raw_colors(spark, small)])
    # The partition columns of the table are read back as they are written.
    assert set(want.columns) - set(got.columns) <= {"color", "file_year", "file_month"}
    assert set(got.columns) - set(want.columns) <= {"color", "file_year", "file_month"}
    shared = [c for c in want.columns if c in got.columns and c not in ("airport_fee", "congestion_surcharge")]
    assert got.select(shared).exceptAll(want.select(shared)).count() == 0
    assert got.count() == want.count() > 0
    if kind == "payment":
        assert "congestion_surcharge" in got.columns
        assert got.filter("color = 'green' AND congestion_surcharge IS NOT NULL").count() == 0
        assert got.filter("color = 'yellow' AND congestion_surcharge IS NOT NULL").count() > 0


def test_years_and_colors_are_options(spark, small, mixed_dir, tmp_path):
    run("clean", raw=mixed_dir, out=tmp_path / "a", kind="union", years=[2016, 2019], colors=["yellow"])
    # The year is the file's: some of its trips are picked up in the year before.
    got = spark.read.parquet(str(tmp_path / "a"))
    want = expected_rows(spark, small, ("yellow", 2016, 5)).select(got.columns)
    assert got.count() == want.count() > 0 and got.exceptAll(want).count() == 0
    paths = tripdata.list_trip_files(spark, mixed_dir, years=None)
    assert len(paths) == 5 and all(path.endswith(".parquet") for path in paths)


def test_a_hot_month_is_split_and_small_ones_are_not(spark, tmp_path):
    """A third of all rows in one month: several tasks write it; the other months get a file each."""
    rows = spark.range(300_000, numPartitions=12).select(
        F.when(F.col("id") % 3 == 0, "yellow").otherwise("green").alias("color"),
        F.lit(2018).alias("file_year"),
        F.when(F.col("id") % 3 == 0, 1).otherwise(1 + F.col("id") % 12).cast("int").alias("file_month"),
        F.sha2(F.col("id").cast("string"), 512).alias("body"),
    )
    names = ("color", "file_year", "file_month")
    sizes = {"advisoryPartitionSizeInBytes": "2m", "coalescePartitions.parallelismFirst": "false"}
    for name, value in sizes.items():
        spark.conf.set(f"spark.sql.adaptive.{name}", value)
    try:
        sinks.write_table(rows, str(tmp_path / "table"), *names)
    finally:
        for name in sizes:
            spark.conf.unset(f"spark.sql.adaptive.{name}")
    files = {}
    for path in glob.glob(f"{tmp_path}/table/*/*/*/part-*.parquet"):
        files.setdefault(tuple(path.split("/")[-4:-1]), []).append(path)
    hot = files.pop(("color=yellow", "file_year=2018", "file_month=1"))
    assert len(files) == 8 and len(hot) >= 3
    # Without dealing, each of the twelve tasks would write a file for every month.
    assert all(len(own) <= 3 for own in files.values())
    assert spark.read.parquet(str(tmp_path / "table")).count() == 300_000


def test_time_report_adds_up(spark, tables, tmp_path):
    run("time-report", trips=f"{tables}/time", out=tmp_path)
    trips = spark.read.parquet(f"{tables}/time").count()
    for part in ("year", "month", "weekday", "date", "hour"):
        assert sum(int(r["count"]) for r in csv_rows(tmp_path / part)) == trips
    assert len(csv_rows(tmp_path / "passenger")) == 7
    assert len(glob.glob(f"{tmp_path}/month_by_year/year=*")) == 5


def test_speed_reports(spark, tables, tmp_path):
    run("speed-report", trips=f"{tables}/trips", out=tmp_path / "speed")
    medians = [float(r["median"]) for r in csv_rows(tmp_path / "speed/worst10")]
    rides = cleaning.clean_speed(spark.read.parquet(f"{tables}/trips"))
    assert len(medians) == min(10, rides.select("DOLocationID").distinct().count())
    assert medians == sorted(medians)
    box = csv_rows(tmp_path / "speed/box_plot")
    assert all(float(r["min"]) <= float(r["Q2"]) <= float(r["median"]) <= float(r["Q4"]) for r in box)
    run("flow-report", trips=f"{tables}/trips", out=tmp_path / "flow")
    rides = rides.count()
    for name in ("hour_day_zone_freq", "hour_day_commute_freq", "zone_commute_freq"):
        assert sum(int(r["count"]) for r in csv_rows(tmp_path / "flow" / name)) == rides
    run("borough-report", trips=f"{tables}/trips", zones=f"{tables}/zones", out=tmp_path / "b")
    assert sum(int(r["count"]) for r in csv_rows(tmp_path / "b/borough_count")) == rides


@pytest.mark.parametrize("job", ["time-report", "speed-report", "flow-report", "tips-general", "tips-overview", "tips-location"])
def test_reports_pass_over_the_trips_at_most_twice(spark, tables, tmp_path, monkeypatch, job):
    source = f"{tables}/time" if job == "time-report" else f"{tables}/trips"
    plain, read = tripdata.read_trips, spark.sparkContext.accumulator(0)

    def counted(spark, path):
        frame = plain(spark, path)

        def through(batches):
            for batch in batches:
                read.add(batch.num_rows)
                yield batch

        return frame.mapInArrow(through, frame.schema)

    monkeypatch.setattr(tripdata, "read_trips", counted)
    run(job, trips=source, out=tmp_path)
    assert 0 < read.value <= 2 * plain(spark, source).count()


def test_figures_of_one_aggregate_are_those_of_each_plan(spark, tables):
    rides = cleaning.clean_speed(spark.read.parquet(f"{tables}/trips"))
    report = speed.report_rides(rides)
    figures = speed.chart_figures(report)
    for name, want in (("speed", speed.speed_histogram(rides)), ("minutes", speed.duration_histogram(rides))):
        got = [tuple(r) for r in speed.histogram_of(figures, report, name).orderBy("bin").collect()]
        assert got == [tuple(r) for r in want.select("bin", "bin_start", "bin_end", "count").orderBy("bin").collect()]
    got = {(r.hour, r.weekday): r.average for r in speed.hour_weekday_of(figures).collect()}
    want = {(r.hour, r.weekday): r.average for r in speed.speed_by_hour_weekday(rides).collect()}
    assert got == pytest.approx(want)
    nothing = speed.report_rides(rides.limit(0))
    empty = speed.histogram_of(speed.chart_figures(nothing), nothing, "speed").collect()
    assert len(empty) == 200 and all(r["count"] == 0 and r.bin_start is None for r in empty)


def test_tip_reports(spark, tables, tmp_path):
    run("tips-general", trips=f"{tables}/trips", out=tmp_path / "g")
    run("tips-overview", trips=f"{tables}/trips", out=tmp_path / "o")
    daily = sum(int(r["count"]) for r in csv_rows(tmp_path / "o/daily"))
    buckets = csv_rows(tmp_path / "o/distribution")
    assert daily == sum(int(r["count"]) for r in buckets) > 0
    for year in {r["year"] for r in buckets}:
        shares = [float(r["ratio_of_year"]) for r in buckets if r["year"] == year]
        assert sum(shares) == pytest.approx(1)
    run("tips-location", trips=f"{tables}/trips", out=tmp_path / "l", lookup=f"{tables}/lookup",
        above=20)
    total = {r["locationID"]: int(r["count"]) for r in csv_rows(tmp_path / "l/total")}
    for kind, ratio in (("petty", "petty_ratio"), ("generous", "generous_ratio")):
        for row in csv_rows(tmp_path / "l" / kind):
            assert float(row[ratio]) == pytest.approx(int(row["count"]) / total[row["locationID"]])
    assert len(csv_rows(tmp_path / "l/total_full")) == 26
    assert all(int(r["count"]) > 20 for r in csv_rows(tmp_path / "l/total_above_20"))
    assert len(csv_rows(tmp_path / "l/total_top20")) <= 20


def test_zone_and_facility_jobs(spark, raw_dir, tables, tmp_path):
    run("count-zones", raw=raw_dir, out=tmp_path / "counts")
    counted = zone_counts.counted_rides(tripdata.read_trip_files(spark, raw_dir)).count()
    for name in ("monthly", "color", "season", "year", "total"):
        found = spark.read.parquet(str(tmp_path / "counts" / name))
        assert found.agg(F.sum("trip_count")).first()[0] == 2 * counted
    run("match-facilities", facilities=f"{tables}/stops", zones=f"{tables}/zones", kind="bus",
        cell=1.0, out=tmp_path / "bus")
    assert spark.read.parquet(str(tmp_path / "bus/with_location")).count() == 10
    run("match-facilities", facilities=f"{tables}/lots", zones=f"{tables}/zones", kind="lots",
        cell=0.1, out=tmp_path / "lots")
    run("parking-counterexamples", counts=tmp_path / "counts", lots=tmp_path / "lots",
        zones=f"{tables}/zones", out=tmp_path / "odd")
    assert csv_rows(tmp_path / "odd")


def test_converted_shapes_match_and_broken_ones_are_counted(spark, tables, tmp_path):
    broken = {
        "missing": [None, "  "],
        "empty": ["POINT EMPTY", "POLYGON EMPTY", "MULTIPOLYGON (((0 0, 1 0)))"],
        "unparsable": ["POLYGON ((0 0, 1 0, x 1, 0 0))", "LINESTRING (0 0, 1 1)", "POINT (1 a)", "POLYGON ((0 0, 1 1"],
    }
    rows = [(n, text) for n, text in enumerate(text for own in broken.values() for text in own)]
    odd = spark.createDataFrame(rows, "stop_id long, the_geom string")
    for kind, folder, plain in (("bus", "stops", f"{tables}/stops"), ("lots", "lots", f"{tables}/lots")):
        good = spark.read.option("header", True).csv(plain)
        extra = odd.select(*[F.col(c) if c in ("the_geom",) else F.lit(None).cast("string").alias(c) for c in good.columns])
        sinks.write_report(good.unionByName(extra), str(tmp_path / folder / "csv"))
        run("convert-shapes", csv=tmp_path / folder / "csv", out=tmp_path / folder / "parsed")
        problems = {r["problem"]: int(r["rows"]) for r in csv_rows(tmp_path / folder / "parsed/problems")}
        assert problems == {"none": good.count(), **{name: len(own) for name, own in broken.items()}}
        jobs.main(["match-facilities", "--facilities", str(tmp_path / folder / "parsed"), "--converted", "--kind", kind,
                   "--zones", f"{tables}/zones", "--out", str(tmp_path / folder / "matched")])
        run("match-facilities", facilities=plain, zones=f"{tables}/zones", kind=kind, out=tmp_path / folder / "plain")
        got, want = (spark.read.parquet(str(tmp_path / folder / name / "with_location")) for name in ("matched", "plain"))
        assert got.count() == good.count() + len(rows)
        placed = sorted(str(r.ID) for r in want.collect() if r.ID is not None)
        assert placed and sorted(str(r.ID) for r in got.collect() if r.ID is not None) == placed


def test_weather_and_models(spark, tables, tmp_path):
    run("clean-weather", weather=f"{tables}/weather", out=tmp_path / "w")
    assert set(csv_rows(tmp_path / "w")[0]) == {"date", "tavg", "has_snow", "has_rain"}
    run("flow-report", trips=f"{tables}/trips", out=tmp_path / "flow")
    grid = {"step_sizes": [0.3], "depths": [2, 3], "fraction": 0.5}
    for name, extra in (
        ("plain", {}),
        ("flow", {"flow": tmp_path / "flow/hour_day_zone_freq"}),
        ("weather", {"weather": f"{tables}/weather"}),
    ):
        out = tmp_path / name
        run("train-speed", trips=f"{tables}/trips", zones=f"{tables}/zones", out=out, **grid, **extra)
        points = csv_rows(out / "grid")
        assert len(points) == 2 and all(float(p["rmse"]) > 0 and "r2" in p for p in points)
        for point in points:
            assert PipelineModel.load(f"{out}/models/{point['step_size']}-{point['depth']}").stages
        assert sum(float(r["value"]) for r in csv_rows(out / "importances")) == pytest.approx(1)
        assert PipelineModel.load(str(out / "model")).stages
    for kind in ("regressor", "classifier"):
        out = tmp_path / kind
        run("train-tip", trips=f"{tables}/trips", kind=kind, out=out)
        scores = {r["name"]: float(r["value"]) for r in csv_rows(out / "report") if r["kind"] == "score"}
        assert scores.get("train_rmse", 1) > 0 and 0 <= scores.get("train_f1", 0) <= 1
        saved = PipelineModel.load(str(out / "model"))
        assert "prediction" in saved.transform(spark.read.parquet(f"{tables}/trips")).columns
