"""Static schedule files (CSV in one directory per download) as typed, versioned tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from punctual import schemas
from punctual.plans.files import Files

FILES = {
    "agency": "agency.txt",
    "routes": "routes.txt",
    "stops": "stops.txt",
    "calendar": "calendar.txt",
    "calendar_dates": "calendar_dates.txt",
    "trips": "trips.txt",
    "stop_times": "stop_times.txt",
    "shapes": "shapes.txt",
}
REQUIRED = ("agency.txt", "routes.txt", "stops.txt", "trips.txt", "stop_times.txt")
CALENDARS = ("calendar.txt", "calendar_dates.txt")
WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def schedule_seconds(c: Column) -> Column:
    """"25:10:00" as seconds of the service day: hours may pass 24, blank is null, anything that is
    not three numbers with minutes and seconds below 60 fails the job."""
    text = blank_to_null(c)
    part = F.split(text, ":")
    ok = text.rlike(r"^\s*[+-]?\d+\s*:\s*\d+\s*:\s*\d+\s*$")
    h, m, s = (F.try_element_at(part, F.lit(i)).try_cast("int") for i in (1, 2, 3))
    return (
        F.when(text.isNull(), F.lit(None).cast("int"))
        .when(ok & (m < 60) & (s < 60), (h * 3600 + m * 60 + s).cast("int"))
        .otherwise(F.raise_error(F.concat(F.lit("malformed schedule time "), text)).cast("int"))
    )


def schedule_date(c: Column) -> Column:
    return F.to_date(blank_to_null(c), "yyyyMMdd")


def typed(table: str, raw: DataFrame, fv: int | Column) -> DataFrame:
    """One file's all-text rows as the table's declared types. Columns the file lacks are null,
    apart from the defaults below; header names may carry a byte-order mark or spaces."""
    clean = raw.toDF(*[c.replace("﻿", "").strip() for c in raw.columns])

    def text(name: str) -> Column:
        return F.trim(F.col(name)) if name in clean.columns else F.lit(None).cast("string")

    def required(name: str) -> Column:
        return F.coalesce(text(name), F.lit(""))

    def number(name: str, kind: str = "int") -> Column:
        return blank_to_null(text(name)).cast(kind)

    version = F.lit(fv).cast("int") if not isinstance(fv, Column) else fv.cast("int")
    special = {
        "feed_version_id": lambda: version,
        "agency_id": lambda: F.coalesce(text("agency_id"), F.lit("")),
        "location_type": lambda: F.coalesce(number("location_type"), F.lit(0)),
        "arrival_seconds": lambda: schedule_seconds(text("arrival_time")),
        "departure_seconds": lambda: schedule_seconds(text("departure_time")),
        **{d: (lambda d=d: F.coalesce(text(d) == "1", F.lit(False))) for d in WEEKDAYS},
    }
    keys = {
        "agency": ("agency_name", "agency_timezone"),
        "routes": ("route_id",),
        "stops": ("stop_id", "stop_name"),
        "calendar": ("service_id",),
        "calendar_dates": ("service_id",),
        "trips": ("trip_id", "route_id", "service_id"),
        "stop_times": ("trip_id", "stop_id"),
        "shapes": ("shape_id",),
    }[table]
    out = []
    for field in schemas.SCHEDULE[table]:
        kind = field.dataType.simpleString()
        if field.name in special:
            value = special[field.name]()
        elif field.name in keys:
            value = required(field.name)
        elif kind == "date":
            value = schedule_date(text(field.name))
        elif kind == "string":
            value = blank_to_null(text(field.name))
        else:
            value = number(field.name, kind)
        out.append(value.cast(field.dataType).alias(field.name))
    return clean.select(*out)


def read_gtfs(spark: SparkSession, folder: str, fv: int) -> dict[str, DataFrame]:
    """Every schedule table present in an unzipped download, stamped with its version."""
    names = file_names(spark, folder)
    check_complete(names)
    return {
        table: typed(table, _csv(spark, folder, name, table in QUOTED), fv)
        for table, name in FILES.items()
        if name in names
    }


# small tables whose free text may hold line breaks; the others have none and can be split
QUOTED = ("agency", "routes", "stops", "feed_info")


def _csv(spark: SparkSession, folder: str, name: str, lines_in_quotes: bool = False) -> DataFrame:
    return spark.read.csv(
        f"{folder.rstrip('/')}/{name}", header=True, inferSchema=False, quote='"', escape='"', multiLine=lines_in_quotes
    )


def file_names(spark: SparkSession, folder: str) -> set[str]:
    """The files in a download: a handful of names. A large one may be a folder of parts."""
    return {n for n in Files(spark, folder).names(folder) if n.endswith(".txt")}


def check_complete(names: set[str]) -> None:
    missing = sorted(set(REQUIRED) - names)
    if missing:
        raise FileNotFoundError(f"schedule download lacks {missing}")
    if not names & set(CALENDARS):
        raise FileNotFoundError("schedule download has neither of the calendar files")


def feed_info(raw: DataFrame) -> DataFrame:
    """Start, end and label of a download from feed_info (its only row)."""
    clean = raw.toDF(*[c.replace("﻿", "").strip() for c in raw.columns])
    have = lambda c: F.col(c) if c in clean.columns else F.lit(None).cast("string")
    return clean.limit(1).select(
        schedule_date(have("feed_start_date")).alias("feed_start_date"),
        schedule_date(have("feed_end_date")).alias("feed_end_date"),
        blank_to_null(have("feed_version")).alias("feed_version"),
    )


def downloads(spark: SparkSession, pattern: str) -> DataFrame:
    """Archived downloads with their content hash: (source_url, sha256, byte_size)."""
    return spark.read.format("binaryFile").load(pattern).select(
        F.col("path").alias("source_url"),
        F.sha2("content", 256).alias("sha256"),
        F.col("length").alias("byte_size"),
    )


def new_versions(candidates: DataFrame, known: DataFrame, first_id: int | Column = 1) -> DataFrame:
    """Downloads whose bytes are not a version yet, one row per distinct content, numbered from
    ``first_id`` in download order. There are a few of these a year."""
    from pyspark.sql import Window

    fresh = (
        candidates.join(known.select("sha256").distinct(), "sha256", "left_anti")
        .groupBy("sha256")
        .agg(F.min(F.struct("downloaded_at", "source_url", "byte_size")).alias("d"))
        .select("sha256", "d.*")
    )
    start = F.lit(first_id) if not isinstance(first_id, Column) else first_id
    order = F.row_number().over(Window.orderBy("downloaded_at", "sha256"))
    return fresh.withColumn("feed_version_id", (start + order - 1).cast("int"))


def append_version(tables: dict[str, DataFrame], root: str) -> None:
    """Add one version's rows to the stored tables, one partition per version. Rewriting only that
    partition makes a retried append harmless."""
    for name, df in tables.items():
        (
            df.write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("feed_version_id")
            .parquet(f"{root.rstrip('/')}/{name}")
        )
