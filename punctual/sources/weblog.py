"""The web server's access log and the site's own page views."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from punctual import schemas
from punctual.config import DEFAULT, Config
from punctual.functions.timeutil import as_utc, lit_ts, local_day

# fixed values: agents that are not people (the page-view form and the access-log form)
BOT_AGENTS = r"(?i)bot|crawl|spider|slurp|headless|lighthouse|preview|monitor|python|curl|wget"
LOG_BOT_AGENTS = BOT_AGENTS + "|scan"
# fixed values: requests that are parts of a page
PAGE_PARTS = r"^/(_stcore|static|media|component|favicon|robots|\.well-known)|\.\w+$"
REPORTS = "/reports"


def access_log(lines: DataFrame, as_of: datetime, days: int = 30, cfg: Config = DEFAULT) -> DataFrame:
    """Pages people opened: (seen_at, day, path, is_report, referrer). Lines that are not such an
    object are skipped."""
    r = F.from_json("value", schemas.ACCESS_LOG_DDL, {"mode": "PERMISSIVE"})
    agent = F.get(F.col("r.request.headers.`User-Agent`"), F.lit(0))
    referer = F.get(F.col("r.request.headers.Referer"), F.lit(0))
    path = F.regexp_extract(F.col("r.request.uri"), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    bare = lambda host: F.regexp_replace(F.lower(host), r"^www\.", "")
    host = F.try_parse_url(referer, F.lit("HOST"))
    return (
        lines.select(r.alias("r"))
        .filter(F.col("r.ts").isNotNull() & F.col("r.request").isNotNull())
        .select(
            F.timestamp_micros(F.round(F.col("r.ts") * 1_000_000).cast("long")).alias("seen_at"),
            F.when(path == "", "/").otherwise(path).alias("path"),
            F.col("r.request.method").alias("method"),
            F.col("r.status").alias("status"),
            agent.alias("agent"),
            bare(host).alias("from_host"),
            F.regexp_replace(F.coalesce("r.request.host", F.lit("")), r"^www\.", "").alias("own_host"),
        )
        .filter(
            (F.col("seen_at") >= lit_ts(as_utc(as_of) - timedelta(days=days)))
            & (F.col("method") == "GET")
            & F.col("status").isin(200, 304)
            & ~F.col("path").rlike(PAGE_PARTS)
            & (F.coalesce("agent", F.lit("")) != "")
            & ~F.col("agent").rlike(LOG_BOT_AGENTS)
        )
        .select(
            "seen_at",
            local_day(F.col("seen_at"), cfg.timezone).alias("day"),
            "path",
            F.col("path").startswith(REPORTS).alias("is_report"),
            F.when(F.col("from_host") != F.col("own_host"), F.nullif("from_host", F.lit(""))).alias("referrer"),
        )
    )


def access_counts(log: DataFrame) -> DataFrame:
    """(kind, item, n): sites that sent people, pages they landed on, report pages, report views
    per day. One pass over the log."""
    return (
        log.select(
            F.explode(
                F.array_compact(
                    F.array(
                        F.struct(F.lit("landing").alias("kind"), F.col("path").alias("item")),
                        F.when(
                            F.col("referrer").isNotNull(),
                            F.struct(F.lit("source").alias("kind"), F.col("referrer").alias("item")),
                        ),
                        F.when(
                            F.col("is_report"),
                            F.struct(F.lit("report_page").alias("kind"), F.col("path").alias("item")),
                        ),
                        F.when(
                            F.col("is_report"),
                            F.struct(
                                F.lit("report_day").alias("kind"), F.col("day").cast("string").alias("item")
                            ),
                        ),
                    )
                )
            ).alias("x")
        )
        .groupBy("x.kind", "x.item")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def device(agent: Column) -> Column:
    return (
        F.when(agent.rlike(BOT_AGENTS), "bot")
        .when(agent.contains("Mobi") | agent.contains("Android"), "phone")
        .otherwise("computer")
    )


def page_views(hits: DataFrame, salts: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Page views with the visitor's code for the day: the browser's address and type mixed with
    that day's random value. ``hits``: viewed_at, session_id, page, detail, load_ms, ip, agent."""
    day = local_day(F.col("viewed_at"), cfg.timezone)
    return (
        hits.filter(F.coalesce("agent", F.lit("")) != "")
        .withColumn("day", day)
        .join(salts, "day", "inner")
        .select(
            "viewed_at",
            "session_id",
            "page",
            "detail",
            device(F.col("agent")).alias("device"),
            "load_ms",
            F.left(
                F.md5(F.concat(F.col("salt"), F.coalesce("ip", F.lit("")), F.lit("|"), F.col("agent"))),
                F.lit(16),
            ).alias("visitor"),
        )
    )


def kept_salts(salts: DataFrame, as_of: datetime, cfg: Config = DEFAULT) -> DataFrame:
    """Yesterday's random values are forgotten, so yesterday's codes can never be made again."""
    from punctual.functions.timeutil import local_date

    return salts.filter(F.col("day") >= F.lit(local_date(as_of, cfg.timezone)))
