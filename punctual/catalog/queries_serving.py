"""Registered serving queries, diagnostics and checks."""

from __future__ import annotations

import uuid
from dataclasses import replace
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from punctual.catalog.queries import AS_OF, CFG, LIVE, START30, Tables, polls, query, samples_once, stored
from punctual.functions.names import clean_headsign, clean_stop_name
from punctual.functions.timeutil import lit_ts, seconds_between
from punctual.operators import diagnostics, history, live, neighbours, quality, routes, timetables, visitors
from punctual.session import shared_folder, shuffles_freed

STOP, ROUTE, NO_DIRECTION = "S44", "R3", "R19"
CHECK_DAY = date(2024, 1, 25)

# --- live ----------------------------------------------------------------------------------

query("q1_live_buses", lambda t: live.live_buses(t, LIVE))
query("q2_live_status_bands", lambda t: live.status_bands(t, LIVE))


def next_two_stops(t: Tables) -> DataFrame:
    """Paths as text: points in order, five digits of a degree."""
    told = lambda c: F.array_join(F.transform(c, lambda p: F.format_string("%.5f %.5f", p["lon"], p["lat"])), ", ")
    return live.next_stops(t, LIVE).withColumn("path1", told("path1")).withColumn("path2", told("path2"))


query("q3_next_two_stops", next_two_stops)
query("q4_coming_up", lambda t: live.coming_up(t, LIVE))
query("q4_coming_up_route", lambda t: live.coming_up(t, LIVE, route_id="R2"))
query("q5_just_left", lambda t: live.just_left(t, LIVE))
query("q6_minute_blocks", lambda t: live.minute_blocks(t, LIVE))
query("q7_stop_buses", lambda t: live.stop_buses(t, LIVE, STOP))
query("q8_coming_history", lambda t: live.coming_history(t, LIVE, STOP))
query("q8_route_now_history", lambda t: live.route_now_history(t, LIVE, "R2"))


def countdown_rows(t: Tables):
    """Stop events predicted within half an hour, as a countdown shows them."""
    due = t["prediction_current"].withColumn("at", live.told()).filter(
        F.col("at").between(lit_ts(LIVE), live.ahead(LIVE, minutes=30)))
    events = t["scheduled_stop_events"].select(
        "trip_id", F.col("service_date").alias("start_date"), "stop_sequence", "route_id", "is_timepoint")
    return due.join(events, live.KEY).select(
        *live.KEY, "route_id", "is_timepoint", (seconds_between(F.col("at"), lit_ts(LIVE)) / 60).alias("minutes"))


query("q9_honest_countdown", lambda t: live.honest_countdown(countdown_rows(t), t, LIVE))
query("q27_feed_state", lambda t: live.feed_state(t, LIVE))
query("q28_current_alerts", lambda t: live.current_alerts(t, AS_OF))
query("q29_latest_messages", live.latest_messages)
query("q29_bus_movement", lambda t: live.bus_movement(t, LIVE))
query("q29_recent_revisions", lambda t: live.recent_revisions(t, LIVE))
query("q29_recently_settled", lambda t: live.recently_settled(t, LIVE))
query("q30_fetch_health", lambda t: live.fetch_health(t, LIVE))
query("q30_five_minute_buckets", lambda t: live.five_minute_buckets(t, LIVE))
query("q30_discarded_polls", lambda t: live.discarded(t, LIVE))
query("q30_table_growth", lambda t: live.growth(t, LIVE))
query("q30_field_fill", lambda t: live.field_fill(t, LIVE))
query("q30_prediction_fill", lambda t: live.prediction_fill(t, LIVE))
query("q30_buses_now", lambda t: live.buses_now(t, LIVE))
query("q36_just_measured", lambda t: live.just_measured(t, LIVE, "R2"))

# --- history -------------------------------------------------------------------------------

query("q10_stops_with_numbers", lambda t: history.stops_with_numbers(t, AS_OF))
query("q11_route_rank", lambda t: history.route_rank(t))
query("q12_prediction_off", lambda t: history.prediction_off(t, START30))
query("q12_prediction_off_at_stop", lambda t: history.prediction_off_by(t, "route_id", START30, where=F.col("stop_id") == STOP))
query("q12_prediction_off_on_route", lambda t: history.prediction_off_by(
    t, "stop_id", START30, "weekday", F.col("route_id") == ROUTE, ["S64", "S65", "S66"]))
query("q13_hourly_by_route", lambda t: history.hourly_by(t, "route_id", START30, "weekday"))
query("q14_scope_lateness", lambda t: history.scope_lateness(t, START30, stop_id=STOP))
query("q14_today_so_far", lambda t: history.today_so_far(t, AS_OF))
query("q15_route_trend", lambda t: history.trend(t, route_id=ROUTE))
query("q16_accuracy_by_hour", lambda t: history.accuracy_by_hour(t, START30, 1, 5))
query("q16_accuracy_by_hour_at_stop", lambda t: history.accuracy_by_hour(t, START30, 1, 5, stop_id=STOP))
query("q17_predictions_vs_timetable", lambda t: history.predictions_vs_timetable(t, "route_id", START30))
query("q17_predictions_vs_timetable_by_stop", lambda t: history.predictions_vs_timetable(
    t, "stop_id", START30, where=F.col("route_id") == ROUTE, min_n=5))
query("q18_stop_report", lambda t: history.stop_report(t, STOP, START30))
query("q19_departures", lambda t: history.departures(t, STOP, START30, cfg=replace(CFG, min_departure_days=2)))
query("q20_nearest_of_all_stops", lambda t: neighbours.nearest(
    t["stops"].filter("location_type = 0").select("feed_version_id", F.col("stop_id").alias("id"), F.col("stop_lon").alias("lon"), F.col("stop_lat").alias("lat")),
    k=8, by=["feed_version_id"]))
query("q20_nearby_stops", lambda t: history.nearby_stops(t, AS_OF, STOP))
query("q21_along_route", lambda t: history.along_route(t, AS_OF, ROUTE, 0, START30))
query("q21_along_route_without_directions", lambda t: history.along_route(t, AS_OF, NO_DIRECTION, None, START30))
query("q31_layer_status", history.layer_status)
query("q31_observed_lately", lambda t: history.observed_lately(t, AS_OF))
query("q32_agreement_summary", lambda t: history.agreement_summary(t, AS_OF))
query("q32_agreement_histogram", lambda t: history.agreement_histogram(t, AS_OF))
query("q32_coverage_week", lambda t: history.coverage_week(t, AS_OF))
query("q33_report_lateness", lambda t: history.report_lateness(t, AS_OF))
query("q33_report_predictions_by_route", lambda t: history.report_predictions(t, AS_OF, by_stop=False))
query("q33_report_predictions_by_stop", lambda t: history.report_predictions(t, AS_OF, by_stop=True))
query("q34_steadiest", lambda t: history.steadiest(t, replace(CFG, min_route_arrivals=50)))
query("q35_destinations", lambda t: history.destinations(t, AS_OF))
query("q35_readable_destinations", lambda t: history.readable_destinations(t, AS_OF))
query("q35_route_shapes", lambda t: history.route_shapes(t, AS_OF, ROUTE))

# --- timetables ----------------------------------------------------------------------------

query("q22_search_by_words", lambda t: timetables.search_stops(t, AS_OF, "OAK avenue 5"))
query("q22_search_by_code", lambda t: timetables.search_stops(t, AS_OF, "0105"))
query("q23_busy_stops", lambda t: timetables.busy_stops(t, AS_OF))
query("q23_busy_stops_scheduled", lambda t: timetables.busy_stops_scheduled(t, AS_OF))
query("q23_stops_by_service", lambda t: timetables.stops_by_service(t, AS_OF))
query("q23_routes_by_service", lambda t: timetables.routes_by_service(t, AS_OF))
query("q23_route_stops", lambda t: timetables.route_stops(t, AS_OF, "R4"))
query("q23_route_stops_numbered", lambda t: timetables.route_stops(t, AS_OF, "R4", 0))
query("q24_representative_days", lambda t: timetables.representative_days(t, AS_OF))
query("q25_stop_timetable", lambda t: timetables.stop_timetable(t, AS_OF, "S86"))
query("q26_route_timetable", lambda t: timetables.route_timetable(t, AS_OF, "R4", 0, "saturday"))

# --- visitors ------------------------------------------------------------------------------

query("q37_visitors_by_day", lambda t: visitors.periods(t, AS_OF, "day", 40))
query("q37_visitors_by_week", lambda t: visitors.periods(t, AS_OF, "week", 8))
query("q37_visitors_by_month", lambda t: visitors.periods(t, AS_OF, "month", 3))
query("q37_totals", lambda t: visitors.totals(t, AS_OF))
query("q37_top_pages", lambda t: visitors.top_pages(t, AS_OF))
query("q37_looked_up", lambda t: visitors.looked_up(t, AS_OF))
query("q37_busiest", visitors.busiest)
query("q37_devices", lambda t: visitors.devices(t, AS_OF))
query("q37_bots", lambda t: visitors.bots(t, AS_OF))
query("q37_load_times", lambda t: visitors.load_times(t, AS_OF))

# --- names ---------------------------------------------------------------------------------

query("p11_stop_names", lambda t: t["stops"].filter("feed_version_id = 5").select("stop_id", clean_stop_name(F.col("stop_name")).alias("shown")))
query("p11_stop_names_all_versions", lambda t: t["stops"].select("feed_version_id", "stop_id", clean_stop_name(F.col("stop_name")).alias("shown")))
query("p11_headsigns", lambda t: t["trips"].join(
    t["routes"].select("feed_version_id", "route_id", "route_short_name"), ["feed_version_id", "route_id"]).groupBy(
    "route_short_name", clean_headsign(F.col("trip_headsign"), F.col("route_short_name")).alias("shown")).agg(F.count(F.lit(1)).alias("trips")))

# --- diagnostics ---------------------------------------------------------------------------

query("d1_schedule_versions", diagnostics.schedule_versions)
query("d1_fetches_per_feed", diagnostics.fetches_per_feed)
query("d1_cadence", lambda t: diagnostics.cadence(t, LIVE, hours=48))
query("d1_discarded_by_hour", diagnostics.discarded_by_hour)
query("d1_positions_lately", lambda t: diagnostics.positions_lately(t, AS_OF))
query("d1_superseded", lambda t: diagnostics.superseded(t, AS_OF))
query("d1_change_frequency", lambda t: diagnostics.change_frequency(t, AS_OF))
query("d1_unmatched_trips", diagnostics.unmatched_trips)
query("d2_poller_health", lambda t: diagnostics.poller_health(t, LIVE))
query("d3_feed_lags", lambda t: diagnostics.feed_lags(t, LIVE))
query("d3_prediction_freshness", lambda t: diagnostics.prediction_freshness(t, LIVE))
query("d3_schedule_match", lambda t: diagnostics.schedule_match(t, LIVE))
query("d4_empty_feed", diagnostics.empty_feed)
query("d5_collection_by_day", diagnostics.collection_by_day)
query("d5_feed_shape", lambda t: diagnostics.feed_shape(t, LIVE))
query("d5_trips_not_in_schedule", lambda t: diagnostics.trips_not_in_schedule(t, LIVE))
query("d6_run_share", lambda t: diagnostics.run_share(t, LIVE))
query("d6_slowest_steps", lambda t: diagnostics.slowest_steps(t, LIVE))
query("d6_full_refresh_time", diagnostics.full_refresh_time)
query("d6_storage_growth", diagnostics.storage_growth)
query("d7_unscored_reasons", lambda t: diagnostics.unscored_reasons(t, AS_OF))
query("d7_missing_trips_by_hour", lambda t: diagnostics.missing_trips_by_hour(t, AS_OF))
query("d7_daily_scores", diagnostics.daily_scores)
query("d8_timepoint_bump", lambda t: diagnostics.timepoint_bump(t, AS_OF, days=30))
query("d8_timepoint_bump_by_source", lambda t: diagnostics.timepoint_bump(t, AS_OF, days=30, by_source=True))
query("d9_predictions_by_timing", lambda t: diagnostics.predictions_by_timing(t, AS_OF))
query("d9_first_stops_and_timepoints", lambda t: diagnostics.first_stops_and_timepoints(t, AS_OF))
query("d10_agreement_by_stop_type", diagnostics.agreement_by_stop_type)
query("d10_agreement_by_route", lambda t: diagnostics.agreement_by_route(t, AS_OF, min_n=5))
query("d10_unplaceable_stops", diagnostics.unplaceable_stops)
query("d10_worst_stops", lambda t: diagnostics.worst_stops(t, AS_OF, min_route=20))
query("d11_calibration_sample", diagnostics.calibration_sample)
query("d11_rows_vs_arrivals", diagnostics.rows_vs_arrivals)
query("d11_values_sent", diagnostics.values_sent)
query("d12_lateness_check", lambda t: diagnostics.lateness_check(t, AS_OF))
query("d12_prediction_check", lambda t: diagnostics.prediction_check(samples_once(t)))
query("d12_prediction_avg_by_route", diagnostics.prediction_avg_by_route)
query("d12_report_card_check", lambda t: diagnostics.report_card_check(samples_once(t), AS_OF))
query("d13_outlier_stops", lambda t: diagnostics.outlier_stops(t, AS_OF))
query("d13_early_by_kind", lambda t: diagnostics.early_by_kind(t, AS_OF))
query("d13_first_stop_departures", lambda t: diagnostics.first_stop_departures(t, AS_OF))
query("d13_first_stop_conditions", lambda t: diagnostics.first_stop_conditions(t, AS_OF))
query("d14_storage_ratio", lambda t: diagnostics.storage_ratio(t, AS_OF))
query("d15_arrival_or_departure", lambda t: diagnostics.arrival_or_departure(t, AS_OF))
query("d15_early_between_timepoints", lambda t: diagnostics.early_between_timepoints(t, AS_OF))
query("d16_predictions_that_lose", lambda t: diagnostics.predictions_that_lose(t, AS_OF))
query("d16_stops_that_lose", lambda t: diagnostics.stops_that_lose(t, AS_OF, min_n=3))
query("d16_one_minute_error", lambda t: diagnostics.one_minute_error(t, min_n=5))
query("d16_calibration_by_stop_type", diagnostics.calibration_by_stop_type)
query("d17_cancelled_trips", lambda t: diagnostics.cancelled_trips(t, LIVE))
query("d17_destination_names", diagnostics.destination_names)
query("d18_honest_countdown_test", lambda t: diagnostics.honest_countdown_test(t, AS_OF))
query("d18_range_rows", diagnostics.range_rows)
query("d19_board_balance", lambda t: diagnostics.board_balance(t, LIVE))
query("d20_loads_during_runs", lambda t: diagnostics.loads_during_runs(t, LIVE))
query("d21_coverage_by_hour", lambda t: diagnostics.coverage_by_hour(t, AS_OF))
query("d22_doubtful_counts", lambda t: diagnostics.doubtful_counts(t, AS_OF))
query("d22_doubtful_list", diagnostics.doubtful_list)
query("d22_rule_comparison", lambda t: diagnostics.doubtful_rule_comparison(t, AS_OF))
query("d23_stop_order_check", lambda t: routes.order_check(t))
query("d24_strips_check", lambda t: diagnostics.strips_check(t, AS_OF))
query("d25_off_shape", diagnostics.off_shape)


def next_stop_check(t: Tables):
    # the window is cut before a bus's newest report is taken: the tables go on after this moment
    buses = live.hinted_stops(live.latest_reports(t, LIVE), t).withColumn("hint_seq", F.col("p1.stop_sequence"))
    trips = t["trips"].filter(F.col("feed_version_id") == live.version_in_force(t, LIVE))
    return diagnostics.next_stop_check(buses, live.next_stops(t, LIVE, buses=buses), trips)


query("d26_next_stop_check", next_stop_check)
query("d27_names_by_rule", lambda t: history.names_by_rule(t, AS_OF).groupBy("rule").agg(
    F.count(F.lit(1)).alias("names"), F.min("shown").alias("example")))

# --- checks --------------------------------------------------------------------------------

query("k1_not_null", lambda t: quality.not_null(t["stop_events"], "status").groupBy("service_date").agg(F.count(F.lit(1)).alias("failures")))
query("k2_unique", lambda t: quality.unique(t["vehicle_position"], ["vehicle_id", "position_timestamp"]))
query("k3_accepted_values", lambda t: quality.accepted_values(t["stop_events"], "status", ("on_time", "late")).groupBy("status").agg(F.count(F.lit(1)).alias("failures")))
query("k4_accepted_range", lambda t: quality.accepted_range(
    t["stop_events"], "uncertainty_s", 0, 120, F.col("service_date") >= F.lit(CHECK_DAY)).select("service_date", "trip_id", "stop_sequence", "uncertainty_s"))
query("k5_scheduled_times_in_order", lambda t: quality.scheduled_times_in_order(t))
query("k6_observed_times_in_order", lambda t: quality.observed_times_in_order(t))
query("k7_filled_times_in_order", lambda t: quality.filled_times_in_order(t))
query("k8_missing_parents", lambda t: quality.missing_parents(t["stop_times"], t["stops"].filter("location_type = 1"), ["feed_version_id", "stop_id"]))
query("k8_missing_stops", lambda t: quality.missing_parents(t["stop_times"], t["stops"], ["feed_version_id", "stop_id"]))
query("k9_freshness", lambda t: quality.freshness(polls(t), AS_OF))


def all_rules(t: Tables) -> DataFrame:
    """The rules of every table, one table after the other, so that the disk holds the shuffles of one at a time. Three
    tables are made from the countdown samples, which are worked out once."""
    t = stored(t, "countdown_samples", t["countdown_samples"])
    folder = f"{shared_folder(t.spark)}/rules-{uuid.uuid4().hex}"
    with shuffles_freed(t.spark):
        for name in quality.RULES:
            quality.summary(t, [name]).write.mode("append").parquet(folder)
    return t.spark.read.schema("tbl string, check string, failures long").parquet(folder)


query("k_all_rules", all_rules)
