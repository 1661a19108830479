"""Every tunable value of the pipeline, in one place."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    timezone: str = "America/Los_Angeles"
    # lateness bands, seconds against the timetable
    early_s: int = 60
    late_s: int = 300
    very_late_s: int = 600
    # how much history a full build covers
    lookback_days: int = 120
    # service this frequent is judged by evenness, not by the timetable
    frequent_headway_s: int = 1200
    bunched_below: float = 0.5
    gapped_above: float = 1.5
    # an arrival outside this window is a wrong trip id, not a late bus
    plausible_early_s: int = 1800
    plausible_late_s: int = 5400
    max_uncertainty_s: int = 120
    # geometry, metres
    off_route_m: float = 100.0
    stop_usable_m: float = 60.0
    walk_back_m: float = 100.0
    walk_reach_m: float = 300.0
    walk_speed_mps: float = 40.0
    pass_tolerance_m: float = 25.0
    next_stop_clearance_m: float = 25.0
    # stops whose own time is out of line with both neighbours
    doubtful_days: int = 30
    doubtful_min_trips: int = 20
    doubtful_spike_s: int = 120
    # fixed values: names of the two ways an arrival is timed, and of a time the feed predicted
    source_feed: str = "LTD"
    source_gps: str = "gps"
    source_agency: str = "ltd_departure"
    # which predictions count as having been on the sign
    prediction_slack_s: int = 60
    prediction_max_ahead_s: int = 5400
    countdown_max_min: int = 15
    calibration_max_min: int = 60
    honest_max_min: int = 30
    honest_min_n: int = 50
    # feed health
    feed_gap_s: int = 120
    due_after_s: int = 7200
    feed_stopped_s: int = 600
    # service day rollover, hours after local midnight
    rollover_hours: int = 3
    stale_prediction_days: int = 2
    # boards
    board_all_min: int = 3
    board_route_min: int = 15
    left_rule_s: int = 20
    fresh_s: int = 180
    just_left_s: int = 360
    # how many arrivals a number needs before it is shown
    min_typical: int = 5
    min_range: int = 10
    min_report: int = 20
    min_departure_days: int = 5
    min_route_arrivals: int = 500
    trend_max_points: int = 120
    # chunk widths for splitting long ordered groups, seconds
    chunk_s: int = 3600
    feed_chunk_s: int = 86400


DEFAULT = Config()
