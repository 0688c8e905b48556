"""Field constants, thresholds and declared schemas.

All values here are fixed: they have to equal the published rules for results to agree.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

PLAY = ["game_id", "play_id"]
FRAME = ["game_id", "play_id", "frame_id"]

FIELD_LENGTH = 120.0
CONTRACT_WIDTH = 53.3
EXPORT_WIDTH = 160.0 / 3.0
GOAL_X = 110.0
RATE = 10

# Fixed value lists.
CONTRACT_EVENTS = [
    "ball_snap", "handoff", "lateral", "pass_forward", "pass_arrived",
    "pass_outcome_caught", "tackle", "touchdown", "out_of_bounds",
]
SNAP_NAMES = ["ball_snap", "autoevent_ballsnap", "snap_direct"]
THROW_NAMES = ["pass_forward", "pass_shovel"]
ARRIVAL_PRIORITY = [
    "pass_arrived", "pass_outcome_caught", "pass_tipped",
    "pass_outcome_incomplete", "pass_outcome_interception",
]
O_SOURCES = ["measured", "from_dir", "from_velocity", "assumed", "authored"]
ELIGIBLE_POSITIONS = ["WR", "TE", "RB", "FB"]
LINE_POSITIONS = ["T", "G", "C", "OL", "OT", "OG"]
POSITION_GROUPS = {
    "QB": 0, "RB": 1, "FB": 1, "WR": 2, "TE": 3, "T": 4, "G": 4, "C": 4,
    "DE": 5, "DT": 5, "NT": 5, "OLB": 6, "ILB": 6, "MLB": 6, "LB": 6,
    "CB": 7, "DB": 7, "SS": 8, "FS": 8,
}
ROLE_CODES = {
    "Passer": 0, "Targeted Receiver": 1, "Other Route Runner": 2, "Defensive Coverage": 3,
}
PASS_PROBABILITIES = {
    "consider_alternative": {"target_was_reasonable": 0.25, "consider_alternative": 0.75},
    "target_was_reasonable": {"target_was_reasonable": 0.72, "consider_alternative": 0.28},
    "suggest_run_play": {"pass": 0.2, "run": 0.8},
    "suggest_punt": {"pass": 0.1, "run": 0.2, "punt": 0.7},
}
FORECAST_FEATURES = [
    "x_rel", "y_mid", "s", "a", "vx", "vy", "ox", "oy",
    "dx5", "dy5", "dx10", "dy10", "cv_dx", "cv_dy", "h",
    "offense", "route", "pos", "opp_dx", "opp_dy", "opp_dist",
]

# Release column spellings, best first (fixed values).
ALIASES = {
    "game_id": ["gameId", "game_id", "gameKey", "game_key"],
    "play_id": ["playId", "play_id", "playID"],
    "game_play": ["game_play"],
    "player_id": ["nflId", "nfl_player_id", "nflID", "nfl_id", "player_id", "player"],
    "display_name": ["displayName", "display_name", "player_name"],
    "jersey": ["jerseyNumber", "jersey_number", "jersey"],
    "position": ["position", "officialPosition", "player_position"],
    "team": ["team", "club", "teamAbbr", "team_abbr", "player_side"],
    "frame": ["frame.id", "frameId", "frame_id", "step", "frame"],
    "time": ["time", "datetime", "timestamp"],
    "x": ["x"],
    "y": ["y"],
    "s": ["s", "speed"],
    "a": ["a", "acceleration"],
    "dis": ["dis", "distance"],
    "dir": ["dir", "direction"],
    "o": ["o", "orientation"],
    "event": ["event"],
    "play_direction": ["playDirection", "play_direction"],
    "role": ["player_role", "role"],
    "ball_land_x": ["ball_land_x"],
    "ball_land_y": ["ball_land_y"],
    "yardline": ["absolute_yardline_number", "yardlineNumber", "yardline_number"],
    "frames_output": ["num_frames_output"],
}
REQUIRED_COLUMNS = ["player_id", "frame", "x", "y"]


@dataclass(frozen=True)
class ContactRules:
    """Yards, yards per second and 10 Hz frames."""

    enter: float = 1.5
    stay: float = 2.2
    grace_frames: int = 4       # first whole frame at or beyond 0.35 s
    min_frames: int = 2         # 0.2 s
    block_frames: int = 6       # 0.6 s
    down_speed: float = 1.4
    tackle_drop: float = 1.5


@dataclass(frozen=True)
class PossessionRules:
    reach: float = 1.6
    held_share: float = 0.75
    offense_share: float = 0.85


@dataclass(frozen=True)
class EvadeRules:
    radius: float = 3.5
    turn_deg: float = 25.0
    reach_frames: int = 5
    behind: float = 0.5


@dataclass(frozen=True)
class ViewRules:
    cone_deg: float = 100.0
    min_frames: int = 2


@dataclass(frozen=True)
class FlightRules:
    speed: float = 13.0
    min_seconds: float = 0.3
    min_yards: float = 6.0
    measured_share: float = 0.25


@dataclass(frozen=True)
class ReviewRules:
    open_yards: float = 3.0
    advantage_yards: float = 5.0
    full_roster: int = 22


@dataclass(frozen=True)
class DuplicateRules:
    yards: float = 0.9
    share: float = 0.6
    min_shared: int = 4


@dataclass(frozen=True)
class StitchRules:
    max_gap: float = 1.2
    gate: float = 3.5
    max_speed: float = 11.0
    steps: int = 3


TRACKING_SCHEMA = T.StructType([
    T.StructField("game_id", T.LongType()),
    T.StructField("play_id", T.LongType()),
    T.StructField("frame_id", T.IntegerType()),
    T.StructField("nfl_id", T.LongType()),
    T.StructField("club", T.StringType()),
    T.StructField("position", T.StringType()),
    T.StructField("play_direction", T.StringType()),
    T.StructField("event", T.StringType()),
    T.StructField("x", T.DoubleType()),
    T.StructField("y", T.DoubleType()),
    T.StructField("s", T.DoubleType()),
    T.StructField("a", T.DoubleType()),
    T.StructField("dir", T.DoubleType()),
    T.StructField("o", T.DoubleType()),
])
