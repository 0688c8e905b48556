"""From recovered clips to reviewable plays in one call: roster, sides, line, direction, ball, throw, verdict.

Every stage is one table over all plays, kept by its settings (:class:`snapspan.plans.stages.Stages`). What is missing becomes a blocker or a note of the play, never a guess.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapspan.functions.coding import problem_list
from snapspan.operators.events import ball_flights
from snapspan.operators.roster import apply_merges, consolidate
from snapspan.operators.sides import formation_line, resolve_sides
from snapspan.plans.sequences import Span, span
from snapspan.plans.stages import Stages
from snapspan.schema import CONTRACT_WIDTH, FIELD_LENGTH, FRAME, GOAL_X, PLAY, DuplicateRules, FlightRules


@dataclass(frozen=True)
class Settings:
    """Grouped by the stage that reads them."""

    per_side: int = 11
    min_share: float = 0.18
    duplicates: DuplicateRules = field(default_factory=DuplicateRules)
    line_confidence: float = 0.5
    sure_side: float = 0.9
    min_travel: float = 10.0
    min_measured: float = 0.25
    flight: FlightRules = field(default_factory=FlightRules)
    width: float = CONTRACT_WIDTH


def prepare(samples: DataFrame, ball: DataFrame, clips: DataFrame, stages: Stages, settings: Settings = Settings(), play_span: Span = span(PLAY, "frame_id")) -> dict[str, DataFrame]:
    """``samples`` (turned to +x), ``ball``, ``tracks`` and ``report`` of every play of ``clips``.

    ``samples`` has frame_id, nfl_id, club, x, y, s, dir, o; ``ball`` frame_id, t, x, y; ``clips`` a row a play: snap, trustworthy, render_problems (array), los, attacks,
    yards_to_go, offense (told by somebody who knows), measured_share, travelled; unknown values are null. Without measured_share the ball was seen on no frame.
    """
    s = settings
    roster = stages.keep("roster", [s.per_side, s.min_share, asdict(s.duplicates)], lambda: consolidate(samples, per_side=s.per_side, min_share=s.min_share, rules=s.duplicates)[0])
    men = stages.keep("men", [], lambda: apply_merges(samples, roster))
    sides = stages.keep("sides", [], lambda: resolve_sides(
        men, ball, clips.select(*PLAY, "snap"), told=clips.filter("offense is not null").select(*PLAY, "offense"), lines=clips.filter("los is not null and attacks is not null").select(*PLAY, "los", "attacks")))
    lines = stages.keep("line", [s.line_confidence], lambda: _lines(men, clips, sides, s.line_confidence))
    turned = stages.keep("turned", [s.width], lambda: _turned(men, lines, s.width))
    balls = stages.keep("ball", [s.width], lambda: _turned(ball, lines, s.width, angles=()))
    flights = stages.keep("throw", asdict(s.flight), lambda: ball_flights(balls, play_span, s.flight, clips.select(*PLAY, "measured_share")))
    report = stages.keep("report", [s.sure_side, s.min_travel, s.min_measured], lambda: _report(samples, clips, roster, sides, lines, ball, flights, s))
    return {"samples": turned, "ball": balls, "tracks": roster, "report": report}


def _lines(men: DataFrame, clips: DataFrame, sides: DataFrame, least: float) -> DataFrame:
    """Line and direction of each play: the broadcast's where it has a line, else that of the formation where the sides are known and it looks like a snap."""
    at_snap = men.join(clips.filter("los is null").select(*PLAY, F.col("snap").alias("frame_id")), FRAME)
    at_snap = at_snap.join(sides.filter("confidence > 0").select(*PLAY, "offense"), PLAY).withColumn("side", F.when(F.col("club") == F.col("offense"), "offense").otherwise("defense"))
    seen = formation_line(at_snap).select(*PLAY, F.col("los").alias("f_los"), F.col("attacks").alias("f_attacks"), F.col("gap").alias("gap"), F.col("confidence").alias("f_confidence"))
    d = clips.select(*PLAY, "los", "attacks", "yards_to_go").join(seen, PLAY, "left")
    use = F.col("los").isNull() & (F.coalesce("f_confidence", F.lit(0.0)) >= least)
    source = F.when(F.col("los").isNotNull(), "broadcast").when(use, "formation")
    attacks = F.when(use, F.col("f_attacks")).otherwise(F.col("attacks"))
    left = F.coalesce(attacks == "left", F.lit(False))
    raw = F.when(use, F.col("f_los")).otherwise(F.col("los"))
    los = F.when(left, FIELD_LENGTH - raw).otherwise(raw)
    return d.select(*PLAY, los.alias("line_of_scrimmage"), source.alias("line_source"), attacks.alias("attacks"), left.alias("mirrored"), F.when(F.col("los").isNull(), F.col("f_confidence")).alias("formation_confidence"),
                    F.when(F.col("los").isNull(), F.col("gap")).alias("gap"), "yards_to_go", F.least(los + F.col("yards_to_go"), F.lit(GOAL_X)).alias("first_down_line"))


def _turned(rows: DataFrame, lines: DataFrame, width: float, angles=("dir", "o")) -> DataFrame:
    d = rows.join(lines.select(*PLAY, "mirrored"), PLAY)
    turn = {"x": F.when(F.col("mirrored"), FIELD_LENGTH - F.col("x")).otherwise(F.col("x")), "y": F.when(F.col("mirrored"), width - F.col("y")).otherwise(F.col("y"))}
    turn |= {a: F.when(F.col("mirrored"), F.pmod(F.col(a) + 180.0, F.lit(360.0))).otherwise(F.col(a)) for a in angles if a in rows.columns}
    return d.withColumns(turn)


def _report(samples: DataFrame, clips: DataFrame, roster: DataFrame, sides: DataFrame, lines: DataFrame, ball: DataFrame, flights: DataFrame, s: Settings) -> DataFrame:
    """One row a play of ``clips``; texts say what to do about it."""
    n = lambda k: F.count_if(F.col("status") == k).alias(k)
    tracks = roster.groupBy(*PLAY).agg(F.count(F.lit(1)).alias("tracks"), n("kept"), n("merged"), n("unlabelled"), n("short"), n("surplus"))
    frames = samples.select(*FRAME).distinct().groupBy(*PLAY).agg(F.count(F.lit(1)).alias("frames"))
    seen = ball.filter(F.col("x").isNotNull() & ~F.isnan("x")).select(*FRAME).distinct().groupBy(*PLAY).agg(F.count(F.lit(1)).alias("positioned"))
    d = clips.select(*PLAY, "trustworthy", "render_problems", "measured_share", "travelled").join(lines, PLAY, "left").join(sides, PLAY, "left").join(tracks, PLAY, "left")
    d = d.join(frames, PLAY, "left").join(seen, PLAY, "left").join(flights.select(*PLAY, "verdict", "thrown_at", "arrived_at"), PLAY, "left")
    c, zero = F.col, lambda k: F.coalesce(F.col(k), F.lit(0.0))
    has, sure = F.coalesce(c("positioned"), F.lit(0)) > 0, zero("confidence")
    still = has & (zero("travelled") < s.min_travel)
    blind = has & ~still & (zero("measured_share") < s.min_measured)
    share = lambda k: F.round(100 * zero(k), 0).cast("int")
    blockers = problem_list(
        (~F.coalesce("trustworthy", F.lit(True)), F.concat(F.lit("the registration is not trustworthy, so nothing here is in yards: "), F.array_join(F.slice(F.coalesce("render_problems", F.array().cast("array<string>")), 1, 2), "; "))),
        (F.coalesce(c("formation_confidence") < s.line_confidence, F.lit(False)), F.format_string("the front ranks are %.1f yards apart at the snap frame, which is not a snap", c("gap"))),
        (sure <= 0, "it is not known which side has the ball"), (~F.coalesce(c("attacks").isin("left", "right"), F.lit(False)), "it is not known which way the offense attacks"),
        (~has, "no ball track, so no passer, throw or arrival"), (still, F.format_string("the ball moves %.1f yards in all: something that does not move was tracked", zero("travelled"))),
        (blind, F.format_string("the ball was seen on %d %% of samples, under %d %%", share("measured_share"), F.lit(int(100 * s.min_measured)))))
    no_throw = (F.size(blockers) == 0) & ~F.coalesce(c("verdict") == "pass", F.lit(False))
    blockers = F.when(no_throw, F.array(F.concat(F.lit("no throw in the ball track: "), F.coalesce("verdict", F.lit("no ball"))))).otherwise(blockers)
    notes = problem_list(((sure > 0) & (sure < s.sure_side), F.format_string("possession is a %d %% call (%s); with the sides swapped the whole review is wrong", share("confidence"), c("method"))),
                         (c("yards_to_go").isNull(), "no distance to go is known"))
    d = d.withColumns({"has_ball": has, "ball_coverage": F.coalesce(c("positioned") / c("frames"), F.lit(0.0)), "blockers": blockers, "notes": notes})
    known = sure > 0
    return d.select(*PLAY, F.when(known, c("offense")).alias("offense"), F.when(known, c("defense")).alias("defense"), F.coalesce("method", F.lit("unknown")).alias("method"), sure.alias("confidence"), "line_source", "line_of_scrimmage",
                    "first_down_line", "attacks", F.coalesce("mirrored", F.lit(False)).alias("mirrored"), "tracks", "kept", "merged", "unlabelled", "short", "surplus", "has_ball", "ball_coverage",
                    F.when(F.size("blockers") == 0, c("thrown_at")).alias("thrown_at"), F.when(F.size("blockers") == 0, c("arrived_at")).alias("arrived_at"), "blockers", "notes",
                    (F.size("blockers") == 0).alias("reviewable"))
