"""Everything derived from a set of plays, each table made once and used by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapspan.operators import interactions as ia
from snapspan.plans.sequences import Span
from snapspan.plans.session import cut_lineage
from snapspan.schema import FRAME, PLAY


def derive(men: DataFrame, ball: DataFrame, play_span: Span, player_span: Span, sides: DataFrame | None = None,
           wanted: set[str] | None = None) -> dict[str, DataFrame]:
    """Holders, possession, contact, evasion, view and notes for all plays.

    ``men`` carries club, cdir, co and o_source. With ``sides`` (play, offense, method, confidence)
    a play whose ball column does not follow the ball takes its carrier from the defense.
    Holders (one row per frame) and contacts are read by several tables, so they are written once, unless only
    ``wanted`` tables are asked for and none needs them.
    """
    held = ia.holders(men, ball)
    notes = None
    if sides is not None:
        m = men.join(sides.select(*PLAY, "offense"), PLAY)
        m = m.withColumn("side", F.when(F.col("club") == F.col("offense"), "offense").otherwise("defense"))
        good = ia.ball_usable(m, ball)
        lost = held.select(*PLAY).distinct().join(good.filter("usable").select(*PLAY), PLAY, "left_anti")
        other = ia.inferred_holders(ia.convergence(m.join(lost, PLAY, "left_semi")), held.join(lost, PLAY, "left_semi").select(*FRAME, "t"))
        held = held.join(lost, PLAY, "left_anti").unionByName(other)
        notes = sides.join(good.select(*PLAY, "usable", "held_share"), PLAY, "left").select(*PLAY, F.array_compact(F.array(
            F.when(F.col("confidence") < 0.9, F.concat(F.lit("which team had the ball was inferred by "), "method")),
            F.when(F.coalesce("usable", F.lit(False)), "ball track used").otherwise("possession inferred from defensive convergence"))).alias("notes"))
    if wanted is not None and wanted <= {"notes"}:
        return {} if notes is None else {"notes": notes}
    held = cut_lineage(held)
    if wanted is not None and wanted <= {"holders", "possessions", "notes"}:
        return {"holders": held, "possessions": ia.possession_runs(held, play_span)} | ({} if notes is None else {"notes": notes})
    contacts = cut_lineage(ia.engagements(men, held, play_span))
    out = {"holders": held, "possessions": ia.possession_runs(held, play_span), "contacts": contacts,
           "evades": ia.evades(men, held, contacts, play_span), "views": ia.view_windows(men, ball, player_span)}
    out["timeline"] = ia.interval_timeline(out["possessions"], contacts, out["evades"])
    if notes is not None:
        out["notes"] = notes
    return out
