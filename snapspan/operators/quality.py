"""Scores, checks and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapspan.functions.angles import heading, turn_deg
from snapspan.functions.coding import problem_list
from snapspan.functions.geometry import dist, invert3, project
from snapspan.operators.matching import pct
from snapspan.plans.sequences import Span, shift
from snapspan.schema import CONTRACT_WIDTH, FIELD_LENGTH, FRAME, O_SOURCES, PLAY

MOVING = 1.5


def pair_errors() -> dict:
    """What ``match_frames`` is to tell of a pair for its score."""
    e_dir = F.abs(turn_deg(F.col("t_cdir"), F.col("p_cdir")))
    told = {"e_s": F.abs(F.col("t_s") - F.col("p_s")), "e_dir": e_dir, "e_moving": F.when(F.col("t_s") >= MOVING, e_dir),
            "e_o": F.abs(turn_deg(F.col("t_co"), F.col("p_co"))), "told_o": (F.col("p_o_source") == "measured").cast("double")}
    return {"told": told, "of": (("s", "cdir", "co"), ("s", "cdir", "co", "o_source"))}


def tracking_score(truth: DataFrame, pred: DataFrame, matches: DataFrame, by=PLAY) -> DataFrame:
    """Accuracy of recovered tracks, per play (or per player with ``by``).

    ``matches`` is the frame matching with a ``switch`` flag and, if it was told to, with ``pair_errors``; otherwise it is joined with both tables, which carry s,
    dir and o, the prediction also o_source.
    """
    t = truth.withColumnRenamed("nfl_id", "truth_id")
    p, m = pred, matches
    errors = pair_errors()
    if not set(errors["told"]) <= set(m.columns):
        for rows, end, prefix, cols in ((t, "truth_id", "t_", errors["of"][0]), (p, "pred_id", "p_", errors["of"][1])):
            m = m.join(rows.select(*FRAME, end, *[F.col(c).alias(prefix + c) for c in cols]), [*FRAME, end])
        m = m.withColumns(errors["told"])
    g = m.groupBy(*by).agg(
        F.count(F.lit(1)).alias("matched"), F.percentile(F.round("d", 6), F.array(F.lit(0.5), F.lit(0.95))).alias("_q"), F.sqrt(F.avg(F.col("d") * F.col("d"))).alias("rmse"),
        F.max("d").alias("worst"), F.sum("switch").alias("switches"), F.avg("e_s").alias("speed_mae"), F.avg("e_dir").alias("dir_mae"),
        F.avg("e_moving").alias("dir_mae_moving"), F.avg("e_o").alias("o_mae"), F.avg("told_o").alias("o_measured"))
    g = g.select(*by, "matched", F.col("_q")[0].alias("median"), "rmse", F.col("_q")[1].alias("p95"), *[c for c in g.columns if c not in (*by, "matched", "_q", "rmse")])
    nt = t.groupBy(*by).agg(F.count(F.lit(1)).alias("truth_samples"))
    out = nt.join(g, by, "left")
    if "truth_id" not in by:
        out = out.join(p.groupBy(*by).agg(F.count(F.lit(1)).alias("pred_samples")), by, "left")
    matched = F.coalesce("matched", F.lit(0))
    out = out.withColumns({"matched": matched, "misses": F.col("truth_samples") - matched, "coverage": matched / F.col("truth_samples")})
    if "truth_id" in by:
        return out
    sw = F.coalesce("switches", F.lit(0))
    out = out.withColumns({"false_positives": F.coalesce("pred_samples", F.lit(0)) - F.col("matched"), "switches": sw})
    out = out.withColumn("mota", 1.0 - (F.col("misses") + F.col("false_positives") + F.col("switches")) / F.col("truth_samples"))
    return out.withColumn("passes_bar", F.coalesce((F.col("median") <= 1.0) & (F.col("p95") <= 2.0) & (F.col("switches") <= 5), F.lit(False)))


def angle_conventions(rows: DataFrame, sp: Span, min_speed: float = 2.0, limit: float = 15.0, rate: int = 10) -> DataFrame:
    """Median error of four readings of ``dir`` on moving samples; the best one, and whether it is good enough."""
    r = shift(rows, sp, {"_x": "x", "_y": "y"}, -1)
    dx, dy = F.col("x") - F.col("_x"), F.col("y") - F.col("_y")
    r = r.filter((F.sqrt(dx * dx + dy * dy) * rate > min_speed) & F.col("dir").isNotNull())
    move, d = heading(dx, dy), F.col("dir")
    reads = {"compass_cw_from_y": 90.0 - d, "math_ccw_from_x": d, "compass_cw_from_x": -d, "ccw_from_y": d + 90.0}
    # the errors of a play are sorted as plain arrays, a reading each: rows are neither repeated for the readings nor counted by value
    g = r.groupBy(*PLAY).agg(*[F.sort_array(F.collect_list(F.round(F.abs(turn_deg(move, e)), 6))).alias(n) for n, e in reads.items()])
    half = lambda n: (F.get(n, F.floor((F.size(n) - 1) / 2).cast("int")) + F.get(n, F.floor(F.size(n) / 2).cast("int"))) / 2
    med = g.select(*PLAY, F.explode(F.array(*[F.struct(F.lit(n).alias("reading"), half(n).alias("median_error")) for n in reads])).alias("k")).select(*PLAY, "k.*")
    best = med.groupBy(*PLAY).agg(F.min_by("reading", F.struct("median_error", "reading")).alias("best"), F.min("median_error").alias("best_error"))
    return med.join(best, PLAY).withColumn("ok", F.col("best_error") <= limit)


def validate_plays(rows: DataFrame, roster: DataFrame, frames: DataFrame, sp: Span, ball: DataFrame, events: DataFrame) -> DataFrame:
    """Contract problems per play, as texts. ``frames`` is one row per frame of a play with t.

    A missing sample is a roster member without a row on a frame: counted as
    roster x frames - rows, so no grid is built.
    """
    f = shift(frames, sp, {"_t": "t"}, -1)
    fr = f.groupBy(*PLAY).agg(F.count(F.lit(1)).alias("frames"), F.count_if(F.col("t") <= F.col("_t")).alias("backwards"))
    ro = roster.groupBy(*PLAY).agg(F.count(F.lit(1)).alias("people"))
    good = F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y")
    off = good & ~(F.col("x").between(-5.0, 125.0) & F.col("y").between(-5.0, 58.0))
    bad_o = good & ~F.coalesce((F.col("o") >= 0) & (F.col("o") < 360), F.lit(False))
    bad_s = good & ~F.coalesce(F.col("o_source").isin(*O_SOURCES), F.lit(False))
    sm = rows.groupBy(*PLAY).agg(F.count_if(good).alias("samples"), F.count_if(off).alias("off_field"),
                                 (F.count_if(bad_o) + F.count_if(bad_s)).alias("bad_angles"))
    bl = ball.groupBy(*PLAY).agg(F.count(F.lit(1)).alias("balls"))
    ev = events.filter("event IS NOT NULL").select(*FRAME, "event").distinct().groupBy(*PLAY).agg(
        F.count(F.lit(1)).alias("events"), F.count_if(F.col("event") == "ball_snap").alias("snaps"))
    j = fr.join(ro, PLAY, "full").join(sm, PLAY, "left").join(bl, PLAY, "left").join(ev, PLAY, "left")
    z = lambda c: F.coalesce(c, F.lit(0))
    missing = z("frames") * z("people") - z("samples")
    j = j.withColumns({"missing": missing, "off_field": z("off_field"), "bad_angles": z("bad_angles")})
    say = lambda c, text: F.concat(F.col(c).cast("string"), F.lit(text))
    probs = problem_list(
        (z("frames") == 0, "no frames"), (z("people") == 0, "no roster"),
        (z("backwards") > 0, say("backwards", " frames run backwards")),
        (F.col("missing") > 0, say("missing", " player samples missing position")),
        (F.col("off_field") > 0, say("off_field", " samples outside the field")),
        (F.col("bad_angles") > 0, say("bad_angles", " samples with a bad orientation")),
        (z("balls") == 0, "no ball track"), (z("snaps") == 0, "no ball_snap event"))
    return j.select(*PLAY, "frames", "people", "missing", "off_field", "bad_angles", z("events").alias("events"), probs.alias("problems"))


def provenance(rows: DataFrame) -> DataFrame:
    """Share of samples per facing source, the measured share and a class for the play."""
    g = rows.groupBy(*PLAY, "o_source").agg(F.count(F.lit(1)).alias("n"))
    p = g.groupBy(*PLAY).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("o_source", "n")))).alias("by_source"),
                             F.sum("n").alias("samples"), F.sum(F.when(F.col("o_source") == "measured", F.col("n")).otherwise(0)).alias("measured"))
    share = F.col("measured") / F.col("samples")
    return p.withColumn("measured_share", share).withColumn(
        "source_class", F.when(share == 1, "measured").when(share > 0, "estimated").otherwise("simulated"))


def ball_statistics(ball: DataFrame) -> DataFrame:
    """Frames with a ball, samples by source, measured share and how much field it covered."""
    seen = F.col("x").isNotNull() & ~F.isnan("x")
    spread = lambda c: F.max(F.when(seen, F.col(c))) - F.min(F.when(seen, F.col(c)))
    g = ball.groupBy(*PLAY).agg(
        F.count(F.lit(1)).alias("samples"), F.count_if(seen).alias("positioned"), F.count_if(F.col("source") == "detected").alias("detected"),
        F.count_if(F.col("source") == "coasted").alias("coasted"), F.count_if(F.col("source") == "carrier").alias("carrier"),
        spread("x").alias("_w"), spread("y").alias("_h"))
    return g.withColumns({"measured_share": F.col("detected") / F.col("samples"),
                          "travelled": F.sqrt(F.col("_w") * F.col("_w") + F.col("_h") * F.col("_h"))}).drop("_w", "_h")


def marker_check(markers: DataFrame, keys) -> DataFrame:
    """Median gap between the two drawn lines against the stated distance."""
    g = markers.groupBy(*keys, "stated").agg(
        pct(F.abs(F.col("fd_x") - F.col("los_x")), 0.5).alias("measured"), pct(F.col("scatter"), 0.5).alias("straightness"),
        pct(F.col("los_x"), 0.5).alias("los"), pct(F.col("fd_x"), 0.5).alias("first_down"), F.count(F.lit(1)).alias("frames"))
    gap = F.col("first_down") - F.col("los")
    err = F.col("measured") - F.col("stated")
    return g.withColumns({"error": err, "attacks": F.when(F.abs(gap) < 0.5, None).when(gap > 0, "right").otherwise("left"),
                          "ok": (F.abs(err) <= 0.5) & (F.col("straightness") <= 0.5)})


def registration_check(points: DataFrame, matrices: DataFrame, keys, limit_px: float = 3.0) -> DataFrame:
    """Residuals of clicked points under a matrix (field to image) and what to warn about."""
    j = points.join(matrices, keys)
    j = j.withColumn("_p", project(F.col("h"), F.col("x"), F.col("y"))).withColumn("_f", project(invert3(F.col("h")), F.col("px"), F.col("py")))
    j = j.withColumns({"e_px": dist(F.col("_p.x"), F.col("_p.y"), F.col("px"), F.col("py")), "e_yd": dist(F.col("_f.x"), F.col("_f.y"), F.col("x"), F.col("y"))})
    g = j.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("points"), F.sqrt(F.avg(F.col("e_px") * F.col("e_px"))).alias("rms_px"), F.sqrt(F.avg(F.col("e_yd") * F.col("e_yd"))).alias("rms_yd"),
        pct(F.col("e_yd"), 0.95).alias("p95_yd"), F.count_if(F.col("e_px") <= limit_px).alias("inliers"),
        (F.max("x") - F.min("x")).alias("span_x"), (F.max("y") - F.min("y")).alias("span_y"))
    return g.withColumn("warnings", problem_list(
        (F.col("points") < 6, "few points"), (F.col("span_x") < 10, "narrow downfield span"),
        (F.col("span_y") < 10, "narrow cross-field span"), (F.col("rms_yd") > 0.5, "loose fit")))


def corners_fold(matrices: DataFrame, keys, width: float = CONTRACT_WIDTH) -> DataFrame:
    """Whether the projected field corners are finite and turn the same way all round."""
    xy = [(0.0, 0.0), (FIELD_LENGTH, 0.0), (FIELD_LENGTH, width), (0.0, width)]
    pts = [project(F.col("h"), F.lit(x), F.lit(y)) for x, y in xy]
    m = matrices.withColumn("_c", F.array(*pts))
    turns = []
    for i in range(4):
        a, b, c = F.col("_c")[i], F.col("_c")[(i + 1) % 4], F.col("_c")[(i + 2) % 4]
        turns.append(F.signum((b["x"] - a["x"]) * (c["y"] - b["y"]) - (b["y"] - a["y"]) * (c["x"] - b["x"])))
    finite = ~F.exists("_c", lambda p: F.isnan(p["x"]) | F.isnan(p["y"]))
    return m.select(*keys, finite.alias("finite"), (F.abs(turns[0] + turns[1] + turns[2] + turns[3]) == 4).alias("convex"))


def registration_verdict(rows: DataFrame, problems: str = "problems") -> DataFrame:
    """Trustworthy unless a problem text names a misplaced field."""
    fatal = F.filter(problems, lambda p: p.rlike("(?i)collinear|folded|not enough to fix scale|no registration|self-crossing"))
    return rows.withColumn("fatal", fatal).withColumn("trustworthy", F.size("fatal") == 0)


def round_trip(a: DataFrame, b: DataFrame, keys, straight, angular) -> DataFrame:
    """Largest difference per column between two versions of the same rows, angles the short way."""
    j = a.select(*keys, *[F.col(c).alias(f"a_{c}") for c in (*straight, *angular)]).join(
        b.select(*keys, *[F.col(c).alias(f"b_{c}") for c in (*straight, *angular)]), keys)
    return j.agg(F.count(F.lit(1)).alias("n"), *[F.max(F.abs(F.col(f"a_{c}") - F.col(f"b_{c}"))).alias(f"max_{c}") for c in straight],
                 *[F.max(F.abs(turn_deg(F.col(f"a_{c}"), F.col(f"b_{c}")))).alias(f"max_{c}") for c in angular])


def condition_summary(scores: DataFrame) -> DataFrame:
    """Means (NaN left out), worst case, switches and plays over the bar for each condition."""
    ok = lambda c: F.when(~F.isnan(c), F.col(c))
    return scores.groupBy("condition").agg(
        F.count(F.lit(1)).alias("plays"), F.avg(ok("median")).alias("median"), F.avg(ok("p95")).alias("p95"), F.max(ok("worst")).alias("worst"),
        F.sum("switches").alias("switches"), F.count_if("passes_bar").alias("passing"))


def play_qa(men: DataFrame, ball: DataFrame, sp: Span, principals: DataFrame, cone: float = 45.0, overlap: float = 0.45,
            overlap_share: float = 0.12, view_share: float = 0.25, turn_limit: float = 250.0) -> DataFrame:
    """Per player: ball in the forward cone, bodies overlapping, fastest turn, measured share, what fails."""
    b = ball.select(*FRAME, F.col("x").alias("bx"), F.col("y").alias("by"))
    near = men.select(*FRAME, F.col("nfl_id").alias("o_id"), F.col("x").alias("ox"), F.col("y").alias("oy"))
    m = shift(men, sp, {"_o": "co", "_t": "t"}, -1)
    m = m.join(b, FRAME, "left")
    off = F.abs(turn_deg(F.col("co"), heading(F.col("bx") - F.col("x"), F.col("by") - F.col("y"))))
    m = m.withColumns({"in_view": F.coalesce(off <= cone, F.lit(False)),
                       "rate": F.abs(turn_deg(F.col("_o"), F.col("co"))) / (F.col("t") - F.col("_t"))})
    g = m.groupBy(*PLAY, "nfl_id").agg(F.count(F.lit(1)).alias("frames"), F.avg(F.col("in_view").cast("double")).alias("view_share"),
                                       F.max("rate").alias("max_turn"), F.avg((F.col("o_source") == "measured").cast("double")).alias("measured_share"))
    a = men.select(*FRAME, "nfl_id", "x", "y").join(near, FRAME)
    hits = a.filter((F.col("nfl_id") != F.col("o_id")) & (dist(F.col("x"), F.col("y"), F.col("ox"), F.col("oy")) < overlap))
    hits = hits.groupBy(*PLAY, "nfl_id").agg(F.count(F.lit(1)).alias("hits"))
    g = g.join(hits, [*PLAY, "nfl_id"], "left").withColumn("overlap_share", F.coalesce("hits", F.lit(0)) / F.col("frames")).drop("hits")
    g = g.join(principals.select(*PLAY, "nfl_id").distinct().withColumn("principal", F.lit(True)), [*PLAY, "nfl_id"], "left")
    g = g.withColumn("principal", F.coalesce("principal", F.lit(False)))
    blocked = F.col("overlap_share") > overlap_share
    return g.withColumns({
        "fails": problem_list((F.col("principal") & (F.col("view_share") < view_share), "ball rarely in view"),
                              (F.col("principal") & blocked, "view obstructed"),
                              (F.coalesce(F.col("max_turn") > turn_limit * 1.05, F.lit(False)), "turns too fast")),
        "warnings": problem_list((~F.col("principal") & blocked, "view obstructed"))})


def effective_rate(rows: DataFrame, keys, t: str = "t") -> DataFrame:
    """Samples per second actually returned: (n - 1) / span."""
    span_s = F.max(t) - F.min(t)
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.when(span_s > 0, (F.count(F.lit(1)) - 1) / span_s).alias("rate"))


def churn(rows: DataFrame, keys, frame: str, pid: str) -> DataFrame:
    """Tracks per person: distinct ids over the median number of people on a frame."""
    per = rows.groupBy(*keys, frame).agg(F.count(F.lit(1)).alias("n")).groupBy(*keys).agg(F.percentile("n", F.lit(0.5)).alias("people"))
    ids = rows.select(*keys, pid).distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("tracks"))
    return ids.join(per, keys).withColumn("churn", F.col("tracks") / F.col("people"))


def gate(facts: DataFrame) -> DataFrame:
    """Blockers and notes of a play; it is reviewable when nothing blocks it.

    ``facts`` has trustworthy, side_confidence, line_confidence, attacks, has_ball, travelled,
    measured_share, has_throw, yards_to_go.
    """
    c = F.col
    no = lambda x: F.coalesce(x, F.lit(False))
    held = no(c("has_ball"))
    still = held & no(c("travelled") < 10.0)
    blind = held & ~still & no(c("measured_share") < 0.25)
    base = problem_list(
        (~F.coalesce(c("trustworthy"), F.lit(True)), "registration not trustworthy"),
        (no(c("line_confidence") < 0.5), "front ranks do not look like a snap"),
        (F.coalesce(c("side_confidence"), F.lit(0.0)) <= 0.0, "possession unknown"),
        (~no(c("attacks").isin("left", "right")), "attack direction unknown"),
        (~held, "no ball track"), (still, "ball does not move"), (blind, "ball seldom seen"))
    blockers = F.when((F.size(base) == 0) & ~no(c("has_throw")), F.array(F.lit("no throw found"))).otherwise(base)
    notes = problem_list((no((c("side_confidence") > 0) & (c("side_confidence") < 0.9)), "possession is a guess"),
                         (c("yards_to_go").isNull(), "no distance to go"))
    out = facts.withColumns({"blockers": blockers, "notes": notes})
    return out.withColumn("reviewable", F.size("blockers") == 0)


def outcome_check(reports: DataFrame, rank: str = "tile") -> DataFrame:
    """Incompletion rate of the most against the least disputed quarter."""
    return reports.agg(F.avg(F.when(F.col(rank) == 4, F.col("incomplete"))).alias("top_rate"),
                       F.avg(F.when(F.col(rank) == 1, F.col("incomplete"))).alias("bottom_rate"),
                       F.avg(F.col("flagged").cast("double")).alias("flagged_share"), pct(F.col("advantage"), 0.5).alias("median_advantage"))

