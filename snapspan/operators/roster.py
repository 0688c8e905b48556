"""Turning many tracks into two sides of eleven: duplicates, fragments, strays, votes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from snapspan.operators.pairs import duplicate_pairs, track_frames
from snapspan.plans.choice import refused
from snapspan.plans.folds import small_groups
from snapspan.plans.ranking import global_rank
from snapspan.plans.session import cut_lineage
from snapspan.schema import CONTRACT_WIDTH, PLAY, DuplicateRules, StitchRules


def roster_of(rows: DataFrame, pid: str = "nfl_id", frame: str = "frame_id", cols=("club", "position", "jersey")) -> DataFrame:
    """One row per player of a play: what his first row says."""
    men = rows.filter(F.col(pid).isNotNull())
    g = men.groupBy(*PLAY, pid).agg(F.min_by(F.struct(*cols), frame).alias("_r"))
    return g.select(*PLAY, pid, "_r.*")


def majority(votes: DataFrame, keys, value: str, at: str) -> DataFrame:
    """Most frequent value of each key; a tie goes to the value seen first."""
    n = votes.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"), F.min(at).alias("_at"))
    return n.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("_n"), "_at", value)).alias(value))


def fold_duplicates(pairs: DataFrame, lives: DataFrame, pid: str) -> DataFrame:
    """loser -> winner, longest-lived track first; one row per surviving merge.

    ``pairs`` is already one row per pair; merges that share a track wait for each other in rounds.
    """
    a = lives.select(*PLAY, F.col(pid).alias("a"), F.col("life").alias("la"))
    b = lives.select(*PLAY, F.col(pid).alias("b"), F.col("life").alias("lb"))
    p = pairs.select(*PLAY, "a", "b").join(a, [*PLAY, "a"]).join(b, [*PLAY, "b"])
    first = (F.col("la") > F.col("lb")) | ((F.col("la") == F.col("lb")) & (F.col("a") < F.col("b")))
    p = p.select(*PLAY, F.when(first, F.col("a")).otherwise(F.col("b")).alias("winner"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("loser"),
                 (-F.greatest("la", "lb")).alias("o1"), (-F.least("la", "lb")).alias("o2"))

    # a merge rules out the later ones that its loser takes part in
    order = F.struct("o1", "winner", "o2", "loser")
    p = cut_lineage(p.withColumn("order", order))
    ends = p.select(*PLAY, F.col("order").alias("after"), F.explode(F.array("winner", "loser")).alias("loser"))
    clash = p.select(*PLAY, F.col("order").alias("before"), "loser").join(ends, [*PLAY, "loser"]).filter(F.col("before") < F.col("after"))
    node = lambda c: F.struct(*PLAY, F.col(c).alias("order"))
    lost = refused(clash.select(node("before").alias("before"), node("after").alias("after")))
    return p.join(lost.select("node.*"), [*PLAY, "order"], "left_anti").select(*PLAY, "loser", "winner")


def consolidate(samples: DataFrame, pid: str = "nfl_id", team: str = "club", per_side: int = 11, min_share: float = 0.18,
                rules: DuplicateRules = DuplicateRules()) -> tuple[DataFrame, DataFrame]:
    """(status per track, report per play): two main teams, no strays, duplicates folded, eleven a side.

    The samples are read twice, for the tracks (a row each, written) and for the pairs; all else is worked out on tracks.
    """
    own = cut_lineage(track_frames(samples, pid, team))
    lives = own.groupBy(*PLAY, pid).agg(F.sum("n").alias("life"), F.min_by(team, "first").alias(team))
    seen = own.select(*PLAY, F.explode("frames").alias("f")).distinct().groupBy(*PLAY).agg(F.count(F.lit(1)).alias("seen"))
    unnumbered = own.groupBy(*PLAY).agg(F.max((F.col("n") > F.size("frames")).cast("int")).alias("more"))  # samples without a frame count as one
    frames = unnumbered.join(seen, PLAY, "left").select(*PLAY, (F.coalesce("seen", F.lit(0)) + F.col("more")).alias("frames"))
    sizes = lives.groupBy(*PLAY, team).agg(F.sum("life").alias("n"))
    by_size = Window.partitionBy(*PLAY).orderBy(F.desc("n"), team)
    main = sizes.withColumn("_r", F.row_number().over(by_size)).filter("_r <= 2").select(*PLAY, team, F.lit(True).alias("main"))
    t = lives.join(main, [*PLAY, team], "left").join(frames, PLAY)
    need = F.greatest(F.lit(2), F.bround(min_share * F.col("frames"), 0).cast("int"))
    t = t.withColumn("status", F.when(F.col("main").isNull(), "unlabelled").when(F.col("life") < need, "short"))
    alive = t.filter("status IS NULL")
    pairs = duplicate_pairs(samples, pid, team, rules.yards, rules.share, rules.min_shared, tracks=own)
    merges = fold_duplicates(pairs, alive, pid)
    t = t.join(merges.select(*PLAY, F.col("loser").alias(pid), "winner"), [*PLAY, pid], "left")
    t = t.withColumn("status", F.when(F.col("status").isNull() & F.col("winner").isNotNull(), "merged").otherwise(F.col("status")))
    rank = Window.partitionBy(*PLAY, team, F.col("status").isNull()).orderBy(F.desc("life"), pid)
    t = t.withColumn("_r", F.row_number().over(rank))
    t = t.withColumn("status", F.when(F.col("status").isNotNull(), F.col("status")).when(F.col("_r") > per_side, "surplus").otherwise("kept"))
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    report = t.groupBy(*PLAY).agg(F.count(F.lit(1)).alias("before"), n("kept"), n("merged"), n("unlabelled"), n("short"), n("surplus"),
                                  F.avg(F.when(F.col("status") == "kept", F.col("life") / F.col("frames"))).alias("coverage"))
    return t.drop("_r", "main", "frames"), report


def apply_merges(samples: DataFrame, tracks: DataFrame, pid: str = "nfl_id") -> DataFrame:
    """Samples under their surviving track; an absorbed one only fills a frame the survivor lacks."""
    who = tracks.filter(F.col("status").isin("kept", "merged")).select(*PLAY, pid, F.coalesce("winner", pid).alias("_to"), F.col("winner").isNotNull().alias("_late"))
    who = who.join(tracks.filter("status = 'kept'").select(*PLAY, F.col(pid).alias("_to")), [*PLAY, "_to"], "left_semi")
    # the tracks of a partition are looked up in a table, so the samples are sorted only once, for the choice
    s = samples.join(who.hint("shuffle_hash"), [*PLAY, pid])
    first = F.row_number().over(Window.partitionBy(*PLAY, "frame_id", "_to").orderBy("_late", pid))
    s = s.withColumn("_k", first).filter("_k = 1")
    rest = [c for c in samples.columns if c not in (*PLAY, "frame_id", pid)]
    return s.select(*PLAY, "frame_id", F.col("_to").alias(pid), *rest)


def track_ends(samples: DataFrame, pid: str, steps: int = 3, t: str = "t") -> DataFrame:
    """Start and tail of every track. The tail is a bounded number of samples."""
    last = Window.partitionBy(*PLAY, pid).orderBy(F.desc(t))
    tail = samples.withColumn("_k", F.row_number().over(last)).filter(F.col("_k") <= steps + 1)
    tail = tail.groupBy(*PLAY, pid).agg(F.array_sort(F.collect_list(F.struct(t, "x", "y"))).alias("tail"))
    head = samples.groupBy(*PLAY, pid).agg(F.count(F.lit(1)).alias("n"), F.min(t).alias("t0"), F.min_by("x", t).alias("x0"), F.min_by("y", t).alias("y0"))
    return head.join(tail, [*PLAY, pid]).filter("n >= 2")


def stitch_candidates(ends: DataFrame, pid: str, rules: StitchRules = StitchRules()) -> DataFrame:
    """Pairs where b starts soon after a ends, near where a was heading.

    Ends are put on buckets one maximal gap wide, so the range join is an equi join.
    """
    g = rules.max_gap
    z = F.try_element_at("tail", F.lit(-1))
    e = ends.withColumns({"_t1": z["t"], "_x1": z["x"], "_y1": z["y"]})
    n = F.least(F.lit(rules.steps), F.size("tail") - 1)
    old = F.element_at("tail", F.size("tail") - n)
    dt = F.greatest(F.col("_t1") - old["t"], F.lit(1e-6))
    e = e.withColumns({"_vx": (F.col("_x1") - old["x"]) / dt, "_vy": (F.col("_y1") - old["y"]) / dt})
    v = F.sqrt(F.col("_vx") * F.col("_vx") + F.col("_vy") * F.col("_vy"))
    scale = F.when(v > rules.max_speed, rules.max_speed / v).otherwise(1.0)
    a = e.select(*PLAY, F.col(pid).alias("a"), "_t1", "_x1", "_y1", (F.col("_vx") * scale).alias("_vx"), (F.col("_vy") * scale).alias("_vy"),
                 F.explode(F.array(F.floor(F.col("_t1") / g), F.floor(F.col("_t1") / g) + 1)).alias("_b"))
    b = ends.select(*PLAY, F.col(pid).alias("b"), "t0", "x0", "y0", F.floor(F.col("t0") / g).alias("_b"))
    j = a.join(b, [*PLAY, "_b"]).withColumn("gap", F.round(F.col("t0") - F.col("_t1"), 6))
    j = j.filter((F.col("gap") > 0) & (F.col("gap") <= g) & (F.col("a") != F.col("b")))
    mx = F.col("x0") - F.col("_x1") - F.col("_vx") * F.col("gap")
    my = F.col("y0") - F.col("_y1") - F.col("_vy") * F.col("gap")
    far = F.sqrt(F.pow(F.col("x0") - F.col("_x1"), 2) + F.pow(F.col("y0") - F.col("_y1"), 2)) / F.col("gap")
    j = j.withColumns({"miss": F.sqrt(mx * mx + my * my), "need": far})
    return j.filter((F.col("miss") <= rules.gate) & (F.col("need") <= rules.max_speed)).select(*PLAY, "a", "b", "gap", "miss", "need")


def _motion(tail: list[tuple], rules: StitchRules) -> tuple[float, float]:
    """Where a tail is heading, a second on, at no more than the fastest speed."""
    (t1, x1, y1), (t0, x0, y0) = tail[-1], tail[-1 - min(rules.steps, len(tail) - 1)]
    dt = max(t1 - t0, 1e-6)
    vx, vy = (x1 - x0) / dt, (y1 - y0) / dt
    speed = float(np.hypot(vx, vy))
    scale = rules.max_speed / speed if speed > rules.max_speed else 1.0
    return vx * scale, vy * scale


def _folded(ends: list[tuple], rules: StitchRules) -> list[tuple]:
    """(kept, part, miss) of the ends (id, t0, x0, y0, tail) of a play in the order of their starts; each chain's motion is worked out when it grows, not for each pair."""
    live: dict = {}
    out = []
    for part, t0, x0, y0, tail in ends:
        best, best_miss = None, np.inf
        for k, (hist, (t1, x1, y1), vx, vy) in live.items():
            gap = round(t0 - t1, 6)
            if not 0 < gap <= rules.max_gap:
                continue
            dx, dy = x0 - x1, y0 - y1
            miss = float(np.hypot(dx - vx * gap, dy - vy * gap))
            if miss <= rules.gate and float(np.hypot(dx, dy)) / gap <= rules.max_speed and miss < best_miss:
                best, best_miss = k, miss
        if best is not None:
            tail = (live[best][0] + tail)[-(rules.steps + 1):]
            out.append((best, part, best_miss))
        live[part if best is None else best] = (tail, tail[-1], *_motion(tail, rules))
    return out


def stitch(ends: DataFrame, pid: str, rules: StitchRules = StitchRules()) -> DataFrame:
    """part -> kept: chains of fragments folded into their first, earliest start first.

    One row per track goes in (its start and a bounded tail), never its samples.
    """
    kind = ends.schema[pid].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        tails = ([*zip(*(np.asarray(c).tolist() for c in tail))] for tail in zip(pdf["_t"], pdf["_x"], pdf["_y"]))
        ends = zip(*(pdf[c].tolist() for c in (pid, "t0", "x0", "y0")), tails)
        out = [(*pdf[PLAY].iloc[0], *row) for row in _folded(sorted(ends, key=lambda e: (e[1], e[0])), rules)]
        return pd.DataFrame(out, columns=[*PLAY, "kept", "part", "miss"])

    # tails go as plain arrays: a struct becomes a Python object of its own
    plain = ends.select(*PLAY, pid, "t0", "x0", "y0", *[F.col(f"tail.{c}").alias(f"_{c}") for c in ("t", "x", "y")])
    return small_groups(plain, PLAY, run, schema=f"game_id bigint, play_id bigint, kept {kind}, part {kind}, miss double")


def static_furniture(samples: DataFrame, pid: str, still: float = 1.0, band: float = 2.0, width: float = CONTRACT_WIDTH) -> DataFrame:
    """Tracks that stand on a sideline and never move."""
    g = samples.groupBy(*PLAY, pid).agg(F.count(F.lit(1)).alias("n"), (F.max("x") - F.min("x")).alias("w"), (F.max("y") - F.min("y")).alias("h"),
                                        F.min("y").alias("low"), F.max("y").alias("high"))
    moved = F.sqrt(F.col("w") * F.col("w") + F.col("h") * F.col("h"))
    edge = F.least(F.col("low"), width - F.col("high"))
    return g.filter((F.col("n") >= 2) & (moved <= still) & (edge <= band)).select(*PLAY, pid)


def sideline_cuts(points: DataFrame, keys, frame: str, margin: float = 3.0, min_crowd: float = 2.0, width: float = CONTRACT_WIDTH) -> DataFrame:
    """The emptiest one-yard band near each sideline that has a crowd beyond it.

    Points are counted into the few candidate bands by one aggregation; no point meets another.
    """
    steps = [-8.5 + i for i in range(int(margin + 8.5 + 0.01) + 1)]
    sides = [("low", 0.0, -1), ("high", width, 1)]
    aggs = [F.count(F.lit(1)).alias("_n")]
    for name, edge, out in sides:
        for i, s in enumerate(steps):
            c = edge + out * s
            aggs.append(F.count_if((F.col("y") >= c - 0.5) & (F.col("y") < c + 0.5)).alias(f"_d_{name}_{i}"))
            aggs.append(F.count_if(F.col("y") >= c if out > 0 else F.col("y") <= c).alias(f"_b_{name}_{i}"))
    g = points.groupBy(*keys).agg(*aggs)
    n = points.select(*keys, frame).distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("_frames"))
    g = g.join(n, keys)
    cols = {}
    for name, edge, out in sides:
        cand = F.array(*[F.when(F.col(f"_b_{name}_{i}") / F.col("_frames") >= min_crowd,
                                F.struct(F.col(f"_d_{name}_{i}").alias("d"), F.lit(-out * (edge + out * s)).alias("o"), F.lit(edge + out * s).alias("c")))
                         for i, s in enumerate(steps)])
        cols[f"cut_{name}"] = F.coalesce(F.array_min(F.array_compact(cand))["c"], F.lit(edge + out * margin))
    return g.select(*keys, *[v.alias(k) for k, v in cols.items()])


def static_candidates(points: DataFrame, keys, frame: str, radius: float = 1.5, min_frames: int = 8) -> DataFrame:
    """Spots where ball candidates stand still, as greedy clusters per clip.

    A keyed band join finds the points with neighbours on enough frames; only those and the
    points round them reach the greedy pass, the rest of a clip never leaves the JVM.
    """
    p = points.withColumn("_id", F.struct(frame, "x", "y"))
    wide = 5 * radius
    a = p.select(*keys, "_id", frame, "x", "y", F.floor(F.col("x") / wide).alias("_s"))
    b = p.select(*keys, F.col(frame).alias("_f"), F.col("x").alias("_x"), F.col("y").alias("_y"),
                 F.explode(F.sequence(F.floor((F.col("x") - radius) / wide), F.floor((F.col("x") + radius) / wide))).alias("_s"))
    close = F.sqrt(F.pow(F.col("x") - F.col("_x"), 2) + F.pow(F.col("y") - F.col("_y"), 2)) <= radius
    near = a.join(b, [*keys, "_s"]).filter(close).select(*keys, "_id", "_f").distinct()
    seeds = near.groupBy(*keys, "_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_frames)
    seeds = seeds.select(*keys, F.col("_id.x").alias("sx"), F.col("_id.y").alias("sy"), F.floor(F.col("_id.x") / wide).alias("_s")).distinct()
    c = p.select(*keys, frame, "x", "y", F.explode(F.sequence(F.floor((F.col("x") - radius) / wide), F.floor((F.col("x") + radius) / wide))).alias("_s"))
    touched = c.join(seeds, [*keys, "_s"]).filter(F.sqrt(F.pow(F.col("x") - F.col("sx"), 2) + F.pow(F.col("y") - F.col("sy"), 2)) <= radius)
    touched = touched.select(*keys, frame, "x", "y").distinct()

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([frame, "x", "y"])
        xy, fr = pdf[["x", "y"]].to_numpy(), pdf[frame].to_numpy()
        free = np.ones(len(xy), dtype=bool)
        out = []
        for i in range(len(xy)):
            if not free[i]:
                continue
            m = free & (np.hypot(*(xy - xy[i]).T) <= radius)
            if len(set(fr[m])) >= min_frames:
                free &= ~m
                out.append({**{k: pdf[k].iloc[0] for k in keys}, "cx": xy[m, 0].mean(), "cy": xy[m, 1].mean()})
        return pd.DataFrame(out, columns=[*keys, "cx", "cy"])

    schema = ", ".join([f"{k} {points.schema[k].dataType.simpleString()}" for k in keys] + ["cx double", "cy double"])
    return small_groups(touched, list(keys), greedy, schema)


def hold_out(rows: DataFrame, clip: str, share: float = 0.2) -> DataFrame:
    """The last clips in sorted order are validation: round(share x clips), at least one.

    Clips are ranked over the whole table in buckets, so no task sorts them all; ``clip`` is a number.
    """
    clips = global_rank(rows.select(clip).distinct(), clip, clip, total="_clips")
    held = F.greatest(F.lit(1), F.bround(F.lit(share) * F.col("_clips"), 0).cast("bigint"))
    split = F.when(F.col("rank") > F.col("_clips") - held, "val").otherwise("train")
    return rows.join(clips.select(clip, split.alias("split")), clip)


def kit_clusters(colours: DataFrame, keys, clip=PLAY, k: int = 3) -> DataFrame:
    """Median colour per track, clustered within its clip; clusters named by size.

    A clip of fewer tracks has fewer clusters. Of equally large clusters the darker one is named first. ``separation`` is the distance
    of the two teams, null where there is one. The tracks of one clip are some dozens of rows, clustered many clips to a batch.
    """
    med = colours.groupBy(*keys).agg(*[F.percentile(c, F.lit(0.5)).alias(c) for c in ("l", "a", "b")], F.count(F.lit(1)).alias("samples"))

    def name(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["l", "a", "b"], kind="stable")
        x = pdf[["l", "a", "b"]].to_numpy()
        most = min(k, len(np.unique(x, axis=0)))
        groups = [[i] for i in range(len(x))]
        while len(groups) > most:  # join the two groups whose union spreads least more
            centres, n = np.array([x[g].mean(axis=0) for g in groups]), np.array([len(g) for g in groups])
            cost = ((centres[:, None] - centres[None]) ** 2).sum(axis=2) * (n[:, None] * n[None]) / (n[:, None] + n[None])
            cost[np.tril_indices(len(n))] = np.inf
            i, j = np.unravel_index(cost.argmin(), cost.shape)
            groups[i] += groups.pop(j)
        own = np.empty(len(x), int)
        for c, g in enumerate(groups):
            own[g] = c
        centres = np.array([x[g].mean(axis=0) for g in groups])
        ranked = sorted(range(len(centres)), key=lambda c: (-(own == c).sum(), tuple(centres[c])))
        kits = {c: ("teamA", "teamB")[r] if r < 2 else "other" for r, c in enumerate(ranked)}
        gap = float(np.linalg.norm(centres[ranked[0]] - centres[ranked[1]])) if len(ranked) > 1 else None
        return pdf.assign(kit=[kits[c] for c in own], separation=gap)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in med.schema) + ", kit string, separation double"
    return small_groups(med, list(clip), name, schema)
