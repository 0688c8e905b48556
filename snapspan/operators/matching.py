"""One-to-one matching inside a frame.

Candidates come from keyed joins. A pair whose two ends have no other candidate is decided
by counts; the contested rest splits into connected components, solved batch by batch.
"""

from __future__ import annotations

from functools import cache
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegralType

from snapspan.functions.geometry import box_gap, dist
from snapspan.operators.pairs import _strip, _strips
from snapspan.plans.folds import kept_of_groups, small_groups

FAR = 1.0e6


def least_cost(cost: np.ndarray) -> list[tuple[int, int]]:
    """Row, column pairs of the cheapest full assignment, by shortest augmenting paths."""
    flipped = cost.shape[0] > cost.shape[1]
    c = cost.T if flipped else cost
    rows, cols = c.shape
    price_row, price_col = np.zeros(rows), np.zeros(cols)
    owner = np.full(cols, -1)
    for r in range(rows):
        reach = c[r] - price_row[r] - price_col
        came = np.full(cols, -1)
        done = np.zeros(cols, dtype=bool)
        base, at = 0.0, -1
        while True:
            open_cols = np.where(~done)[0]
            nxt = open_cols[np.argmin(reach[open_cols])]
            base = reach[nxt]
            done[nxt] = True
            if owner[nxt] < 0:
                at = nxt
                break
            i = owner[nxt]
            via = base + c[i] - price_row[i] - price_col
            better = ~done & (via < reach)
            reach[better], came[better] = via[better], nxt
        price_row[r] += base
        for j in np.where(done)[0]:
            if j != at:
                price_row[owner[j]] += base - reach[j]
            price_col[j] -= base - reach[j]
        while came[at] >= 0:
            owner[at] = owner[came[at]]
            at = came[at]
        owner[at] = r
    pairs = [(int(owner[j]), j) for j in range(cols) if owner[j] >= 0]
    return [(j, i) for i, j in pairs] if flipped else pairs


def linked(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Component label of every left and every right end; ends are numbered from 0 on each side."""
    at_left = np.arange(left.max() + 1)
    at_right = np.full(right.max() + 1, len(at_left))
    while True:
        np.minimum.at(at_right, right, at_left[left])
        before = at_left.copy()
        np.minimum.at(at_left, left, at_right[right])
        if np.array_equal(before, at_left):
            return at_left, at_right


@cache
def _ways(rows: int, cols: int) -> np.ndarray:
    """All ways to deal each row a column of its own, in order."""
    return np.array(list(permutations(range(cols), rows)))


def _all_small(grids: np.ndarray) -> np.ndarray:
    """The column of each row in the cheapest way through each grid of few ways, with no more rows than columns; of equally cheap ways the first."""
    ways = _ways(*grids.shape[1:])
    total = sum(grids[:, i, ways[:, i]] for i in range(grids.shape[1]))
    return ways[total.argmin(axis=1)]


def _all_least(grids: np.ndarray) -> np.ndarray:
    """The column of each row as ``least_cost`` finds it, for all grids at once: the best of few ways where no other comes near, step by step where ways tie or are many."""
    if grids.shape[2] > 4:
        return _steps(grids)
    ways = _ways(*grids.shape[1:])
    total = sum(grids[:, i, ways[:, i]] for i in range(grids.shape[1]))
    to = ways[total.argmin(axis=1)]
    tied = np.flatnonzero((total <= total.min(axis=1)[:, None] + 1e-6).sum(axis=1) > 1)
    if len(tied):
        to[tied] = _steps(grids[tied])
    return to


def _steps(grids: np.ndarray) -> np.ndarray:
    """``least_cost`` step by step for all grids at once, which have no more rows than columns."""
    n, rows, cols = grids.shape
    each = np.arange(n)
    price_row, price_col, owner = np.zeros((n, rows)), np.zeros((n, cols)), np.full((n, cols), -1)
    for r in range(rows):
        reach = grids[:, r] - price_row[:, r, None] - price_col
        came, done = np.full((n, cols), -1), np.zeros((n, cols), bool)
        base, at, open_ = np.zeros(n), np.full(n, -1), each
        while len(open_):
            nxt = np.where(done[open_], np.inf, reach[open_]).argmin(axis=1)
            base[open_] = reach[open_, nxt]
            done[open_, nxt] = True
            i = owner[open_, nxt]
            at[open_[i < 0]] = nxt[i < 0]
            open_, nxt, i = open_[i >= 0], nxt[i >= 0], i[i >= 0]
            via = base[open_, None] + grids[open_, i] - price_row[open_, i, None] - price_col[open_]
            better = ~done[open_] & (via < reach[open_])
            reach[open_] = np.where(better, via, reach[open_])
            came[open_] = np.where(better, nxt[:, None], came[open_])
        price_row[:, r] += base
        moved = np.where(done, base[:, None] - reach, 0.0)
        for j in range(cols):
            mine = np.flatnonzero(done[:, j] & (at != j))
            price_row[mine, owner[mine, j]] += moved[mine, j]
        price_col -= moved
        back = np.flatnonzero(came[each, at] >= 0)
        while len(back):
            before = came[back, at[back]]
            owner[back, at[back]] = owner[back, before]
            at[back] = before
            back = back[came[back, before] >= 0]
        owner[each, at] = r
    out = np.empty((n, rows), int)
    k, j = np.nonzero(owner >= 0)
    out[k, owner[k, j]] = j
    return out


def _places(end: np.ndarray, starts: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Of each edge the place of its end among the ends of its component, in the order they come in."""
    _, first, of = np.unique(end, return_index=True, return_inverse=True)
    came = np.empty(len(first), int)
    came[np.argsort(first)] = np.arange(len(first))
    at = came[of]
    return at - at[starts][number]


#: Grids of larger sides are solved one by one.
SIDE = 12


def choose_edges(left: np.ndarray, right: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Positions of the edges in the cheapest one-to-one choice, as many edges as possible.

    Components are independent. Those with a single end on a side, those two by two and those of short sides are
    decided for the whole batch at once; the rest are solved one by one.
    """
    if len(left) == 0:
        return np.zeros(0, dtype=int)
    at_left, at_right = linked(left, right)
    comp = at_left[left]
    order = np.lexsort((cost, comp))
    comp, left, right, cost = comp[order], left[order], right[order], cost[order]
    starts = np.concatenate([[0], np.where(comp[1:] != comp[:-1])[0] + 1])
    ends = np.append(starts[1:], len(comp))
    top = max(at_left.max(), at_right.max()) + 1
    n_left, n_right = np.bincount(at_left, minlength=top)[comp[starts]], np.bincount(at_right, minlength=top)[comp[starts]]
    star = (n_left == 1) | (n_right == 1)
    square = (n_left == 2) & (n_right == 2)
    picked = [starts[star]]
    if square.any():
        number = np.repeat(np.arange(len(starts)), ends - starts)
        mine = np.where(square[number])[0]
        at = np.cumsum(square)[number[mine]] - 1
        up = (left[mine] == np.maximum.reduceat(left, starts)[number[mine]]).astype(int)
        across = (right[mine] == np.maximum.reduceat(right, starts)[number[mine]]).astype(int)
        grid = np.full((int(square.sum()), 2, 2), FAR)
        grid[at, up, across] = cost[mine]
        straight = grid[:, 0, 0] + grid[:, 1, 1] <= grid[:, 0, 1] + grid[:, 1, 0]
        picked.append(mine[(up == across) == straight[at]])
    rest = ~star & ~square
    if rest.any():
        rows, cols = np.minimum(n_left, n_right), np.maximum(n_left, n_right)
        shape = np.where(rest & (cols <= SIDE), rows * (SIDE + 1) + cols, 0)
        for code in np.unique(shape[shape > 0]).tolist():
            alike = np.flatnonzero(shape == code)
            rest[alike] = False
            size = (ends - starts)[alike]
            first = np.cumsum(size) - size
            at = np.repeat(np.arange(len(alike)), size)
            mine = np.arange(size.sum()) + np.repeat(starts[alike] - first, size)
            row, col = _places(left[mine], first, at), _places(right[mine], first, at)
            turned = (n_left > n_right)[alike][at]
            row, col = np.where(turned, col, row), np.where(turned, row, col)
            grids = np.full((len(alike), *divmod(code, SIDE + 1)), FAR)
            grids[at, row, col] = cost[mine]
            to = _all_small(grids) if grids.shape[2] <= 3 else _all_least(grids)
            picked.append(mine[to[at, row] == col])
    for a, b in zip(starts[rest], ends[rest]):
        ls, rs = {}, {}
        li = [ls.setdefault(v, len(ls)) for v in left[a:b].tolist()]
        ri = [rs.setdefault(v, len(rs)) for v in right[a:b].tolist()]
        grid = np.full((len(ls), len(rs)), FAR)
        grid[li, ri] = cost[a:b]
        where = {(i, j): a + k for k, (i, j) in enumerate(zip(li, ri))}
        picked.append(np.array([where[p] for p in least_cost(grid) if p in where], dtype=int))
    return order[np.concatenate(picked)]


#: Frames whose candidates are chosen among in one call.
FRAMES = 256


def _codes(c: pa.Array) -> np.ndarray:
    """A number for each value of the one list, in the order of the values."""
    own = c.flatten()
    if pa.types.is_integer(own.type) and not own.null_count and len(own):
        low, high = pc.min_max(own).as_py().values()
        if high - low <= len(own):
            return own.to_numpy().astype(np.int64) - low
    coded = c.flatten().dictionary_encode("encode")
    rank = np.empty(len(coded.dictionary), np.int64)
    rank[pc.sort_indices(coded.dictionary).to_numpy()] = np.arange(len(rank))
    return rank[coded.indices.to_numpy(zero_copy_only=False)]


def _kept(frame: pa.Array, left: pa.Array, right: pa.Array, cost: pa.Array) -> list:
    """Places of the chosen candidates in the one list that each argument holds; they are chosen among in the order of frame, ends and cost."""
    at, price = _codes(frame), cost.flatten().to_numpy(zero_copy_only=False)
    l_code, r_code = (np.unique(at * (len(at) + 1) + _codes(end), return_inverse=True)[1] for end in (left, right))
    order = np.lexsort((price, r_code, l_code))
    return np.sort(order[choose_edges(l_code[order], r_code[order], price[order])])


def solve(candidates: DataFrame, keys, left: str, right: str, cost: str) -> DataFrame:
    """Cheapest one-to-one choice among candidate rows, as many pairs as possible.

    The last of ``keys`` is the frame; the frames of the keys before it (a play) are one list for every ``FRAMES`` of them, in which the choice is marked. So what lies
    together by play still does after the choice, and nothing is shuffled for it. Of two equally cheap choices between two ends and two
    the lower ends meet each other; among more the order of the ends decides.
    """
    *outer, frame = keys
    rest = [c for c in candidates.columns if c not in (*keys, left, right, cost)]
    numbered = isinstance(candidates.schema[frame].dataType, IntegralType)
    block = F.floor(F.col(frame) / FRAMES) if numbered else F.xxhash64(frame)
    row = F.struct(frame, left, right, cost, *rest)
    c = candidates.groupBy(*outer, block.alias("_block")).agg(F.collect_list(row).alias("_rows"))
    pick = F.arrow_udf(_kept, "array<bigint>")
    of = F.col("_rows").getField
    c = c.withColumn("_at", pick(of(frame), of(left), of(right), of(cost)).over(Window.partitionBy(*outer, "_block")))
    c = c.select(*outer, F.explode(F.transform("_at", lambda i: F.get("_rows", i.cast("int")))).alias("_r"))
    return c.select(*[c[k] if k in outer else F.col(f"_r.{k}") for k in candidates.columns])


def match_frames(truth: DataFrame, pred: DataFrame, keys, truth_id: str, pred_id: str, gate: float = 3.0,
                 team: str | None = None, team_penalty: float = 0.0, label: str | None = None, told: dict[str, Column] | None = None, of=((), ())) -> DataFrame:
    """Truth to prediction per frame within ``gate`` yards.

    ``team_penalty`` makes a pair of different teams dearer; with ``label`` two named ends pair
    only when the names agree, at any distance, and distance decides the rest. ``told`` adds columns of a pair, worked out from columns of truth and
    prediction named in ``of``, with ``t_`` and ``p_`` before their names; so matches need not be joined with their rows again.
    """
    extra, told = [c for c in (team, label) if c is not None], told or {}
    a = truth.select(*keys, F.col(truth_id).alias("truth_id"), F.col("x").alias("tx"), F.col("y").alias("ty"),
                     *[F.col(c).alias(f"t_{c}") for c in dict.fromkeys([*extra, *of[0]])])
    b = pred.select(*keys, F.col(pred_id).alias("pred_id"), F.col("x").alias("px"), F.col("y").alias("py"),
                    *[F.col(c).alias(f"p_{c}") for c in dict.fromkeys([*extra, *of[1]])])
    near = a.withColumn("_strip", _strip(F.col("tx"), gate)).join(
        b.withColumn("_strip", F.explode(_strips(F.col("px"), gate))), [*keys, "_strip"]).drop("_strip")
    d = dist(F.col("tx"), F.col("ty"), F.col("px"), F.col("py"))
    near = near.withColumn("d", d).filter(F.col("d") <= gate)
    cost = F.col("d")
    if team is not None and team_penalty > 0:
        differ = F.coalesce(F.col(f"t_{team}") != F.col(f"p_{team}"), F.lit(False))
        cost = cost + F.when(differ, team_penalty).otherwise(0.0)
    if label is not None:
        named = F.col(f"t_{label}").isNotNull() & F.col(f"p_{label}").isNotNull()
        same = a.join(b, keys).filter(F.col(f"t_{label}") == F.col(f"p_{label}")).withColumn("d", d)
        near = near.filter(~named).unionByName(same)
    near = near.withColumn("cost", cost)
    near = near.select(*keys, "truth_id", "pred_id", "d", "cost", *[c.alias(name) for name, c in told.items()])
    return solve(near, keys, "truth_id", "pred_id", "cost").drop("cost")


STATES = ("matched", "duplicate", "stray", "unclaimed")


def judge_boxes(points: DataFrame, boxes: DataFrame, keys, pid: str, box: str, pad: float = 6.0, both: bool = True) -> DataFrame:
    """(keys, pid, box, state, miss): a row for each player and for each box that nobody holds, of frames that have players and boxes.

    A player inside a padded box may claim it; the nearest foot wins and one box serves one player. The boxes of a frame meet its players as one array, joined on
    ``keys`` once, and the choice comes last, so what lies together by play already is not shuffled. Without ``both`` players of all frames are judged, and no boxes.
    """
    px, py, kind = F.col("px"), F.col("py"), boxes.schema[box].dataType
    inside = lambda b: px.between(b["x1"] - pad, b["x2"] + pad) & py.between(b["y1"] - pad, b["y2"] + pad)
    foot = lambda b: F.struct(b[box].alias(box), dist(px, py, (b["x1"] + b["x2"]) / 2, b["y2"]).alias("_foot"))
    framed = boxes.groupBy(*keys).agg(F.collect_list(F.struct(box, "x1", "y1", "x2", "y2")).alias("_boxes"))
    c = points.select(*keys, pid, "px", "py").join(framed, list(keys), "inner" if both else "left")
    c = c.withColumn("_near", F.transform(F.filter("_boxes", inside), foot))
    ids = F.when(F.col(pid) == F.min(pid).over(Window.partitionBy(*keys)), F.transform("_boxes", lambda b: b[box])) if both else F.lit(None).cast(ArrayType(kind))
    c = c.withColumn("_ids", ids)
    # Only players inside no box are measured against every box of the frame.
    c = c.select(*keys, pid, "_ids", (F.size("_near") == 1).alias("_one"), F.when(F.size("_near") == 0, F.array_min(F.transform("_boxes", lambda b: box_gap(px, py, b)))).alias("_gap"),
                 F.explode_outer("_near").alias("_n"))
    alone = F.count(F.lit(1)).over(Window.partitionBy(*keys, "_n")) == 1  # by then the box itself
    c = c.select(*keys, pid, "_ids", "_one", "_gap", F.col(f"_n.{box}").alias("_n"), F.col("_n._foot").alias("_foot")).withColumn("_sole", F.col("_n").isNotNull() & F.col("_one") & alone)
    c = c.select(*keys, pid, F.coalesce("_n", F.lit(0).cast(kind)).alias(box), F.col("_n").isNotNull().alias("_inside"), "_sole", "_foot", "_gap", "_ids")

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        within, sole = pdf["_inside"].to_numpy(), pdf["_sole"].to_numpy()
        hard = np.where(within & ~sole)[0]
        h = pdf.iloc[hard]
        l_code, r_code = (h.groupby([*keys, end], sort=False).ngroup().to_numpy() for end in (pid, box))
        got = choose_edges(l_code, r_code, h["_foot"].to_numpy())
        ends, at = np.unique(l_code, return_index=True)
        held = np.concatenate([np.where(sole)[0], hard[got]])
        parts = [held, hard[at[~np.isin(ends, l_code[got])]], np.where(~within)[0]]
        state = np.repeat(np.arange(3, dtype=np.int32), [len(p) for p in parts])
        out = pdf.iloc[np.concatenate(parts)][[*keys, pid, box, "_gap"]].assign(_state=state)
        if not both:
            return out
        told = pdf[pdf["_ids"].notna()].drop_duplicates(list(keys))
        free = told.loc[told.index.repeat(told["_ids"].map(len)), [*keys, pid, box, "_gap"]].assign(_state=np.int32(3))
        free[box] = np.concatenate(told["_ids"].to_list())
        taken = pd.MultiIndex.from_frame(pdf.iloc[held][[*keys, box]])
        free = free[~pd.MultiIndex.from_frame(free[[*keys, box]]).isin(taken)]
        return pd.concat([out, free], ignore_index=True)

    shape = c.select(*keys, pid, box, "_gap", F.lit(0).alias("_state")).schema
    r = small_groups(c, list(keys), pick, shape, together=True).withColumn("state", F.element_at(F.array(*[F.lit(s) for s in STATES]), F.col("_state") + 1))
    return r.select(*keys, F.when(F.col("_state") < 3, F.col(pid)).alias(pid), F.when(F.col("_state").isin(0, 3), F.col(box)).alias(box), "state",
                    F.when(F.col("_state") == 2, F.coalesce("_gap", F.lit(0.0))).alias("miss"))


def claim_boxes(points: DataFrame, boxes: DataFrame, keys, pid: str, box: str, pad: float = 6.0) -> DataFrame:
    """Each projected player against the boxes of his frame: matched, duplicate or stray.

    ``claimed`` is the box he holds. ``miss`` is the distance to the nearest box for a stray.
    """
    return judge_boxes(points, boxes, keys, pid, box, pad, both=False).withColumnRenamed(box, "claimed")


def _islands(group: np.ndarray, x1: np.ndarray, x2: np.ndarray) -> np.ndarray:
    """A number for each stretch of boxes, in order of group and left edge, which no box reaches across."""
    if not len(group):
        return group
    by_right = np.argsort(x2, kind="stable")
    rank = np.empty(len(x2), np.int64)
    rank[by_right] = np.arange(len(x2))
    far = np.maximum.accumulate(group * len(x2) + rank)[:-1]  # the farthest right edge so far, of the last group
    new = np.ones(len(x2), bool)
    new[1:] = (group[1:] != group[:-1]) | (x1[1:] >= x2[by_right][far % len(x2)])
    return np.cumsum(new)


def _unsuppressed(group: np.ndarray, sides: np.ndarray, score: np.ndarray, number: np.ndarray, limit: float) -> np.ndarray:
    """Which boxes a greedy pass through each group keeps, best score first; ``sides`` has rows x1, y1, x2, y2."""
    order = np.lexsort((sides[0], group))
    island = _islands(group[order], sides[0][order], sides[2][order])
    order = order[np.lexsort((number[order], -score[order], ~np.isnan(score[order]), island))]
    island = np.sort(island)
    (x1, y1, x2, y2), area = sides[:, order], ((sides[2] - sides[0]) * (sides[3] - sides[1]))[order]
    stays = np.ones(len(order), bool)
    first = np.flatnonzero(np.diff(island, prepend=-1))
    end = np.append(first[1:], len(order))
    while len(first := first[(more := end - first > 1)]):  # the best box left of each island, against those after it
        end = end[more]
        if len(at := np.flatnonzero(stays[first])):
            size = (end - first)[at] - 1
            k = np.repeat(first[at], size)
            r = k + 1 + np.arange(len(k)) - np.repeat(np.cumsum(size) - size, size)
            wide, high = np.minimum(x2[k], x2[r]) - np.maximum(x1[k], x1[r]), np.minimum(y2[k], y2[r]) - np.maximum(y1[k], y1[r])
            inter = np.maximum(wide, 0.0) * np.maximum(high, 0.0)
            union = area[k] + area[r] - inter
            with np.errstate(invalid="ignore", divide="ignore"):
                stays[r[~(union <= 0) & ~(inter / union < limit)]] = False
        first = first + 1
    out = np.empty(len(order), bool)
    out[order] = stays
    return out


def suppress_overlaps(boxes: DataFrame, keys, box: str, limit: float = 0.55) -> DataFrame:
    """Greedy suppression by score: a box overlapping a kept, better one is dropped.

    Boxes in order of their left edge fall into islands, which no box reaches across; the islands of many frames are passed through from the best box down at once, a
    round for each place in an island. Rows are sorted by ``keys``, so boxes that lie together by play are not shuffled. Ties of score go to the lower box; a box
    without a score or a place (null, or a side that is no number) stays and drops none. ``limit`` is above 0.
    """
    sides = ["x1", "y1", "x2", "y2"]
    plain = boxes.withColumns({f"_{c}": F.col(c).cast("double") for c in (*sides, "score") if boxes.schema[c].dataType != DoubleType()})
    named = {c: f"_{c}" if f"_{c}" in plain.columns else c for c in (*sides, "score")}

    def keep(rows: pa.Table, group: np.ndarray) -> np.ndarray:
        at = np.stack([rows[named[c]].to_numpy() for c in sides])
        judged = ~np.isnan(at).any(axis=0) & ~rows[named["score"]].is_null().to_numpy()
        out = np.ones(len(judged), bool)
        number = rows[box]
        if not pa.types.is_integer(number.type) or number.null_count:
            number = pc.rank(number, "ascending", null_placement="at_start", tiebreaker="dense")
        out[judged] = _unsuppressed(group[judged], at[:, judged], rows[named["score"]].to_numpy()[judged], number.to_numpy()[judged], limit)
        return out

    return kept_of_groups(plain, list(keys), keep, boxes.columns)


def switches(matches: DataFrame, sp) -> DataFrame:
    """Identity switches: the matched track differs from the previous match of that player."""
    from snapspan.plans.sequences import shift
    m = shift(matches, sp, {"_was": "pred_id"}, -1)
    return m.withColumn("switch", F.coalesce((F.col("_was") != F.col("pred_id")).cast("int"), F.lit(0))).drop("_was")


def pct(c: Column, q: float) -> Column:
    return F.percentile(F.round(c, 6), F.lit(q))
