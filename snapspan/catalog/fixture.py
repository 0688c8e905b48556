"""Tracking tables derived from the given ``orders`` and ``events`` tables.

Every order is one instant of a play: 40 consecutive order keys make a play, and the
instant becomes one row per player and one for the ball. Nothing is filtered, so the
tables grow with ``orders``. Positions are closed forms of the keys in hundredths of a
yard, which gives both engines the same doubles; the customer key supplies acceleration
and body angle. The whole table costs one scan and one shuffle of the narrow instants; it is
written in buckets of whole plays, so what is keyed on the play is not shuffled again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapspan.plans.session import checkpoint_folder, settle
from snapspan.schema import PLAY

ENTITIES = 23
#: Instants of one bucket: about 280,000 rows, which a task sorts in memory.
BUCKET = 12_000
_WRITTEN: dict[tuple, str] = {}
_COUNTED: dict[tuple, int] = {}


PLAY_COLUMNS = ["o_orderkey", "o_custkey", "CAST(floor(o_orderkey / 40) AS BIGINT) AS k",
                "CAST(o_orderkey % 40 + 1 AS INT) AS f"]

# Layer by layer: who the row follows (players themselves, the ball its holder or its flight),
# where that route is, and how far it moved since the last frame. Offense runs straight lines
# from the snap at frame 5; a defender shadows his man with a gap that swings in and out.
TRACKING_SELECT = """
SELECT CAST(floor(k / 25) AS BIGINT) AS game_id, k AS play_id, f AS frame_id, round((f - 5) / 10, 3) AS t,
  CASE WHEN p < 22 THEN CAST(p AS BIGINT) END AS nfl_id,
  CASE WHEN p = 22 THEN 'ball' WHEN p < 11 THEN 'HOM' ELSE 'AWY' END AS club,
  CASE WHEN p = 22 THEN NULL
       WHEN p >= 11 THEN CASE p % 5 WHEN 0 THEN 'DE' WHEN 1 THEN 'CB' WHEN 2 THEN 'FS' WHEN 3 THEN 'ILB' ELSE 'NT' END
       ELSE CASE (p - passer + 11) % 11 WHEN 0 THEN 'QB' WHEN 1 THEN 'RB' WHEN 2 THEN 'TE' WHEN 3 THEN 'WR'
         WHEN 4 THEN 'WR' WHEN 5 THEN 'TE' WHEN 6 THEN 'T' WHEN 7 THEN 'G' WHEN 8 THEN 'C' WHEN 9 THEN 'G' ELSE 'T' END
  END AS position,
  CASE WHEN p < 22 THEN CAST(p + 10 AS INT) END AS jersey,
  CASE WHEN lft = 1 THEN 'left' ELSE 'right' END AS play_direction,
  CASE WHEN f = 5 THEN 'ball_snap' WHEN f = 12 THEN 'pass_forward' WHEN f = arr THEN 'pass_arrived' END AS event,
  CASE WHEN lft = 1 THEN 12000 - x100 ELSE x100 END / 100 AS x,
  CASE WHEN lft = 1 THEN 5330 - y100 ELSE y100 END / 100 AS y,
  CASE WHEN p = 22 THEN CAST(0 AS DOUBLE) ELSE round(sqrt(CAST(dx * dx + dy * dy AS DOUBLE)) / 10, 6) END AS s,
  CAST(o_custkey % 40 AS DOUBLE) / 10 AS a,
  CASE WHEN p < 22 THEN bear END AS dir,
  CASE WHEN p < 22 AND (o_custkey + p) % 17 > 0 THEN round(bear + (o_custkey + p) % 41 + 340, 6) % 360 END AS o
FROM (SELECT *, CASE WHEN dx = 0 AND dy = 0 THEN CAST(0 AS DOUBLE)
        ELSE round((degrees(atan2(CASE WHEN lft = 1 THEN -dx ELSE dx END, CASE WHEN lft = 1 THEN -dy ELSE dy END)) + 360) % 360, 6) END AS bear
  FROM (SELECT *,
      CASE WHEN fly = 1 THEN CAST(floor(x1 + (x2 - x1) * (f - 12) / (arr - 12)) AS BIGINT) ELSE x1 + gap END AS x100,
      CASE WHEN fly = 1 THEN CAST(floor(y1 + (y2 - y1) * (f - 12) / (arr - 12)) AS BIGINT) ELSE y1 END AS y100,
      CASE WHEN f > 5 THEN vx + gap - gap0 ELSE 0 END AS dx, CASE WHEN f > 5 THEN vy ELSE 0 END AS dy
    FROM (SELECT *, 4000 + (k * 37 + q * 101) % 500 + vx * m AS x1, 600 + q * 400 + vy * m + d * 40 AS y1,
        4000 + (k * 37 + target * 101) % 500 + (10 + (target * 7 + k) % 50) * (arr - 5) AS x2,
        600 + target * 400 + ((target * 5 + k) % 21 - 10) * (arr - 5) AS y2,
        d * abs((m * 40 + c1) % (300 + 2 * c2) - (150 + c2)) AS gap,
        d * abs(((m - 1) * 40 + c1) % (300 + 2 * c2) - (150 + c2)) AS gap0
      FROM (SELECT *, 10 + (q * 7 + k) % 50 AS vx, (q * 5 + k) % 21 - 10 AS vy, ((k + q) % 5) * 100 AS c1,
          50 * ((k + 2 * q) % 8) AS c2, CASE WHEN fly = 1 THEN 7 WHEN f > 5 THEN f - 5 ELSE 0 END AS m
        FROM (SELECT *, CASE WHEN e >= 11 THEN e - 11 ELSE e END AS q, CASE WHEN e >= 11 THEN 1 ELSE 0 END AS d
          FROM (SELECT *, CASE WHEN p < 22 THEN p WHEN f < arr THEN passer ELSE target END AS e,
              CASE WHEN p = 22 AND f > 12 AND f < arr THEN 1 ELSE 0 END AS fly
            FROM (SELECT *, k % 2 AS lft, k % 11 AS passer, (k + 3) % 11 AS target, 20 + k % 5 AS arr
              FROM {source}) a) b) c) d) e) g) h
"""

PLAYS_SELECT = """
SELECT CAST(floor(k / 25) AS BIGINT) AS game_id, k AS play_id, CAST(1 + floor(k / 25) % 3 AS INT) AS week,
  CAST(1 + floor((k % 25) / 7) AS INT) AS quarter, CAST(1 + k % 4 AS INT) AS down, CAST(10 - k % 7 AS INT) AS yards_to_go,
  CASE k % 3 WHEN 0 THEN 'C' WHEN 1 THEN 'I' ELSE 'IN' END AS pass_result,
  CAST(k % 13 - 3 AS INT) AS yards_gained, CASE WHEN k % 12 < 6 THEN 'HOM' ELSE 'AWY' END AS possession_team,
  CASE WHEN k % 2 = 1 THEN 'left' ELSE 'right' END AS play_direction,
  CAST(CASE WHEN k % 2 = 1 THEN 78 - k % 5 ELSE 42 + k % 5 END AS DOUBLE) AS yardline,
  CASE WHEN k % 5 > 0 THEN TRUE ELSE FALSE END AS is_dropback, CAST(CASE WHEN k % 29 = 7 THEN 1 ELSE 0 END AS INT) AS kneel,
  CAST(CASE WHEN k % 31 = 5 THEN 1 WHEN k % 31 = 6 THEN NULL ELSE 0 END AS INT) AS spike,
  CAST(top_cust % 41 - 20 AS DOUBLE) / 10 AS epa, top_prio AS priority,
  concat('(', CAST(15 - k % 15 AS STRING), ':00) Q.Back pass short to P.Name', substr('abcdefghijk', CAST(1 + CASE WHEN k % 4 = 0 THEN (k + 4) % 11 ELSE (k + 3) % 11 END AS INT), 1),
         CASE WHEN k % 9 = 0 THEN ' TOUCHDOWN' ELSE '' END) AS description
FROM (SELECT k, max(o_custkey) AS top_cust, min(o_orderpriority) AS top_prio
      FROM (SELECT o_custkey, o_orderpriority, CAST(floor(o_orderkey / 40) AS BIGINT) AS k FROM orders) o GROUP BY k) z
"""


def tables(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def buckets(spark: SparkSession, sf_dir: str) -> int:
    """As many as the configured shuffle, and more once a bucket would outgrow ``BUCKET`` instants."""
    at = (spark.sparkContext.applicationId, sf_dir)
    if at not in _COUNTED:
        _COUNTED[at] = tables(spark, sf_dir, "orders").count()
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-_COUNTED[at] // BUCKET))


def derive_tracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Release-shaped rows: stadium coordinates, compass angles, null id for the ball.

    The narrow instants are spread by play before each becomes 23 rows, so the work does not
    depend on how many files ``orders`` came in.
    """
    orders = tables(spark, sf_dir, "orders").selectExpr(*PLAY_COLUMNS)
    placed = orders.repartition(buckets(spark, sf_dir), F.expr("CAST(floor(k / 25) AS BIGINT)"), F.col("k")).sortWithinPartitions("k", "f")
    spread = placed.withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(ENTITIES - 1))))
    return spark.sql(TRACKING_SELECT.format(source="{spread}"), spread=spread)


def tracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tracking table, written once per application to the shared folder and read back.

    Every query then scans only its own columns, and a lost executor re-reads files. A play lies in one
    bucket: windows, groups and joins keyed on it, or on it and more, need no shuffle.
    """
    settle(spark)
    name = f"tracking_{abs(hash(sf_dir))}"
    at = (spark.sparkContext.applicationId, sf_dir)
    if at not in _WRITTEN:
        path = f"{checkpoint_folder(spark)}/{spark.sparkContext.applicationId}/{name}"
        made = derive_tracking(spark, sf_dir)
        made.write.mode("overwrite").option("path", path).bucketBy(buckets(spark, sf_dir), *PLAY).saveAsTable(name)
        _WRITTEN[at] = name
    return spark.table(_WRITTEN[at])


def plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a play, dealt like the buckets of the tracking table: a join with it moves these few rows and no samples."""
    made = spark.sql(PLAYS_SELECT.replace("FROM orders)", "FROM {orders})"), orders=tables(spark, sf_dir, "orders"))
    return made.repartition(buckets(spark, sf_dir), *PLAY)


TRACKING_SQL = TRACKING_SELECT.format(
    source=f"(SELECT {", ".join(PLAY_COLUMNS)}, p FROM orders CROSS JOIN (SELECT CAST(range AS INT) AS p FROM range({ENTITIES})) pp) src")

# Named base tables of the oracle statements, each after the ones it reads.
BASE = {
    "trk": TRACKING_SQL,
    "plays": PLAYS_SELECT.replace("AS STRING)", "AS VARCHAR)"),
    "norm": """SELECT game_id, play_id, frame_id, t, nfl_id, club, position, jersey, event, s, a, play_direction = 'left' AS mirrored,
        play_direction, CASE WHEN play_direction = 'left' THEN 120.0::DOUBLE - x ELSE x END AS x,
        CASE WHEN play_direction = 'left' THEN 53.3::DOUBLE - y ELSE y END AS y,
        CASE WHEN play_direction = 'left' THEN (o + 180) % 360 ELSE o END AS o,
        CASE WHEN play_direction = 'left' THEN (dir + 180) % 360 ELSE dir END AS dir FROM trk""",
    "men": "SELECT *, (90 - dir + 720) % 360 AS cdir, (90 - coalesce(o, dir) + 720) % 360 AS co FROM norm WHERE nfl_id IS NOT NULL",
    "ball": "SELECT game_id, play_id, frame_id, t, x, y, s FROM norm WHERE nfl_id IS NULL",
    "win": """SELECT game_id, play_id, snap, throw, arrival, arrival - throw AS h FROM (
        SELECT game_id, play_id, min(frame_id) FILTER (event = 'ball_snap') AS snap,
          min(frame_id) FILTER (event IN ('pass_forward', 'pass_shovel')) AS throw,
          min(frame_id) FILTER (event = 'pass_arrived') AS arrival FROM trk GROUP BY ALL) z
        WHERE throw IS NOT NULL AND arrival IS NOT NULL AND arrival > throw""",
}
NEEDS = {"norm": ["trk"], "men": ["norm"], "ball": ["norm"], "win": ["trk"]}


def add_base(name: str, sql: str, *needs: str) -> None:
    BASE[name] = sql
    NEEDS[name] = list(needs)


def oracle(body: str, *names: str) -> str:
    """A DuckDB statement over the named base tables and whatever those read."""
    ordered: list[str] = []

    def visit(n: str) -> None:
        for m in NEEDS.get(n, []):
            visit(m)
        if n not in ordered:
            ordered.append(n)

    for n in names:
        visit(n)
    body = body.strip()
    head = ",\n".join(f"{n} AS MATERIALIZED ({BASE[n]})" for n in ordered)
    if not head:
        return body
    kind = "WITH RECURSIVE" if body.upper().startswith("WITH RECURSIVE ") else "WITH"
    return f"{kind} {head}" + (f",\n{body[len(kind) + 1:]}" if body.upper().startswith("WITH ") else f"\n{body}")
