"""Queries of superpixels, on boards of 64 x 64."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators import raster as R
from palimpsest.operators import superpixels as S
from palimpsest.plans import maps
from palimpsest.plans.catalog import query
from palimpsest.plans.homographies import _MATCHES, _matches
from palimpsest.plans.maps import BOARD
from palimpsest.session import durable

ROUNDS, SEGMENTS, COMPACT = 2, 36, 60.0


def _slic_sql() -> str:
    """bd and the segments of a chain of rounds, the last of which is sg(image_id, y, x, segment); side 64 / 6."""
    side = "(64 / 6.0::DOUBLE)"
    parts = [f"c0 AS (SELECT bd.image_id, i * 6 + j + 1 AS segment, bd.y::DOUBLE AS cy, bd.x::DOUBLE AS cx, bd.g::DOUBLE AS c FROM (SELECT unnest(range(6)) AS i), (SELECT unnest(range(6)) AS j), bd WHERE bd.y = floor((i + 0.5) * {side}) AND bd.x = floor((j + 0.5) * {side}))"]
    for k in range(ROUNDS + 1):
        parts.append(
            f"""m{k} AS MATERIALIZED (SELECT b.image_id, b.y, b.x, b.g, arg_min(segment, (round((b.g - c) * (b.g - c) + ({COMPACT}::DOUBLE / {side}) * ({COMPACT}::DOUBLE / {side}) * ((b.y - cy) * (b.y - cy) + (b.x - cx) * (b.x - cx)), 9), segment)) AS segment
FROM bd b JOIN c{k} ON b.image_id = c{k}.image_id WHERE abs(b.y - cy) <= 2 * {side} AND abs(b.x - cx) <= 2 * {side} GROUP BY ALL)"""
        )
        parts.append(f"c{k + 1} AS MATERIALIZED (SELECT image_id, segment, avg(y) AS cy, avg(x) AS cx, avg(g) AS c FROM m{k} GROUP BY ALL)")
    return ",\n".join([BOARD.replace("bd AS (", "bd AS MATERIALIZED (", 1), *parts[:-1], f"sg AS (SELECT image_id, y, x, segment FROM m{ROUNDS})"])


def _segments(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    board = maps.boards(spark, sf_dir)
    counts = board.select("image_id").distinct().withColumn("segments", F.lit(SEGMENTS))
    return board, S.slic(board, counts, COMPACT, ROUNDS)


@query(f"WITH {_slic_sql()} SELECT image_id, y, x, segment FROM sg")
def slic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Superpixels by local clustering from a grid of centres."""
    return _segments(spark, sf_dir)[1].select("image_id", "y", "x", F.col("segment").cast("long").alias("segment"))


@query(
    f"""WITH {_slic_sql()}, {_MATCHES}, ab AS (SELECT image_id, segment, avg(y) AS cy, avg(x) AS cx, avg(g) AS mean FROM m{ROUNDS} GROUP BY ALL),
mm AS (SELECT image_id, y, x, my, mx FROM ma WHERE id % 6 <> 0 AND id % 5 = 0),
ps AS MATERIALIZED (SELECT mm.image_id, segment AS s, my, mx FROM mm JOIN sg USING (image_id, y, x)),
pa AS MATERIALIZED (SELECT DISTINCT ps.image_id, s, segment AS t FROM ps JOIN sg ON sg.image_id = ps.image_id AND sg.y = my AND sg.x = mx),
se AS (SELECT image_id, s AS segment FROM pa UNION SELECT image_id, t FROM pa),
sp AS MATERIALIZED (SELECT DISTINCT image_id, segment, y + dy AS y, x + dx AS x FROM sg SEMI JOIN se USING (image_id, segment), (SELECT unnest(range(-3, 4)) AS dy), (SELECT unnest(range(-3, 4)) AS dx)),
tc AS MATERIALIZED (SELECT DISTINCT sp.image_id, sp.segment, sg.segment AS nb FROM sp JOIN sg USING (image_id, y, x) WHERE sp.segment <> sg.segment),
an AS (SELECT tc.*, round(degrees(atan2(q.cy - p.cy, q.cx - p.cx)), 6) AS angle, p.mean AS m, q.mean AS n FROM tc JOIN ab p ON p.image_id = tc.image_id AND p.segment = tc.segment JOIN ab q ON q.image_id = tc.image_id AND q.segment = tc.nb),
di AS (SELECT image_id, segment, d, arg_min(nb, nb) AS nb, arg_min(abs(m - n), nb) AS off FROM an, (SELECT unnest(range(8)) AS d) WHERE least(abs(angle - (d * 45 - 180)), 360 - abs(angle - (d * 45 - 180))) <= 22 GROUP BY ALL),
al AS (SELECT * FROM di WHERE off <= 6),
bo AS (SELECT pa.image_id, p.nb AS p, q.nb AS q FROM pa JOIN al p ON p.image_id = pa.image_id AND p.segment = s JOIN al q ON q.image_id = pa.image_id AND q.segment = t AND q.d = p.d)
SELECT image_id, segment FROM se UNION SELECT image_id, p FROM bo UNION SELECT image_id, q FROM bo"""
)
def grown_superpixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Superpixels with matches, and their near-coloured neighbours in the same direction at both ends."""
    board, segments = _segments(spark, sf_dir)
    segments = durable(segments, "segments")
    matches = _matches(spark, sf_dir).filter("id % 6 <> 0 AND id % 5 = 0")
    found = S.grown(segments, S.described(board, segments), matches, 6.0)
    return found.select("image_id", F.col("segment").cast("long").alias("segment"))


@query()
def superpixel_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Superpixels of a size that the image asks for, without fragments, grown from matches and closed."""
    board = maps.boards(spark, sf_dir)
    counts = R.segment_size(board.select("image_id", "y", "x", F.col("g").cast("double").alias("v")), "v", 4).select("image_id", F.greatest(F.lit(4), F.round("size").cast("int")).alias("segments"))
    segments = S.without_fragments(S.slic(board, counts, COMPACT, 3), 20)
    found = S.grown(segments, S.described(board, segments), _matches(spark, sf_dir).filter("id % 6 <> 0 AND id % 5 = 0"), 6.0)
    return S.closed_areas(segments, found, 4, 64, 64)
