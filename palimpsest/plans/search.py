"""Queries of the search for snippets, on sheets of 32 x 32."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators import search as S
from palimpsest.operators.images import XY
from palimpsest.plans import maps
from palimpsest.plans.catalog import query
from palimpsest.plans.maps import SHEET

#: A snippet of 9 rows and 8 columns of each sheet at (k % 7 + 1, k % 5), without some of its pixels, and the forged sheet, where it stands a second time 14 rows down and 13 to the right, a level brighter.
_SNIPPET = f"""{SHEET}, whole AS (SELECT image_id, y - (image_id % 7 + 1) AS y, x - image_id % 5 AS x, g FROM sh WHERE y - (image_id % 7 + 1) BETWEEN 0 AND 8 AND x - image_id % 5 BETWEEN 0 AND 7),
sn AS MATERIALIZED (SELECT * FROM whole WHERE (y + x) % 6 <> 5),
put AS (SELECT *, 0 AS k FROM sh UNION ALL SELECT image_id, CAST(y + image_id % 7 + 15 AS INT), CAST(x + image_id % 5 + 13 AS INT), least(255, g + 1), 1 FROM whole),
fo AS MATERIALIZED (SELECT image_id, y, x, arg_max(g, k) AS g FROM put GROUP BY image_id, y, x HAVING min(k) = 0)"""


def _scene(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Sheets, forged sheets, the opaque pixels of each sheet's snippet, and all of them."""
    sheets = maps.sheets(spark, sf_dir)
    at = sheets.withColumns({"y": F.expr("cast(y - (image_id % 7 + 1) AS int)"), "x": F.expr("cast(x - image_id % 5 AS int)")})
    full = at.filter("y BETWEEN 0 AND 8 AND x BETWEEN 0 AND 7").select(F.col("image_id").alias("snippet_id"), *XY, "g")
    put = full.select("image_id", F.expr("cast(y + image_id % 7 + 15 AS int)").alias("y"), F.expr("cast(x + image_id % 5 + 13 AS int)").alias("x"), F.expr("least(255, g + 1)").alias("new"))
    forged = sheets.join(put, XY, "left").select(*XY, F.coalesce("new", "g").alias("g"))
    return sheets, forged, full.filter("(y + x) % 6 <> 5"), full


_SCORES = """c AS (SELECT s.image_id, CAST(p.y - s.y AS INT) AS oy, CAST(p.x - s.x AS INT) AS ox, count(*) AS n, {score} AS score FROM sn s JOIN {image} p ON p.image_id = s.image_id GROUP BY ALL),
w AS (SELECT c.* FROM c JOIN (SELECT image_id, count(*) AS need FROM sn GROUP BY ALL) USING (image_id) WHERE n = need)"""


@query(
    f"""WITH {_SNIPPET}, {_SCORES.format(score="sum(CASE WHEN abs(p.g - s.g) > 40 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)", image="fo")}
SELECT image_id AS snippet_id, image_id, oy, ox, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score, oy, ox) AS rank FROM w) WHERE rank <= 6"""
)
def snippet_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six best places of a snippet by pixels off, from coarse to fine."""
    _, forged, snippets, _ = _scene(spark, sf_dir)
    return S.search(forged, snippets, tolerance=40).withColumn("rank", F.col("rank").cast("long"))


_FIRST = "SELECT image_id, oy, ox FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score, oy, ox) AS rank FROM {0}) WHERE rank = 1"


@query(
    f"""WITH {_SNIPPET}, c AS (SELECT s.image_id, CAST(p.y - s.y AS INT) AS oy, CAST(p.x - s.x AS INT) AS ox, count(*) AS n, count(*) FILTER (abs(p.g - s.g) > 2) AS score FROM sn s JOIN fo p ON p.image_id = s.image_id GROUP BY ALL),
sizes AS (SELECT image_id, count(*) AS need FROM sn GROUP BY ALL), w AS (SELECT c.* FROM c JOIN sizes USING (image_id) WHERE n = need AND 2 * score < need),
near AS (SELECT * FROM w WHERE abs(oy - (image_id % 7 + 15)) <= 3 AND abs(ox - (image_id % 5 + 13)) <= 3), ins AS ({_FIRST.format("near")}),
neutral AS MATERIALIZED (SELECT image_id, y, x, CASE WHEN count(*) > 1 THEN (max(g) + 128) % 256 ELSE max(g) END AS g FROM (SELECT * FROM fo UNION ALL SELECT s.image_id, s.y + i.oy, s.x + i.ox, -1 FROM sn s JOIN ins i USING (image_id)) GROUP BY image_id, y, x),
c2 AS (SELECT s.image_id, CAST(p.y - s.y AS INT) AS oy, CAST(p.x - s.x AS INT) AS ox, count(*) AS n, count(*) FILTER (abs(p.g - s.g) > 2) AS score FROM sn s JOIN neutral p ON p.image_id = s.image_id GROUP BY ALL),
w2 AS (SELECT c2.* FROM c2 JOIN sizes USING (image_id) WHERE n = need AND 2 * score < need), src AS ({_FIRST.format("w2")}),
sp AS MATERIALIZED (SELECT s.image_id, i.oy + s.y AS y, i.ox + s.x AS x, o.oy + s.y AS py, o.ox + s.x AS px FROM sn s JOIN ins i USING (image_id) JOIN src o USING (image_id)),
sa AS MATERIALIZED (SELECT sp.*, g FROM sp JOIN fo USING (image_id, y, x)),
ag AS MATERIALIZED (SELECT sa.image_id, sa.y, sa.x, py, px FROM sa JOIN fo b ON b.image_id = sa.image_id AND b.y = py AND b.x = px WHERE abs(sa.g - b.g) < 6),
cp AS (SELECT image_id, y, x FROM ag UNION SELECT image_id, py, px FROM ag),
ch AS (SELECT DISTINCT a.image_id, a.y, a.x FROM whole f JOIN ins i USING (image_id) JOIN fo a ON a.image_id = f.image_id AND a.y = i.oy + f.y AND a.x = i.ox + f.x JOIN sh b ON b.image_id = a.image_id AND b.y = a.y AND b.x = a.x WHERE abs(a.g - b.g) >= 6)
SELECT image_id, y, x, 255 AS value FROM cp UNION ALL SELECT image_id, y, x, 128 FROM ch WHERE NOT EXISTS (SELECT 1 FROM cp WHERE cp.image_id = ch.image_id AND cp.y = ch.y AND cp.x = ch.x)"""
)
def snippet_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ground truth of a forgery from its snippet: the insert found near a box, the source once that place is neutralised, both annotated."""
    sheets, forged, snippets, full = _scene(spark, sf_dir)
    near = snippets.select(*S.SNIPPET).distinct().withColumns({f"{e}_{c}": F.expr(f"cast(image_id % {m} + {at} {d} 3 AS int)") for c, m, at in (("y", 7, 15), ("x", 5, 13)) for e, d in (("low", "-"), ("high", "+"))})
    inserted, source = S.insert_and_source(forged, snippets, near, best=1, tolerance=2, prune_factor=2.0)
    return S.annotated(forged, sheets, snippets, full, inserted, source)
