"""Queries over forgery operators, templates and scenes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators import forge, images, scenes
from palimpsest.operators import raster as R
from palimpsest.operators import scoring as S
from palimpsest.operators import templates as P
from palimpsest.operators.images import XY
from palimpsest.plans import maps
from palimpsest.plans.catalog import query
from palimpsest.plans.maps import COMP, GT, PX, SIDE
from palimpsest.plans.raster import _packed
from palimpsest.session import durable, table


@query(
    f"""WITH {PX}, {GT}, box AS (SELECT image_id, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1 FROM gt GROUP BY image_id),
shape AS (SELECT DISTINCT p.image_id, p.y, p.x FROM px p JOIN gt g ON g.image_id = p.image_id AND abs(g.y - p.y) <= 1 AND abs(g.x - p.x) <= 1 JOIN box b ON b.image_id = p.image_id AND p.y BETWEEN y0 AND y1 AND p.x BETWEEN x0 AND x1)
SELECT p.image_id, p.y, p.x, CASE WHEN s.y IS NULL THEN g ELSE least(255, greatest(0, CAST(floor(g * 1.2::DOUBLE + 20) AS INT))) END AS g, s.y IS NOT NULL AS truth
FROM px p LEFT JOIN shape s ON s.image_id = p.image_id AND s.y = p.y AND s.x = p.x"""
)
def retouch_brightness_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contrast and brightness of objects through their dilated shapes."""
    out, truth = forge.retouch(maps.pixels(spark, sf_dir), maps.truth(spark, sf_dir), 1.2, 20, SIDE, SIDE)
    return out.join(truth.select(*XY, F.lit(True).alias("truth")), XY, "left").fillna(False, ["truth"])


@query(
    f"""WITH {PX}, {GT}, landed AS (SELECT g.image_id, g.y, g.x FROM gt g WHERE g.y + 3 <= 7 AND g.x + 2 <= 7 AND NOT EXISTS (SELECT 1 FROM gt h WHERE h.image_id = g.image_id AND h.y = g.y + 3 AND h.x = g.x + 2)),
copied AS (SELECT l.image_id, l.y + 3 AS y, l.x + 2 AS x, p.g FROM landed l JOIN px p USING (image_id, y, x))
SELECT p.image_id, p.y, p.x, coalesce(c.g, p.g) AS g, CASE WHEN c.g IS NOT NULL THEN 'copy' WHEN l.y IS NOT NULL THEN 'source' ELSE 'none' END AS part
FROM px p LEFT JOIN copied c ON c.image_id = p.image_id AND c.y = p.y AND c.x = p.x LEFT JOIN landed l ON l.image_id = p.image_id AND l.y = p.y AND l.x = p.x"""
)
def copy_move_translate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects moved within their image, without what falls on the originals."""
    out, truth = forge.copy_move(maps.pixels(spark, sf_dir), maps.truth(spark, sf_dir), F.lit(3), F.lit(2), SIDE, SIDE)
    return out.join(truth, XY, "left").withColumn("part", F.coalesce("part", F.lit("none"))).groupBy(*XY).agg(F.first("g").alias("g"), F.min("part").alias("part"))


@query(
    f"""WITH {PX}, laid AS (SELECT image_id, y, x, g, 0 AS k FROM px UNION ALL SELECT image_id + 1, y + 1, x - 1, g, 1 FROM px WHERE v > 0.15 AND y < 7 AND x >= 1)
SELECT image_id, y, x, coalesce(max(g) FILTER (k = 1), max(g)) AS g, max(k) = 1 AS truth FROM laid GROUP BY image_id, y, x HAVING min(k) = 0"""
)
def splicing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """objects of one image in the next."""
    px = maps.pixels(spark, sf_dir)
    pairs = maps.image_list(spark, sf_dir).select(F.col("image_id").alias("donor"), (F.col("image_id") + 1).alias("host"))
    out, truth = forge.splice(px, maps.truth(spark, sf_dir), px, pairs, 1, -1, SIDE, SIDE)
    return out.join(truth.select(*XY, F.lit(True).alias("truth")), XY, "left").fillna(False, ["truth"])


@query(
    """WITH r AS (SELECT vec_id AS image_id, vec_id % 3 AS ay, vec_id % 2 AS ax, vec_id % 4 AS cy, 3 AS cx FROM embeddings),
s AS (SELECT *, greatest(ay, cy) AS y0, greatest(ax, cx) AS x0, least(ay + 5, cy + 4) AS y1, least(ax + 4, cx + 5) AS x1 FROM r)
SELECT image_id, y0 - ay AS a_top, x0 - ax AS a_left, y0 - cy AS b_top, x0 - cx AS b_left, y1 - y0 AS h, x1 - x0 AS w FROM s WHERE y0 < y1 AND x0 < x1"""
)
def overlap_rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """what two crops of an image share, in each crop's frame."""
    c = {"a_y0": F.col("image_id") % 3, "a_x0": F.col("image_id") % 2, "a_h": F.lit(5), "a_w": F.lit(4), "b_y0": F.col("image_id") % 4, "b_x0": F.lit(3), "b_h": F.lit(4), "b_w": F.lit(5)}
    return forge.overlap(maps.image_list(spark, sf_dir).withColumns(c), SIDE, SIDE)


@query(f"WITH {PX} SELECT image_id, 7 - x AS y, 7 - y AS x, least(255, greatest(0, g + 10)) AS g, 255 AS truth FROM px")
def simple_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F16: a whole image turned, mirrored and brightened."""
    return forge.simple_copy(maps.pixels(spark, sf_dir), SIDE, SIDE, 1, True, 10)


@query()
def tiles_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects covered by free background tiles."""
    px, gt = maps.pixels(spark, sf_dir), maps.truth(spark, sf_dir)
    objects = forge.pick_objects(S.label_components(gt), 2)
    tiles = R.free_tiles(maps.image_list(spark, sf_dir), gt, SIDE, SIDE, 2, 2)
    return forge.clean_by_tiles(px, objects, tiles, 2, 2)[0]


@query(
    f"""WITH RECURSIVE {PX}, gt AS (SELECT image_id, y, x, 1 AS label FROM px WHERE v > 0.18), {COMP}, b AS (SELECT image_id, c, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1 FROM comp GROUP BY ALL)
SELECT image_id, y, x, c AS component FROM comp WHERE (image_id, c) NOT IN (SELECT b.image_id, b.c FROM b JOIN comp o ON o.image_id = b.image_id AND o.c <> b.c AND o.y BETWEEN y0 - 1 AND y1 + 1 AND o.x BETWEEN x0 - 1 AND x1 + 1)"""
)
def isolated_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """objects with nothing else in their enlarged box."""
    objects = S.label_components(images.threshold(maps.pixels(spark, sf_dir), 0.18)).drop("label")
    return forge.isolated(objects, 1).select(*XY, "component")


@query()
def inpaint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bright objects filled from the rest of their image."""
    return forge.inpaint(_packed(spark, sf_dir), 165.0)


@query()
def poisson_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects moved with their gradients."""
    return forge.poisson_move(_packed(spark, sf_dir), 160.0, 2, 3)


_BLURRED = """{out} AS MATERIALIZED (SELECT a.image_id, a.y, a.x, avg(b.v) AS v FROM {of} a JOIN {of} b ON a.image_id = b.image_id AND b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1 GROUP BY ALL)"""


@query(
    f"""WITH {PX}, {GT}, bx AS (SELECT image_id, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1 FROM gt GROUP BY image_id),
s0 AS MATERIALIZED (SELECT px.image_id, y, x, g::DOUBLE AS v FROM px JOIN bx USING (image_id) WHERE y BETWEEN y0 AND y1 AND x BETWEEN x0 AND x1), {_BLURRED.format(out="s1", of="s0")}, {_BLURRED.format(out="s2", of="s1")},
sh AS (SELECT DISTINCT image_id, y + dy AS y, x + dx AS x FROM gt, (SELECT unnest([-3, -2, -1, 0, 1, 2, 3]) AS dy), (SELECT unnest([-3, -2, -1, 0, 1, 2, 3]) AS dx)),
ne AS (SELECT image_id, y, x, CAST(floor(round(v, 6) + 0.5) AS INT) AS g, 1 AS k FROM s2 SEMI JOIN sh USING (image_id, y, x) UNION ALL SELECT image_id, y, x, g, 0 FROM px)
SELECT image_id, y, x, arg_max(g, k) AS g FROM ne GROUP BY image_id, y, x"""
)
def retouch_blur(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects blurred twice within their box; all of an image's are one."""
    objects = maps.truth(spark, sf_dir).select(*XY, F.lit(1).alias("component"))
    return forge.forge("retouching_blurring", maps.pixels(spark, sf_dir), objects, SIDE, SIDE, radius=1, level=2)[0]


@query(f"WITH {PX} SELECT image_id, 1 AS crop, y - 1 AS y, x AS x, g, y >= 3 AND x >= 2 AS shared FROM px WHERE y BETWEEN 1 AND 5 AND x BETWEEN 0 AND 3 UNION ALL SELECT image_id, 2, y - 3, x - 2, g, y <= 5 AND x <= 3 FROM px WHERE y BETWEEN 3 AND 6 AND x BETWEEN 2 AND 6")
def overlap_crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two crops of each image, and which of their pixels both have."""
    px = maps.pixels(spark, sf_dir)
    out, truth = forge.forge("overlap_forgery", px, px.limit(0), SIDE, SIDE, first=(1, 0, 5, 4), second=(3, 2, 4, 5))
    return out.join(truth.withColumn("shared", F.lit(True)), ["image_id", "crop", "y", "x"], "left").withColumn("shared", F.coalesce("shared", F.lit(False)))


@query()
def seeded_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters of each image by a seed."""
    return forge.parameters(maps.image_list(spark, sf_dir), 5)


_NAMES = "['copy_move_forgery', 'retouching_contrast', 'cleaning_using_bf', 'unknown']"


@query(f"SELECT p_partkey, n.name, CASE WHEN n.name = 'copy_move_forgery' THEN 'duplication' WHEN n.name = 'retouching_contrast' THEN 'retouching' WHEN n.name = 'cleaning_using_bf' THEN 'cleaning' ELSE 'Not Implemented' END AS modality, p_size AS height FROM part, LATERAL (SELECT {_NAMES}[1 + p_partkey % 4] AS name) n")
def annotations_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotation documents, written and read again by field."""
    names = F.array(*[F.lit(n) for n in ("copy_move_forgery", "retouching_contrast", "cleaning_using_bf", "unknown")])
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("image_id"), F.element_at(names, (1 + F.col("p_partkey") % 4).cast("int")).alias("function_name"), F.col("p_size").alias("height"), F.lit(64).alias("width"), F.create_map(F.lit("alpha"), F.lit("1.5")).alias("args"))
    doc = F.from_json("annotation", "forgery_info struct<modality:string,function_name:string>, figure_annotations struct<height:int,image_id:string>")
    return forge.annotation(rows).select(doc.alias("d")).select(F.col("d.figure_annotations.image_id").cast("long").alias("p_partkey"), F.col("d.forgery_info.function_name").alias("name"), F.col("d.forgery_info.modality").alias("modality"), F.col("d.figure_annotations.height").alias("height"))


def _templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Template documents made from suppliers: two rows of three panels each."""
    text = lambda c: c.cast("string")
    panel = lambda r, k: F.concat(F.lit(f'"00{r * 3 + k + 1}":{{"bbox":{{"x0":'), text(F.lit(k / 4)), F.lit(',"x1":'), text(F.lit(k / 4 + 0.25)), F.lit(',"y0":'), text(F.lit(r / 2)), F.lit(',"y1":'), text(F.lit(r / 2 + 0.25)), F.lit('},"class":"'), F.when((F.col("s_suppkey") + r + k) % 3 == 0, "Graphs").when((F.col("s_suppkey") + k) % 2 == 0, "Microscopy").otherwise("WesternBlot"), F.lit('"}'))
    parts = [panel(r, k) for r in range(2) for k in range(3)]
    doc = F.concat(F.lit('{"orig_height":'), text(100 + F.col("s_suppkey") % 7 * 20), F.lit(',"orig_width":400,"aspect_rate":'), text(1 + (F.col("s_suppkey") % 4) / 4), F.lit(","), F.concat_ws(",", *parts), F.lit("}"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", doc.alias("doc"))


_TEMPLATE = """t AS (SELECT s_suppkey AS template, 100 + s_suppkey % 7 * 20 AS height, CAST(round_even((1 + (s_suppkey % 4) / 4.0::DOUBLE) * (100 + s_suppkey % 7 * 20), 0) AS INT) AS width FROM supplier),
panels AS (SELECT template, '00' || (r * 3 + k + 1) AS panel, CAST(height AS INT) AS height, width, CAST(floor(k / 4.0::DOUBLE * width) AS INT) AS x0, CAST(floor((k / 4.0::DOUBLE + 0.25) * width) AS INT) AS x1,
  CAST(floor(r / 2.0::DOUBLE * height) AS INT) AS y0, CAST(floor((r / 2.0::DOUBLE + 0.25) * height) AS INT) AS y1,
  CASE WHEN (template + r + k) % 3 = 0 THEN 'Graphs' WHEN (template + k) % 2 = 0 THEN 'Microscopy' ELSE 'WesternBlot' END AS class
  FROM t, (SELECT unnest(range(2)) AS r), (SELECT unnest(range(3)) AS k)),
rated AS (SELECT *, (x1 - x0) / (y1 - y0)::DOUBLE AS ratio FROM panels)"""


def _panels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.parse_templates(_templates(spark, sf_dir), "s_suppkey", "doc")


@query(f"WITH {_TEMPLATE} SELECT template, panel, height, width, x0, x1, y0, y1, class, round(ratio, 9) AS ratio FROM rated")
def template_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panels of template documents in pixels."""
    return _panels(spark, sf_dir).withColumn("ratio", F.round("ratio", 9))


@query(f"WITH {_TEMPLATE} SELECT template, count(*) AS fits FROM rated WHERE class = 'WesternBlot' AND abs(ratio - 1.5) <= 2 GROUP BY template HAVING count(*) >= 2")
def valid_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Templates with enough panels for a query image."""
    return P.valid_templates(_panels(spark, sf_dir), "WesternBlot", 1.5, 2)


@query(
    f"""WITH {_TEMPLATE} SELECT template, count(*) FILTER (WHERE class = 'WesternBlot' AND abs(ratio - 1.2) <= 2) AS donors, count(*) FILTER (WHERE class = 'Microscopy' AND abs(ratio - 2.0) <= 4) AS hosts,
count(*) FILTER (WHERE class = 'WesternBlot' AND abs(ratio - 1.2) <= 2 OR class = 'Microscopy' AND abs(ratio - 2.0) <= 4) AS either FROM rated GROUP BY template HAVING donors >= 1 AND hosts >= 1 AND either >= 2"""
)
def splice_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Templates with room for a donor and a host."""
    return P.splice_templates(_panels(spark, sf_dir), ("WesternBlot", 1.2), ("Microscopy", 2.0))


@query(f"WITH {_TEMPLATE}, m AS (SELECT a.template, a.panel, count(*) AS n FROM rated a JOIN rated b ON a.template = b.template AND a.class = b.class AND a.panel <> b.panel AND abs(a.ratio - b.ratio) <= 2 GROUP BY ALL) SELECT DISTINCT template FROM m WHERE n >= 2")
def panel_mates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H3: templates with three panels alike."""
    return P.has_mates(_panels(spark, sf_dir), 3)


@query(
    """WITH p AS (SELECT p_size AS sheet, p_partkey AS panel, 10 + p_partkey % 7 AS h, 12 + p_partkey % 5 AS w FROM part),
s AS (SELECT sheet, min(h) AS h, min(w) AS w, count(*) AS n FROM p GROUP BY sheet), r AS (SELECT sheet, panel, s.h, s.w, CAST(ceil(n / floor(sqrt(n))) AS BIGINT) AS per, row_number() OVER (PARTITION BY sheet ORDER BY panel) - 1 AS i FROM p JOIN s USING (sheet))
SELECT sheet, panel, i // per * (h + 4) + 2 AS y0, i % per * (w + 4) + 2 AS x0, h, w FROM r"""
)
def contact_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The places of panels on a sheet."""
    p = table(spark, sf_dir, "part").select(F.col("p_size").alias("sheet"), F.col("p_partkey").alias("panel"), (10 + F.col("p_partkey") % 7).alias("h"), (12 + F.col("p_partkey") % 5).alias("w"))
    return P.contact_sheet(p)


@query()
def picked_panels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One seeded panel of each template."""
    return P.pick_panel(_panels(spark, sf_dir), 1)


@query(
    f"""WITH {_TEMPLATE}, s AS (SELECT template, panel, height, width, 0 AS n, 'top' AS side, x0 AS a, x1 AS b, y0 - 8 AS c, y0 AS d FROM panels UNION ALL SELECT template, panel, height, width, 1, 'left', x0 - 8, x0, y0, y1 FROM panels
UNION ALL SELECT template, panel, height, width, 2, 'right', x1, x1 + 8, y0, y1 FROM panels UNION ALL SELECT template, panel, height, width, 3, 'bottom', x0, x1, y1, y1 + 8 FROM panels),
f AS (SELECT * FROM s WHERE a >= 0 AND c >= 0 AND b <= width AND d <= height AND NOT EXISTS (SELECT 1 FROM panels p WHERE p.template = s.template AND p.x0 < b AND a < p.x1 AND p.y0 < d AND c < p.y1))
SELECT f.template, f.panel, arg_min(side, n) AS side, any_value(l.caption) AS caption, any_value(k.number) AS number FROM f
JOIN (SELECT template, panel, chr(CAST(64 + row_number() OVER (PARTITION BY template ORDER BY y0, x0, panel) AS INT)) AS caption FROM panels SEMI JOIN f USING (template, panel)) l ON l.template = f.template AND l.panel = f.panel
JOIN (SELECT template, panel, CAST(dense_rank() OVER (PARTITION BY template ORDER BY first) AS INT) AS number FROM (SELECT *, min(panel) OVER (PARTITION BY template, class) AS first FROM panels)) k ON k.template = f.template AND k.panel = f.panel GROUP BY f.template, f.panel"""
)
def caption_strips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The free side for a caption, its letter among the panels that have one, and the panel's class number."""
    p = _panels(spark, sf_dir)
    sides = P.free_strip(p, 8)
    free = p.join(sides, ["template", "panel"], "left_semi")
    return sides.join(P.captions(free), ["template", "panel"]).join(P.class_numbers(p), ["template", "panel"])


_NARROW = "nar AS (SELECT template, panel, height, x0 + (template + CAST(right(panel, 1) AS INT)) % 3 * 6 AS x0, x1, y0, y1 FROM panels)"


@query(
    f"""WITH RECURSIVE {_TEMPLATE}, {_NARROW}, w AS (SELECT template, panel, y0 AS y, x0 - 5 AS x FROM nar s WHERE x0 - 5 >= 1 AND y0 + 5 <= height AND NOT EXISTS (SELECT 1 FROM nar p WHERE p.template = s.template AND p.x0 < s.x0 AND s.x0 - 5 < p.x1 AND p.y0 < s.y0 + 5 AND s.y0 < p.y1)),
o AS (SELECT *, row_number() OVER (PARTITION BY template ORDER BY panel) AS n FROM w),
r(template, n, kept) AS (SELECT DISTINCT template, 0::BIGINT, []::STRUCT(panel VARCHAR, y INT, x BIGINT)[] FROM o
  UNION ALL SELECT o.template, o.n, CASE WHEN len(list_filter(kept, lambda k: abs(k.x - o.x) < 5 AND abs(k.y - o.y) < 5)) = 0 THEN list_append(kept, struct_pack(panel := o.panel, y := o.y, x := CAST(o.x AS BIGINT))) ELSE kept END FROM r JOIN o ON o.template = r.template AND o.n = r.n + 1),
k AS (SELECT template, unnest(arg_max(kept, n)) AS k FROM r GROUP BY template)
SELECT template, k.panel AS panel, k.y AS y, CAST(k.x AS BIGINT) AS x, chr(CAST(64 + row_number() OVER (PARTITION BY template ORDER BY k.y, k.x) AS INT)) AS caption FROM k"""
)
def caption_corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters left of the upper corners of panels that have room there; every second and third panel is narrowed to make some."""
    p = _panels(spark, sf_dir).withColumn("x0", F.expr("x0 + (template + cast(right(panel, 1) AS int)) % 3 * 6"))
    return P.corner_captions(p, 5).withColumn("x", F.col("x").cast("long"))


@query(f"WITH {_TEMPLATE} SELECT template, panel, chr(CAST(97 + (row_number() OVER (PARTITION BY template ORDER BY x0, y0, panel) - 1) % 26 AS INT)) AS letter FROM panels WHERE class = 'Microscopy'")
def panel_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters inside microscopy panels, from left to right."""
    return P.panel_letters(_panels(spark, sf_dir))


@query(f"WITH {_TEMPLATE}, {PX} SELECT template, CAST(count(*) AS BIGINT) AS pixels, CAST(sum(g) AS BIGINT) AS total FROM panels r, LATERAL (SELECT unnest(range(y0, y1)) AS fy), LATERAL (SELECT unnest(range(x0, x1)) AS fx), px WHERE px.image_id = template % 50 AND px.y = CAST(floor((fy - y0) * 8 / (y1 - y0)::DOUBLE) AS INT) AND px.x = CAST(floor((fx - x0) * 8 / (x1 - x0)::DOUBLE) AS INT) GROUP BY template")
def figure_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures of resized panel images, for every template of the catalogue."""
    p = _panels(spark, sf_dir).withColumns({"image_id": F.col("template") % 50, "ih": F.lit(SIDE), "iw": F.lit(SIDE)})
    return P.place(p, maps.pixels(spark, sf_dir).select(*XY, "g")).groupBy("template").agg(F.count(F.lit(1)).alias("pixels"), F.sum("g").alias("total"))


@query(f"WITH {PX}, h AS (SELECT image_id, g // 16 AS bin, count(*) AS n FROM px GROUP BY ALL), m AS (SELECT image_id, arg_min(bin, -n * 1000 + bin) AS bin FROM h GROUP BY image_id) SELECT image_id, CAST(bin * 16 AS INT) AS mode, bin * 16 < 100 AS white_text FROM m")
def text_colour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """White letters on a dark modal value."""
    h = maps.pixels(spark, sf_dir).groupBy("image_id", F.expr("g div 16").alias("bin")).count()
    m = h.groupBy("image_id").agg(F.min_by("bin", F.struct(-F.col("count"), "bin")).alias("bin")).select("image_id", (F.col("bin") * 16).cast("int").alias("mode"))
    return m.withColumn("white_text", P.dark(F.col("mode")))


@query(
    f"""WITH RECURSIVE {PX}, {GT}, {COMP}, b AS (SELECT image_id, c, min(comp.y) AS y0, max(comp.y) AS y1, min(comp.x) AS x0, max(comp.x) AS x1, avg(g) AS m FROM comp JOIN px USING (image_id, y, x) GROUP BY image_id, c)
SELECT image_id, lpad(CAST(row_number() OVER (PARTITION BY image_id ORDER BY c) AS VARCHAR), 3, '0') AS panel, x0 / 8.0::DOUBLE AS x0, (x1 + 1) / 8.0::DOUBLE AS x1, y0 / 8.0::DOUBLE AS y0, (y1 + 1) / 8.0::DOUBLE AS y1, CASE WHEN m >= 160 THEN 'WesternBlot' ELSE 'Microscopy' END AS class FROM b"""
)
def template_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fractional panels from the components of a drawing."""
    c = S.label_components(maps.truth(spark, sf_dir)).join(maps.pixels(spark, sf_dir).select(*XY, "g"), XY)
    return P.extract_templates(c, SIDE, SIDE, 160)


@query(f"WITH {_TEMPLATE} SELECT template, panel, class, CAST(template % 50 AS VARCHAR) AS image_id, x0 FROM panels")
def figure_annotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A figure's annotation document, read again by panel."""
    p = _panels(spark, sf_dir)
    doc = P.annotation(p, p.select("template", "panel", (F.col("template") % 50).alias("image_id")))
    panel = "struct<bbox:struct<x0:int>,class:string,image_id:string>"
    rows = doc.select("template", F.explode(F.from_json("annotation", f"panels map<string,{panel}>")["panels"]).alias("panel", "p"))
    return rows.select("template", "panel", F.col("p.class").alias("class"), F.col("p.image_id").alias("image_id"), F.col("p.bbox.x0").alias("x0"))


@query(
    f"""WITH {PX}, m AS (SELECT image_id, y, x, y BETWEEN 2 AND 5 AS band, CASE WHEN y BETWEEN 2 AND 5 THEN 200 ELSE g END AS s FROM px)
SELECT image_id, y, x, CASE WHEN band AND x > 2 THEN CAST(floor((50 * 100 + s * 155) / 255.0::DOUBLE) AS INT) ELSE s END AS g, CASE WHEN band THEN 1 ELSE 0 END AS owner FROM m"""
)
def scene_splice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two layers blended in order, and who owns each pixel."""
    px = maps.pixels(spark, sf_dir).select(*XY, "g")
    band = px.filter("y BETWEEN 2 AND 5")
    one = band.select(*XY, F.lit(1).alias("layer"), F.lit(200).alias("g"), F.lit(255).alias("alpha"))
    two = band.filter("x > 2").select(*XY, F.lit(2).alias("layer"), F.lit(50).alias("g"), F.lit(100).alias("alpha"))
    out, owner = scenes.splice_layers(px, one.unionByName(two))
    return out.join(owner, XY, "left").fillna(0, ["owner"])


@query(
    f"""WITH {PX}, u AS (SELECT image_id, y, x, max(g) FILTER (k = 0) AS g, coalesce(max(g) FILTER (k = 1), -1000) AS s FROM (SELECT image_id, y, x, g, 0 AS k FROM px UNION ALL SELECT image_id, y + 4, x, g, 1 FROM px WHERE y < 4) GROUP BY image_id, y, x),
f AS (SELECT *, CASE WHEN y >= 4 AND x < 4 THEN s + x % 2 * 10 ELSE g END AS f FROM u) SELECT image_id, y, x, CASE WHEN abs(f - s) < 6 THEN 255 ELSE 128 END AS value FROM f WHERE f <> g"""
)
def scene_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels that copy a place, and those that only changed."""
    px = maps.pixels(spark, sf_dir).select(*XY, "g")
    source = px.select("image_id", (F.col("y") + 4).alias("y"), "x", F.col("g").alias("s"))
    forged = px.join(source, XY, "left").select(*XY, F.when((F.col("y") >= 4) & (F.col("x") < 4), F.col("s") + F.col("x") % 2 * 10).otherwise(F.col("g")).alias("g"))
    shift = maps.image_list(spark, sf_dir).select("image_id", F.lit(-4).alias("dy"), F.lit(0).alias("dx"))
    return scenes.copied_pixels(px, forged, shift)


@query("SELECT p_partkey, p_partkey % 90 - (((p_partkey % 90 - p_size) % 4) + 4) % 4 AS aligned, 'img' || CASE WHEN p_size % 3 <> 0 THEN '_r' || (p_size % 3) ELSE '' END || CASE WHEN 90 + p_size % 11 <> 100 THEN '_s' || (90 + p_size % 11) ELSE '' END || '.png' AS name FROM part")
def scene_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aligned insert positions, and file names that tell the parameters."""
    part = table(spark, sf_dir, "part")
    return part.select("p_partkey", scenes.aligned(F.col("p_partkey") % 90, F.col("p_size"), 4).alias("aligned"), scenes.output_name(F.lit("img"), F.col("p_size") % 3, 90 + F.col("p_size") % 11, F.lit(0)).alias("name"))


@query()
def scene_degraded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest scaling and seeded noise, with random blocks planned."""
    px = scenes.noisy(scenes.scaled_nearest(maps.pixels(spark, sf_dir).select(*XY, "g"), 2), 5.0)
    plan = scenes.random_blocks(maps.image_list(spark, sf_dir), 16, 16, 4, 3)
    return px.join(plan.groupBy("image_id").agg(F.count(F.lit(1)).alias("blocks")), "image_id", "left")


def _first_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = S.label_components(maps.truth(spark, sf_dir))
    return parts.join(parts.groupBy("image_id").agg(F.min("component").alias("component")), ["image_id", "component"], "left_semi")


@query(
    f"""WITH RECURSIVE {PX}, {GT}, {COMP}, obj AS (SELECT image_id, y, x FROM comp WHERE (image_id, c) IN (SELECT image_id, min(c) FROM comp GROUP BY image_id)),
box AS (SELECT image_id, min(y) AS y0, min(x) AS x0, max(y) - min(y) + 1 AS h, max(x) - min(x) + 1 AS w FROM obj GROUP BY image_id),
t AS (SELECT *, greatest(1, w * 3 // 2) AS nh, greatest(1, h * 3 // 2) AS nw FROM box),
spots AS (SELECT image_id, y0 + h - 1 - c * h // nw AS sy, x0 + w - 1 - r * w // nh AS sx, y0 + 2 + r AS y, x0 + 1 + c AS x FROM t, (SELECT CAST(unnest(range(12)) AS INT) AS r), (SELECT CAST(unnest(range(12)) AS INT) AS c) WHERE r < nh AND c < nw),
landed AS (SELECT a.* FROM spots a JOIN obj s ON s.image_id = a.image_id AND s.y = sy AND s.x = sx WHERE a.y <= 7 AND a.x <= 7 AND NOT EXISTS (SELECT 1 FROM obj o WHERE o.image_id = a.image_id AND o.y = a.y AND o.x = a.x)),
copied AS (SELECT l.image_id, l.y, l.x, p.g FROM landed l JOIN px p ON p.image_id = l.image_id AND p.y = sy AND p.x = sx),
source AS (SELECT DISTINCT image_id, sy AS y, sx AS x FROM landed)
SELECT p.image_id, p.y, p.x, coalesce(c.g, p.g) AS g, CASE WHEN c.g IS NOT NULL THEN 'copy' WHEN s.y IS NOT NULL THEN 'source' ELSE 'none' END AS part
FROM px p LEFT JOIN copied c ON c.image_id = p.image_id AND c.y = p.y AND c.x = p.x LEFT JOIN source s ON s.image_id = p.image_id AND s.y = p.y AND s.x = p.x"""
)
def copy_move_turned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An object mirrored, turned, scaled and pasted, with the sampled pixels as its source."""
    out, truth = forge.forge("copy_move_forgery", maps.pixels(spark, sf_dir), _first_object(spark, sf_dir), SIDE, SIDE, dy=2, dx=1, turns=1, mirrored=True, up=3, down=2)
    return out.join(truth, XY, "left").withColumn("part", F.coalesce("part", F.lit("none")))


_A, _B = forge.rotation_units(30, 1.25)


@query(
    f"""WITH RECURSIVE {PX}, {GT}, {COMP}, obj AS (SELECT image_id, y, x FROM comp WHERE (image_id, c) IN (SELECT image_id, min(c) FROM comp GROUP BY image_id)),
box AS (SELECT image_id, CAST(min(y) + max(y) AS BIGINT) AS cy, CAST(min(x) + max(x) AS BIGINT) AS cx FROM obj GROUP BY image_id),
turned AS (SELECT p.image_id, p.y, p.x, cy, cx, 2 * (p.y - 1) - cy AS u, 2 * (p.x - 2) - cx AS v FROM px p JOIN box USING (image_id)),
spots AS (SELECT image_id, y, x, CAST(floor((cy * 65536 + u * {_A} - v * {_B} + 65536) / 131072::DOUBLE) AS INT) AS sy, CAST(floor((cx * 65536 + v * {_A} + u * {_B} + 65536) / 131072::DOUBLE) AS INT) AS sx FROM turned),
landed AS (SELECT a.* FROM spots a JOIN obj s ON s.image_id = a.image_id AND s.y = sy AND s.x = sx WHERE NOT EXISTS (SELECT 1 FROM obj o WHERE o.image_id = a.image_id AND o.y = a.y AND o.x = a.x)),
copied AS (SELECT l.image_id, l.y, l.x, p.g FROM landed l JOIN px p ON p.image_id = l.image_id AND p.y = sy AND p.x = sx),
source AS (SELECT DISTINCT image_id, sy AS y, sx AS x FROM landed)
SELECT p.image_id, p.y, p.x, coalesce(c.g, p.g) AS g, CASE WHEN c.g IS NOT NULL THEN 'copy' WHEN s.y IS NOT NULL THEN 'source' ELSE 'none' END AS part
FROM px p LEFT JOIN copied c ON c.image_id = p.image_id AND c.y = p.y AND c.x = p.x LEFT JOIN source s ON s.image_id = p.image_id AND s.y = p.y AND s.x = p.x"""
)
def copy_move_rotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An object turned by 30 degrees, scaled by 5 / 4 and pasted."""
    out, truth = forge.forge("copy_move_forgery", maps.pixels(spark, sf_dir), _first_object(spark, sf_dir), SIDE, SIDE, types=("rotation",), dy=1, dx=2, degrees=30, scale=1.25)
    return out.join(truth, XY, "left").withColumn("part", F.coalesce("part", F.lit("none")))


_TILED = f"""WITH RECURSIVE {PX}, {GT}, {COMP}, box AS (SELECT image_id, c, min(y) AS y0, min(x) AS x0 FROM comp GROUP BY ALL HAVING max(y) - min(y) < 2 AND max(x) - min(x) < 2),
a AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY c) AS n FROM box),
tiles AS (SELECT image_id, ty, tx FROM (SELECT DISTINCT image_id FROM px), (SELECT CAST(unnest([0, 2, 4, 6]) AS INT) AS ty), (SELECT CAST(unnest([0, 2, 4, 6]) AS INT) AS tx)),
free AS (SELECT t.*, row_number() OVER (PARTITION BY image_id ORDER BY ty, tx) AS n FROM tiles t WHERE NOT EXISTS (SELECT 1 FROM gt g WHERE g.image_id = t.image_id AND g.y BETWEEN ty AND ty + 1 AND g.x BETWEEN tx AND tx + 1)),
moved AS (SELECT o.image_id AS donor, o.y, o.x, f.image_id AS host, o.y + ty - y0 AS my, o.x + tx - x0 AS mx, a.n, p.g FROM comp o JOIN a USING (image_id, c) JOIN free f ON f.n = a.n AND f.image_id = a.image_id + :step JOIN px p ON p.image_id = o.image_id AND p.y = o.y AND p.x = o.x WHERE a.n <= 2)
SELECT p.image_id, p.y, p.x, coalesce(m.g, p.g) AS g, coalesce(CAST(m.n AS INT), 0) AS copied, coalesce(CAST(s.n AS INT), 0) AS taken FROM px p LEFT JOIN moved m ON m.host = p.image_id AND m.my = p.y AND m.mx = p.x LEFT JOIN moved s ON s.donor = p.image_id AND s.y = p.y AND s.x = p.x"""


def _tiled(out: DataFrame, truth: DataFrame) -> DataFrame:
    part = lambda kind, name: truth.filter(F.col("part") == kind).select(*XY, F.col("index").alias(name))
    return out.join(part("copy", "copied"), XY, "left").join(part("source", "taken"), XY, "left").fillna(0, ["copied", "taken"])


@query(_TILED.replace(":step", "0"))
def copy_move_to_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """two objects of each image in free tiles of it, with the index that source and copy share."""
    return _tiled(*forge.random_copy_move(maps.pixels(spark, sf_dir), S.label_components(maps.truth(spark, sf_dir)), SIDE, SIDE, 2, 2, 2))


@query(_TILED.replace(":step", "1"))
def splicing_to_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """two objects of each image in free tiles of the next."""
    px, parts = maps.pixels(spark, sf_dir), S.label_components(maps.truth(spark, sf_dir))
    pairs = maps.image_list(spark, sf_dir).select(F.col("image_id").alias("donor"), (F.col("image_id") + 1).alias("host"))
    return _tiled(*forge.splice_to_tiles(px, parts, px, parts, pairs, SIDE, SIDE, 2, 2, 2))


@query(
    f"""WITH {_TEMPLATE}, {PX}, ranked AS (SELECT *, row_number() OVER (PARTITION BY template, class ORDER BY panel) AS n FROM panels),
chosen AS (SELECT template, arg_min(class, panel) AS own FROM ranked WHERE n = 2 GROUP BY template),
roles AS (SELECT r.*, CASE WHEN class = own AND n <= 2 THEN n ELSE 0 END AS role FROM ranked r JOIN chosen USING (template)),
shown AS (SELECT *, CASE WHEN role > 0 THEN template % 50 ELSE (template + CAST(panel AS INT)) % 50 END AS image_id FROM roles),
fig AS (SELECT s.template, s.role, v > 0.15 AS marked, CASE WHEN role = 2 AND v > 0.15 THEN least(255, g + 30) ELSE g END AS g FROM shown s, LATERAL (SELECT unnest(range(y0, y1)) AS fy), LATERAL (SELECT unnest(range(x0, x1)) AS fx), px
  WHERE px.image_id = s.image_id AND px.y = CAST(floor((fy - y0) * 8 / (y1 - y0)::DOUBLE) AS INT) AND px.x = CAST(floor((fx - x0) * 8 / (x1 - x0)::DOUBLE) AS INT))
SELECT template, count(*) AS pixels, CAST(sum(g) AS BIGINT) AS total, count(*) FILTER (WHERE role = 1 AND marked) AS sources, count(*) FILTER (WHERE role = 2 AND marked) AS copies FROM fig GROUP BY template"""
)
def inter_panel_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures that show an image and its retouched copy in two panels alike, with the ground truth of both."""
    p = _panels(spark, sf_dir)
    role = P.mates(p).select("template", "panel", "role")
    image = F.when(F.col("role") != "filler", F.col("template") % 50).otherwise((F.col("template") + F.col("panel").cast("int")) % 50)
    shown = role.select("template", "panel", image.alias("image_id"), F.lit(SIDE).alias("ih"), F.lit(SIDE).alias("iw"))
    px, gt = maps.pixels(spark, sf_dir).select(*XY, "g"), maps.truth(spark, sf_dir)
    forged = px.join(gt.select(*XY, F.lit(30).alias("more")), XY, "left").select(*XY, R.brighten(F.col("g"), F.coalesce("more", F.lit(0))).alias("g"))
    figure, truth = P.inter_panel(p, shown, px, forged, gt)
    counts = truth.groupBy("template").agg(F.count_if(F.col("part") == "source").alias("sources"), F.count_if(F.col("part") == "copy").alias("copies"))
    return figure.groupBy("template").agg(F.count(F.lit(1)).alias("pixels"), F.sum("g").alias("total")).join(counts, "template", "left").fillna(0, ["sources", "copies"])


@query(
    f"""WITH {_TEMPLATE}, {PX}, ch AS (SELECT template, min(panel) AS panel FROM rated WHERE class = 'Microscopy' AND abs(ratio - 1) <= 4 GROUP BY template),
shown AS (SELECT p.*, p.panel = ch.panel AS own, (template + CAST(p.panel AS INT)) % 50 AS image_id FROM panels p JOIN ch USING (template)),
mv AS (SELECT image_id, y AS sy, x AS sx, y + 3 AS y, x + 2 AS x, g FROM px WHERE v > 0.15 AND y <= 4 AND x <= 5),
ld AS MATERIALIZED (SELECT * FROM mv WHERE (image_id, y, x) NOT IN (SELECT image_id, y, x FROM px WHERE v > 0.15)),
fo AS (SELECT image_id, y, x, arg_max(g, k) AS g FROM (SELECT image_id, y, x, g, 0 AS k FROM px UNION ALL SELECT image_id, y, x, g, 1 FROM ld) GROUP BY image_id, y, x),
ce AS MATERIALIZED (SELECT template, own, image_id, CAST(floor((fy - y0) * 8 / (y1 - y0)::DOUBLE) AS INT) AS y, CAST(floor((fx - x0) * 8 / (x1 - x0)::DOUBLE) AS INT) AS x FROM shown, LATERAL (SELECT unnest(range(y0, y1)) AS fy), LATERAL (SELECT unnest(range(x0, x1)) AS fx)),
fig AS (SELECT template, count(*) AS pixels, CAST(sum(CASE WHEN own THEN fo.g ELSE px.g END) AS BIGINT) AS total FROM ce JOIN px USING (image_id, y, x) JOIN fo USING (image_id, y, x) GROUP BY template),
be AS (SELECT template, count(*) AS before FROM ce JOIN (SELECT image_id, sy AS y, sx AS x FROM ld) USING (image_id, y, x) WHERE own GROUP BY template),
af AS (SELECT template, count(*) AS after FROM ce JOIN (SELECT image_id, y, x FROM ld) USING (image_id, y, x) WHERE own GROUP BY template)
SELECT template, pixels, total, coalesce(before, 0) AS before, coalesce(after, 0) AS after FROM fig LEFT JOIN be USING (template) LEFT JOIN af USING (template)"""
)
def intra_panel_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures of which one microscopy panel shows an image with objects copied within it, with the ground truth of both ends."""
    p, px = _panels(spark, sf_dir), maps.pixels(spark, sf_dir)
    shown = p.select("template", "panel", ((F.col("template") + F.col("panel").cast("int")) % 50).alias("image_id"), F.lit(SIDE).alias("ih"), F.lit(SIDE).alias("iw"))
    of_figures = px.join(durable(shown.select("image_id").distinct(), "shown"), "image_id", "left_semi")  # images that no figure shows need no forgery
    forged, truth = forge.copy_move(of_figures, images.threshold(of_figures, 0.15), F.lit(3), F.lit(2), SIDE, SIDE)
    chosen = P.fitting_panel(p, "Microscopy", 1.0, 4.0)
    figure, marks = P.intra_panel(p, chosen, shown, px.select(*XY, "g"), forged, truth.filter("part = 'source'"), truth.filter("part = 'copy'"))
    counts = marks.groupBy("template").agg(F.count_if(F.col("part") == "before").alias("before"), F.count_if(F.col("part") == "after").alias("after"))
    return figure.groupBy("template").agg(F.count(F.lit(1)).alias("pixels"), F.sum("g").alias("total")).join(counts, "template", "left").fillna(0, ["before", "after"])


_STEPS = "lg AS (SELECT image_id, s AS step, CASE s WHEN 1 THEN 15.0 + image_id % 4 * 20 ELSE 0.0 END::DOUBLE AS degrees, CASE s WHEN 1 THEN 1.0 WHEN 2 THEN 1.3 ELSE 0.9 END::DOUBLE AS factor, 3.5::DOUBLE AS cy, 3.0 + s * 0.25::DOUBLE AS cx FROM (SELECT DISTINCT image_id FROM px), (SELECT unnest([1, 2, 3]) AS s))"


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = maps.image_list(spark, sf_dir).withColumn("step", F.explode(F.array(*[F.lit(i) for i in (1, 2, 3)])))
    degrees = F.when(F.col("step") == 1, 15.0 + F.col("image_id") % 4 * 20).otherwise(0.0)
    factor = F.when(F.col("step") == 1, 1.0).when(F.col("step") == 2, 1.3).otherwise(0.9)
    return rows.select("image_id", "step", degrees.alias("degrees"), factor.alias("factor"), F.lit(3.5).alias("cy"), (3.0 + F.col("step") * 0.25).alias("cx"))


@query(
    f"""WITH {PX}, {_STEPS}, m AS (SELECT image_id, step, factor * cos(radians(degrees)) AS c, factor * sin(radians(degrees)) AS s, cy, cx FROM lg),
i AS (SELECT image_id, step, c / (c * c + s * s) AS c, s / (c * c + s * s) AS s, cy, cx FROM m),
p3 AS (SELECT f.image_id, f.y, f.x, cx + c * (f.x - cx) + s * (f.y - cy) AS u, cy - s * (f.x - cx) + c * (f.y - cy) AS v FROM (SELECT image_id, y, x FROM px) f JOIN i USING (image_id) WHERE step = 3),
p2 AS (SELECT p3.image_id, y, x, cx + c * (u - cx) + s * (v - cy) AS u, cy - s * (u - cx) + c * (v - cy) AS v FROM p3 JOIN i USING (image_id) WHERE step = 2),
p1 AS (SELECT p2.image_id, y, x, CAST(round_even(round(cx + c * (u - cx) + s * (v - cy), 6), 0) AS INT) AS sx, CAST(round_even(round(cy - s * (u - cx) + c * (v - cy), 6), 0) AS INT) AS sy FROM p2 JOIN i USING (image_id) WHERE step = 1)
SELECT p1.image_id, p1.y, p1.x, g FROM p1 JOIN px ON px.image_id = p1.image_id AND px.y = sy AND px.x = sx"""
)
def scene_replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images under a log of a turn and two scalings, replayed as one transform; SQL goes back step by step."""
    return scenes.replayed(maps.pixels(spark, sf_dir).select(*XY, "g"), scenes.composed(_log(spark, sf_dir)), SIDE, SIDE)
