"""Boxes, pictures and token grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenweave.functions import arrays as A
from lumenweave.functions import boxes as B
from lumenweave.operators import curation
from lumenweave.storage import read_tables

from .registry import Registry

R = Registry()
QUERIES, ORACLE, q = R.queries, R.oracle, R.query

_KEY = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"
_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
_Q, _P, _D, _T = "l_quantity", "l_extendedprice / 1000", "l_discount * 100", "l_tax * 100"


def _line(spark, folder, *columns):
    (l,) = read_tables(spark, folder, "lineitem")
    return l.select(*_KEYS, *columns)


def _box():
    return F.array(F.col("l_quantity"), F.expr("l_extendedprice / 1000"), F.expr("l_discount * 100"), F.expr("l_tax * 100"))


def _flat(box, *names):
    return [F.round(F.get(box, F.lit(i)), 6).alias(n) for i, n in enumerate(names)]


def _sql(select: str) -> str:
    return f"SELECT {_KEY}, {select} FROM lineitem"


@q("box_xywh_xyxy", _sql(f"round({_Q}, 6) AS x1, round({_P}, 6) AS y1, round({_Q} + {_D}, 6) AS x2, round({_P} + {_T}, 6) AS y2"))
def _(spark, folder):
    return _line(spark, folder, *_flat(B.xywh_to_xyxy(_box()), "x1", "y1", "x2", "y2"))


@q("box_xyxy_xywh", _sql(f"round({_Q}, 6) AS x, round({_P}, 6) AS y, round({_D} - {_Q}, 6) AS w, round({_T} - {_P}, 6) AS h"))
def _(spark, folder):
    return _line(spark, folder, *_flat(B.xyxy_to_xywh(_box()), "x", "y", "w", "h"))


@q("box_center_angle", _sql(f"round({_Q} + {_D} / 2, 6) AS cx, round({_P} + {_T} / 2, 6) AS cy, round({_D}, 6) AS w, round({_T}, 6) AS h, 0.0::DOUBLE AS angle"))
def _(spark, folder):
    return _line(spark, folder, *_flat(B.xywh_to_xywha(_box()), "cx", "cy", "w", "h", "angle"))


_HW = f"((abs(cos(radians({_Q}))) * {_D} + abs(sin(radians({_Q}))) * {_T}) / 2)"


@q("box_rotated", _sql(f"round({_P} - {_HW}, 6) AS x1, round({_P} + {_HW}, 6) AS x2"))
def _(spark, folder):
    box = B.xywha_to_xyxy(F.array(F.expr(_P), F.lit(0.0), F.expr(_D), F.expr(_T), F.col("l_quantity")))
    return _line(spark, folder, F.round(box[0], 6).alias("x1"), F.round(box[2], 6).alias("x2"))


_A = ("l_quantity", "0.0", "l_quantity + 20", "l_discount * 1000 + 1")
_B = ("l_quantity + l_tax * 100", "l_discount * 100", "l_quantity + 25", "60.0")
_INTER = f"(greatest(least({_A[2]}, {_B[2]}) - greatest({_A[0]}, {_B[0]}), 0) * greatest(least({_A[3]}, {_B[3]}) - greatest({_A[1]}, {_B[1]}), 0))"
_AREA = [f"(({x[2]}) - ({x[0]})) * (({x[3]}) - ({x[1]}))" for x in (_A, _B)]
_IOU = f"({_INTER} / ({_AREA[0]} + {_AREA[1]} - {_INTER}))"


def _array(parts):
    return F.array(*[F.expr(p).cast("double") for p in parts])


@q("iou", _sql(f"round({_IOU}, 6) AS overlap, round({_AREA[0]}, 6) AS area"))
def _(spark, folder):
    return _line(spark, folder, F.round(B.iou(_array(_A), _array(_B)), 6).alias("overlap"), F.round(B.area(_array(_A)), 6).alias("area"))


@q("iou_accuracy", f"SELECT round(avg(CASE WHEN {_IOU} > 0.5 THEN 1.0 ELSE 0.0 END) * 100, 2) AS accuracy FROM lineitem")
def _(spark, folder):
    from lumenweave.operators.metrics import accuracy

    (l,) = read_tables(spark, folder, "lineitem")
    return accuracy(l, F.coalesce(B.iou(_array(_A), _array(_B)) > 0.5, F.lit(False)))


def _clip_sql(v: str, most: str) -> str:
    return f"least(greatest({v}, 0), {most})"


@q("box_clip", _sql(f"round({_clip_sql(_Q, '30')}, 6) AS x1, round({_clip_sql(_P, '40')}, 6) AS y1, round({_clip_sql(_D, '30')}, 6) AS x2, round({_clip_sql(_T, '40')}, 6) AS y2"))
def _(spark, folder):
    return _line(spark, folder, *_flat(B.clip(_box(), F.lit(40), F.lit(30)), "x1", "y1", "x2", "y2"))


@q("box_inside", _sql(f"({_Q} >= -1 AND {_P} >= -1 AND {_D} < 31 AND {_T} < 41) AS inside, ({_D} - {_Q} > 0 AND {_T} - {_P} > 0) AS nonempty"))
def _(spark, folder):
    return _line(spark, folder, B.inside(_box(), F.lit(40), F.lit(30), 1.0).alias("inside"), B.nonempty(_box()).alias("nonempty"))


@q("box_center_scale", _sql(f"round(({_Q} + {_D}) / 2, 6) AS cx, round(({_P} + {_T}) / 2, 6) AS cy, round({_Q} * 2, 6) AS x1, round({_T} * 3, 6) AS y2"))
def _(spark, folder):
    c, s = B.center(_box()), B.scale(_box(), F.lit(2.0), F.lit(3.0))
    return _line(spark, folder, F.round(c[0], 6).alias("cx"), F.round(c[1], 6).alias("cy"), F.round(s[0], 6).alias("x1"), F.round(s[3], 6).alias("y2"))


@q("box_quantize", _sql("round_even(l_quantity / 50.0 * 999, 0)::INTEGER AS x1, round_even(l_discount * 100 / 100.0 * 999, 0)::INTEGER AS y1"))
def _(spark, folder):
    b = B.quantize(F.array(F.col("l_quantity"), F.expr("l_discount * 100"), F.lit(0.0), F.lit(0.0)), 1000, F.lit(100), F.lit(50))
    return _line(spark, folder, b[0].alias("x1"), b[1].alias("y1"))


@q("box_dequantize", _sql("round(l_linenumber / 999.0 * 640, 6) AS x1, round(l_quantity / 999.0 * 480, 6) AS y1"))
def _(spark, folder):
    b = B.dequantize(F.array(F.col("l_linenumber").cast("double"), F.col("l_quantity"), F.lit(0.0), F.lit(0.0)), 1000, F.lit(480), F.lit(640))
    return _line(spark, folder, F.round(b[0], 6).alias("x1"), F.round(b[1], 6).alias("y1"))


@q("box_clamp", _sql("round(greatest(l_quantity - 25, 0), 6) AS x, round(least(l_extendedprice / 1000, 30), 6) AS w, round(least(l_extendedprice / 2000, 20), 6) AS h"))
def _(spark, folder):
    b = B.clamp_xywh(F.array(F.expr("l_quantity - 25"), F.lit(-1.0), F.expr(_P), F.expr("l_extendedprice / 2000")), F.lit(30), F.lit(20))
    return _line(spark, folder, F.round(b[0], 6).alias("x"), F.round(b[2], 6).alias("w"), F.round(b[3], 6).alias("h"))


@q(
    "box_normalize",
    """SELECT DISTINCT image_id, round(10.0 / nullif(width, 0), 6) AS x, round(20.0 / nullif(height, 0), 6) AS y, round(0.5::DOUBLE * width, 6) AS px, round(0.25::DOUBLE * height, 6) AS py FROM images WHERE width IS NOT NULL AND height IS NOT NULL""",
)
def _(spark, folder):
    (i,) = read_tables(spark, folder, "images")
    n = B.normalize(F.array(F.lit(10.0), F.lit(20.0), F.lit(10.0), F.lit(20.0)), F.col("width"), F.col("height"))
    p = B.denormalize(F.array(F.lit(0.5), F.lit(0.25), F.lit(0.5), F.lit(0.25)), F.col("width"), F.col("height"))
    rows = i.filter("width IS NOT NULL AND height IS NOT NULL")
    return rows.select("image_id", F.round(n[0], 6).alias("x"), F.round(n[1], 6).alias("y"), F.round(p[0], 6).alias("px"), F.round(p[1], 6).alias("py")).distinct()


@q("resize_target", "SELECT DISTINCT width, height, least(336, (ceil(width / 14.0) * 14)::INTEGER) AS w, least(336, (ceil(height / 14.0) * 14)::INTEGER) AS h FROM images WHERE width IS NOT NULL AND height IS NOT NULL")
def _(spark, folder):
    (i,) = read_tables(spark, folder, "images")
    rows = i.filter("width IS NOT NULL AND height IS NOT NULL")
    return rows.select("width", "height", B.resize_target(F.col("width"), 336, 14, variable=True).alias("w"), B.resize_target(F.col("height"), 336, 14, variable=True).alias("h")).distinct()


@q("min_size_filter", "SELECT DISTINCT image_id, width, height FROM images WHERE least(width, height) >= 400 AND width IS NOT NULL AND height IS NOT NULL")
def _(spark, folder):
    (i,) = read_tables(spark, folder, "images")
    return i.filter(curation.min_size(F.col("width"), F.col("height"), least=400)).select("image_id", "width", "height").distinct()


@q(
    "area_filter",
    """WITH once AS (SELECT DISTINCT ON (record_id) * FROM records)
    SELECT record_id, count(*) AS n_regions, count(*) FILTER (r.bbox[3]::DOUBLE * r.bbox[4]::DOUBLE <= 16384) AS n_small FROM (SELECT record_id, unnest(region) AS r FROM once) WHERE r IS NOT NULL AND len(r.bbox) = 4 GROUP BY record_id""",
)
def _(spark, folder):
    (r,) = read_tables(spark, folder, "records")
    whole = F.filter("region", lambda x: x.isNotNull() & (F.size(x["bbox"]) == 4))
    sized = F.transform(whole, lambda x: F.struct(x["bbox"][2].cast("double").alias("w"), x["bbox"][3].cast("double").alias("h")))
    rows = r.dropDuplicates(["record_id"]).select("record_id", sized.alias("b")).filter(F.size("b") > 0)
    return rows.select("record_id", F.size("b").cast("long").alias("n_regions"), F.size(curation.small_area(F.col("b"))).cast("long").alias("n_small"))


_VEC = "embedding"


@q(
    "patchify",
    "SELECT vec_id, round(embedding[1]::DOUBLE, 5) AS p0_0, round(embedding[9]::DOUBLE, 5) AS p0_2, round(embedding[3]::DOUBLE, 5) AS p1_0, round(embedding[64]::DOUBLE, 5) AS p15_3, 16 AS n_patches FROM embeddings",
)
def _(spark, folder):
    (e,) = read_tables(spark, folder, "embeddings")
    rows = e.select("vec_id", A.patchify(F.col(_VEC), 8, 8, 2).alias("p"))
    at = lambda i, j, n: F.round(F.col("p")[i][j].cast("double"), 5).alias(n)
    return rows.select("vec_id", at(0, 0, "p0_0"), at(0, 2, "p0_2"), at(1, 0, "p1_0"), at(15, 3, "p15_3"), F.size("p").alias("n_patches"))


@q("normalize_pixels", "SELECT vec_id, i AS pos, round((embedding[i + 1]::DOUBLE / 255 - 0.48) / 0.27, 6) AS v FROM embeddings, range(0, 64) AS t(i)")
def _(spark, folder):
    (e,) = read_tables(spark, folder, "embeddings")
    rows = e.select("vec_id", F.posexplode(A.normalize_pixels(F.col(_VEC), F.lit(0.48), F.lit(0.27))).alias("pos", "v"))
    return rows.select("vec_id", F.col("pos").cast("long").alias("pos"), F.round("v", 6).alias("v"))


_WEIGHTS = "w{0} AS (SELECT j, x, g / sum(g) OVER (PARTITION BY j) AS g FROM (SELECT j, x, greatest(0.0, 1 - abs(x + 0.5 - (j + 0.5) * 8 / {0}) / greatest(8.0 / {0}, 1)) AS g FROM range(0, {0}) AS a(j), range(0, 8) AS b(x)))"


@q(
    "resize_pixels",
    f"""WITH {_WEIGHTS.format(4)}, {_WEIGHTS.format(12)}, p AS (SELECT vec_id, i // 8 AS y, i % 8 AS x, embedding[i + 1]::DOUBLE AS v FROM embeddings, range(0, 64) AS t(i)),
    r AS (SELECT vec_id, y, w12.j AS j, sum(v * g) AS v FROM p JOIN w12 USING (x) GROUP BY vec_id, y, w12.j)
    SELECT vec_id, w4.j * 12 + r.j AS pos, round(sum(v * g), 6) + 0 AS v FROM r JOIN w4 ON w4.x = r.y GROUP BY vec_id, w4.j, r.j""",
)
def _(spark, folder):
    """Fewer rows and more columns: 8 by 8 to 4 by 12."""
    (e,) = read_tables(spark, folder, "embeddings")
    made = A.resize_pixels(F.col(_VEC), F.lit(8), F.lit(8), F.lit(4), F.lit(12))
    rows = e.select("vec_id", F.posexplode(made).alias("pos", "v"))
    return rows.select("vec_id", F.col("pos").cast("long").alias("pos"), (F.round("v", 6) + F.lit(0.0)).alias("v"))


@q("channel_first", "SELECT vec_id, i AS pos, round(embedding[(i % 16) * 4 + i // 16 + 1]::DOUBLE, 6) AS v FROM embeddings, range(0, 64) AS t(i)")
def _(spark, folder):
    (e,) = read_tables(spark, folder, "embeddings")
    rows = e.select("vec_id", F.posexplode(A.hwc_to_chw(F.col(_VEC), 4, 4, 4)).alias("pos", "v"))
    return rows.select("vec_id", F.col("pos").cast("long").alias("pos"), F.round(F.col("v").cast("double"), 6).alias("v"))


@q("pad_image", "SELECT vec_id, 100 AS n, round(embedding[64]::DOUBLE, 6) AS last_pixel, 1.0::DOUBLE AS corner FROM embeddings")
def _(spark, folder):
    (e,) = read_tables(spark, folder, "embeddings")
    p = A.pad_image(F.transform(_VEC, lambda v: v.cast("double")), 8, 8, 10)
    return e.select("vec_id", F.size(p).alias("n"), F.round(p[77], 6).alias("last_pixel"), F.element_at(p, -1).alias("corner"))


@q(
    "image_tokens",
    """SELECT DISTINCT height // 14 AS n_rows, width // 14 AS n_columns, (height // 14) * (width // 14 + 1) + 1 AS n_tokens, (height // 14) * (width // 14) AS n_patches
    FROM images WHERE width >= 14 AND height >= 14""",
)
def _(spark, folder):
    (i,) = read_tables(spark, folder, "images")
    grid = i.filter("width >= 14 AND height >= 14").select(F.expr("height div 14").alias("n_rows"), F.expr("width div 14").alias("n_columns")).distinct()
    tokens = A.image_tokens(F.col("n_rows"), F.col("n_columns"))
    return grid.select("n_rows", "n_columns", F.size(tokens).cast("long").alias("n_tokens"), F.size(F.filter(tokens, lambda t: t == A.IMAGE_TOKEN)).cast("long").alias("n_patches"))


@q("number_of_patches", "SELECT DISTINCT width // 10 * 10 AS w, height // 10 * 10 AS h, (width // 10) * (height // 10) AS n FROM images WHERE width IS NOT NULL AND height IS NOT NULL")
def _(spark, folder):
    (i,) = read_tables(spark, folder, "images")
    sizes = i.filter("width IS NOT NULL AND height IS NOT NULL").select(F.expr("width div 10 * 10").alias("w"), F.expr("height div 10 * 10").alias("h")).distinct()
    return sizes.select("w", "h", A.number_of_patches(F.col("h"), F.col("w"), 10).cast("long").alias("n"))


@q(
    "topk_filter",
    "SELECT vec_id, count(*) AS n_kept, round(min(v), 6) AS least FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS v, list_sort(embedding, 'DESC')[5]::DOUBLE AS k FROM embeddings) WHERE v >= k GROUP BY vec_id",
)
def _(spark, folder):
    (e,) = read_tables(spark, folder, "embeddings")
    kept = F.filter(A.top_k_filter(F.col(_VEC), 5), lambda v: v > float("-inf"))
    return e.select("vec_id", F.size(kept).cast("long").alias("n_kept"), F.round(F.array_min(kept), 6).alias("least"))


@q(
    "nucleus_filter",
    """WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, unnest(range(0, 64)) AS i FROM embeddings),
    c AS (SELECT vec_id, i, v, sum(exp(v)) OVER (PARTITION BY vec_id ORDER BY v, i ROWS UNBOUNDED PRECEDING) / sum(exp(v)) OVER (PARTITION BY vec_id) AS cum FROM x)
    SELECT vec_id, count(*) FILTER (cum > 0.3) AS n_kept FROM c GROUP BY vec_id""",
)
def _(spark, folder):
    (e,) = read_tables(spark, folder, "embeddings")
    kept = F.filter(A.nucleus_filter(F.col(_VEC), 0.7), lambda v: v > float("-inf"))
    return e.select("vec_id", F.size(kept).cast("long").alias("n_kept"))


@q("argmax", "SELECT vec_id, list_position(embedding, list_max(embedding))::BIGINT - 1 AS best FROM embeddings")
def _(spark, folder):
    (e,) = read_tables(spark, folder, "embeddings")
    return e.select("vec_id", A.argmax(F.col(_VEC)).alias("best"))


@q(
    "repetition_penalty",
    "SELECT vec_id, i AS pos, round(CASE WHEN i IN (1, 5, 9) THEN CASE WHEN embedding[i + 1] < 0 THEN embedding[i + 1]::DOUBLE * 1.3 ELSE embedding[i + 1]::DOUBLE / 1.3 END ELSE embedding[i + 1]::DOUBLE END, 6) AS v FROM embeddings, range(0, 64) AS t(i)",
)
def _(spark, folder):
    (e,) = read_tables(spark, folder, "embeddings")
    rows = e.select("vec_id", F.posexplode(A.repetition_penalty(F.col(_VEC), F.array(F.lit(1), F.lit(5), F.lit(9)), 1.3)).alias("pos", "v"))
    return rows.select("vec_id", F.col("pos").cast("long").alias("pos"), F.round("v", 6).alias("v"))


@q("schedule_steps", "SELECT n_rows, ceil(n_rows / 64.0)::BIGINT AS steps_per_epoch, ceil(ceil(n_rows / 64.0) * 2 * 0.03)::BIGINT AS warmup FROM (SELECT count(*) AS n_rows FROM lineitem)")
def _(spark, folder):
    (l,) = read_tables(spark, folder, "lineitem")
    steps = F.ceil(F.col("n_rows") / 64.0)
    return l.agg(F.count(F.lit(1)).alias("n_rows")).select("n_rows", steps.alias("steps_per_epoch"), F.ceil(steps * 2 * 0.03).alias("warmup"))
