"""Registered queries over pixels, probability maps and masks, with the same in DuckDB's SQL where it can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import quality, regions_of_maps, repair
from .catalogue import _REGIONS, _records, query

#: A text as a probability map: 40 characters a line, four pixels a character, letters and digits inked on four rows of six.
_INK = """chars AS (SELECT conv_id, turn, unnest(string_split(text, '')) AS ch, unnest(generate_series(0, length(text) - 1)) AS pos FROM conversations WHERE length(text) > 0),
inked AS (SELECT *, pos // 40 AS line, pos % 40 AS col, regexp_full_match(ch, '[A-Za-z0-9]') AS ink FROM chars),
starts AS (SELECT *, ink AND NOT COALESCE(lag(ink) OVER (PARTITION BY conv_id, turn, line ORDER BY col), false) AS begins FROM inked),
runs AS (SELECT conv_id, turn, line, min(col) AS a, max(col) AS b FROM (SELECT *, sum(begins::INT) OVER (PARTITION BY conv_id, turn, line ORDER BY col) AS run FROM starts) WHERE ink GROUP BY conv_id, turn, line, run),
blobs AS (SELECT conv_id, turn, 4 * a AS x0, 4 * b + 3 AS x1, 6 * line AS y0, 6 * line + 3 AS y1 FROM runs),
grown AS (SELECT *, (x1 - x0) * 3 * 1.5 / (2 * (x1 - x0 + 3)) AS d FROM blobs),
sized AS (SELECT g.*, 6 * ((length(text) + 39) // 40) AS h FROM grown g JOIN conversations USING (conv_id, turn)),
boxes AS (SELECT conv_id, turn, least(319, 2 * greatest(0, ceil(x0 - d - 0.5))) AS l, least(2 * h - 1, 2 * greatest(0, ceil(y0 - d - 0.5))) AS t, least(319, 2 * least(160, floor(x1 + d + 0.5))) AS r, least(2 * h - 1, 2 * least(h, floor(y1 + d + 0.5))) AS b FROM sized)"""


@query("WITH " + _INK + """, sums AS (SELECT conv_id, turn, count(*) AS n, sum(l)::BIGINT AS lefts, sum(t)::BIGINT AS tops, sum(r)::BIGINT AS rights, sum(b)::BIGINT AS bottoms, sum(l * b)::BIGINT AS mixed, 0.902 AS score FROM boxes GROUP BY 1, 2)
SELECT conv_id, turn, COALESCE(n, 0) AS n, COALESCE(lefts, 0) AS lefts, COALESCE(tops, 0) AS tops, COALESCE(rights, 0) AS rights, COALESCE(bottoms, 0) AS bottoms, COALESCE(mixed, 0) AS mixed, score::DOUBLE AS score FROM conversations LEFT JOIN sums USING (conv_id, turn)""")
def text_map_regions(spark, sf_dir):
    """Text regions of maps drawn from the texts, in images twice as large: words are the regions."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    inked = F.regexp_replace(F.regexp_replace("text", "[^A-Za-z0-9]", " "), "[A-Za-z0-9]", "æ")
    lines = F.ceil(F.length("text") / 40).cast("int")
    wide = F.regexp_replace(F.rpad(inked, 40 * lines, " "), "(.)", "$1$1$1$1")
    drawn = F.regexp_replace(wide, "(.{160})", "$1$1$1$1" + " " * 320)
    probability = F.struct(F.lit(160).alias("width"), (6 * lines).alias("height"), F.encode(drawn, "ISO-8859-1").alias("data"))
    found = rows.select("conv_id", "turn", regions_of_maps.text_regions(probability, F.lit(320), 12 * lines, most=None).alias("found"))
    total = lambda f: F.coalesce(F.aggregate("found", F.lit(0).cast("long"), lambda s, r: s + f(r["poly"])), F.lit(0).cast("long"))
    return found.select(
        "conv_id", "turn", F.size("found").cast("long").alias("n"), total(lambda p: p[0][0]).alias("lefts"), total(lambda p: p[0][1]).alias("tops"), total(lambda p: p[2][0]).alias("rights"), total(lambda p: p[2][1]).alias("bottoms"),
        total(lambda p: p[3][0].cast("long") * p[3][1]).alias("mixed"), F.round(F.array_max(F.transform("found", lambda r: r["score"])), 4).alias("score"),
    )


@query("WITH " + _REGIONS + """, reach AS (SELECT unnest(generate_series(-5, 5)) AS d), wide AS (SELECT d, round_even(sqrt(25 - d * d), 0)::INT AS w FROM reach),
rows AS (SELECT event_id, y0 // 2 + y AS y, max(w) AS w, x0 // 2 AS x0, (x0 + 40) // 2 + event_id % 30 AS x1 FROM (SELECT event_id, x0, y0, unnest(generate_series(-5, (event_id % 12) + 5)) AS y FROM regions) JOIN wide ON y - d BETWEEN 0 AND event_id % 12 AND y0 // 2 + y - d <= 239 GROUP BY ALL)
SELECT event_id, count(*) FILTER (WHERE y BETWEEN 0 AND 239) AS n_rows, sum(CASE WHEN y BETWEEN 0 AND 239 THEN least(319, x1 + w) - greatest(0, x0 - w) + 1 ELSE 0 END)::BIGINT AS n_pixels, sum(CASE WHEN y BETWEEN 0 AND 239 THEN y * (least(319, x1 + w) - greatest(0, x0 - w) + 1) ELSE 0 END)::BIGINT AS moment FROM events LEFT JOIN rows USING (event_id) GROUP BY event_id""")
def repair_masks(spark, sf_dir):
    """What a region covers once an ellipse of five pixels is laid around it, in an image of 320 by 240."""
    i = F.col("event_id")
    own = _records(spark, sf_dir).select("event_id", F.col("regions")[0]["poly"][0].alias("p"))
    x0, y0 = F.expr("p[0] div 2").cast("int"), F.expr("p[1] div 2").cast("int")
    x1, y1 = (F.expr("(p[0] + 40) div 2") + i % 30).cast("int"), (F.expr("p[1] div 2") + i % 12).cast("int")
    poly = F.array(F.array(x0, y0), F.array(x1, y0), F.array(x1, y1), F.array(x0, y1))
    rows = own.select("event_id", repair.masked_pixels(F.array(poly), F.lit(320), F.lit(240), 5).alias("rows"))
    total = lambda f: F.aggregate("rows", F.lit(0).cast("long"), lambda s, r: s + f(r))
    return rows.select("event_id", F.size("rows").cast("long").alias("n_rows"), total(lambda r: r["n"]).alias("n_pixels"), total(lambda r: r["n"] * r["row"]).alias("moment"))


def images_of(texts):
    """(conv_id, turn, pixels, polygons) of (conv_id, turn, text): 24 pixels wide from the bytes of the whole text, the last row
    filled up with black, and a turned box over the middle."""
    own = texts.where("octet_length(text) > 0").withColumn("height", F.ceil(F.octet_length("text") / 72).cast("int"))
    data = F.expr("concat(encode(text, 'utf-8'), unhex(repeat('00', cast(pmod(-octet_length(text), 72) as int))))")
    pixels = F.struct(F.lit(24).alias("width"), F.col("height"), data.alias("data"))
    h = F.col("height")
    at = lambda x, y: F.array(F.lit(x), F.floor(y).cast("int"))
    poly = F.array(at(7, h / 2 - 2), at(15, h / 2 - 1), at(14, h / 2 + 2), at(6, h / 2 + 1))
    return own.select("conv_id", "turn", pixels.alias("pixels"), F.array(poly).alias("polygons"))


@query()
def repaired_images(spark, sf_dir):
    """Pixels of a turned box in each image, filled in from what is around them; digests of the images."""
    own = images_of(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    fixed = own.select("conv_id", "turn", repair.repair(F.col("pixels"), F.col("polygons"), 1, 3, repair.TELEA).alias("t"), repair.repair(F.col("pixels"), F.col("polygons"), 1, 3, repair.ISOPHOTES).alias("n"))
    return fixed.select("conv_id", "turn", F.sha2("t.data", 256).alias("telea"), F.sha2("n.data", 256).alias("isophotes"))


@query("""WITH p AS (SELECT vec_id, sqrt(x[1]**2 + x[2]**2 + x[3]**2) AS n, sqrt(x[5]**2 + x[6]**2 + x[7]**2) AS m, x FROM (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings)),
u AS (SELECT vec_id, x[1] / n AS a, x[2] / n AS b, x[3] / n AS c, x[5] / m AS d, x[6] / m AS e, x[7] / m AS f FROM p),
z AS (SELECT vec_id, a, d, b * f - c * e AS p, c * d - a * f AS q, a * e - b * d AS r FROM u),
y AS (SELECT *, degrees(asin(greatest(-1, least(1, p)))) AS yaw FROM z), k AS (SELECT *, greatest(1e-6, cos(radians(yaw))) AS c FROM y)
SELECT vec_id, round(yaw, 6) AS yaw, round(degrees(atan2(q / c, r / c)), 6) AS pitch, round(degrees(atan2(d / c, a / c)), 6) AS roll FROM k""")
def head_angles(spark, sf_dir):
    """Angles of a head from the first parameters of a face model; here those of the vectors."""
    own = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", quality.head_angles(F.col("embedding")).alias("a"))
    return own.select("vec_id", *[F.round(f"a.{c}", 6).alias(c) for c in ("yaw", "pitch", "roll")])


@query("""WITH m AS (SELECT event_id, (event_id * 7 % 50)::INT AS x0, (event_id * 13 % 30)::INT AS y0, (event_id % 11 + 3)::INT AS w, (event_id % 9 + 1)::INT AS h FROM events),
b AS (SELECT event_id, x0, y0, least(64, x0 + w) AS x1, least(40, y0 + h) AS y1 FROM m),
c AS (SELECT *, greatest(0, x0 - 20) AS l, greatest(0, y0 - 20) AS t, least(64, x1 + 20) AS r, least(40, y1 + 20) AS u FROM b)
SELECT event_id, x0 || ',' || y0 || ',' || x1 || ',' || y1 AS subject, CASE WHEN good THEN l || ',' || t || ',' || r || ',' || u END AS box, CASE WHEN good THEN round(removed, 9) END AS removed, CASE WHEN good AND edge THEN 'subject_mask_touches_source_edge' WHEN good THEN '' END AS warnings
FROM (SELECT *, 1.0 - ((r - l) * (u - t))::DOUBLE / 2560 AS removed, removed >= 0.05 AS good, x0 <= 0 OR y0 <= 0 OR x1 >= 64 OR y1 >= 40 AS edge FROM c)""")
def mask_boxes(spark, sf_dir):
    """Crops proposed from square masks of images of 64 by 40: what lies outside the image in the square, above and below, doesn't count."""
    i = F.col("event_id")
    own = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", (i * 7 % 50).cast("int").alias("x0"), (i * 13 % 30).cast("int").alias("y0"), (i % 11 + 3).cast("int").alias("w"), (i % 9 + 1).cast("int").alias("h"))
    own = own.withColumns({"x1": F.least(F.lit(64), F.col("x0") + F.col("w")), "y1": F.least(F.lit(40), F.col("y0") + F.col("h"))})
    dark, light = F.lit("\x10"), F.lit("æ")  # 16 of 255 is below the least, 230 above
    row = F.concat(F.repeat(dark, F.col("x0")), F.repeat(light, F.col("x1") - F.col("x0")), F.repeat(dark, 64 - F.col("x1")))
    empty, full = F.repeat(dark, F.lit(64)), F.repeat(light, F.lit(64))
    square = F.concat(F.repeat(full, F.lit(12)), F.repeat(empty, F.col("y0")), F.repeat(row, F.col("y1") - F.col("y0")), F.repeat(empty, 40 - F.col("y1")), F.repeat(full, F.lit(12)))
    found = own.select("event_id", quality.mask_box(F.lit(64), F.encode(square, "ISO-8859-1"), F.lit(64), F.lit(40)).alias("b"))
    found = found.withColumn("p", quality.proposed_crop(F.col("b"), F.lit(64), F.lit(40), padding=20))
    joined = lambda c: F.array_join(c.cast("array<string>"), ",")
    return found.select("event_id", joined(F.col("b")).alias("subject"), joined(F.col("p.box")).alias("box"), F.round("p.removed_area_ratio", 9).alias("removed"), F.array_join("p.warnings", ",").alias("warnings"))


@query()
def scene_features(spark, sf_dir):
    """The 36 features of the image of each text."""
    own = images_of(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    f = own.select("conv_id", "turn", quality.natural_scene_features(F.col("pixels")).alias("f"))
    return f.select("conv_id", "turn", F.array_join(F.transform("f", lambda v: F.round(v, 6).cast("string")), ",").alias("features"))


@query()
def upright_faces(spark, sf_dir):
    """Images turned upright by five points, which turn with the row; digests of the pixels."""
    own = images_of(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    angle, size = F.col("conv_id") % 360, (F.col("turn") % 5 + 3) / 10.0
    at = lambda x, y: F.array(12 + size * (F.cos(F.radians(angle)) * (x - 56) - F.sin(F.radians(angle)) * (y - 72)), 12 + size * (F.sin(F.radians(angle)) * (x - 56) + F.cos(F.radians(angle)) * (y - 72)))
    points = F.array(*[at(F.lit(x), F.lit(y)) for x, y in quality.UPRIGHT])
    return own.select("conv_id", "turn", quality.upright(F.col("pixels"), points).alias("u")).select("conv_id", "turn", "u.width", "u.height", F.sha2("u.data", 256).alias("digest"))
