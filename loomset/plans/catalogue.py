"""The registered queries of the curation operators over the test tables, with the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expressions as x
from ..functions import geometry as g
from ..operators import decisions, dupes, manifest, moves, quota, refresh, regions, views
from ..schema import COMPOSITE_VERSION, PICKED
from ..sources.images import SAMPLES, raw_samples, samples
from ..streaming.enrichment import current_results

_found: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}

# -- what the SQL shares

_SAMPLES = (
    "raw AS (SELECT " + SAMPLES.format(sha="sha256", bits="") + """),
classed AS (SELECT *,
  'img_' || lpad(ord::VARCHAR, 8, '0') AS sample_id, source || '/' || lang || '_frame_' || ord || '.jpg' AS relative_path,
  CASE WHEN abs(yaw) < 15 THEN '正脸' WHEN abs(yaw) < 45 THEN CASE WHEN yaw > 0 THEN '左3/4' ELSE '右3/4' END WHEN yaw > 0 THEN '左侧脸' ELSE '右侧脸' END AS angle_class,
  CASE WHEN pitch >= 22 THEN '仰头' WHEN pitch <= -12 THEN '低头' ELSE '正常' END AS pitch_class FROM raw),
flagged AS (SELECT *,
  list_filter([CASE WHEN faces = 0 AND person_scale = '全身' THEN 'no_face_full_body_review' END, CASE WHEN faces > 1 THEN 'secondary_faces_detected' END,
    CASE WHEN width < 512 OR height < 512 THEN 'low_resolution' END, CASE WHEN faces > 0 AND face_px < 120 THEN 'low_face_pixels' END,
    CASE WHEN faces > 0 AND face_ratio < 0.018 THEN 'low_face_ratio' END, CASE WHEN faces > 0 AND blur < 25 THEN 'severe_face_blur' END,
    CASE WHEN faces > 0 AND face_quality < 0.25 THEN 'low_face_quality' END, CASE WHEN brisque > 80 THEN 'high_brisque' END,
    CASE WHEN brightness < 28 OR brightness > 228 THEN 'extreme_exposure' END], lambda c: c IS NOT NULL) AS flags,
  list_filter([CASE WHEN faces = 0 AND person_scale <> '全身' THEN 'no_face_not_full_body' END], lambda c: c IS NOT NULL) AS rejects FROM classed),
judged AS (SELECT *,
  CASE WHEN len(rejects) > 0 THEN 'REJECT' WHEN len(flags) > 0 THEN 'REVIEW' ELSE 'PASS' END AS eligibility,
  len(rejects) = 0 AND NOT list_has_any(flags, ['no_face_full_body_review', 'secondary_faces_detected', 'low_face_pixels', 'extreme_exposure'])
    AND NOT (list_contains(flags, 'low_face_quality') AND angle_class NOT IN ('左侧脸', '右侧脸')) AND brisque <= 70 AND blur >= 40 AS qualified FROM flagged),
copies AS (SELECT content_sha256, row_number() OVER (ORDER BY q, b, l, o) AS duplicate_group FROM (
  SELECT content_sha256, -face_quality AS q, brisque AS b, -blur AS l, ord AS o, count(*) OVER (PARTITION BY content_sha256) AS n,
    row_number() OVER (PARTITION BY content_sha256 ORDER BY face_quality DESC, brisque, blur DESC, ord) AS k FROM judged) WHERE k = 1 AND n > 1),
s AS (SELECT j.*, COALESCE(c.duplicate_group, 0) AS duplicate_group, CASE WHEN eligibility = 'REJECT' THEN '淘汰' ELSE '备选' END AS base,
  COALESCE(manual_status, CASE WHEN eligibility = 'REJECT' THEN '淘汰' ELSE '备选' END) AS status FROM judged j LEFT JOIN copies c USING (content_sha256))"""
)
_RANK = "face_quality DESC, brisque, blur DESC, ord"
_MEMBERS = f"""members AS (SELECT *, bool_or(qualified) OVER (PARTITION BY duplicate_group) AS some_q FROM s WHERE duplicate_group <> 0),
ranks AS (SELECT *, CASE WHEN qualified OR NOT some_q THEN row_number() OVER (PARTITION BY duplicate_group, qualified OR NOT some_q ORDER BY {_RANK}) ELSE 0 END AS group_rank,
  count(*) FILTER (WHERE qualified OR NOT some_q) OVER (PARTITION BY duplicate_group) AS group_size FROM members)"""
_POOL = f"""pool AS (SELECT * FROM s WHERE qualified AND duplicate_group = 0 UNION ALL BY NAME SELECT * EXCLUDE (k) FROM (
  SELECT *, row_number() OVER (PARTITION BY duplicate_group ORDER BY {_RANK}) AS k FROM s WHERE qualified AND duplicate_group <> 0) WHERE k = 1)"""


def query(sql: str | None = None):
    """Registers a function under its name; a SQL text that starts with SELECT or a name sees the view s of samples."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        _found[f.__name__] = (f, sql)
        return f

    return register


def _s(select: str, *ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join([_SAMPLES, *ctes]) + "\n" + select


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples with groups of exact copies, status and whether they qualify."""
    own = dupes.exact_groups(samples(spark, sf_dir))
    return own.withColumn("status", x.effective_status(F.col("manual_status"), F.col("auto_status"))).withColumn("qualified", F.size(x.blockers()) == 0)


def _long(*names: str):
    return [F.col(n).cast("long").alias(n) for n in names]


# -- projections


@query(_s("SELECT ord, array_to_string(flags, '|') AS flag_codes, array_to_string(rejects, '|') AS reject_codes FROM s"))
def findings_flags(spark, sf_dir):
    code = lambda c: F.array_join(x.codes(F.col(c)), "|")
    return samples(spark, sf_dir).select("ord", code("review_flags").alias("flag_codes"), code("hard_rejects").alias("reject_codes"))


@query(_s("SELECT eligibility, count(*) AS n FROM s GROUP BY 1"))
def eligibility_counts(spark, sf_dir):
    return samples(spark, sf_dir).groupBy("eligibility").agg(F.count(F.lit(1)).alias("n"))


@query(_s("SELECT ord, angle_class, pitch_class, CASE WHEN ord % 5 = 0 THEN '近景/头肩' WHEN ord % 3 = 0 THEN '全身' WHEN ord % 4 = 1 THEN '大半身' WHEN ord % 2 = 0 THEN '半身' ELSE '近景/头肩' END AS pose_scale FROM s"))
def yaw_pitch_scale_classes(spark, sf_dir):
    own = samples(spark, sf_dir)
    seen = lambda on: F.when(on, 0.9).otherwise(0.1)
    k = F.col("ord")
    marks = F.transform(F.sequence(F.lit(0), F.lit(32)), lambda j: F.struct(F.lit(0.5).alias("x"), F.lit(0.5).alias("y"), F.when(j >= 27, seen(k % 3 == 0)).when(j >= 25, seen(k % 4 == 1)).when(j >= 23, seen(k % 2 == 0)).otherwise(0.9).alias("visibility")))
    return own.select("ord", "angle_class", "pitch_class", x.person_scale(F.when(k % 5 != 0, marks)).alias("pose_scale"))


@query(_s("SELECT ord, qualified FROM s"))
def recommendation_blockers(spark, sf_dir):
    return samples(spark, sf_dir).select("ord", (F.size(x.blockers()) == 0).alias("qualified"))


@query(_s("SELECT ord, status FROM s"))
def effective_status(spark, sf_dir):
    return samples(spark, sf_dir).select("ord", x.effective_status(F.col("manual_status"), F.col("auto_status")).alias("status"))


@query("""SELECT page_id, CASE WHEN contains(stem, '_frame_') THEN split_part(stem, '_frame_', 1) ELSE regexp_replace(path, '/[^/]*$', '') END AS source_label
FROM (SELECT page_id, path, regexp_replace(split_part(path, '/', -1), '(.)\\.[^.]*$', '\\1') AS stem FROM (SELECT page_id, url || '/clip' || page_id % 7 || CASE WHEN page_id % 2 = 0 THEN '_frame_' ELSE '-' END || page_id || '.png' AS path FROM pages))""")
def source_label(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    i = F.col("page_id")
    path = F.concat("url", F.lit("/clip"), i % 7, F.when(i % 2 == 0, "_frame_").otherwise("-"), i, F.lit(".png"))
    return p.select("page_id", x.source_label(path).alias("source_label"))


@query(_s("SELECT s.sample_id, relative_path, status AS effective_status, COALESCE(manual_status, '') AS manual_status, eligibility, faces::BIGINT AS face_count, face_px::BIGINT AS face_px, face_quality, duplicate_group::BIGINT AS duplicate_group, array_to_string(flags, '|') AS review_flag_codes, array_to_string(rejects, '|') AS hard_reject_codes, split_part(relative_path, '/', -1) AS filename FROM s"))
def manifest_flat(spark, sf_dir):
    rows = _rows(spark, sf_dir).withColumn("recommendation_reasons", x.blockers())
    return manifest.flat(rows).select("sample_id", "filename", "relative_path", "effective_status", "manual_status", "eligibility", *_long("face_count", "face_px"), "face_quality", *_long("duplicate_group"), "review_flag_codes", "hard_reject_codes")


# -- hashes and copies


def _hashes(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    bits = x.hash_bits(F.col("embedding"))
    return e.select(F.col("vec_id").alias("id"), bits.alias("bits"), x.bits_to_long(bits).alias("phash"))


_BITS = """bits AS (SELECT vec_id, array_to_string(list_transform(embedding, lambda v: CASE WHEN v::DOUBLE > m THEN '1' ELSE '0' END), '') AS bits
FROM (SELECT vec_id, embedding, list_median(list_transform(embedding, lambda v: v::DOUBLE)) AS m FROM embeddings))"""


@query("WITH " + _BITS + " SELECT vec_id AS id, bits FROM bits")
def hash_bits(spark, sf_dir):
    return _hashes(spark, sf_dir).select("id", "bits")


_PAIRS = _BITS + """, firsts AS (SELECT bits, min(vec_id) AS id FROM bits WHERE contains(bits, '1') GROUP BY bits),
pairs AS (SELECT least(a.id, b.id) AS a, greatest(a.id, b.id) AS b, hamming(a.bits, b.bits) AS distance FROM firsts a JOIN firsts b ON a.id < b.id AND hamming(a.bits, b.bits) <= 20
UNION ALL SELECT f.id, v.vec_id, 0 FROM bits v JOIN firsts f USING (bits) WHERE v.vec_id <> f.id)"""


@query("WITH " + _PAIRS + " SELECT a, b, distance::BIGINT AS distance FROM pairs")
def hamming_pairs(spark, sf_dir):
    return dupes.hamming_pairs(_hashes(spark, sf_dir), 20).select("a", "b", *_long("distance"))


@query("WITH " + _BITS + """, m AS (SELECT vec_id AS id, bits, vec_id % 40 AS source, vec_id % 4 AS person_scale, (vec_id * 37) % 181 - 90 AS yaw, (vec_id * 53) % 91 - 45 AS pitch FROM bits WHERE contains(bits, '1'))
SELECT a.id AS a, b.id AS b, hamming(a.bits, b.bits)::BIGINT AS distance FROM m a JOIN m b ON a.source = b.source AND a.person_scale = b.person_scale AND a.id < b.id
WHERE abs(a.yaw - b.yaw) <= 25 AND abs(a.pitch - b.pitch) <= 25 AND hamming(a.bits, b.bits) <= 28""")
def adjacent_pairs(spark, sf_dir):
    return dupes.adjacent_pairs(_metrics(_hashes(spark, sf_dir)), 28).select("a", "b", *_long("distance"))


def _metrics(rows: DataFrame) -> DataFrame:
    i = F.col("id")
    return rows.withColumns({"source": i % 40, "person_scale": i % 4, "yaw": (i * 37) % 181 - 90, "pitch": (i * 53) % 91 - 45})


@query("WITH RECURSIVE " + _BITS + """, m AS (SELECT vec_id AS id, bits, (1000 - vec_id * 7919 % 1000) * 10000000000 + vec_id AS pri, vec_id % 40 AS source, vec_id % 4 AS person_scale,
  (vec_id * 37) % 181 - 90 AS yaw, (vec_id * 53) % 91 - 45 AS pitch FROM bits WHERE contains(bits, '1') AND vec_id % 17 <> 0),
close AS (SELECT a.pri AS a, list(b.pri) AS nbs FROM m a JOIN m b ON a.id <> b.id AND (hamming(a.bits, b.bits) <= 20 OR (a.source = b.source AND a.person_scale = b.person_scale
  AND abs(a.yaw - b.yaw) <= 25 AND abs(a.pitch - b.pitch) <= 25 AND hamming(a.bits, b.bits) <= 28)) GROUP BY 1),
walk(anchor, members, rem) AS (SELECT NULL::BIGINT, []::BIGINT[], (SELECT list(pri ORDER BY pri) FROM m)
  UNION ALL SELECT rem[1], list_intersect(rem[2:], COALESCE(nbs, [])), list_filter(rem[2:], lambda x: NOT list_contains(COALESCE(nbs, []), x)) FROM walk LEFT JOIN close ON close.a = rem[1] WHERE len(rem) > 0),
groups AS (SELECT row_number() OVER (ORDER BY anchor) AS g, list_append(members, anchor) AS pris FROM walk WHERE len(members) > 0),
placed AS (SELECT g, unnest(pris) AS pri FROM groups)
SELECT bits.vec_id AS id, COALESCE(g, 0)::BIGINT AS duplicate_group FROM bits LEFT JOIN m ON m.id = bits.vec_id LEFT JOIN placed USING (pri)""")
def dup_groups(spark, sf_dir):
    score = (F.col("id") * 7919) % 1000
    nodes = _hashes(spark, sf_dir).select("id", "phash", ((1000 - score) * 10_000_000_000 + F.col("id")).alias("pri"), (F.col("id") % 17 == 0).alias("duplicate_ignore"))
    return dupes.greedy_groups(_metrics(nodes), 20, 28).select("id", *_long("duplicate_group"))


@query(_s("SELECT ord, duplicate_group::BIGINT AS duplicate_group FROM s"))
def exact_dup_groups(spark, sf_dir):
    return dupes.exact_groups(samples(spark, sf_dir)).select("ord", *_long("duplicate_group"))


@query(_s("SELECT ord, group_rank::BIGINT AS group_rank, group_size::BIGINT AS group_size FROM ranks UNION ALL SELECT ord, 1, 1 FROM s WHERE duplicate_group = 0", _MEMBERS))
def group_rank(spark, sf_dir):
    return dupes.with_group_rank(_rows(spark, sf_dir), qualified=True).select("ord", *_long("group_rank", "group_size"))


@query(_s("SELECT ord FROM pool", _POOL))
def best_per_group(spark, sf_dir):
    return dupes.best_per_group(_rows(spark, sf_dir).where("qualified")).select("ord")


@query(_s("SELECT ord FROM ranks WHERE group_rank = 1 UNION ALL SELECT ord FROM s WHERE duplicate_group = 0", _MEMBERS))
def best_only_view(spark, sf_dir):
    return views.run_view(_rows(spark, sf_dir), views.ViewSpec(best_only=True))[0].select("ord")


@query(_s("SELECT duplicate_group::BIGINT AS duplicate_group, bool_and(manual_status IS NOT NULL) AS reviewed FROM s WHERE duplicate_group <> 0 GROUP BY 1"))
def group_review_state(spark, sf_dir):
    rows = _rows(spark, sf_dir).withColumn("duplicate_reviewed", F.col("manual_status").isNotNull())
    return dupes.group_reviewed(rows).select(*_long("duplicate_group"), "reviewed")


# -- the recommendation

_TOP = f"""chosen AS (
  WITH w(scale, y, sw, yw, p) AS (SELECT scale, y, sw, yw, row_number() OVER () FROM (VALUES ('近景/头肩', 35), ('半身', 30), ('大半身', 20), ('全身', 15)) a(scale, sw), (VALUES ('正脸', 280), ('左3/4', 160), ('右3/4', 160), ('左侧脸', 100), ('右侧脸', 100)) b(y, yw)),
  scales AS (SELECT scale, min(p) AS p, min(sw) AS sw FROM w GROUP BY 1),
  q1 AS (SELECT scale, p, 60 * sw / sum(sw) OVER () AS share FROM scales),
  q2 AS (SELECT scale, floor(share)::INT + CASE WHEN row_number() OVER (ORDER BY share - floor(share) DESC, p) <= 60 - (SELECT sum(floor(share)) FROM q1) THEN 1 ELSE 0 END AS quota FROM q1),
  have AS (SELECT person_scale AS scale, angle_class AS y, count(*) AS n FROM pool GROUP BY 1, 2),
  y1 AS (SELECT w.scale, w.y, p, n, quota, quota * yw / sum(yw) OVER (PARTITION BY w.scale) AS share FROM w JOIN have USING (scale, y) JOIN q2 USING (scale)),
  y2 AS (SELECT scale, y, LEAST(n, floor(share)::INT + CASE WHEN row_number() OVER (PARTITION BY scale ORDER BY share - floor(share) DESC, p) <= quota - sum(floor(share)) OVER (PARTITION BY scale) THEN 1 ELSE 0 END) AS k1, quota FROM y1),
  r1 AS (SELECT pool.*, row_number() OVER (PARTITION BY person_scale, angle_class ORDER BY {_RANK}) <= k1 AS one, quota - sum(0) OVER () AS quota FROM pool JOIN y2 ON person_scale = scale AND angle_class = y),
  r2 AS (SELECT *, row_number() OVER (PARTITION BY person_scale, one ORDER BY {_RANK}) AS k, count(*) FILTER (WHERE one) OVER (PARTITION BY person_scale) AS firsts FROM r1)
  SELECT ord FROM r2 WHERE one OR k <= quota - firsts OR (SELECT count(*) FROM pool) <= 60)"""


def _recommended(spark, sf_dir, target):
    return quota.recommend(_rows(spark, sf_dir), target)


@query(_s("SELECT s.ord, CASE WHEN chosen.ord IS NOT NULL THEN '推荐' ELSE base END AS auto_status FROM s LEFT JOIN chosen USING (ord)", _POOL, _TOP))
def recommend_quota(spark, sf_dir):
    return _recommended(spark, sf_dir, 60).select("ord", "auto_status")


@query()
def recommend_topup(spark, sf_dir):
    return _recommended(spark, sf_dir, 230).select("ord", "auto_status", F.array_join("recommendation_reasons", "|").alias("reasons"))


@query(_s("SELECT 60::BIGINT AS target, count(chosen.ord) AS automatic_recommended, count(*) FILTER (WHERE manual_status = '推荐') AS manual_recommended, count(*) FILTER (WHERE COALESCE(manual_status, CASE WHEN chosen.ord IS NOT NULL THEN '推荐' ELSE base END) = '推荐') AS total_recommended FROM s LEFT JOIN chosen USING (ord)", _POOL, _TOP))
def recommend_summary(spark, sf_dir):
    return quota.summary(_recommended(spark, sf_dir, 60), 60).select(*_long("target"), "automatic_recommended", "manual_recommended", "total_recommended")


# -- views


def _view(spec: views.ViewSpec):
    return lambda spark, sf_dir: views.run_view(_rows(spark, sf_dir), spec)[0]


@query(_s("SELECT ord FROM (SELECT * FROM s WHERE eligibility = 'REVIEW' AND pitch_class = '正常') ORDER BY blur DESC, brisque, ord LIMIT 50"))
def view_filter_sort_top(spark, sf_dir):
    return _view(views.ViewSpec("v", {"eligibility": "REVIEW", "pitch_class": "正常", "status": views.ALL}, "BRISQUE", views.FORWARD, False, "view_top", 50, "Sharpness"))(spark, sf_dir).select("ord")


@query(_s("SELECT ord FROM s ORDER BY face_quality, brisque DESC, blur, source DESC, ord LIMIT 40"))
def view_bottom(spark, sf_dir):
    return _view(views.ViewSpec("v", {}, "来源目录 / 源视频", views.BACKWARD, False, "view_bottom", 40))(spark, sf_dir).select("ord")


@query(_s("SELECT ord FROM s ORDER BY face_px DESC, ord LIMIT 120 OFFSET 120"))
def view_page(spark, sf_dir):
    rows, order = views.run_view(_rows(spark, sf_dir), views.ViewSpec(sort_field="Face Pixels"))
    return views.page_of(rows, order, 1).select("ord")


@query(_s("SELECT ord, ((row_number() OVER (PARTITION BY source ORDER BY ord) - 1) // 16)::BIGINT AS page, ((row_number() OVER (PARTITION BY source ORDER BY ord) - 1) % 16)::BIGINT AS slot FROM s"))
def page_chunks(spark, sf_dir):
    return views.chunks(samples(spark, sf_dir), 16, "source").select("ord", *_long("page", "slot"))


@query(_s("""SELECT 'status' AS field, status AS value, count(*) AS n FROM s GROUP BY 2 UNION ALL SELECT 'person_scale', person_scale, count(*) FROM s GROUP BY 2 UNION ALL SELECT 'angle_class', angle_class, count(*) FROM s GROUP BY 2
UNION ALL SELECT 'pitch_class', pitch_class, count(*) FROM s GROUP BY 2 UNION ALL SELECT 'eligibility', eligibility, count(*) FROM s GROUP BY 2"""))
def dataset_histograms(spark, sf_dir):
    return views.histograms(_rows(spark, sf_dir))


@query(_s("SELECT count(*) AS total, count(DISTINCT CASE WHEN duplicate_group <> 0 THEN duplicate_group END) AS groups, count(*) FILTER (WHERE duplicate_group <> 0) AS group_members, count(*) FILTER (WHERE ord % 29 = 0) AS ignored, count(*) FILTER (WHERE list_contains(flags, 'secondary_faces_detected')) AS secondary_faces, count(*) FILTER (WHERE faces = 0) AS no_face, count(*) FILTER (WHERE len(rejects) > 0) AS hard_rejects FROM s"))
def dataset_summary(spark, sf_dir):
    return views.dataset_summary(_rows(spark, sf_dir).withColumn("duplicate_ignore", F.col("ord") % 29 == 0))


_DONE = """done AS (SELECT s.* EXCLUDE (status), chosen.ord IS NOT NULL AS auto_picked, COALESCE(manual_status, CASE WHEN chosen.ord IS NOT NULL THEN '推荐' ELSE base END) AS status FROM s LEFT JOIN chosen USING (ord))"""


@query(_s("""SELECT count(*) FILTER (WHERE auto_picked) AS auto_picked, count(*) FILTER (WHERE manual_status = '推荐' AND NOT auto_picked) AS manual_added, count(*) FILTER (WHERE status = '推荐') AS picked, count(DISTINCT source) AS sources,
count(DISTINCT CASE WHEN duplicate_group <> 0 THEN duplicate_group END) AS groups,
count(*) FILTER (WHERE status <> '推荐' AND eligibility <> 'REJECT' AND duplicate_group <> 0 AND (r.group_rank > 1 OR duplicate_group IN (SELECT duplicate_group FROM done WHERE status = '推荐' AND duplicate_group <> 0))) AS lost_to_copies,
count(*) FILTER (WHERE eligibility = 'REVIEW') AS review, count(*) FILTER (WHERE eligibility = 'REJECT') AS rejected FROM done LEFT JOIN (SELECT ord, group_rank FROM ranks) r USING (ord)""", _MEMBERS, _POOL, _TOP, _DONE))
def stats_selected_only(spark, sf_dir):
    return views.stats(_recommended(spark, sf_dir, 60))


@query(_s("""SELECT 'status' AS field, status AS value, count(*) AS n FROM done GROUP BY 2 UNION ALL SELECT 'person_scale', person_scale, count(*) FROM done WHERE status = '推荐' GROUP BY 2
UNION ALL SELECT 'angle_class', angle_class, count(*) FROM done WHERE status = '推荐' GROUP BY 2 UNION ALL SELECT 'pitch_class', pitch_class, count(*) FROM done WHERE status = '推荐' GROUP BY 2""", _POOL, _TOP, _DONE))
def stats_histograms(spark, sf_dir):
    return views.picked_histograms(_recommended(spark, sf_dir, 60))


# -- refresh and overlays


def _snapshots(spark, sf_dir):
    rows = raw_samples(spark, sf_dir)
    i = F.col("ord")
    file = lambda folder, time: F.struct(F.concat(F.lit(f"/{folder}/"), i, F.lit(".jpg")).alias("path_key"), time.alias("mtime_ns"))
    old = rows.where(i % 10 != 0).select(i.alias("ord"), F.concat(F.lit("id"), i).alias("sample_id"), "content_sha256", F.col("width").cast("long").alias("file_size"), "manual_status", file("a", i * 1000).alias("f")).select("*", "f.*").drop("f")
    moved = F.when(i % 13 == 0, file("b", i * 1000)).otherwise(file("a", F.when(i % 17 == 0, i * 1000 + 7).otherwise(i * 1000)))
    sha = F.when(i % 34 == 0, F.sha2(F.concat("content_sha256", F.lit("x")), 256)).otherwise(F.col("content_sha256")).alias("content_sha256")
    new = rows.select(i.alias("ord"), sha, F.col("width").cast("long").alias("file_size"), moved.alias("f")).select("*", "f.*").drop("f")
    return old, new


_FILES = """olds AS (SELECT ord, 'id' || ord AS sample_id, content_sha256 AS sha, width AS size, manual_status, '/a/' || ord || '.jpg' AS path_key, ord * 1000 AS mtime FROM raw WHERE ord % 10 <> 0),
news AS (SELECT ord, CASE WHEN ord % 34 = 0 THEN sha256(content_sha256 || 'x') ELSE content_sha256 END AS sha, width AS size, CASE WHEN ord % 13 = 0 THEN '/b/' ELSE '/a/' END || ord || '.jpg' AS path_key,
  CASE WHEN ord % 13 <> 0 AND ord % 17 = 0 THEN ord * 1000 + 7 ELSE ord * 1000 END AS mtime FROM raw),
here AS (SELECT n.path_key, n.sha, o.sample_id AS old_id, CASE WHEN o.sample_id IS NULL THEN 'new' WHEN n.size = o.size AND n.mtime = o.mtime THEN 'unchanged' WHEN n.sha = o.sha THEN 'touched' ELSE 'other' END AS c FROM news n LEFT JOIN olds o USING (path_key)),
spare AS (SELECT sha, min(sample_id) AS moved_id FROM olds WHERE sample_id NOT IN (SELECT old_id FROM here WHERE c IN ('unchanged', 'touched')) GROUP BY sha HAVING count(*) = 1),
moved AS (SELECT path_key, moved_id FROM (SELECT sha, min(path_key) AS path_key FROM here WHERE c IN ('new', 'other') GROUP BY sha) JOIN spare USING (sha)),
changes AS (SELECT here.path_key, CASE WHEN c IN ('unchanged', 'touched') THEN c WHEN moved_id IS NOT NULL THEN 'moved' WHEN c = 'new' THEN 'added' ELSE 'modified' END AS change,
  CASE WHEN c IN ('unchanged', 'touched') THEN old_id ELSE moved_id END AS sample_id FROM here LEFT JOIN moved USING (path_key))"""


@query(_s("SELECT path_key, change, sample_id FROM changes", _FILES))
def refresh_diff(spark, sf_dir):
    old, new = _snapshots(spark, sf_dir)
    return refresh.diff(new, old)


@query(_s("""SELECT (SELECT count(*) FROM news WHERE path_key NOT IN (SELECT path_key FROM olds)) AS added, count(*) FILTER (WHERE change IN ('unchanged', 'touched', 'moved')) AS unchanged, count(*) FILTER (WHERE change = 'modified') AS modified,
count(*) FILTER (WHERE change IN ('added', 'modified')) AS changed, (SELECT count(*) FROM olds WHERE path_key NOT IN (SELECT path_key FROM news)) AS deleted FROM changes""", _FILES))
def refresh_counters(spark, sf_dir):
    old, new = _snapshots(spark, sf_dir)
    return refresh.counters(refresh.diff(new, old), new, old)


@query(_s("""SELECT n.ord, CASE WHEN n.sha = o.sha THEN o.sample_id ELSE 'new' || n.ord END AS sample_id, CASE WHEN n.sha = o.sha THEN o.manual_status WHEN n.ord % 4 = 0 THEN '备选' END AS manual_status,
COALESCE(n.sha = o.sha AND n.ord % 3 = 0, false) AS duplicate_ignore, CASE WHEN n.sha = o.sha THEN 'patch' || n.ord END AS patch FROM news n LEFT JOIN olds o USING (path_key)""", _FILES))
def history_overlay(spark, sf_dir):
    old, new = _snapshots(spark, sf_dir)
    i, no = F.col("ord"), F.lit(False)
    said = lambda c: F.struct(c.alias("patch_id")).alias("ai_suggestion")
    old = old.withColumns({"duplicate_ignore": i % 3 == 0, "duplicate_reviewed": no}).select("*", said(F.concat(F.lit("patch"), i)))
    rows = new.withColumns({"sample_id": F.concat(F.lit("new"), i), "manual_status": F.lit(None).cast("string"), "duplicate_ignore": no, "duplicate_reviewed": no}).select("*", said(F.lit(None).cast("string")))
    legacy = new.where("ord % 4 = 0").select("path_key", F.lit("备选").alias("manual_status"))
    out = refresh.overlay_history(rows, old, legacy)
    return out.select("ord", "sample_id", "manual_status", "duplicate_ignore", F.col("ai_suggestion.patch_id").alias("patch"))


@query(_s("SELECT ord, CASE WHEN ord % 6 = 0 THEN CASE WHEN ord % 12 = 0 THEN '推荐' ELSE '淘汰' END ELSE manual_status END AS manual_status, CASE WHEN ord % 6 = 0 THEN 2 ELSE 0 END::BIGINT AS composite_scan_version FROM raw"))
def pending_overlay(spark, sf_dir):
    i = F.col("ord")
    rows = raw_samples(spark, sf_dir).withColumns({"path_key": i.cast("string"), "composite_scan_version": F.lit(0)})
    pending = rows.where(i % 6 == 0).select("path_key", F.when(i % 12 == 0, PICKED).otherwise("淘汰").alias("status"))
    return refresh.overlay_pending(rows, pending, COMPOSITE_VERSION).select("ord", "manual_status", *_long("composite_scan_version"))


@query(_s("""SELECT p.sample_id, CASE WHEN r.ord IS NULL THEN 'unknown' WHEN p.sha <> '' AND p.sha <> r.content_sha256 THEN 'stale' WHEN p.e NOT IN ('PASS', 'REVIEW', 'REJECT') THEN 'invalid' ELSE 'pending' END AS outcome
FROM (SELECT 'img_' || lpad((CASE WHEN doc_id % 8 = 0 THEN doc_id + 1000000 ELSE doc_id END)::VARCHAR, 8, '0') AS sample_id, CASE WHEN doc_id % 9 = 0 THEN 'old' ELSE '' END AS sha, CASE WHEN doc_id % 31 = 0 THEN 'BAD' WHEN quality = 1 THEN 'PASS' ELSE 'REVIEW' END AS e FROM labels) p LEFT JOIN s r USING (sample_id)"""))
def patch_classify(spark, sf_dir):
    i = F.col("doc_id")
    ident = F.concat(F.lit("img_"), F.lpad(F.when(i % 8 == 0, i + 1_000_000).otherwise(i).cast("string"), 8, "0"))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    patch = labels.select(ident.alias("sample_id"), F.when(i % 9 == 0, "old").otherwise("").alias("content_sha256"), F.when(i % 31 == 0, "BAD").when(F.col("quality") == 1, "PASS").otherwise("REVIEW").alias("suggested_eligibility"), F.lit(None).cast("string").alias("suggested_status"))
    return refresh.classify_patch(patch, samples(spark, sf_dir)).select("sample_id", "outcome")


@query(_s("SELECT content_sha256, min(sample_id) AS sample_id FROM s GROUP BY 1 HAVING count(*) = 1"))
def unique_hash_match(spark, sf_dir):
    return refresh.unique_hash(samples(spark, sf_dir))


# -- regions and boxes

_REGIONS = """regions AS (SELECT event_id, 'u' || user_id % 20 AS source, x0, y0, x0 + 40 + event_id % 300 AS x1, y0 + 10 + event_id % 30 AS y1, (event_id % 100) / 100.0 AS score
FROM (SELECT event_id, user_id, (event_id * 7) % 640 AS x0, (event_id * 13) % 500 AS y0 FROM events)),
centred AS (SELECT *, (x0 + x1)::DOUBLE / 2 / 1000 AS cx, (y0 + y1)::DOUBLE / 2 / 600 AS cy FROM regions),
binned AS (SELECT *, round_even(cx, 1) AS bx, round_even(cy, 1) AS by_ FROM centred)"""


def _records(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    i = F.col("event_id")
    box = {"x0": (i * 7) % 640, "y0": (i * 13) % 500}
    own = e.select("event_id", F.concat(F.lit("u"), F.col("user_id") % 20).alias("source"), *[v.cast("int").alias(k) for k, v in box.items()])
    own = own.withColumns({"x1": (F.col("x0") + 40 + i % 300).cast("int"), "y1": (F.col("y0") + 10 + i % 30).cast("int")})
    corner = lambda a, b: F.array(F.col(a), F.col(b))
    poly = F.array(corner("x0", "y0"), corner("x1", "y0"), corner("x1", "y1"), corner("x0", "y1"))
    return own.select("event_id", F.col("event_id").cast("string").alias("path"), "source", F.lit(1000).alias("width"), F.lit(600).alias("height"), F.array(F.struct(poly.alias("poly"), F.lit(False).alias("selected"), F.lit(False).alias("manual"), ((i % 100) / 100.0).alias("score"), F.lit(False).alias("suggested"))).alias("regions"))


@query("WITH " + _REGIONS + " SELECT event_id::VARCHAR AS path, ((cy < .18 OR cy > .70) AND (x1 - x0) / 1000.0 >= .12 AND (x1 - x0) / (y1 - y0)::DOUBLE >= 1.35) OR (count(*) OVER (PARTITION BY source, bx, by_) >= 2 AND (cy < .18 OR cy > .70) AND (x1 - x0) / 1000.0 >= .06) AS suggested FROM binned")
def region_repeat_counts(spark, sf_dir):
    return regions.suggest(_records(spark, sf_dir)).select("path", "suggested")


@query("WITH " + _REGIONS + " SELECT event_id, (y1 - y0 >= 24 AND (x1 - x0) * (y1 - y0) >= 2000 AND score >= .5)::BIGINT AS eligible FROM regions")
def region_eligible(spark, sf_dir):
    own = _records(spark, sf_dir)
    kept = regions.eligible_regions(F.col("regions"), F.col("width"), F.col("height"), min_height=24, min_area=2000, min_score=0.5)
    return own.select("event_id", F.size(kept).cast("long").alias("eligible"))


def _boxes(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    x0, y0 = (F.col("l_partkey") % 500).cast("int"), (F.col("l_suppkey") % 300).cast("int")
    w, h = (F.col("l_quantity") * 6 + 20).cast("int"), (F.col("l_quantity") * 4 + 30).cast("int")
    return li.select("l_orderkey", "l_linenumber", F.array(x0, y0, x0 + w, y0 + h).alias("box"))


_BOXES = "boxes AS (SELECT l_orderkey, l_linenumber, (l_partkey % 500)::INT AS x0, (l_suppkey % 300)::INT AS y0, (l_partkey % 500 + l_quantity * 6 + 20)::INT AS x1, (l_suppkey % 300 + l_quantity * 4 + 30)::INT AS y1 FROM lineitem)"


@query("WITH " + _BOXES + """, padded AS (SELECT l_orderkey, l_linenumber, greatest(0, x0 - 32) AS a, greatest(0, y0 - 32) AS b, least(640, x1 + 32) AS c, least(480, y1 + 32) AS d FROM boxes)
SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, a || ',' || b || ',' || c || ',' || d AS box FROM padded WHERE 1.0 - (c - a) * (d - b) / 307200.0 >= 0.05""")
def crop_proposals(spark, sf_dir):
    own = _boxes(spark, sf_dir).withColumn("p", g.crop_proposal(F.col("box"), F.lit(640), F.lit(480))).where("p is not null")
    return own.select("l_orderkey", *_long("l_linenumber"), F.array_join(F.col("p.box").cast("array<string>"), ",").alias("box"))


@query()
def composite_geometry(spark, sf_dir):
    kind = "struct<bbox:array<int>,confidence:double>"
    found = F.struct(F.col("box").alias("bbox"), (F.lit(1.0) / (F.col("l_linenumber") + 1)).cast("double").alias("confidence"))
    own = _boxes(spark, sf_dir).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", found.alias("d")))).alias("ds"))  # at most seven lines an order
    people = F.transform("ds", lambda d: d["d"])
    heads = F.slice(people, 1, 2)
    own = own.withColumn("p", g.composite_proposal(people, heads, F.lit(1000), F.lit(600), kind))
    return own.select("l_orderkey", "p.mode", F.array_join(F.transform("p.boxes", lambda b: F.array_join(b.cast("array<string>"), ",")), ";").alias("boxes"))


# -- plans


def _plan(spark, sf_dir):
    i = F.col("ord")
    root = F.when(i % 7 == 0, F.concat(F.lit("/data/"), F.col("status"), F.lit("/"))).when(i % 11 == 0, F.lit("/data/Archive/")).otherwise(F.lit("/data/"))
    stored = F.when(i % 5 == 0, F.concat(F.lit("kept/"), i % 900, F.lit(".jpg")))
    rows = _rows(spark, sf_dir).select("sample_id", "status", F.concat(root, "relative_path").alias("path"), stored.alias("origin_relative_path"))
    return moves.move_plan(rows, "/data", ["archive"]), rows


_PLAN = """paths AS (SELECT sample_id, status, ord, relative_path AS r, CASE WHEN ord % 7 = 0 THEN '/data/' || status || '/' WHEN ord % 11 = 0 THEN '/data/Archive/' ELSE '/data/' END || relative_path AS path FROM s),
plan AS (SELECT sample_id, path, '/data/' || status || '/' || CASE WHEN ord % 5 = 0 THEN 'kept/' || ord % 900 || '.jpg' WHEN ord % 7 = 0 OR ord % 11 <> 0 THEN r ELSE 'Archive/' || r END AS destination, ord % 7 <> 0 AND ord % 11 = 0 AS skip FROM paths)"""


@query(_s("SELECT sample_id, path, destination, CASE WHEN skip THEN 'skipped' WHEN lower(path) = lower(destination) THEN 'unchanged' ELSE 'move' END AS outcome FROM plan", _PLAN))
def move_plan(spark, sf_dir):
    return _plan(spark, sf_dir)[0].select("sample_id", "path", "destination", "outcome")


@query(_s("""SELECT 'duplicate' AS kind, lower(destination) AS destination_key FROM plan WHERE NOT skip AND lower(path) <> lower(destination) GROUP BY 2 HAVING count(*) > 1
UNION ALL SELECT DISTINCT 'exists', lower(destination) FROM plan WHERE NOT skip AND lower(path) <> lower(destination) AND lower(destination) IN (SELECT lower(path) FROM plan UNION ALL SELECT lower('/data/推荐/kept/' || ord || '.jpg') FROM s WHERE ord % 3 = 0)
  AND lower(destination) NOT IN (SELECT lower(path) FROM plan WHERE NOT skip AND lower(path) <> lower(destination))""", _PLAN))
def move_conflicts(spark, sf_dir):
    plan, rows = _plan(spark, sf_dir)
    strays = samples(spark, sf_dir).where("ord % 3 = 0").select(F.concat(F.lit("/data/推荐/kept/"), "ord", F.lit(".jpg")).alias("path"))
    return moves.conflicts(plan, rows.select("path").unionByName(strays))


@query(_s("SELECT CASE WHEN v <> 2 THEN 'composite' ELSE 'auto_crop' END AS stage, sample_id, path FROM (SELECT sample_id, relative_path AS path, ord % 3 AS v, CASE ord % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'rejected' END AS d, ord % 5 AS c FROM s WHERE status <> '淘汰') WHERE v <> 2 OR (COALESCE(d, 'rejected') = 'rejected' AND c NOT IN (1, 2))"))
def enrichment_plan(spark, sf_dir):
    i = F.col("ord")
    rows = _rows(spark, sf_dir).withColumns({
        "status": F.when(F.col("status") == "淘汰", "淘汰").otherwise(PICKED),
        "path": F.col("relative_path"),
        "composite_scan_version": (i % 3).cast("int"),
        "composite_decision": F.when(i % 4 == 0, "pending").when(i % 4 == 1, "rejected"),
        "crop_version": F.when(i % 5 < 3, (i % 5).cast("int")),
        "crop_box": F.lit(None).cast("array<int>"),
        "crop_state": F.lit("no_candidate"),
    })
    return decisions.enrichment_plan(rows)


@query(_s("SELECT ord, sample_id FROM s WHERE status = '推荐' AND ord % 2 = 0 AND ord % 15 <> 0"))
def late_results(spark, sf_dir):
    """Results of one epoch; a third comes under ids that are no more, and is found by its path, unless that is no more either."""
    i = F.col("ord")
    rows = _rows(spark, sf_dir).withColumn("path", F.col("relative_path"))
    lost = F.when(i % 15 == 0, F.lit("/nowhere")).otherwise(F.upper("path"))
    results = rows.select("ord", F.when(i % 3 == 0, F.concat(F.lit("old"), i)).otherwise(F.col("sample_id")).alias("sample_id"), F.when(i % 3 == 0, lost).otherwise(F.lit("/nowhere")).alias("path"), (i % 2).alias("epoch"))
    return current_results(results, rows, 0).select("ord", "sample_id")


@query(_s("""SELECT st AS status, count(p.sample_id) AS n FROM (VALUES ('推荐'), ('备选'), ('淘汰')) d(st) LEFT JOIN (SELECT plan.*, s.status FROM plan JOIN s USING (sample_id) WHERE NOT skip AND lower(path) <> lower(destination)) p ON st = p.status GROUP BY 1""", _PLAN))
def move_counts(spark, sf_dir):
    return moves.move_counts(_plan(spark, sf_dir)[0])


def _all() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]]:
    from . import kept, pixels, reviews, stored  # noqa: F401  register their queries here

    return _found


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, (f, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _all().items() if sql}
