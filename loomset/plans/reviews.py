"""Registered queries of decisions, stored states, sorts and geometry, with the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expressions as x
from ..functions import geometry as g
from ..functions import kernels
from ..operators import decisions, dupes, refresh, regions, states, views
from ..schema import FINDING_TEXTS
from ..sources import images
from ..sources.images import raw_samples, samples
from .catalogue import _BOXES, _FILES, _REGIONS, _boxes, _long, _records, _rows, _s, _snapshots, query

_ANY = "ranks AS (SELECT ord, row_number() OVER (PARTITION BY duplicate_group ORDER BY face_quality DESC, brisque, blur DESC, ord) AS k FROM s WHERE duplicate_group <> 0)"


def _marked(spark, sf_dir):
    return _rows(spark, sf_dir).withColumns({"duplicate_reviewed": F.lit(False), "duplicate_ignore": F.col("ord") % 29 == 0})


def _picks(spark, sf_dir, every):
    return _rows(spark, sf_dir).where(F.col("ord") % every == 0).select("sample_id")


# -- decisions on groups


@query(_s("SELECT ord, CASE status WHEN '推荐' THEN '备选' WHEN '备选' THEN '推荐' ELSE '备选' END AS toggled FROM s"))
def toggled_status(spark, sf_dir):
    return _rows(spark, sf_dir).select("ord", dupes.toggle(F.col("status")).alias("toggled"))


@query(_s("SELECT ord, CASE WHEN duplicate_group = 1 THEN CASE WHEN k = 1 THEN '推荐' ELSE '淘汰' END ELSE manual_status END AS manual_status, duplicate_group = 1 AS reviewed FROM s LEFT JOIN ranks USING (ord)", _ANY))
def keep_best_of_group(spark, sf_dir):
    return dupes.keep_best(_marked(spark, sf_dir), 1).select("ord", "manual_status", F.col("duplicate_reviewed").alias("reviewed"))


@query(_s("SELECT ord, CASE WHEN duplicate_group <> 0 THEN CASE WHEN ord % 3 = 0 THEN '推荐' ELSE '淘汰' END ELSE manual_status END AS manual_status, duplicate_group <> 0 AS reviewed FROM s"))
def apply_checked_groups(spark, sf_dir):
    return dupes.apply_checked(_marked(spark, sf_dir), _picks(spark, sf_dir, 3)).select("ord", "manual_status", F.col("duplicate_reviewed").alias("reviewed"))


@query(_s("SELECT ord, CASE duplicate_group WHEN 1 THEN '推荐' WHEN 2 THEN NULL ELSE manual_status END AS manual_status, duplicate_group = 1 AS reviewed FROM s"))
def keep_all_and_restore(spark, sf_dir):
    return dupes.restore_auto(dupes.keep_all(_marked(spark, sf_dir), 1), 2).select("ord", "manual_status", F.col("duplicate_reviewed").alias("reviewed"))


@query(_s("SELECT ord, ord % 29 = 0 OR ord % 5 = 0 AS duplicate_ignore, ord % 5 = 0 AND ord % 29 <> 0 AS changed FROM s"))
def ignored_rows(spark, sf_dir):
    return dupes.set_ignored(_marked(spark, sf_dir), _picks(spark, sf_dir, 5)).select("ord", "duplicate_ignore", "changed")


@query(_s("SELECT ord FROM s WHERE duplicate_group = 1 UNION ALL SELECT ord FROM s WHERE ord % 29 = 0"))
def members_of_groups(spark, sf_dir):
    rows = _marked(spark, sf_dir)
    return dupes.group_members(rows, 1).select("ord").unionByName(dupes.group_members(rows, -1).select("ord"))


@query(_s("SELECT DISTINCT duplicate_group::BIGINT AS duplicate_group FROM s WHERE duplicate_group <> 0"))
def group_numbers(spark, sf_dir):
    return dupes.group_ids(_rows(spark, sf_dir)).select(*_long("duplicate_group"))


# -- suggestions, crops and composites


@query(_s("""SELECT ord, CASE WHEN ord % 3 = 0 THEN COALESCE(CASE WHEN ord % 4 = 0 THEN '备选' END, CASE ord % 5 WHEN 0 THEN '淘汰' WHEN 1 THEN '备选' END, manual_status) ELSE manual_status END AS manual_status,
CASE ord % 3 WHEN 0 THEN 'accepted' WHEN 1 THEN 'rejected' END AS decision FROM s"""))
def suggestion_decisions(spark, sf_dir):
    i, no = F.col("ord"), F.lit(None).cast("string")
    said = {"patch_id": F.lit("p"), "bundle_id": F.lit("b"), "suggested_eligibility": F.when(i % 5 == 0, "REJECT").when(i % 5 == 1, "REVIEW").when(i % 5 == 2, "PASS"), "suggested_status": F.when(i % 4 == 0, "备选"), "flags": F.array().cast("array<string>"), "note": no, "request_full_resolution": F.lit(False), "decision": F.lit("pending")}
    rows = _rows(spark, sf_dir).withColumn("ai_suggestion", F.struct(*[c.alias(n) for n, c in said.items()]))
    actions = rows.select("sample_id", F.when(i % 3 == 0, "accept").when(i % 3 == 1, "reject").otherwise("clear").alias("action"))
    return refresh.decide_suggestion(rows, actions).select("ord", "manual_status", F.col("ai_suggestion.decision").alias("decision"))


@query("""SELECT doc_id AS sample, CASE WHEN doc_id % 9 = 0 THEN 'unknown' WHEN doc_id % 7 = 0 THEN 'stale' WHEN doc_id % 5 = 0 THEN 'invalid' ELSE 'pending' END AS outcome FROM documents""")
def patch_types(spark, sf_dir):
    i = F.col("ord")
    rows = raw_samples(spark, sf_dir).select(i, F.concat(F.lit("img"), i).alias("sample_id"), "content_sha256")
    patch = rows.select("ord", F.when(i % 9 == 0, F.concat(F.lit("no"), i)).otherwise(F.col("sample_id")).alias("sample_id"), F.when(i % 7 == 0, "old").when(i % 2 == 0, F.col("content_sha256")).otherwise("").alias("content_sha256"), F.when(i % 10 == 5, "MAYBE").alias("suggested_eligibility"), F.lit(None).cast("string").alias("suggested_status"), F.when(i % 10 != 0, "note").alias("note"))
    return refresh.classify_patch(patch, rows.drop("ord")).select(i.alias("sample"), "outcome")


_CROPS = _BOXES + """, crops AS (SELECT l_orderkey, l_linenumber, x0, y0, x1, y1, l_linenumber % 4 AS step, greatest(0, least(x0 - 30, 639)) AS a, greatest(0, least(y0 - 10, 479)) AS b FROM boxes),
edited AS (SELECT *, least(greatest(x1 + 700, a + 1), 640) AS c, least(greatest(y1, b + 1), 480) AS d FROM crops)"""


@query("WITH " + _CROPS + """ SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, CASE step WHEN 0 THEN 'accepted' WHEN 1 THEN 'keep_original' ELSE 'pending' END AS decision,
CASE WHEN step = 3 THEN x0 || ',' || y0 || ',' || x1 || ',' || y1 ELSE a || ',' || b || ',' || c || ',' || d END AS box, step <> 3 AND (a <> x0 OR b <> y0 OR c <> x1 OR d <> y1) AS adjusted FROM edited""")
def crop_decisions(spark, sf_dir):
    own = _boxes(spark, sf_dir).withColumn("p", F.struct(F.col("box").alias("auto_box"), F.col("box"), F.lit("accepted").alias("decision"), F.lit(False).alias("manually_adjusted")))
    b = F.col("box")
    own = own.withColumn("p", decisions.edit_crop(F.col("p"), F.array(b[0] - 30, b[1] - 10, b[2] + 700, b[3]), F.lit(640), F.lit(480)))
    step = F.col("l_linenumber") % 4
    actions = ("accept", "keep_original", "restore_pending", "reset")
    made = F.coalesce(*[F.when(step == k, decisions.decide_crop(F.col("p"), a)) for k, a in enumerate(actions)])
    own = own.withColumn("p", made)
    return own.select("l_orderkey", *_long("l_linenumber"), F.col("p.decision").alias("decision"), F.array_join(F.col("p.box").cast("array<string>"), ",").alias("box"), F.col("p.manually_adjusted").alias("adjusted"))


@query("WITH " + _BOXES + """, stored AS (SELECT *, l_linenumber % 3 AS version, CASE l_orderkey % 4 WHEN 0 THEN 'accepted' WHEN 1 THEN 'pending' WHEN 2 THEN 'keep_original' ELSE 'odd' END AS decision FROM boxes)
SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, CASE WHEN version > 0 AND decision <> 'odd' THEN decision END AS decision, CASE WHEN version > 0 AND decision <> 'odd' THEN version = 2 AND l_linenumber % 2 = 0 END AS adjusted FROM stored""")
def crop_states(spark, sf_dir):
    k, b = F.col("l_linenumber"), F.col("box")
    auto = F.when(k % 2 == 0, F.array(b[0], b[1], b[2] + 1, b[3])).otherwise(b)
    said = F.element_at(F.array(*map(F.lit, ("accepted", "pending", "keep_original", "odd"))), (F.col("l_orderkey") % 4 + 1).cast("int"))
    own = _boxes(spark, sf_dir).withColumn("p", F.struct((k % 3).cast("int").alias("version"), b, auto.alias("auto_box"), said.alias("decision")))
    p = decisions.decode_crop(F.col("p"), F.lit(640), F.lit(480))
    return own.withColumn("p", p).select("l_orderkey", *_long("l_linenumber"), F.col("p.decision").alias("decision"), F.col("p.manually_adjusted").alias("adjusted"))


def _crops(spark, sf_dir):
    i = F.col("ord")
    return _rows(spark, sf_dir).withColumns({
        "path": F.col("relative_path"),
        "crop_decision": F.when(i % 3 == 0, "accepted").when(i % 3 == 1, "pending"),
        "crop_box": F.when(i % 3 != 2, F.array(F.lit(1), F.lit(2), F.col("width"), F.col("height"))),
        "crop_version": F.when(i % 4 != 0, 2),
        "crop_state": F.lit("scanned"),
        "composite_decision": F.when(i % 6 == 0, "pending").when(i % 6 == 1, "accepted").when(i % 6 == 2, "rejected").when(i % 6 == 3, "odd"),
        "composite_scan_version": (i % 3).cast("int"),
    })


@query(_s("SELECT ord, CASE WHEN status = '推荐' AND ord % 3 = 0 THEN 'accepted' WHEN status = '推荐' AND ord % 3 = 1 THEN 'pending' ELSE '' END AS badge FROM s"))
def crop_badges(spark, sf_dir):
    return _crops(spark, sf_dir).select("ord", decisions.crop_badge().alias("badge"))


@query(_s("""SELECT * FROM (SELECT 'auto_crop_unscanned' AS code, count(*) FILTER (WHERE ord % 4 = 0) AS n FROM s WHERE status = '推荐' UNION ALL SELECT 'auto_crop_pending', count(*) FILTER (WHERE ord % 3 = 1) FROM s WHERE status = '推荐'
UNION ALL SELECT 'composite_pending', count(*) FILTER (WHERE ord % 6 = 0) FROM s WHERE status = '推荐') WHERE n > 0"""))
def export_gates(spark, sf_dir):
    return decisions.gates(_crops(spark, sf_dir)).select("code", "n")


@query(_s("SELECT ord, relative_path AS path, CASE WHEN ord % 3 = 0 THEN '1,2,' || width || ',' || height END AS crop FROM s WHERE status = '推荐'"))
def export_files(spark, sf_dir):
    return decisions.export_plan(_crops(spark, sf_dir)).select("ord", "path", F.array_join(F.col("crop_box").cast("array<string>"), ",").alias("crop"))


@query(_s("SELECT count(*) FILTER (WHERE ord % 6 IN (0, 3)) AS pending, count(*) FILTER (WHERE ord % 6 = 1) AS accepted, count(*) FILTER (WHERE ord % 6 = 2) AS rejected FROM s"))
def composite_decisions(spark, sf_dir):
    return decisions.decision_counts(_crops(spark, sf_dir))


@query(_s("SELECT ord, status = '推荐' AND ord % 6 < 4 AS shown, status = '推荐' AND ord % 3 <> 2 AS todo FROM s"))
def composite_lists(spark, sf_dir):
    rows = _crops(spark, sf_dir)
    todo = states.composite_todo(rows).select("ord", F.lit(True).alias("todo"))
    return rows.join(todo, "ord", "left").select("ord", states.composite_shown().alias("shown"), F.coalesce("todo", F.lit(False)).alias("todo"))


@query(_s("SELECT count(*) FILTER (WHERE ord % 3 < 2) AS scanned, count(*) FILTER (WHERE ord % 3 = 0) AS candidates, count(*) FILTER (WHERE ord % 3 = 1) AS no_candidate, count(*) FILTER (WHERE ord % 3 = 2) AS skipped_existing FROM s"))
def crop_scan_counts(spark, sf_dir):
    i = F.col("ord")
    return decisions.scan_result(_rows(spark, sf_dir).withColumn("outcome", F.when(i % 3 == 0, "candidate").when(i % 3 == 1, "no_candidate").otherwise("skipped_existing")))


@query("WITH " + _BOXES + """, numbered AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, x0, y0, x1, y1) AS k FROM boxes)
SELECT l_orderkey || '/a.png' AS path, 'a__split_' || lpad(k::VARCHAR, 2, '0') AS name, x0 || ',' || y0 || ',' || x1 || ',' || y1 AS box, CASE WHEN k % 2 = 1 THEN '推荐' ELSE '淘汰' END AS status FROM numbered""")
def composite_outputs(spark, sf_dir):
    own = _boxes(spark, sf_dir).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "box"))).alias("b"))  # at most seven lines an order
    rows = own.select(F.concat("l_orderkey", F.lit("/a.png")).alias("path"), F.lit("a").alias("stem"), F.lit("split_people").alias("mode"), F.transform("b", lambda v: v["box"]).alias("boxes"), F.transform("b", lambda v, k: k % 2 == 0).alias("keep"))
    return decisions.materialised(rows).select("path", "name", F.array_join(F.col("box").cast("array<string>"), ",").alias("box"), "status")


# -- sorts and samples

_SORTS = {
    "默认顺序": "ord", "质量排序": "face_quality DESC, brisque, blur DESC", "Face Quality": "face_quality DESC", "BRISQUE": "brisque", "Sharpness": "blur DESC", "Face Pixels": "face_px DESC", "状态": "list_position(['推荐', '备选', '淘汰'], status)",
    "Eligibility": "list_position(['PASS', 'REVIEW', 'REJECT'], eligibility)", "Duplicate Group": "duplicate_group = 0, duplicate_group", "来源目录 / 源视频": "source", "景别": "list_position(['近景/头肩', '半身', '大半身', '全身'], person_scale)",
    "Yaw": "list_position(['正脸', '左3/4', '右3/4', '左侧脸', '右侧脸'], angle_class)", "Pitch": "list_position(['正常', '仰头', '低头'], pitch_class)",
}


@query(_s(" UNION ALL ".join(f"SELECT * FROM (SELECT '{name}' AS field, ord, row_number() OVER (ORDER BY {keys}, ord) AS place FROM s) WHERE place <= 30" for name, keys in _SORTS.items())))
def sort_fields(spark, sf_dir):
    """The first 30 rows of each sort field: the feature is the order."""
    from ..storage import cut

    rows, out = cut(_rows(spark, sf_dir).drop("review_flags", "hard_rejects"), "rows"), None
    for name in _SORTS:
        top = rows.orderBy(*views.sort_keys(name)).limit(30).select("ord")
        order = views.sort_keys(name)
        own = rows.join(top, "ord", "left_semi").select(F.lit(name).alias("field"), "ord", F.row_number().over(views.Window.partitionBy(F.lit(name)).orderBy(*order)).cast("long").alias("place"))
        out = own if out is None else out.unionByName(own)
    return out


@query(_s("SELECT ord FROM (SELECT ord, row_number() OVER (ORDER BY ord) - 1 AS k, count(*) OVER () AS n FROM s) WHERE k IN (SELECT round_even(j * ((SELECT count(*) FROM s) - 1) / 16.0, 0)::BIGINT FROM range(17) r(j))"))
def evenly_spaced(spark, sf_dir):
    return views.even_sample(_rows(spark, sf_dir), 17).select("ord")


# -- names, findings and records


@query(_s("SELECT ord, CASE WHEN len(flags) > 0 THEN flags[1] ELSE '' END AS first_code, CASE WHEN ord % 4 = 0 THEN 'legacy' ELSE 'image' END AS source FROM s"))
def finding_decode(spark, sf_dir):
    own = samples(spark, sf_dir).withColumn("code", F.coalesce(F.get(x.codes(F.col("review_flags")), 0), F.lit("")))
    text = F.when(F.col("ord") % 4 == 0, F.col("code")).otherwise(F.to_json(F.struct("code", F.lit("image").alias("source"))))
    return own.withColumn("f", states.decode_finding(text)).select("ord", F.col("f.code").alias("first_code"), F.col("f.source").alias("source"))


@query(_s("SELECT ord, sample_id, content_sha256, width::BIGINT AS width, face_quality, '未检测' AS angle_class, manual_status, array_to_string(flags, '|') AS flags, CASE WHEN ord % 5 = 0 THEN 0 ELSE 2 END::BIGINT AS scan_version, ord % 5 <> 0 AND ord % 2 = 0 AS has_proposal FROM s"))
def record_round_trip(spark, sf_dir):
    i = F.col("ord")
    proposal = F.when(i % 2 == 0, F.to_json(F.struct(F.when(i % 5 == 0, 1).otherwise(2).alias("version"), F.array(F.array(F.lit(1), F.lit(2), F.lit(3), F.lit(4))).alias("output_boxes"))))
    old = F.when(i % 5 == 0, F.coalesce(proposal, F.lit('{"version":1}'))).otherwise(proposal)
    rows = _rows(spark, sf_dir).select("ord", "sample_id", "content_sha256", "width", "face_quality", "manual_status", "review_flags", F.lit(2).alias("composite_scan_version"), old.alias("proposal"))
    texts = states.encode_records(rows.drop("proposal")).select(F.get_json_object("record", "$.ord").cast("long").alias("ord"), "record")
    whole = texts.join(rows.select("ord", "proposal"), "ord").select("ord", F.when(F.col("proposal").isNull(), F.col("record")).otherwise(F.concat(F.expr("left(record, length(record) - 1)"), F.lit(',"composite_proposal":'), "proposal", F.lit("}"))).alias("record"))
    out = states.decode_records(whole)
    return out.select("ord", "sample_id", "content_sha256", *_long("width"), "face_quality", "angle_class", "manual_status", F.array_join(x.codes(F.col("review_flags")), "|").alias("flags"), F.col("composite_scan_version").cast("long").alias("scan_version"), F.col("composite_proposal").isNotNull().alias("has_proposal"))


@query(_s("SELECT content_sha256, string_agg(lower(relative_path), '|' ORDER BY lower(relative_path)) AS paths FROM s WHERE ord % 3 <> 0 GROUP BY 1"))
def paths_by_content(spark, sf_dir):
    rows = _rows(spark, sf_dir).select(x.path_key(F.col("relative_path")).alias("path_key"), "content_sha256", F.when(F.col("ord") % 3 == 0, 2).otherwise(3).alias("version"), F.lit(4).alias("analysis_version"))
    return states.by_hash(rows).select("content_sha256", F.array_join("paths", "|").alias("paths"))


@query(_s("SELECT lower(relative_path) AS path_key, manual_status FROM s WHERE ord % 4 IN (1, 2) AND manual_status IS NOT NULL"))
def legacy_states(spark, sf_dir):
    rows = _rows(spark, sf_dir).select(x.path_key(F.col("relative_path")).alias("path_key"), "manual_status", (F.col("ord") % 4).alias("version"))
    return images.legacy_manual(rows)


@query(_s("SELECT ord, CASE WHEN contains(relative_path, '_frame_') THEN regexp_replace(split_part(relative_path, '/', -1), '_frame_.*$', '') END AS label, '.' || CASE ord % 4 WHEN 0 THEN 'jpg' WHEN 1 THEN 'png' WHEN 2 THEN 'webp' ELSE 'png' END AS suffix, left(sha256(relative_path), 24) AS digest FROM s"))
def export_names(spark, sf_dir):
    name = F.concat(F.lit("x."), F.element_at(F.array(*map(F.lit, ("JPG", "gif", "webp", "txt"))), (F.col("ord") % 4 + 1).cast("int")))
    return _rows(spark, sf_dir).select("ord", x.export_source_label(F.col("relative_path"), F.lit("root")).alias("label"), x.output_suffix(name).alias("suffix"), x.cache_digest(F.col("relative_path")).alias("digest"))


@query("SELECT doc_id, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.0f KB', round_even(n / 1024.0, 0)) WHEN n < 1073741824 THEN printf('%.1f MB', n / 1048576.0) ELSE printf('%.1f GB', n / 1073741824.0) END AS size FROM (SELECT doc_id, n_chars::BIGINT * CASE doc_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 1021 WHEN 2 THEN 99991 ELSE 9999991 END AS n FROM documents)")
def readable_sizes(spark, sf_dir):
    k = F.col("doc_id") % 4
    n = F.col("n_chars").cast("long") * F.when(k == 0, 1).when(k == 1, 1021).when(k == 2, 99991).otherwise(9999991)
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", x.human_bytes(n).alias("size"))


_SAID = "CASE c " + " ".join(f"WHEN '{c}' THEN '{t}'" for c, t in FINDING_TEXTS.items() if "%d" not in t) + " WHEN 'secondary_faces_detected' THEN '" + FINDING_TEXTS["secondary_faces_detected"].replace("%d", "' || faces || '") + "' END"


@query(_s(f"""SELECT ord, array_to_string(CASE WHEN ord % 13 = 0 THEN [] ELSE list_concat(flags, CASE WHEN ord % 10 = 0 THEN ['head_pose_error'] ELSE [] END, CASE WHEN ord % 6 = 0 THEN ['brisque_error'] ELSE [] END) END, '|') AS codes,
array_to_string(CASE WHEN ord % 13 = 0 THEN ['{FINDING_TEXTS["read_error"]}broken'] ELSE list_concat(list_transform(list_concat(rejects, flags), lambda c: {_SAID}), CASE WHEN ord % 10 = 0 THEN ['head_pose_error'] ELSE [] END, CASE WHEN ord % 6 = 0 THEN ['failed'] ELSE [] END) END, '|') AS texts,
CASE WHEN ord % 13 = 0 OR len(rejects) > 0 THEN 'REJECT' WHEN len(flags) > 0 OR ord % 6 = 0 OR ord % 10 = 0 THEN 'REVIEW' ELSE 'PASS' END AS eligibility FROM s"""))
def stage_errors(spark, sf_dir):
    """Findings with those of failed stages, as they are said: the detail, or the code where there is none; and unreadable images."""
    i = F.col("ord")
    errors = F.create_map(F.lit("brisque_error"), F.when(i % 6 == 0, "failed"), F.lit("head_pose_error"), F.when(i % 10 == 0, ""))
    own = samples(spark, sf_dir)
    flags, rejects = x.unless_unreadable(x.with_stage_errors(F.col("review_flags"), errors), F.col("hard_rejects"), F.when(i % 13 == 0, "broken"))
    own = own.withColumns({"flags": flags, "rejects": rejects})
    return own.select("ord", F.array_join(x.codes(F.col("flags")), "|").alias("codes"), F.array_join(F.transform(F.concat("rejects", "flags"), x.finding_text), "|").alias("texts"), x.eligibility(F.col("rejects"), F.col("flags")).alias("eligibility"))


# -- text regions


@query("WITH " + _REGIONS + ", rows AS (SELECT event_id, y1 - y0 >= 24 AND (x1 - x0) * (y1 - y0) >= 2000 AND score >= .5 AS e, event_id % 3 = 0 AS sel, event_id % 5 = 0 AS man FROM regions) SELECT event_id, e AND sel AS repair, e AS text, e AND man AS manual FROM rows")
def text_views(spark, sf_dir):
    own = _regions(spark, sf_dir)
    kept = regions.eligible_regions(F.col("regions"), F.col("width"), F.col("height"), min_height=24, min_area=2000, min_score=0.5)
    own = own.withColumn("kept", kept)
    return own.select("event_id", *[regions.view_mode(F.col("kept"), m).alias(m) for m in ("repair", "text", "manual")])


def _regions(spark, sf_dir):
    i = F.col("event_id")
    mark = lambda r: r.withField("selected", i % 3 == 0).withField("manual", i % 5 == 0).withField("suggested", i % 2 == 0)
    return _records(spark, sf_dir).withColumn("regions", F.transform("regions", mark))


@query("WITH " + _REGIONS + " SELECT sum(CASE WHEN e THEN 1 ELSE 0 END)::BIGINT AS eligible, sum(CASE WHEN e AND event_id % 3 = 0 THEN 1 ELSE 0 END)::BIGINT AS selected, count(*) FILTER (WHERE event_id % 5 = 0) AS manual_records FROM (SELECT *, y1 - y0 >= 24 AND (x1 - x0) * (y1 - y0) >= 2000 AND score >= .5 AS e FROM regions)")
def text_totals(spark, sf_dir):
    return regions.totals(_regions(spark, sf_dir), min_height=24, min_area=2000, min_score=0.5)


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN 2 WHEN 1 THEN 0 ELSE 1 END::BIGINT AS n, CASE event_id % 3 WHEN 0 THEN 1 + CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END WHEN 1 THEN 0 ELSE CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END END::BIGINT AS selected FROM events")
def text_edits(spark, sf_dir):
    k, r = F.col("event_id") % 3, F.col("regions")
    square = F.array(*[F.array(F.lit(a), F.lit(b)) for a, b in ((0, 0), (9, 0), (9, 9), (0, 9))])
    made = F.when(k == 0, regions.add_region(r, square)).when(k == 1, regions.delete_region(regions.clear_selected(r), 0)).otherwise(regions.select_suggested(r))
    own = _regions(spark, sf_dir).withColumn("regions", made)
    return own.select("event_id", F.size("regions").cast("long").alias("n"), F.size(F.filter("regions", lambda v: v["selected"])).cast("long").alias("selected"))


@query(_s("SELECT n.path_key, COALESCE(n.size = o.size AND n.mtime = o.mtime, false) = false AS detect FROM news n LEFT JOIN olds o USING (path_key)", _FILES))
def text_reuse(spark, sf_dir):
    old, new = _snapshots(spark, sf_dir)
    return regions.restore(new, old.withColumn("regions", F.array().cast(f"array<{regions.REGION}>"))).select("path_key", "detect")


@query(_s("SELECT path_key FROM olds UNION SELECT path_key FROM news", _FILES))
def appended_paths(spark, sf_dir):
    old, new = _snapshots(spark, sf_dir)
    return refresh.append_new(old.select("path_key"), new.select("path_key"))


# -- geometry


@query("WITH " + _BOXES + """, c AS (SELECT l_orderkey, l_linenumber, x0, y0, x1, y1, x0 + x1 AS cx, y0 + y1 AS cy FROM boxes),
w AS (SELECT *, max(cx) OVER o - min(cx) OVER o >= max(cy) OVER o - min(cy) OVER o AS across FROM c WINDOW o AS (PARTITION BY l_orderkey))
SELECT l_orderkey, string_agg(x0 || ',' || y0 || ',' || x1 || ',' || y1, ';' ORDER BY CASE WHEN across THEN cx ELSE cy END, CASE WHEN across THEN cy ELSE cx END, x0, y0, x1, y1) AS boxes FROM w GROUP BY 1""")
def reading_order(spark, sf_dir):
    own = _boxes(spark, sf_dir).groupBy("l_orderkey").agg(F.collect_list("box").alias("boxes"))  # at most seven lines an order
    return own.select("l_orderkey", F.array_join(F.transform(g.reading_order(F.col("boxes")), lambda b: F.array_join(b.cast("array<string>"), ",")), ";").alias("boxes"))


@query("WITH " + _BOXES + """, c AS (SELECT l_orderkey, l_linenumber, greatest(0, least(x0 - 100, 399)) AS a, greatest(0, least(y0 - 50, 299)) AS b, x1, y1 FROM boxes)
SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, a || ',' || b || ',' || least(greatest(x1, a + 1), 400) || ',' || least(greatest(y1, b + 1), 300) AS box FROM c""")
def clamped_boxes(spark, sf_dir):
    b = F.col("box")
    made = g.clamp(F.array(b[0] - 100, b[1] - 50, b[2], b[3]), F.lit(400), F.lit(300))
    return _boxes(spark, sf_dir).select("l_orderkey", *_long("l_linenumber"), F.array_join(made.cast("array<string>"), ",").alias("box"))


_TURNED = _BOXES + """, turned AS (SELECT row_number() OVER () AS row, l_orderkey, l_linenumber, x0 AS cx, y0 AS cy, (x1 - x0) // 2 AS a, (l_orderkey % 41 - 20)::INT AS b, (y1 - y0) // (1 + (l_orderkey % 9)::INT * 3) AS c FROM boxes),
corners AS (SELECT row, l_orderkey, l_linenumber, unnest([cx - a + b, cx + a + b, cx + a - b, cx - a - b]) AS x, unnest([cy - c - b, cy - c + b, cy + c + b, cy + c - b]) AS y, unnest([1, 2, 3, 4]) AS n FROM turned),
half AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY x, y, n) <= 2 AS west FROM corners),
named AS (SELECT *, row_number() OVER (PARTITION BY row, west ORDER BY y, x, n) = 1 AS north FROM half),
four AS (SELECT row, l_orderkey, l_linenumber, max(CASE WHEN west AND north THEN [x, y] END) AS p0, max(CASE WHEN NOT west AND north THEN [x, y] END) AS p1, max(CASE WHEN NOT west AND NOT north THEN [x, y] END) AS p2, max(CASE WHEN west AND NOT north THEN [x, y] END) AS p3 FROM named GROUP BY 1, 2, 3),
cut AS (SELECT l_orderkey, l_linenumber, list_transform([p0, p1, p2, p3], lambda p: [greatest(0, least(399, p[1])), greatest(0, least(299, p[2]))]) AS q FROM four)"""


@query("WITH " + _TURNED + """ SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, array_to_string(list_transform(q, lambda p: p[1] || ',' || p[2]), ';') AS corners,
floor(sqrt((q[1][1] - q[2][1])::DOUBLE ** 2 + (q[1][2] - q[2][2])::DOUBLE ** 2)) > 3 AND floor(sqrt((q[1][1] - q[4][1])::DOUBLE ** 2 + (q[1][2] - q[4][2])::DOUBLE ** 2)) > 3 AS kept FROM cut""")
def ordered_corners(spark, sf_dir):
    """Corners of turned boxes, given in any of four orders, put in order, clipped to an image and judged by their sides."""
    b, k = F.col("box"), F.col("l_orderkey")
    turn = (k % 41 - 20).cast("int")
    half, third = F.expr("(box[2] - box[0]) div 2").cast("int"), F.expr("(box[3] - box[1]) div (1 + int(l_orderkey % 9) * 3)").cast("int")
    at = lambda dx, dy: F.array((b[0] + dx).cast("int"), (b[1] + dy).cast("int"))
    corners = [at(turn - half, -third - turn), at(half + turn, turn - third), at(half - turn, third + turn), at(-half - turn, third - turn)]
    mixed = [F.array(*[corners[j] for j in order]) for order in ((0, 1, 2, 3), (2, 0, 3, 1), (3, 2, 1, 0), (1, 3, 0, 2))]
    given = F.coalesce(*[F.when(F.col("l_linenumber") % 4 == n, m) for n, m in enumerate(mixed)])
    own = _boxes(spark, sf_dir).select("l_orderkey", *_long("l_linenumber"), g.clipped_points(g.order_points(given), F.lit(400), F.lit(300)).alias("q"))
    return own.select("l_orderkey", "l_linenumber", F.array_join(F.transform("q", lambda p: F.array_join(p.cast("array<string>"), ",")), ";").alias("corners"), g.large_enough(F.col("q")).alias("kept"))


@query("""SELECT doc_id, w::BIGINT AS width, h::BIGINT AS height FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 640 WHEN doc_id % 3 = 1 THEN 320 ELSE 1 END AS w, CASE WHEN doc_id % 3 = 0 THEN 480 WHEN doc_id % 3 = 1 THEN 200 ELSE 1 END AS h FROM documents)""")
def filled_sizes(spark, sf_dir):
    k = F.col("doc_id") % 3
    known, decoded = F.when(k == 0, 640).otherwise(0), F.when(k == 1, F.struct(F.lit(320).alias("width"), F.lit(200).alias("height")))
    own = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", states.filled_size(known, F.when(k == 0, 480).otherwise(7), decoded).alias("s"))
    return own.select("doc_id", F.col("s.width").cast("long").alias("width"), F.col("s.height").cast("long").alias("height"))


@query()
def detections_kept(spark, sf_dir):
    kind = "struct<bbox:array<int>,confidence:double>"
    found = F.struct(F.col("box").alias("bbox"), ((F.col("l_linenumber") * 7 % 5) / 5.0).cast("double").alias("confidence"))
    own = _boxes(spark, sf_dir).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", found.alias("d")))).alias("ds"))  # at most seven lines an order
    kept = lambda c: F.array_join(F.transform(c, lambda d: F.array_join(d["bbox"].cast("array<string>"), ",")), ";")
    people = F.transform("ds", lambda d: d["d"])
    return own.select("l_orderkey", kept(g.nms(people, 0.3, kind)).alias("nms"), kept(g.suppress_nested(people, kind)).alias("nested"))


@query()
def pixel_metrics(spark, sf_dir):
    """Images 24 pixels wide from the bytes of whole texts, the last row filled up with black."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("octet_length(text) > 0")
    data = F.expr("concat(encode(text, 'utf-8'), unhex(repeat('00', cast(pmod(-octet_length(text), 72) as int))))")
    pixels = F.struct(F.lit(24).alias("width"), F.ceil(F.octet_length("text") / 72).cast("int").alias("height"), data.alias("data"))
    return docs.select("doc_id", kernels.metrics(pixels).alias("m")).select("doc_id", "m.*")
