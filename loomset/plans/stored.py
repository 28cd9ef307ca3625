"""Registered queries of stored proposals and their edits, with the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import decisions, states
from .catalogue import _BOXES, _boxes, query

_text = lambda boxes: F.array_join(F.transform(boxes, lambda b: F.array_join(b.cast("array<string>"), ",")), ";")
_KIND = "struct<version:int,mode:string,output_boxes:array<array<int>>,baseline_boxes:array<array<int>>,manual_triggered:boolean,decision:string,detail:string>"


@query("WITH " + _BOXES + """, o AS (SELECT l_orderkey AS k, list(x0 || ',' || y0 || ',' || x1 || ',' || y1 ORDER BY x0, y0, x1, y1) AS b FROM boxes GROUP BY 1),
e AS (SELECT k, b, k % 7 AS how, list_transform(b, lambda v, i: CASE WHEN i = 1 THEN '0,0,5,5' ELSE v END) AS moved FROM o)
SELECT k AS l_orderkey, array_to_string(CASE how WHEN 0 THEN list_append(moved, '1,1,9,9') WHEN 1 THEN b WHEN 2 THEN list_concat(moved[1:1], moved[3:]) WHEN 3 THEN list_reverse(b) WHEN 4 THEN [] ELSE moved END, ';') AS boxes,
array_to_string(CASE how WHEN 0 THEN list_append(b, '1,1,9,9') WHEN 2 THEN list_concat(b[1:1], b[3:]) WHEN 3 THEN list_reverse(b) WHEN 4 THEN [] ELSE b END, ';') AS baselines,
CASE how WHEN 0 THEN len(b) + 1 WHEN 2 THEN greatest(1, len(b) - 1) WHEN 4 THEN 0 ELSE len(b) END::BIGINT AS n_keep, CASE how WHEN 3 THEN 'pending' WHEN 4 THEN 'pending' WHEN 5 THEN 'rejected' WHEN 6 THEN 'accepted' ELSE 'old' END AS decision, how IN (3, 4) AS triggered FROM e""")
def composite_edits(spark, sf_dir):
    """Edits of proposals whose first box was moved: a box drawn, put back, deleted, another detection with and without a result, decisions."""
    own = _boxes(spark, sf_dir).groupBy("l_orderkey").agg(F.array_sort(F.collect_list("box")).alias("b"))  # at most seven lines an order
    moved = F.transform("b", lambda v, i: F.when(i == 0, F.array(F.lit(0), F.lit(0), F.lit(5), F.lit(5))).otherwise(v))
    made = lambda boxes, base: F.struct(F.lit(2).alias("version"), F.lit("split_people").alias("mode"), boxes.alias("output_boxes"), base.alias("baseline_boxes"), F.lit(False).alias("manual_triggered"), F.lit("old").alias("decision"), F.lit("").alias("detail")).cast(_KIND)
    own = own.withColumns({"p": made(moved, F.col("b")), "keep": F.transform("b", lambda v: F.lit(True)), "how": F.col("l_orderkey") % 7})
    p, keep = F.col("p"), F.col("keep")
    drawn, deleted = decisions.create_box(p, keep, F.array(*map(F.lit, (1, 1, 9, 9)))), decisions.delete_box(p, keep, 1)
    found = F.when(F.col("how") == 3, made(F.reverse("b"), F.array().cast("array<array<int>>")))
    again = decisions.redetected(p, found)
    edits = [drawn, (decisions.reset_box(p, 0), keep), deleted, again[:2], again[:2], (decisions.decide_composite(p, "rejected"), keep), (decisions.decide_composite(p, "accepted"), keep)]
    pick = lambda j: F.coalesce(*[F.when(F.col("how") == n, e[j]) for n, e in enumerate(edits)])
    done = own.select("l_orderkey", pick(0).alias("q"), pick(1).alias("r"))
    return done.select("l_orderkey", _text(F.col("q.output_boxes")).alias("boxes"), _text(F.col("q.baseline_boxes")).alias("baselines"), F.size("r").cast("long").alias("n_keep"), F.col("q.decision").alias("decision"), F.col("q.manual_triggered").alias("triggered"))


@query("""SELECT event_id, CASE WHEN event_id % 8 IN (3, 5) THEN NULL WHEN event_id % 8 IN (6, 7) THEN '' ELSE (event_id % 500) || ',1,' || (event_id % 500 + 20) || ',30' END AS boxes,
CASE WHEN event_id % 8 IN (3, 5) THEN NULL WHEN event_id % 8 = 1 THEN 3 ELSE 2 END::BIGINT AS version FROM events""")
def proposal_texts(spark, sf_dir):
    """Composite proposals as they are stored: plain, with numbers as texts, behind white space, cut numbers, no numbers, no object."""
    i = F.col("event_id")
    a, b = (i % 500).cast("string"), (i % 500 + 20).cast("string")
    box = lambda *parts: F.concat(F.lit('{"version":2,"output_boxes":[['), F.concat_ws(",", *parts), F.lit("]]}"))
    quoted = lambda v: F.concat(F.lit('"'), v, F.lit('"'))
    forms = [box(a, F.lit("1"), b, F.lit("30")), F.concat(F.lit('{"version":"3","output_boxes":[['), F.concat_ws(",", quoted(a), F.lit('"1"'), quoted(b), F.lit('" 30 "')), F.lit("]]}")), F.concat(F.lit(" \n\t"), box(a, F.lit("true"), b, F.lit("30.9"))), box(a, F.lit('"1.5"'), b, F.lit("30")), box(a, F.lit("1"), F.concat(b, F.lit(".2")), F.lit("30")), box(a, F.lit("null"), b, F.lit("30")), F.lit("{}"), F.lit('{"output_boxes":[]}')]
    text = F.coalesce(*[F.when(i % 8 == n, f) for n, f in enumerate(forms)])
    own = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", states.decode_proposal(text).alias("p"))
    return own.select("event_id", _text(F.col("p.output_boxes")).alias("boxes"), F.col("p.version").cast("long").alias("version"))


@query("""WITH e AS (SELECT event_id, event_id % 6 AS how, event_id % 400 AS x FROM events)
SELECT event_id, CASE WHEN how IN (0, 1, 2, 5) THEN x || ',2,' || (x + 10) || ',9' END AS box, CASE how WHEN 0 THEN x || ',2,' || (x + 10) || ',9' WHEN 1 THEN x || ',2,' || (x + 11) || ',9' WHEN 2 THEN x || ',2,' || (x + 10) || ',9' WHEN 5 THEN x || ',2,' || (x + 10) || ',9' END AS auto_box,
CASE WHEN how IN (0, 1, 2, 5) THEN how = 1 END AS adjusted, CASE how WHEN 0 THEN 0.25 WHEN 1 THEN 0.5 WHEN 2 THEN 0.25 WHEN 5 THEN 0 END::DOUBLE AS auto_removed, CASE how WHEN 0 THEN '' WHEN 1 THEN '640,480' WHEN 2 THEN '' WHEN 5 THEN '' END AS size,
CASE how WHEN 0 THEN 'subject_mask_touches_source_edge' WHEN 1 THEN 'a|b' WHEN 2 THEN '' WHEN 5 THEN '' END AS warnings, CASE WHEN how IN (0, 2, 5) THEN 32 WHEN how = 1 THEN 8 END::BIGINT AS padding, CASE WHEN how IN (0, 2, 5) THEN 0.1 WHEN how = 1 THEN 0.2 END::DOUBLE AS alpha FROM e""")
def crop_texts(spark, sf_dir):
    """Crop proposals as they are stored, of both versions, with all their fields; unknown versions, decisions and boxes."""
    i = F.col("event_id")
    x = i % 400
    box = lambda dx: F.concat(F.lit("["), x, F.lit(',"2",'), x + dx, F.lit(".4,9]"))
    of = lambda version, rest, dx=10: F.concat(F.lit(f'{{"version":{version},"box":'), box(dx), F.lit(rest), F.lit("}"))
    forms = [
        of(1, ',"removed_area_ratio":0.25,"auto_removed_area_ratio":0.9,"warnings":["subject_mask_touches_source_edge"],"image_size":[1,2]'),
        F.concat(F.lit('{"version":2,"auto_box":'), box(11), F.lit(',"box":'), box(10), F.lit(',"auto_removed_area_ratio":0.5,"removed_area_ratio":0.4,"warnings":["a","b"],"image_size":[640,480],"alpha_min":0.2,"padding_px":8}')),
        of(2, ',"removed_area_ratio":0.25,"image_size":[1]'), of(3, ""), of(2, ',"decision":"odd"'), of(2, ',"decision":"accepted"'),
    ]
    text = F.coalesce(*[F.when(i % 6 == n, f) for n, f in enumerate(forms)])
    own = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", decisions.decode_crop_text(text).alias("p"))
    joined = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return own.select("event_id", joined("p.box").alias("box"), joined("p.auto_box").alias("auto_box"), F.col("p.manually_adjusted").alias("adjusted"), F.col("p.auto_removed_area_ratio").alias("auto_removed"), joined("p.image_size").alias("size"), F.array_join("p.warnings", "|").alias("warnings"), F.col("p.padding_px").cast("long").alias("padding"), F.col("p.alpha_min").alias("alpha"))
