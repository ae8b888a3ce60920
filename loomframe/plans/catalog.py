"""Registered queries over the test tables, each with the SQL that gives the same rows.

The tables stand in for a labelled frame dataset: a document is a frame, its source the video, its language the layout;
labels.quality is the human label and labels.toxic the teacher's. Replies and other fields that the tables lack are made
from the id by expressions that both engines read alike.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import sequences as Q
from ..functions import text as T
from ..operators import batches, conversations, features, labels, metrics, sampling
from ..operators.inference import Stub, encode_images, infer, infer_once
from ..sources import files, schemas, sinks
from ..sources.shared import fresh_path
from ..streaming import incremental

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


REPLY = """CASE doc_id % 13 WHEN 0 THEN 'Yes.' WHEN 1 THEN 'no, it is' WHEN 2 THEN 'well, no yes' WHEN 3 THEN '**Yes**' WHEN 4 THEN 'unknown'
 WHEN 5 THEN '' WHEN 6 THEN 'maybe' WHEN 7 THEN '  TRUE! ' WHEN 8 THEN 'n' WHEN 9 THEN 'I would say yes' WHEN 10 THEN 'False;'
 WHEN 11 THEN 'It is hard to tell from this one frame, yes' ELSE NULL END"""
YN = "CASE doc_id % 7 WHEN 0 THEN 'Yes' WHEN 1 THEN ' yes' WHEN 2 THEN 'no' WHEN 3 THEN NULL WHEN 4 THEN '' WHEN 5 THEN 'YEAH' ELSE 'unsure' END"
SPLIT = "CASE WHEN doc_id % 10 < 6 THEN 'train' WHEN doc_id % 10 < 8 THEN 'validate' ELSE 'test' END"
TEACHER = "CASE WHEN toxic IS NULL THEN NULL WHEN doc_id % 9 = 0 THEN '' WHEN toxic = 1 THEN 'no' ELSE 'yes' END"
JUDGE = "CASE doc_id % 8 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' WHEN 2 THEN 'Yes, both' WHEN 3 THEN NULL WHEN 4 THEN '' WHEN 5 THEN ' yes' ELSE 'no' END"
JSON_REPLY = r"""CASE doc_id % 9 WHEN 0 THEN concat('{"sludge": "yes", "layout": "', lang, '", "description": "d"}')
 WHEN 1 THEN concat('<think>{a}</think> ```json {"sludge": "no", "layout": "', lang, '"}```')
 WHEN 2 THEN 'no object here' WHEN 3 THEN '{"sludge": "yes"' WHEN 4 THEN '{"sludge": "yes"} and {"sludge": "no"}'
 WHEN 5 THEN '{''sludge'': ''yes''}' WHEN 6 THEN '{}' WHEN 7 THEN '} {' ELSE 'Sure: {"layout": "grid", "sludge": "yes", "x": 1}' END"""
BUCKET = "('0x' || substr(md5({}), 1, 8))::BIGINT"
FRAMES = f"""f AS (SELECT d.doc_id, d.source AS video_id, concat('frames/', d.source, '/', d.doc_id, '.jpg') AS frame_path, d.lang AS layout, {SPLIT.replace("doc_id", "d.doc_id")} AS split,
 l.quality = 1 AS gt, l.toxic, {REPLY.replace("doc_id", "d.doc_id")} AS reply FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""
YES_NO = """CASE WHEN w IN ('yes','y','true') THEN TRUE WHEN w IN ('no','n','false') THEN FALSE
 WHEN contains(h, 'yes'){guard} THEN TRUE WHEN contains(h, 'no') THEN FALSE END"""
GUARD = " AND NOT contains(substr(t, 1, instr(t, 'yes') + 2), 'no ')"
ANSWERS = """a AS (SELECT *, substr(t, 1, 30) AS h, rtrim(regexp_extract(t, '^\\S*'), '.,!?:;') AS w FROM (SELECT *, lower(trim(reply)) AS t FROM f))"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("video_id"), F.concat(F.lit("frames/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".jpg")).alias("frame_path"), F.col("lang").alias("layout"), F.expr(SPLIT).alias("split"), F.expr(REPLY).alias("reply"))
    gt = read(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("gt"), "toxic")
    return labels.with_labels(d, gt, "doc_id")


@query(f"""WITH {FRAMES}, {ANSWERS}, p AS (SELECT *, {YES_NO.format(guard=GUARD)} AS pred FROM a WHERE split = 'test' AND gt IS NOT NULL)
SELECT coalesce(nullif(layout, ''), 'unknown') AS layout, count(pred) AS n, count(*) FILTER (pred = gt) AS correct, count(*) FILTER (pred IS NULL) AS unparseable,
 count(*) FILTER (pred = gt) / nullif(count(pred), 0)::DOUBLE AS acc FROM p GROUP BY 1""")
def classify_report_per_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir).where("split = 'test'")
    return metrics.per_layout(f.withColumn("pred", T.yes_no(F.col("reply"))), "pred", "gt", "layout")


@query(f"""WITH {FRAMES}, {ANSWERS}, p AS (SELECT *, {YES_NO.format(guard=GUARD)} AS pred FROM a)
SELECT count(*) AS n_total, count(*) FILTER (pred IS NOT NULL AND gt IS NOT NULL) AS n_covered, count(*) FILTER (pred = gt) AS n_correct, count(*) FILTER (pred IS NULL AND gt IS NOT NULL) AS n_unparseable,
 count(*) FILTER (gt IS NULL) AS n_no_label, 0::BIGINT AS n_errors, count(*) FILTER (pred = gt) / nullif(count(*) FILTER (pred IS NOT NULL AND gt IS NOT NULL), 0)::DOUBLE AS accuracy, count(*) FILTER (pred = gt) / nullif(count(*), 0)::DOUBLE AS accuracy_all FROM p""")
def classify_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.classify_report(frames(spark, sf_dir).withColumn("pred", T.yes_no(F.col("reply"))), "pred", "gt")


@query(f"WITH {FRAMES}, {ANSWERS} SELECT doc_id, {YES_NO.format(guard=GUARD)} AS answer FROM a")
def parse_yes_no_guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", T.yes_no(F.expr(REPLY)).alias("answer"))


@query(f"WITH {FRAMES}, {ANSWERS} SELECT doc_id, {YES_NO.format(guard='')} AS answer FROM a")
def parse_yes_no_unguarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", T.yes_no(F.expr(REPLY), guarded=False).alias("answer"))


@query(f"SELECT doc_id, starts_with(lower(trim(coalesce(s, ''))), 'y') AS stripped, starts_with(lower(coalesce(s, '')), 'y') AS plain FROM (SELECT doc_id, {YN} AS s FROM documents)")
def yn_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.expr(YN)
    return read(spark, sf_dir, "documents").select("doc_id", T.starts_yes(s).alias("stripped"), T.starts_yes(s, stripped=False).alias("plain"))


@query(rf"""WITH r AS (SELECT doc_id, {JSON_REPLY} AS raw FROM documents), s AS (SELECT doc_id, trim(replace(replace(regexp_replace(raw, '(?s)^.*</think>', ''), '```json', ''), '```', '')) AS t FROM r),
j AS (SELECT doc_id, TRY_CAST(CASE WHEN instr(t, '{{') > 0 AND length(t) - instr(reverse(t), '}}') + 1 > instr(t, '{{') AND contains(t, '}}') THEN substr(t, instr(t, '{{'), length(t) - instr(reverse(t), '}}') + 2 - instr(t, '{{')) END AS JSON) AS o FROM s)
SELECT doc_id, o ->> '$.sludge' AS sludge, o ->> '$.layout' AS layout, o ->> '$.description' AS description FROM j""")
def reply_json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = read(spark, sf_dir, "documents").select("doc_id", T.reply_fields(F.expr(JSON_REPLY), ["sludge", "layout", "description"]).alias("o"))
    return r.select("doc_id", "o.*")


@query("""SELECT d.doc_id, d.source, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)""")
def label_lookup_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.with_labels(read(spark, sf_dir, "documents").select("doc_id", "source"), read(spark, sf_dir, "labels"), "doc_id")


@query("""SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1""")
def last_write_wins_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value")
    return labels.last_wins(e, ["user_id"], ["ts", "event_id"]).drop("ts")


@query(f"""SELECT d.doc_id FROM documents d WHERE EXISTS (SELECT 1 FROM (SELECT doc_id, {SPLIT} AS split FROM labels) l WHERE l.doc_id = d.doc_id AND split IN ('train', 'validate'))""")
def split_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = read(spark, sf_dir, "labels").select("doc_id", F.expr(SPLIT).alias("split"))
    return labels.in_splits(read(spark, sf_dir, "documents").select("doc_id"), named, ["train", "validate"], "doc_id")


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def resume_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.not_done(read(spark, sf_dir, "documents").select("doc_id", "source"), read(spark, sf_dir, "labels"), "doc_id")


@query("""SELECT split_source, count(*) AS n, sum(length(text))::BIGINT AS chars FROM (SELECT text, 'train' AS split_source FROM documents UNION ALL SELECT text, 'test' FROM benchmark) GROUP BY 1""")
def union_with_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = read(spark, sf_dir, "documents").select("text", F.lit("train").alias("split_source")).unionByName(read(spark, sf_dir, "benchmark").select("text", F.lit("test").alias("split_source")))
    return both.groupBy("split_source").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query("SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5('42' || doc_id), doc_id) AS k FROM documents) WHERE k <= 5")
def sample_k_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.sample_by_group(read(spark, sf_dir, "documents").select("source", "doc_id"), "source", "doc_id", 5)


@query("""WITH p AS (SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5('42' || doc_id), doc_id) AS k FROM documents) WHERE k <= 5)
SELECT source, doc_id FROM p WHERE doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY source, md5('42' || doc_id), doc_id LIMIT 40""")
def sample_exclude_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.sample_excluding(read(spark, sf_dir, "documents").select("source", "doc_id"), read(spark, sf_dir, "labels"), "source", "doc_id", 5, 40)


TASK_SQL = f"CASE WHEN b < 25 THEN 'classify' WHEN b < 40 THEN 'layout' WHEN b < 60 THEN 'describe_teacher' WHEN b < 95 THEN 'coupled' ELSE 'refuse' END"


@query(f"SELECT task, count(*) AS n FROM (SELECT {TASK_SQL} AS task FROM (SELECT {BUCKET.format(chr(39) + 'task' + chr(39) + ' || doc_id')} % 100 AS b FROM documents)) GROUP BY 1")
def weighted_task_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.count_by(conversations.with_task(read(spark, sf_dir, "documents"), key="doc_id"), "task")


def taught(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames with a teacher struct: some descriptions and explanations are blank."""
    f = frames(spark, sf_dir)
    texts = read(spark, sf_dir, "documents").select("doc_id", "text")
    t = F.struct(F.expr(TEACHER).alias("sludge"), F.expr("CASE WHEN doc_id % 6 = 0 THEN ' ' ELSE layout END").alias("layout"), F.expr("CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN '  ' ELSE text END").alias("description"), F.expr("CASE WHEN doc_id % 4 = 0 THEN 'Two scenes.' END").alias("explanation"))
    return f.join(texts, "doc_id").withColumn("teacher", t).withColumn("time_s", F.expr("CASE WHEN doc_id % 3 = 0 THEN NULL ELSE doc_id % 30 + 0.5D END"))


def _bank(items: list[str], salt: str) -> str:
    quoted = ", ".join("'" + x.replace("'", "''") + "'" for x in items)
    return f"[{quoted}][CAST({BUCKET.format(chr(39) + salt + chr(39) + ' || frame_path')} % {len(items)} AS INTEGER) + 1]"


CONVERSATION_SQL = f"""WITH {FRAMES}, t AS (
 SELECT f.*, {TEACHER.replace("doc_id", "f.doc_id")} AS t_sludge, trim(CASE WHEN f.doc_id % 6 = 0 THEN ' ' ELSE layout END) AS t_layout,
  CASE f.doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN '  ' ELSE d.text END AS t_raw, CASE WHEN f.doc_id % 4 = 0 THEN 'Two scenes.' ELSE '' END AS t_why,
  CASE WHEN f.doc_id % 3 = 0 THEN 0 ELSE f.doc_id % 30 END AS sec, {BUCKET.format("'task' || frame_path")} % 100 AS b FROM f JOIN documents d ON f.doc_id = d.doc_id),
u AS (SELECT *, regexp_replace(t_raw, '^\\s+|\\s+$', '', 'g') AS t_text, starts_with(lower(coalesce(t_sludge, '')), 'y') AS yes, {TASK_SQL} AS task, coalesce(nullif(t_layout, ''), 'other') AS lay FROM t WHERE length(t_raw) > 0 AND split IN ('train', 'validate')),
v AS (SELECT *, concat('tiktok_', video_id, '_f', sec, '_', task) AS id, replace(frame_path, 'frames/', '') AS image, CASE WHEN yes THEN 'Yes.' ELSE 'No.' END AS yn,
  CASE task WHEN 'layout' THEN {_bank(conversations.LAYOUT, "q")} WHEN 'describe_teacher' THEN {_bank(conversations.DESCRIBE, "q")} WHEN 'refuse' THEN {_bank(conversations.REFUSE, "q")} ELSE {_bank(conversations.CLASSIFY, "q")} END AS q, {_bank(conversations.EXPLAIN, "why")} AS q2 FROM u)
SELECT id, image, 0 AS turn, 'human' AS "from", concat('<image>', chr(10), q) AS value FROM v
UNION ALL SELECT id, image, 1, 'gpt', CASE task WHEN 'layout' THEN lay WHEN 'describe_teacher' THEN t_text WHEN 'refuse' THEN concat('{conversations.REFUSAL}', coalesce(nullif(t_text, ''), CASE WHEN yes THEN '{conversations.GROUNDED[True]}' ELSE '{conversations.GROUNDED[False]}' END)) ELSE yn END FROM v
UNION ALL SELECT id, image, 2, 'human', q2 FROM v WHERE task = 'coupled'
UNION ALL SELECT id, image, 3, 'gpt', concat(CASE WHEN yes THEN 'Yes, this is sludge. ' ELSE 'No, this is not sludge. ' END, coalesce(nullif(t_why, ''), t_text)) FROM v WHERE task = 'coupled'"""


@query(CONVERSATION_SQL)
def conversation_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversations.with_task(conversations.eligible(taught(spark, sf_dir)))
    return conversations.flat_turns(conversations.build_conversations(rows))


TAUGHT_SQL = f"SELECT l.doc_id, d.source, {TEACHER.replace('doc_id', 'l.doc_id')} AS teacher_sludge, l.quality = 1 AS gt_is_sludge, {JUDGE.replace('doc_id', 'l.doc_id')} AS judge_sludge FROM labels l JOIN documents d ON l.doc_id = d.doc_id"


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = read(spark, sf_dir, "labels").select("doc_id", F.expr(TEACHER).alias("teacher_sludge"), (F.col("quality") == 1).alias("gt_is_sludge"), F.expr(JUDGE).alias("judge_sludge"))
    return l.join(read(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")


@query(f"SELECT doc_id, teacher_sludge, gt_is_sludge FROM ({TAUGHT_SQL}) WHERE teacher_sludge <> '' AND starts_with(lower(trim(teacher_sludge)), 'y') <> coalesce(gt_is_sludge, FALSE)")
def disputes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.disputes(judged(spark, sf_dir)).select("doc_id", "teacher_sludge", "gt_is_sludge")


@query(f"""SELECT source, count(*) AS n FROM ({TAUGHT_SQL}) WHERE teacher_sludge <> '' AND starts_with(lower(trim(teacher_sludge)), 'y') <> coalesce(gt_is_sludge, FALSE) GROUP BY 1""")
def disputes_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.count_by(labels.disputes(judged(spark, sf_dir)), "source")


@query(f"""WITH r AS (SELECT *, coalesce(judge_sludge, '') = '' AS bad, coalesce(teacher_sludge, '') <> '' AS t, starts_with(lower(trim(coalesce(judge_sludge, ''))), 'y') AS j, starts_with(lower(trim(coalesce(teacher_sludge, ''))), 'y') AS y, coalesce(gt_is_sludge, FALSE) AS g FROM ({TAUGHT_SQL}))
SELECT count(*) AS n_disputes_judged, count(*) FILTER (bad) AS errors, count(*) FILTER (NOT bad AND t AND j = y AND j <> g) AS judge_sides_with_teacher, count(*) FILTER (NOT bad AND t AND j = g AND j <> y) AS judge_sides_with_gt,
 count(*) FILTER (NOT bad AND t AND (j = y) = (j = g)) AS judge_agrees_with_both_or_neither FROM r""")
def judge_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.judge_tally(judged(spark, sf_dir))


#: Labels by source: the last labelled document's; verdicts by a shifted source name, so that some are unknown.
CLEANED_SQL = f"""g AS (SELECT source AS video_id, arg_max(gt_is_sludge, doc_id) AS gt FROM ({TAUGHT_SQL}) GROUP BY 1),
v AS (SELECT CASE WHEN doc_id % 17 = 0 THEN source || 'x' ELSE source END AS video_id, arg_max(judge_sludge, doc_id) AS judge FROM ({TAUGHT_SQL}) WHERE judge_sludge <> '' GROUP BY 1),
c AS (SELECT coalesce(g.video_id, v.video_id) AS video_id, CASE WHEN g.video_id IS NOT NULL THEN coalesce(gt, FALSE) END AS gt, coalesce(starts_with(lower(judge), 'y'), gt, FALSE) AS cleaned FROM g FULL JOIN v ON g.video_id = v.video_id)"""


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = judged(spark, sf_dir)
    gt = labels.last_wins(j.select(F.col("source").alias("video_id"), F.col("gt_is_sludge").alias("gt"), "doc_id"), ["video_id"], ["doc_id"])
    verdicts = j.select(F.expr("CASE WHEN doc_id % 17 = 0 THEN source || 'x' ELSE source END").alias("video_id"), "judge_sludge", F.col("doc_id").alias("ord"))
    return labels.cleaned_labels(gt, verdicts)


@query(f"WITH {CLEANED_SQL} SELECT video_id, gt, cleaned FROM c")
def cleaned_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaned(spark, sf_dir)


@query(f"""WITH {FRAMES}, {ANSWERS}, {CLEANED_SQL}, p AS (SELECT a.*, {YES_NO.format(guard="")} AS pred FROM a WHERE split = 'test'),
r AS (SELECT pred, coalesce(p.gt, FALSE) AS g, coalesce(c.cleaned, coalesce(p.gt, FALSE)) AS cl FROM p LEFT JOIN c ON p.video_id = c.video_id)
SELECT count(*) AS n_total, count(*) FILTER (pred IS NULL) AS n_unparseable, count(*) FILTER (pred = g) AS gt_correct, count(*) FILTER (pred = cl) AS cleaned_correct, count(*) FILTER (g <> cl) AS overrides_applied,
 count(*) FILTER (pred = g) / greatest(count(*), 1)::DOUBLE AS gt_acc, count(*) FILTER (pred = cl) / greatest(count(*), 1)::DOUBLE AS cleaned_acc FROM r""")
def dual_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir).where("split = 'test'").withColumn("pred", T.yes_no(F.col("reply"), guarded=False))
    return metrics.dual_report(f.join(cleaned(spark, sf_dir).select("video_id", "cleaned"), "video_id", "left"), "pred", "gt", "cleaned")


SAID = "CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN concat('a ', lang, ' frame') WHEN 2 THEN upper(lang) WHEN 3 THEN 'grid' ELSE substr(lang, 1, 1) END"


@query(f"""SELECT count(*) AS n, count(*) FILTER (contains(lower(s), lower(lang)) OR contains(lower(lang), lower(s))) AS correct, count(*) FILTER (contains(lower(s), lower(lang)) OR contains(lower(lang), lower(s))) / nullif(count(*), 0)::DOUBLE AS accuracy FROM (SELECT lang, {SAID} AS s FROM documents WHERE lang <> '')""")
def layout_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("lang", F.expr(SAID).alias("s"))
    return metrics.containment_report(d.withColumn("hit", T.contains_either_way(F.col("s"), F.col("lang"))), "hit", "lang")


PAIR_A = "concat('{\"sludge\": \"', CASE WHEN doc_id % 2 = 0 THEN 'yes' ELSE 'no' END, '\", \"layout\": \"', lang, '\"}')"
PAIR_B = f"""CASE doc_id % 14 WHEN 0 THEN concat('{{"layout": "', lang, '", "sludge": "yes"}}') WHEN 1 THEN 'none' WHEN 2 THEN concat('{{"sludge": "no", "layout": "', lang, '"}}')
 WHEN 3 THEN concat({PAIR_A}, ' junk }}') WHEN 4 THEN replace({PAIR_A}, '"', '\'\'') WHEN 5 THEN '{{"sludge": true, "layout": 1}}' WHEN 6 THEN concat('{{"sludge": "yes", "layout": "', lang, '", "x": 1}}')
 WHEN 7 THEN concat('<think>{{}}</think>```json ', {PAIR_A}, ' ```') WHEN 8 THEN concat({PAIR_A}, {PAIR_A}) ELSE {PAIR_A} END"""
EMPTY_A = f"CASE WHEN doc_id % 28 = 1 THEN '{{}}' ELSE {PAIR_A} END"
RUNS_SQL = f"SELECT doc_id, {EMPTY_A} AS a, {PAIR_B} AS b FROM documents"


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, run, reply): the replies of two runs over the same rows."""
    d = read(spark, sf_dir, "documents").select("doc_id", "lang")
    return d.select("doc_id", F.lit("serial").alias("run"), F.expr(EMPTY_A).alias("reply")).union(d.select("doc_id", F.lit("batched").alias("run"), F.expr(PAIR_B).alias("reply")))


@query(f"""WITH p AS ({RUNS_SQL}), c AS (SELECT *, trim(replace(replace(regexp_replace(b, '(?s)^.*</think>', ''), '```json', ''), '```', '')) AS t FROM p),
q AS (SELECT a, b, coalesce(TRY_CAST(a AS JSON), '{{}}') AS ja, coalesce(TRY_CAST(CASE WHEN contains(t, '{{') THEN substr(t, instr(t, '{{'), length(t) - instr(reverse(t), '}}') + 2 - instr(t, '{{')) END AS JSON), '{{}}') AS jb FROM c),
x AS (SELECT a = b AS t, list_sort(json_keys(ja)) = list_sort(json_keys(jb)) AND (ja -> '$.sludge')::VARCHAR IS NOT DISTINCT FROM (jb -> '$.sludge')::VARCHAR AND (ja -> '$.layout')::VARCHAR IS NOT DISTINCT FROM (jb -> '$.layout')::VARCHAR AS o,
 CASE WHEN json_type(ja, '$.sludge') = 'VARCHAR' THEN ja ->> '$.sludge' END IS NOT DISTINCT FROM CASE WHEN json_type(jb, '$.sludge') = 'VARCHAR' THEN jb ->> '$.sludge' END AS s,
 CASE WHEN json_type(ja, '$.layout') = 'VARCHAR' THEN ja ->> '$.layout' END IS NOT DISTINCT FROM CASE WHEN json_type(jb, '$.layout') = 'VARCHAR' THEN jb ->> '$.layout' END AS l FROM q),
n AS (SELECT count(*) AS n, count(*) FILTER (t) AS byte_identical, count(*) FILTER (o) AS json_identical, count(*) FILTER (s) AS sludge_match, count(*) FILTER (l) AS layout_match FROM x)
SELECT *, round_even(byte_identical::DOUBLE * 100 / n, 1) AS byte_identical_pct, round_even(json_identical::DOUBLE * 100 / n, 1) AS json_identical_pct, round_even(sludge_match::DOUBLE * 100 / n, 1) AS sludge_match_pct, round_even(layout_match::DOUBLE * 100 / n, 1) AS layout_match_pct FROM n""")
def ab_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = metrics.paired(runs(spark, sf_dir), "doc_id", "run", "reply", "serial", "batched")
    p = p.withColumn("x", T.reply_fields(F.col("serial"), ["sludge", "layout"])).withColumn("y", T.reply_fields(F.col("batched"), ["sludge", "layout"]))
    field = lambda f: F.col(f"x.{f}").eqNullSafe(F.col(f"y.{f}"))
    return metrics.agreement(p, F.col("serial").eqNullSafe(F.col("batched")), T.same_object(F.col("serial"), F.col("batched")), field("sludge"), field("layout"))


@query(f"SELECT doc_id, a AS serial, b AS batched FROM ({RUNS_SQL}) WHERE a IS DISTINCT FROM b ORDER BY doc_id LIMIT 5")
def ab_first_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.first_diffs(metrics.paired(runs(spark, sf_dir), "doc_id", "run", "reply", "serial", "batched"), "serial", "batched", "doc_id")


@query("""WITH r AS (SELECT CAST(power(2, event_id % 4) AS INTEGER) AS batch_size, count(*) AS n_frames, CAST(sum(CAST(floor(value * 100) AS BIGINT)) AS DOUBLE) AS time_s FROM events GROUP BY 1)
SELECT batch_size, n_frames, time_s, time_s / n_frames AS s_per_frame, (SELECT time_s FROM r WHERE batch_size = 1) / time_s AS speedup_vs_serial FROM r""")
def batch_sweep_speedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").groupBy(F.expr("CAST(power(2, event_id % 4) AS INT)").alias("batch_size")).agg(F.count("*").alias("n_frames"), F.sum(F.floor(F.col("value") * 100)).cast("double").alias("time_s"))
    return metrics.sweep_report(e)


@query("""WITH e AS (SELECT event_type, event_id, value > 50 AS hit, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS place FROM events),
r AS (SELECT event_type, place, sum(hit::INT) OVER (PARTITION BY event_type ORDER BY place) AS hits FROM e)
SELECT event_type, place, hits::BIGINT AS hits, hits / place AS accuracy FROM r WHERE place % 25 = 0""")
def running_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("event_type", "ts", "event_id", (F.col("value") > 50).alias("hit"))
    e = batches.numbered_within(e, "event_type", ["ts", "event_id"])
    return metrics.running_accuracy(e, "hit", "place", 25, "event_type")


@query("""SELECT event_type, arg_min(event_id, (value, event_id)) AS best_step, min(value) AS best_loss FROM events WHERE value IS NOT NULL GROUP BY 1""")
def best_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.best_checkpoint(read(spark, sf_dir, "events").select("event_type", "event_id", "value"), "event_id", "value", ["event_type"])


@query("""WITH e AS (SELECT user_id, event_id, value, row_number() OVER w AS n, min(value) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
l AS (SELECT *, n - max(CASE WHEN best IS NULL OR value < best THEN n END) OVER (PARTITION BY user_id ORDER BY event_id) AS since FROM e)
SELECT user_id, min(CASE WHEN since >= 2 THEN event_id END) AS stop_step FROM l GROUP BY 1""")
def early_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.early_stop(read(spark, sf_dir, "events").select("user_id", "event_id", "value"), "event_id", "value", 2, "user_id")


@query("""WITH e AS (SELECT event_type, CAST(floor(value * 100) AS BIGINT) AS v, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS a, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS z FROM events)
SELECT event_type, avg(v) FILTER (a <= 3) AS first_mean, avg(v) FILTER (z <= 3) AS last_mean, avg(v) FILTER (a <= 3) - avg(v) FILTER (z <= 3) AS "drop" FROM e GROUP BY 1""")
def first_last_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("event_type", "ts", "event_id", F.floor(F.col("value") * 100).alias("v0"))
    return metrics.first_last_mean(e, "v0", ["ts", "event_id"], 3, "event_type")


@query("SELECT json_extract_string(props, '$.k') AS k, count(*) AS n FROM events GROUP BY 1")
def json_prop_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").groupBy(F.get_json_object("props", "$.k").alias("k")).agg(F.count("*").alias("n"))


@query("""WITH d AS (SELECT doc_id, CAST(trunc(n_chars / 10.0) AS INTEGER) AS n FROM documents), w AS (SELECT doc_id, n, unnest(range(least(n, 30))) AS i FROM d WHERE n >= 1)
SELECT doc_id, CASE WHEN n > 30 THEN floor(i * (n / 30.0::DOUBLE)) ELSE i END + 0.5 AS time_s FROM w""")
def even_frame_subsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") / 10).alias("duration"))
    return d.select("doc_id", F.explode(N.frame_times(F.col("duration"))).alias("time_s"))


@query("SELECT doc_id, ord, ord // 8 AS batch_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS ord FROM documents)")
def batch_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batches.with_batch(batches.numbered(read(spark, sf_dir, "documents").select("doc_id"), ["doc_id"]), 8)


TURNS_SQL = """t AS (SELECT conv_id, turn, role, CASE WHEN turn = 0 AND conv_id % 3 = 0 THEN concat('<image>', chr(10), text) ELSE text END AS value, CASE role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'gpt' ELSE role END AS who,
 row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
c AS (SELECT conv_id, turn, k, value, CASE WHEN who = 'human' THEN 'user' ELSE 'assistant' END AS role FROM t WHERE NOT (k = 1 AND who <> 'human'))"""


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, has_image, turns): the first turn of every third conversation shows an image."""
    c = read(spark, sf_dir, "conversations")
    value = F.expr("CASE WHEN turn = 0 AND conv_id % 3 = 0 THEN concat('<image>', chr(10), text) ELSE text END")
    who = F.expr("CASE role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'gpt' ELSE role END")
    t = F.array_sort(F.collect_list(F.struct("turn", who.alias("from"), value.alias("value"))))
    g = c.groupBy("conv_id").agg(t.alias("t"))
    return g.select("conv_id", (F.col("conv_id") % 3 == 0).alias("has_image"), F.transform("t", lambda x: F.struct(x["from"].alias("from"), x["value"].alias("value"))).alias("turns"))


@query(f"""WITH {TURNS_SQL} SELECT i.conv_id, coalesce(string_agg(concat('<|im_start|>', role, chr(10), value, '<|im_end|>', chr(10)), '' ORDER BY k), '') AS chat FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN c ON i.conv_id = c.conv_id GROUP BY 1""")
def chatml_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, sf_dir).select("conv_id", Q.render_chat(Q.chat_turns(F.col("turns"))).alias("chat"))


def samples(spark: SparkSession, sf_dir: str, most: int | None = None) -> DataFrame:
    t = turns(spark, sf_dir).withColumn("s", Q.chat_segments(Q.chat_turns(F.col("turns")), F.col("has_image"), Q.split_tokens))
    ids, lab = Q.joined(F.col("s"))
    return t.select("conv_id", "has_image", Q.truncate(ids, most).alias("input_ids"), Q.truncate(lab, most).alias("labels"))


#: Whitespace tokens of a turn: head, body (an image splits it in two), closing mark.
TOKENS_SQL = f"""{TURNS_SQL}, s AS (SELECT conv_id, k, role, conv_id % 3 = 0 AND contains(value, '<image>') AS img, length(concat('<|im_start|>', role, chr(10)))::BIGINT AS head, value FROM c),
b AS (SELECT conv_id, k, role, head, CASE WHEN img THEN list_concat(list_concat([w for w in string_split(split_part(value, '<image>', 1), ' ') if w <> ''], ['#IMG#']), [w for w in string_split(split_part(value, '<image>', 2), ' ') if w <> '']) ELSE [w for w in string_split(value, ' ') if w <> ''] END AS words FROM s),
g AS (SELECT conv_id, k, list_concat([head], list_concat([CASE WHEN w = '#IMG#' THEN -200 ELSE length(w) END for w in words], [11])) AS ids,
 list_concat([-100], list_concat([CASE WHEN role <> 'assistant' OR w = '#IMG#' THEN -100 ELSE length(w) END for w in words], [CASE WHEN role = 'assistant' THEN 11 ELSE -100 END])) AS labs FROM b),
m AS (SELECT i.conv_id, coalesce(flatten(list(ids ORDER BY k) FILTER (ids IS NOT NULL)), []) AS ids, coalesce(flatten(list(labs ORDER BY k) FILTER (labs IS NOT NULL)), []) AS labs FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN g ON i.conv_id = g.conv_id GROUP BY 1)"""


def _flat(ids: str) -> str:
    return f"array_to_string([x::VARCHAR for x in {ids}], ' ')"


def flat(c: str) -> F:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), " ")


@query(f"WITH {TOKENS_SQL} SELECT conv_id, {_flat('ids')} AS ids, {_flat('labs')} AS labels, len([x for x in labs if x <> -100])::INTEGER AS n_supervised FROM m")
def turn_label_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).select("conv_id", flat("input_ids").alias("ids"), flat("labels").alias("labels"), F.size(F.filter("labels", lambda x: x != -100)).alias("n_supervised"))


@query(f"WITH {TOKENS_SQL} SELECT conv_id, {_flat('ids[1:64]')} AS ids, {_flat('labs[1:64]')} AS labels FROM m")
def truncate_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir, 64).select("conv_id", flat("input_ids").alias("ids"), flat("labels").alias("labels"))


@query(f"""WITH {TOKENS_SQL}, x AS (SELECT conv_id, conv_id // 8 AS batch_id, ids, labs FROM m), y AS (SELECT *, max(len(ids)) OVER (PARTITION BY batch_id) AS n FROM x)
SELECT conv_id, batch_id, n::INTEGER AS batch_len, {_flat('list_resize(ids, n, 0)')} AS ids, {_flat('list_resize(labs, n, -100)')} AS labels, len(ids)::BIGINT AS n_attended FROM y""")
def pad_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = batches.padded(batches.with_batch(samples(spark, sf_dir), 8, "conv_id"), "batch_id", 0)
    return x.select("conv_id", "batch_id", "batch_len", flat("input_ids").alias("ids"), flat("labels").alias("labels"), F.aggregate("attention_mask", F.lit(0).cast("long"), lambda a, v: a + v).alias("n_attended"))


@query(f"""WITH {TOKENS_SQL}, x AS (SELECT conv_id, ids, labs FROM m), y AS (SELECT *, coalesce(list_position(ids, -200), 0) AS p FROM x)
SELECT conv_id, (len(ids) + CASE WHEN p > 0 THEN 31 ELSE 0 END)::INTEGER AS n_spliced, {_flat('CASE WHEN p > 0 THEN list_concat(list_concat(labs[1:p-1], [-100 for i in range(32)]), labs[p+1:]) ELSE labs END')} AS labels,
 {_flat('[greatest(i, 0) for i in ids]')} AS embeddable FROM y""")
def splice_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = samples(spark, sf_dir).withColumn("out", Q.splice_labels(F.col("labels"), F.col("input_ids"))).withColumn("emb", Q.embeddable(F.col("input_ids")))
    return x.select("conv_id", F.size("out").alias("n_spliced"), flat("out").alias("labels"), flat("emb").alias("embeddable"))


@query("""WITH t AS (SELECT conv_id, CASE WHEN turn = 0 AND conv_id % 3 = 0 THEN length(text) + 8 ELSE length(text) END AS n FROM conversations)
SELECT conv_id, (sum(n) + CASE WHEN conv_id % 3 = 0 THEN 96 ELSE 0 END)::BIGINT AS length_proxy FROM t GROUP BY 1""")
def length_proxy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, sf_dir).select("conv_id", Q.length_proxy(F.col("turns"), F.col("has_image")).alias("length_proxy"))


@query("""WITH n AS (SELECT count(*) AS c FROM documents), x AS (SELECT doc_id, n_chars, ('0x' || substr(md5('42' || doc_id), 1, 8))::BIGINT % CAST(ceil(c / 128.0) AS BIGINT) AS mega_id FROM documents, n)
SELECT doc_id, n_chars, mega_id, (row_number() OVER (PARTITION BY mega_id ORDER BY n_chars DESC, doc_id) - 1)::INTEGER AS place FROM x""")
def length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batches.length_groups(read(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id", "n_chars", 128)


@query("SELECT image, row_number() OVER (ORDER BY first, image) - 1 AS idx FROM (SELECT md5(text) AS image, min(doc_id) AS first FROM documents GROUP BY 1)")
def dense_distinct_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.dense_ids(read(spark, sf_dir, "documents").select(F.md5("text").alias("image"), "doc_id"), "image", "doc_id")


@query("""WITH r AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN NULL ELSE concat('v', doc_id) END AS image FROM documents), c AS (SELECT concat('v', vec_id) AS image, vec_id % 7 <> 0 AS ok, label FROM embeddings)
SELECT r.doc_id, r.image, CASE WHEN r.image IS NULL THEN 'kept' WHEN c.image IS NULL THEN 'uncached' WHEN NOT ok THEN 'failed' ELSE 'kept' END AS status FROM r LEFT JOIN c ON r.image = c.image""")
def feature_join_with_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = read(spark, sf_dir, "documents").select("doc_id", F.expr("CASE WHEN doc_id % 10 = 0 THEN NULL ELSE concat('v', doc_id) END").alias("image"))
    c = read(spark, sf_dir, "embeddings").select(F.expr("concat('v', vec_id)").alias("image"), F.expr("vec_id % 7 <> 0").alias("ok"))
    return features.with_reason(r, c)


@query("""WITH r AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'kept' WHEN vec_id IS NULL THEN 'uncached' WHEN vec_id % 7 = 0 THEN 'failed' ELSE 'kept' END AS s FROM documents LEFT JOIN embeddings ON doc_id = vec_id)
SELECT count(*) FILTER (s = 'kept') AS n_kept, count(*) FILTER (s = 'uncached') AS n_uncached, count(*) FILTER (s = 'failed') AS n_failed FROM r""")
def feature_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.reasons(feature_join_with_reasons(spark, sf_dir))


@query("""WITH n AS (SELECT count(*) AS c FROM embeddings), o AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS ord, vec_id % 3 = 0 AS ok FROM embeddings)
SELECT o.vec_id, o.ord, (SELECT arg_min(p.ord, (p.ord - o.ord + c) % c) FROM o p, n WHERE p.ok AND (p.ord - o.ord + c) % c < 5) AS used FROM o""")
def decode_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = batches.numbered(read(spark, sf_dir, "embeddings").select("vec_id", (F.col("vec_id") % 3 == 0).alias("ok")), ["vec_id"])
    return features.with_fallback(o).select("vec_id", "ord", "used")


@query("""SELECT vec_id, round(list_sum([embedding[i]::DOUBLE * (i % 3 - 1) for i in range(1, 65)]) + 1, 4) AS y0, round(list_sum([embedding[i]::DOUBLE * (i % 5 - 2) for i in range(1, 65)]) - 1, 4) AS y1 FROM embeddings""")
def linear_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = [[float(i % 3 - 1) for i in range(1, 65)], [float(i % 5 - 2) for i in range(1, 65)]]
    y = Q.project_small(F.col("embedding"), w, [1.0, -1.0])
    return read(spark, sf_dir, "embeddings").select("vec_id", y.alias("y")).select("vec_id", F.round(F.col("y")[0], 4).alias("y0"), F.round(F.col("y")[1], 4).alias("y1"))


@query("""SELECT frame_path, CASE WHEN ('0x' || substr(md5(frame_path), 1, 8))::BIGINT % 2 = 1 THEN 'Yes.' ELSE 'No.' END AS reply FROM (SELECT concat('f/', doc_id) AS frame_path FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels))""")
def stub_inference_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = labels.not_done(read(spark, sf_dir, "documents").select("doc_id"), read(spark, sf_dir, "labels"), "doc_id")
    return infer(d.select(F.concat(F.lit("f/"), F.col("doc_id").cast("string")).alias("frame_path")), Stub).select("frame_path", "reply")


@query("""SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY md5('42' || o_orderkey), o_orderkey) AS k FROM orders) WHERE k <= 5""")
def sample_orders_per_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.sample_by_group(read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey", "o_orderkey", 5)


@query("""WITH s AS (SELECT doc_id // 2 AS video_id, lang = 'en' AS classification, source AS batch_name, row_number() OVER (PARTITION BY doc_id // 2 ORDER BY doc_id DESC) AS k FROM documents),
e AS (SELECT doc_id // 3 AS video_id, CASE WHEN doc_id % 4 = 0 THEN '' ELSE concat('s', doc_id) END AS summary, CASE WHEN quality = 1 THEN 'grid' ELSE '' END AS layout_category, toxic = 1 AS is_sludge, row_number() OVER (PARTITION BY doc_id // 3 ORDER BY doc_id DESC) AS k FROM labels)
SELECT s.video_id, classification, batch_name, summary, layout_category, is_sludge FROM s LEFT JOIN e ON s.video_id = e.video_id AND e.k = 1 WHERE s.k = 1""")
def label_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "documents").select(F.expr("doc_id div 2").alias("id"), (F.col("lang") == "en").alias("classification"), F.col("source").alias("batch_name"), F.lit("train").alias("split"), F.col("doc_id").alias("ord"))
    e = read(spark, sf_dir, "labels").select(F.expr("doc_id div 3").alias("video_id"), F.expr("CASE WHEN doc_id % 4 <> 0 THEN concat('s', doc_id) END").alias("summary"), F.expr("CASE WHEN quality = 1 THEN 'grid' END").alias("layout_category"), (F.col("toxic") == 1).alias("is_sludge"), F.col("doc_id").alias("ord"))
    return labels.label_lookup(s, e).drop("split")


@query(f"""WITH {FRAMES} SELECT video_id, frame_path, round_even(doc_id / 8.0::DOUBLE, 2) AS time_s, gt AS classification, toxic = 1 AS is_sludge, layout AS layout_category, concat('s', doc_id) AS summary, split, 'b1' AS batch FROM f""")
def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir).withColumns({"batch": F.lit("b1"), "time_s": F.col("doc_id") / F.lit(8.0), "classification": F.col("gt"), "is_sludge": F.col("toxic") == 1, "layout_category": F.col("layout"), "summary": F.expr("concat('s', doc_id)")})
    return labels.manifest_rows(f)


@query(f"""WITH {FRAMES} SELECT frame_path, video_id, split, doc_id / 8.0::DOUBLE AS time_s, gt AS gt_classification, toxic = 1 AS gt_is_sludge, layout AS gt_layout, reply AS teacher_raw, {TEACHER} AS sludge, layout AS layout FROM f""")
def teacher_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir).withColumns({"time_s": F.col("doc_id") / F.lit(8.0), "classification": F.col("gt"), "is_sludge": F.col("toxic") == 1, "layout_category": F.col("layout"), "teacher_raw": F.col("reply"), "teacher": F.struct(F.expr(TEACHER).alias("sludge"), F.col("layout").alias("layout"))})
    return labels.teacher_rows(f).select("*", "teacher.sludge", "teacher.layout").drop("teacher")


@query(f"""WITH {FRAMES} SELECT frame_path, video_id, split AS split_source, gt AS gt_is_sludge, {TEACHER} AS teacher_sludge, layout AS teacher_layout, 'd' AS teacher_desc, {JUDGE} AS judge_sludge, concat('r', doc_id) AS judge_reason, reply AS judge_raw FROM f""")
def judge_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    teacher = F.struct(F.expr(TEACHER).alias("sludge"), F.col("layout").alias("layout"), F.lit("d").alias("description"))
    f = frames(spark, sf_dir).withColumns({"split_source": F.col("split"), "gt_is_sludge": F.col("gt"), "teacher": teacher, "judged": F.struct(F.expr(JUDGE).alias("sludge"), F.expr("concat('r', doc_id)").alias("reason")), "judge_raw": F.col("reply")})
    return labels.judge_rows(f)


@query(f"WITH {FRAMES} SELECT doc_id, CASE WHEN gt THEN 'Why is it?' ELSE 'Why is it not?' END AS prompt FROM f")
def label_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames(spark, sf_dir).select("doc_id", conversations.prompt_for(F.col("gt"), "Why is it?", "Why is it not?").alias("prompt"))


IMAGE_OF = "CASE doc_id % 10 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE concat('v', doc_id) END"


@query(f"SELECT doc_id, image FROM (SELECT doc_id, {IMAGE_OF} AS image FROM documents) WHERE image IS NULL OR image = '' OR image IN (SELECT concat('v', vec_id) FROM embeddings)")
def existing_images_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    listing = read(spark, sf_dir, "embeddings").select(F.expr("concat('v', vec_id)").alias("path"))
    return features.existing_only(read(spark, sf_dir, "documents").select("doc_id", F.expr(IMAGE_OF).alias("image")), listing)


@query(f"""SELECT doc_id, image, CASE WHEN vec_id IS NULL THEN 2 ELSE 1 END::INTEGER AS n_rows, coalesce(embedding[1], 0)::DOUBLE AS x0, coalesce(embedding[64], 0)::DOUBLE AS x63 FROM (SELECT doc_id, {IMAGE_OF} AS image FROM documents)
LEFT JOIN embeddings ON image = concat('v', vec_id) AND vec_id % 7 <> 0 WHERE image IS NULL OR image = '' OR vec_id IS NOT NULL""")
def feature_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache = read(spark, sf_dir, "embeddings").select(F.expr("concat('v', vec_id)").alias("image"), F.expr("vec_id % 7 <> 0").alias("ok"), Q.first_rows(F.array("embedding", "embedding"), 1).alias("features"))
    x = features.with_features(read(spark, sf_dir, "documents").select("doc_id", F.expr(IMAGE_OF).alias("image")), cache, rows=2, width=64)
    return x.select("doc_id", "image", F.size("features").alias("n_rows"), F.col("features")[0][0].cast("double").alias("x0"), F.col("features")[0][63].cast("double").alias("x63"))


@query(f"SELECT d.doc_id, d.source, l.split FROM documents d JOIN (SELECT doc_id, {SPLIT} AS split FROM labels) l ON d.doc_id = l.doc_id")
def split_overridden(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = read(spark, sf_dir, "labels").select("doc_id", F.expr(SPLIT).alias("split"))
    return sampling.with_split(read(spark, sf_dir, "documents").select("doc_id", "source", F.lit("none").alias("split")), named, "doc_id")


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars, doc_id LIMIT 20")
def limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.limit_rows(read(spark, sf_dir, "documents").select("doc_id", "n_chars"), ["n_chars", "doc_id"], 20)


VIDEO_PATH = "concat('root/', source, '/clip.', doc_id, CASE doc_id % 3 WHEN 0 THEN '.mp4' WHEN 1 THEN '' ELSE '.tar.gz' END)"


@query(rf"""SELECT doc_id, string_split(p, '/')[-1] AS name, regexp_replace(string_split(p, '/')[-1], '\.[^.]*$', '') AS stem, string_split(p, '/')[-2] AS parent, substr(p, 6) AS inner_path,
 concat('v', doc_id, '_f', doc_id % 31, '.jpg') AS frame FROM (SELECT doc_id, {VIDEO_PATH} AS p FROM documents)""")
def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, p = read(spark, sf_dir, "documents").select("doc_id", F.expr(VIDEO_PATH).alias("p")), F.col("p")
    frame = T.frame_name(F.expr("concat('v', doc_id)"), F.expr("doc_id % 31 + 0.75D"))
    return x.select("doc_id", T.file_name(p).alias("name"), T.file_stem(p).alias("stem"), T.parent_name(p).alias("parent"), T.without_prefix(p, "root/").alias("inner_path"), frame.alias("frame"))


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN concat('__ERROR__: OSError: ', source) ELSE 'Yes.' END AS raw, CASE WHEN doc_id % 4 <> 0 THEN 'Yes.' END AS answer FROM documents")
def error_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("doc_id") % 4 == 0, T.error_marker(F.lit("OSError"), F.col("source"))).otherwise("Yes.")
    return read(spark, sf_dir, "documents").select("doc_id", raw.alias("raw"), T.without_errors(raw).alias("answer"))


@query("""SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 0)""")
def resume_retries_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = read(spark, sf_dir, "labels").select("doc_id", F.when(F.col("toxic") == 0, "Yes.").otherwise("__ERROR__: OSError: x").alias("teacher_raw"))
    return labels.not_done(read(spark, sf_dir, "documents").select("doc_id", "source"), done, "doc_id", retry_errors=True)


@query(f"""SELECT conv_id, turn, concat('<|im_start|>user', chr(10), CASE WHEN conv_id % 3 = 0 THEN concat(repeat('<image>', 32), chr(10)) ELSE '' END, text, '<|im_end|>', chr(10), '<|im_start|>assistant', chr(10)) AS template,
 concat('<|im_start|>user', chr(10), text, '<|im_end|>', chr(10), '<|im_start|>assistant', chr(10)) AS prompt FROM conversations""")
def prompt_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("text"))
    text = item("text", F.col("text"))
    content = F.when(F.col("conv_id") % 3 == 0, F.array(item("image", F.lit(None).cast("string")), text)).otherwise(F.array(text))
    messages = F.array(F.struct(F.lit("user").alias("role"), content.alias("content")))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", Q.render_template(messages, prompt=True).alias("template"), Q.render_prompt(F.col("text")).alias("prompt"))


@query(f"""WITH x AS (SELECT doc_id, [length(w)::BIGINT for w in string_split(concat(coalesce(text, ''), '<|im_end|>'), ' ') if w <> ''] AS t FROM documents)
SELECT doc_id, {_flat("list_concat([-200], t)")} AS ids, {_flat("list_concat([-100], t)")} AS labels FROM x""")
def caption_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = lambda who, value: F.struct(F.lit(who).alias("from"), value.alias("value"))
    said = F.array(turn("human", F.lit(Q.IMAGE_TEXT)), turn("gpt", F.coalesce("text", F.lit(""))))
    ids, lab = Q.caption_sample(said, Q.split_tokens)
    return read(spark, sf_dir, "documents").select("doc_id", ids.alias("ids"), lab.alias("labels")).select("doc_id", flat("ids").alias("ids"), flat("labels").alias("labels"))


@query(SQL["linear_projection"])
def model_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = np.array([[i % 3 - 1 for i in range(1, 65)], [i % 5 - 2 for i in range(1, 65)]], np.float64)
    y = Q.project(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding", w, np.array([1.0, -1.0]), "y")
    return y.select("vec_id", F.round(F.col("y")[0], 4).alias("y0"), F.round(F.col("y")[1], 4).alias("y1"))


@query("""SELECT frame_path, CASE WHEN contains(frame_path, 'bad') THEN concat('__ERROR__: FileNotFoundError: ', frame_path) WHEN ('0x' || substr(md5(frame_path), 1, 8))::BIGINT % 2 = 1 THEN 'Yes.' ELSE 'No.' END AS reply
FROM (SELECT concat(CASE WHEN doc_id % 11 = 0 THEN 'bad/' ELSE 'f/' END, doc_id // 2) AS frame_path FROM documents)""")
def inference_with_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch of one row, so that a failure is its own row's only; a key is asked once however often it is given."""
    key = F.expr("concat(CASE WHEN doc_id % 11 = 0 THEN 'bad/' ELSE 'f/' END, doc_id div 2)")
    return infer_once(read(spark, sf_dir, "documents").select(key.alias("frame_path")), Stub, "frame_path", batch_size=1)


def _byte_counter() -> Callable[[bytes], list[list[float]]]:
    """A stand-in encoder: the size of the content, twice; content of a size that divides by three is unreadable."""

    def encode(content: bytes) -> list[list[float]]:
        if len(content) % 3 == 0:
            raise ValueError("unreadable")
        return [[float(len(content))], [-1.0]]

    return encode


@query("""SELECT concat('p', page_id) AS image, page_id AS idx, n % 3 <> 0 AS ok, CASE WHEN n % 3 <> 0 THEN n::DOUBLE END AS size FROM (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n FROM pages)""")
def encoded_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "pages").select(F.expr("concat('p', page_id)").alias("image"), F.col("page_id").alias("idx"), F.coalesce(F.encode("html", "UTF-8"), F.lit(b"")).alias("content"))
    return encode_images(p, _byte_counter, 1).select("image", "idx", "ok", F.col("features")[0][0].cast("double").alias("size"))


@query("""WITH v AS (SELECT DISTINCT source AS video_id FROM documents), n AS (SELECT source AS video_id, count(*) AS n FROM documents WHERE md5(source) >= '4' GROUP BY 1)
SELECT count(*) AS videos, coalesce(sum(n), 0)::BIGINT AS frames, count(*) FILTER (n IS NULL) AS failed FROM v LEFT JOIN n USING (video_id)""")
def extraction_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document is a frame; some of the sources could not be read and have none."""
    d = read(spark, sf_dir, "documents").select(F.col("source").alias("video_id"), F.expr("CASE WHEN md5(source) >= '4' THEN concat('f', doc_id) END").alias("frame_path"))
    return files.extraction_counts(d.select("video_id").distinct(), d)


@query("SELECT doc_id, lang, md5(text) AS print FROM documents")
def lines_written_and_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "lines")
    sinks.write_lines(read(spark, sf_dir, "documents").select("doc_id", "lang", "text"), path)
    return files.read_lines(spark, path, "doc_id long, lang string, text string").select("doc_id", "lang", F.md5("text").alias("print"))


@query("SELECT source, count(*) AS n FROM documents GROUP BY 1")
def array_written_and_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "array")
    sinks.as_array(labels.count_by(read(spark, sf_dir, "documents"), "source"), ["source"]).write.text(path)
    return files.read_array(spark, path, "source string, n long")


@query("SELECT 'train' AS split_source, doc_id AS id, md5(text) AS print FROM documents UNION ALL SELECT 'test', NULL, md5(text) FROM benchmark")
def tagged_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = {tag: fresh_path(spark, tag) for tag in ("train", "test")}
    sinks.write_lines(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), paths["train"])
    sinks.write_lines(read(spark, sf_dir, "benchmark").select("text"), paths["test"])
    return files.read_tagged(spark, paths, "id long, text string").select("split_source", "id", F.md5("text").alias("print"))


DONE_LINE = """CASE doc_id % 5 WHEN 0 THEN concat('{"frame_path":"f', doc_id, '"}') WHEN 1 THEN '{"frame_path":' WHEN 2 THEN '{"other":1}' ELSE '' END"""


@query("SELECT concat('f', doc_id) AS frame_path, CASE WHEN doc_id % 5 <> 0 THEN doc_id END AS doc_id FROM documents")
def append_after_broken_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An earlier run left whole, broken and foreign lines; what it did not write is appended."""
    d, path = read(spark, sf_dir, "documents"), fresh_path(spark, "done")
    d.select(F.expr(DONE_LINE).alias("value")).write.text(path)
    sinks.append_new(d.select(F.expr("concat('f', doc_id)").alias("frame_path"), "doc_id"), path, files.read_done(spark, path, "frame_path string"))
    return files.read_done(spark, path, "frame_path string, doc_id long")


@query("SELECT lang, doc_id FROM documents")
def lines_by_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "by")
    sinks.write_by(read(spark, sf_dir, "documents").select("lang", "doc_id"), path, "lang")
    return files.read_lines(spark, path, "doc_id long, lang string").select("lang", "doc_id")


@query("SELECT concat('v', vec_id) AS image, vec_id AS idx, vec_id % 7 <> 0 AS ok, CASE WHEN vec_id % 7 <> 0 THEN embedding[1]::DOUBLE END AS x0 FROM embeddings")
def features_written_and_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, path = read(spark, sf_dir, "embeddings"), fresh_path(spark, "features")
    ok = F.col("vec_id") % 7 != 0
    sinks.write_features(e.select(F.expr("concat('v', vec_id)").alias("image"), F.col("vec_id").alias("idx"), ok.alias("ok"), F.when(ok, F.array("embedding")).alias("features")), path, "float32", 1, 64, "stub")
    return files.read_features(spark, path, "float32").select("image", "idx", "ok", F.col("features")[0][0].cast("double").alias("x0"))


@query("SELECT vec_id AS idx, concat('v', vec_id) AS image FROM embeddings WHERE vec_id % 7 = 0")
def failed_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.failed_images(read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("idx"), F.expr("concat('v', vec_id)").alias("image"), (F.col("vec_id") % 7 != 0).alias("ok")))


@query("""WITH p AS (SELECT url, min(page_id) AS first FROM pages WHERE url <> '' GROUP BY 1), i AS (SELECT row_number() OVER (ORDER BY first, url) - 1 AS idx, url AS image, first FROM p)
SELECT idx, image, count(*) OVER () AS failed FROM i WHERE first % 3 = 0""")
def failed_images_by_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache of distinct pages is written; the places that its table of failures names are turned back into images."""
    ids, path = features.dense_ids(read(spark, sf_dir, "pages").select("url", "page_id"), "url", "page_id"), fresh_path(spark, "features")
    ids = ids.withColumnRenamed("url", "image")
    first = read(spark, sf_dir, "pages").groupBy(F.col("url").alias("image")).agg(F.min("page_id").alias("first"))
    made = ids.join(first, "image").select("image", "idx", (F.col("first") % 3 != 0).alias("ok"), F.array(F.array(F.length("image").cast("float"))).alias("features"))
    sinks.write_features(made, path, "float32", 1, 1, "pages")
    failed = spark.read.schema(schemas.FEATURES_META).parquet(f"{path}/meta").first()["failed"]
    return features.images_of(files.read_features(spark, path, "float32"), files.read_failed(spark, path)).withColumn("failed", F.lit(failed))


@query("""SELECT concat('{', chr(10), '  "n": ', count(*), ',', chr(10), '  "first": ', coalesce(min(doc_id)::VARCHAR, 'null'), ',', chr(10), '  "note": null', chr(10), '}') AS summary FROM documents""")
def summary_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = read(spark, sf_dir, "documents").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"), F.lit(None).cast("string").alias("note"))
    return spark.createDataFrame([(sinks.summary_text(one),)], "summary string")


@query("SELECT quality::VARCHAR AS quality, count(*) AS n, sum(toxic)::BIGINT AS toxic FROM labels WHERE quality IS NOT NULL GROUP BY 1")
def report_keyed_by_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = read(spark, sf_dir, "labels").where("quality IS NOT NULL").groupBy("quality").agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic"))
    return sinks.keyed_by_text(x, "quality").select(F.explode("by_key").alias("quality", "r")).select("quality", "r.n", "r.toxic")


@query("SELECT frame_path, CASE WHEN ('0x' || substr(md5(frame_path), 1, 8))::BIGINT % 2 = 1 THEN 'Yes.' ELSE 'No.' END AS reply FROM (SELECT concat('f/', doc_id) AS frame_path FROM documents)")
def incremental_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs of a stream over a growing folder of lines, the second with every row again under a new checkpoint: each key is written once."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.expr("concat('f/', doc_id)").alias("frame_path"))
    source, out = fresh_path(spark, "arrivals"), fresh_path(spark, "replies")
    for part in (d.where("doc_id % 2 = 0"), d):
        sinks.write_lines(part.select("frame_path"), source, "append")
        incremental.run_incrementally(incremental.stream_lines(spark, source, "frame_path string"), lambda rows: infer(rows, Stub), out, fresh_path(spark, "checkpoint")).awaitTermination()
    return files.read_lines(spark, out, "frame_path string, reply string")


# Queries of other modules register themselves.
from . import training  # noqa: E402, F401
