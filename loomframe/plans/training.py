"""Registered queries of training: real token ids, spliced feature rows, loss logs as streams, appends, harness, sinks."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bpe
from ..functions import sequences as Q
from ..functions.numbers import percent
from ..operators import batches, features, harness, labels, splice
from ..operators.inference import Stub, encode_images, infer
from ..sources import arrays, media, sinks
from ..sources.shared import fresh_path
from ..streaming import committed, incremental, losses
from .catalog import ANSWERS, FRAMES, GUARD, IMAGE_OF, JUDGE, SQL, TOKENS_SQL, TURNS_SQL, YES_NO, _flat, flat, frames, query, read, samples, turns

#: A public byte-level vocabulary; any file of the format will do.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"

#: Words by the pattern: RE2 cannot look ahead, so a mark (U+0001, which the texts lack) parts the last blank of a run from those before it.
BPE_SQL = rf"""file AS (SELECT content::JSON AS j FROM read_text('{VOCABULARY}')),
vocab AS (SELECT e.key AS token, e.value AS id FROM (SELECT unnest(map_entries(from_json(j -> '$.model.vocab', '"MAP(VARCHAR,BIGINT)"'))) AS e FROM file)),
pairs AS (SELECT from_json(j -> '$.model.merges', '[["VARCHAR"]]') AS p FROM file),
merges AS (SELECT rank, e[1] AS l, e[2] AS r FROM (SELECT unnest(p) AS e, unnest(range(len(p))) AS rank FROM pairs)),
printable AS (SELECT b, (b BETWEEN 33 AND 126 OR b BETWEEN 161 AND 172 OR b BETWEEN 174 AND 255) AS p FROM range(256) t(b)),
names AS (SELECT list(chr((CASE WHEN p THEN b ELSE 255 + (SELECT count(*) FROM printable q WHERE NOT q.p AND q.b <= x.b) END)::INTEGER) ORDER BY b) AS n FROM printable x),
c AS (SELECT conv_id, turn, k, value, CASE WHEN who = 'human' THEN 'user' ELSE 'assistant' END AS role FROM t WHERE NOT (k = 1 AND who <> 'human')),
q AS (SELECT conv_id, k, role, list_concat(list_concat([[concat('<|im_start|>', role, chr(10)), 'h']], CASE WHEN conv_id % 3 = 0 AND contains(value, '<image>') THEN [[split_part(value, '<image>', 1), 'b'], ['', 'i'], [split_part(value, '<image>', 2), 'b']] ELSE [[value, 'b']] END), [[concat('<|im_end|>', chr(10)), 'b']]) AS x FROM c),
p AS (SELECT conv_id, role, x[2] AS kind, x[1] AS text, k * 10 + i AS k FROM (SELECT conv_id, k, role, unnest(x) AS x, unnest(range(len(x))) AS i FROM q)),
w AS (SELECT conv_id, k, role, kind, [y for y in regexp_extract_all(regexp_replace(text, '(\s+)(\s\S)', '\1' || chr(1) || '\2', 'g'), '''(?:s|t|re|ve|m|ll|d)| ?\p{{L}}+| ?\p{{N}}+| ?[^\s\p{{L}}\p{{N}}' || chr(1) || ']+|\s+') if y <> chr(1)] AS words FROM p),
d AS (SELECT DISTINCT unnest(words) AS word FROM w),
s AS (SELECT word, [n[('0x' || substr(x, 2 * i + 1, 2))::BIGINT + 1] for i in range(len(x) // 2)] AS s FROM (SELECT word, hex(encode(word)) AS x FROM d), names),
m AS (SELECT word, s FROM s UNION ALL SELECT word, list_concat(list_concat(s[1:pos-1], [s[pos] || s[pos+1]]), s[pos+2:]) FROM
 (SELECT word, any_value(s) AS s, arg_min(i, rank * 1000000 + i) AS pos FROM (SELECT word, s, unnest(range(1, len(s))) AS i FROM m) x JOIN merges ON l = s[i] AND r = s[i+1] GROUP BY word)),
e AS (SELECT word, arg_min(s, len(s)) AS s FROM m GROUP BY word),
ids AS (SELECT word, list(id ORDER BY i) AS ids FROM (SELECT word, unnest(s) AS token, unnest(range(len(s))) AS i FROM e) JOIN vocab USING (token) GROUP BY word),
z AS (SELECT conv_id, k, role, kind, flatten(list(ids ORDER BY i) FILTER (ids IS NOT NULL)) AS ids FROM (SELECT conv_id, k, role, kind, unnest(CASE WHEN words = [] THEN [NULL] ELSE words END) AS word, unnest(range(greatest(len(words), 1))) AS i FROM w) LEFT JOIN ids USING (word) GROUP BY ALL),
a AS (SELECT conv_id, k, CASE WHEN kind = 'i' THEN [-200] ELSE coalesce(ids, []) END AS ids, kind = 'b' AND role = 'assistant' AS said FROM z),
tokens AS (SELECT o.conv_id, coalesce(flatten(list(a.ids ORDER BY k) FILTER (k IS NOT NULL)), []) AS ids, coalesce(flatten(list(CASE WHEN said THEN a.ids ELSE [-100 for i in a.ids] END ORDER BY k) FILTER (k IS NOT NULL)), []) AS labs FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN a ON o.conv_id = a.conv_id GROUP BY 1)"""
BPE_SQL = f"WITH RECURSIVE {TURNS_SQL[: TURNS_SQL.index('c AS (')]}{BPE_SQL}"


def token_samples(spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(conv_id, has_image, input_ids, labels) of whole conversations in byte-pair ids."""
    path = vocabulary if "://" in vocabulary else f"file://{vocabulary}"
    t = turns(spark, sf_dir).select("conv_id", "has_image", Q.chat_pieces(Q.chat_turns(F.col("turns")), F.col("has_image")).alias("pieces"))
    t = t.withColumn("tokens", bpe.tokenizer(spark, path)(F.transform("pieces", lambda p: p["text"])))
    ids, labels = Q.assembled(F.col("pieces"), F.col("tokens"))
    return t.select("conv_id", "has_image", ids.alias("input_ids"), labels.alias("labels"))


@query(f"{BPE_SQL} SELECT conv_id, {_flat('ids')} AS ids, {_flat('labs')} AS labels, len([x for x in ids if x = -200])::INTEGER AS n_images, len([x for x in labs if x <> -100])::INTEGER AS n_supervised FROM tokens")
def byte_pair_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole conversations as byte-pair ids, the image's sentinel in its place, and labels of what the assistant says."""
    n = lambda c, f: F.size(F.filter(c, f))
    return token_samples(spark, sf_dir).select("conv_id", flat("input_ids").alias("ids"), flat("labels").alias("labels"), n("input_ids", lambda x: x == Q.IMAGE_TOKEN).alias("n_images"), n("labels", lambda x: x != Q.IGNORE).alias("n_supervised"))


@query(f"""WITH {TOKENS_SQL}, cut AS (SELECT conv_id, conv_id // 8 AS batch_id, ids, labs, coalesce(list_position(ids, -200), 0) AS mark FROM m),
places AS (SELECT conv_id, ids[i] AS id, i + CASE WHEN mark > 0 AND i > mark THEN 31 ELSE 0 END AS place FROM (SELECT *, unnest(range(1, len(ids) + 1)) AS i FROM cut)),
rws AS (SELECT conv_id, place, embedding AS v FROM places JOIN embeddings ON vec_id = id
 UNION ALL SELECT conv_id, mark + x, [y * (x + 1) for y in embedding] FROM cut JOIN embeddings ON vec_id = conv_id AND vec_id % 7 <> 0, range(32) q(x) WHERE mark > 0),
sums AS (SELECT conv_id, sum(list_sum([v[j]::DOUBLE * j for j in range(1, 65)]) * (place + 1)) AS total FROM rws GROUP BY 1),
long AS (SELECT conv_id, batch_id, len(ids) + CASE WHEN mark > 0 THEN 31 ELSE 0 END AS n, CASE WHEN mark > 0 THEN list_concat(list_concat(labs[1:mark-1], [-100 for i in range(32)]), labs[mark+1:]) ELSE labs END AS labs FROM cut),
even AS (SELECT *, max(n) OVER (PARTITION BY batch_id) AS batch_len FROM long)
SELECT conv_id, batch_id, batch_len::INTEGER AS batch_len, batch_len::INTEGER AS n_rows, 64 AS width, n::BIGINT AS n_attended, {_flat('list_resize(labs, batch_len, -100)')} AS labels, round(coalesce(total, 0), 2) AS checksum FROM even LEFT JOIN sums USING (conv_id)""")
def spliced_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as rows of features: vec_id is the token's id in the embedding table, and the conversation's image; every seventh image could not be read."""
    e = read(spark, sf_dir, "embeddings")
    block = F.transform(F.sequence(F.lit(0), F.lit(Q.QUERY_TOKENS - 1)), lambda k: F.transform("embedding", lambda x: (x * (k + 1)).cast("float")))
    images = e.where("vec_id % 7 <> 0").select(F.col("vec_id").alias("conv_id"), block.alias("features"))
    rows = splice.spliced(samples(spark, sf_dir).select("conv_id", "input_ids", "labels"), e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), images, "conv_id", 64, Q.QUERY_TOKENS)
    x = splice.padded_rows(batches.with_batch(rows, 8, "conv_id"), "batch_id", 64)
    weighed = F.transform("rows", lambda r, i: F.aggregate(F.transform(r, lambda v, j: v.cast("double") * (j + 1)), F.lit(0.0), lambda a, v: a + v) * (i + 2))
    total = lambda c, zero: F.aggregate(c, zero, lambda a, v: a + v)
    shape = {"n_rows": F.size("rows"), "width": F.size(F.get("rows", F.lit(0))), "n_attended": total("attention_mask", F.lit(0).cast("long")), "checksum": F.round(total(weighed, F.lit(0.0)), 2)}
    return x.withColumns(shape | {"flat": flat("labels")}).select("conv_id", "batch_id", "batch_len", *shape, F.col("flat").alias("labels"))


@query("""WITH e AS (SELECT event_type AS run, event_id AS step, CASE WHEN event_id % 7 = 0 THEN value / 2 ELSE value END AS value, event_id % 5 = 0 AS evaluated FROM events),
v AS (SELECT *, row_number() OVER w AS n, min(value) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM e WHERE evaluated WINDOW w AS (PARTITION BY run ORDER BY step)),
l AS (SELECT *, n - max(CASE WHEN best IS NULL OR value < best THEN n END) OVER (PARTITION BY run ORDER BY step) AS since FROM v)
SELECT run, (SELECT count(*) FROM e WHERE e.run = l.run AND NOT evaluated) AS n_train, count(*) AS n_eval, arg_min(step, (value, step)) AS best_step, min(value) AS best_loss, min(CASE WHEN since >= 2 THEN step END) AS stop_step FROM l GROUP BY run""")
def loss_log_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a loss log that arrives in three parts: every fifth step is an evaluation, every tenth row comes half a day late, every
    seventh step comes again. The stream is stopped and started between the parts; its last results are those of the whole log."""
    rows = read(spark, sf_dir, "events").select(F.col("event_type").alias("run"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("step"), "value", F.lit(0).alias("again"))
    again = rows.where("step % 7 = 0").select("run", (F.col("at") + F.expr("INTERVAL 1 HOUR")).alias("at"), "step", (F.col("value") / 2).alias("value"), F.lit(6).alias("again"))
    rows = rows.unionByName(again).withColumn("arrives", F.unix_timestamp("at") + 3600 * (F.col("again") + F.when(F.col("step") % 10 == 3, 12).otherwise(0)))
    loss = lambda name, of: F.when(of, F.col("value")).alias(name)
    log = rows.select("run", "at", "step", loss("loss", F.col("step") % 5 != 0), loss("eval_loss", F.col("step") % 5 == 0), "arrives")
    first, last = log.agg(F.min("arrives"), F.max("arrives")).first()
    source, out = fresh_path(spark, "log"), fresh_path(spark, "results")
    for part in range(3):
        of = F.least(F.floor((F.col("arrives") - F.lit(first)) * 3 / F.lit((last or 0) - (first or 0) + 1)), F.lit(2))
        sinks.write_lines(log.where(of == part).drop("arrives"), source, "append")
        lines = incremental.stream_lines(spark, source, "run string, at timestamp, step long, loss double, eval_loss double")
        run = losses.follow(lines, "2 days").writeStream.outputMode("update").foreachBatch(lambda rows, number: committed.commit(rows, number, out) and None)
        run.option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return losses.results(committed.read_committed(spark, out, losses.PART))


@query("SELECT frame_path, CASE WHEN ('0x' || substr(md5(frame_path), 1, 8))::BIGINT % 2 = 1 THEN 'Yes.' ELSE 'No.' END AS reply, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 1 END AS batch FROM (SELECT doc_id, concat('f/', doc_id) AS frame_path FROM documents)")
def replies_committed_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two arrivals, the second with every row of the first again; the second batch fails after it has written its rows, and is replayed."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.expr("concat('f/', doc_id)").alias("frame_path"))
    source, out = fresh_path(spark, "arrivals"), fresh_path(spark, "replies")

    def breaks(batch: int) -> None:
        if batch == 1:
            raise OSError("lost before the batch was entered in the log")

    def run(before: Callable[[int], None] | None = None) -> None:
        rows = incremental.stream_lines(spark, source, "frame_path string")
        committed.append_once(rows, lambda x: infer(x, Stub), out, "frame_path", before).awaitTermination()

    sinks.write_lines(d.where("doc_id % 3 = 0").select("frame_path"), source, "append")
    run()
    sinks.write_lines(d.select("frame_path"), source, "append")
    try:
        run(breaks)
    except StreamingQueryException:
        run()
    return committed.read_committed(spark, out, "frame_path string, reply string").withColumn("batch", F.col("batch").cast("int"))


class Signs:
    """A small model: Yes where the weighed sum of a vector is positive. It has room for `most` vectors at once."""

    def __init__(self, most: int):
        self.most = most

    def reply(self, batch: pd.DataFrame) -> list[str]:
        if len(batch) > self.most:
            raise MemoryError(f"more than {self.most} vectors")
        x = np.stack(batch["embedding"].to_list()).astype(np.float64)
        return np.where(x @ (np.arange(x.shape[1]) % 5 - 2.0) > 0, "Yes.", "No.").tolist()


@query("""WITH r AS (SELECT list_sum([embedding[i]::DOUBLE * ((i - 1) % 5 - 2) for i in range(1, 65)]) > 0 AS yes FROM embeddings)
SELECT size AS batch_size, (SELECT count(*) FROM r) AS n_frames, size > 16 AS failed, CASE WHEN size <= 16 THEN (SELECT count(*) FILTER (yes) FROM r) END AS n_yes, CASE WHEN size <= 16 THEN 100.0::DOUBLE END AS same_as_serial_pct FROM (SELECT unnest([1, 4, 16, 32]) AS size)""")
def batch_sizes_swept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One model over all embeddings at rising batch sizes, until one has no room; replies are compared with the serial run's by key."""
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    report, replies = harness.sweep(rows, lambda: Signs(16), [1, 4, 16, 32, 64])
    serial = replies.where("run = 'bs=1'").select("vec_id", F.col("reply").alias("serial"))
    by_run = replies.join(serial, "vec_id").groupBy("run").agg(F.count_if(F.col("reply") == "Yes.").alias("n_yes"), percent(F.count_if(F.col("reply") == F.col("serial")), F.count("*")).alias("same_as_serial_pct"))
    x = report.withColumn("run", F.concat(F.lit("bs="), F.col("batch_size").cast("string"))).join(by_run, "run", "left")
    return x.select("batch_size", "n_frames", (F.col("n_errors") > 0).alias("failed"), "n_yes", "same_as_serial_pct")


@query("SELECT doc_id, lang, n_chars, md5(text) AS print FROM documents")
def array_parts_written_and_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as one JSON array in parts, and read again."""
    path = fresh_path(spark, "array-parts")
    arrays.write_array(read(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars", "text"), path, ["doc_id"], rows_per_part=10_000)
    return arrays.read_array_parts(spark, path, "doc_id long, lang string, n_chars long, text string").select("doc_id", "lang", "n_chars", F.md5("text").alias("print"))


@query(SQL["feature_join"])
def bucketed_feature_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature join on a cache that was written in buckets by image: its rows are not shuffled again."""
    cache = read(spark, sf_dir, "embeddings").select(F.expr("concat('v', vec_id)").alias("image"), F.expr("vec_id % 7 <> 0").alias("ok"), Q.first_rows(F.array("embedding", "embedding"), 1).alias("features"))
    name = f"features_{uuid.uuid4().hex}"
    sinks.write_buckets(cache, fresh_path(spark, "buckets"), name, 16)
    x = features.with_features(read(spark, sf_dir, "documents").select("doc_id", F.expr(IMAGE_OF).alias("image")), spark.table(name), rows=2, width=64)
    return x.select("doc_id", "image", F.size("features").alias("n_rows"), F.col("features")[0][0].cast("double").alias("x0"), F.col("features")[0][63].cast("double").alias("x63"))


#: Every image is made of a vector: grey 8 x 8 or, for even ids, colour 7 x 3; every seventh is cut off, every eleventh has a comment.
PIXEL = "(floor(abs(embedding[{i}]::DOUBLE) * 997)::BIGINT % 256)"


def made_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image, idx, content)."""
    hexed = F.array_join(F.transform("embedding", lambda x: F.lpad(F.hex(F.floor(F.abs(x.cast("double")) * 997).cast("long") % 256), 2, "0")), "")
    even = F.col("vec_id") % 2 == 0
    head = F.concat(F.when(even, "P6 ").otherwise("P5 "), F.when(F.col("vec_id") % 11 == 0, "# made\n").otherwise(""), F.when(even, "7 3\n255\n").otherwise("8 8\n255\n"))
    body = F.unhex(F.substring(hexed, F.lit(1), F.when(F.col("vec_id") % 7 == 0, 20).when(even, 126).otherwise(128)))
    return read(spark, sf_dir, "embeddings").select(F.expr("concat('v', vec_id)").alias("image"), F.col("vec_id").alias("idx"), F.concat(F.encode(head, "UTF-8"), body).alias("content"))


@query(f"""WITH a AS (SELECT n, greatest(0, least(n - 1, (i + 0.5::DOUBLE) * n / 224 - 0.5::DOUBLE)) AS s FROM (SELECT unnest([3, 7, 8]) AS n), range(224) t(i)),
axis AS (SELECT n, place, sum(w) AS w FROM (SELECT n, floor(s)::INT AS place, 1 - (s - floor(s)) AS w FROM a UNION ALL SELECT n, least(floor(s)::INT + 1, n - 1), s - floor(s) FROM a) GROUP BY 1, 2),
p AS (SELECT vec_id, CASE WHEN vec_id % 2 = 0 THEN c ELSE NULL END AS c, CASE WHEN vec_id % 2 = 0 THEN 3 ELSE 8 END AS h, CASE WHEN vec_id % 2 = 0 THEN 7 ELSE 8 END AS w, y, x, {PIXEL.format(i="CASE WHEN vec_id % 2 = 0 THEN (y * 7 + x) * 3 + c + 1 ELSE y * 8 + x + 1 END")} AS v
 FROM embeddings, range(8) ty(y), range(8) tx(x), range(3) tc(c) WHERE CASE WHEN vec_id % 2 = 0 THEN y < 3 AND x < 7 ELSE c = 0 END),
m AS (SELECT vec_id, sum(CASE WHEN c = 0 OR c IS NULL THEN f.w * g.w * v END) / 50176 AS r, sum(CASE WHEN c = 1 OR c IS NULL THEN f.w * g.w * v END) / 50176 AS g, sum(CASE WHEN c = 2 OR c IS NULL THEN f.w * g.w * v END) / 50176 AS b
 FROM p JOIN axis f ON f.n = h AND f.place = y JOIN axis g ON g.n = p.w AND g.place = x WHERE vec_id % 7 <> 0 GROUP BY 1)
SELECT concat('v', vec_id) AS image, vec_id AS idx, vec_id % 7 <> 0 AS ok, CASE WHEN vec_id % 7 <> 0 THEN 32 END AS n_rows, round(r, 3) AS red, round(g, 3) AS green, round(b, 3) AS blue FROM embeddings LEFT JOIN m USING (vec_id)""")
def pixel_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images from bytes to 32 rows of mean colours of the 224 x 224 image; those that cannot be read are marked."""
    x = encode_images(made_images(spark, sf_dir), media.patch_encoder(np.eye(3)))
    mean = lambda c: F.round(F.aggregate("features", F.lit(0.0), lambda a, r: a + r[c].cast("double")) / 32, 3)
    return x.select("image", "idx", "ok", F.when(F.col("ok"), F.size("features")).alias("n_rows"), mean(0).alias("red"), mean(1).alias("green"), mean(2).alias("blue"))


@query(f"""WITH m AS (SELECT vec_id, list_avg([{PIXEL.format(i="i")} for i in range(1, CASE WHEN vec_id % 2 = 0 THEN 64 ELSE 65 END)]) AS bright FROM embeddings)
SELECT concat('v', vec_id) AS image, CASE WHEN vec_id % 7 = 0 THEN '__ERROR__: image_open_failed' WHEN bright > 100 THEN 'Yes.' ELSE 'No.' END AS reply FROM m""")
def image_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model of brightness asked about each image; those that cannot be read get the marker, and their batches go on."""
    bright = lambda: lambda images: ["Yes." if x.mean() > 100 else "No." for x in images]
    return media.reply_to_images(made_images(spark, sf_dir).select("image", "content"), bright)


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 4 THEN 0 WHEN doc_id % 5 = 3 THEN n_chars * 1000000 / 90000 ELSE n_chars / 1000 END::DOUBLE AS seconds FROM documents")
def movie_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MP4 heads of documents: headers of both versions, after boxes of 32 and 64 bits; every fifth is cut off."""
    number = lambda c, size: F.lpad(F.hex(c.cast("long")), 2 * size, "0")
    box = lambda kind, body: F.concat(number(F.length(body) / 2 + 8, 4), F.hex(F.lit(kind)), body)
    wide = F.col("doc_id") % 5 == 3
    short = F.concat(F.lit("00000000" + "0" * 16), number(F.lit(1000), 4), number(F.col("n_chars"), 4))
    long = F.concat(F.lit("01000000" + "0" * 32), number(F.lit(90_000), 4), number(F.col("n_chars") * 1_000_000, 8))
    free = F.concat(F.lit("00000001"), F.hex(F.lit("free")), number(F.lit(20), 8), F.lit("00000000"))
    whole = F.concat(box("ftyp", F.hex(F.lit("isom0000"))), F.when(F.col("doc_id") % 2 == 0, free).otherwise(""), box("moov", F.concat(box("udta", F.lit("00")), box("mvhd", F.concat(F.when(wide, long).otherwise(short), F.lit("00" * 80))))))
    cut = F.when(F.col("doc_id") % 5 == 4, F.substring(whole, F.lit(1), F.length(whole) - 170)).otherwise(whole)
    return read(spark, sf_dir, "documents").select("doc_id", media.seconds_of(F.unhex(cut)).alias("seconds"))


@query(f"""WITH {FRAMES}, {ANSWERS}, r AS (SELECT *, {YES_NO.format(guard=GUARD)} AS pred, CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN upper(layout) ELSE concat('grid ', layout) END AS said FROM a)
SELECT doc_id, to_json({{'ground_truth': {{'classification': gt, 'layout_category': layout, 'enriched_summary': concat('s', doc_id)}}, 'model_outputs': {{'classify': {{'prompt': 'Is it?', 'reply': reply, 'parsed_sludge': pred, 'hit': pred = gt}},
 'layout': {{'prompt': 'Which?', 'reply': said, 'hit': CASE WHEN layout <> '' AND said <> '' THEN contains(lower(layout), lower(said)) OR contains(lower(said), lower(layout)) END}},
 'describe': {{'prompt': 'What?', 'reply': 'd'}}, 'explain': {{'prompt': CASE WHEN gt THEN 'Why?' END, 'reply': 'e'}}}}}})::VARCHAR AS record FROM r""")
def evaluation_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested records of an evaluation, as JSON."""
    said = F.expr("CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN upper(layout) ELSE concat('grid ', layout) END")
    made = {"batch": F.lit("b"), "summary": F.expr("concat('s', doc_id)"), "classify": F.col("reply"), "layout_reply": said, "describe": F.lit("d"), "explain": F.lit("e"), "explain_prompt": F.when(F.col("gt"), "Why?"), "frame_path": F.col("doc_id")}
    x = labels.evaluation_rows(frames(spark, sf_dir).withColumns(made), {"classify": "Is it?", "layout": "Which?", "describe": "What?"})
    return x.select(F.col("frame_path").alias("doc_id"), F.to_json(F.struct("ground_truth", "model_outputs"), {"ignoreNullFields": "false"}).alias("record"))


@query(f"""WITH x AS (SELECT doc_id, doc_id // 16 AS batch_id, list_concat(CASE WHEN doc_id % 3 = 0 THEN [17, -200] ELSE [] END, [length(w)::BIGINT for w in string_split(concat(CASE WHEN doc_id % 3 = 0 THEN '' ELSE concat('<|im_start|>user', chr(10), '<image>') END, chr(10), text, '<|im_end|>', chr(10), '<|im_start|>assistant', chr(10)), ' ') if w <> '']) AS ids FROM documents),
y AS (SELECT *, max(len(ids)) OVER (PARTITION BY batch_id) AS n FROM x)
SELECT doc_id, batch_id, n::INTEGER AS batch_len, {_flat('list_concat([0 for i in range(n - len(ids))], ids)')} AS ids, {_flat('list_concat([0 for i in range(n - len(ids))], [1 for i in ids])')} AS mask, {_flat('[-100 for i in range(n)]')} AS labels FROM y""")
def generation_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts of whole documents in batches, padded at the left; every third has an image, elsewhere the mark is text."""
    prompt = Q.render_prompt(F.concat(F.lit("<image>\n"), F.col("text")))
    ids, mask, none = Q.prompt_inputs(prompt, F.col("doc_id") % 3 == 0, Q.split_tokens)
    x = read(spark, sf_dir, "documents").select("doc_id", ids.alias("input_ids"), mask.alias("attention_mask"), none.alias("labels"))
    x = batches.left_padded(batches.with_batch(x, 16, "doc_id"), "batch_id", 0)
    return x.select("doc_id", "batch_id", "batch_len", flat("input_ids").alias("ids"), flat("attention_mask").alias("mask"), flat("labels").alias("labels"))


@query(f"WITH {FRAMES} SELECT doc_id, split, {JUDGE} AS judge_sludge FROM f WHERE split = 'test' AND {JUDGE} <> ''")
def judged_test_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frames(spark, sf_dir).select("doc_id", F.col("split").alias("split_source"), F.expr(JUDGE).alias("judge_sludge"))
    return labels.judged_of(rows).withColumnRenamed("split_source", "split")
