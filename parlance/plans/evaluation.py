"""More registered queries: losses, generation accounting, run statistics, batches and collation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from parlance.functions import media, metrics
from parlance.functions.tokens import Chars
from parlance.operators import align, collate, encode, mix, validate
from parlance.plans.queries import ORDERED_SQL, SCORES_SQL, lot_sql, padded, query, scores, table
from parlance.schema import IMAGE, USER, message, messages
from parlance.sources.readers import with_order


def _pairs(spark, sf_dir):
    """Two log-probabilities per row."""
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", (-F.abs(F.col("embedding")[0].cast("double")) - 0.01).alias("c"), (-F.abs(F.col("embedding")[1].cast("double")) - 0.01).alias("r"), F.col("embedding")[2].cast("double").alias("rc"), F.col("embedding")[3].cast("double").alias("rr"))


_PAIRS = "WITH e AS (SELECT vec_id, -abs(embedding[1]::DOUBLE) - 0.01 AS c, -abs(embedding[2]::DOUBLE) - 0.01 AS r, embedding[3]::DOUBLE AS rc, embedding[4]::DOUBLE AS rr FROM embeddings)"


@query(_PAIRS + ", o AS (SELECT *, (c - r) - (ln(1 - exp(c)) - ln(1 - exp(r))) AS odds, 0.1 * ((c - r) - (rc - rr)) AS x FROM e) SELECT round(avg(-c + 0.1 * (ln(1 + exp(-abs(odds))) - least(odds, 0))), 9) AS odds_ratio, round(avg(ln(1 + exp(-abs(x))) - least(x, 0)), 9) AS sigmoid, round(avg((ln(1 + exp(-abs(x))) - least(x, 0) + 0.5 * c) / 1.5), 9) AS combined FROM o")
def preference_losses(spark, sf_dir):
    """Odds-ratio, sigmoid and combined losses."""
    c, r = F.col("c"), F.col("r")
    sig = metrics.sigmoid_loss(c, r, F.col("rc"), F.col("rr"), 0.1)
    return _pairs(spark, sf_dir).agg(F.round(F.avg(metrics.odds_ratio_loss(c, r, 0.1)), 9).alias("odds_ratio"), F.round(F.avg(sig), 9).alias("sigmoid"), F.round(F.avg(metrics.combined(sig, c, 0.5)), 9).alias("combined"))


@query(_PAIRS + ", b AS (SELECT *, vec_id // 50 AS b FROM e), s AS (SELECT b, sum(sum(c + r)) OVER (ORDER BY b) / sum(2 * count(*)) OVER (ORDER BY b) AS base FROM b GROUP BY b), l AS (SELECT c - base AS x, -(r - base) AS y FROM b JOIN s USING (b)) SELECT round(avg(ln(1 + exp(-abs(x))) - least(x, 0) + ln(1 + exp(-abs(y))) - least(y, 0)), 9) AS loss FROM l")
def bco_loss(spark, sf_dir):
    """Loss against the running mean reward."""
    df = _pairs(spark, sf_dir).withColumn("batch_id", F.floor(F.col("vec_id") / 50))
    return metrics.bco_loss(df, "c", "r").agg(F.round(F.avg("loss"), 9).alias("loss"))


@query(_PAIRS + ", t AS (SELECT c, r, vec_id % 3 = 0 AS tag FROM e) SELECT round(sum(c) FILTER (WHERE tag) / count(*) FILTER (WHERE tag), 9) AS reward_chosen, round(sum(c) FILTER (WHERE NOT tag) / count(*) FILTER (WHERE NOT tag), 9) AS reward_rejected, round(sum(r) FILTER (WHERE tag) / count(*) FILTER (WHERE tag), 9) AS logp_chosen, round(sum(c) FILTER (WHERE tag) / count(*) FILTER (WHERE tag) - sum(c) FILTER (WHERE NOT tag) / count(*) FILTER (WHERE NOT tag), 9) AS margin FROM t")
def feedback_metrics(spark, sf_dir):
    """Per-class ratios after reduction."""
    m = metrics.feedback_summary(_pairs(spark, sf_dir).select(F.col("c").alias("reward"), F.col("r").alias("logp"), (F.col("vec_id") % 3 == 0).alias("tag")))
    return m.select(*[F.round(x, 9).alias(x) for x in ("reward_chosen", "reward_rejected", "logp_chosen", "margin")])


@query("""
WITH t AS (SELECT vec_id, generate_subscripts(embedding, 1) AS i, -abs(unnest(embedding)::DOUBLE) AS v FROM embeddings)
SELECT vec_id, round(sum(v) FILTER (WHERE i < (SELECT max(i) FROM t) AND (i + 1) % 3 <> 0), 6) AS total, round(avg(v) FILTER (WHERE i < (SELECT max(i) FROM t) AND (i + 1) % 3 <> 0), 6) AS mean FROM t GROUP BY vec_id
""")
def sequence_logps(spark, sf_dir):
    """Shifted, masked sums and means of token log-probabilities."""
    e = table(spark, sf_dir, "embeddings")
    v = F.transform("embedding", lambda x: -F.abs(x.cast("double")))
    y = F.transform("embedding", lambda x, i: F.when((i + 1) % 3 == 0, -100).otherwise(1))
    total = metrics.masked_sum(v, y)
    return e.select("vec_id", F.round(total, 6).alias("total"), F.round(total / metrics.counted(y), 6).alias("mean"))


@query("""
WITH t AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings), k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC) AS rank FROM t), z AS (SELECT vec_id, ln(sum(exp(v))) AS z FROM k WHERE rank <= 20 GROUP BY vec_id),
a AS (SELECT vec_id, ln(sum(exp(v))) - max(v) FILTER (WHERE i = 1) AS nll FROM t GROUP BY vec_id), h AS (SELECT vec_id, -sum(exp(v - z) * (v - z)) / 3.0 AS h FROM k JOIN z USING (vec_id) WHERE rank <= 20 GROUP BY vec_id)
SELECT round(avg(nll), 6) AS nll, round(avg(nll * exp(-nll)), 6) AS dft, round(avg(nll * h), 6) AS eaft FROM a JOIN h USING (vec_id)
""")
def token_losses(spark, sf_dir):
    """Cross-entropy and its re-weighted forms from logits."""
    z = F.transform("embedding", lambda x: x.cast("double"))
    e = table(spark, sf_dir, "embeddings").select(z.alias("z")).withColumn("n", metrics.nll(F.col("z"), F.lit(0)))
    return e.agg(F.round(F.avg("n"), 6).alias("nll"), F.round(F.avg(metrics.dft_weight(F.col("n"))), 6).alias("dft"), F.round(F.avg(metrics.eaft_weight(F.col("n"), F.col("z"))), 6).alias("eaft"))


@query("SELECT vec_id, ['A', 'B', 'C', 'D'][list_position(embedding[1:4], list_max(embedding[1:4]))] AS choice FROM embeddings")
def choice_prediction(spark, sf_dir):
    """Letter of the largest of four logits."""
    return table(spark, sf_dir, "embeddings").select("vec_id", metrics.predicted_choice(F.slice("embedding", 1, 4)).alias("choice"))


@query(SCORES_SQL + "SELECT kind, id FROM (SELECT doc_id AS id, CASE WHEN y = 1 AND p < 0.3 THEN 'fn' WHEN y = 0 AND p >= 0.3 THEN 'fp' END AS kind FROM s) WHERE kind IS NOT NULL")
def mistakes(spark, sf_dir):
    """False negatives and positives at a threshold."""
    df = scores(spark, sf_dir).withColumnRenamed("doc_id", "id")
    return metrics.mistakes(df, 0.3, df.count(), 1).select("kind", "id")


@query("SELECT doc_id, CASE lang WHEN 'en' THEN 1 WHEN 'fr' THEN 0 ELSE 7 END AS y FROM documents")
def label_normalisation(spark, sf_dir):
    """Two class texts or an integer."""
    raw = F.when(F.col("lang").isin("en", "fr"), F.col("lang")).otherwise("7")
    return table(spark, sf_dir, "documents").select("doc_id", metrics.normal_label(raw, "fr", "en").alias("y"))


@query("SELECT CAST(count(*) FILTER (WHERE doc_id % 5 IN (0, 1, 2)) AS BIGINT) AS invalid, CAST(count(*) FILTER (WHERE doc_id % 5 IN (3, 4)) AS BIGINT) AS valid FROM documents")
def invalid_logits(spark, sf_dir):
    """Empty, incomplete and non-number logits."""
    d = table(spark, sf_dir, "documents")
    m = F.when(F.col("doc_id") % 5 == 0, F.create_map().cast("map<string,double>")).when(F.col("doc_id") % 5 == 1, F.create_map(F.lit("a"), F.lit(1.0))).when(F.col("doc_id") % 5 == 2, F.create_map(F.lit("a"), F.lit(float("nan")), F.lit("b"), F.lit(1.0))).otherwise(F.create_map(F.lit("a"), F.lit(0.0), F.lit("b"), F.lit(1.0)))
    bad = metrics.invalid(m, ("a", "b"))
    return d.agg(F.count_if(bad).alias("invalid"), F.count_if(~bad).alias("valid"))


@query("SELECT vec_id, CAST(2 AS INT) AS place, CASE WHEN vec_id % 3 = 0 THEN 0 WHEN vec_id % 3 = 1 THEN 1 ELSE -1 END AS y FROM embeddings")
def answer_class(spark, sf_dir):
    """Answer place and class from labels."""
    y = F.array(F.lit(-100), F.lit(-100), (F.col("vec_id") % 3).cast("int") + 50, F.lit(2))
    return table(spark, sf_dir, "embeddings").select("vec_id", metrics.answer_place(y).alias("place"), F.coalesce(metrics.answer_class(y, 50, 51), F.lit(-1)).alias("y"))


@query("SELECT conv_id, turn, CAST(CASE WHEN position('e' IN text) > 0 THEN position('e' IN text) ELSE length(text) END AS INT) AS length, CASE WHEN position('e' IN text) > 0 THEN 'stop' ELSE 'length' END AS reason FROM conversations")
def generation_accounting(spark, sf_dir):
    """Response length to the first end, and why it ended."""
    ids = Chars().encode(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", metrics.finished(ids, ord("e") + 3).alias("f")).select("conv_id", "turn", "f.length", "f.reason")


@query("SELECT vec_id, CAST(embedding[vec_id % 8 + 1] AS DOUBLE) AS score FROM embeddings")
def last_scores(spark, sf_dir):
    """The value at the last seen position."""
    seen = F.array_repeat(F.lit(1), (F.col("vec_id") % 8 + 1).cast("int"))
    return table(spark, sf_dir, "embeddings").select("vec_id", metrics.last_score(F.col("embedding"), seen).cast("double").alias("score"))


@query("WITH l AS (SELECT max(event_id) AS n FROM events) SELECT CAST(n AS BIGINT) AS current_steps, CAST(n * 2 AS BIGINT) AS total_steps, 50.0::DOUBLE AS percentage, CAST(n AS DOUBLE) AS remaining FROM l")
def run_progress(spark, sf_dir):
    """Latest line of the whole log, percentage and time left."""
    e = table(spark, sf_dir, "events")
    top = e.agg(F.max("event_id").alias("m"))
    log = e.select(F.col("event_id").alias("current_steps"), F.col("event_id").cast("double").alias("elapsed")).crossJoin(F.broadcast(top)).withColumn("total_steps", F.col("m") * 2)
    return metrics.latest_progress(log).select("current_steps", "total_steps", "percentage", "remaining")


@query("""
WITH o AS (SELECT (row_number() OVER (ORDER BY doc_id) - 1) // 8 AS b, length(text) AS n FROM documents), r AS (SELECT sum(n)::DOUBLE / sum(w) AS ratio FROM (SELECT n, max(n) OVER (PARTITION BY b) AS w FROM o))
SELECT round(ratio, 9) AS valid_ratio, round(3e-4 * sqrt(2048 * ratio / 4000000), 12) AS lr FROM r
""")
def learning_rate(spark, sf_dir):
    """Learning rate by the share of valid tokens in padded batches of whole texts."""
    return metrics.learning_rate(padded(spark, sf_dir, 8, 1), 256, 8).select(F.round("valid_ratio", 9).alias("valid_ratio"), F.round("lr", 12).alias("lr"))


@query("SELECT round(sum(n_chars) * 3.0 / 60.0 / 8, 6)::DOUBLE AS tokens_per_second FROM documents")
def tokens_per_second(spark, sf_dir):
    """Effective tokens a second."""
    return metrics.tokens_per_second(table(spark, sf_dir, "documents"), "n_chars", 3.0, 60.0, 8).select(F.round("tokens_per_second", 6).alias("tokens_per_second"))


@query("SELECT n_nationkey, 3 * ((1 + n_nationkey) * 128 * 4 * (6 * 256 * 512 + 4 * 256 * 256 + 2 * floor(2 * 256 * 256 * 2 / 8)) + (1 + n_nationkey) * 4 * 4 * 256 * 128 * 128)::DOUBLE + 3 * ((1 + n_nationkey) * 128 * 256 * 1000 * 2)::DOUBLE AS flops FROM nation")
def model_flops(spark, sf_dir):
    """Operations of a training pass."""
    n = table(spark, sf_dir, "nation")
    sizes = [F.lit(x) for x in (128, 256, 1000, 512, 8, 2, 4)]
    return n.select("n_nationkey", metrics.model_flops(F.col("n_nationkey") + 1, *sizes, F.lit(False)).alias("flops"))


@query("SELECT event_type, CAST(CAST(floor(sum(value) / 3600) AS BIGINT) AS VARCHAR) || ':' || lpad(CAST(floor(sum(value) % 3600 / 60) AS INT)::VARCHAR, 2, '0') || ':' || lpad(CAST(floor(sum(value) % 60) AS INT)::VARCHAR, 2, '0') AS t FROM (SELECT event_type, floor(avg(value) * 100) AS value FROM events GROUP BY 1) GROUP BY event_type")
def duration_text(spark, sf_dir):
    """Durations as h:mm:ss."""
    e = table(spark, sf_dir, "events").groupBy("event_type").agg(F.floor(F.avg("value") * 100).alias("s"))
    return e.select("event_type", metrics.duration(F.col("s")).alias("t"))


# Collation.


@query("SELECT conv_id, CAST(turn AS BIGINT) AS turn, CAST(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS cumulative FROM conversations WHERE length(text) > 0")
def cumulative_lengths(spark, sf_dir):
    """Cumulative sub-sequence ends of packed rows."""
    c = table(spark, sf_dir, "conversations").where(F.length("text") > 0)
    by = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return c.select("conv_id", "turn", F.sum(F.length("text").cast("bigint")).over(by).alias("cumulative"))


@query("""
WITH m AS (SELECT conv_id, sum(1) AS n, count(*) FILTER (WHERE role = 'user') AS a FROM conversations GROUP BY conv_id)
SELECT conv_id, CAST(n + 2 AS INT) AS width, CAST(a * (a + 1) // 2 + (n - a) * (n - a + 1) // 2 AS INT) AS visible FROM m
""")
def block_masks(spark, sf_dir):
    """Block-diagonal causal masks: a segment of as many places as user turns, one of the others, two of padding."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").cast("int").alias("n"), F.count_if(F.col("role") == "user").cast("int").alias("a"))
    seg = F.concat(F.array_repeat(F.lit(1), F.col("a")), F.array_repeat(F.lit(2), F.col("n") - F.col("a")), F.array_repeat(F.lit(0), 2))
    m = c.select("conv_id", collate.block_mask(seg, 1.0, 0.0).alias("m"))
    return m.select("conv_id", F.size("m").alias("width"), F.aggregate(F.flatten("m"), F.lit(0.0), lambda a, x: a + x).cast("int").alias("visible"))


@query("SELECT doc_id, md5(text) AS kept FROM documents")
def unpadded(spark, sf_dir):
    """Padding removed by mask, whole texts kept."""
    ids = Chars().encode(F.col("text"))
    row, seen = F.concat(ids, F.array_repeat(F.lit(0), 5)), F.concat(F.array_repeat(F.lit(1), F.length("text")), F.array_repeat(F.lit(0), 5))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(Chars().decode(collate.unpad(row, seen))).alias("kept"))


@query("SELECT vec_id, side, CAST(2 + side AS INT) AS n FROM embeddings, range(2) r(side)")
def stacked_pairs(spark, sf_dir):
    """Chosen rows, then rejected ones."""
    e = table(spark, sf_dir, "embeddings")
    for side, n in (("chosen", 2), ("rejected", 3)):
        for c in collate.PADDING:
            e = e.withColumn(f"{side}_{c}", F.array_repeat(F.lit(1), n))
    return collate.stack_pairs(e.select("vec_id", *[f"{s}_{c}" for s in ("chosen", "rejected") for c in collate.PADDING])).select("vec_id", F.col("side").cast("bigint").alias("side"), F.size("input_ids").alias("n"))


@query("WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents) SELECT CAST(i // 10 AS BIGINT) AS batch_id, CAST(sum(doc_id % 3) AS INT) AS n_images, string_agg(CAST(doc_id % 3 AS VARCHAR), ',' ORDER BY i) AS counts FROM o GROUP BY i // 10")
def flattened_media(spark, sf_dir):
    """Media of a batch end to end with each row's count."""
    d = with_order(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"])
    none = F.lit(None).cast("array<string>")
    d = d.withColumn("_images", F.when(F.col("doc_id") % 3 > 0, F.array_repeat(F.lit("x"), (F.col("doc_id") % 3).cast("int")))).withColumn("_videos", none).withColumn("_audios", none)
    return collate.flatten_media(d, 10).select("batch_id", F.size("images").alias("n_images"), F.array_join(F.transform("images_counts", lambda x: x.cast("string")), ",").alias("counts"))


@query("SELECT doc_id, CAST(least(n, 40) + CASE WHEN n > 40 THEN 0 ELSE 40 - n END AS INT) AS width FROM (SELECT doc_id, length(text) AS n FROM documents)")
def fitted(spark, sf_dir):
    """Arrays cut and padded to a width."""
    ids = Chars().encode(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(collate.fit(ids, "input_ids", 40, F.lit(100_000))).alias("width"))


@query("SELECT doc_id, CAST(least(greatest(90 - t, 0), 60) AS INT) AS prompt_kept, CAST(least(t, 20 + doc_id % 50) AS INT) AS chosen_kept FROM (SELECT doc_id, least(CASE WHEN m * 2 < 90 THEN 90 WHEN 60 * 2 < 90 THEN 30 ELSE floor(90 * (m::DOUBLE / (60 + m)))::INT END, m) AS t FROM (SELECT doc_id, greatest(20 + doc_id % 50, 30) AS m FROM documents))")
def pairwise_lengths(spark, sf_dir):
    """A shared prompt and the budget of the longer answer."""
    rep = lambda n: F.array_repeat(F.lit(5), n)
    d = table(spark, sf_dir, "documents").withColumn("c", rep((20 + F.col("doc_id") % 50).cast("int")))
    x = encode.pairwise(rep(F.lit(60)), F.col("c"), rep(F.lit(30)), 90)
    kept = F.size(F.filter("x.chosen_labels", lambda y: y == -100))
    return d.select("doc_id", x.alias("x")).select("doc_id", kept.alias("prompt_kept"), (F.size("x.chosen_input_ids") - kept).alias("chosen_kept"))


@query("SELECT CAST(count(*) FILTER (WHERE doc_id % 7 <> 0) AS BIGINT) AS desirable, CAST(count(*) FILTER (WHERE doc_id % 7 = 0) AS BIGINT) AS undesirable FROM documents")
def one_class_counts(spark, sf_dir):
    """Counts of desirable and undesirable rows."""
    response = messages(message("assistant", F.when(F.col("doc_id") % 7 == 0, "").otherwise("x")))
    return table(spark, sf_dir, "documents").agg(*encode.one_class(response))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'm/' || lang || '.png' ELSE lang || '.png' END AS path FROM documents")
def media_paths(spark, sf_dir):
    """Paths under the media folder where the file exists."""
    known = F.when(F.col("doc_id") % 2 == 0, F.array(F.concat(F.lit("m/"), F.col("lang"), F.lit(".png")))).otherwise(F.array().cast("array<string>"))
    paths = F.array(F.concat("lang", F.lit(".png")))
    return table(spark, sf_dir, "documents").select("doc_id", align.resolve_media(paths, "m", known)[0].alias("path"))


@query("SELECT doc_id, CASE WHEN position('<image>' IN t) > 0 THEN t ELSE '<image><image>' || t END AS text FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN lang || '<image>' ELSE lang END AS t FROM documents)")
def prepended_marks(spark, sf_dir):
    """Marks before the first message where media come without any."""
    m = messages(message(USER, F.concat("lang", F.when(F.col("doc_id") % 2 == 0, IMAGE).otherwise(""))))
    return table(spark, sf_dir, "documents").select("doc_id", validate.prepend_placeholders(m, F.array(F.lit("a"), F.lit("b")))[0]["content"].alias("text"))


@query("SELECT doc_id, CAST((h // 14) * (w // 14) + 1 AS BIGINT) AS patches, CAST(((mel - 1) // 2 + 1 - 2) // 2 + 1 AS BIGINT) AS audio, lpad(CAST(mel // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(mel % 60 AS VARCHAR), 2, '0') AS clock FROM (SELECT doc_id, 100 + doc_id % 900 AS h, 120 + doc_id * 3 % 700 AS w, 10 + doc_id % 3000 AS mel FROM documents)")
def media_counts(spark, sf_dir):
    """Patch, audio and time arithmetic."""
    d = table(spark, sf_dir, "documents").select("doc_id", (100 + F.col("doc_id") % 900).alias("h"), (120 + F.col("doc_id") * 3 % 700).alias("w"), (10 + F.col("doc_id") % 3000).alias("mel"))
    return d.select("doc_id", media.patch_tokens(F.col("h"), F.col("w"), 14, 1).alias("patches"), media.audio_tokens_strided(F.col("mel")).alias("audio"), media.clock(F.col("mel")).alias("clock"))


@query("SELECT c_custkey, CAST(row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) - 1 AS BIGINT) AS pos FROM customer")
def largest_first(spark, sf_dir):
    """Stable order by size, largest first (O1)."""
    c = table(spark, sf_dir, "customer").select("c_custkey", (-F.col("c_acctbal")).alias("k"))
    return with_order(c, ["k", "c_custkey"]).select("c_custkey", F.col("_ord").alias("pos"))


@query(ORDERED_SQL + f" SELECT doc_id, CAST(p % 4 AS INT) AS rank, CAST(p // 4 AS BIGINT) AS step FROM (SELECT doc_id, n, row_number() OVER (ORDER BY {lot_sql(3, 'o')}, o) - 1 AS p FROM d) WHERE p < n // 4 * 4")
def epoch_shards(spark, sf_dir):
    """An epoch's permutation dealt to ranks, the incomplete tail dropped."""
    d = with_order(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"])
    return mix.epoch_order(d, 1, 2, 4).select("doc_id", "rank", "step")
