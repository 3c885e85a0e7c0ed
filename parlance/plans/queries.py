"""Registered queries over the driver's tables, with the DuckDB SQL that each must agree with.

Conversations stand for chat sources, documents for texts and instruction rows, labels for ground truth, embeddings for logits, events for logs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parlance.functions import media, metrics, rendering, templates, toolcalls
from parlance.functions.tokens import Chars
from parlance.operators import align, collate, encode, mix, requests, validate
from parlance.schema import USER, message, messages
from parlance.sources import sinks
from parlance.sources.catalog import SourceSpec

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
CHAT = SourceSpec("chat", formatting="sharegpt", messages="messages", role_tag="role", content_tag="text", user_tag="user", assistant_tag="assistant", system_tag="system", observation_tag="tool", function_tag="call")


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, messages in turn order."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(turns.alias("messages"))


def aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align(chats(spark, sf_dir), CHAT, ("conv_id",))


# SQL shared by the chat oracles: dialogues without a leading system turn, with their parity.
CHAT_SQL = """
WITH firsts AS (SELECT conv_id, min(turn) AS first_turn FROM conversations GROUP BY conv_id),
m AS (
  SELECT c.conv_id, c.turn, c.role, c.text, row_number() OVER (PARTITION BY c.conv_id ORDER BY c.turn) - 1 AS i, count(*) OVER (PARTITION BY c.conv_id) AS n
  FROM conversations c JOIN firsts f USING (conv_id) WHERE NOT (c.turn = f.first_turn AND c.role = 'system')
),
sys AS (SELECT c.conv_id, max(CASE WHEN c.turn = f.first_turn AND c.role = 'system' THEN c.text END) AS system FROM conversations c JOIN firsts f USING (conv_id) GROUP BY c.conv_id),
ok AS (
  SELECT s.conv_id, coalesce(s.system, '') AS system, coalesce(v.n, 0) AS n, coalesce(v.good, TRUE) AND coalesce(v.n, 0) % 2 = 0 AS good
  FROM sys s LEFT JOIN (SELECT conv_id, max(n) AS n, bool_and(role = CASE WHEN i % 2 = 0 THEN 'user' ELSE 'assistant' END) AS good FROM m GROUP BY conv_id) v USING (conv_id)
)
"""


@query(CHAT_SQL + """SELECT o.conv_id, o.system, CAST(CASE WHEN good AND o.n > 0 THEN o.n - 1 ELSE 0 END AS INT) AS n_prompt, CAST(CASE WHEN good AND o.n > 0 THEN 1 ELSE 0 END AS INT) AS n_response,
  CASE WHEN good THEN (SELECT min_by(text, i) FROM m WHERE m.conv_id = o.conv_id AND m.i < o.n - 1) END AS first_text, CASE WHEN good THEN (SELECT max_by(text, i) FROM m WHERE m.conv_id = o.conv_id) END AS last_text FROM ok o""")
def align_sharegpt(spark, sf_dir):
    """System extraction, alternation and parity, prompt and response."""
    at = lambda c, i: F.try_element_at(F.col(c), F.lit(i))["content"]
    return aligned(spark, sf_dir).select("conv_id", F.col("_system").alias("system"), F.size("_prompt").alias("n_prompt"), F.size("_response").alias("n_response"), at("_prompt", 1).alias("first_text"), at("_response", 1).alias("last_text"))


@query(CHAT_SQL + "SELECT conv_id, good FROM ok WHERE NOT good")
def invalid_conversations(spark, sf_dir):
    """Dialogues that break alternation or parity."""
    return aligned(spark, sf_dir).where((F.size("_prompt") == 0) & (F.size("_response") == 0)).join(chats(spark, sf_dir).where(F.size(F.filter("messages", lambda m: m["role"] != "system")) > 0).select("conv_id"), "conv_id").select("conv_id", F.lit(False).alias("good"))


@query(CHAT_SQL + "SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(count(*) FILTER (WHERE good AND n > 0) AS BIGINT) AS supervised, CAST(0 AS BIGINT) AS pairwise, CAST(count(*) FILTER (WHERE good AND n > 0) AS BIGINT) AS unsupervised FROM ok")
def stage_filter_counts(spark, sf_dir):
    """Rows that each stage keeps."""
    return aligned(spark, sf_dir).agg(F.count("*").alias("n_rows"), *[F.count_if(validate.usable(s)).alias(s) for s in ("supervised", "pairwise", "unsupervised")])


def instructions(spark, sf_dir) -> DataFrame:
    """Documents as instruction rows."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return d.select("doc_id", F.substring("text", 1, 40).alias("instruction"), F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.substring("text", 41, 60)).alias("input"), F.when(F.col("doc_id") % 7 != 0, F.expr("substring(text, 101)")).alias("output"), (F.col("quality") == 1).alias("tag"))


INSTRUCTIONS_SQL = """
WITH a AS (
  SELECT d.doc_id, substr(text, 1, 40) AS instruction, CASE WHEN d.doc_id % 3 = 0 THEN '' ELSE substr(text, 41, 60) END AS input, CASE WHEN d.doc_id % 7 <> 0 THEN substr(text, 101) END AS output, quality = 1 AS tag
  FROM documents d LEFT JOIN labels USING (doc_id)
)
"""


@query(INSTRUCTIONS_SQL + "SELECT doc_id, concat_ws(chr(10), nullif(instruction, ''), nullif(input, '')) AS prompt, CAST(CASE WHEN output IS NULL THEN 0 ELSE 1 END AS INT) AS n_response, output AS response FROM a")
def align_alpaca(spark, sf_dir):
    """Instruction rows to one user turn and an optional answer."""
    rows = align.align(instructions(spark, sf_dir), SourceSpec("docs"), ("doc_id",))
    return rows.select("doc_id", F.col("_prompt")[0]["content"].alias("prompt"), F.size("_response").alias("n_response"), F.get("_response", F.lit(0))["content"].alias("response"))


@query(INSTRUCTIONS_SQL + "SELECT doc_id, CASE WHEN tag IS NULL THEN output WHEN tag THEN output ELSE '' END AS first_answer, CASE WHEN tag THEN '' WHEN NOT tag THEN output END AS second_answer FROM a")
def align_kto_pair(spark, sf_dir):
    """Boolean tags to a preferred and an empty answer (A4)."""
    rows = align.align(instructions(spark, sf_dir), SourceSpec("docs", kto_tag="tag"), ("doc_id",))
    return rows.select("doc_id", *[F.get("_response", F.lit(k))["content"].alias(n) for k, n in enumerate(("first_answer", "second_answer"))])


@query(INSTRUCTIONS_SQL + "SELECT doc_id, CASE WHEN output IS NULL THEN NULL ELSE output END AS chosen, CASE WHEN output IS NULL THEN NULL ELSE instruction END AS rejected FROM a")
def align_pairwise(spark, sf_dir):
    """Chosen and rejected answers of a ranking source (A5)."""
    rows = align.align(instructions(spark, sf_dir).withColumnRenamed("output", "chosen").withColumn("rejected", F.col("instruction")), SourceSpec("docs", ranking=True, chosen="chosen", rejected="rejected", response=None), ("doc_id",))
    return rows.select("doc_id", *[F.get("_response", F.lit(k))["content"].alias(n) for k, n in enumerate(("chosen", "rejected"))])


@query("""
WITH e AS (SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN 'observation' ELSE 'user' END AS role, text FROM conversations),
f AS (SELECT *, sum(CASE WHEN role = 'observation' AND prev = 'observation' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM e)),
g AS (SELECT conv_id, run, min(role) AS role, string_agg(text, chr(10) || '</tool_response>' || chr(10) || '<tool_response>' || chr(10) ORDER BY turn) AS text, max(turn) AS last FROM f GROUP BY conv_id, run),
h AS (SELECT *, max(last) OVER (PARTITION BY conv_id) AS final FROM g)
SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY run) - 1 AS INT) AS pos, role, text FROM h WHERE NOT (role = 'observation' AND last = final)
""")
def tool_run_merge(spark, sf_dir):
    """Runs of tool results become one turn, one at the end is dropped."""
    role = lambda m: F.when(m["role"] == "assistant", "observation").otherwise("user")
    turns = F.transform("messages", lambda m: message(role(m), m["text"]))
    return chats(spark, sf_dir).select("conv_id", F.posexplode(align.merge_tool_runs(turns)).alias("pos", "m")).select("conv_id", "pos", "m.role", F.col("m.content").alias("text"))


@query("""
SELECT doc_id, CASE WHEN coalesce(s, '') = '' THEN CASE WHEN t = '' THEN 'detailed thinking off' ELSE s END WHEN t <> '' THEN s || chr(10)
  WHEN s LIKE '%detailed thinking o%' THEN s ELSE s || chr(10) || 'detailed thinking off' END AS system
FROM (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '' WHEN doc_id % 4 = 1 THEN 'detailed thinking on' ELSE lang END AS s, CASE WHEN doc_id % 3 = 0 THEN '[]' ELSE '' END AS t FROM documents)
""")
def system_suffix(spark, sf_dir):
    """Thinking marker of system texts."""
    d = table(spark, sf_dir, "documents")
    s = F.when(F.col("doc_id") % 4 == 0, "").when(F.col("doc_id") % 4 == 1, "detailed thinking on").otherwise(F.col("lang"))
    return d.select("doc_id", align.system_suffix(s, F.when(F.col("doc_id") % 3 == 0, "[]").otherwise("")).alias("system"))


@query("""
SELECT doc_id, CAST((length(t) - length(replace(t, 'the', ''))) / 3 AS INT) AS n_marks, (length(t) - length(replace(t, 'the', ''))) / 3 = 2 AS matches FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
""")
def placeholder_counts(spark, sf_dir):
    """Occurrences of a mark against a media list."""
    d = table(spark, sf_dir, "documents").select("doc_id", validate.placeholders(messages(message(USER, F.coalesce("text", F.lit("")))), "the").alias("n_marks"))
    return d.withColumn("matches", F.col("n_marks") == 2)


@query("SELECT doc_id, CAST(CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 0 END + CASE WHEN length(instruction) > 0 OR length(input) > 0 THEN 1 ELSE 0 END + CASE WHEN length(output) > 0 THEN 1 ELSE 0 END - CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END AS INT) AS n_messages, CASE WHEN doc_id % 2 = 0 THEN lang ELSE instruction || input END AS first_text FROM (SELECT doc_id, lang, substr(text, 1, 40) AS instruction, substr(text, 41, 60) AS input, substr(text, 101) AS output FROM documents)")
def align_alpaca_v1(spark, sf_dir):
    """Second-generation instruction rows: joined without a break, weights 0/0/1 (V1)."""
    d = table(spark, sf_dir, "documents")
    m = align.alpaca_v1(F.when(F.col("doc_id") % 2 == 0, F.col("lang")), F.substring("text", 1, 40), F.substring("text", 41, 60), F.expr("substring(text, 101)"))
    return d.select("doc_id", m.alias("m")).select("doc_id", F.size("m").alias("n_messages"), F.col("m")[0]["content"][0]["value"].alias("first_text"))


@query("SELECT conv_id, CAST(count(*) FILTER (WHERE role <> 'system') AS INT) AS n_messages, CAST(count(*) FILTER (WHERE role = 'assistant') AS DOUBLE) AS weight FROM conversations GROUP BY conv_id")
def align_sharegpt_v1(spark, sf_dir):
    """Second-generation dialogues: unknown tags skipped, answers weighted (V2)."""
    tag = lambda m: F.when(m["role"] == "user", "human").when(m["role"] == "assistant", "gpt").otherwise("unknown")
    turns = F.transform("messages", lambda m: F.struct(tag(m).alias("from"), m["text"].alias("value")))
    rows = chats(spark, sf_dir).select("conv_id", align.sharegpt_v1(turns).alias("m"))
    return rows.select("conv_id", F.size("m").alias("n_messages"), F.aggregate("m", F.lit(0.0), lambda a, x: a + x["loss_weight"]).alias("weight"))


@query("SELECT conv_id, max(CASE WHEN i = 0 AND role = 'system' THEN text END) AS system, CAST(count(*) FILTER (WHERE NOT (i = 0 AND role = 'system')) AS INT) AS n_messages FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations) GROUP BY conv_id")
def request_alignment(spark, sf_dir):
    """Chat requests to canonical messages."""
    turns = F.transform("messages", lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content")))
    return chats(spark, sf_dir).select("conv_id", requests.request_messages(turns).alias("r")).select("conv_id", "r.system", F.size("r.messages").alias("n_messages"))


# Mixing, splitting, joins.


def lot_sql(seed: int, *keys: str) -> str:
    """mix.lot in SQL."""
    text = ", ".join(f"coalesce(CAST({k} AS VARCHAR), '')" for k in keys)
    return f"CAST('0x' || substr(md5(concat_ws(':', '{seed}', {text})), 1, 15) AS BIGINT)"


ORDERED_SQL = "WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS o, count(*) OVER () AS n FROM documents)"


def whole(spark, sf_dir) -> DataFrame:
    """All documents as one ordered table."""
    from parlance.sources.readers import with_order

    return with_order(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"])


def all_parts(spark, sf_dir) -> list[DataFrame]:
    """All documents as ordered tables: de, es, fr, and the rest (en, other and null)."""
    from parlance.sources.readers import with_order

    d = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("lang").isin("de", "es", "fr"), F.col("lang")).otherwise("rest").alias("part"))
    return [with_order(d.where(F.col("part") == x).select("doc_id"), ["doc_id"]) for x in ("de", "es", "fr", "rest")]


ALL_PARTS_SQL = """
WITH k AS (SELECT doc_id, CASE lang WHEN 'de' THEN 0 WHEN 'es' THEN 1 WHEN 'fr' THEN 2 ELSE 3 END AS k FROM documents), p AS (SELECT doc_id, k, row_number() OVER (PARTITION BY k ORDER BY doc_id) - 1 AS o, count(*) OVER (PARTITION BY k) AS n FROM k)
"""


@query(ALL_PARTS_SQL + "SELECT doc_id, CAST(row_number() OVER (ORDER BY k, o) - 1 AS BIGINT) AS pos FROM p")
def mix_concat(spark, sf_dir):
    """All documents, table by table."""
    return mix.mix(all_parts(spark, sf_dir)).select("doc_id", F.col("_ord").alias("pos"))


@query(ALL_PARTS_SQL + "SELECT doc_id, CAST(o * 4 + k AS BIGINT) AS pos FROM p WHERE o < (SELECT min(n) FROM p)")
def mix_rr_under(spark, sf_dir):
    """Round robin of all documents until the shortest table ends (M4)."""
    return mix.mix(all_parts(spark, sf_dir), "interleave_under").select("doc_id", F.col("_ord").alias("pos"))


@query(ALL_PARTS_SQL + "SELECT p.doc_id, CAST(i * 4 + k AS BIGINT) AS pos FROM p, range((SELECT max(n) FROM p)) r(i) WHERE i % p.n = p.o")
def mix_rr_over(spark, sf_dir):
    """Round robin of all documents until the longest table ends (M4)."""
    return mix.mix(all_parts(spark, sf_dir), "interleave_over").select("doc_id", F.col("_ord").alias("pos"))


@query(ALL_PARTS_SQL + "SELECT doc_id, CAST(row_number() OVER (ORDER BY o, k) - 1 AS BIGINT) AS pos FROM p")
def mix_rr_once(spark, sf_dir):
    """Round robin of all documents, every row once (M4)."""
    return mix.mix(all_parts(spark, sf_dir), "interleave_once").select("doc_id", F.col("_ord").alias("pos"))


def _weighted_sql(probabilities: list[float], seed: int, first: bool) -> str:
    edges = [sum(probabilities[: k + 1]) / sum(probabilities) for k in range(len(probabilities))]
    turn = "CASE " + " ".join(f"WHEN {lot_sql(seed, 'i')}::DOUBLE / {float(mix.LOTS)!r}::DOUBLE < {e!r}::DOUBLE THEN {k}" for k, e in enumerate(edges[:-1])) + f" ELSE {len(edges) - 1} END"
    return ALL_PARTS_SQL + f""", w AS (SELECT i, t, row_number() OVER (PARTITION BY t ORDER BY i) - 1 AS j FROM (SELECT i, {turn} AS t FROM range((SELECT 12 * count(*) + 1000 FROM documents)) r(i))),
z AS (SELECT {'min' if first else 'max'}(i) AS z FROM w JOIN (SELECT DISTINCT k, n FROM p) ON t = k AND j = n - 1)
SELECT doc_id, CAST(i AS BIGINT) AS pos FROM w JOIN p ON p.k = t AND p.o = j % p.n WHERE i <= (SELECT z FROM z)"""


_SHARES = [0.2, 0.15, 0.15, 0.5]


@query(_weighted_sql(_SHARES, 7, True))
def mix_probabilities(spark, sf_dir):
    """Weighted draws of all documents' tables until one is exhausted (M5)."""
    return mix.mix(all_parts(spark, sf_dir), "interleave_under", _SHARES, 7).select("doc_id", F.col("_ord").alias("pos"))


@query(_weighted_sql(_SHARES, 8, False))
def mix_probabilities_over(spark, sf_dir):
    """Weighted draws until every table is exhausted, shorter ones wrap (M5)."""
    return mix.mix(all_parts(spark, sf_dir), "interleave_over", _SHARES, 8).select("doc_id", F.col("_ord").alias("pos"))


@query(ORDERED_SQL + "SELECT doc_id, CAST(o AS BIGINT) AS pos FROM d WHERE o BETWEEN 20 AND 29")
def max_samples_page(spark, sf_dir):
    """First rows and a page of them."""
    from parlance.sources.readers import page

    return page(mix.first_n(whole(spark, sf_dir), 50), 2, 10).select("doc_id", F.col("_ord").alias("pos"))


@query("SELECT doc_id, CAST((n - 1 - o) / 3 AS BIGINT) AS pos FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS o, count(*) OVER () AS n FROM documents) WHERE (n - 1 - o) % 3 = 0")
def slice_rows(spark, sf_dir):
    """A Python slice of all documents with a negative step."""
    return mix.select_slice(whole(spark, sf_dir), None, None, -3).select("doc_id", F.col("_ord").alias("pos"))


@query(ORDERED_SQL + f""" SELECT doc_id, CAST(row_number() OVER (ORDER BY {lot_sql(3, 'o')}, o) - 1 AS BIGINT) AS pos FROM d
UNION ALL SELECT d.doc_id, CAST(d.n + r.k AS BIGINT) FROM range(50) r(k) JOIN d ON d.o = {lot_sql(4, 'r.k')} % d.n""")
def sample_rows(spark, sf_dir):
    """Sampling beyond a table's size: a permutation, then draws with replacement (M1)."""
    df = whole(spark, sf_dir)
    return mix.sample(df, df.count() + 50, 3).select("doc_id", F.col("_ord").alias("pos"))


@query(ORDERED_SQL + f" SELECT d.doc_id, CAST(r.k AS BIGINT) AS pos FROM range((SELECT CAST(floor(count(*) * 1.5) AS BIGINT) FROM documents)) r(k) JOIN d ON d.o = {lot_sql(4, 'r.k')} % d.n")
def resampled_rows(spark, sf_dir):
    """Weighted resampling with replacement."""
    return mix.resample(whole(spark, sf_dir), None, 1.5, 3).select("doc_id", F.col("_ord").alias("pos"))


@query(ORDERED_SQL + f" SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY {lot_sql(5, 'o')}, o) <= ceil(n * 0.1) THEN 'validation' ELSE 'train' END AS side FROM d")
def holdout_rows(spark, sf_dir):
    """A seeded split of all documents (M7, M9)."""
    made = mix.split(whole(spark, sf_dir), None, 0.1, 5)
    return made.train.select("doc_id", F.lit("train").alias("side")).unionByName(made.eval["validation"].select("doc_id", F.lit("validation").alias("side")))


@query(f"SELECT doc_id, {lot_sql(9, 'doc_id')} % 1000000 < 250000 AS held FROM documents")
def holdout_stream_rows(spark, sf_dir):
    """A split by a hash threshold, as streams have it (M8)."""
    train, held = mix.holdout_stream(table(spark, sf_dir, "documents").select("doc_id"), 0.25, 9, "doc_id")
    return train.withColumn("held", F.lit(False)).unionByName(held.withColumn("held", F.lit(True)))


@query("SELECT user_id, CAST(min(event_id) AS BIGINT) AS first_event, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def merge_dedup_last(spark, sf_dir):
    """Last value wins, first position stays."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    return mix.merge_last(e, "user_id", "event_id").withColumnRenamed("_ord", "first_event")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def resume_antijoin(spark, sf_dir):
    """Tasks that no finished table holds."""
    li = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    return mix.pending(table(spark, sf_dir, "orders").select("o_orderkey"), [li.where("l_returnflag = 'R'"), li.where("l_quantity > 45")], "o_orderkey")


@query("SELECT page_id, regexp_replace(name, '(.)\\.[^.]*$', '\\1') AS stem FROM (SELECT page_id, regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]*)/*$', 1) AS name FROM pages)")
def path_stem(spark, sf_dir):
    """File stems."""
    return table(spark, sf_dir, "pages").select("page_id", mix.stem(F.regexp_replace("url", "[?#].*$", "")).alias("stem"))


@query("SELECT CAST(count(l.doc_id) AS BIGINT) AS scored, CAST(count(*) FILTER (WHERE l.doc_id IS NULL) AS BIGINT) AS missing, CAST(sum(l.quality) AS BIGINT) AS positives FROM documents d LEFT JOIN labels l USING (doc_id)")
def match_truth(spark, sf_dir):
    """Predictions against ground truth, last label wins."""
    truth = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"), F.col("doc_id").alias("_ord"))
    scored, missing = mix.match_truth(table(spark, sf_dir, "documents").select("doc_id"), truth, "doc_id")
    return scored.agg(F.count("*").alias("scored"), F.sum("label").alias("positives")).crossJoin(missing.agg(F.count("*").alias("missing")))


@query("""
WITH RECURSIVE t AS (SELECT id, load, row_number() OVER (ORDER BY load DESC, id) AS k FROM (SELECT c_nationkey AS id, count(*) AS load FROM customer GROUP BY 1)),
r(k, id, load, worker, loads) AS (
  SELECT CAST(0 AS BIGINT), NULL::BIGINT, CAST(0 AS BIGINT), 0::BIGINT, [0, 0, 0, 0]::BIGINT[]
  UNION ALL SELECT t.k, t.id, t.load, list_position(loads, list_min(loads)) - 1, list_transform(loads, lambda x, i: CASE WHEN i = list_position(loads, list_min(loads)) THEN x + t.load ELSE x END) FROM r JOIN t ON t.k = r.k + 1
) SELECT id, CAST(load AS BIGINT) AS load, CAST(worker AS INT) AS worker FROM r WHERE k > 0
""")
def balance_load(spark, sf_dir):
    """Largest task first to the least loaded worker."""
    t = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("id")).agg(F.count("*").alias("load")).withColumn("_ord", F.col("id").cast("bigint"))
    return mix.balance(t, 4).select("id", "load", "worker")


@query(f"""
WITH s AS (SELECT s_nationkey AS subject, s_suppkey AS support_id, row_number() OVER (PARTITION BY s_nationkey ORDER BY {lot_sql(1, 's_suppkey')}, s_suppkey) - 1 AS place, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier),
a AS (SELECT c_custkey AS question_id, c_nationkey AS subject, k, ({lot_sql(2, 'c_custkey')} + k) % n AS place FROM customer JOIN (SELECT DISTINCT subject, n FROM s) ON subject = c_nationkey, range(3) r(k) WHERE k < n)
SELECT question_id, CAST(k AS INT) AS shot, support_id FROM a JOIN s USING (subject, place)""")
def support_shots(spark, sf_dir):
    """Up to n support rows per question of its subject."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("subject"), F.col("s_suppkey").alias("support_id"))
    asks = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("subject"), F.col("c_custkey").alias("question_id"))
    return mix.support_set(asks, s, 3, 1).select("question_id", F.col("shot").cast("int").alias("shot"), "support_id")


# Rendering.


def _rendered(name: str):
    def run(spark, sf_dir):
        rows = validate.stage_filter(aligned(spark, sf_dir), "supervised")
        turn = templates.one_turn(templates.REGISTRY[name], F.concat("_prompt", "_response"), F.col("_system"))
        return rows.select("conv_id", turn.alias("t")).select("conv_id", "t.prompt", "t.response", F.length("t.prompt").alias("n_prompt"))

    run.__name__ = f"render_{name}"
    run.__doc__ = f"Dialogues in the {name} format (T1-T9, E14 lengths)."
    return run


def _render_sql(user: str, assistant: str, system: str, prefix: str = "", default: str = "", first_user: str | None = None) -> str:
    """Prompt and response by slot texts; {0} is the content. first_user: the first turn's format with the system text {1} inside."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    put = lambda s, c: " || ".join(f"{q(a)}" + (f" || {c}" if k == 0 and '{0}' in s else "") for k, a in enumerate(s.split("{0}")))
    sys = f"coalesce(nullif(system, ''), {q(default)})"
    block = f"CASE WHEN {sys} = '' THEN '' ELSE {put(system, sys)} END"
    head = f"CASE WHEN i = 0 THEN {q(prefix)} || {block} ELSE '' END"
    body = put(user, "text")
    if first_user:
        head, body = f"CASE WHEN i = 0 THEN {q(prefix)} ELSE '' END", put(user, f"(CASE WHEN i = 0 THEN {block} ELSE '' END || text)")
    return CHAT_SQL + f""", r AS (SELECT m.conv_id, i, m.n, {head} || CASE WHEN role = 'user' THEN {body} ELSE {put(assistant, 'text')} END AS t FROM m JOIN ok USING (conv_id) WHERE good AND ok.n > 0)
SELECT conv_id, string_agg(t, '' ORDER BY i) FILTER (WHERE i < n - 1) AS prompt, max(t) FILTER (WHERE i = n - 1) AS response, CAST(length(string_agg(t, '' ORDER BY i) FILTER (WHERE i < n - 1)) AS INT) AS n_prompt FROM r GROUP BY conv_id"""


_IM = ("<|im_start|>user\n{0}<|im_end|>\n<|im_start|>assistant\n", "{0}<|im_end|>\n", "<|im_start|>system\n{0}<|im_end|>\n")
_RENDERS = {
    "default": _render_sql("Human: {0}</s>\nAssistant:", "{0}</s>\n", "System: {0}</s>\n"),
    "chatml": _render_sql(*_IM),
    "llama3": _render_sql("<|start_header_id|>user<|end_header_id|>\n\n{0}<|eot_id|><|start_header_id|>assistant<|end_header_id|>\n\n", "{0}<|eot_id|>", "<|start_header_id|>system<|end_header_id|>\n\n{0}<|eot_id|>", "<s>"),
    "llama2": _render_sql("<s>[INST] {0} [/INST]", "{0}</s>", "<<SYS>>\n{0}\n<</SYS>>\n\n", first_user="yes"),
    "qwen": _render_sql(*_IM, default="You are Qwen, created by Alibaba Cloud. You are a helpful assistant."),
    "chatglm3": _render_sql("<|user|>\n{0}<|assistant|>", "\n{0}", "<|system|>\n{0}", "[gMASK]sop"),
    "gemma": _render_sql("<start_of_turn>user\n{0}<end_of_turn>\n<start_of_turn>model\n", "{0}<end_of_turn>\n", "{0}\n\n", "<s>", first_user="yes"),
    "mistral": _render_sql("[INST] {0}[/INST]", " {0}</s>", "{0}\n\n", "<s>", first_user="yes"),
    "vicuna": _render_sql("USER: {0} ASSISTANT:", "{0}</s>", "{0}", default="A chat between a curious user and an artificial intelligence assistant. The assistant gives helpful, detailed, and polite answers to the user's questions."),
    "zephyr": _render_sql("<|user|>\n{0}</s><|assistant|>\n", "{0}</s>", "<|system|>\n{0}</s>", default="You are Zephyr, a helpful assistant."),
    "empty": _render_sql("{0}", "{0}", "{0}"),
}
for _name, _sql in _RENDERS.items():
    query(_sql)(_rendered(_name))


@query(CHAT_SQL + """, r AS (SELECT m.conv_id, i, m.n, CASE WHEN i = 0 AND system <> '' THEN '<|im_start|>system' || chr(10) || system || '<|im_end|>' || chr(10) ELSE '' END ||
  CASE WHEN role = 'user' THEN '<|im_start|>user' || chr(10) || text || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) ELSE text || '<|im_end|>' || chr(10) END AS t FROM m JOIN ok USING (conv_id) WHERE good AND ok.n > 0)
SELECT conv_id, string_agg(t, '' ORDER BY i) FILTER (WHERE i < n - 1) AS prompt, '<think>' || chr(10) || chr(10) || '</think>' || chr(10) || chr(10) || max(t) FILTER (WHERE i = n - 1) AS response FROM r GROUP BY conv_id""")
def render_qwen3_thinking(spark, sf_dir):
    """A reasoning format with the empty thought."""
    rows = validate.stage_filter(aligned(spark, sf_dir), "supervised")
    return rows.select("conv_id", templates.one_turn(templates.REGISTRY["qwen3"], F.concat("_prompt", "_response"), F.col("_system")).alias("t")).select("conv_id", "t.prompt", "t.response")


@query("SELECT doc_id, ltrim(regexp_replace(c, '<think>\\n(.*?)\\n</think>\\n\\n', '', 'gs'), chr(10)) AS bare FROM (SELECT doc_id, chr(10) || '<think>' || chr(10) || text || chr(10) || '</think>' || chr(10) || chr(10) || lang AS c FROM documents)")
def strip_thought(spark, sf_dir):
    """Thought blocks removed."""
    c = F.concat(F.lit("\n<think>\n"), F.col("text"), F.lit("\n</think>\n\n"), F.col("lang"))
    return table(spark, sf_dir, "documents").select("doc_id", templates.strip_thought(templates.REGISTRY["qwen3"], c).alias("bare"))


@query(CHAT_SQL + "SELECT a.conv_id, CAST(a.i // 2 AS INT) AS pair, a.text AS question, b.text AS answer FROM m a JOIN m b ON a.conv_id = b.conv_id AND b.i = a.i + 1 JOIN ok ON ok.conv_id = a.conv_id WHERE good AND a.i % 2 = 0")
def multiturn_pairs(spark, sf_dir):
    """Dialogues as question and answer pairs."""
    rows = validate.stage_filter(aligned(spark, sf_dir), "supervised").withColumn("m", F.concat("_prompt", "_response"))
    pairs = templates.multi_turn(templates.REGISTRY["empty"], F.col("m"))
    return rows.select("conv_id", F.posexplode(pairs).alias("pair", "p")).select("conv_id", "pair", F.col("p.prompt").alias("question"), F.col("p.response").alias("answer"))


@query("SELECT item_id, 'The following are multiple choice questions (with answers) about item' || (item_id % 3) || '.' || chr(10) || chr(10) || text || chr(10) || 'A. ' || text || '!' || chr(10) || 'B. ' || item_id || chr(10) || 'Answer:' AS prompt FROM benchmark")
def mcq_prompt(spark, sf_dir):
    """Multiple-choice prompts."""
    options = {"A": F.concat("text", F.lit("!")), "B": F.col("item_id").cast("string"), "C": F.lit(None).cast("string")}
    subject = F.concat(F.lit("item"), (F.col("item_id") % 3).cast("string"))
    return table(spark, sf_dir, "benchmark").select("item_id", F.concat(metrics.choice_system(subject), metrics.choice_prompt(F.col("text"), options)).alias("prompt"))


@query("SELECT conv_id, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn) AS text, CAST(count(*) FILTER (WHERE role = 'assistant') AS DOUBLE) AS weight FROM conversations GROUP BY conv_id")
def render_chatml_v1(spark, sf_dir):
    """Second-generation segments with weights."""
    typed = F.transform("messages", lambda m: F.struct(m["role"].alias("role"), F.array(F.struct(F.lit("text").alias("type"), m["text"].alias("value"))).alias("content"), F.lit(None).cast("double").alias("loss_weight")))
    rows = chats(spark, sf_dir).select("conv_id", rendering.chatml_segments(typed).alias("s"))
    return rows.select("conv_id", F.array_join(F.transform("s", lambda x: x["text"]), "").alias("text"), F.aggregate("s", F.lit(0.0), lambda a, x: a + x["weight"]).alias("weight"))


@query("SELECT doc_id, lang AS name, '{\"q\": ' || n_chars || '}' AS arguments FROM documents")
def tool_extract(spark, sf_dir):
    """Tool calls read back from text."""
    t = F.concat(F.lit("Action: "), F.col("lang"), F.lit('\nAction Input: {"q": '), F.col("n_chars").cast("string"), F.lit("}"))
    return table(spark, sf_dir, "documents").select("doc_id", toolcalls.extract("default", t).alias("x")).select("doc_id", F.col("x.calls")[0]["name"].alias("name"), F.col("x.calls")[0]["arguments"].alias("arguments"))


# Encoding and batches, with the code-point tokenizer.


@query("""
SELECT doc_id, CAST(least(greatest(128 - t, 0), s) AS INT) AS source_kept, CAST(t AS INT) AS target_kept FROM (
  SELECT doc_id, s, least(CASE WHEN target * 2 < 128 THEN 128 WHEN s * 2 < 128 THEN 128 - s ELSE CAST(floor(128 * (target::DOUBLE / (s + target))) AS INT) END, target) AS t FROM (SELECT doc_id, n_chars AS s, n_chars * (doc_id % 5) // 3 AS target FROM documents))
""")
def seqlen_budget(spark, sf_dir):
    """Lengths kept within a cutoff."""
    s, t = encode.budget(F.col("n_chars").cast("int"), F.expr("cast(n_chars * (doc_id % 5) div 3 as int)"), 128)
    return table(spark, sf_dir, "documents").select("doc_id", s.alias("source_kept"), t.alias("target_kept"))


@query(CHAT_SQL + """, p AS (SELECT a.conv_id, a.i // 2 AS k, length(a.text) AS s, length(b.text) AS t FROM m a JOIN m b ON a.conv_id = b.conv_id AND b.i = a.i + 1 JOIN ok ON ok.conv_id = a.conv_id WHERE good AND a.i % 2 = 0),
w AS (WITH RECURSIVE f(conv_id, k, used, learned) AS (
  SELECT DISTINCT conv_id, CAST(-1 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM p
  UNION ALL
  SELECT f.conv_id, f.k + 1, CASE WHEN used >= 300 THEN used ELSE used + least(greatest((300 - used) - t2, 0), s) + t2 END, CASE WHEN used >= 300 THEN learned ELSE learned + t2 END
  FROM (SELECT f.*, p.s, least(CASE WHEN p.t * 2 < 300 - used THEN 300 - used WHEN p.s * 2 < 300 - used THEN 300 - used - p.s ELSE CAST(floor((300 - used) * (p.t::DOUBLE / greatest(p.s + p.t, 1))) AS BIGINT) END, p.t) AS t2 FROM f JOIN p ON p.conv_id = f.conv_id AND p.k = f.k + 1) f
) SELECT conv_id, arg_max(used, k) AS total, arg_max(learned, k) AS learned FROM f GROUP BY conv_id)
SELECT conv_id, CAST(total AS INT) AS total, CAST(learned AS INT) AS learned FROM w""")
def supervised_lengths(spark, sf_dir):
    """Encoded and learned lengths of dialogues under a cutoff."""
    rows = validate.stage_filter(aligned(spark, sf_dir), "supervised").withColumn("m", F.concat("_prompt", "_response"))
    pairs = F.transform(templates.multi_turn(templates.REGISTRY["empty"], F.col("m")), lambda p: F.struct(F.length(p["prompt"]).alias("source"), F.length(p["response"]).alias("target")))
    # The empty format ends answers without a mark, so lengths are those of the texts.
    return rows.select("conv_id", encode.supervised_lengths(pairs, 300).alias("x")).select("conv_id", "x.total", "x.learned")


@query("""
WITH d AS (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 1000 AS b, text FROM documents), s AS (SELECT b, string_agg(text, '' ORDER BY doc_id) AS t, sum(length(text)) AS n FROM d GROUP BY b)
SELECT CAST(b AS BIGINT) AS batch_id, CAST(k AS BIGINT) AS block_id, md5(substr(t, k * 2048 + 1, 2048)) AS content FROM s, range((SELECT CAST(max(n) // 2048 AS BIGINT) FROM s)) r(k) WHERE k < n // 2048
""")
def pretrain_blocks(spark, sf_dir):
    """Texts end to end in blocks, and what each block holds."""
    from parlance.sources.readers import spread, with_order

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    order = with_order(docs.select("doc_id"), ["doc_id"])  # keys are ordered apart, so texts move once
    d = spread(docs).join(order, "doc_id").select("_ord", Chars().encode(F.col("text")).alias("ids"))
    return encode.pretrain_blocks(d, "ids", 2048).select("batch_id", "block_id", F.md5(Chars().decode(F.col("input_ids"))).alias("content"))


@query("""
WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents), b AS (SELECT *, i // 100 AS b FROM o)
SELECT doc_id, coalesce(lag(doc_id) OVER w, last_value(doc_id) OVER (PARTITION BY b ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS neighbour FROM b WINDOW w AS (PARTITION BY b ORDER BY i)
""")
def kl_shift(spark, sf_dir):
    """Each row with its batch neighbour's answer."""
    from parlance.sources.readers import with_order

    return encode.rotate_answers(with_order(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"]), "doc_id", "neighbour", 100).select("doc_id", "neighbour")


def padded(spark, sf_dir, batch: int, multiple: int) -> DataFrame:
    """Whole documents in padded batches: widths from lengths alone, so no token array is shuffled."""
    from parlance.sources.readers import spread, with_order

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    widths = collate.batch_widths(with_order(docs.select("doc_id", F.length("text").alias("n")), ["doc_id"]), F.col("n"), batch, multiple)
    ids = Chars().encode(F.col("text"))
    return collate.pad_to(spread(docs).join(widths.drop("n"), "doc_id").select("doc_id", "batch_id", "_n", ids.alias("input_ids"), ids.alias("labels")))


@query("""
WITH o AS (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 16 AS b, length(text) AS n FROM documents)
SELECT doc_id, CAST(ceil(max(n) OVER (PARTITION BY b) / 8.0) * 8 AS INT) AS width, CAST(ceil(max(n) OVER (PARTITION BY b) / 8.0) * 8 - n AS INT) AS padding FROM o
""")
def pad_batch(spark, sf_dir):
    """Batches of whole texts padded to a multiple of 8."""
    return padded(spark, sf_dir, 16, 8).select("doc_id", F.size("input_ids").alias("width"), (F.size("labels") - collate.valid_tokens(F.col("labels"))).alias("padding"))


@query("SELECT conv_id, CAST(turn AS INT) AS segment, CAST(length(text) AS BIGINT) AS n FROM (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS turn, text FROM conversations) WHERE length(text) > 0")
def segment_lengths(spark, sf_dir):
    """Sub-sequence sizes of packed masks."""
    m = F.flatten(F.transform("messages", lambda m, i: F.array_repeat(i + 1, F.length(m["text"]))))
    return collate.segment_lengths(chats(spark, sf_dir).select("conv_id", m.alias("attention_mask")), "attention_mask", "conv_id")


@query()
def packed_sequences(spark, sf_dir):
    """Dialogues packed by greedy knapsacks."""
    from parlance.sources.readers import with_order

    ids = Chars().encode(F.col("text"))
    d = with_order(table(spark, sf_dir, "conversations").select("conv_id", "turn", ids.alias("input_ids"), ids.alias("labels")), ["conv_id", "turn"])
    return encode.pack(d, 1024, neat=True).select("batch_id", "sack", F.size("input_ids").alias("width"), "padding", F.size("boundaries").alias("n_bounds"))


@query("""
WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents)
SELECT doc_id, CAST(i // 24 AS BIGINT) AS step, CAST(i % 24 // 8 AS INT) AS micro, CAST(i // 4 % 2 AS INT) AS rank FROM o WHERE i < n // 24 * 24
""")
def micro_batches(spark, sf_dir):
    """Steps, micro-batches and ranks; the incomplete tail dropped."""
    from parlance.sources.readers import with_order

    return collate.micro_batches(with_order(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"]), 24, 4, 2).drop("_ord")


# Metrics.


def scores(spark, sf_dir) -> DataFrame:
    """A probability and a class per labelled document."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return d.select("doc_id", (F.pmod(F.col("n_chars") * 7919 + F.col("doc_id"), F.lit(1000)) / 1000.0).alias("p"), F.col("quality").alias("y"))


SCORES_SQL = "WITH s AS (SELECT doc_id, ((n_chars * 7919 + doc_id) % 1000) / 1000.0::DOUBLE AS p, quality AS y FROM documents JOIN labels USING (doc_id))"
_R = "round(coalesce({0}, 0), 6)"


@query(SCORES_SQL + """, t AS (SELECT unnest([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])::DOUBLE AS threshold),
c AS (SELECT threshold, count(*) FILTER (WHERE p >= threshold AND y = 1) AS tp, count(*) FILTER (WHERE p >= threshold AND y = 0) AS fp, count(*) FILTER (WHERE p < threshold AND y = 1) AS fn, count(*) FILTER (WHERE p < threshold AND y = 0) AS tn FROM s, t GROUP BY threshold)
SELECT threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn, round((tp + tn)::DOUBLE / (tp + fp + fn + tn), 6) AS accuracy, round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 6)::DOUBLE AS f1 FROM c""")
def softmax_thresholds(spark, sf_dir):
    """Confusion and ratios at fixed thresholds."""
    return metrics.ratios(metrics.confusion(scores(spark, sf_dir))).select("threshold", "tp", "fp", "fn", "tn", F.round("accuracy", 6).alias("accuracy"), F.round("f1", 6).alias("f1"))


@query(SCORES_SQL + """, r AS (SELECT y, avg(rn) OVER (PARTITION BY p) AS rank FROM (SELECT *, row_number() OVER (ORDER BY p) AS rn FROM s)), n AS (SELECT sum(y)::DOUBLE AS a, count(*) - sum(y)::DOUBLE AS b FROM s)
SELECT round((sum(rank) FILTER (WHERE y = 1) - max(a) * (max(a) + 1) / 2) / (max(a) * max(b)), 9) AS auc FROM r, n""")
def roc_auc(spark, sf_dir):
    """Area under the ROC curve, ties halved."""
    return metrics.roc_auc(scores(spark, sf_dir)).select(F.round("auc", 9).alias("auc"))


@query(SCORES_SQL + """, c AS (SELECT a.p, sum(b.y) AS tp, count(*) - sum(b.y) AS fp FROM (SELECT DISTINCT p FROM s) a JOIN s b ON b.p >= a.p GROUP BY a.p), f AS (SELECT p, 2.0::DOUBLE * tp / (tp + fp + (SELECT sum(y) FROM s)) AS f1 FROM c)
SELECT p AS threshold, round(f1, 9) AS f1 FROM f ORDER BY f.f1 DESC, p LIMIT 1""")
def best_f1(spark, sf_dir):
    """The exact best threshold, lowest on ties."""
    return metrics.best_f1(scores(spark, sf_dir)).select("threshold", F.round("f1", 9).alias("f1"))


@query(SCORES_SQL + "SELECT round(avg(CASE WHEN y = 1 THEN -0.25 * greatest(1 - p, 1e-6) ** 2 * ln(greatest(p, 1e-12)) ELSE -0.75 * greatest(p, 1e-6) ** 2 * ln(greatest(1 - p, 1e-12)) END), 9) AS loss FROM s")
def focal_loss(spark, sf_dir):
    """Mean focal loss."""
    return scores(spark, sf_dir).agg(F.round(F.avg(metrics.focal_loss(F.col("p"), F.col("y"))), 9).alias("loss"))


@query("SELECT CAST(n_chars // 500 * 500 AS BIGINT) AS bin, CAST(count(*) AS BIGINT) AS n, CAST(sum(count(*)) OVER (ORDER BY n_chars // 500) AS BIGINT) AS cumulative, round(sum(count(*)) OVER (ORDER BY n_chars // 500) * 100.0 / sum(count(*)) OVER (), 6)::DOUBLE AS percent FROM documents GROUP BY n_chars // 500")
def length_cdf(spark, sf_dir):
    """Length histogram with cumulative share."""
    return metrics.length_cdf(table(spark, sf_dir, "documents"), "n_chars", 500).withColumn("percent", F.round("percent", 6))


@query("""
WITH e AS (SELECT vec_id, label, embedding[1]::DOUBLE AS c, embedding[2]::DOUBLE AS r FROM embeddings), x AS (SELECT c, r, -ln(1 + exp(-abs(c - r))) + least(c - r, 0) AS ls, 0.1 * (c - r - 0.5 / 0.1) AS sp FROM e)
SELECT round(avg(c), 9) AS rewards_chosen, round(avg(r), 9) AS rewards_rejected, avg(CASE WHEN c > r THEN 1.0 ELSE 0.0 END)::DOUBLE AS rewards_accuracy, round(avg(c - r), 9) AS rewards_margin, round(avg(-ls), 9) AS reward_loss, round(avg(ln(1 + exp(-abs(sp))) - least(sp, 0)), 9) AS simple_loss FROM x
""")
def preference_metrics(spark, sf_dir):
    """Rewards, margins and preference losses."""
    e = table(spark, sf_dir, "embeddings").select(F.col("embedding")[0].cast("double").alias("chosen"), F.col("embedding")[1].cast("double").alias("rejected"))
    c, r = F.col("chosen"), F.col("rejected")
    losses = e.agg(F.avg(metrics.reward_loss(c, r)).alias("reward_loss"), F.avg(metrics.simple_loss(c, r, 0.1, 0.5)).alias("simple_loss"))
    both = metrics.preference_summary(e).crossJoin(losses)
    return both.select(*[(F.col(x) if x == "rewards_accuracy" else F.round(x, 9)).alias(x) for x in both.columns])


@query("SELECT coalesce(event_type, 'Average') AS category, round(avg(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END), 9)::DOUBLE AS accuracy, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY GROUPING SETS ((event_type), ())")
def mcq_category_accuracy(spark, sf_dir):
    """Accuracy by category and over all rows."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("category"), (F.coalesce("value", F.lit(0.0)) > 50).alias("correct"))
    return metrics.accuracy_by_category(e).withColumn("accuracy", F.round("accuracy", 9))


@query("""
WITH t AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings), r AS (SELECT vec_id, exp(avg(abs(v))) AS ppl FROM t WHERE i > 1 AND i % 3 <> 0 GROUP BY vec_id)
SELECT round(avg(ppl), 9) AS mean_perplexity, CAST(count(*) AS BIGINT) AS n FROM r
""")
def perplexity(spark, sf_dir):
    """Mean of row perplexities over counted labels."""
    e = table(spark, sf_dir, "embeddings")
    labels = F.transform("embedding", lambda x, i: F.when((i + 1) % 3 == 0, -100).otherwise(1))
    loss = F.transform(F.slice("embedding", 2, F.size("embedding")), lambda v: F.abs(v.cast("double")))
    return e.select(metrics.perplexity(F.concat(loss, F.array(F.lit(0.0))), labels).alias("p")).agg(F.round(F.avg("p"), 9).alias("mean_perplexity"), F.count("*").alias("n"))


@query("SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INT) AS best, round(sqrt(1.0) * exp(embedding[1]::DOUBLE - greatest(embedding[1], embedding[2])::DOUBLE) / (exp(embedding[1]::DOUBLE - greatest(embedding[1], embedding[2])::DOUBLE) + exp(embedding[2]::DOUBLE - greatest(embedding[1], embedding[2])::DOUBLE)), 9) AS p FROM embeddings")
def argmax_softmax(spark, sf_dir):
    """Argmax over a vocabulary and the stable binary softmax."""
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", metrics.argmax(e).alias("best"), F.round(metrics.binary_softmax(e[1].cast("double"), e[0].cast("double")), 9).alias("p"))


@query("""
WITH t AS (SELECT vec_id, generate_subscripts(embedding, 1) AS i, CASE WHEN unnest(embedding) > 0 THEN 1 ELSE 0 END AS x FROM embeddings), p AS (SELECT a.vec_id, avg(CASE WHEN a.x = b.x THEN 1.0 ELSE 0.0 END) AS acc FROM t a JOIN t b ON a.vec_id = b.vec_id AND b.i = a.i + 1 WHERE b.i % 4 <> 0 GROUP BY a.vec_id)
SELECT round(avg(acc), 9)::DOUBLE AS accuracy FROM p
""")
def token_accuracy(spark, sf_dir):
    """Shifted, masked accuracy per row, then over rows."""
    x = F.transform("embedding", lambda v: F.when(v > 0, 1).otherwise(0))
    y = F.transform(x, lambda v, i: F.when((i + 1) % 4 == 0, -100).otherwise(v))
    return table(spark, sf_dir, "embeddings").select(metrics.token_accuracy(x, y).alias("a")).agg(F.round(F.avg("a"), 9).alias("accuracy"))


@query("""
WITH t AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events WHERE value IS NOT NULL),
f AS (WITH RECURSIVE r(user_id, k, event_id, s, w) AS (
  SELECT user_id, k, event_id, value, 1.8 * (1 / (1 + exp(-0.05 * n)) - 0.5) FROM t WHERE k = 1
  UNION ALL SELECT t.user_id, t.k, t.event_id, r.s * r.w + (1 - r.w) * t.value, r.w FROM r JOIN t ON t.user_id = r.user_id AND t.k = r.k + 1) SELECT * FROM r)
SELECT user_id, event_id, round(s, 6) AS smoothed FROM f
""")
def ema_smooth(spark, sf_dir):
    """Smoothed series."""
    e = table(spark, sf_dir, "events").where("value is not null")
    return metrics.ema(e, "value", "event_id", "user_id").select("user_id", "event_id", F.round("smoothed", 6).alias("smoothed"))


@query("SELECT CAST(count(*) AS BIGINT) AS n, round(avg(value), 6) AS mean_of_rows, round((SELECT avg(m) FROM (SELECT event_type, avg(m) AS m FROM (SELECT event_type, user_id, avg(value) AS m FROM events GROUP BY 1, 2) GROUP BY 1)), 6) AS mean_of_means FROM events")
def metric_accumulation(spark, sf_dir):
    """Mean of means over batches and ranks."""
    e = table(spark, sf_dir, "events")
    return e.agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_of_rows")).crossJoin(metrics.mean_of_means(e, "value", "user_id", "event_type").select(F.round("value", 6).alias("mean_of_means")))


@query("""
WITH v AS (SELECT doc_id, 200 + doc_id % 1500 AS w, 150 + doc_id * 7 % 1100 AS h, doc_id * 13 % 400 AS total, (doc_id % 90)::DOUBLE AS sec FROM documents),
a AS (SELECT *, CASE WHEN w * h > 589824 THEN CAST(floor(w * sqrt(589824::DOUBLE / (w * h))) AS BIGINT) ELSE w END AS w1, CASE WHEN w * h > 589824 THEN CAST(floor(h * sqrt(589824::DOUBLE / (w * h))) AS BIGINT) ELSE h END AS h1,
  CASE WHEN total = 0 THEN 64 ELSE least(total, 64, greatest(1, floor(sec * 2.0))) END AS f FROM v)
SELECT doc_id, CAST(w1 AS BIGINT) AS width, CAST(h1 AS BIGINT) AS height, CAST(f AS INT) AS frames, CAST(floor(ceil((f + f % 2) / 2.0) * (h1 // 14) * (w1 // 14) / 4) AS BIGINT) AS tokens FROM a
""")
def video_token_counts(spark, sf_dir):
    """Sizes, sampled frames and tokens of videos by metadata."""
    d = table(spark, sf_dir, "documents").select("doc_id", (200 + F.col("doc_id") % 1500).alias("w"), (150 + F.col("doc_id") * 7 % 1100).alias("h"), (F.col("doc_id") * 13 % 400).alias("total"), (F.col("doc_id") % 90).cast("double").alias("sec"))
    w, h = media.area_limits(F.col("w"), F.col("h"), 589824, 1024)
    d = d.select("doc_id", w.alias("width"), h.alias("height"), media.sampled_frames(F.col("total"), F.col("sec"), 2.0, 64).alias("frames"))
    grid = media.video_grid(media.even(F.col("frames")), F.col("height"), F.col("width"))
    return d.withColumn("g", grid).select("doc_id", "width", "height", "frames", media.grid_tokens(F.col("g.t"), F.col("g.h"), F.col("g.w")).alias("tokens"))


@query("SELECT doc_id, replace('look <image> and <image>', '<image>', '<|vision_start|>' || repeat('<|image_pad|>', CAST(doc_id % 4 + 1 AS INT)) || '<|vision_end|>') AS text FROM documents")
def expand_placeholders(spark, sf_dir):
    """Image marks expanded in order."""
    metas = F.array(*[F.struct(F.lit(1).alias("t"), F.lit(2).alias("h"), (2 * (F.col("doc_id") % 4 + 1)).alias("w"))] * 2)
    out = media.expand_images(messages(message(USER, F.lit("look <image> and <image>"))), metas, "qwen2_vl", {"image": "<|image_pad|>"})
    return table(spark, sf_dir, "documents").select("doc_id", out[0]["content"].alias("text"))


@query("SELECT round(avg(embedding[1]), 4)::DOUBLE AS chosen, round(avg(embedding[2]), 4)::DOUBLE AS rejected FROM embeddings")
def reward_report(spark, sf_dir):
    """Means of reward columns in name order (K2, K4)."""
    e = table(spark, sf_dir, "embeddings").select(F.col("embedding")[0].cast("double").alias("chosen"), F.col("embedding")[1].cast("double").alias("rejected"))
    m = sinks.mean_report(e, ["rejected", "chosen"])
    return m.select(*[F.round(c, 4).alias(c) for c in m.columns])


@query()
def text_overlap(spark, sf_dir):
    """ROUGE and BLEU of consecutive answers."""
    c = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    rows = c.withColumn("before", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("before is not null")
    return rows.select("conv_id", "turn", metrics.text_overlap("text", "before").alias("s")).select("conv_id", "turn", "s.*")


@query("SELECT event_type, CAST(count(*) FILTER (WHERE value > 50) AS BIGINT) AS positives, round(sum(value * event_id) / sum(event_id), 6) AS weighted FROM events GROUP BY event_type")
def weighted_means(spark, sf_dir):
    """Weighted running averages by class."""
    e = table(spark, sf_dir, "events")
    return e.groupBy("event_type").agg(F.count_if(F.col("value") > 50).alias("positives"), F.round(metrics.weighted_mean(F.col("value"), F.col("event_id")), 6).alias("weighted"))
