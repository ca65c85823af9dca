"""Dataset construction: hold-outs, near duplicates, retrieval, derivations, normalisation, chats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from toolloom.functions.json import args_map, call_signature
from toolloom.functions.text import token_set
from toolloom.functions.values import cycled, first_filled, last_n, slot_recall
from toolloom.operators import dedup, derivation, generation, normalise, ranks, registry, reports, retrieval, sampling
from toolloom.plans.base import Plans, table

plans = Plans()

_TOKENS = r"list_sort(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')))"
_SIMILAR_SQL = f"""
    WITH t AS (SELECT doc_id, lang || '|' || source AS key, {_TOKENS} AS w FROM documents),
    cl AS (SELECT key, w, min(doc_id) AS doc_id FROM t WHERE len(w) > 0 GROUP BY key, w),
    s AS (SELECT a.key, a.doc_id AS earlier, b.doc_id AS later, len(list_intersect(a.w, b.w)) AS c, len(a.w) AS na, len(b.w) AS nb
          FROM cl a JOIN cl b ON a.key = b.key AND a.doc_id < b.doc_id AND least(len(a.w), len(b.w)) >= 0.85 * greatest(len(a.w), len(b.w))),
    p AS (SELECT key, earlier, later, c / (na + nb - c) AS similarity FROM s WHERE c / (na + nb - c) > 0.85)
"""


def tokenized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.concat_ws("|", "lang", "source").alias("key"), F.col("doc_id").alias("pos"), token_set(F.col("text")).alias("tokens"))


@plans.query(_SIMILAR_SQL + "SELECT key, earlier, later, round(similarity, 6) AS similarity FROM p")
def jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.similar_pairs(tokenized(spark, sf_dir)).withColumn("similarity", F.round("similarity", 6))


@plans.query(_SIMILAR_SQL + "SELECT doc_id FROM t WHERE len(w) = 0 UNION ALL SELECT doc_id FROM cl WHERE doc_id NOT IN (SELECT later FROM p)")
def dedup_declarative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.drop_similar(tokenized(spark, sf_dir)).select(F.col("pos").alias("doc_id"))


@plans.query(
    _SIMILAR_SQL.replace("WITH t AS", "WITH RECURSIVE t AS", 1)
    + """, r AS (SELECT row_number() OVER (ORDER BY t.doc_id) AS i, t.doc_id, t.key, array_to_string(t.w, ' ') AS sig, t.key LIKE 'es%' AS exempt, cl.doc_id AS cid FROM t LEFT JOIN cl ON cl.key = t.key AND cl.w = t.w),
         near AS (SELECT key, earlier AS a, later AS b FROM p UNION ALL SELECT key, later, earlier FROM p UNION ALL SELECT key, doc_id, doc_id FROM cl),
         nb AS (SELECT x.doc_id, list(y.doc_id) AS before FROM r x JOIN near ON near.key = x.key AND near.a = x.cid JOIN r y ON y.key = x.key AND y.cid = near.b AND y.doc_id < x.doc_id GROUP BY 1),
         sg AS (SELECT x.doc_id, list(y.doc_id) AS same FROM r x JOIN r y ON y.key = x.key AND y.sig = x.sig AND y.doc_id < x.doc_id GROUP BY 1),
         n AS (SELECT i, doc_id, exempt, coalesce(before, []) AS before, coalesce(same, []) AS same FROM r LEFT JOIN nb USING (doc_id) LEFT JOIN sg USING (doc_id)),
         walk AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS kept
                  UNION ALL SELECT n.i, CASE WHEN NOT list_has_any(before, kept) AND (exempt OR len(list_intersect(same, kept)) < 3) THEN list_append(kept, doc_id) ELSE kept END FROM walk JOIN n ON n.i = walk.i + 1)
       SELECT unnest(kept) AS doc_id FROM (SELECT kept FROM walk ORDER BY i DESC LIMIT 1)"""
)
def dedup_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order-dependent rule, decided in rounds; the oracle walks row by row."""
    rows = tokenized(spark, sf_dir).withColumns({"signature": F.array_join("tokens", " "), "exempt": F.col("key").startswith("es")})
    return dedup.greedy(rows).select(F.col("pos").alias("doc_id"))


@plans.query("WITH r AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type, user_id % 20 ORDER BY event_id) AS n FROM events) SELECT event_id FROM r WHERE n <= 3 OR event_type = 'error'")
def cap_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", (F.col("user_id") % 20).alias("sig"))
    return dedup.cap_per_signature(rows, ["event_type", "sig"], "event_id", exempt=F.col("event_type") == "error").select("event_id")


@plans.query(f"WITH t AS (SELECT lang, source, {_TOKENS} AS w FROM documents) SELECT lang, source, count(*) - count(DISTINCT array_to_string(w, ' ')) AS duplicates FROM t GROUP BY 1, 2")
def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.duplicates(table(spark, sf_dir, "documents"), ["lang", "source"], token_set(F.col("text")))


@plans.query("SELECT event_id FROM events WHERE event_id % 100 <> 0 AND (event_type, CAST(json_extract_string(props, '$.k') AS INT)) NOT IN (SELECT event_type, CAST(json_extract_string(props, '$.k') AS INT) FROM events WHERE event_id % 100 = 0)")
def anti_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls whose signature no held-out call has."""
    calls = table(spark, sf_dir, "events").select("event_id", call_signature(F.col("event_type"), F.col("props")).alias("signature"))
    return dedup.decontaminate(calls.where("event_id % 100 <> 0"), calls.where("event_id % 100 = 0")).select("event_id")  # two sides that are the whole table


def _asked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return queries, table(spark, sf_dir, "documents").select("doc_id", "text")


@plans.query(
    r"""WITH d AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS token FROM documents),
             tf AS (SELECT doc_id, token, count(*) AS tf FROM d GROUP BY 1, 2), dl AS (SELECT doc_id, sum(tf) AS len FROM tf GROUP BY 1),
             st AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT sum(len) FROM dl) / (SELECT count(*) FROM documents) AS avg_len),
             idf AS (SELECT token, ln(1 + ((SELECT n FROM st) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf GROUP BY 1),
             q AS (SELECT item_id, token, count(*) AS qtf FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS token FROM benchmark) GROUP BY 1, 2),
             s AS (SELECT item_id, doc_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / (SELECT avg_len FROM st)))), 6) AS score FROM q JOIN idf USING (token) JOIN tf USING (token) JOIN dl USING (doc_id) GROUP BY 1, 2),
             r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s)
        SELECT item_id AS query_id, doc_id, rank, round(score, 4) AS score FROM r WHERE rank <= 8"""
)
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight best documents of each benchmark text by score, ties to the smaller document."""
    return retrieval.bm25_top_k(*_asked(spark, sf_dir), k=8).select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"), F.round("score", 4).alias("score"))


@plans.query(
    rf"""WITH q AS (SELECT DISTINCT item_id, unnest({_TOKENS}) AS token FROM benchmark), d AS (SELECT DISTINCT doc_id, unnest({_TOKENS}) AS token FROM documents),
              r AS (SELECT item_id, doc_id, count(*) AS score, row_number() OVER (PARTITION BY item_id ORDER BY count(*) DESC, doc_id) AS rank FROM q JOIN d USING (token) GROUP BY 1, 2)
         SELECT item_id AS query_id, doc_id, score, rank FROM r WHERE rank <= 8"""
)
def overlap_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.overlap_top_k(*_asked(spark, sf_dir), k=8).withColumn("rank", F.col("rank").cast("long"))


@plans.query(
    r"""WITH q AS (SELECT page_id, regexp_extract_all(lower(regexp_extract(coalesce(url, ''), '\?([^#]*)', 1)), '[\p{L}\p{N}_]+') AS w FROM pages),
             d AS (SELECT DISTINCT p_partkey, unnest(regexp_extract_all(lower(p_name), '[\p{L}\p{N}_]+')) AS token FROM part),
             m AS (SELECT page_id, p_partkey, count(*) AS score FROM (SELECT DISTINCT page_id, unnest(w) AS token FROM q) JOIN d USING (token) GROUP BY 1, 2),
             r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, p_partkey) AS rank FROM m),
             f AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) AS rank FROM part ORDER BY p_partkey LIMIT 3)
        SELECT page_id, p_partkey, score, rank FROM r WHERE rank <= 3 UNION ALL SELECT page_id, p_partkey, 0, rank FROM q, f WHERE len(w) = 0"""
)
def retrieval_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query parts of urls against part names; a page without a word gets the first parts."""
    queries = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract(F.coalesce("url", F.lit("")), r"\?([^#]*)", 1).alias("text"))
    docs = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("text"))
    top = retrieval.overlap_top_k(queries, docs, 3, "page_id", "p_partkey")
    return retrieval.or_first(top, queries, docs, 3, "page_id", "p_partkey").select("page_id", "p_partkey", F.col("score").cast("long").alias("score"), F.col("rank").cast("long").alias("rank"))


@plans.query("SELECT event_id, CASE event_type WHEN 'view' THEN 'xlam' ELSE 'toolace' END AS source FROM events WHERE event_type IN ('view', 'click') ORDER BY event_id LIMIT 2000")
def warmup_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two thousand rows of public sources."""
    source = F.when(F.col("event_type") == "view", "xlam").when(F.col("event_type") == "click", "toolace").otherwise(F.col("event_type"))
    rows = generation.public_only(table(spark, sf_dir, "events").select("event_id", source.alias("source")))
    return sampling.first_n(rows, 2000, "event_id")


@plans.query("SELECT c_custkey, CASE WHEN row_number() OVER (ORDER BY (c_custkey * 7919 + 104729) % 1000003, c_custkey) <= 100 THEN 'eval' ELSE 'train' END AS side FROM customer")
def holdout_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    held, rest = sampling.hold_out(table(spark, sf_dir, "customer").select("c_custkey"), 100, "c_custkey", sampling.arithmetic_hash(F.col("c_custkey")))
    return held.withColumn("side", F.lit("eval")).union(rest.withColumn("side", F.lit("train")))


@plans.query("SELECT coalesce(lang, 'unknown') AS lang, count(*) AS n, round(100 * count(*) / (SELECT count(*) FROM documents), 4) AS pct FROM documents GROUP BY 1")
def scenario_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.distribution(table(spark, sf_dir, "documents"), "lang")


_WITH_TURNS = "WITH f AS (SELECT conv_id, arg_min(text, turn) AS first_text FROM conversations WHERE role = 'user' GROUP BY 1), l AS (SELECT conv_id, arg_max(text, turn) AS last_text FROM conversations WHERE role = 'assistant' GROUP BY 1)"


@plans.query(_WITH_TURNS + "SELECT c.conv_id, first_text, last_text FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN f USING (conv_id) LEFT JOIN l USING (conv_id)")
def first_user_last_assistant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derivation.first_and_last(table(spark, sf_dir, "conversations"))


@plans.query(_WITH_TURNS + "SELECT CAST(conv_id AS VARCHAR) AS id, 'system:system|user:' || first_text || '|assistant:' || last_text AS messages, 'abstain' AS expected_action FROM f JOIN l USING (conv_id)")
def chat_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat records of three messages from each conversation that has both sides."""
    turns = derivation.first_and_last(table(spark, sf_dir, "conversations")).where("first_text is not null and last_text is not null")
    rows = turns.select(F.col("conv_id").cast("string").alias("id"), F.lit("chat").alias("source"), F.col("first_text").alias("instruction"), F.lit("abstain").alias("expected_action"), "last_text")
    chats = derivation.chat_record(rows, F.lit("system"), F.col("last_text"))
    return chats.select("id", F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|").alias("messages"), "expected_action")


@plans.query(
    """SELECT event_id, CASE event_id % 4 WHEN 2 THEN 'param' WHEN 3 THEN 'renamed' ELSE 'fn' END AS mode, CASE WHEN event_id % 4 = 3 THEN 'kpi_query_' ELSE 'func_' END || CAST(event_id + 1 AS VARCHAR) AS masked_name,
              CASE WHEN event_id % 4 = 2 THEN 'param_1' ELSE 'k' END AS key, CAST(json_extract_string(props, '$.k') AS BIGINT) AS value FROM events"""
)
def mask_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("i"), F.col("event_type").alias("tool_name"), args_map(F.col("props")).alias("args"), F.array(F.lit("k"), F.lit("z")).alias("param_names"), F.col("event_type").alias("instruction"))
    key = F.element_at(F.map_keys("masked_args"), 1)
    return derivation.masked(rows).select(F.col("i").alias("event_id"), "mode", "masked_name", key.alias("key"), F.element_at("masked_args", key).cast("long").alias("value"))


@plans.query(
    """SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'from_date,to_date' ELSE 'location_code' END AS missing, CASE WHEN o_orderkey % 2 = 0 THEN 'kpi,location_code' ELSE 'from_date,kpi,to_date' END AS kept FROM orders"""
)
def missing_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests that leave out both dates or the location, in turn."""
    args = args_map(F.to_json(F.struct(F.col("o_orderstatus").alias("location_code"), F.col("o_orderdate").cast("string").alias("from_date"), F.col("o_orderdate").cast("string").alias("to_date"), F.lit("k").alias("kpi"))))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("i"), args.alias("args"), F.array(*map(F.lit, ("location_code", "from_date", "to_date", "kpi"))).alias("required"))
    return derivation.missing_slot(rows).select(F.col("i").alias("o_orderkey"), F.array_join("missing_slots", ",").alias("missing"), F.array_join(F.array_sort(F.map_keys("checker_arguments")), ",").alias("kept"))


@plans.query("SELECT s_suppkey, n_name AS first_location, n_name AS second_location, 'x' || CAST(s_suppkey AS VARCHAR) AS kept FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def parallel_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two calls a supplier; the second takes over the shared location and keeps its own argument."""
    rows = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    first = args_map(F.to_json(F.struct(F.col("n_name").alias("location_code"))))
    second = args_map(F.to_json(F.struct(F.lit("elsewhere").alias("location_code"), F.concat(F.lit("x"), F.col("s_suppkey").cast("string")).alias("own"))))
    calls = derivation.parallel_calls(F.lit("a"), first, F.lit("b"), second)
    value = lambda i, k: F.element_at(F.col("calls")[i]["arguments"], k).cast("string")
    return rows.select("s_suppkey", calls.alias("calls")).select("s_suppkey", value(0, "location_code").alias("first_location"), value(1, "location_code").alias("second_location"), value(1, "own").alias("kept"))


@plans.query("SELECT 's' || CAST(s_suppkey AS VARCHAR) || x.suffix AS id, CASE x.suffix WHEN '_r1' THEN s_name ELSE 'st' || CAST(s_suppkey % 10 AS VARCHAR) END AS value FROM supplier, (VALUES ('_r1'), ('_r2')) AS x(suffix) WHERE s_suppkey % 10 <> 0")
def react_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rows a chain; the waiting argument of the second is the first observed station."""
    first = args_map(F.to_json(F.struct(F.col("s_name").alias("v"))))
    second = args_map(F.to_json(F.struct(F.lit("?").alias("v"))))
    rows = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"), F.lit("find it").alias("instruction"), derivation.chained_calls(F.lit("a"), first, F.lit("b"), second, F.lit("v")).alias("steps"),
        F.when(F.col("s_suppkey") % 10 != 0, F.array(F.concat(F.lit("st"), (F.col("s_suppkey") % 10).cast("string")))).otherwise(F.array().cast("array<string>")).alias("observation"),
    )
    return derivation.react_steps(rows).select("id", F.element_at("arguments", "v").cast("string").alias("value"))


@plans.query(
    """SELECT o_orderkey, o_orderkey % 4 = 1 AS repaired, CASE o_orderkey % 4 WHEN 0 THEN 'from_date,to_date' WHEN 1 THEN 'from_date,to_date' WHEN 2 THEN 'kpi_code' ELSE 'to_date' END AS missing
       FROM orders WHERE NOT (o_orderkey % 4 = 1 AND o_orderkey % 3 = 0)"""
)
def date_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    slots = F.when(k % 4 == 0, F.array(F.lit("from_date"), F.lit("to_date"))).when(k % 4 == 1, F.array(F.lit("from_date"))).when(k % 4 == 2, F.array(F.lit("kpi_code"))).otherwise(F.array(F.lit("to_date")))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when(k % 4 == 3, "parallel").otherwise("missing_slot").alias("scenario_family"), F.when(k % 3 == 0, "ngày 2024-01-05").otherwise("hôm nay").alias("instruction"), slots.alias("missing_slots"), args_map(F.lit('{"to_date": "x", "a": 1}')).alias("checker_args"))
    return derivation.repair_dates(rows).select("o_orderkey", "repaired", F.array_join("missing_slots", ",").alias("missing"))


@plans.query("SELECT c_custkey, CASE WHEN c_custkey % 10 < 3 THEN 'simple' WHEN c_custkey % 10 < 7 THEN 'medium' ELSE 'complex' END AS tier, CASE c_custkey % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS slot FROM customer")
def tier_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", sampling.tier(F.col("c_custkey")).alias("tier"), cycled(F.col("c_custkey"), ["a", "b", "c"]).alias("slot"))


@plans.query("SELECT s_suppkey, 'real_' || CAST(s_nationkey AS VARCHAR) || '_' || lpad(CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS VARCHAR), 4, '0') AS id FROM supplier")
def numbered_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    return sampling.numbered_ids(rows, F.concat(F.lit("real_"), F.col("s_nationkey").cast("string"), F.lit("_")), ["s_suppkey"], ["s_nationkey"]).select("s_suppkey", "id")


@plans.query(
    """SELECT CASE event_id % 6 WHEN 0 THEN 'xlam' WHEN 1 THEN 'toolace' WHEN 2 THEN 'apigen_mt' WHEN 3 THEN 'hermes_fc' WHEN 4 THEN 'xlam_irrelevance' ELSE 'xlam' END AS source,
              CASE event_id % 6 WHEN 3 THEN 'call_functions' WHEN 4 THEN 'abstain' WHEN 5 THEN 'abstain' ELSE 'call_function' END AS expected_action, event_id % 6 = 5 AS malformed,
              count(*) AS n, min('public_' || CASE event_id % 6 WHEN 0 THEN 'xlam' WHEN 1 THEN 'toolace' WHEN 2 THEN 'apigen_mt' WHEN 3 THEN 'hermes_fc' WHEN 4 THEN 'xlam_irrelevance' ELSE 'xlam' END || '_' || lpad(CAST(event_id AS VARCHAR), 6, '0')) AS first_id FROM events GROUP BY 1, 2, 3"""
)
def normalise_public(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events dressed in five public dialects and one malformed row kind."""
    call = F.concat(F.lit('{"name": "'), "event_type", F.lit('", "arguments": '), "props", F.lit("}"))
    quoted = F.regexp_replace(call, '"', r'\\"')
    kind = F.col("event_id") % 6
    text = (
        F.when(kind == 0, F.concat(F.lit('{"query": "q", "answers": "['), quoted, F.lit(']"}')))
        .when(kind == 1, F.concat(F.lit('{"conversations": [{"from": "user", "value": "q"}, {"from": "assistant", "value": "'), quoted, F.lit('"}]}')))
        .when(kind == 2, F.concat(F.lit('{"conversations": [{"from": "human", "value": "q"}, {"from": "function_call", "value": "'), quoted, F.lit('"}]}')))
        .when(kind == 3, F.concat(F.lit('{"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "<tool_call>'), quoted, F.lit("</tool_call><tool_call>"), quoted, F.lit('</tool_call>"}]}')))
        .when(kind == 4, F.lit('{"instruction": "q", "answers": []}'))
        .otherwise("not json")
    )
    source = F.element_at(F.array(*map(F.lit, ("xlam", "toolace", "apigen_mt", "hermes_fc", "xlam_irrelevance", "xlam"))), kind.cast("int") + 1)
    raw = table(spark, sf_dir, "events").select(F.col("event_id").cast("int").alias("pos"), source.alias("source"), text.alias("json"))
    return normalise.normalise(raw).groupBy("source", "expected_action", "malformed").agg(F.count("*").alias("n"), F.min("record_id").alias("first_id"))


@plans.query("SELECT family, count(*) AS n FROM (SELECT o_orderstatus AS family FROM orders WHERE o_orderstatus <> 'F' UNION ALL SELECT 'F' FROM customer) GROUP BY 1")
def splice_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("family"), "o_orderkey")
    return derivation.splice(rows, table(spark, sf_dir, "customer").select(F.lit("F").alias("family")), "family", "F").groupBy("family").agg(F.count("*").alias("n"))


@plans.query("SELECT p_name AS name, max(p_partkey) AS last_key, min(p_partkey) AS first_key FROM part GROUP BY 1")
def registry_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), "p_partkey")
    last = registry.last_wins(parts, ["name"], F.col("p_partkey")).withColumnRenamed("p_partkey", "last_key")
    return last.join(registry.first_wins(parts, ["name"], F.col("p_partkey")).withColumnRenamed("p_partkey", "first_key"), "name")


@plans.query("SELECT p_type AS code, arg_min(p_name, p_partkey) AS name, row_number() OVER (ORDER BY min(p_partkey)) AS place FROM part GROUP BY 1")
def reference_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First name of each code, and codes in first-seen order."""
    firsts = table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("code")).agg(F.min_by("p_name", "p_partkey").alias("name"), F.min("p_partkey").alias("pos"))
    return ranks.numbered(firsts, [], ["pos"]).select("code", "name", (F.col("n") + 1).alias("place"))


@plans.query("SELECT c_custkey, CASE WHEN c_nationkey = 1 THEN 't1,t0' WHEN c_nationkey = 0 THEN 't0,t1' ELSE 't' || CAST(c_nationkey AS VARCHAR) || ',t0,t1' END AS tools FROM customer")
def prompt_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.array(F.concat(F.lit("t"), F.col("c_nationkey").cast("string")))
    chosen = retrieval.prompt_tools(own, F.array(F.lit("t0"), F.lit("bad")), F.array(F.lit("t1"), F.lit("t0")), F.array(F.lit("bad")))
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(chosen, ",").alias("tools"))


@plans.query(
    """WITH r AS (SELECT s_suppkey, s_nationkey % 20 AS loc, row_number() OVER (PARTITION BY s_nationkey % 20 ORDER BY lpad(CAST(s_suppkey AS VARCHAR), 9, '0')) AS n FROM supplier),
            o AS (SELECT loc, string_agg(lpad(CAST(s_suppkey AS VARCHAR), 9, '0'), ',' ORDER BY s_suppkey) AS own FROM r WHERE n <= 3 GROUP BY 1),
            a AS (SELECT string_agg(x, ',' ORDER BY x) AS anywhere FROM (SELECT lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS x FROM supplier ORDER BY x LIMIT 3))
       SELECT n_nationkey, coalesce(own, anywhere) AS stations FROM nation LEFT JOIN o ON n_nationkey = loc, a"""
)
def stations_by_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three stations of a location, of the whole catalogue where it has none."""
    stations = table(spark, sf_dir, "supplier").select(F.lpad(F.col("s_suppkey").cast("string"), 9, "0").alias("station_code"), (F.col("s_nationkey") % 20).alias("location_code"))
    places = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_nationkey").alias("location_code"))
    return sampling.stations_of(places, stations).select("n_nationkey", F.array_join("stations", ",").alias("stations"))


@plans.query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 1.0 WHEN event_id % 3 = 1 THEN 0.5 ELSE 0.0 END AS recall, CASE WHEN event_id % 2 = 0 THEN 'b,c' ELSE 'a' END AS picked FROM events")
def slot_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slot recall, and the first filled of several lists (empty ones fall through) with its last two items."""
    e = F.col("event_id")
    missing = F.when(e % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("a"), F.lit("b")))
    asked = F.when(e % 3 == 1, F.array(F.lit("b"), F.lit("z"))).otherwise(F.array(F.lit("z")))
    picked = first_filled(F.when(e % 2 == 0, F.array(F.lit("a"), F.lit("b"), F.lit("c"))).otherwise(F.array().cast("array<string>")), F.array(F.lit("a")))
    return table(spark, sf_dir, "events").select("event_id", slot_recall(missing, asked).alias("recall"), F.array_join(last_n(picked, 2), ",").alias("picked"))


@plans.query("SELECT n_nationkey AS location, i.i, CASE WHEN i.i % 10 < 3 THEN 'simple' WHEN i.i % 10 < 7 THEN 'medium' ELSE 'complex' END AS tier, true AS in_pool, true AS same_period FROM nation, (SELECT unnest(range(12)) AS i) i")
def argument_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Argument sets drawn from tiered pools: each value is of its pool, both dates share a period."""
    params = "array<struct<name:string,type:string,required:boolean,enum:array<string>,pattern:string,description:string>>"
    tools = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("name"), F.from_json(F.lit('[{"name":"from_date","required":true},{"name":"to_date","required":true},{"name":"kpi","required":true},{"name":"x","required":false}]'), params).alias("params"))
    tiers = ("simple", "medium", "complex")
    pools = spark.createDataFrame([(p, t, [f"{p}-{t}-{j}" for j in range(5)], "time" if p != "kpi" else None) for p in ("from_date", "to_date", "kpi") for t in tiers], "param string, tier string, items array<string>, period string")
    drawn = sampling.argument_grid(tools, pools, 12)
    value = lambda k: F.element_at("arguments", k)
    last = lambda k: F.substring_index(value(k), "-", -1)
    return drawn.select(F.col("name").cast("int").alias("location"), F.col("i").cast("long").alias("i"), "tier", (value("kpi").startswith(F.concat(F.lit("kpi-"), "tier")) & (F.size("arguments") == 3)).alias("in_pool"), (last("from_date") == last("to_date")).alias("same_period"))
