"""The operators applied to whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from toolloom.llm import common, conversations, decontamination, near_duplicates, neighbours, packing, pii, pivots, quality, runs, sharding, token_counts, token_files, urls
from toolloom.llm.encoding import vocabulary

WORD_BPE, BYTE_BPE = "word_bpe_49k.json", "byte_bpe_50k.json"
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack_documents(common.read(spark, sf_dir, "documents"), vocabulary(WORD_BPE), end_id=2)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.groups(common.read(spark, sf_dir, "documents"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.new_path(spark, "token-files")
    token_files.write_tokens(common.read(spark, sf_dir, "documents"), vocabulary(WORD_BPE), 1, path)
    return token_files.read_tokens(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.report(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "benchmark"))


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(common.read(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a cache of this run's own: a lasting one would let a second run skip the work
    return token_counts.token_counts(common.read(spark, sf_dir, "documents"), vocabulary(BYTE_BPE), common.new_path(spark, "token-cache"), limit=1024)


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(common.read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scores(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "labels"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(common.read(spark, sf_dir, "pages"), spark.createDataFrame(RULES, "host string, path string, verdict string"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(common.read(spark, sf_dir, "documents"), shards=8)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.report(conversations.damaged(common.read(spark, sf_dir, "conversations")))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.report(common.read(spark, sf_dir, "documents"), plant=True)


def op13_exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.search(common.read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


QUERIES = {f.__name__: f for f in (op1_packing, op2_near_duplicates, op3_token_files, op4_decontamination, op5_personal_data, op6_token_counts, op7_neighbours, op8_quality, op9_url_filter, op10_sharding, op11_conversation_repair, op12_periodic_runs, op13_exact_search)}

def _checksum(text: str) -> str:
    """DuckDB's unsigned CRC-32 of an ASCII text, bit by bit."""
    byte = "list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda y, z: xor(y >> 1, 3988292384 * (y & 1)))"
    codes = f"list_transform(string_split({text}, ''), lambda ch: ascii(ch)::BIGINT)"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {codes}), lambda c, b: {byte}), 4294967295)"


def _after(state: str, cost: str, letter: str, line: str = "") -> str:
    """A state (cost, audit, repaired text) of the repair after an edit."""
    return f"CASE WHEN {state} IS NOT NULL THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 'r': {state}.r || {line or chr(39) * 2}}} END"


def _repair_sql() -> str:
    none = "NULL::STRUCT(c BIGINT, a VARCHAR, r VARCHAR)"
    user, assistant = (f"chr(10) || '{r}:'" for r in ("user", "assistant"))
    # insertions before a row: after nothing, s or a comes u, after u comes a
    closed = f"o, s, least(u, {_after('o', '2', 'I', user)}, {_after('s', '2', 'I', user)}, {_after('a', '2', 'I', user)}) AS u, a"
    closed_again = f"o, s, least(u, {_after('a', '2', 'I', user)}) AS u, least(a, {_after('u', '2', 'I', assistant)}) AS a"
    drop = {x: _after(x, "3", "D") for x in "osua"}
    may = lambda sql: f"CASE WHEN free THEN {sql} END"
    changed = lambda x, role: may(_after(x, "2 + late", "R", f"chr(10) || '{role}:' || text"))
    kept = lambda x, first: f"CASE WHEN free AND first = '{first}' THEN {_after(x, 'late', 'K', 'chr(10) || role || chr(58) || text')} END"
    step = f"""
        {drop["o"]} AS o, least({drop["s"]}, {kept("o", "s")}) AS s,
        least({drop["u"]}, {changed("o", "user")}, {changed("s", "user")}, {changed("a", "user")}, {kept("o", "u")}, {kept("s", "u")}, {kept("a", "u")}) AS u,
        least({drop["a"]}, {changed("u", "assistant")}, {kept("u", "a")}) AS a"""
    return f"""
        WITH RECURSIVE k AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                   {_checksum("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS kind
            FROM conversations),
        d AS (
            SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
                   CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                   unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
            FROM k),
        n AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i,
                   row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS seen,
                   NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank, NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') AS open
            FROM d),
        f AS (
            SELECT conv_id, turn, role, text, i, blank, NOT blank AND seen AS duplicate, NOT blank AND NOT seen AND open AS truncated,
                   NOT blank AND NOT seen AS free, (NOT blank AND NOT seen AND open)::BIGINT AS late, role[1] AS first,
                   lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) || role[1] AS pair
            FROM n),
        w AS (
            SELECT conv_id, 0::BIGINT AS i, {{'c': 0::BIGINT, 'a': '', 'r': ''}} AS o, {none} AS s, {none} AS u, {none} AS a FROM (SELECT DISTINCT conv_id FROM f)
            UNION ALL
            SELECT conv_id, i, {step}
            FROM (SELECT conv_id, i, {closed_again}, free, late, first, role, text
                  FROM (SELECT w.conv_id, w.i + 1 AS i, {closed}, f.free, f.late, f.first, f.role, f.text FROM w JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1))),
        last AS (SELECT conv_id, max(i) AS i FROM f GROUP BY conv_id),
        won AS (
            SELECT conv_id, least(o, a, {_after("u", "2", "I", assistant)}, {_after("s", "4", "II", user + " || " + assistant)}) AS best
            FROM w SEMI JOIN last ON last.conv_id IS NOT DISTINCT FROM w.conv_id AND last.i = w.i),
        told AS (
            SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, sum(blank::BIGINT) AS blank, sum(duplicate::BIGINT) AS duplicate, sum(truncated::BIGINT) AS truncated,
                   sum((pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au'))::BIGINT) AS illegal
            FROM f GROUP BY conv_id)
        SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
               coalesce(best.c, 0)::BIGINT AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(best.r[2:], '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) c
        LEFT JOIN told ON told.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN won ON won.conv_id IS NOT DISTINCT FROM c.conv_id
    """


ORACLES: dict[str, str] = {
    "op9_url_filter": r"""
        WITH parts AS (
            SELECT page_id,
                   translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
            FROM pages),
        ruled AS (
            SELECT page_id, host, path,
                   CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
                        WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
                        WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
                        WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule
            FROM parts)
        SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict
        FROM ruled
    """,
    "op4_decontamination": r"""
        WITH d AS (
            SELECT doc_id, row_number() OVER () AS rid,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM documents),
        b AS (
            SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM benchmark),
        win AS (
            SELECT DISTINCT item, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS g, least(10, len(w)) AS n
            FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
        sizes AS (SELECT DISTINCT n FROM win),
        hit AS (
            SELECT rid, i, x.n, item
            FROM (SELECT rid, n, i, array_to_string(w[i : i + n - 1], ' ') AS g
                  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)) x
            JOIN win ON win.g = x.g AND win.n = x.n),
        words AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT rid, i, n FROM hit)) GROUP BY rid),
        items AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT rid, item FROM hit) GROUP BY rid)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)
    """,
    "op11_conversation_repair": _repair_sql(),
    "op12_periodic_runs": rf"""
        WITH d AS (
            SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, {_checksum("doc_id::VARCHAR")} AS h FROM documents),
        g AS (SELECT *, len(w) AS n, h // 10 AS g FROM d),
        a AS (SELECT *, coalesce(h % 10 = 0, false) AS hit, CASE WHEN n > 0 THEN g % n END AS a FROM g),
        p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
        e AS (SELECT rid, i, n, CASE WHEN hit AND i >= a THEN w[a + (i - a) % p + 1] ELSE w[i + 1] END AS word FROM (SELECT *, unnest(range(n)) AS i FROM p)),
        same AS (SELECT x.rid, x.i, y.i - x.i AS q FROM e x JOIN e y ON x.rid = y.rid AND x.word = y.word AND y.i > x.i AND (y.i - x.i) * 4 <= x.n),
        isle AS (SELECT rid, q, i, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS isle FROM same),
        long AS (SELECT rid, min(i) AS start, count(*) + q AS length, q FROM isle GROUP BY rid, q, isle HAVING count(*) + q >= greatest(6, 4 * q)),
        run AS (SELECT rid, start, length, min(q) AS period FROM long GROUP BY rid, start, length),
        gone AS (SELECT DISTINCT rid, unnest(range(start + period, start + length)) AS i FROM run),
        best AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY length / period DESC, start, period) AS place FROM run),
        lines AS (SELECT rid, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM run GROUP BY rid),
        kept AS (SELECT rid, string_agg(word, ' ' ORDER BY i) AS words FROM e ANTI JOIN gone USING (rid, i) GROUP BY rid)
        SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start::BIGINT AS start, length::BIGINT AS length, period::BIGINT AS period, (1000 * length // period)::BIGINT AS exponent_milli,
               sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(words, '')) AS collapsed_sha256
        FROM d LEFT JOIN lines USING (rid) LEFT JOIN (SELECT * FROM best WHERE place = 1) USING (rid) LEFT JOIN kept USING (rid)
    """,
    "op13_exact_search": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS x FROM embeddings
            WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.x, v.x)::BIGINT AS score FROM v q JOIN v ON q.vec_id % 100 = 0 AND v.vec_id <> q.vec_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
    """,
}
