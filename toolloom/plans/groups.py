"""Groups of rollouts, routing and rewards: a user's events are one prompt's rollouts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from toolloom.functions import scores as S
from toolloom.operators import bandit, reports, rollouts
from toolloom.plans.base import Plans, table

plans = Plans()

_ROLLOUTS_SQL = "WITH r AS (SELECT user_id AS id, event_id AS k, CASE WHEN user_id % 5 = 0 THEN 0.0 WHEN user_id % 5 = 1 THEN 0.5 WHEN event_id % 3 = 0 THEN 1.0 ELSE (event_id % 7) / 10.0 END AS reward, CASE WHEN event_id % 4 = 0 THEN '' ELSE event_type END AS raw_output FROM events)"


def rolled(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, u = F.col("event_id"), F.col("user_id")
    reward = F.when(u % 5 == 0, 0.0).when(u % 5 == 1, 0.5).when(e % 3 == 0, 1.0).otherwise((e % 7) / 10)
    return table(spark, sf_dir, "events").select(u.alias("id"), e.alias("k"), reward.alias("reward"), F.when(e % 4 == 0, "").otherwise(F.col("event_type")).alias("raw_output"))


@plans.query(_ROLLOUTS_SQL + "SELECT id, count(*) AS n, round(avg(reward), 6) AS avg_reward, max(reward) AS best_reward, CASE WHEN max(reward) >= 1 THEN min(CASE WHEN reward = 1 THEN k END) ELSE -1 END AS best_k FROM r GROUP BY id")
def best_of_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollouts.best_of_k(rolled(spark, sf_dir)).withColumn("avg_reward", F.round("avg_reward", 6))


@plans.query(_ROLLOUTS_SQL + "SELECT id, count(DISTINCT round(reward, 3)) AS n_rewards FROM r GROUP BY id HAVING count(DISTINCT round(reward, 3)) > 1")
def group_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollouts.contrasting(rolled(spark, sf_dir))


@plans.query(_ROLLOUTS_SQL + "SELECT id, round(avg(reward), 6) AS avg_reward FROM r GROUP BY id HAVING avg(reward) > 0 AND avg(reward) < 1")
def mixed_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollouts.mixed(rollouts.not_all_failed(rollouts.best_of_k(rolled(spark, sf_dir)))).select("id", F.round("avg_reward", 6).alias("avg_reward"))


@plans.query(_ROLLOUTS_SQL + ", b AS (SELECT id, avg(reward) AS a, max(reward) AS m FROM r GROUP BY id) SELECT count(*) AS groups, sum((m >= 1)::INT)::BIGINT AS with_success, sum((a > 0 AND a < 1)::INT)::BIGINT AS mixed, round(avg(m), 6) AS avg_best FROM b")
def group_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollouts.group_counts(rollouts.best_of_k(rolled(spark, sf_dir))).withColumn("avg_best", F.round("avg_best", 6))


@plans.query(_ROLLOUTS_SQL + "SELECT id, k, round(reward - avg(reward) OVER (PARTITION BY id), 6) + 0.0 AS centred FROM r")
def group_centred(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollouts.centred(rolled(spark, sf_dir)).select("id", "k", (F.round("centred", 6) + 0.0).alias("centred"))


@plans.query(_ROLLOUTS_SQL + "SELECT id, min(k) AS k, 1.0 AS reward FROM r WHERE raw_output <> '' AND reward >= 1 GROUP BY id")
def positive_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollouts.banks(rolled(spark, sf_dir))[0].select("id", "k", "reward")


@plans.query(_ROLLOUTS_SQL + "SELECT id, count(*) AS n FROM r WHERE raw_output <> '' AND reward < 1 GROUP BY id")
def negative_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollouts.banks(rolled(spark, sf_dir))[1].groupBy("id").agg(F.count("*").alias("n"))


@plans.query(_ROLLOUTS_SQL + "SELECT count(*) AS attempted, sum((reward = 1)::INT)::BIGINT AS valid, round(sum((reward = 1)::INT) / greatest(count(*), 1), 6) AS rate FROM r")
def valid_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollouts.valid_corrections(rolled(spark, sf_dir).withColumnRenamed("reward", "correction_reward")).withColumn("rate", F.round("rate", 6))


@plans.query(_ROLLOUTS_SQL + "SELECT count(*) AS n, round(sum((reward < 1)::INT) / greatest(count(*), 1), 6) AS failure_rate FROM r")
def failure_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rolled(spark, sf_dir)
    wrong = F.count_if(F.col("reward") < rollouts.SUCCESS)
    return rows.agg(F.count("*").alias("n"), F.round(reports.rate(wrong, F.count("*")), 6).alias("failure_rate"))


@plans.query("SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def unfinished_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("id"))
    return rollouts.unfinished(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), done)


@plans.query(
    """WITH r AS (SELECT l_orderkey AS id, l_linenumber AS k, (l_tax - l_discount) + (l_discount - 0.5 * l_tax) AS d, l_quantity >= 25 AS good FROM lineitem),
            c AS (SELECT *, d / 2.0 AS x, avg(d / 2.0) OVER (PARTITION BY id) AS delta FROM r)
       SELECT id, count(*) AS n, round(sum(ln(1 + exp(CASE WHEN good THEN delta - x ELSE x - delta END))), 4) AS loss FROM c GROUP BY id"""
)
def implicit_rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.array("l_tax", "l_discount").alias("teacher_lp"), F.array(F.col("l_discount"), 0.5 * F.col("l_tax")).alias("policy_lp"), F.when(F.col("l_quantity") >= 25, 1.0).otherwise(0.0).alias("reward"))
    return rollouts.implicit_contrast(rows).groupBy("id").agg(F.count("*").alias("n"), F.round(F.sum("loss"), 4).alias("loss"))


@plans.query(
    """WITH e AS (SELECT vec_id, unnest(embedding[1:32])::DOUBLE AS a, unnest(embedding[33:64])::DOUBLE AS b FROM embeddings),
            z AS (SELECT vec_id, sum(exp(a)) AS sa, sum(exp(b)) AS sb FROM e GROUP BY 1),
            p AS (SELECT vec_id, exp(a) / sa AS p, exp(b) / sb AS q FROM e JOIN z USING (vec_id))
       SELECT vec_id, round(sum(p * ln(p / q)), 5) + 0.0 AS kl, round(0.5 * sum(p * ln(2 * p / (p + q)) + q * ln(2 * q / (p + q))), 5) + 0.0 AS jsd FROM p GROUP BY 1"""
)
def token_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    p, q = F.slice("e", 1, 32), F.slice("e", 33, 32)  # both halves of a vector
    return e.select("vec_id", (F.round(S.top_k_kl(p, q), 5) + 0.0).alias("kl"), (F.round(S.top_k_jsd(p, q), 5) + 0.0).alias("jsd"))


def _loss_sql(alpha: float) -> str:
    ratio = "least(exp(least(greatest(n - o, -20.0), 20.0)), 1.1)"
    m = f"({alpha} * p[i] + {1 - alpha} * q[i])"
    return f"avg(list_sum(list_transform(range(1, 9), lambda i: {alpha} * p[i] * (ln(p[i]) - ln({m})) + {1 - alpha} * q[i] * (ln(q[i]) - ln({m})))) * {ratio})"


@plans.query(
    f"""WITH t AS (SELECT vec_id, k, embedding[k + 1]::DOUBLE AS n, embedding[k + 33]::DOUBLE AS o, list_transform(embedding[33 + 8 * k : 40 + 8 * k], lambda x: exp(x::DOUBLE)) AS t, list_transform(embedding[1 + 8 * k : 8 + 8 * k], lambda x: exp(x::DOUBLE)) AS s
                   FROM (SELECT *, unnest(range(4)) AS k FROM embeddings)),
             x AS (SELECT vec_id, n, o, list_transform(t, lambda v: v / list_sum(t)) AS p, list_transform(s, lambda v: v / list_sum(s)) AS q FROM t)
        SELECT vec_id, round({_loss_sql(0.5)}, 5) + 0.0 AS even, round({_loss_sql(0.3)}, 5) + 0.0 AS tilted, round({_loss_sql(0.0)}, 5) + 0.0 AS left_end, round({_loss_sql(1.0)}, 5) + 0.0 AS right_end FROM x GROUP BY 1"""
)
def distillation_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four tokens a vector: divergences times clipped ratios, at both ends of the mixture and between."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    teacher, student = (F.array(*(F.slice("e", start + 8 * k, 8) for k in range(4))) for start in (33, 1))
    new, old = F.slice("e", 1, 4), F.slice("e", 33, 4)
    return e.select("vec_id", *((F.round(S.distillation_loss(teacher, student, new, old, alpha, 1.1), 5) + 0.0).alias(name) for name, alpha in (("even", 0.5), ("tilted", 0.3), ("left_end", 0.0), ("right_end", 1.0))))


@plans.query("SELECT vec_id, list_aggregate(list_sort(embedding, 'DESC')[1:3], 'sum')::DOUBLE > 0.5 AS large, list_sort(embedding, 'DESC')[1] AS first FROM embeddings")
def top_k_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = S.top_k(F.col("embedding"), 3)
    return table(spark, sf_dir, "embeddings").select("vec_id", (F.aggregate(top, F.lit(0.0), lambda a, x: a + x) > 0.5).alias("large"), F.element_at(top, 1).alias("first"))


_ARMS_SQL = "WITH a AS (SELECT doc_id AS id, CASE WHEN (n_chars < 400) = (quality = 0) THEN 1.0 ELSE 0.25 END AS ra FROM labels JOIN documents USING (doc_id) WHERE doc_id % 10 <> 0), b AS (SELECT doc_id AS id, CASE WHEN (lang = 'en') = (quality = 1) THEN 1.0 ELSE 0.0 END AS rb, lang FROM labels JOIN documents USING (doc_id) WHERE doc_id % 10 <> 1), j AS (SELECT * FROM a JOIN b USING (id))"


def arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = table(spark, sf_dir, "labels").select("doc_id", "quality").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang"), "doc_id").withColumnRenamed("doc_id", "id")
    a = both.where("id % 10 <> 0").select("id", F.when((F.col("n_chars") < 400) == (F.col("quality") == 0), 1.0).otherwise(0.25).alias("reward"))
    b = both.where("id % 10 <> 1").select("id", F.when((F.col("lang") == "en") == (F.col("quality") == 1), 1.0).otherwise(0.0).alias("reward"))
    return bandit.common_rewards(a, b).join(both.select("id", F.concat(F.when(F.col("lang") == "de", "multi_step_").when(F.col("lang") == "fr", "abstain_").otherwise("seen_"), "lang").alias("split"), F.lit("").alias("family"), F.when(F.col("n_chars") % 3 == 0, "call_functions").otherwise("call_function").alias("expected_action")), "id")


@plans.query(_ARMS_SQL + "SELECT round(avg(greatest(ra, rb)), 6) AS oracle, round(avg((ra >= 1)::INT), 6) AS arm_a, round(avg((rb >= 1)::INT), 6) AS arm_b FROM j")
def oracle_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bandit.bounds(arms(spark, sf_dir))
    return out.select(*(F.round(c, 6).alias(c) for c in out.columns))


@plans.query(_ARMS_SQL + "SELECT lang, round(avg((ra >= 1)::INT), 6) AS arm_a, count(*) AS n FROM j GROUP BY lang")
def arm_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arms(spark, sf_dir).groupBy(F.substring_index("split", "_", -1).alias("lang")).agg(F.round(F.avg((F.col("reward_a") >= 1).cast("double")), 6).alias("arm_a"), F.count("*").alias("n"))


@plans.query(_ARMS_SQL + "SELECT id, CASE WHEN n_chars % 3 = 0 THEN 1.0 ELSE 0.0 END AS parallel, CASE WHEN j.lang = 'de' THEN 1.0 ELSE 0.0 END AS multi_step, CASE WHEN j.lang = 'fr' THEN 1.0 ELSE 0.0 END AS abstain FROM j JOIN documents ON id = doc_id")
def bandit_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bandit.features(arms(spark, sf_dir)).select("id", *(F.element_at("x", i + 1).alias(c) for i, c in enumerate(("parallel", "multi_step", "abstain"))))


@plans.query()
def linucb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit rate of the router by replica and split; sequential, so tested against a plain loop."""
    samples = bandit.features(arms(spark, sf_dir)).select("id", "split", "x", "reward_a", "reward_b")
    replicas = spark.createDataFrame([(a, s) for a in (0.5, 1.0) for s in (41, 42)], "alpha double, seed long")
    return bandit.linucb(samples, replicas).groupBy("alpha", "seed", "split").agg(F.avg("hit").alias("hit_rate"), F.count("*").alias("n"))
