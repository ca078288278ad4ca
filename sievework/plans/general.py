"""Queries over texts, events, vectors and the order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions import columns as C
from sievework.operators import relational as R
from sievework.operators import texts as X
from sievework.streaming import events as E


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pricing(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _t(spark, sf_dir, "lineitem").where("l_shipdate <= timestamp '1998-09-02'")
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base"), F.round(F.sum(net), 2).alias("sum_net"), F.round(F.avg("l_discount"), 6).alias("avg_discount"), F.count(F.lit(1)).alias("n")
    )


def revenue_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue by region, nation and order status: all their combinations."""
    region, nation, customer, orders = (_t(spark, sf_dir, t) for t in ("region", "nation", "customer", "orders"))
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.cube("r_name", "o_orderstatus").agg(F.grouping_id().alias("level"), F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def top_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("o_orderstatus").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return _t(spark, sf_dir, "orders").withColumn("rank", F.row_number().over(w)).where("rank <= 10").select("o_orderstatus", "o_orderkey", "o_totalprice", "rank")


def idle_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without a large order, by nation."""
    large = _t(spark, sf_dir, "orders").where("o_totalprice > 300000")
    return _t(spark, sf_dir, "customer").join(large, F.col("c_custkey") == F.col("o_custkey"), "left_anti").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))


def last_purchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each error event with the user's last purchase before it."""
    e = _t(spark, sf_dir, "events")
    left = e.where("event_type = 'error'").select("event_id", "user_id", "ts")
    return R.asof(left, e.where("event_type = 'purchase'"), "ts", ["user_id"], ["value"]).select("event_id", "right_value")


def donors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each question whether another of half to twice its length, of another group, was found."""
    q = _t(spark, sf_dir, "typed_questions").withColumn("len", F.length("state"))
    own = F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("group_key", F.concat(F.lit("row "), F.col("row_no").cast("string"))))
    found = R.band_donors(q, "row_no", "len", own, 0.5, 2.0, 3)
    theirs = q.select(F.col("row_no").alias("donor"), F.col("len").alias("their_len"), own.alias("theirs"))
    return found.join(theirs, "donor", "left").join(q.select("row_no", "len", own.alias("own")), "row_no").select("row_no", (F.col("donor").isNotNull() & F.col("their_len").between(F.col("len") * 0.5, F.col("len") * 2) & (F.col("own") != F.col("theirs"))).alias("found"))


def nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _t(spark, sf_dir, "embeddings")
    return R.nearest_vectors(v, v.where("vec_id % 100 = 0")).select("query_id", "id", "rank", F.round("cosine", 6).alias("cosine"))


def softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _t(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("l"))
    p = v.withColumn("p", C.softmax(F.col("l"), 0.5))
    return p.select("vec_id", C.argmax(F.col("p")).alias("top"), F.round(F.array_max("p"), 9).alias("confidence"), F.round(C.margin(F.col("p")), 9).alias("margin"), F.array_join(F.transform(C.ranked(F.col("p")), lambda i: i.cast("string")), ",").alias("ranking"))


def stub(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = _t(spark, sf_dir, "typed_questions").where("q_type = 'choice'")
    keys = F.transform("options", lambda o: o["key"])
    s = R.stub_scores(q.select("row_no", keys.alias("keys")), "row_no", F.col("keys"))
    return s.select("row_no", F.element_at("keys", C.argmax(F.col("probs")) + 1).alias("answer"), F.round(F.array_max("probs"), 9).alias("confidence"))


def windows_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = E.windowed(_t(spark, sf_dir, "events"))
    return w.select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", F.round("mean", 6).alias("mean"))


def windows_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = E.drained(E.windowed(E.stream(spark, f"{sf_dir}/events.parquet")), "complete")
    return w.select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", F.round("mean", 6).alias("mean"))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = E.sessions(_t(spark, sf_dir, "events"))
    return s.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.max("n").alias("longest"))


def streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = E.drained(E.stream(spark, f"{sf_dir}/events.parquet").select("user_id", "ts", "event_id", "event_type"))
    return E.error_streaks(events).groupBy("user_id").agg(F.count(F.lit(1)).alias("streaks"), F.max("streak").alias("longest"))


def deduplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = E.drained(E.deduplicated(E.stream(spark, f"{sf_dir}/events.parquet"), ["event_id"], "1 hour"))
    return d.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"))


def revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that differ between the two lines of ids that two corpora share."""
    q = _t(spark, sf_dir, "typed_questions")
    first = lambda corpus: q.where(F.col("corpus") == corpus).groupBy("id").agg(*(F.min_by(c, "row_no").alias(c) for c in ("q_type", "label_key", "split")))
    a, b = first("typed_main"), first("typed_extra")
    shared = a.select("id").join(b.select("id"), "id")
    return R.changed_fields(a.join(shared, "id", "left_semi"), b.join(shared, "id", "left_semi"), "id", ["q_type", "label_key", "split"]).groupBy("field").agg(F.count(F.lit(1)).alias("n"))


def redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with what looks like a path below a root taken out, and how many such there were."""
    d = _t(spark, sf_dir, "documents").where("text IS NOT NULL")
    roots = ("/home", "/Users", "/mnt", "/root", " /")
    return d.select("doc_id", F.md5(C.redacted(F.col("text"), roots)).alias("text"), F.size(C.absolute_paths(F.col("text"))).alias("paths"), C.slug("source").alias("slug"))


QUERIES = {
    "pricing_summary": pricing, "revenue_cube": revenue_cube, "top_orders": top_orders, "idle_customers": idle_customers,
    "asof_last_purchase": last_purchase, "band_join_donors": donors, "vectors_nearest": nearest, "vectors_softmax": softmax, "scores_stub": stub,
    "event_windows": windows_batch, "event_windows_stream": windows_stream, "event_sessions": sessions, "event_streaks_stream": streaks, "event_dedup_stream": deduplicated,
    "revised_fields": revisions,
    "text_support_sentences": lambda spark, sf_dir: X.support_sentences(_t(spark, sf_dir, "typed_questions"), "row_no", "state", "instructions"),
    "text_filled_paragraphs": lambda spark, sf_dir: X.filled_paragraphs(_t(spark, sf_dir, "documents"), "doc_id", "text", 1500, 2500),
    "text_tool_calls": lambda spark, sf_dir: X.tool_calls(_t(spark, sf_dir, "documents"), "doc_id", "text"),
    "text_argument_pool": lambda spark, sf_dir: X.argument_pool(X.tool_calls(_t(spark, sf_dir, "documents"), "doc_id", "text"), 5),
    "text_turns": lambda spark, sf_dir: X.turns(_t(spark, sf_dir, "documents"), "doc_id", "text").groupBy("id").agg(F.count(F.lit(1)).alias("turns"), F.max("gap").alias("longest_gap")),
    "text_redacted": redacted,
}

_CALLS = """WITH l AS (SELECT doc_id AS id, regexp_extract_all(text, '(\\{"tool": [^\\n\\r]*\\})', 1) AS calls FROM documents), u AS (SELECT id, generate_subscripts(calls, 1) - 1 AS place, unnest(calls) AS call FROM l),
    c AS (SELECT id, place, call ->> '$.tool' AS tool, call ->> '$.arg' AS arg, try_cast(call ->> '$.n' AS BIGINT) AS n FROM u WHERE json_valid(call) AND (call ->> '$.tool') IS NOT NULL)"""
_SENT = """WITH s AS (SELECT row_no AS id, instructions, unnest(regexp_split_to_array(regexp_replace(state, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))) AS sentence, generate_subscripts(regexp_split_to_array(regexp_replace(state, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), 1) - 1 AS place FROM typed_questions),
    t AS (SELECT id, place, list_distinct(regexp_extract_all(lower(sentence), '([a-z0-9]+)', 1)) AS tokens FROM s WHERE trim(sentence) <> ''), k AS (SELECT * FROM t WHERE len(tokens) > 0),
    f AS (SELECT id, place, len(tokens) AS n, unnest(tokens) AS token FROM k), i AS (SELECT token, ln(((SELECT count(*) FROM k) + 1) / (count(*) + 1)::DOUBLE) + 1 AS idf FROM f GROUP BY 1),
    q AS (SELECT row_no AS id, unnest(list_distinct(regexp_extract_all(lower(instructions), '([a-z0-9]+)', 1))) AS token FROM typed_questions),
    r AS (SELECT id, place, round(sum(idf) / sqrt(any_value(n)), 9) AS score FROM f JOIN q USING (id, token) JOIN i USING (token) GROUP BY 1, 2)"""

ORACLES = {
    "pricing_summary": """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_net, round(avg(l_discount), 6) AS avg_discount, count(*) AS n
        FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""",
    "revenue_cube": """SELECT r_name, o_orderstatus, grouping(r_name, o_orderstatus) AS level, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY CUBE (r_name, o_orderstatus)""",
    "top_orders": "SELECT o_orderstatus, o_orderkey, o_totalprice, rank FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 10",
    "idle_customers": "SELECT c_nationkey, count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000) GROUP BY 1",
    "asof_last_purchase": "SELECT l.event_id, r.value AS right_value FROM (SELECT * FROM events WHERE event_type = 'error') l ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY 1, 2) r ON l.user_id = r.user_id AND l.ts >= r.ts",
    "band_join_donors": """WITH t AS (SELECT row_no, length(state) AS len, coalesce(source, '') || '/' || coalesce(group_key, 'row ' || row_no) AS own FROM typed_questions WHERE length(state) >= 1) SELECT row_no, EXISTS (SELECT 1 FROM t b WHERE b.own <> a.own AND b.len BETWEEN a.len * 0.5 AND a.len * 2) AS found FROM t a""",
    "vectors_nearest": """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), c AS (SELECT q.vec_id AS query_id, v.vec_id AS id, list_dot_product(q.e, v.e) / sqrt(list_dot_product(q.e, q.e)) / sqrt(list_dot_product(v.e, v.e)) AS cosine FROM v q JOIN v ON q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id)
        SELECT query_id, id, rank, round(cosine, 6) AS cosine FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(cosine, 12) DESC, id) AS rank FROM c) WHERE rank <= 5""",
    "vectors_softmax": """WITH l AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / 0.5::DOUBLE) AS l FROM embeddings), p AS (SELECT vec_id, list_transform(l, lambda x: exp(x - list_max(l)) / list_sum(list_transform(l, lambda y: exp(y - list_max(l))))) AS p FROM l)
        SELECT vec_id, list_position(p, list_max(p)) - 1 AS top, round(list_max(p), 9) AS confidence, round(list_reverse_sort(p)[1] - list_reverse_sort(p)[2], 9) AS margin,
        array_to_string(list_transform(list_sort(list_transform(range(len(p)), lambda i: {'v': -p[i + 1], 'i': i})), lambda s: CAST(s.i AS VARCHAR)), ',') AS ranking FROM p""",
    "scores_stub": """WITH o AS (SELECT row_no, generate_subscripts(options, 1) AS i, unnest(options).key AS key FROM typed_questions WHERE q_type = 'choice'), w AS (SELECT *, 1 + ('0x' || substr(md5(row_no || '|' || key), 1, 4))::BIGINT AS w FROM o)
        SELECT row_no, arg_max(key, (w, -i)) AS answer, round(max(w) / sum(w)::DOUBLE, 9) AS confidence FROM w GROUP BY 1""",
    "event_windows": "SELECT strftime(time_bucket(INTERVAL '1 hour', ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2",
    "event_windows_stream": "SELECT strftime(time_bucket(INTERVAL '1 hour', ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2",
    "event_sessions": """WITH g AS (SELECT user_id, ts, CAST(coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL '30 minutes', true) AS INT) AS new FROM events), s AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g), n AS (SELECT user_id, s, count(*) AS n FROM s GROUP BY 1, 2)
        SELECT user_id, count(*) AS sessions, max(n) AS longest FROM n GROUP BY 1""",
    "event_streaks_stream": """WITH o AS (SELECT user_id, event_type, row_number() OVER w AS i, row_number() OVER (PARTITION BY user_id, event_type = 'error' ORDER BY ts, event_id) AS j, count(*) OVER (PARTITION BY user_id) AS total FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        r AS (SELECT user_id, i - j AS run, count(*) AS n, max(i) AS last, any_value(total) AS total FROM o WHERE event_type = 'error' GROUP BY 1, 2) SELECT user_id, count(*) AS streaks, max(n) AS longest FROM r WHERE n >= 3 AND last < total GROUP BY 1""",
    "event_dedup_stream": "SELECT event_type, count(DISTINCT event_id) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1",
    "revised_fields": """WITH f AS (SELECT corpus, id, arg_min_null(q_type, row_no) AS q_type, arg_min_null(label_key, row_no) AS label_key, arg_min_null(split, row_no) AS split FROM typed_questions GROUP BY 1, 2),
        j AS (SELECT a.q_type AS q1, b.q_type AS q2, a.label_key AS l1, b.label_key AS l2, a.split AS s1, b.split AS s2 FROM f a JOIN f b ON a.id = b.id AND a.corpus = 'typed_main' AND b.corpus = 'typed_extra'),
        u AS (SELECT 'q_type' AS field FROM j WHERE q1 IS DISTINCT FROM q2 UNION ALL SELECT 'label_key' FROM j WHERE l1 IS DISTINCT FROM l2 UNION ALL SELECT 'split' FROM j WHERE s1 IS DISTINCT FROM s2) SELECT field, count(*) AS n FROM u GROUP BY 1""",
    "text_support_sentences": _SENT + "SELECT id, place, score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, place) AS i FROM r) WHERE i = 1",
    "text_filled_paragraphs": """WITH b AS (SELECT doc_id AS id, unnest(regexp_split_to_array(text, '\\n\\s*\\n')) AS block, generate_subscripts(regexp_split_to_array(text, '\\n\\s*\\n'), 1) AS place FROM documents), l AS (SELECT id, place, length(trim(block, ' ')) AS len FROM b),
        t AS (SELECT id, len, sum(len + 2) OVER w AS upto, row_number() OVER w AS i FROM l WHERE len > 0 WINDOW w AS (PARTITION BY id ORDER BY place ROWS UNBOUNDED PRECEDING))
        SELECT id, count(*) AS paragraphs, CAST(sum(len + 2) AS BIGINT) AS chars FROM t WHERE upto - len - 2 < 1500 AND (i = 1 OR upto <= 2500) GROUP BY 1""",
    "text_tool_calls": _CALLS + "SELECT * FROM c",
    "text_argument_pool": _CALLS + "SELECT tool, arg, uses, rank FROM (SELECT tool, arg, count(*) AS uses, row_number() OVER (PARTITION BY tool ORDER BY count(*) DESC, arg) AS rank FROM c WHERE arg IS NOT NULL GROUP BY 1, 2) WHERE rank <= 5",
    "text_turns": """WITH l AS (SELECT doc_id AS id, regexp_extract_all(text, '([0-9]{2}:[0-9]{2}:[0-9]{2} [A-Z]{2}-[0-9]{4})', 1) AS l FROM documents), u AS (SELECT id, generate_subscripts(l, 1) AS place, unnest(l) AS x FROM l),
        s AS (SELECT id, place, CAST(x[1:2] AS INT) * 3600 + CAST(x[4:5] AS INT) * 60 + CAST(x[7:8] AS INT) AS s FROM u), g AS (SELECT id, s - lag(s) OVER (PARTITION BY id ORDER BY place) AS gap FROM s)
        SELECT id, count(*) AS turns, max(gap) AS longest_gap FROM g GROUP BY 1""",
    "text_redacted": "SELECT doc_id, md5(regexp_replace(text, '(/home|/Users|/mnt|/root| /)(/[\\w.\\-]+)+', '<path>', 'g')) AS text, len(regexp_extract_all(text, '(/(?:[\\w.\\-]+/)+[\\w.\\-]+)', 1)) AS paths, regexp_replace(regexp_replace(lower(source), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM documents WHERE text IS NOT NULL",
}
