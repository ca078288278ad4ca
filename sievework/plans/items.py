"""Queries over items made of texts: answers, distractors, evidence, conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions import columns as C
from sievework.operators import items as I
from sievework.session import cut


def _t(spark: SparkSession, sf_dir: str, name: str = "typed_questions") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def answer_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of tables, by what they look like as an answer."""
    cells = _t(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"\| ([^|\n\r]+) (?=\|)"), 1)).alias("cell"))
    return cells.groupBy(I.answer_type(F.col("cell")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def _examples(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Choice questions as examples, and all option texts as the pool."""
    q = _t(spark, sf_dir).where("q_type = 'choice'")
    gold = F.try_element_at(F.filter("options", lambda o: o["key"] == F.col("label_key")), F.lit(1))["text"]
    rows = q.select(F.col("row_no").alias("key"), F.col("instructions").alias("question"), gold.alias("gold"), F.coalesce("state", F.lit("")).alias("state"), F.transform("options", lambda o: o["text"]).alias("own"), "source").where("gold IS NOT NULL AND NOT exists(own, t -> t IS NULL)")
    return rows, q.select(F.explode("options").alias("o")).select("o.text")


def distractors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, pool = _examples(spark, sf_dir)
    asked = rows.select("key", "gold", "state", I.expected_type(F.col("question"), F.col("gold")).alias("kind"), F.transform("own", I.plain).alias("forbidden"), F.lit(3).alias("want"))
    got = I.distractors(asked, pool, 3).join(asked.select("key", "forbidden"), "key")
    return got.select(F.col("key").alias("row_no"), F.size(F.array_distinct("picked")).alias("picked"), F.size(F.array_intersect(F.transform("picked", I.plain), "forbidden")).alias("clashes"))


def choice_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, pool = _examples(spark, sf_dir)
    made = I.choice_items(rows.withColumn("forbidden", F.array().cast("array<string>")), pool, 6, 150, 5).join(rows.select("key", "gold"), "key")
    right = F.element_at("texts", F.regexp_extract("label", "([0-9]+)$", 1).cast("int") + 1) == F.col("gold")
    return made.select(F.col("key").alias("row_no"), "reason", F.size(F.array_distinct("texts")).alias("options"), right.alias("gold_in_place"))


def filled_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), F.posexplode(F.split("text", r"\n\s*\n")).alias("place", "text"))
    made = I.filled_state(parts.select("key", "place", F.lit(None).cast("string").alias("title"), "text", (F.col("place") % 2 == 1).alias("supporting")), 1500, 2500)
    return made.select(F.col("key").alias("doc_id"), "paragraphs", F.md5("state").alias("state"))


def without_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.without_support(_t(spark, sf_dir), "row_no", "state", "instructions", 2).select(F.col("key").alias("row_no"), "rank", "place", "score", F.md5("left").alias("left"))


def entity_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = _t(spark, sf_dir)
    return I.entity_types(I.entities(q, "row_no", "instructions"), I.common_words(q, "state")).groupBy("type", "words").agg(F.count(F.lit(1)).alias("n"))


def swapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of the first sentence of a state swapped in the whole state: how many states, of each source, and in how many the entity still stands (none may)."""
    q = _t(spark, sf_dir).withColumn("first", F.element_at(F.split(F.coalesce("state", F.lit("")), r"(?<=[.!?])\s+"), 1))
    got = I.swapped_entities(q, "row_no", "state", "first", ["source"], "group_key", 1, 9)
    still = F.regexp_like("text", F.concat(F.lit(r"(?i)(?<![\p{L}\p{N}_])\Q"), "entity", F.lit(r"\E(?![\p{L}\p{N}_])")))
    return got.join(q.select(F.col("row_no").alias("key"), "source"), "key").groupBy("source").agg(F.count(F.lit(1)).alias("states"), F.sum(still.cast("int")).alias("left"))


def out_of_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = _t(spark, sf_dir)
    got = I.out_of_scope(q, "row_no", 7)
    theirs = q.select(F.col("row_no").alias("donor"), F.coalesce("source", F.lit("")).alias("their_source"), F.col("state").alias("their_state"))
    own = q.select("row_no", F.coalesce("source", F.lit("")).alias("source"))
    return got.join(theirs, "donor").join(own, "row_no").select("row_no", ((F.col("their_source") != F.col("source")) & (F.col("state") == F.col("their_state"))).alias("fits"))


def _conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents read as conversations: a line with a tool is a call, a log line a tool's result, a line that begins with a name and a colon the user, another the agent."""
    d = _t(spark, sf_dir, "documents").select("doc_id", "lang", F.filter(F.split(F.coalesce("text", F.lit("")), r"\r?\n"), lambda s: F.trim(s) != "").alias("lines"))
    is_call = lambda s: s.rlike(r'^\{"tool": .*\}$') & F.get_json_object(s, "$.tool").isNotNull()
    name = lambda s: F.get_json_object(s, "$.tool")
    call = lambda s: F.to_json(F.struct(name(s).alias("name"), F.struct(F.get_json_object(s, "$.arg").alias("arg"), F.expr("0").alias("zero")).alias("arguments")))
    role = lambda s: F.when(is_call(s), "function_call").when(s.rlike(r"^[0-9]{2}:[0-9]{2}:[0-9]{2} "), "observation").when(s.rlike(r"^\p{Lu}\p{L}+: "), "human").otherwise("gpt")
    turns = F.transform("lines", lambda s: F.struct(role(s).alias("from"), F.when(is_call(s), call(s)).otherwise(s).alias("value")))
    names = F.array_distinct(F.transform(F.filter("lines", is_call), name))
    tools = F.to_json(F.transform(names, lambda n: F.struct(n.alias("name"), F.concat(F.lit("Tool "), n).alias("description"))))
    return cut(d.select("doc_id", F.col("lang").alias("system"), turns.alias("conversations"), tools.alias("tools")))


def tool_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = I.tool_items(_conversations(spark, sf_dir), "doc_id", "system", "conversations", "tools", 2, 20)
    return got.select(F.col("key").alias("doc_id"), "label", F.array_join("keys", "|").alias("keys"))


def action_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = I.action_items(_conversations(spark, sf_dir).withColumn("system", F.lit("Be brief.")), "doc_id", "system", "conversations")
    return got.select(F.col("key").alias("doc_id"), "label", "allowed", (F.length("state") <= 8000).alias("fits"))


def next_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = I.next_action_items(_conversations(spark, sf_dir), "doc_id", "system", "conversations", "tools")
    return got.select(F.col("key").alias("doc_id"), "reason", "label")


def argument_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _conversations(spark, sf_dir)
    return I.argument_pool(I.call_arguments(c, "doc_id", "conversations"), I.tool_enums(c, "tools"), 3)


def argument_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = I.argument_items(_conversations(spark, sf_dir), "doc_id", "conversations", "tools", 3)
    return got.select(F.col("key").alias("doc_id"), "tool", "arg", "reason", "q_type", "label", F.array_join("keys", "|").alias("keys"))


def unique_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.unique_indices(_t(spark, sf_dir).select("row_no", "source", "priority"), "source", "priority", "row_no").select("row_no", "priority")


def family_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct texts of a question and its instructions, and what it lacks."""
    gaps = I.variant_gaps({"options": F.col("options"), "levels": F.col("levels"), "augmented": F.col("augmented_options"), "teacher": F.col("teacher_probs")})
    texts = I.family_texts(F.col("state"), F.col("instructions"), F.col("state"))
    return _t(spark, sf_dir).select(F.size(texts).alias("texts"), F.array_join(gaps, ",").alias("gaps")).groupBy("texts", "gaps").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    "text_answer_types": answer_types,
    "item_distractors": distractors,
    "item_choices": choice_items,
    "item_filled_states": filled_states,
    "evidence_removed": without_support,
    "evidence_entity_types": entity_types,
    "evidence_swapped": swapped,
    "evidence_out_of_scope": out_of_scope,
    "tool_choice_items": tool_items,
    "tool_action_items": action_items,
    "tool_next_actions": next_actions,
    "tool_argument_pool": argument_pool,
    "tool_argument_items": argument_items,
    "family_indices": unique_indices,
    "family_texts": family_texts,
}


def _type(c: str) -> str:
    t = f"trim(coalesce({c}, ''))"
    titled = I._TITLED.removeprefix("(?is)").replace("'", "''")
    head = f"lower(regexp_replace(regexp_extract({t}, '{titled}', 1, 'is'), '^[ \"''(“]+|[ \"''(“]+$', '', 'g'))"
    tail = f"lower(regexp_replace(regexp_extract({t}, '{titled}', 2, 'is'), '^[ \"'').,]+|[ \"'').,]+$', '', 'g'))"
    proper = I._PROPER.replace("'", "''")
    return f"""CASE WHEN {t} = '' THEN 'empty' WHEN lower({t}) IN ('yes', 'no', 'true', 'false') THEN 'yes_no' WHEN regexp_matches({t}, '{I._NUMBER}') AND regexp_matches({t}, '{I._YEAR}') THEN 'date' WHEN regexp_matches({t}, '{I._NUMBER}') THEN 'number' WHEN regexp_matches({t}, '{I._YEAR}') AND length({t}) <= 40 THEN 'date'
        WHEN regexp_matches({t}, '{titled}', 'is') AND ({tail} = '' OR regexp_matches({tail}, '^(of|for|at) ') OR {head} IN ('the', 'a', 'an')) THEN 'title' WHEN regexp_matches({t}, '{I._any(I.PLACE_WORDS)}', 'i') THEN 'place' WHEN regexp_matches({t}, '{I._any(I.ORGANIZATION_WORDS)}', 'i') THEN 'organization' WHEN regexp_matches({t}, '{proper}') THEN 'proper' ELSE 'entity' END"""


def _plain(c: str) -> str:
    return f"lower(trim(regexp_replace(coalesce({c}, ''), '[\\s\\x{{1c}}-\\x{{1f}}\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+', ' ', 'g')))"


_KIND = "CASE " + " ".join(f"WHEN regexp_matches(lower(coalesce(instructions, '')), '{p}') THEN '{k}'" for k, p in I.EXPECTED) + f" ELSE {_type('gold')} END"
_EXAMPLES = f"""WITH e AS (SELECT *, {_KIND} AS kind, {_plain('gold')} AS g, {_plain('state')} AS s FROM (SELECT row_no, instructions, state, list_transform(options, lambda o: o.text) AS own, list_filter(options, lambda o: o.key = label_key)[1].text AS gold FROM typed_questions WHERE q_type = 'choice') WHERE gold IS NOT NULL AND len(list_filter(own, lambda t: t IS NULL)) = 0),
    pool AS (SELECT n, {_type('t')} AS kind FROM (SELECT n, min(trim(t)) AS t FROM (SELECT {_plain('t')} AS n, t FROM (SELECT unnest(options).text AS t FROM typed_questions WHERE q_type = 'choice')) WHERE n <> '' GROUP BY 1)),
    f AS (SELECT row_no, count(*) AS free FROM e JOIN pool p ON p.kind = e.kind AND length(p.n) BETWEEN 0.33 * greatest(1, length(g)) AND 3 * greatest(1, length(g)) AND NOT contains(g, p.n) AND NOT contains(p.n, g) AND NOT contains(s, p.n) AND NOT list_contains(list_transform(own, lambda t: lower(trim(t))), p.n) WHERE e.kind NOT IN ('yes_no', 'empty') GROUP BY 1)"""
# a mark after each sentence end, taken back after capitals and abbreviations
_ABBR = "|".join(I.ABBREVIATIONS)
_MARKED = f"regexp_replace(regexp_replace(regexp_replace(state, '([.!?])(\\s+)', '\\1\\2' || chr(1), 'g'), '(\\p{{Lu}}[.!?]\\s+)' || chr(1), '\\1', 'g'), '((?:^|[^A-Za-z''’\\-])(?i:{_ABBR})[.!?]\\s+)' || chr(1), '\\1', 'g')"
_STOP = "(" + ", ".join(f"'{w}'" for w in I.STOPWORDS) + ")"
_TOKENS = "list_filter(regexp_extract_all(lower({}), '([a-z0-9][a-z0-9''\\-]*)', 1), lambda t: t NOT IN " + _STOP + " AND length(t) > 1)"
_CONV = """WITH d AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(coalesce(text, ''), '\\r?\\n'), lambda s: trim(s) <> '')) AS s, generate_subscripts(list_filter(regexp_split_to_array(coalesce(text, ''), '\\r?\\n'), lambda s: trim(s) <> ''), 1) AS i FROM documents),
    r AS (SELECT doc_id, i, s, CASE WHEN regexp_matches(s, '^\\{"tool": .*\\}$') AND json_valid(s) AND (s ->> '$.tool') IS NOT NULL THEN 'function_call' WHEN regexp_matches(s, '^[0-9]{2}:[0-9]{2}:[0-9]{2} ') THEN 'observation' WHEN regexp_matches(s, '^\\p{Lu}\\p{L}+: ') THEN 'human' ELSE 'gpt' END AS role FROM d),
    c AS (SELECT *, CASE WHEN role = 'function_call' THEN trim(s ->> '$.tool') END AS tool, CASE WHEN role = 'function_call' THEN s ->> '$.arg' END AS arg FROM r)"""


def _cues(words: tuple[str, ...], c: str) -> str:
    return "(" + " OR ".join(f"contains({c}, '{w.replace(chr(39), chr(39) * 2)}')" for w in words) + ")"


_SAID = f"CASE WHEN {_cues(I.REFUSE_CUES, 'lower(trim(s))')} THEN 'refuse' WHEN ends_with(trim(s), '?') OR {_cues(I.CLARIFY_CUES, 'lower(trim(s))')} THEN 'clarify' ELSE 'answer' END"

ORACLES = {
    "text_answer_types": f"""WITH l AS (SELECT unnest(regexp_split_to_array(text, '[\\n\\r]')) AS line FROM documents), p AS (SELECT string_split(line, '|') AS p FROM l WHERE contains(line, '|')), c AS (SELECT unnest(p[2:len(p) - 1]) AS cell FROM p WHERE len(p) > 2)
        SELECT {_type('cell')} AS kind, count(*) AS n FROM c WHERE regexp_matches(cell, '^ .+ $') GROUP BY 1""",
    "item_distractors": _EXAMPLES + "SELECT row_no, CASE WHEN free >= 3 THEN 3 END AS picked, CASE WHEN free >= 3 THEN 0 END AS clashes FROM e LEFT JOIN f USING (row_no)",
    "item_choices": _EXAMPLES + f""", r AS (SELECT row_no, len(own) AS o, coalesce(free, 0) AS free, CASE WHEN length(coalesce(state, '')) < 150 THEN 'short_state' WHEN {_type('gold')} = 'yes_no' THEN 'yes_no_answer' WHEN len(own) > 6 THEN 'k_below_option_count' WHEN len(list_distinct(list_transform(own, lambda t: lower(trim(t))))) < len(own) THEN 'duplicate_options' END AS early FROM e LEFT JOIN f USING (row_no)),
        x AS (SELECT row_no, coalesce(early, CASE WHEN o < 6 AND free < 6 - o THEN 'insufficient_distractors' END) AS reason FROM r) SELECT row_no, reason, CASE WHEN reason IS NULL THEN 6 END AS options, CASE WHEN reason IS NULL THEN true END AS gold_in_place FROM x""",
    "item_filled_states": """WITH b AS (SELECT doc_id, generate_subscripts(a, 1) - 1 AS place, trim(unnest(a), ' ') AS b FROM (SELECT doc_id, regexp_split_to_array(text, '\\n\\s*\\n') AS a FROM documents)), t AS (SELECT *, sum(length(b) + 2) OVER w AS upto, row_number() OVER w AS i FROM b WHERE b <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY place % 2 DESC, place ROWS UNBOUNDED PRECEDING)),
        s AS (SELECT doc_id, min(i) AS stop FROM t WHERE i > 1 AND (upto > 2500 OR upto - length(b) - 2 >= 1500) GROUP BY 1) SELECT doc_id, count(*) AS paragraphs, md5(string_agg(b, chr(10) || chr(10) ORDER BY i)) AS state FROM t LEFT JOIN s USING (doc_id) WHERE stop IS NULL OR i < stop GROUP BY 1""",
    "evidence_removed": f"""WITH m AS (SELECT row_no, instructions, list_filter(list_transform(string_split({_MARKED}, chr(1)), lambda x: regexp_replace(x, '([.!?])\\s+$', '\\1')), lambda x: regexp_matches(x, '\\S')) AS a FROM typed_questions WHERE state IS NOT NULL), s AS (SELECT row_no, generate_subscripts(a, 1) - 1 AS place, unnest(a) AS sentence FROM m),
        t AS (SELECT row_no, place, {_TOKENS.format('sentence')} AS k FROM s), f AS (SELECT row_no, place, len(k) AS n, unnest(list_distinct(k)) AS token FROM t), i AS (SELECT token, ln(((SELECT count(*) FROM s) + 1) / (count(*) + 1)::DOUBLE) + 1 AS idf FROM f GROUP BY 1), q AS (SELECT row_no, unnest(list_distinct({_TOKENS.format('instructions')})) AS token FROM typed_questions),
        c AS (SELECT row_no, place, round(sum(idf) / sqrt(greatest(1, any_value(n))), 9) AS score FROM f JOIN q USING (row_no, token) JOIN i USING (token) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY row_no ORDER BY score DESC, place) AS rank FROM c)
        SELECT r.row_no, rank, place, score, md5(array_to_string(list_concat(a[1:place], a[place + 2:]), ' ')) AS left FROM r JOIN m USING (row_no) WHERE rank <= 2 AND len(a) >= 2""",
    "evidence_out_of_scope": "SELECT row_no, true AS fits FROM typed_questions WHERE q_type = 'noul'",
    "tool_choice_items": _CONV + ", t AS (SELECT doc_id, arg_min(tool, i) AS label, list_sort(list(DISTINCT tool)) AS k FROM c WHERE role = 'function_call' GROUP BY 1) SELECT doc_id, label, array_to_string(k, '|') AS keys FROM t WHERE len(k) BETWEEN 2 AND 20",
    "tool_action_items": _CONV + f""", a AS (SELECT *, role = 'gpt' AND length(trim(s)) <= 160 AND {_cues(I.ACK_CUES, 'lower(trim(s))')} AS ack FROM c WHERE role IN ('gpt', 'function_call')), x AS (SELECT doc_id, coalesce(min(i) FILTER (NOT ack), min(i)) AS i FROM a GROUP BY 1),
        y AS (SELECT doc_id, CASE WHEN role = 'function_call' THEN 'call_tool' WHEN ack THEN 'answer' ELSE {_SAID} END AS label FROM x JOIN a USING (doc_id, i)) SELECT doc_id, label, CASE label WHEN 'call_tool' THEN true WHEN 'refuse' THEN false END AS allowed, true AS fits FROM y""",
    "tool_next_actions": _CONV + f""", o AS (SELECT doc_id, min(i) AS i FROM (SELECT *, lag(role) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM c) WHERE role = 'observation' AND before = 'function_call' GROUP BY 1), n AS (SELECT d.doc_id, o.i, c.role, c.s, c.tool FROM (SELECT doc_id FROM documents) d LEFT JOIN o USING (doc_id) LEFT JOIN c ON c.doc_id = o.doc_id AND c.i = o.i + 1),
        x AS (SELECT *, CASE WHEN i IS NULL THEN 'no_observation' WHEN role IS NULL THEN 'no_later_action' WHEN role NOT IN ('function_call', 'gpt') THEN 'no_agent_action' END AS reason FROM n) SELECT doc_id, reason, CASE WHEN reason IS NULL THEN CASE WHEN role = 'function_call' THEN tool ELSE {_SAID} END END AS label FROM x""",
    "tool_argument_pool": _CONV + """, a AS (SELECT tool, 'arg' AS arg, 'string' AS type, arg AS value FROM c WHERE role = 'function_call' AND arg <> '' UNION ALL SELECT tool, 'zero', 'number', '0' FROM c WHERE role = 'function_call'), u AS (SELECT tool, arg, type, value, count(*) AS uses FROM a GROUP BY ALL)
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tool, arg, type ORDER BY uses DESC, value) AS rank FROM u) WHERE rank <= 3""",
    "tool_argument_items": _CONV + """, a AS (SELECT tool, 'arg' AS arg, 'choice' AS q, arg AS value FROM c WHERE role = 'function_call' AND arg <> '' UNION ALL SELECT tool, 'zero', 'choice', '0' FROM c WHERE role = 'function_call'), u AS (SELECT tool, arg, value, row_number() OVER (PARTITION BY tool, arg ORDER BY count(*) DESC, value) AS rank FROM a GROUP BY 1, 2, 3),
        f AS (SELECT doc_id, arg_min(tool, i) AS tool, arg_min(coalesce(arg, ''), i) AS v FROM c WHERE role = 'function_call' GROUP BY 1), x AS (SELECT doc_id, tool, 'arg' AS arg, v AS label FROM f WHERE v <> '' UNION ALL SELECT doc_id, tool, 'zero', '0' FROM f),
        k AS (SELECT x.doc_id, x.tool, x.arg, x.label, list(u.value ORDER BY rank) FILTER (u.value <> x.label) AS o FROM x LEFT JOIN u ON u.tool = x.tool AND u.arg = x.arg AND u.rank <= 4 GROUP BY ALL)
        SELECT doc_id, tool, arg, CASE WHEN coalesce(len(o), 0) < 1 THEN 'too_few_candidates' END AS reason, 'choice' AS q_type, label, array_to_string(list_concat([label], coalesce(o, [])[1:2]), '|') AS keys FROM k""",
    "family_indices": """WITH r AS (SELECT row_no, source, priority, row_number() OVER (PARTITION BY source, priority ORDER BY row_no) AS seen, max(priority) OVER (PARTITION BY source) AS most FROM typed_questions), a AS (SELECT row_no, coalesce(most, -1) + row_number() OVER (PARTITION BY source ORDER BY row_no) AS priority FROM r WHERE priority IS NULL OR seen > 1)
        SELECT row_no, priority FROM r WHERE priority IS NOT NULL AND seen = 1 UNION ALL SELECT row_no, CAST(priority AS INT) FROM a""",
    "family_texts": f"""SELECT len(list_distinct(list_filter([regexp_replace({_plain('state').removeprefix('lower(')[:-1]}, '', ''), {_plain('instructions').removeprefix('lower(')[:-1]}], lambda s: s <> ''))) AS texts,
        concat_ws(',', CASE WHEN options IS NULL THEN 'options' END, CASE WHEN levels IS NULL THEN 'levels' END, CASE WHEN augmented_options IS NULL THEN 'augmented' END, CASE WHEN teacher_probs IS NULL THEN 'teacher' END) AS gaps, count(*) AS n FROM typed_questions GROUP BY ALL""",
}
