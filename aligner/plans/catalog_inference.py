"""Queries: batch inference preparation and output validation."""

import json

from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from aligner.operators import inference as inf
from aligner.plans.registry import query

_COUNTER = StructType([StructField("k", LongType())])
_PROFILE_SCHEMA = {
    "type": "object", "required": ["core_concept", "k"],
    "properties": {"core_concept": {"type": "string"}, "k": {"type": "integer"}, "tags": {"type": "array", "items": {"type": "string"}}},
}


@query("compose_prompt", """SELECT conv_id, turn, concat_ws(chr(10) || chr(10), nullif(role, 'system'), text) AS prompt FROM {conversations}""")
def _compose(w):
    fields = [F.when(F.col("role") == "system", "").otherwise(F.col("role")), F.lit(""), F.col("text"), F.lit(None).cast("string")]
    return w.conversations.select("conv_id", "turn", inf.compose_prompt(fields).alias("prompt"))


@query("render_prompt", """SELECT conv_id, turn, replace(replace('Role {{role}}: {{text}} ({{missing}})', '{{role}}',
    CASE WHEN turn % 3 = 0 THEN '{{text}}' ELSE role END), '{{text}}', text) AS prompt FROM {conversations}""")
def _render(w):
    role = F.when(F.col("turn") % 3 == 0, "{{text}}").otherwise(F.col("role"))
    return w.conversations.select("conv_id", "turn", inf.render_prompt(
        F.lit("Role {{role}}: {{text}} ({{missing}})"), {"role": role, "text": F.col("text")}).alias("prompt"))


@query("prompt_checks", """SELECT conv_id, turn, contains(p, text) AS has_query, length(p) AS n_chars,
    array_to_string(regexp_extract_all(p, '\\{\\{(\\w+)\\}\\}', 1), ',') AS unresolved
  FROM (SELECT conv_id, turn, text, concat('Look at ', CASE WHEN turn % 2 = 0 THEN text ELSE role END, ' {{a}} {{b_1}}') AS p FROM {conversations})""")
def _checks(w):
    prompt = F.concat(F.lit("Look at "), F.when(F.col("turn") % 2 == 0, F.col("text")).otherwise(F.col("role")), F.lit(" {{a}} {{b_1}}"))
    checked = w.conversations.select("conv_id", "turn", inf.prompt_checks(prompt, F.col("text")).alias("c"))
    return checked.select("conv_id", "turn", "c.has_query", "c.n_chars", F.array_join("c.unresolved", ",").alias("unresolved"))


_TAIL = inf.DIRECT_PROMPT_TAIL.replace("'", "''")


@query("direct_prompt_messages", f"""SELECT conv_id, turn,
    concat('{inf.DIRECT_PROMPT_HEAD}', chr(10), chr(10), concat_ws(chr(10),
      CASE WHEN turn % 2 = 0 THEN concat('PROJECT CONTEXT:', chr(10), role) END, concat('USER INSTRUCTIONS:', chr(10), 'Translate'),
      CASE WHEN role = 'assistant' THEN concat('Current output value: ', role) END), chr(10), chr(10), '{_TAIL}') AS system,
    concat('Input: ', text, CASE WHEN role = 'assistant' THEN concat(chr(10), 'Current output: ', role) ELSE '' END) AS user
  FROM {{conversations}}""")
def _direct(w):
    context = F.when(F.col("turn") % 2 == 0, F.col("role"))
    current = F.when(F.col("role") == "assistant", F.col("role")).otherwise("")
    msg = inf.direct_prompt_messages(F.col("text"), F.lit("Translate"), context, current)
    return w.conversations.select("conv_id", "turn", msg.alias("m")).select("conv_id", "turn", "m.system", "m.user")


@query("token_budget", r"""SELECT doc_id, round(n * 1.3, 4) AS estimated_tokens, n * 1.3 > 1000 AS rejected
  FROM (SELECT doc_id, len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) AS n FROM {documents})""")
def _budget(w):
    docs = w.documents.select("doc_id", F.col("text").alias("prompt"))
    return inf.token_budget(docs, limit=1000).select("doc_id", F.round("estimated_tokens", 4).alias("estimated_tokens"), "rejected")


def _echo(prompts, **options):
    """Deterministic stand-in for a model: valid JSON, wrong type, broken JSON or fixed on repair."""
    def answer(p):
        n = len(p)
        if inf.REPAIR_HEAD in p or n % 4 == 0:
            return json.dumps({"core_concept": options.get("model", "m"), "k": n})
        return ['{"core_concept": 7}', '{"core_concept": "x", "k": 1, "tags": ["a", 2]}', "no json"][n % 4 - 1]
    return [answer(p) for p in prompts]


@query("batch_infer", """SELECT conv_id, turn, CASE length(text) % 4
    WHEN 0 THEN concat('{"core_concept": "stub", "k": ', length(text), '}') WHEN 1 THEN '{"core_concept": 7}'
    WHEN 2 THEN '{"core_concept": "x", "k": 1, "tags": ["a", 2]}' ELSE 'no json' END AS response FROM {conversations}""")
def _infer(w):
    prompts = w.conversations.select("conv_id", "turn", F.col("text").alias("prompt"))
    return inf.batch_infer(prompts, _echo, model="stub", temperature=0.0).drop("prompt")


@query("parse_response", """SELECT event_id, CASE WHEN json_valid(r) THEN 'ok' ELSE 'json_parse_failed' END AS parse_status,
    CASE WHEN json_valid(r) THEN CAST(json_extract_string(r, '$.k') AS BIGINT) END AS k
  FROM (SELECT event_id, CASE WHEN event_id % 9 = 0 THEN substr(props, 1, 5) ELSE props END AS r FROM {events})""")
def _parse(w):
    raw = w.events.select("event_id", F.when(F.col("event_id") % 9 == 0, F.substring("props", 1, 5)).otherwise(F.col("props")).alias("response"))
    return inf.parse_response(raw, _COUNTER).select("event_id", "parse_status", "parsed.k")


@query("schema_errors", """SELECT conv_id, turn, CASE length(text) % 4 WHEN 0 THEN ''
    WHEN 1 THEN concat('- core_concept: expected type string, got int', chr(10), '- k: required property is missing')
    WHEN 2 THEN '- tags/1: expected type string, got int' ELSE '- (root): Response was not valid JSON.' END AS errors FROM {conversations}""")
def _schema(w):
    prompts = w.conversations.select("conv_id", "turn", F.col("text").alias("prompt"))
    answers = inf.batch_infer(prompts, _echo)
    return answers.select("conv_id", "turn", inf.error_bullets(inf.schema_errors("response", _PROFILE_SCHEMA)).alias("errors"))


@query("unwrap_single", """SELECT event_id, CASE event_id % 3 WHEN 2 THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM {events}""")
def _unwrap(w):
    wrapped = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("[1, "), F.col("props"), F.lit("]"))).when(
        F.col("event_id") % 3 == 1, F.col("props")).otherwise("[]")
    return w.events.select("event_id", inf.unwrap_single(wrapped, _COUNTER).alias("o")).select("event_id", "o.k")


@query("repair_queue", """SELECT conv_id, turn, CASE WHEN length(text) % 4 = 0 THEN 1 ELSE 2 END AS attempts, 'ok' AS status FROM {conversations}""")
def _repair(w):
    prompts = w.conversations.select("conv_id", "turn", F.col("text").alias("prompt"))
    return inf.infer_with_repair(prompts, _echo, _PROFILE_SCHEMA).select("conv_id", "turn", "attempts", "status")


@query("finish_reason_norm", """SELECT event_id, CASE WHEN r IS NULL OR r = '' THEN 'unknown'
    WHEN p = 'anthropic' THEN CASE r WHEN 'max_tokens' THEN 'length' WHEN 'end_turn' THEN 'stop' ELSE r END
    ELSE CASE r WHEN 'tool_calls' THEN 'tool_use' ELSE r END END AS reason
  FROM (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'anthropic' ELSE 'other' END AS p,
    CASE event_type WHEN 'view' THEN 'max_tokens' WHEN 'click' THEN 'end_turn' WHEN 'purchase' THEN 'tool_calls' WHEN 'signup' THEN NULL ELSE '' END AS r FROM {events})""")
def _finish(w):
    t = F.col("event_type")
    reason = F.when(t == "view", "max_tokens").when(t == "click", "end_turn").when(t == "purchase", "tool_calls").when(t == "signup", None).otherwise("")
    provider = F.when(F.col("event_id") % 2 == 0, "anthropic").otherwise("other")
    return w.events.select("event_id", inf.normalized_finish_reason(provider, reason).alias("reason"))


@query("usage_accounting", """WITH u AS (SELECT conv_id AS trace_id, role AS step, turn AS seq, n_chars FROM (SELECT conv_id, role, turn, length(text) AS n_chars FROM {conversations})),
  l AS (SELECT trace_id, step, arg_max(n_chars, seq) AS n_chars FROM u GROUP BY trace_id, step)
  SELECT step, concat('model-', trace_id % 3) AS model, count(*) AS calls, CAST(sum(n_chars) AS BIGINT) AS input_tokens,
    CAST(sum(CASE WHEN n_chars % 2 = 0 THEN 0 ELSE n_chars // 2 END) AS BIGINT) AS output_tokens,
    CAST(sum(CASE WHEN n_chars % 5 = 0 THEN n_chars END) AS BIGINT) AS reasoning_tokens, round(sum(n_chars * 0.25), 2) AS cost_usd FROM l GROUP BY ALL""")
def _usage(w):
    n = F.col("n_chars").cast("long")
    usage = w.v_batches.select(
        F.col("batch_id").alias("trace_id"), F.col("role").alias("step"), F.col("turn").alias("seq"),
        F.concat(F.lit("model-"), (F.col("batch_id") % 3).cast("string")).alias("model"), n.alias("input"),
        F.when(n % 2 != 0, F.floor(n / 2)).alias("output"), F.when(n % 5 == 0, n).alias("reasoning"), (n * 0.25).alias("cost_usd"))
    return inf.usage_accounting(inf.last_usage_per_step(usage)).withColumn("cost_usd", F.round("cost_usd", 2))
