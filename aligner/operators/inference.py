"""Batch inference: prompt composition, model application, output validation, repair rounds, usage accounting.

The model itself is the caller's function ``infer(prompts, **options) -> responses``; it runs once per Arrow batch inside
the tasks, so a client can be opened per partition. Results of a round are staged before they are read twice, so no
prompt is sent to the model again because of a second use of its answer.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from aligner.session import stage

Infer = Callable[..., Sequence[str]]

# Prompt fields in order, message texts, limits and code tables.
PROMPT_FIELDS = ["persona", "task_intent", "problem_description", "instruction", "thinking_style", "answer_format"]
DIRECT_PROMPT_HEAD = "You are a helpful assistant that processes text according to user instructions."
DIRECT_PROMPT_TAIL = """For the given input, apply the user's instructions and return a JSON object:
{
    "output": "the processed/transformed result",
    "confidence": 0.0-1.0,
    "reasoning": "brief explanation of what you did"
}

Return ONLY valid JSON."""
REPAIR_HEAD = "Your previous response did not satisfy the required JSON schema:"
REPAIR_TAIL = "Reply with ONLY corrected JSON that satisfies the schema — no prose, no code fences."
NOT_JSON = "Response was not valid JSON."
TOKENS_PER_WORD = 1.3
TOKEN_LIMIT = 100_000
MAX_SCHEMA_ERRORS = 8
REPAIR_ROUNDS = 2
FINISH_REASONS = {"end_turn": "stop", "stop_sequence": "stop", "max_tokens": "length", "tool_use": "tool_use"}
FINISH_REASONS_OPENAI = {"tool_calls": "tool_use"}
ANTHROPIC_STYLE = "anthropic"


# ---------------------------------------------------------------- prompts

def compose_prompt(fields: Sequence[Column]) -> Column:
    """Prompt fields joined by a blank line, empty and null ones skipped."""
    return F.concat_ws("\n\n", *[F.nullif(f, F.lit("")) for f in fields])


def render_prompt(template: Column, values: dict[str, Column]) -> Column:
    """Replace ``{{name}}`` one name after the other, so a value may bring in a later placeholder."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{{" + name + "}}"), value.cast("string"))
    return template


def prompt_checks(prompt: Column, query: Column) -> Column:
    """Whether the query made it into the prompt, the prompt's length, and placeholders left over."""
    return F.struct(
        F.contains(prompt, query).alias("has_query"), F.length(prompt).alias("n_chars"),
        F.regexp_extract_all(prompt, F.lit(r"\{\{(\w+)\}\}"), F.lit(1)).alias("unresolved"))


def direct_prompt_messages(query: Column, user_prompt: Column, project_context: Column, current_output: Column) -> Column:
    """System and user text of a direct prompt; missing sections are left out."""
    given = lambda c: c.isNotNull() & (c != "")
    sections = F.concat_ws(
        "\n", F.when(given(project_context), F.concat(F.lit("PROJECT CONTEXT:\n"), project_context)),
        F.concat(F.lit("USER INSTRUCTIONS:\n"), user_prompt),
        F.when(given(current_output), F.concat(F.lit("Current output value: "), current_output)))
    user = F.concat_ws("\n", F.concat(F.lit("Input: "), query),
                       F.when(given(current_output), F.concat(F.lit("Current output: "), current_output)))
    return F.struct(F.concat_ws("\n\n", F.lit(DIRECT_PROMPT_HEAD), sections, F.lit(DIRECT_PROMPT_TAIL)).alias("system"),
                    user.alias("user"))


def token_estimate(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")) * TOKENS_PER_WORD


def token_budget(prompts: DataFrame, prompt: str = "prompt", limit: float = TOKEN_LIMIT) -> DataFrame:
    """Prompts with their estimated tokens and whether they are rejected as too long."""
    return prompts.withColumn("estimated_tokens", token_estimate(F.col(prompt))).withColumn(
        "rejected", F.col("estimated_tokens") > limit)


# ---------------------------------------------------------------- model calls

def batch_infer(df: DataFrame, infer: Infer, prompt: str = "prompt", response: str = "response", **options) -> DataFrame:
    """Rows with the model's answer to ``prompt``; ``options`` (provider, model, temperature, ...) go to ``infer``."""
    schema = StructType([*df.schema.fields, StructField(response, StringType())])

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(**{response: list(infer(batch[prompt].tolist(), **options))})

    return df.mapInPandas(apply, schema)


def parse_response(df: DataFrame, schema: StructType, response: str = "response") -> DataFrame:
    """Typed ``parsed`` and ``parse_status``; text that is not JSON is ``json_parse_failed``."""
    full = StructType([*schema.fields, StructField("_corrupt", StringType())])
    parsed = F.from_json(F.col(response), full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    valid = F.try_parse_json(F.col(response)).isNotNull()
    return df.withColumn("parsed", F.when(valid, parsed)).withColumn(
        "parse_status", F.when(valid, "ok").otherwise("json_parse_failed"))


def unwrap_single(response: Column, schema: StructType) -> Column:
    """The object itself, or the first object of an array wrapped around it, or an object without values."""
    trimmed = F.ltrim(response)
    listed = F.from_json(response, ArrayType(StringType()))
    objects = F.filter(listed, lambda x: F.ltrim(x).startswith("{"))
    inner = F.coalesce(F.get(objects, 0), F.lit("{}"))
    return F.from_json(F.when(trimmed.startswith("["), inner).otherwise(response), schema)


# ---------------------------------------------------------------- schema validation

# Names of the kinds in messages, the kinds each JSON Schema type accepts, and the messages.
KIND_NAMES = {"OBJECT": "dict", "ARRAY": "list", "STRING": "str", "BOOLEAN": "bool", "BIGINT": "int", "VOID": "NoneType"}
ACCEPTED_KINDS = {
    "object": ["dict"], "array": ["list"], "string": ["str"], "number": ["int", "float"], "integer": ["int"], "boolean": ["bool"],
    "null": ["NoneType"],
}
WRONG_TYPE = "expected type {names}, got "
MISSING_PROPERTY = "required property is missing"
_ERRORS = "array<struct<path:array<string>,message:string>>"


def _kind(value: Column) -> Column:
    """Kind of a variant: an integer is a number without a fractional part in its text."""
    schema = F.schema_of_variant(value)
    named = F.create_map(*[F.lit(x) for kv in KIND_NAMES.items() for x in kv])
    return F.when(schema.rlike(r"^DECIMAL\(\d+,0\)"), "int").otherwise(
        F.coalesce(F.try_element_at(named, F.regexp_extract(schema, "^[A-Z]+", 0)), F.lit("float")))


def _shown(value: Column, kind: Column) -> Column:
    """A value as messages show it: texts quoted, the constants capitalised, anything else as JSON."""
    text = F.try_variant_get(value, "$", "string")
    quote = F.when(F.contains(text, F.lit("'")) & ~F.contains(text, F.lit('"')), F.lit('"')).otherwise(F.lit("'"))
    return (F.when(kind == "str", F.concat(quote, text, quote)).when(kind == "NoneType", "None")
            .when(kind == "bool", F.initcap(text)).otherwise(F.to_json(value)))


def _errors(path: Column, message: Column) -> Column:
    return F.array(F.struct(path.alias("path"), message.alias("message"))).cast(_ERRORS)


def _checked(rule: dict, value: Column, path: Column) -> Column:
    """Expression of all violations of a rule by a variant. The schema is walked once, while the plan is built; a value of the wrong type
    is not looked into."""
    none = F.array().cast(_ERRORS)
    kind = _kind(value)
    parts = [none]
    if rule.get("enum") is not None:
        allowed = [json.dumps(v, separators=(",", ":")) for v in rule["enum"]]
        equal = F.coalesce(F.to_json(value), F.lit("null")).isin(allowed)
        message = F.concat(F.lit("value "), _shown(value, kind), F.lit(f" is not one of {rule['enum']}"))
        parts.append(F.when(equal, none).otherwise(_errors(path, message)))
    held = {key: F.try_variant_get(value, f'$["{key}"]', "variant") for key in (*rule.get("required", ()), *rule.get("properties", ()))}
    below = {key: F.concat(path, F.array(F.lit(key))) for key in held}
    for key in rule.get("required", ()):
        parts.append(F.when((kind == "dict") & held[key].isNull(), _errors(below[key], F.lit(MISSING_PROPERTY))).otherwise(none))
    for key, sub in rule.get("properties", {}).items():
        parts.append(F.when(held[key].isNotNull(), _checked(sub, held[key], below[key])).otherwise(none))
    if isinstance(rule.get("items"), dict):
        items = F.coalesce(F.try_variant_get(value, "$", "array<variant>"), F.array().cast("array<variant>"))
        each = F.transform(items, lambda item, i: _checked(
            rule["items"], F.coalesce(item, F.parse_json(F.lit("null"))), F.concat(path, F.array(i.cast("string")))))
        parts.append(F.flatten(each))
    inner = F.concat(*parts)
    names = [rule["type"]] if isinstance(rule.get("type"), str) else rule.get("type")
    if names is None or not set(names) <= set(ACCEPTED_KINDS):
        return inner
    fits = kind.isin([k for n in names for k in ACCEPTED_KINDS[n]])
    return F.when(fits, inner).otherwise(_errors(path, F.concat(F.lit(WRONG_TYPE.format(names=" | ".join(names))), kind)))


def schema_errors(response: Column | str, schema: dict) -> Column:
    """Violations of type, enum, required, properties and items as ``array<struct<path, message>>``, path-sorted, the first eight.

    A null answer counts as JSON null. An object that repeats a key is no valid JSON.
    """
    text = F.coalesce(F.col(response) if isinstance(response, str) else response, F.lit("null"))
    value = F.try_parse_json(text)
    found = F.slice(F.array_sort(_checked(schema, value, F.array().cast("array<string>"))), 1, MAX_SCHEMA_ERRORS)
    named = F.transform(found, lambda e: F.struct(
        F.when(F.size(e["path"]) == 0, "(root)").otherwise(F.array_join(e["path"], "/")).alias("path"), e["message"].alias("message")))
    broken = F.array(F.struct(F.lit("(root)").alias("path"), F.lit(NOT_JSON).alias("message")))
    return F.when(value.isNull(), broken).otherwise(named)


def error_bullets(errors: Column) -> Column:
    return F.array_join(F.transform(errors, lambda e: F.concat(F.lit("- "), e["path"], F.lit(": "), e["message"])), "\n")


def repair_prompt(prompt: Column, response: Column, errors: Column) -> Column:
    """Follow-up prompt: the conversation so far, the bad answer and what was wrong with it."""
    return F.concat_ws("\n\n", prompt, response, F.concat_ws("\n", F.lit(REPAIR_HEAD), error_bullets(errors), F.lit(REPAIR_TAIL)))


def infer_with_repair(df: DataFrame, infer: Infer, schema: dict, rounds: int = REPAIR_ROUNDS, prompt: str = "prompt",
                      **options) -> DataFrame:
    """Model answers checked against the schema; invalid ones are asked again, at most ``rounds`` times.

    Adds ``response``, ``errors``, ``attempts`` and ``status`` (ok / json_parse_failed / schema_validation_failed).
    The number of rounds is fixed, so the loop only builds the plan of each round.
    """
    def answered(asked: DataFrame, attempt: int) -> DataFrame:
        out = batch_infer(asked, infer, "_ask", **options)
        return stage(out.withColumn("errors", schema_errors("response", schema)).withColumn("attempts", F.lit(attempt)), "inference")

    current = answered(df.withColumn("_ask", F.col(prompt)), 1)
    done = None
    for attempt in range(2, rounds + 2):
        valid = current.filter(F.size("errors") == 0)
        done = valid if done is None else done.unionByName(valid)
        invalid = current.filter(F.size("errors") > 0).withColumn("_ask", repair_prompt(F.col("_ask"), F.col("response"), F.col("errors")))
        current = answered(invalid.drop("response", "errors", "attempts"), attempt)
    result = current if done is None else done.unionByName(current)
    not_json = F.exists("errors", lambda e: e["message"] == NOT_JSON)
    status = F.when(F.size("errors") == 0, "ok").when(not_json, "json_parse_failed").otherwise("schema_validation_failed")
    return result.withColumn("status", status).drop("_ask")


# ---------------------------------------------------------------- accounting

def normalized_finish_reason(provider: Column, reason: Column) -> Column:
    """Provider codes as length / stop / tool_use / ...; codes not in the table stay, a missing one is unknown."""
    def mapped(table: dict[str, str]) -> Column:
        pairs = [F.lit(x) for kv in table.items() for x in kv]
        return F.coalesce(F.try_element_at(F.create_map(*pairs), reason), F.nullif(reason, F.lit("")), F.lit("unknown"))

    return F.when(reason.isNull(), F.lit("unknown")).when(
        provider == ANTHROPIC_STYLE, mapped(FINISH_REASONS)).otherwise(mapped(FINISH_REASONS_OPENAI))


def last_usage_per_step(usage: DataFrame) -> DataFrame:
    """Token record of a step per trace: the last one reported stands."""
    fields = [c for c in usage.columns if c not in ("trace_id", "step", "seq")]
    return usage.groupBy("trace_id", "step").agg(F.max_by(F.struct(*fields), "seq").alias("u")).select("trace_id", "step", "u.*")


def usage_accounting(usage: DataFrame) -> DataFrame:
    """Tokens and cost per step and model; missing counts are zero, cost stays null where none was reported."""
    return usage.groupBy("step", "model").agg(
        F.count(F.lit(1)).alias("calls"),
        F.sum(F.coalesce("input", F.lit(0))).alias("input_tokens"), F.sum(F.coalesce("output", F.lit(0))).alias("output_tokens"),
        F.sum("reasoning").alias("reasoning_tokens"), F.sum("cost_usd").alias("cost_usd"))
