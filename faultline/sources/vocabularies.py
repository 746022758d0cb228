"""Raw spans of three attribute vocabularies to canonical spans, in Catalyst expressions only.

Input: raw spans (trace_id, span_id, parent_span_id, name, attributes as JSON text; of OpenTelemetry start_ns, end_ns,
status_code, status_message; of direct uploads kind, status, actor, start_time, end_time). A column that is missing
counts as null. Whatever cannot be normalised stays a row: kind unknown, no payload, normalize_error says why, attributes are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.operators.steps import PAYLOAD

# The canonical kinds, and what the vocabularies call them.
KINDS = ["llm", "tool", "retriever", "agent", "chain", "embedding", "guardrail", "unknown"]
OPERATIONS = {"invoke_agent": "agent", "create_agent": "agent", "chat": "llm", "text_completion": "llm", "generate_content": "llm", "embeddings": "embedding", "execute_tool": "tool", "retrieve_documents": "retriever"}
OPENINFERENCE_KINDS = {"AGENT": "agent", "LLM": "llm", "TOOL": "tool", "RETRIEVER": "retriever", "CHAIN": "chain", "EMBEDDING": "embedding", "GUARDRAIL": "guardrail"}
STATUS = {"STATUS_CODE_OK": "ok", "STATUS_CODE_ERROR": "error", "STATUS_CODE_UNSET": "unset"}
PREVIEW = 200
INPUT = ["trace_id", "span_id", "parent_span_id", "name", "attributes", "start_ns", "end_ns", "status_code", "status_message", "kind", "status", "actor", "start_time", "end_time"]

_CALLS = "array<struct<id:string,name:string,arguments:string,function:struct<name:string,arguments:string>>>"
_MESSAGES = f"array<struct<role:string,content:string,tool_calls:{_CALLS}>>"
_DOCUMENTS = "array<struct<id:string,doc_id:string,content:string,score:double>>"


def _lookup(col: Column, names: dict[str, str], default: str) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for kv in names.items() for x in kv))[col], F.lit(default))


def is_json(text: Column) -> Column:
    return F.try_parse_json(text).isNotNull()


def matches(raw_kind: Column, start: Column, end: Column, attributes: Column) -> dict[str, Column]:
    """Whether a raw span is written in each vocabulary, in the order in which they are asked."""
    return {
        "otel_genai": F.coalesce(F.map_contains_key(attributes, "gen_ai.operation.name"), F.lit(False)),
        "openinference": F.coalesce(F.map_contains_key(attributes, "openinference.span.kind"), F.lit(False)),
        "raw_upload": F.coalesce(raw_kind.isin(*KINDS), F.lit(False)) & start.isNotNull() & end.isNotNull(),
    }


def detect(raw_kind: Column, start: Column, end: Column, attributes: Column) -> Column:
    """The first vocabulary that matches, else unknown."""
    m = matches(raw_kind, start, end, attributes)
    return F.coalesce(*(F.when(m[v], F.lit(v)) for v in m), F.lit("unknown"))


def _messages(items: Column) -> Column:
    return F.transform(items, lambda m: F.struct(F.coalesce(m["role"], F.lit("unknown")).alias("role"), m["content"].alias("content")))


def _documents(items: Column) -> Column:
    return F.transform(items, lambda d, i: F.struct(
        F.coalesce(d["doc_id"], d["id"], F.concat(F.lit("doc-"), i.cast("string"))).alias("doc_id"), F.length(F.coalesce(d["content"], F.lit(""))).cast("bigint").alias("content_len"),
        F.substring(F.coalesce(d["content"], F.lit("")), 1, PREVIEW).alias("content_preview"), d["score"].alias("score"),
    ))


def _calls(items: Column, nested: bool) -> Column:
    """The tool calls of messages; nested: under function, with the arguments as text."""
    f = (lambda c: (c["function"]["name"], c["function"]["arguments"])) if nested else (lambda c: (c["name"], c["arguments"]))
    one = lambda c: F.struct(F.coalesce(f(c)[0], F.lit("")).alias("tool_name"), F.coalesce(F.nullif(f(c)[1], F.lit("")), F.lit("{}")).alias("arguments_json"))
    return F.flatten(F.transform(items, lambda m: F.transform(F.coalesce(m["tool_calls"], F.array().cast(_CALLS)), one)))


def _indexed(a: Column, prefix: str, build) -> Column:
    """build(first, index) for every index i of the keys prefix.i.rest, in numeric order; first is 'prefix.i.'."""
    pattern = "^" + prefix.replace(".", r"\.") + r"\.(\d+)\..+$"
    at = F.transform(F.filter(F.map_keys(a), lambda k: k.rlike(pattern)), lambda k: F.regexp_extract(k, pattern, 1))
    order = F.array_sort(F.array_distinct(F.transform(at, lambda i: F.struct(i.cast("int").alias("n"), i.alias("i")))))
    return F.transform(order, lambda x: build(F.concat(F.lit(prefix + "."), x["i"], F.lit(".")), x["i"]))


def _flat_calls(a: Column) -> Column:
    """The tool calls of all output messages out of flattened keys, in order of message and call."""
    pattern = r"^llm\.output_messages\.(\d+)\.message\.tool_calls\.(\d+)\.tool_call\..+$"
    keys = F.filter(F.map_keys(a), lambda k: k.rlike(pattern))
    pair = lambda k: F.struct(F.regexp_extract(k, pattern, 1).cast("int").alias("m"), F.regexp_extract(k, pattern, 2).cast("int").alias("c"), F.regexp_extract(k, r"^(.*\.tool_call\.)", 1).alias("at"))
    one = lambda x: F.struct(F.coalesce(a[F.concat(x["at"], F.lit("function.name"))], F.lit("")).alias("tool_name"), F.coalesce(F.nullif(a[F.concat(x["at"], F.lit("function.arguments"))], F.lit("")), F.lit("{}")).alias("arguments_json"))
    return F.transform(F.array_sort(F.array_distinct(F.transform(keys, pair))), one)


def _payload(**fields: Column) -> Column:
    """A payload struct with the given fields, the others null."""
    parts, depth, name = [], 0, ""
    for ch in PAYLOAD + ",":
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            parts.append(name.strip())
            name = ""
        else:
            name += ch
    return F.struct(*(fields.get(f.split()[0], F.lit(None)).cast(f.split(None, 1)[1]).alias(f.split()[0]) for f in parts))


def _genai(a: Column, kind: Column, is_error: Column, message: Column) -> tuple[Column, Column]:
    """(payload, why it cannot be made)."""
    text = lambda k, d="": F.coalesce(a[k], F.lit(d))
    asked, said = F.from_json(a["gen_ai.input.messages"], _MESSAGES), F.from_json(a["gen_ai.output.messages"], _MESSAGES)
    none = F.array().cast(_MESSAGES)
    asked, said = F.coalesce(asked, none), F.coalesce(said, none)
    tokens = [a[f"gen_ai.usage.{x}_tokens"].try_cast("bigint") for x in ("input", "output")]
    docs = F.coalesce(F.from_json(a["gen_ai.retrieval.documents"], _DOCUMENTS), F.array().cast(_DOCUMENTS))
    result = text("gen_ai.tool.call.result")
    payload = (
        F.when(kind == "llm", _payload(provider=text("gen_ai.provider.name", "unknown"), model=F.coalesce(F.nullif(a["gen_ai.response.model"], F.lit("")), a["gen_ai.request.model"], F.lit("unknown")), request_messages=_messages(asked), response_messages=_messages(said), tool_calls=_calls(said, True), finish_reason=F.get(F.from_json(a["gen_ai.response.finish_reasons"], "array<string>"), F.lit(0)), prompt_tokens=tokens[0], completion_tokens=tokens[1], total_tokens=tokens[0] + tokens[1], temperature=a["gen_ai.request.temperature"].try_cast("double")))
        .when(kind == "tool", _payload(tool_name=text("gen_ai.tool.name", "unknown"), arguments_json=F.coalesce(F.nullif(a["gen_ai.tool.call.arguments"], F.lit("")), F.lit("{}")), result_text=result, result_len=F.length(result), is_error=is_error, error_message=F.when(is_error, message)))
        .when(kind == "retriever", _payload(query=text("gen_ai.retrieval.query"), documents=_documents(docs), top_k=F.coalesce(a["gen_ai.retrieval.document.count"].try_cast("bigint"), F.size(docs).cast("bigint"))))
        .when(kind == "agent", _payload(agent_name=text("gen_ai.agent.name", "unknown"), role=text("gen_ai.agent.description"), input_text=F.lit(""), output_text=F.lit(""), delegated_to=F.array().cast("array<string>")))
    )
    needs = {"llm": ["gen_ai.input.messages", "gen_ai.output.messages"], "retriever": ["gen_ai.retrieval.documents"]}
    return payload, _broken(a, kind, needs)


def _broken(a: Column, kind: Column, needs: dict[str, list[str]]) -> Column:
    return F.coalesce(*(F.when((kind == k) & a[x].isNotNull() & ~is_json(a[x]), F.lit(f"attribute {x} is not valid JSON")) for k, xs in needs.items() for x in xs))


def _openinference(a: Column, kind: Column, is_error: Column, message: Column) -> tuple[Column, Column]:
    text = lambda k, d="": F.coalesce(a[k], F.lit(d))
    messages = lambda p: _indexed(a, p, lambda at, _: F.struct(F.coalesce(a[F.concat(at, F.lit("message.role"))], F.lit("unknown")).alias("role"), a[F.concat(at, F.lit("message.content"))].alias("content")))
    content = lambda at: F.coalesce(a[F.concat(at, F.lit("document.content"))], F.lit(""))
    docs = _indexed(a, "retrieval.documents", lambda at, i: F.struct(F.coalesce(a[F.concat(at, F.lit("document.id"))], F.concat(F.lit("doc-"), i.cast("int").cast("string"))).alias("doc_id"), F.length(content(at)).cast("bigint").alias("content_len"), F.substring(content(at), 1, PREVIEW).alias("content_preview"), a[F.concat(at, F.lit("document.score"))].try_cast("double").alias("score")))
    count = lambda x: a[f"llm.token_count.{x}"].try_cast("bigint")
    result = text("output.value")
    payload = (
        F.when(kind == "llm", _payload(provider=text("llm.system", "unknown"), model=text("llm.model_name", "unknown"), request_messages=messages("llm.input_messages"), response_messages=messages("llm.output_messages"), tool_calls=_flat_calls(a), finish_reason=a["llm.finish_reason"], prompt_tokens=count("prompt"), completion_tokens=count("completion"), total_tokens=count("total"), max_tokens=count("max"), temperature=F.get_json_object(a["llm.invocation_parameters"], "$.temperature").try_cast("double")))
        .when(kind == "tool", _payload(tool_name=text("tool.name", "unknown"), arguments_json=F.coalesce(F.nullif(a["input.value"], F.lit("")), F.lit("{}")), result_text=result, result_len=F.length(result), is_error=is_error, error_message=F.when(is_error, message)))
        .when(kind == "retriever", _payload(query=text("input.value"), documents=docs, top_k=F.size(docs).cast("bigint")))
        .when(kind == "agent", _payload(agent_name=F.coalesce(F.get_json_object(a["metadata"], "$.agent_name"), F.lit("unknown")), role=F.lit(""), input_text=text("input.value"), output_text=result, delegated_to=F.array().cast("array<string>")))
    )
    return payload, _broken(a, kind, {"llm": ["llm.invocation_parameters"], "agent": ["metadata"]})


def _raw_upload(a: Column, kind: Column, actor: Column) -> Column:
    text = lambda k, d="": F.coalesce(a[k], F.lit(d))
    none = F.array().cast(_MESSAGES)
    listed = lambda k: F.coalesce(F.filter(F.from_json(a[k], _MESSAGES), lambda m: m.isNotNull()), none)
    asked, said = listed("request_messages"), listed("response_messages")
    tokens = [a[x].try_cast("bigint") for x in ("prompt_tokens", "completion_tokens")]
    docs = F.coalesce(F.filter(F.from_json(a["documents"], _DOCUMENTS), lambda d: d.isNotNull()), F.array().cast(_DOCUMENTS))
    is_error, result = text("is_error", "false") == "true", text("result")
    return (
        F.when(kind == "llm", _payload(provider=text("provider", "unknown"), model=text("model", "unknown"), request_messages=_messages(asked), response_messages=_messages(said), tool_calls=_calls(said, False), finish_reason=a["finish_reason"], prompt_tokens=tokens[0], completion_tokens=tokens[1], total_tokens=tokens[0] + tokens[1], max_tokens=a["max_tokens"].try_cast("bigint"), temperature=a["temperature"].try_cast("double")))
        .when(kind == "tool", _payload(tool_name=text("tool_name", "unknown"), arguments_json=text("arguments", "{}"), result_text=result, result_len=F.length(result), is_error=is_error, error_message=F.when(is_error, a["error_message"])))
        .when(kind == "retriever", _payload(query=text("query"), documents=_documents(docs), top_k=F.size(docs).cast("bigint")))
        .when(kind == "agent", _payload(agent_name=F.coalesce(a["agent.name"], actor, F.lit("unknown")), role=text("agent.role"), input_text=text("input_text"), output_text=text("output_text"), delegated_to=F.coalesce(F.from_json(a["delegated_to"], "array<string>"), F.array().cast("array<string>"))))
    )


def iso_ns(text: Column) -> Column:
    """ISO-8601 with a zone as epoch nanoseconds, in microsecond precision; null without a zone or if it is no time."""
    zoned = text.rlike(r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d(:\d\d(\.\d+)?)?([Zz]|[+-]\d\d:?\d\d)$")
    return F.when(zoned, F.unix_micros(F.try_to_timestamp(F.regexp_replace(F.regexp_replace(text, r"(\.\d{6})\d+", "$1"), r"([+-]\d\d)(\d\d)$", "$1:$2"))) * 1000)


def normalize(raw: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """carry, trace_id, span_id, parent_span_id, name, kind, status, status_message, start_ns, end_ns, vocabulary, attributes, p, normalize_error.

    p is a payload struct (null for kinds without one). A null attributes text is an empty object; one that is no JSON object is an error of
    the span. Extra columns are left out unless carried. Empty in, empty out.
    """
    carry = carry or []
    types = {"start_ns": "bigint", "end_ns": "bigint"}
    r = raw.select(*carry, *((F.col(c) if c in raw.columns else F.lit(None)).cast(types.get(c, "string")).alias(f"r_{c}") for c in INPUT))
    r = r.withColumn("a", F.from_json(F.coalesce("r_attributes", F.lit("{}")), "map<string,string>")).withColumn("vocabulary", detect(F.col("r_kind"), F.col("r_start_time"), F.col("r_end_time"), F.col("a")))
    a, v = F.col("a"), F.col("vocabulary")
    upload = v == "raw_upload"
    kind = F.when(v == "otel_genai", _lookup(a["gen_ai.operation.name"], OPERATIONS, "unknown")).when(v == "openinference", _lookup(a["openinference.span.kind"], OPENINFERENCE_KINDS, "unknown")).when(upload, F.col("r_kind")).otherwise("unknown")
    status = F.when(upload, F.coalesce("r_status", F.lit("unset"))).otherwise(_lookup(F.coalesce("r_status_code", "r_status", F.lit("")), STATUS, "unset"))
    start, end = F.when(upload, iso_ns(F.col("r_start_time"))).otherwise(F.col("r_start_ns")), F.when(upload, iso_ns(F.col("r_end_time"))).otherwise(F.col("r_end_ns"))
    r = r.select("*", kind.alias("kind"), status.alias("status"), start.alias("start_ns"), end.alias("end_ns"))
    is_error = F.col("status") == "error"
    (genai, bad_genai), (inference, bad_inference) = _genai(a, F.col("kind"), is_error, F.col("r_status_message")), _openinference(a, F.col("kind"), is_error, F.col("r_status_message"))
    payload = F.when(v == "otel_genai", genai).when(v == "openinference", inference).when(upload, _raw_upload(a, F.col("kind"), F.col("r_actor")))
    why = F.coalesce(
        F.when(v == "unknown", F.lit("no vocabulary matched")), F.when(v == "otel_genai", bad_genai), F.when(v == "openinference", bad_inference),
        F.when(~F.col("status").isin("ok", "error", "unset"), F.concat(F.lit("no status: "), "status")), F.when(F.col("r_span_id").isNull(), F.lit("no span_id")), F.when(F.col("start_ns").isNull() | F.col("end_ns").isNull(), F.lit("no start or end")),
    )
    r = r.withColumn("normalize_error", why)
    ok = F.col("normalize_error").isNull()
    return r.select(
        *carry, F.col("r_trace_id").alias("trace_id"), F.coalesce("r_span_id", F.lit("")).alias("span_id"), F.col("r_parent_span_id").alias("parent_span_id"), F.coalesce("r_name", F.lit("")).alias("name"), F.when(ok, F.col("kind")).otherwise("unknown").alias("kind"),
        F.when(ok, F.col("status")).otherwise(_lookup(F.coalesce("r_status_code", "r_status", F.lit("")), STATUS, "unset")).alias("status"), F.when(~upload, F.col("r_status_message")).alias("status_message"),
        F.when(ok, F.col("start_ns")).otherwise(F.coalesce("r_start_ns", F.lit(0))).alias("start_ns"), F.when(ok, F.col("end_ns")).otherwise(F.coalesce("r_end_ns", F.lit(0))).alias("end_ns"),
        "vocabulary", F.coalesce("r_attributes", F.lit("{}")).alias("attributes"), F.when(ok, payload).alias("p"), "normalize_error",
    )
