"""Span trees to ordered steps: effective parents, depth-first order, actors, collapse of non-semantic spans, signatures.

Order and tree paths come out of the hierarchy operator with siblings by (start_ns, span_id), and positions out of bucketed
running sums over its preorder, so no trace is walked or ordered in one task. Traces without a semantic span have no steps and are
left out first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.operators.hierarchy import MAX_ROUNDS, clean_id, clean_parent, hierarchy, running, sibling_buckets
from faultline.operators.steps import EMPTY_RESULTS, PAYLOAD, strip
from faultline.runtime import cut

SEMANTIC = ["llm", "tool", "retriever", "agent"]
#: Positions of a preorder that one task orders.
BUCKET = 4096
_SEP = "\u0001"


def distinct_facts(spans: DataFrame) -> DataFrame:
    """One row per (trace_id, node): parent, kind, status, name, start_ns, end_ns, p. Of repeated rows the smallest value of each column counts."""
    payload = F.col("p") if "p" in spans.columns else F.from_json("payload", PAYLOAD)
    s = spans.select(clean_id(F.col("trace_id")).alias("trace_id"), clean_id(F.col("span_id")).alias("node"), clean_parent(F.col("parent_span_id")).alias("parent"), "kind", "status", "name", "start_ns", "end_ns", F.to_json(payload).alias("payload"))
    one = s.where("trace_id is not null and node is not null").groupBy("trace_id", "node").agg(*(F.min(c).alias(c) for c in ("parent", "kind", "status", "name", "start_ns", "end_ns", "payload")))
    return one.withColumn("start_ns", F.coalesce("start_ns", F.lit(0))).withColumn("end_ns", F.coalesce("end_ns", F.lit(0)))


def _circle_firsts(bad: DataFrame) -> DataFrame:
    """The first node by (start_ns, node) of every circle. bad: trace_id, node, parent, start_ns of the nodes on or below circles."""
    state = cut(bad.select("trace_id", "node", F.col("parent").alias("anc"), F.struct("start_ns", "node").alias("best")))
    most = state.groupBy("trace_id").count().agg(F.max("count")).first()[0] or 0
    for k in range(MAX_ROUNDS):
        if 1 << k > most:
            break
        u = state.select(F.col("trace_id").alias("u_t"), F.col("node").alias("u_n"), F.col("anc").alias("u_anc"), F.col("best").alias("u_best"))
        state = cut(state.join(u, (F.col("trace_id") == F.col("u_t")) & (F.col("anc") == F.col("u_n"))).select("trace_id", "node", F.col("u_anc").alias("anc"), F.least("best", "u_best").alias("best")), state)
    on = state.select(F.col("trace_id").alias("o_t"), F.col("anc").alias("o_n")).distinct()
    return state.join(on, (F.col("trace_id") == F.col("o_t")) & (F.col("node") == F.col("o_n")), "left_semi").where("best.node = node").select("trace_id", "node")


def effective_parents(facts: DataFrame) -> DataFrame:
    """facts with parent as the tree needs it, and is_orphan.

    The root of a trace is the earliest (start_ns, node) of the spans that name no parent, else of all. Whatever else has no parent,
    itself as parent or a parent that the trace lacks hangs directly under the root, and so does the first span (start_ns, node) of
    every circle of links: the others on or below it keep theirs. All those are orphans.
    """
    first = F.min(F.struct(F.col("parent").isNotNull().alias("named"), "start_ns", "node"))
    roots = facts.groupBy(F.col("trace_id").alias("r_t")).agg(first["node"].alias("root"))
    ids = facts.select(F.col("trace_id").alias("i_t"), F.col("node").alias("i_n"))
    known = facts.join(ids, (F.col("trace_id") == F.col("i_t")) & (F.col("parent") == F.col("i_n")) & (F.col("parent") != F.col("node")), "left").join(roots, F.col("trace_id") == F.col("r_t"))
    at_root = F.col("node") == F.col("root")
    hung = cut(known.withColumn("is_orphan", ~at_root & F.col("i_n").isNull()).withColumn("parent", F.when(at_root, F.lit(None)).otherwise(F.coalesce("i_n", "root"))).drop("i_t", "i_n", "r_t"))
    stuck = hierarchy(hung, ["trace_id"]).where("depth < 0").select(F.col("trace_id").alias("b_t"), F.col("node").alias("b_n"))
    bad = cut(hung.join(stuck, (F.col("trace_id") == F.col("b_t")) & (F.col("node") == F.col("b_n")), "left_semi"))
    if bad.isEmpty():
        return hung
    lead = _circle_firsts(bad).select(F.col("trace_id").alias("l_t"), F.col("node").alias("l_n"))
    freed = hung.join(lead, (F.col("trace_id") == F.col("l_t")) & (F.col("node") == F.col("l_n")), "left")
    hit = F.col("l_n").isNotNull()
    return freed.withColumn("parent", F.when(hit, F.col("root")).otherwise(F.col("parent"))).withColumn("is_orphan", hit | F.col("is_orphan")).drop("l_t", "l_n")


def tool_outcome(p: Column) -> Column:
    """err, empty or ok."""
    empty = F.coalesce(p["result_len"] == 0, F.lit(False)) | F.lower(strip(F.coalesce(p["result_text"], F.lit("")))).isin(*EMPTY_RESULTS)
    return F.when(F.coalesce(p["is_error"], F.lit(False)), "err").when(empty, "empty").otherwise("ok")


def place(spans: DataFrame) -> DataFrame:
    """Every span of a trace that has steps: its facts, root, is_orphan, depth, preorder, tree_path ('0.i.j') and actor.

    The actor is the agent named by the span's own payload, else that of the nearest ancestor that has one, else the root's name
    or 'unknown'.
    """
    facts = distinct_facts(spans)
    live = facts.where(F.col("kind").isin(*SEMANTIC)).select(F.col("trace_id").alias("s_t")).distinct()
    tree = effective_parents(cut(facts.join(live, F.col("trace_id") == F.col("s_t"), "left_semi")))
    tree = cut(sibling_buckets(tree, ["trace_id", "parent"], "start_ns").withColumn("one", F.lit(1)))
    tree = running(tree, ["trace_id", "parent"], F.col("__slot"), ["start_ns", "node"], "one", "sibling").withColumn("p", F.from_json("payload", PAYLOAD))
    named = F.when((F.col("kind") == "agent") & F.col("p").isNotNull(), F.coalesce("p.agent_name", F.lit("unknown"))).when(F.col("node") == F.col("root"), F.coalesce(F.nullif(F.col("name"), F.lit("")), F.lit("unknown")))
    tree = cut(tree.withColumn("label", F.concat_ws(_SEP, F.col("sibling").cast("string"), named)).drop("p", "__slot", "one", "sibling"))
    solved = hierarchy(tree, ["trace_id"], True, order="start_ns", label="label").select(F.col("trace_id").alias("h_t"), F.col("node").alias("h_n"), "depth", "preorder", "path")
    at = tree.join(solved, (F.col("trace_id") == F.col("h_t")) & (F.col("node") == F.col("h_n")))
    actor = F.element_at(F.split(F.element_at(F.filter("path", lambda x: F.contains(x, F.lit(_SEP))), -1), _SEP), 2)
    path = F.array_join(F.transform("path", lambda x: F.element_at(F.split(x, _SEP), 1)), ".")
    return at.select("trace_id", "node", "root", "is_orphan", "kind", "status", "name", "start_ns", "end_ns", "payload", "depth", "preorder", path.alias("tree_path"), actor.alias("actor"))


def linearize(spans: DataFrame) -> DataFrame:
    """trace_id, step_index, span_id, kind, actor, depth, tree_path, signature, summary, start_ns, end_ns, duration_ms, collapsed_span_ids.

    spans: trace_id, span_id, parent_span_id, name, kind, status, start_ns, end_ns and payload (JSON) or p (struct). Spans of other kinds than
    SEMANTIC hand their ids to the next step of the trace, those after the last step to the last. The first model step of an actor plans, unless it
    calls a tool; later ones answer. Empty in, empty out.
    """
    at = cut(place(spans).withColumn("is_step", F.col("kind").isin(*SEMANTIC).cast("int")))
    total = at.groupBy(F.col("trace_id").alias("n_t")).agg(F.sum("is_step").alias("steps"))
    line = running(at, ["trace_id"], F.floor(F.col("preorder") / BUCKET), ["preorder"], "is_step", "before").join(total, F.col("trace_id") == F.col("n_t"))
    line = cut(line.withColumn("step_index", F.when(F.col("is_step") == 1, F.col("before")).otherwise(F.least("before", F.col("steps") - 1)).cast("int")).drop("n_t"))
    held = line.where("is_step = 0").groupBy(F.col("trace_id").alias("c_t"), F.col("step_index").alias("c_i")).agg(F.transform(F.array_sort(F.collect_list(F.struct("preorder", "node"))), lambda x: x["node"]).alias("ids"))
    steps = line.where("is_step = 1").withColumn("p", F.from_json("payload", PAYLOAD))
    plans = steps.where("kind = 'llm'").groupBy(F.col("trace_id").alias("f_t"), F.col("actor").alias("f_a")).agg(F.min("step_index").alias("first"))
    steps = steps.join(plans, (F.col("trace_id") == F.col("f_t")) & (F.col("actor") == F.col("f_a")), "left").join(held, (F.col("trace_id") == F.col("c_t")) & (F.col("step_index") == F.col("c_i")), "left")
    p, kind, actor = F.col("p"), F.col("kind"), F.col("actor")
    call = F.get(p["tool_calls"], F.lit(0))["tool_name"]
    calls, plan = F.coalesce(F.size(p["tool_calls"]) > 0, F.lit(False)), F.col("first") == F.col("step_index")
    tool, outcome = F.when(p.isNotNull(), F.coalesce(p["tool_name"], F.lit(""))).otherwise(F.coalesce("name", F.lit(""))), F.when(p.isNotNull(), tool_outcome(p)).otherwise("ok")
    words = F.size(F.filter(F.split(F.coalesce(p["query"], F.lit("")), r"(?U)\s+"), lambda w: w != ""))
    hit = F.when(F.coalesce(F.size(p["documents"]) > 0, F.lit(False)), "hit").otherwise("miss")
    said = (
        F.when(kind == "agent", F.concat_ws(":", F.lit("agent"), actor, F.lit("invoke")))
        .when((kind == "llm") & calls, F.concat_ws(":", F.lit("llm"), actor, F.lit("call"), call))
        .when(kind == "llm", F.concat_ws(":", F.lit("llm"), actor, F.when(plan, "plan").otherwise("answer")))
        .when(kind == "tool", F.concat_ws(":", F.lit("tool"), actor, tool, outcome))
        .otherwise(F.concat_ws(":", F.lit("retr"), actor, F.concat(F.lit("w"), words.cast("string")), hit))
    )
    summary = (
        F.when(kind == "agent", F.concat(actor, F.lit(" is invoked")))
        .when((kind == "llm") & calls, F.concat(actor, F.lit(" decides to call "), F.coalesce(call, F.lit(""))))
        .when(kind == "llm", F.concat(actor, F.when(plan, " plans its next step").otherwise(" responds")))
        .when(kind == "tool", F.concat(tool, F.lit(" returns "), outcome))
        .otherwise(F.concat(actor, F.lit(" retrieves documents ("), hit, F.lit(")")))
    )
    return steps.select(
        "trace_id", "step_index", F.col("node").alias("span_id"), "kind", "actor", "depth", "tree_path", said.alias("signature"), summary.alias("summary"), "start_ns", "end_ns",
        ((F.col("end_ns") - F.col("start_ns")) / 1e6).alias("duration_ms"), F.coalesce("ids", F.array().cast("array<string>")).alias("collapsed_span_ids"),
    )
