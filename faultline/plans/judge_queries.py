"""Queries of candidates, verdicts and evaluation. Their equivalent SQL reads the SQL of all detectors and says the rest anew."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faultline.operators import detectors, evaluate, judge, steps
from faultline.plans import record_queries, relational, step_oracles
from faultline.runtime import table
from faultline.sources import cases as cases_

Query = Callable[[SparkSession, str], DataFrame]


def diagnoses(spark: SparkSession, d: str) -> DataFrame:
    """The latest row of every diagnosis."""
    cols = ["created_at", "confidence", "cluster_id", "trace_id", "root_cause_step_index", "failure_class", "calibrated_confidence", "abstained"]
    return table(spark, d, "diagnoses").where("diagnosis_id is not null").groupBy("diagnosis_id").agg(F.max(F.struct(*cols)).alias("r")).select("diagnosis_id", *(F.col(f"r.{c}").alias(c) for c in cols))


def divergences(spark: SparkSession, d: str) -> DataFrame:
    """diagnosis_id, step_index, score: one row each, of repeated rows the smallest score."""
    return table(spark, d, "divergences").where("diagnosis_id is not null and step_index is not null").groupBy("diagnosis_id", "step_index").agg(F.min("divergence_score").alias("score"))


def _merged(spark: SparkSession, d: str) -> DataFrame:
    found = detectors.signals(steps.enrich(*(table(spark, d, t) for t in ("steps", "spans", "traces"))))
    of = diagnoses(spark, d).where("trace_id is not null").select("diagnosis_id", F.col("trace_id").alias("d_t"))
    own = found.join(of, F.col("trace_id") == F.col("d_t")).select("diagnosis_id", "step_index", "severity", "category")
    return judge.merge(own, divergences(spark, d), "diagnosis_id")


def merge_candidates(spark: SparkSession, d: str) -> DataFrame:
    """All steps that signals or divergences name."""
    return _merged(spark, d).select("diagnosis_id", "step_index", F.round("prior", 6).alias("prior"), "source", "n_signals", F.array_join("categories", ",").alias("categories"))


def rank_candidates(spark: SparkSession, d: str) -> DataFrame:
    """The five that come first of every diagnosis."""
    return judge.top(_merged(spark, d), "diagnosis_id").select("diagnosis_id", "step_index", F.round("prior", 6).alias("prior"), "source", F.col("rank").alias("rnk"))


def _shortlist(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    of = diagnoses(spark, d).where("trace_id is not null").select("diagnosis_id", F.col("trace_id").alias("d_t"))
    s = steps.distinct_steps(table(spark, d, "steps")).select("trace_id", "step_index", "kind", "depth").join(of, F.col("trace_id") == F.col("d_t")).select("diagnosis_id", "step_index", "kind", "depth")
    failed = of.join(steps.latest_traces(table(spark, d, "traces")).where("outcome = 'failure'"), F.col("d_t") == F.col("trace_id"), "left_semi").select("diagnosis_id")
    return judge.shortlist(_merged(spark, d), s, failed, "diagnosis_id"), s


def shortlisted_candidates(spark: SparkSession, d: str) -> DataFrame:
    """The shortlist of every diagnosis with fallback and fillers of failed runs."""
    return _shortlist(spark, d)[0].select("diagnosis_id", "step_index", F.round("prior", 6).alias("prior"), "source", "rank")


def calibrate(spark: SparkSession, d: str) -> DataFrame:
    """The calibrated confidence of every diagnosis whose cause is on its shortlist; it cites its own step."""
    short, s = _shortlist(spark, d)
    visible = F.collect_set("step_index").over(Window.partitionBy("diagnosis_id"))  # five steps at most
    placed = judge.with_place(short.withColumn("visible", visible), s, "diagnosis_id")
    g = diagnoses(spark, d).where("confidence is not null").select(F.col("diagnosis_id").alias("g_id"), "confidence", "failure_class", "root_cause_step_index")
    j = placed.join(g, (F.col("diagnosis_id") == F.col("g_id")) & (F.col("step_index") == F.col("root_cause_step_index")))
    agrees = F.array_contains("categories", F.coalesce("failure_class", F.lit("")))
    density = judge.cite_share(F.array("root_cause_step_index"), F.col("visible"))
    value = judge.calibrate(F.col("confidence"), F.col("prior"), agrees, density, F.col("rank"), F.col("position"), F.col("depth_norm"), F.col("n_signals"), F.col("source"))
    return j.select("diagnosis_id", "step_index", F.round(value, 6).alias("calibrated"))


def select_verdict(spark: SparkSession, d: str) -> DataFrame:
    """One verdict for every diagnosed trace, its diagnoses being what the model said of its candidates."""
    g = diagnoses(spark, d).where("trace_id is not null")
    judged = g.select("trace_id", F.col("root_cause_step_index").alias("step_index"), (~F.col("abstained") & F.col("root_cause_step_index").isNotNull()).alias("is_root_cause"), "failure_class", F.col("calibrated_confidence").alias("calibrated"), F.lit(None).cast("string").alias("error"))
    judged = judged.groupBy("trace_id", "step_index").agg(F.max(F.struct("calibrated", "failure_class", "is_root_cause", "error")).alias("x")).select("trace_id", "step_index", "x.*")
    return judge.select_verdict(judged, g.select("trace_id").distinct(), "trace_id")


def _trail(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(cases, signals, shortlist, steps) of the annotated trail records. Their errors are the truth; a record with any failed."""
    spans, made = record_queries._trail(spark, d)
    cases = cases_.annotated_cases(table(spark, d, "raw_records").where("layout = 'trail'"), "record_id", "body", made)
    bad = cases.select("trace_id").distinct()
    p = spans.select(F.col("trace_id").alias("s_t"), F.lower(F.trim("span_id")).alias("s_n"), "status", F.to_json("p").alias("pj")).groupBy("s_t", "s_n").agg(F.min("status").alias("status"), F.min("pj").alias("pj"))
    e = made.join(p, (F.col("trace_id") == F.col("s_t")) & (F.col("span_id") == F.col("s_n")), "left").drop("s_t", "s_n").withColumn("p", F.from_json("pj", steps.PAYLOAD)).withColumns({"outcome": F.lit("failure"), "task_goal": F.lit(None).cast("string")})
    found = detectors.signals(e)
    none = found.select("trace_id", "step_index", F.lit(0.0).alias("score")).limit(0)
    short = judge.shortlist(judge.merge(found, none, "trace_id"), made, bad, "trace_id")
    return cases, found, short, made


def evaluation_report(spark: SparkSession, d: str) -> DataFrame:
    """The first of every shortlist as the prediction, against the annotated causes."""
    cases, found, short, made = _trail(spark, d)
    kind = found.groupBy(F.col("trace_id").alias("k_t"), F.col("step_index").alias("k_s")).agg(F.max(F.struct("severity", "category"))["category"].alias("failure_class"))
    first = short.where("rank = 1").join(kind, (F.col("trace_id") == F.col("k_t")) & (F.col("step_index") == F.col("k_s")), "left").join(made.select(F.col("trace_id").alias("m_t"), F.col("step_index").alias("m_s"), "span_id"), (F.col("trace_id") == F.col("m_t")) & (F.col("step_index") == F.col("m_s")))
    return evaluate.report(evaluate.predictions(cases, first.select("trace_id", "step_index", "span_id", "failure_class", F.col("prior").alias("confidence"))))


def evaluation_recall(spark: SparkSession, d: str) -> DataFrame:
    cases, _, short, _ = _trail(spark, d)
    return evaluate.recall(cases, short)


def evaluation_sources(spark: SparkSession, d: str) -> DataFrame:
    cases, _, short, _ = _trail(spark, d)
    return evaluate.by_source(cases, short)


def evaluation_coverage(spark: SparkSession, d: str) -> DataFrame:
    cases, found, short, _ = _trail(spark, d)
    return evaluate.coverage(cases, found, short)


def leave_one_out(spark: SparkSession, d: str) -> DataFrame:
    cases, found, _, _ = _trail(spark, d)
    return evaluate.leave_one_out(cases, found, found.select("trace_id", "step_index", F.lit(0.0).alias("score")).limit(0), detectors.DETECTORS)


QUERIES: dict[str, Query] = {f.__name__: f for f in (merge_candidates, rank_candidates, shortlisted_candidates, calibrate, select_verdict, evaluation_report, evaluation_recall, evaluation_sources, evaluation_coverage, leave_one_out)}

_MERGED = f"""with l1 as (select * from ({step_oracles.ALL})), {relational.STEPS}, {relational.TRACES}, {relational.DIAG}, {relational.DIV},
ev as (select diagnosis_id, step_index, max(severity) sev, cast(count(*) as integer) n, array_to_string(list_sort(list_distinct(list(category))), ',') cats from dg join l1 using (trace_id) group by all),
ca as (select diagnosis_id, step_index, case when sev is not null and score is not null then least(1, greatest(sev, score) + 0.15::double) else coalesce(sev, score) end prior,
 case when sev is not null and score is not null then 'both' when sev is not null then 'l1' else 'l2' end source, coalesce(n, 0) n, coalesce(cats, '') cats from ev full join (select * from dv where score is not null) z using (diagnosis_id, step_index)),
rk as (select *, row_number() over (partition by diagnosis_id order by prior desc, step_index) r from ca)"""
_POOL = """p{0} as (select *, row_number() over (partition by diagnosis_id order by step_index) - 1 pos, count(*) over (partition by diagnosis_id) n from {1}),
q{0} as (select *, row_number() over (partition by diagnosis_id order by case when need >= n or (need = 1 and pos = n // 2) or (need > 1 and list_contains(list_transform(range(need), lambda i: cast(round_even(i * (n - 1) / (need - 1)::double, 0) as bigint)), pos)) then 0 else 1 end, pos) pick from p{0} where not used),
f{0} as (select diagnosis_id, step_index from q{0} where pick <= need)"""
_SHORT = _MERGED + """,
ds as (select dg.diagnosis_id, st.step_index, st.kind, st.depth from dg join st using (trace_id)), fd as (select diagnosis_id from dg join tr using (trace_id) where tr.outcome = 'failure'),
b5 as (select diagnosis_id, step_index, prior, source, n, cats from rk where r <= 5),
fb as (select ds.diagnosis_id, max(ds.step_index) step_index from ds join fd using (diagnosis_id) where ds.diagnosis_id not in (select diagnosis_id from b5) group by 1),
re as (select * from b5 union all select diagnosis_id, step_index, 0, 'fallback', 0, '' from fb),
mk as (select ds.*, re.step_index is not null used, least(5, count(*) over (partition by ds.diagnosis_id)) - count(re.step_index) over (partition by ds.diagnosis_id) need from ds join fd using (diagnosis_id) left join re on re.diagnosis_id = ds.diagnosis_id and re.step_index = ds.step_index),
m1 as (select * from mk where need > 0 and kind in ('llm', 'agent')), """ + _POOL.format(1, "m1") + """,
m2 as (select * exclude (need), need - (select count(*) from f1 where f1.diagnosis_id = mk.diagnosis_id) need from mk where not used and need > 0 and kind in ('llm', 'agent', 'tool', 'retriever') and not exists (select 1 from f1 where f1.diagnosis_id = mk.diagnosis_id and f1.step_index = mk.step_index)),
m3 as (select * from m2 where need > 0), """ + _POOL.format(2, "m3") + """,
sh as (select * from re union all select diagnosis_id, step_index, 0, 'filler', 0, '' from (select * from f1 union all select * from f2)),
sr as (select *, row_number() over (partition by diagnosis_id order by source = 'filler', prior desc, step_index) rank from sh)"""
SQL: dict[str, str] = {
    "merge_candidates": _MERGED + " select diagnosis_id, step_index, round(prior, 6) prior, source, n n_signals, cats categories from ca",
    "rank_candidates": _MERGED + " select diagnosis_id, step_index, round(prior, 6) prior, source, cast(r as integer) rnk from rk where r <= 5",
    "shortlisted_candidates": _SHORT + " select diagnosis_id, step_index, round(prior, 6) prior, source, cast(rank as integer) rank from sr",
    "calibrate": _SHORT + """,
pl as (select diagnosis_id, step_index, case when count(*) over w > 1 then step_index / (count(*) over w - 1)::double else 0 end pos, case when max(depth) over w > 0 then depth / (max(depth) over w)::double else 0 end dep from ds window w as (partition by diagnosis_id)),
g as (select sr.*, coalesce(pl.pos, 0) pos, coalesce(pl.dep, 0) dep, greatest(1e-6::double, least(1 - 1e-6::double, dg.confidence)) c, list_contains(string_split(cats, ','), coalesce(dg.failure_class, '-')) agrees from sr join dg on dg.diagnosis_id = sr.diagnosis_id and dg.root_cause_step_index = sr.step_index left join pl on pl.diagnosis_id = sr.diagnosis_id and pl.step_index = sr.step_index where dg.confidence is not null)
select diagnosis_id, step_index, round(1 / (1 + exp(-(-5.3395::double + 0.0077::double * ln(c / (1 - c)) - 1.4268::double * prior - case when agrees then 0.4531::double else 0 end - 0.4575::double + 0.8888::double * (1 - (rank - 1) / 4.0::double) + 1.3492::double * pos + 2.5913::double * dep + 0.7388::double * n - case when source = 'fallback' then 1.8539::double else 0 end + case when source = 'filler' then 0.7661::double else 0 end))), 6) calibrated from g""",
    "select_verdict": f"""with {relational.DIAG}, j as (select trace_id, root_cause_step_index s, failure_class f, calibrated_confidence c, not abstained and root_cause_step_index is not null ok from dg where trace_id is not null),
o as (select * from (select *, row_number() over (partition by trace_id, s order by c desc nulls last, f desc nulls last, ok desc) k from j) where k = 1), e as (select * from o where ok and c is not null),
r as (select *, row_number() over (partition by trace_id order by c desc, s) k2, lead(c) over (partition by trace_id order by c desc, s) c2, lead(f) over (partition by trace_id order by c desc, s) f2, count(*) over (partition by trace_id) m from e),
v as (select t.trace_id, case when c is null then 'none' when c < 0.15::double then 'low_confidence' when m > 1 and c - c2 <= 0.08::double and f is distinct from f2 then 'ambiguous' else 'committed' end verdict, s, f, c from (select distinct trace_id from j) t left join (select * from r where k2 = 1) x using (trace_id))
select trace_id, verdict, case when verdict = 'committed' then s end step_index, case when verdict = 'committed' then f end failure_class, c confidence from v""",
}
