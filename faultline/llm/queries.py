"""Queries of the problems about language models: p1 and p6 to p10."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm import clusters as clusters_
from faultline.llm import leakage, mixing, neighbours, residue, vectors
from faultline.llm import runs as runs_
from faultline.runtime import canonical_source, table

Query = Callable[[SparkSession, str], DataFrame]
#: Length of card_embedding and task_embedding.
DIM = 384


def _sequences(spark: SparkSession, d: str) -> DataFrame:
    steps = table(spark, d, "steps").select(F.lit("steps").alias("sequence_kind"), F.col("trace_id").alias("sequence_id"), "step_index", F.col("signature"), "start_ns", "end_ns")
    div = table(spark, d, "divergences").select(F.lit("divergences").alias("sequence_kind"), F.col("diagnosis_id").alias("sequence_id"), "step_index", F.col("observed_signature").alias("signature"), F.lit(None).cast("long").alias("start_ns"), F.lit(None).cast("long").alias("end_ns"))
    return runs_.runs(steps.unionByName(div), ["sequence_kind", "sequence_id"], "step_index", "signature", "start_ns", "end_ns")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _sequences(spark, d).where("run_length >= 2").select("sequence_kind", "sequence_id", F.col("start_index").cast("int").alias("start_step_index"), "run_length")


def p1_collapsed(spark: SparkSession, d: str) -> DataFrame:
    """Every sequence with its runs collapsed."""
    return _sequences(spark, d).select("sequence_kind", "sequence_id", F.col("start_index").cast("int").alias("start_step_index"), "run_length", "signature", F.col("start").alias("start_ns"), F.col("end").alias("end_ns"), F.col("duration").alias("duration_ns"))


def _clusters(spark: SparkSession, d: str) -> DataFrame:
    return clusters_.clusters(vectors.latest(table(spark, d, "diagnoses"), "diagnosis_id", "created_at", "card_embedding"), DIM)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _clusters(spark, d).select(F.col("id").alias("diagnosis_id"), F.col("medoid").alias("medoid_diagnosis_id"))


def p6_clusters(spark: SparkSession, d: str) -> DataFrame:
    """One row a cluster: its most typical member and size."""
    return _clusters(spark, d).groupBy(F.col("medoid").alias("medoid_diagnosis_id")).agg(F.max("size").alias("labeled_size"), F.round(F.avg("centrality"), 6).alias("mean_cosine"))


def _traces(spark: SparkSession, d: str) -> DataFrame:
    return vectors.latest(table(spark, d, "traces"), "trace_id", "ingested_at", "task_embedding")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    best = neighbours.nearest(_traces(spark, d), DIM, k=5, least=0.80)
    return best.select(F.least("id", "neighbour").alias("trace_id_a"), F.greatest("id", "neighbour").alias("trace_id_b")).distinct()


def p7_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The five most similar other traces of every trace, however similar."""
    return neighbours.nearest(_traces(spark, d), DIM, k=5).select(F.col("id").alias("trace_id"), F.col("neighbour").alias("similar_trace_id"), "rank", F.round("cosine", 6).alias("cosine"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p8_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Leaks with the number of matching windows and the fewest edits."""
    return leakage.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def _mix(spark: SparkSession, d: str) -> mixing.Mix:
    docs = mixing.with_tokens(table(spark, d, "documents").select("doc_id", canonical_source(F.col("source")).alias("source"), "text"))
    return mixing.Mix(docs.select("doc_id", F.array("source").alias("sources"), "tokens"), mixing.read_targets(table(spark, d, "mix_targets"), canonical_source))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d).report().where("falls_short").select("mix_name", "source")


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d).report()


def p9_documents(spark: SparkSession, d: str) -> DataFrame:
    """The documents of every mix and how often each is used."""
    return _mix(spark, d).select()


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.find_residue(table(spark, d, "documents")).select("doc_id")


def p10_clean(spark: SparkSession, d: str) -> DataFrame:
    """The corpus without residue: doc_id and n_chars."""
    docs = table(spark, d, "documents")
    return docs.select("doc_id", "n_chars").join(residue.find_residue(docs).select("doc_id"), "doc_id", "left_anti")


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p1_collapsed, p6_found, p6_clusters, p7_found, p7_neighbours, p8_found, p8_leaks, p9_found, p9_report, p9_documents, p10_found, p10_clean)}

_NORMAL = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(s), '\|.*$', ''), '\([^)]*\)|\[[^\]]*\]', '', 'g'), '[#~]\s*[0-9]+', '', 'g'), '\s*(->|::|[:/>])\s*', ':', 'g'), '[\s_.-]+', '', 'g'), '(^|:)w[0-9]+(:|$)', '\1w\2')"
_RUNS = f"""
with a as (select 'steps' k, trace_id q, step_index i, signature s, start_ns b, end_ns f from steps union all select 'divergences', diagnosis_id, step_index, observed_signature, null, null from divergences),
d as (select k, q, i, min(struct_pack(n := n, b := b, f := f)) r from (select k, q, i, {_NORMAL} n, b, f from a where i is not null) z group by k, q, i),
e as (select k, q, i, r.n n, r.b b, r.f f, case when lag(r.n) over w = r.n then 0 else 1 end fresh from d window w as (partition by k, q order by i)),
g as (select *, sum(fresh) over (partition by k, q order by i) run from e),
h as (select k, q, min(i) i, count(*) c, min(n) n, min_by(b, i) b, max_by(f, i) f from g group by k, q, run)
"""
#: Equivalent SQL where SQL can say it over whole tables.
SQL: dict[str, str] = {
    "p1_found": _RUNS + "select k sequence_kind, q sequence_id, i start_step_index, cast(c as integer) run_length from h where c >= 2",
    "p1_collapsed": _RUNS + "select k sequence_kind, q sequence_id, i start_step_index, cast(c as integer) run_length, n signature, b start_ns, f end_ns, f - b duration_ns from h",
    "p7_found": """
with v as (select trace_id, task_embedding::double[] e from (select *, row_number() over (partition by trace_id order by ingested_at desc nulls last) rn from traces) z where rn = 1 and len(task_embedding) = 384),
u as (select * from v where list_sum(list_transform(e, lambda x: case when isfinite(x) then 0 else 1 end)) = 0 and list_sum(list_transform(e, lambda x: abs(x))) > 0),
s as (select a.trace_id a, b.trace_id b, list_cosine_similarity(a.e, b.e) c from u a join u b on a.trace_id <> b.trace_id),
r as (select *, row_number() over (partition by a order by c desc, b) k from s)
select distinct least(a, b) trace_id_a, greatest(a, b) trace_id_b from r where k <= 5 and c >= 0.8""",
    "p6_found": """
with recursive v as (select diagnosis_id id, card_embedding::double[] e from (select *, row_number() over (partition by diagnosis_id order by created_at desc nulls last) rn from diagnoses) z where rn = 1 and len(card_embedding) = 384),
u as (select * from v where list_sum(list_transform(e, lambda x: case when isfinite(x) then 0 else 1 end)) = 0 and list_sum(list_transform(e, lambda x: abs(x))) > 0),
s as materialized (select a.id a, b.id b, list_cosine_similarity(a.e, b.e) c from u a join u b on true),
reach(a, b) as (select a, b from s where c >= 0.7 union select r.a, s.b from reach r join s on r.b = s.a where s.c >= 0.7),
m as (select a id, min(b) label, count(*) n from reach group by a having count(*) >= 5),
t as (select x.id, x.label, avg(s.c) mean from m x join m y on x.label = y.label join s on s.a = x.id and s.b = y.id group by 1, 2),
w as (select label, id, row_number() over (partition by label order by round(mean, 12) desc, id) k from t)
select m.id diagnosis_id, w.id medoid_diagnosis_id from m join w on m.label = w.label and w.k = 1""",
}
_P6 = SQL["p6_found"].rpartition("select m.id diagnosis_id")[0]
SQL["p6_clusters"] = _P6 + "select w.id medoid_diagnosis_id, max(m.n) labeled_size, round(avg(t.mean), 6) mean_cosine from m join w on m.label = w.label and w.k = 1 join t on t.id = m.id group by w.id"
