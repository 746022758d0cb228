"""Files whose schemas drift, read into one table with a report of every change.

Lines are loaded as path-value maps with raw types. Path-type statistics by file give the fields of each
file; a file's fields against those of the file before it give what was added, removed or changed its
type. A removed and an added field are one renamed field if the records that both files deliver hold the
same values in them, or, where those records leave it open, if their names and values agree over the
whole files. Renames chain back to the canonical columns, onto which all lines are then projected, with a
report of the casts that failed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.operators.shred import shred
from faultline.runtime import cut

#: Paths that name or type a line and are no fields.
NO_FIELDS = ["span_id", "kind", "status"]
#: Columns of one LLM record and their types; arrays and objects stay JSON text.
LLM_COLUMNS = {
    "provider": "string", "model": "string", "finish_reason": "string", "prompt_tokens": "bigint", "completion_tokens": "bigint",
    "total_tokens": "bigint", "max_tokens": "bigint", "temperature": "double", "request_messages": "string", "response_messages": "string", "tool_calls": "string",
}
FILE = ["producer", "file_seq"]


def load_lines(files: DataFrame) -> DataFrame:
    """One row per line: producer, file_seq, line_no, written_at, span_id and the maps fields and types by dotted path. Bodies that are no JSON object give none."""
    rows = shred(files, ["producer", "file_seq", "line_no", "layout", "written_at"], "body", arrays=[])
    return rows.select("producer", "file_seq", "line_no", "layout", "written_at", F.col("fields")["span_id"].alias("span_id"), "fields", "types")


def path_types(lines: DataFrame) -> DataFrame:
    """Per file and path its most frequent type among non-null values (null where all are null; ties: by name) and the number of lines."""
    each = lines.select(*FILE, F.explode("types").alias("path", "type")).where(~F.col("path").isin(*NO_FIELDS) & (F.col("path") != ""))
    by_type = each.groupBy(*FILE, "path", "type").agg(F.count("*").alias("n"))
    best = F.max(F.when(F.col("type") != "null", F.struct("n", "type")))
    return by_type.groupBy(*FILE, "path").agg(best.getField("type").alias("type"), F.sum("n").alias("lines"))


def _canonical(value: Column) -> Column:
    """A value without what a change of type does to it: quotes, a one-element array, a zero fraction."""
    bare = F.regexp_replace(F.lower(value), r'^\[\s*"?|"?\s*\]$|^\s+|\s+$', "")
    number = bare.try_cast("double")
    return F.when(number.isNotNull(), F.format_string("%.6f", number)).otherwise(bare)


def _words(path: Column) -> Column:
    """The words of a path's last two steps, for comparing names."""
    split = F.regexp_replace(path, r"([a-z0-9])([A-Z])", "$1_$2")
    return F.filter(F.split(F.lower(split), r"[^a-z0-9]+"), lambda w: (w != "") & (w != "attributes"))


def changes(lines: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """Every change of a file against its producer's file before: producer, file_seq, change_type, old_field, new_field.

    The first file of a producer changes nothing. Repeated lines count once; a value that is null on
    either side says nothing about a rename.
    """
    if stats is None:
        lines = cut(lines)  # parsed once, read several times
        stats = cut(path_types(lines))
    files = stats.select(*FILE).distinct()
    before = stats.select("producer", (F.col("file_seq") + 1).alias("file_seq"), "path", F.col("type").alias("old_type"), F.lit(True).alias("was"))
    both = (
        stats.select(*FILE, "path", "type", F.lit(True).alias("now"))
        .join(before, [*FILE, "path"], "full_outer")
        .where("was is null or now is null or type <> old_type")
        .withColumn("what", F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").otherwise("type_changed"))
    )
    first = files.groupBy("producer").agg(F.min("file_seq").alias("first_seq"))
    # what changed is few rows, read by all that follows
    changed = cut(both.join(files, FILE, "left_semi").join(first, "producer").where("file_seq > first_seq").select(*FILE, "path", "what", F.coalesce("type", "old_type").alias("type")))

    # a file with a field gone and another come: their values in the records that both files deliver
    gone, come = changed.where("what = 'removed'"), changed.where("what = 'added'")
    pairs = gone.select(*FILE, F.col("path").alias("old_field"), F.col("type").alias("old_type")).join(come.select(*FILE, F.col("path").alias("new_field"), F.col("type").alias("new_type")), FILE)
    values = lines.where("span_id is not null").select(*FILE, "span_id", F.explode("fields").alias("path", "value")).where("value is not null")
    moved = changed.where("what <> 'type_changed'")
    old_values = cut(
        values.withColumn("file_seq", F.col("file_seq") + 1).join(moved.where("what = 'removed'").select(*FILE, "path"), [*FILE, "path"], "left_semi").groupBy(*FILE, "path", "span_id").agg(F.min(_canonical(F.col("value"))).alias("value"))
    )
    new_values = cut(values.join(moved.where("what = 'added'").select(*FILE, "path"), [*FILE, "path"], "left_semi").groupBy(*FILE, "path", "span_id").agg(F.min(_canonical(F.col("value"))).alias("value")))
    shared = (
        old_values.select(*FILE, "span_id", F.col("path").alias("old_field"), F.col("value").alias("old_value"))
        .join(new_values.select(*FILE, "span_id", F.col("path").alias("new_field"), F.col("value").alias("new_value")), [*FILE, "span_id"])
        .groupBy(*FILE, "old_field", "new_field")
        .agg(F.count(F.when(F.col("old_value") == F.col("new_value"), 1)).alias("same"), F.count(F.when(F.col("old_value") != F.col("new_value"), 1)).alias("other"))
    )
    # whole-file evidence: the share of values in common and how far apart the numbers lie
    # (counted by value, so that no field's values ever meet in one task)
    is_text = F.col("value").try_cast("double").isNull()
    texts = lambda df, p: df.where(is_text).select(*FILE, F.col("path").alias(f"{p}_field"), "value").distinct()
    old_texts, new_texts = texts(old_values, "old"), texts(new_values, "new")
    in_common = old_texts.join(new_texts, [*FILE, "value"]).groupBy(*FILE, "old_field", "new_field").agg(F.count("*").alias("n_common"))
    summary = lambda df, p: df.groupBy(*FILE, F.col("path").alias(f"{p}_field")).agg(F.avg(F.col("value").try_cast("double")).alias(f"{p}_mean"))
    kinds = lambda df, p: df.groupBy(*FILE, f"{p}_field").agg(F.count("*").alias(f"{p}_texts"))
    scored = pairs.join(shared, [*FILE, "old_field", "new_field"], "left").join(in_common, [*FILE, "old_field", "new_field"], "left")
    for df, p, t in ((old_values, "old", old_texts), (new_values, "new", new_texts)):
        scored = scored.join(summary(df, p), [*FILE, f"{p}_field"], "left").join(kinds(t, p), [*FILE, f"{p}_field"], "left")
    common = F.coalesce("n_common", F.lit(0)) / F.greatest(F.lit(1), F.least("old_texts", "new_texts"))
    near = F.least(F.abs("old_mean"), F.abs("new_mean")) / F.greatest(F.abs("old_mean"), F.abs("new_mean"), F.lit(1e-9))
    names = F.size(F.array_intersect(_words(F.col("old_field")), _words(F.col("new_field"))))
    # a name within the other's last step ('temp' in 'temperature') counts as a word in common
    last = lambda c: F.regexp_replace(F.lower(F.element_at(F.split(c, r"\."), -1)), "[^a-z]", "")
    inside = (F.length(last(F.col("new_field"))) > 2) & (F.contains(last(F.col("old_field")), last(F.col("new_field"))) | F.contains(last(F.col("new_field")), last(F.col("old_field"))))
    same, other = F.coalesce("same", F.lit(0)), F.coalesce("other", F.lit(0))
    alike = F.greatest(F.coalesce(common, F.lit(0.0)), F.coalesce(near, F.lit(0.0)))
    open_case = (same + other == 0) & ((names > 0) | inside | (F.coalesce(common, F.lit(0.0)) >= 0.5)) & (alike >= 0.5)
    score = F.when((same > 0) & (same > 3 * other), same + 1.0 + (names + inside.cast("int")) / 10).when(open_case, 0.2 + alike / 2 + (names + inside.cast("int")) / 10)
    ranked = scored.select(*FILE, "old_field", "new_field", score.alias("score")).where("score is not null")
    per = lambda c: F.row_number().over(Window.partitionBy(*FILE, c).orderBy(F.desc("score"), "old_field", "new_field"))
    renamed = cut(ranked.withColumn("r_old", per("old_field")).withColumn("r_new", per("new_field")).where("r_old = 1 and r_new = 1").select(*FILE, "old_field", "new_field"))

    gone_left = gone.select(*FILE, F.col("path").alias("old_field")).join(renamed, [*FILE, "old_field"], "left_anti")
    come_left = come.select(*FILE, F.col("path").alias("new_field")).join(renamed, [*FILE, "new_field"], "left_anti")
    out = lambda df, what, old, new: df.select(*FILE, F.lit(what).alias("change_type"), old.alias("old_field"), new.alias("new_field"))
    return (
        out(renamed, "renamed", F.col("old_field"), F.col("new_field"))
        .unionByName(out(gone_left, "removed", F.col("old_field"), F.lit("")))
        .unionByName(out(come_left, "added", F.lit(""), F.col("new_field")))
        .unionByName(out(changed.where("what = 'type_changed'"), "type_changed", F.col("path"), F.col("path")))
    )


def canonical_fields(stats: DataFrame, report: DataFrame) -> DataFrame:
    """Per file and field the canonical column it holds, through all renames: producer, file_seq, path, column.

    A field of a producer's rename chain stands for the chain's one canonical name. The chain is followed as
    sets of names per producer, in as many steps as it is long; fields are few, whatever the rows.
    """
    own = F.regexp_extract("path", r"^(?:attributes\.)?(.*)$", 1)
    fields = stats.select(*FILE, "path").withColumn("column", F.when(own.isin(*LLM_COLUMNS), own))
    renames = report.where("change_type = 'renamed'").select("producer", "file_seq", "old_field", "new_field")
    # a producer's schema history is small: its files and renames, never its lines
    history = renames.groupBy("producer").agg(F.array_sort(F.collect_list(F.struct("file_seq", "old_field", "new_field"))).alias("renames"))

    def origin(path: Column, seq: Column, renames: Column) -> Column:
        back = F.aggregate(F.reverse(F.filter(renames, lambda r: r["file_seq"] <= seq)), path, lambda acc, r: F.when(r["new_field"] == acc, r["old_field"]).otherwise(acc))
        return back

    def final(path: Column, seq: Column, renames: Column) -> Column:
        return F.aggregate(F.filter(renames, lambda r: r["file_seq"] > seq), path, lambda acc, r: F.when(r["old_field"] == acc, r["new_field"]).otherwise(acc))

    bare = lambda c: F.regexp_extract(c, r"^(?:attributes\.)?(.*)$", 1)
    joined = fields.join(history, "producer", "left").withColumn("renames", F.coalesce("renames", F.array().cast("array<struct<file_seq:int,old_field:string,new_field:string>>")))
    first, last = bare(origin(F.col("path"), F.col("file_seq"), F.col("renames"))), bare(final(F.col("path"), F.col("file_seq"), F.col("renames")))
    named = F.coalesce(F.col("column"), F.when(first.isin(*LLM_COLUMNS), first), F.when(last.isin(*LLM_COLUMNS), last))
    return joined.select(*FILE, "path", named.alias("column"))


def unify(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(table, changes, failed casts): all lines as LLM_COLUMNS, once per producer, file and span_id.

    A value that its column's type cannot hold is null in the table and counted in failed casts (producer,
    file_seq, path, column, values, failed). Fields that stand for no canonical column stay out of the table.
    """
    lines = cut(load_lines(files))
    stats = cut(path_types(lines))
    report = cut(changes(lines, stats))
    mapped = canonical_fields(stats, report).where("column is not null")
    # each file's mapping as one small map, so that its lines need one join and no pivot
    maps = mapped.groupBy(*FILE).agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("path", "column")))).alias("columns"))
    with_map = lines.join(maps, FILE, "left")
    def typed(c: str, t: str) -> Column:
        raw = F.when(F.size(F.filter(F.map_values(F.coalesce("columns", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))), lambda x: x == c)) > 0, F.get(F.filter(F.transform(F.map_keys("columns"), lambda p: F.when(F.col("columns")[p] == c, F.col("fields")[p])), lambda v: v.isNotNull()), F.lit(0)))
        bare = F.regexp_replace(raw, r'^\[\s*"?|"?\s*\]$', "") if t in ("bigint", "double") else raw
        return (bare.try_cast("double").try_cast("bigint") if t == "bigint" else bare.try_cast(t)).alias(c)

    table = with_map.select(*FILE, "line_no", "span_id", *(typed(c, t) for c, t in LLM_COLUMNS.items()))
    table = table.withColumn("__n", F.row_number().over(Window.partitionBy(*FILE, "span_id").orderBy("line_no"))).where("__n = 1 or span_id is null").drop("__n")
    kind = F.create_map(*(F.lit(x) for kv in LLM_COLUMNS.items() for x in kv))
    each = lines.select(*FILE, F.explode("fields").alias("path", "value")).where("value is not null").join(mapped, [*FILE, "path"])
    number = F.regexp_replace("value", r'^\[\s*"?|"?\s*\]$', "").try_cast("double")
    bad = kind[F.col("column")].isin("bigint", "double") & number.isNull()
    failed = each.groupBy(*FILE, "path", "column").agg(F.count("*").alias("values"), F.count(F.when(bad, 1)).alias("failed")).where("failed > 0")
    return table, report, failed
