"""Nested records to flat tables.

Every body is parsed once into path-value-ordinal triples. A path ends a *group* at each repeated
ancestor (an array), so all triples under the same array element share one group and one ordinal vector;
pivoting a group gives one flat table whose rows name their parent by the shorter ordinal vector.
Arrays that nest in themselves (child_spans) fold into one group, whatever their depth.

The parse and the pivot of a record need nothing but that record, so they run in one pass over the scan
without a shuffle. ``keep`` prunes fields inside the parser, as a column projection would.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "group string, ordinals array<int>, parent_group string, parent_ordinals array<int>, parent_key string, is_null boolean, fields map<string,string>, types map<string,string>"


class Number(str):
    """The digits of a JSON number as they were written."""


class Fraction(Number):
    """A number with a fraction or exponent."""


def _reject(name: str):
    raise ValueError(name)


def parse(body: str | None):
    """The value of a body, after a byte-order mark; ValueError if it is not JSON."""
    if body is None:
        raise ValueError("null")
    try:
        return json.loads(body.lstrip("﻿"), parse_int=Number, parse_float=Fraction, parse_constant=_reject)
    except RecursionError as e:
        raise ValueError("nested too deeply") from e


def kind_of(v) -> str:
    if v is None:
        return "null"
    if v is True or v is False:
        return "boolean"
    if isinstance(v, Fraction):
        return "number"
    if isinstance(v, Number):
        return "integer"
    if isinstance(v, str):
        return "string"
    return "array" if isinstance(v, list) else "object"


def text_of(v) -> str | None:
    if v is None:
        return None
    if v is True or v is False:
        return "true" if v else "false"
    if isinstance(v, str):
        return str(v)
    return dump(v)


def dump(v) -> str:
    """JSON text of a parsed value, numbers as written."""
    if isinstance(v, Number):
        return str(v)
    if isinstance(v, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{dump(x)}" for k, x in v.items()) + "}"
    if isinstance(v, list):
        return "[" + ",".join(map(dump, v)) + "]"
    return json.dumps(v, ensure_ascii=False)


def shred_value(value, arrays: frozenset[str], keep: frozenset[str] | None, link: frozenset[str] = frozenset(), whole: frozenset[str] = frozenset()):
    """Rows (group, ordinals, parent group, parent ordinals, parent key, is_null, fields, types) of one parsed body.

    arrays: keys at which an array is due. There null or nothing is an empty array and one lone object an
    array of one; text stays a plain value. Null entries keep their position and come out with is_null.
    keep: relative paths to emit, None for all. link: paths whose value names a row; the parent key is
    that of the nearest ancestor that has one, else null. whole: paths whose objects stay one JSON text.
    """
    rows: list[tuple] = []
    # an entry: value, group, ordinals, parent group, parent ordinals
    stack: list[tuple] = [(value, "", (), None, (), None)]
    while stack:
        v, group, ords, pgroup, pords, above = stack.pop()
        own = above
        fields: dict[str, str | None] = {}
        types: dict[str, str] = {}
        nested: list[tuple] = []
        inner = [("", v)]
        while inner:
            path, x = inner.pop()
            key = path.rpartition(".")[2]
            if path and key in arrays and isinstance(x, (list, dict)):
                steps = group.split("/")
                child = group if steps[-1] == path else f"{group}/{path}" if group else path
                for i, e in enumerate(x if isinstance(x, list) else [x]):
                    nested.append((e, child, (*ords, i), group, ords))
                continue
            if isinstance(x, dict) and path in whole:
                fields[path], types[path] = dump(x), "object"
                continue
            if isinstance(x, dict):
                inner.extend((f"{path}.{k}" if path else k, y) for k, y in reversed(x.items()))
                continue
            if path in link and x is not None:
                own = text_of(x)
            if keep is None or path in keep:
                fields[path] = text_of(x)
                types[path] = kind_of(x)
        rows.append((group, ords, pgroup, pords, above, v is None, fields, types))
        stack.extend((*n, own) for n in reversed(nested))
    return rows


def shred(df: DataFrame, id_cols: list[str], body: str, arrays: list[str], keep: list[str] | None = None, groups: list[str] | None = None, link: list[str] | None = None, whole: list[str] | None = None) -> DataFrame:
    """One row per element of each repeated group of the bodies of df; columns id_cols and SCHEMA.

    A body that is not JSON gives no rows here (see invalid_bodies); a null body is not JSON. Other
    columns of df are not read. groups: only these groups are returned, None for all.
    """
    source = df.select(*id_cols, F.col(body).alias("__body"))
    schema = ", ".join([*(f"`{c}` {t}" for c, t in df.select(*id_cols).dtypes), SCHEMA])
    wanted, kept, only, names_row, entire = frozenset(arrays), None if keep is None else frozenset(keep), None if groups is None else frozenset(groups), frozenset(link or []), frozenset(whole or [])

    types = [pa.string(), pa.list_(pa.int32()), pa.string(), pa.list_(pa.int32()), pa.string(), pa.bool_(), pa.map_(pa.string(), pa.string()), pa.map_(pa.string(), pa.string())]
    names = ["group", "ordinals", "parent_group", "parent_ordinals", "parent_key", "is_null", "fields", "types"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):  # bounds what one output batch holds
                part = batch.slice(start, 512)
                at: list[int] = []
                out: list[tuple] = []
                for i, text in enumerate(part.column(part.num_columns - 1).to_pylist()):
                    try:
                        value = parse(text)
                    except ValueError:
                        continue
                    for row in shred_value(value, wanted, kept, names_row, entire):
                        if only is None or row[0] in only:
                            at.append(i)
                            out.append(row)
                take = pa.array(at, pa.int64())
                cols = [part.column(j).take(take) for j in range(part.num_columns - 1)]
                for j, t in enumerate(types):
                    cols.append(pa.array([list(r[j].items()) if j >= 6 else r[j] for r in out], t))
                yield pa.RecordBatch.from_arrays(cols, names=[*id_cols, *names])

    return source.mapInArrow(run, schema)


def triples(shredded: DataFrame, id_cols: list[str]) -> DataFrame:
    """The same as path-value-ordinal triples, one row each: path, ordinals, value, type."""
    return shredded.select(*id_cols, "group", "ordinals", "types", F.explode("fields").alias("relative", "value")).select(
        *id_cols, F.concat_ws("/", F.when(F.col("group") != "", F.col("group")), "relative").alias("path"), "ordinals", "value", F.col("types")[F.col("relative")].alias("type")
    )


def invalid_bodies(df: DataFrame, id_cols: list[str], body: str) -> DataFrame:
    """The records whose body is not JSON."""
    clean = F.regexp_replace(F.col(body), "^﻿+", "")
    return df.where(F.try_parse_json(clean).isNull()).select(*id_cols)
