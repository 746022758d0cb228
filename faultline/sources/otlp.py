"""OpenTelemetry payloads to raw spans: JSON and protobuf bodies give the same rows.

A raw span: trace_id, span_id, parent_span_id, name, otel_kind, start_ns, end_ns, status_code, status_message,
attributes (JSON text of a flat object). A body that cannot be read gives one row with error set and nothing else.
"""

from __future__ import annotations

import base64
import json
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.operators.shred import dump, parse

FIELDS = [("trace_id", "string"), ("span_id", "string"), ("parent_span_id", "string"), ("name", "string"), ("otel_kind", "string"), ("start_ns", "bigint"), ("end_ns", "bigint"), ("status_code", "string"), ("status_message", "string"), ("attributes", "string"), ("error", "string")]
SCHEMA = ", ".join(f"{n} {t}" for n, t in FIELDS)
# Fixed values of the wire format.
KINDS = ["SPAN_KIND_UNSPECIFIED", "SPAN_KIND_INTERNAL", "SPAN_KIND_SERVER", "SPAN_KIND_CLIENT", "SPAN_KIND_PRODUCER", "SPAN_KIND_CONSUMER"]
STATUS = ["STATUS_CODE_UNSET", "STATUS_CODE_OK", "STATUS_CODE_ERROR"]


def any_value(v):
    """The plain value of a JSON AnyValue; None for an unknown kind."""
    if not isinstance(v, dict):
        return None
    if "arrayValue" in v:
        return [any_value(x) for x in as_list((v["arrayValue"] or {}).get("values"))]
    if "kvlistValue" in v:
        return {x.get("key"): any_value(x.get("value")) for x in as_list((v["kvlistValue"] or {}).get("values"))}
    if "intValue" in v:
        return int(v["intValue"])
    if "doubleValue" in v:
        return float(v["doubleValue"])
    for k in ("stringValue", "boolValue", "bytesValue"):
        if k in v:
            return v[k]
    return None


def as_list(v) -> list:
    """The non-null entries of what is due to be an array: null is empty, a lone object an array of one."""
    return [x for x in (v if isinstance(v, list) else [] if v is None else [v]) if x is not None]


def from_json(body: str) -> list[tuple]:
    out = []
    root = parse(body)
    for r in as_list(root.get("resourceSpans")):
        for s in as_list(r.get("scopeSpans")):
            for x in as_list(s.get("spans")):
                attrs = {a.get("key"): any_value(a.get("value")) for a in as_list(x.get("attributes"))}
                status = x.get("status") or {}
                ns = lambda k, x=x: int(x[k]) if str(x.get(k) or "").isdigit() else None
                out.append((x.get("traceId"), x.get("spanId"), x.get("parentSpanId") or None, x.get("name") or "", x.get("kind"), ns("startTimeUnixNano"), ns("endTimeUnixNano"), status.get("code") or STATUS[0], status.get("message"), dump(attrs), None))
    return out


def _varint(b: bytes, i: int) -> tuple[int, int]:
    v = shift = 0
    while True:
        v |= (b[i] & 127) << shift
        i += 1
        if not b[i - 1] & 128:
            return v, i
        shift += 7


def message(b: bytes) -> dict[int, list]:
    """Fields of a protobuf message by number: integers, or bytes of what has a length."""
    out: dict[int, list] = {}
    i = 0
    while i < len(b):
        tag, i = _varint(b, i)
        wire = tag & 7
        if wire == 0:
            v, i = _varint(b, i)
        elif wire == 1:
            v, i = b[i : i + 8], i + 8
        elif wire == 2:
            n, i = _varint(b, i)
            if i + n > len(b):
                raise ValueError("a field runs past its message")
            v, i = b[i : i + n], i + n
        elif wire == 5:
            v, i = b[i : i + 4], i + 4
        else:
            raise ValueError(f"unknown wire type {wire}")
        out.setdefault(tag >> 3, []).append(v)
    return out


def _value(b: bytes):
    m = message(b)
    if 1 in m:
        return m[1][-1].decode()
    if 2 in m:
        return bool(m[2][-1])
    if 3 in m:
        v = m[3][-1]
        return v - (1 << 64) if v >> 63 else v
    if 4 in m:
        return struct.unpack("<d", m[4][-1])[0]
    if 5 in m:
        return [_value(x) for x in message(m[5][-1]).get(1, [])]
    if 6 in m:
        return _pairs(message(m[6][-1]).get(1, []))
    if 7 in m:
        return base64.b64encode(m[7][-1]).decode()
    return None


def _pairs(items: list[bytes]) -> dict:
    out = {}
    for x in items:
        m = message(x)
        out[m.get(1, [b""])[-1].decode()] = _value(m.get(2, [b""])[-1])
    return out


def from_protobuf(body: bytes) -> list[tuple]:
    out = []
    for r in message(body).get(1, []):
        for s in message(r).get(2, []):
            for x in message(s).get(2, []):
                m = message(x)
                text = lambda n, m=m: m.get(n, [b""])[-1].decode()
                hexed = lambda n, m=m: m.get(n, [b""])[-1].hex()
                ns = lambda n, m=m: struct.unpack("<Q", m[n][-1])[0] if n in m else None
                status = message(m[15][-1]) if 15 in m else {}
                pick = lambda names, v: names[v] if v < len(names) else names[0]
                out.append((hexed(1), hexed(2), hexed(4) or None, text(5), pick(KINDS, m.get(6, [0])[-1]), ns(7), ns(8), pick(STATUS, status.get(3, [0])[-1]), status[2][-1].decode() if 2 in status else None, json.dumps(_pairs(m.get(9, [])), ensure_ascii=False, separators=(",", ":")), None))
    return out


def is_raw_upload(body: Column) -> Column:
    """Whether a JSON body is a direct upload: it has spans and no resourceSpans, whatever its content type says."""
    v = F.try_parse_json(body)
    return F.coalesce(F.try_variant_get(v, "$.spans", "variant").isNotNull() & F.try_variant_get(v, "$.resourceSpans", "variant").isNull(), F.lit(False))


def decode(payloads: DataFrame, body: str, key: str, protobuf: bool = False) -> DataFrame:
    """key and the raw spans of every payload; body is text, or binary with protobuf set."""
    kind = dict(payloads.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, rows = [], []
            for i, x in enumerate(b.column(1).to_pylist()):
                try:
                    spans = (from_protobuf if protobuf else from_json)(x)
                except Exception as e:  # noqa: BLE001 - a bad body is a row, not a failed task
                    spans = [(*[None] * (len(FIELDS) - 1), f"{type(e).__name__}: {e}"[:200])]
                at.extend([i] * len(spans))
                rows.extend(spans)
            cols = list(zip(*rows, strict=True)) or [()] * len(FIELDS)
            types = [pa.int64() if t == "bigint" else pa.string() for _, t in FIELDS]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=[key, *(n for n, _ in FIELDS)])

    return payloads.select(key, body).where(F.col(body).isNotNull()).mapInArrow(run, f"{key} {kind}, {SCHEMA}")
