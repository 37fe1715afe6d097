"""Transport forms of mask metadata.

Binary form, little-endian: total length u32, text length u32, the matched texts one
after the other in UTF-8, padding to a multiple of four, then 20 bytes a span: id u32,
type u8, three bytes of padding, start u32, end u32, score f32; offsets are bytes in the
joined text. What cannot be decoded gives empty metadata.
"""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BinaryType

from veilframe.config import ENTITY_IDS
from veilframe.operators.mask import META_TYPE

_SPAN = struct.Struct("<IB3xIIf")
_NAMES = {n: name for name, n in ENTITY_IDS.items()}


def encode(entries) -> bytes:
    """entries: dicts or rows with entity_id, entity_type, matched_text, score."""
    texts, spans, at = [], [], 0
    for e in entries:
        raw = e["matched_text"].encode()
        texts.append(raw)
        spans.append(_SPAN.pack(e["entity_id"], ENTITY_IDS.get(e["entity_type"], 0), at, at + len(raw), e["score"]))
        at += len(raw)
    body = struct.pack("<I", at) + b"".join(texts)
    body += b"\0" * (-(len(body) + 4) % 4) + b"".join(spans)
    return struct.pack("<I", len(body) + 4) + body


def decode(data: bytes | None) -> list[dict]:
    if not data or len(data) < 8:
        return []
    total, size = struct.unpack_from("<II", data)
    first = 8 + size + -size % 4
    if total > len(data) or first > total or (total - first) % _SPAN.size:
        return []
    text = bytes(data[8 : 8 + size])
    out = []
    try:
        for number, kind, start, end, score in _SPAN.iter_unpack(bytes(data[first:total])):
            if not start <= end <= size:
                return []
            out.append({"entity_id": number, "entity_type": _NAMES.get(kind, "NONE"), "matched_text": text[start:end].decode(), "score": round(score, 6)})
    except UnicodeDecodeError:
        return []
    return out


@pandas_udf(BinaryType())
def meta_to_binary(meta: pd.Series) -> pd.Series:
    return meta.map(lambda rows: encode(rows if rows is not None else []))


@pandas_udf(META_TYPE)
def meta_from_binary(data: pd.Series) -> pd.Series:
    return data.map(decode)


def meta_to_base64(meta: Column) -> Column:
    return F.base64(meta_to_binary(meta))


def meta_from_base64(text: Column) -> Column:
    return meta_from_binary(F.try_to_binary(text, F.lit("base64")))


def map_to_json64(mapping: Column) -> Column:
    """Placeholder map as base64 of JSON."""
    return F.base64(F.encode(F.to_json(mapping), "UTF-8"))


def map_from_json64(text: Column) -> Column:
    """The inverse; anything that is not base64 of a JSON object of strings gives an empty map."""
    raw = F.try_to_binary(text, F.lit("base64"))
    parsed = F.from_json(F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string")), "map<string,string>")
    return F.coalesce(parsed, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
