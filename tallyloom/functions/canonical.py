"""Canonical JSON, hashes and small text helpers."""

from __future__ import annotations

import hashlib
import json
import math
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def _plain(value: Any) -> Any:
    if isinstance(value, float):
        if not math.isfinite(value):
            return None
        return int(value) if value == int(value) and abs(value) < 2**53 else value
    if isinstance(value, dict):
        return {str(k): _plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    return value


def canonical_json(value: Any) -> str:
    """Keys sorted at every depth; numbers as JSON writes them (1.0 and -0.0 as integers); what is not finite is null."""
    return json.dumps(_plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def hash_object(value: Any) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def short_hash(value: Any, length: int = 10) -> str:
    return hash_object(value)[:length]


def prompt_hash_value(system: str, user: str, model: str, temperature: float) -> str:
    return hash_object({"system": system, "user": user, "model": model, "temperature": temperature})


def json_text(text: Column) -> Column:
    """A string as JSON writes it."""
    return F.substring(F.to_json(F.array(text)), F.lit(2), F.length(F.to_json(F.array(text))) - 2)


def prompt_hash(system: Column, user: Column, model: str, temperature: str = "0") -> Column:
    """The same hash as prompt_hash_value, on columns."""
    parts = (F.lit('{"model":'), json_text(F.lit(model)), F.lit(',"system":'), json_text(system), F.lit(f',"temperature":{temperature},"user":'), json_text(user), F.lit("}"))
    return F.sha2(F.concat(*parts), 256)


def clip(text: Column, length: int = 240) -> Column:
    return F.substring(text, 1, length)


def confidence_band(confidence: Column) -> Column:
    return F.when(confidence < 0.5, "low").when(confidence < 0.8, "mid").otherwise("high")


def strip_offset(variance: Column, amount: Column) -> Column:
    """Where a variance is drawn: its share of the amount times 40, held to -12..12."""
    return F.greatest(F.lit(-12.0), F.least(F.lit(12.0), variance / F.greatest(F.abs(amount), F.lit(1)) * 40))


@F.pandas_udf(StringType())
def extract_json(texts):
    """The first balanced {...} of each text, strings and escapes respected; null if there is none."""
    return texts.map(first_object)


def first_object(text: str | None) -> str | None:
    begin = text.find("{") if isinstance(text, str) else -1
    if begin < 0:
        return None
    depth, quoted, escaped = 0, False, False
    for i in range(begin, len(text)):
        c = text[i]
        if quoted:
            quoted, escaped = escaped or c != '"', c == "\\" and not escaped
        elif c == '"':
            quoted = True
        elif c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if not depth:
                return text[begin : i + 1]
    return None
