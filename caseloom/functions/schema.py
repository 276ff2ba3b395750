"""Names and column meaning: file identities, suffix rules, feature names and fingerprints."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import types as T

# Columns that are structure, never predictors, and names that would leak the target.
STRUCTURAL = frozenset({"case_id", "target", "WEEK_NUM", "MONTH", "date_decision", "num_group1", "num_group2"})
LEAKS = frozenset({"target", "score", "prediction", "predicted_target"})
KINDS = ("numeric", "categorical", "date", "unsupported")

# What a column's suffix means where its type says nothing. Columns ending in D are dates whatever their type.
UNTYPED = {"M": "categorical", "A": "numeric", "P": "numeric", "L": "numeric"}
DATE_SUFFIX = "D"

_FILE = re.compile(r"(train|test)_(.+)\.parquet")
_TIMES = (T.DateType, T.TimestampType, T.TimestampNTZType, T.TimeType, T.DayTimeIntervalType, T.YearMonthIntervalType)


@dataclass(frozen=True)
class TableIdentity:
    split: str
    family: str
    depth: int
    shard: int | None = None

    @property
    def logical_name(self) -> str:
        return self.family if self.family == "base" else f"{self.family}_{self.depth}"


def parse_file_name(name: str) -> TableIdentity:
    """``{train|test}_base``, ``_{family}_{depth}`` or ``_{family}_{depth}_{shard}``; a family may hold '_'."""
    found = _FILE.fullmatch(name)
    if not found:
        raise ValueError(f"not a table file: {name}")
    split, body = found.groups()
    if body == "base":
        return TableIdentity(split, "base", 0)
    for pattern in (r"(.+)_([012])_(\d+)", r"(.+)_([012])"):
        if parts := re.fullmatch(pattern, body):
            return TableIdentity(split, parts[1], int(parts[2]), int(parts[3]) if len(parts.groups()) > 2 else None)
    raise ValueError(f"no depth in {name}")


def typed(kind: str) -> T.DataType:
    """The Spark type that a simple string, such as a catalog holds, stands for."""
    return T.StructType.fromDDL(f"c {kind}")[0].dataType


def holds_text(kind: T.DataType) -> bool:
    parts = [kind.elementType] if isinstance(kind, T.ArrayType) else [kind.keyType, kind.valueType] if isinstance(kind, T.MapType) else [f.dataType for f in kind] if isinstance(kind, T.StructType) else []
    return isinstance(kind, T.StringType) or any(map(holds_text, parts))


def by_type(kind: T.DataType) -> str:
    if isinstance(kind, T.NumericType):
        return "numeric"
    if isinstance(kind, T.BooleanType) or holds_text(kind):
        return "categorical"
    return "date" if isinstance(kind, _TIMES) else "unsupported"


def classify(name: str, kind: T.DataType) -> str:
    """Meaning of a column of this name and Spark type; a void column has no type and goes by its suffix."""
    if name in STRUCTURAL:
        return "structural"
    if name.endswith(DATE_SUFFIX):
        return "date"
    return UNTYPED.get(name[-1:], "unsupported") if isinstance(kind, T.NullType) else by_type(kind)


def resolve(observations: Iterable[dict[str, str]]) -> dict[str, str]:
    """One meaning per column from those of all shards of both splits (name -> meaning each)."""
    seen: dict[str, set[str]] = {}
    for shard in observations:
        for name, meaning in shard.items():
            if meaning != "structural":
                seen.setdefault(name, set()).add(meaning)
    out = {}
    for name, kinds in sorted(seen.items()):
        order = ["date", *(["categorical"] if name.endswith("M") else ["numeric"] if name[-1:] in "AP" else []), "categorical", "numeric"]
        out[name] = next((k for k in order if k in kinds or (k == "categorical" and name.endswith("M"))), "unsupported")
    return out


def assert_no_leak(columns: Iterable[str], context: str) -> None:
    if found := sorted(LEAKS & set(columns)):
        raise ValueError(f"{context} holds target columns: {', '.join(found)}")


def feature_name(family: str, depth: int, column: str, operation: str, subgroup: str | None = None) -> str:
    return "__".join([family, f"d{depth}", *([subgroup] if subgroup else []), column, operation])


def fingerprint(fields: Sequence[tuple[str, str, bool]]) -> str:
    """SHA-256 of the ordered (name, type, nullable) list."""
    payload = json.dumps([{"name": n, "nullable": x, "type": t} for n, t, x in fields], separators=(",", ":"), sort_keys=True)
    return hashlib.sha256(payload.encode()).hexdigest()


class Sealed:
    """A protocol, and its digest over compact UTF-8 JSON with sorted keys, the digest itself left out."""

    KEY = "protocol_sha256"

    def __init__(self, payload: dict) -> None:
        self.content = {k: v for k, v in payload.items() if k != self.KEY}

    @property
    def digest(self) -> str:
        text = json.dumps(self.content, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        return hashlib.sha256(text.encode()).hexdigest()

    def payload(self) -> dict:
        return {**self.content, self.KEY: self.digest}

    @classmethod
    def opened(cls, payload: dict) -> Sealed:
        """Refuses a payload whose digest does not fit."""
        found = cls(payload)
        if payload.get(cls.KEY) != found.digest:
            raise ValueError("the protocol does not fit its digest")
        return found
