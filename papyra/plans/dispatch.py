"""The four read operations behind an allow-list: parameters are checked before any plan is made."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.operators import reading
from papyra.plans.session import TenantSession

MOST_SEARCHED = 20


class Refused(ValueError):
    """An operation that isn't known, or parameters that aren't allowed; code says which."""

    def __init__(self, code: str, what: str):
        super().__init__(f"{code}: {what}")
        self.code = code


@dataclass(frozen=True)
class Parameter:
    kind: type
    required: bool = True
    low: int | None = None
    high: int | None = None
    keys: frozenset[str] | None = None


@dataclass(frozen=True)
class Operation:
    run: Callable[..., DataFrame]
    parameters: Mapping[str, Parameter] = field(default_factory=dict)


def check(operations: Mapping[str, Operation], name: str, given: Mapping[str, object]) -> Operation:
    """Unknown operation, unknown, missing, wrongly typed, out of bounds, forbidden keys: looked at in that order. A bool is no int."""
    if name not in operations:
        raise Refused("unknown_operation", name)
    spec = operations[name].parameters
    if strange := sorted(set(given) - set(spec)):
        raise Refused("unknown_parameter", strange[0])
    if missing := sorted(p for p, s in spec.items() if s.required and p not in given):
        raise Refused("missing_parameter", missing[0])
    for p, v in given.items():
        if not isinstance(v, spec[p].kind) or (isinstance(v, bool) and spec[p].kind is not bool):
            raise Refused("wrong_type", p)
    for p, v in given.items():
        s = spec[p]
        if (s.low is not None and v < s.low) or (s.high is not None and v > s.high):
            raise Refused("out_of_bounds", p)
    for p, v in given.items():
        if spec[p].keys is not None and not set(v) <= spec[p].keys:
            raise Refused("forbidden_keys", p)
    return operations[name]


@dataclass(frozen=True)
class Reader:
    """Tables as one session sees them; ``tables`` has documents, values, masks, entries."""

    session: TenantSession
    tables: Mapping[str, DataFrame]

    def _seen(self, table: str) -> DataFrame:
        return self.session.table(self.tables[table], table)

    def values(self) -> DataFrame:
        return reading.document_values(self._seen("documents"), self._seen("values"))

    def resolved(self) -> DataFrame:
        return reading.resolved_masks(self._seen("masks"), self._seen("entries"))

    def get_document_value(self, document_id: str, system_context: str, semantic_role: str) -> DataFrame:
        return reading.value_by_role(self.values().where(F.col("document_id") == document_id), self.resolved(), system_context, semantic_role)

    def get_document_section(self, document_id: str, system_context: str, section_path: str) -> DataFrame:
        found = reading.sections(self.values().where(F.col("document_id") == document_id), self.resolved(), system_context)
        return reading.section_values(found, section_path).orderBy("element_id")

    def search_document_sections(self, query: str, system_context: str, limit: int = MOST_SEARCHED, document_id: str | None = None) -> DataFrame:
        return reading.search_sections(reading.sections(self.values(), self.resolved(), system_context), query, limit, document_id)

    def get_provenance(self, document_id: str, element_id: str) -> DataFrame:
        return self.values().where((F.col("document_id") == document_id) & (F.col("element_id") == element_id)).select("document_id", "element_id", *reading.PROVENANCE)


_TEXT = Parameter(str)
OPERATIONS = {
    "get_document_value": Operation(Reader.get_document_value, {"document_id": _TEXT, "system_context": _TEXT, "semantic_role": _TEXT}),
    "get_document_section": Operation(Reader.get_document_section, {"document_id": _TEXT, "system_context": _TEXT, "section_path": _TEXT}),
    "search_document_sections": Operation(Reader.search_document_sections, {"query": _TEXT, "system_context": _TEXT, "limit": Parameter(int, False, 1, MOST_SEARCHED), "document_id": Parameter(str, False)}),
    "get_provenance": Operation(Reader.get_provenance, {"document_id": _TEXT, "element_id": _TEXT}),
}


def dispatch(reader: Reader, name: str, given: Mapping[str, object], operations: Mapping[str, Operation] = OPERATIONS) -> DataFrame:
    return check(operations, name, given).run(reader, **given)


def allowed_schemas(requests: DataFrame, policy: DataFrame) -> DataFrame:
    """Requests whose tenant may bind their target schema; what the policy does not name is denied."""
    return requests.join(policy.select("tenant_id", "target_schema"), ["tenant_id", "target_schema"], "left_semi")


@dataclass(frozen=True)
class Retention:
    keep: int = 3

    def __post_init__(self):
        if self.keep < 1:
            raise ValueError("at least one set must be kept")


@dataclass(frozen=True)
class Costs:
    region: float = 0.1
    layout: float = 1.0
    model: float = 1.0

    def __post_init__(self):
        if min(self.region, self.layout, self.model) < 0:
            raise ValueError("a cost is negative")


@dataclass(frozen=True)
class Guard:
    failures: int = 3
    cool_s: float = 30.0
    cap: float = 100.0
    calls: int = 60
    window_s: float = 60.0

    def __post_init__(self):
        if self.failures < 1 or self.calls < 1 or min(self.cool_s, self.window_s) <= 0 or self.cap < 0:
            raise ValueError("a guard's bounds must be positive")
