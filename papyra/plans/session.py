"""What a role may see on behalf of a tenant. A session is the only way to a table, so no query takes a tenant as an argument.

Templates and masks belong to a tenant or, with a null tenant, to the vendor. Without a tenant only vendor rows are visible.
This keeps honest code apart; it is no barrier against someone who holds the SparkSession.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROLES = ("api_service", "worker", "read_api", "synthesis")
SHARED = ("templates", "masks", "entries")
OWNED = ("documents", "jobs", "review_items", "values")


@dataclass(frozen=True)
class TenantSession:
    role: str
    tenant: str | None = None

    def __post_init__(self):
        if self.role not in ROLES:
            raise ValueError(f"unknown role {self.role}")

    def bound(self, tenant: str | None) -> TenantSession:
        """This role for another tenant; '' is no tenant."""
        return TenantSession(self.role, tenant or None)

    def predicate(self, table: str) -> Column:
        owner, own = F.col("tenant_id"), F.lit(False) if self.tenant is None else F.col("tenant_id") == F.lit(self.tenant)
        if self.role == "synthesis":
            seen = {"templates": owner.isNull(), "masks": F.col("scope") == "vendor"} if table in SHARED else None
            if seen is None:
                raise PermissionError(f"{self.role} may not read {table}")
            return seen.get(table, F.lit(False))
        if table == "outbox" and self.role not in ("api_service", "worker"):
            raise PermissionError(f"{self.role} may not read {table}")
        if table in SHARED:
            return owner.isNull() | F.coalesce(own, F.lit(False))
        if table in (*OWNED, "outbox"):
            return F.coalesce(own, F.lit(False))
        raise KeyError(table)

    def table(self, rows: DataFrame, table: str) -> DataFrame:
        """rows of a table that the session may see; the predicate reaches the scan."""
        return rows.where(self.predicate(table))
