"""Scan options and source configurations, validated before any plan is built."""

from __future__ import annotations

import ipaddress
import re
from dataclasses import dataclass, fields, replace
from typing import Any

# Defaults and ceilings of the options.
DEFAULTS = {"max_file_bytes": 20 * 1024 * 1024, "max_files": 10_000, "max_text_chars": 1_000_000, "table_sample_rows": 1_000, "batch_size": 100, "statement_timeout_ms": 5_000, "lock_timeout_ms": 1_000}
CEILINGS = {"max_file_bytes": 100 * 1024 * 1024, "max_files": 100_000, "max_text_chars": 10_000_000, "table_sample_rows": 1_000, "batch_size": 100, "statement_timeout_ms": 30_000, "lock_timeout_ms": 5_000}
CELL_CHARS, ROW_BYTES, BATCH_BYTES = 65_536, 1 << 20, 8 << 20
KINDS = ("filesystem", "smb", "postgresql", "mysql", "mssql", "s3", "azure_blob", "azure_table", "sqlite")
SECRETS = frozenset({"password", "secret_key", "access_key", "account_key", "sas_token", "connection_string", "session_token"})


class InvalidOptions(ValueError):
    """An option that is unknown, of another type, below 1 or over its ceiling."""


@dataclass(frozen=True)
class Options:
    max_file_bytes: int = DEFAULTS["max_file_bytes"]
    max_files: int = DEFAULTS["max_files"]
    max_text_chars: int = DEFAULTS["max_text_chars"]
    table_sample_rows: int = DEFAULTS["table_sample_rows"]
    batch_size: int = DEFAULTS["batch_size"]
    statement_timeout_ms: int = DEFAULTS["statement_timeout_ms"]
    lock_timeout_ms: int = DEFAULTS["lock_timeout_ms"]
    full_scan: bool = False
    capture_evidence: bool = False

    @classmethod
    def of(cls, given: dict[str, Any] | None = None) -> Options:
        known = {f.name for f in fields(cls)}
        for name, value in (given or {}).items():
            if name not in known:
                raise InvalidOptions(name)
            if name in CEILINGS:
                if type(value) is not int or not 1 <= value <= CEILINGS[name]:
                    raise InvalidOptions(name)
            elif type(value) is not bool:
                raise InvalidOptions(name)
        return replace(cls(), **(given or {}))

    @property
    def cell_chars(self) -> int:
        return min(self.max_text_chars, CELL_CHARS)

    def comparable(self) -> tuple:
        """All but what doesn't change findings."""
        return tuple(getattr(self, f.name) for f in fields(self) if f.name != "capture_evidence")


def wide_row_limits(columns: int, cell_chars: int, batch: int, bytes_per_char: int = 4) -> tuple[int, int]:
    """Characters of a cell and rows of a batch such that neither rows nor batches outgrow their bounds."""
    cell = max(1, min(cell_chars, ROW_BYTES // (max(1, columns) * bytes_per_char)))
    return cell, max(1, min(batch, BATCH_BYTES // (max(1, columns) * cell * bytes_per_char)))


def gate(kind: str, options: Options, approved: bool = False, tables: list[str] | None = None) -> tuple[str, str] | None:
    """(status, reason) of a scan that may not start."""
    if kind not in KINDS:
        return "unsupported", "source_kind_not_supported"
    if options.full_scan and kind == "azure_table":
        return "excluded", "azure_table_full_scan_not_supported"
    if options.full_scan and kind in ("postgresql", "mysql", "mssql", "sqlite"):
        if not approved:
            return "excluded", "full_scan_not_approved"
        if not tables:
            return "excluded", "full_scan_requires_explicit_tables"
    return None


def private_address(host: str) -> bool:
    """An address literal or local name that stays inside; names are not looked up."""
    if host.lower() in ("localhost", "localhost."):
        return True
    try:
        address = ipaddress.ip_address(host.strip("[]"))
    except ValueError:
        return False
    return address.is_private or address.is_loopback


def normalized_config(kind: str, config: dict[str, Any]) -> dict[str, Any]:
    """Trimmed strings, distinct tables in order, and errors for what is missing."""
    if kind not in KINDS:
        raise InvalidOptions(kind)
    out = {k: v.strip() if isinstance(v, str) else v for k, v in config.items()}
    needed = {"filesystem": ("root",), "smb": ("server", "share"), "postgresql": ("host", "database"), "mysql": ("host", "database"), "mssql": ("host", "database"), "s3": ("bucket",), "azure_blob": ("container",), "azure_table": ("table",), "sqlite": ("path",)}[kind]
    if missing := [n for n in needed if not out.get(n)]:
        raise InvalidOptions(", ".join(missing))
    if kind == "filesystem" and not str(out["root"]).startswith("/") and "://" not in str(out["root"]):
        raise InvalidOptions("absolute_root_required")
    if "tables" in out:
        tables = out["tables"] if isinstance(out["tables"], list) else re.split(r"[,\n]", out["tables"] or "")
        out["tables"] = list(dict.fromkeys(t.strip() for t in tables if t.strip()))
    return out


def redacted_config(config: dict[str, Any]) -> dict[str, Any]:
    return {k: "[redacted]" if k in SECRETS and v else v for k, v in config.items()}


def quoted(identifier: str) -> str:
    return "`" + identifier.replace("`", "``") + "`"


def permissions_allowed(granted: set[str], allowed: frozenset[str] = frozenset({"SELECT", "USAGE", "CONNECT", "SHOW VIEW", "VIEW DEFINITION"})) -> bool:
    """An account that can do more than read is refused."""
    return {g.upper() for g in granted} <= allowed
