"""Partner feeds onto one canonical schema, from configuration alone."""

from __future__ import annotations

from dataclasses import dataclass, field

import yaml
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import date_error, parse_date
from ..functions.tokens import strip

CANONICAL = ("partner_member_id", "first_name", "last_name", "dob", "ssn", "ssn_last4", "street", "city", "state", "zip", "phone", "email")


@dataclass(frozen=True)
class PartnerMapping:
    partner_id: str
    mapping: dict[str, str]  # canonical to source
    date_format: str = "%Y-%m-%d"
    date_format_alternates: tuple[str, ...] = ()
    field_tiers: dict[str, str] = field(default_factory=dict)  # in the order of checks
    format: str = "csv"
    ssn_field: str | None = None

    @property
    def formats(self) -> list[str]:
        return [self.date_format, *self.date_format_alternates]

    @property
    def required(self) -> list[str]:
        return [f for f, t in self.field_tiers.items() if t == "required"]


def load_mapping(path: str) -> PartnerMapping:
    with open(path) as f:
        return parse_mapping(f.read())


def parse_mapping(text: str) -> PartnerMapping:
    d = yaml.safe_load(text)
    return PartnerMapping(d["partner_id"], dict(d["mapping"]), d["date_format"], tuple(d.get("date_format_alternates") or ()), dict(d.get("field_tiers") or {}), d.get("format", "csv"), d.get("ssn_field"))


def map_feed(rows: DataFrame, m: PartnerMapping) -> DataFrame:
    """Canonical columns, raw_source and parse_errors, as one projection. Fields that a partner lacks are null."""
    src = {c: strip(F.coalesce(F.col(f"`{s}`").cast("string"), F.lit(""))) if s in rows.columns else F.lit("") for c, s in m.mapping.items()}
    out = {c: src[c] if c in src else F.lit(None).cast("string") for c in CANONICAL}
    error = F.lit(None).cast("string")
    if "dob" in src:
        out["dob"], error = F.coalesce(parse_date(src["dob"], m.formats), F.lit("")), date_error(src["dob"], m.formats)
    if "ssn" in src:
        out["ssn_last4"] = F.right(src["ssn"], F.lit(4))
    if "email" in src:
        out["email"] = F.lower(src["email"])
    raw = F.map_from_arrays(F.array(*map(F.lit, rows.columns)), F.array(*[F.col(f"`{c}`").cast("string") for c in rows.columns]))
    errors = F.when(error.isNotNull(), F.create_map(F.lit("dob"), error)).otherwise(F.create_map().cast("map<string,string>"))
    extra = [F.col(c) for c in ("_line",) if c in rows.columns]
    return rows.select(F.lit(m.partner_id).alias("partner_id"), *[v.alias(k) for k, v in out.items()], raw.alias("raw_source"), errors.alias("parse_errors"), *extra)
