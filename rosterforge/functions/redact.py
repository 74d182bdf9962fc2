"""Finding and redacting personal data in text."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed patterns of the redaction scan.
PATTERNS = {
    "SSN": r"\b\d{3}-\d{2}-\d{4}\b",
    "DOB_US_DATE": r"\b\d{1,2}/\d{1,2}/\d{4}\b",
    "PHONE": r"\b\d{3}-\d{3}-\d{4}\b",
    "EMAIL": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.(?!invalid\b)[A-Za-z]{2,}\b",
}
#: Fixed keys under which dates are no findings.
TIMESTAMP_KEYS = (
    "timestamp", "created_at", "deleted_at", "tombstoned_at", "queued_at", "claimed_at",
    "resolved_at", "decided_at", "first_seen_at", "last_updated_at", "state_effective_from", "state_effective_to",
)
#: Fixed patterns of the scan of test data.
FIXTURE_PATTERNS = {
    "SSN": r"\b\d{3}-\d{2}-\d{4}\b",
    "phone": r"\b(?:\+?1[-.\s])?\(?\d{3}\)?[-.\s]\d{3}[-.\s]\d{4}\b",
    "DOB-shape": r"\b(?:19|20)\d{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])\b",
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+\b",
}
#: Fixed domains of invented addresses, and their endings.
EXEMPT_DOMAINS = ("example.com", "example.org", "example.net", "localhost", "noreply.invalid", "faker.com")
EXEMPT_ENDINGS = (".invalid", ".test", ".local")
ALLOW_MARK = r"(?i)#\s*pii-allowed:"
#: Fixed order of substitutions in log events, and what each leaves.
SUBSTITUTIONS = (
    (r"\b\d{3}-\d{2}-\d{4}\b", "***SSN***"),
    (r"\b\d{9}\b", "***SSN-OR-LONG-DIGIT***"),
    (r"\b(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]\d{3}[-.\s]\d{4}\b", "***PHONE***"),
    (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+\b", "***EMAIL***"),
    (r"\b(?:19|20)\d{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])\b", "***DATE***"),
)
#: Fixed keys of log events whose values never show.
SENSITIVE_KEYS = (
    "ssn", "social_security_number", "social_security", "tin", "ein",
    "dob", "date_of_birth", "birth_date", "birthdate",
    "first_name", "last_name", "full_name", "fname", "lname", "name", "given_name", "family_name", "middle_name",
    "address", "street", "street_address", "home_address", "mailing_address", "city", "zip", "zip_code", "postal_code",
    "phone", "phone_number", "telephone", "mobile", "email", "email_address",
    "member_id", "patient_id", "subscriber_id", "medicare_id", "mbi", "hicn",
    "password", "secret", "token", "api_key", "auth_token", "session_id",
)
MASK = "***REDACTED***"
#: Characters that an excerpt shows on both sides.
CONTEXT = 8


def hits(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def findings(text: Column, patterns: dict[str, str] = PATTERNS) -> Column:
    """array<struct<pattern, value>> of all patterns."""

    def named(k: str) -> Column:
        return F.transform(hits(text, patterns[k]), lambda v: F.struct(F.lit(k).alias("pattern"), v.alias("value")))

    return F.concat(*map(named, patterns))


def fixture_findings(line: Column) -> Column:
    """findings() of a line of test data: none if the line says so, and no invented addresses."""
    found = F.filter(findings(line, FIXTURE_PATTERNS), lambda f: (f["pattern"] != "email") | ~email_exempt(f["value"]))
    return F.when(line_allowed(line), F.array().cast("array<struct<pattern:string,value:string>>")).otherwise(found)


def redact(text: Column) -> Column:
    for pattern, mark in SUBSTITUTIONS:
        text = F.regexp_replace(text, pattern, mark)
    return text


def sensitive(key: Column) -> Column:
    return F.lower(key).isin(*SENSITIVE_KEYS)


def redact_map(m: Column) -> Column:
    """Values of sensitive keys, in any case, are masked; the others are redacted by pattern."""
    return F.transform_values(m, lambda k, v: F.when(sensitive(k), F.lit(MASK)).otherwise(redact(v)))


def mask_keys(m: Column) -> Column:
    """Masked by key alone: for maps inside an event, whose values patterns don't reach."""
    return F.transform_values(m, lambda k, v: F.when(sensitive(k), F.lit(MASK)).otherwise(v))


def email_exempt(email: Column) -> Column:
    domain = F.lower(F.substring_index(email, "@", -1))
    ends = F.lit(False)
    for e in EXEMPT_ENDINGS:
        ends = ends | domain.endswith(e)
    return domain.isin(*EXEMPT_DOMAINS) | ends


def line_allowed(line: Column) -> Column:
    return line.rlike(ALLOW_MARK)


EXCERPTS = T.ArrayType(T.StructType([T.StructField("pattern", T.StringType()), T.StructField("excerpt", T.StringType())]))
_compiled = {k: re.compile(p) for k, p in PATTERNS.items()}


def _excerpts(t: str, dates: bool = True) -> list[dict]:
    return [{"pattern": k, "excerpt": t[max(0, m.start() - CONTEXT) : m.end() + CONTEXT]} for k, p in _compiled.items() if dates or k != "DOB_US_DATE" for m in p.finditer(t)]


def _strings(value, dates: bool = True) -> Iterator[tuple[str, bool]]:
    """The strings of a JSON value in order, and whether dates count there: not below a time stamp's key."""
    if isinstance(value, str):
        yield value, dates
    elif isinstance(value, dict):
        for k, v in value.items():
            yield from _strings(v, dates and k not in TIMESTAMP_KEYS)
    elif isinstance(value, list):
        for v in value:
            yield from _strings(v, dates)


def _of_json(line: str) -> list[dict]:
    try:
        value = json.loads(line)
    except ValueError:
        return _of_text(line)
    return [x for s, dates in _strings(value) for x in _excerpts(s, dates)]


def _of_text(line: str) -> list[dict]:
    return [x | {"excerpt": x["excerpt"].strip()} for x in _excerpts(line)]


@F.pandas_udf(EXCERPTS)
def excerpts(text: pd.Series) -> pd.Series:
    """Every match of a text line with its context; places of matches need Python."""
    return text.map(lambda t: [] if t is None else _of_text(t))


@F.pandas_udf(EXCERPTS)
def json_excerpts(line: pd.Series) -> pd.Series:
    """The same of all strings in a line of JSON; a line that isn't JSON is text."""
    return line.map(lambda t: [] if t is None else _of_json(t))


def suspicious(line: Column) -> Column:
    """Whether a line may hold a finding: only such lines need Python. An escaped string may hide one."""
    return line.rlike("|".join(PATTERNS.values())) | line.contains("\\")
