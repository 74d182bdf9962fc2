"""Checks of a deployment's settings before a run: all that is wrong is told at once."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping

ENFORCED = ("staging", "production")
#: Fixed least length of the secret key, and form of the audit key: 32 bytes in lower-case hexadecimal digits.
SECRET_LENGTH, AUDIT_KEY = 32, re.compile(r"[0-9a-f]{64}\Z")

Settings = Mapping[str, object]
#: What each setting must be, and its test.
RULES: tuple[tuple[str, str, Callable[[Settings], bool]], ...] = (
    ("database_url", "must be stated", lambda s: bool(s.get("database_url"))),
    ("secret_key", f"must have {SECRET_LENGTH} characters or more", lambda s: len(str(s.get("secret_key") or "")) >= SECRET_LENGTH),
    ("auth_mode", "must not be none", lambda s: s.get("auth_mode", "none") != "none"),
    ("database_tls_enabled", "must be true", lambda s: s.get("database_tls_enabled") is True),
    ("audit_key", "must be 64 lower-case hexadecimal digits", lambda s: bool(AUDIT_KEY.match(str(s.get("audit_key") or "")))),
    ("pii_encryption_key", "must be stated", lambda s: bool(s.get("pii_encryption_key"))),
    ("artifact_signing_key", "must be stated", lambda s: bool(s.get("artifact_signing_key"))),
    ("artifact_signing_key", "must differ from secret_key", lambda s: not s.get("artifact_signing_key") or s["artifact_signing_key"] != s.get("secret_key")),
)


class ConfigurationError(ValueError):
    """Settings that a staging or production run can't use."""


def problems(settings: Settings) -> list[str]:
    """Every rule that the settings break; none outside the enforced environments."""
    if settings.get("environment", "dev") not in ENFORCED:
        return []
    return [f"{name} {what}" for name, what, holds in RULES if not holds(settings)]


def validate(settings: Settings) -> None:
    found = problems(settings)
    if found:
        raise ConfigurationError("; ".join(found))
