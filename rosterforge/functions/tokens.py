"""Keyed tokens, suppression hashes and name-based UUIDs, composed of built-in functions: no Python per row."""

from __future__ import annotations

import hashlib
import hmac

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: the name space of object identifiers for UUIDs.
OID_NAMESPACE = "6ba7b8129dad11d180b400c04fd430c8"
BLOCK = 64
#: White space as Unicode has it, and the four separators of ASCII.
SPACE = r"[\s\x1c-\x1f]"


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(c, rf"(?U)^{SPACE}+|{SPACE}+$", "")


def light_norm(c: Column) -> Column:
    return F.lower(strip(F.coalesce(c, F.lit(""))))


@F.pandas_udf(T.StringType())
def _compose(s: pd.Series) -> pd.Series:
    return s.str.normalize("NFC")


def normalize(c: Column, nfc: bool = True) -> Column:
    """Composed, stripped, lower case, runs of white space as one space. Only texts beyond ASCII go through Python."""
    c = F.coalesce(c, F.lit(""))
    if nfc:
        c = F.when(c.rlike(r"[^\x00-\x7F]"), _compose(F.when(c.rlike(r"[^\x00-\x7F]"), c))).otherwise(c)
    return F.regexp_replace(F.lower(strip(c)), rf"(?U){SPACE}+", " ")


def hmac_sha256(message: Column, key: bytes) -> Column:
    """Hexadecimal HMAC-SHA-256, by its definition over sha2. The key's two pads are literals of the plan; see README."""
    key = hashlib.sha256(key).digest() if len(key) > BLOCK else key
    pad = lambda x: F.unhex(F.lit(bytes(b ^ x for b in key.ljust(BLOCK, b"\0")).hex()))
    inner = F.sha2(F.concat(pad(0x36), message.cast("binary")), 256)
    return F.sha2(F.concat(pad(0x5C), F.unhex(inner)), 256)


def token(category: str, value: Column, key: bytes) -> Column:
    return hmac_sha256(F.concat(F.lit(f"{category}:"), value), key)


def name_token(first: Column, last: Column, key: bytes, nfc: bool = True) -> Column:
    return token("name", F.concat_ws("|", normalize(first, nfc), normalize(last, nfc)), key)


def last_name_token(last: Column, key: bytes, nfc: bool = True) -> Column:
    return token("last_name", normalize(last, nfc), key)


def dob_token(dob: Column, key: bytes, nfc: bool = True) -> Column:
    """Of the ISO text of a date, or a date."""
    return token("dob", normalize(dob.cast("string"), nfc), key)


def ssn_last4_token(last4: Column, key: bytes, nfc: bool = True) -> Column:
    """Null where the digits are blank."""
    return F.when(F.coalesce(last4, F.lit("")) != "", token("ssn_last4", normalize(last4, nfc), key))


def partner_member_token(partner: Column, member: Column, key: bytes, nfc: bool = True) -> Column:
    blank = lambda c: F.coalesce(c, F.lit(""))
    return token("partner_member_id", normalize(F.concat_ws("|", blank(partner), blank(member)), nfc), key)


def suppression_hash(salt: str, prefix: str, *parts: Column) -> Column:
    """Salted SHA-256 of a prefix and the parts."""
    return F.sha2(F.concat(F.lit(f"{salt}{prefix}:"), F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])).cast("binary"), 256)


def strict_hash(salt: str, last: Column, dob: Column, partner: Column, member: Column, nfc: bool = True) -> Column:
    """Of one enrollment: the same partner brings the same member back, under whatever first name."""
    return suppression_hash(salt, "suppression", normalize(last, nfc), dob, normalize(partner, nfc), normalize(member, nfc))


def broad_hash(salt: str, dob: Column, last4: Column) -> Column:
    """Whoever brings the person back. Null without last four digits: a date of birth alone suppresses nobody."""
    return F.when(F.coalesce(last4, F.lit("")) != "", suppression_hash(salt, "suppression_broad", dob, last4))


def uuid5(name: Column, namespace: str = OID_NAMESPACE) -> Column:
    """Version 5 UUID of a name."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), name.cast("binary")))
    variant = F.element_at(F.array(*map(F.lit, "89ab")), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def class_keys(master: bytes, classes: list[str], salt: bytes = b"") -> dict[str, bytes]:
    """A key per field class by HKDF-SHA-256, on the driver."""
    prk = hmac.new(salt or bytes(32), master, hashlib.sha256).digest()
    return {c: hmac.new(prk, c.encode() + b"\x01", hashlib.sha256).digest() for c in classes}


def versioned_token(value: Column, key: bytes, version: int = 1) -> Column:
    return F.concat(F.lit(f"v{version}:"), F.base64(F.unhex(hmac_sha256(value, key))))
