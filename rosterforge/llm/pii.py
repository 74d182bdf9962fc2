"""Format-preserving pseudonyms for personal data, in DataFrame operations only.

Texts that hold a mark of some kind (an @, a digit, or a long run of the letters a to f) are cut at one pattern
with split(), the matches come from regexp_extract_all() with the same pattern, and the parts are joined again with each
match replaced. A match is validated (Luhn digit, calendar day, octets, areas of a number); what isn't valid stays as it is.
A valid value is a number in Z_a x Z_b and goes through an alternating Feistel network with modular addition,
l = (l + F(r)) mod a, r = (r + F(l)) mod b. a * b is exactly the number of a kind's valid values, so that the network is a
permutation of just these under the key: equal values get equal pseudonyms in all documents, different values different
ones, and nothing leaves its format.

Kinds: payment cards of 13 to 16 digits (all but the check digit permuted, the check digit made anew), North American
phone numbers (area and exchange from 200 to 999; others, permuted among themselves, only with +1 or parentheses), social security numbers, IPv4 addresses, and dates from 1900 to 2099: ISO;
day first with / or .; month first where the day is over 12 (these are permuted among themselves, so a date never changes
its reading). E-mail names and long hexadecimal secrets aren't numbers. A secret keeps length and alphabet by a keyed digest.
An e-mail name becomes letters of a keyed digest, as many as it has but 8 at least; two names of a host meet with probability 16**-8.

Null texts stay null with no spans. Documents without a match pass unchanged. Repeated rows give equal results. A column of
the documents called pii is replaced by the result's; others of any name are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: Fixed patterns of the kinds, each without groups that capture; tried in this order.
KINDS = {
    "email": r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "secret": r"(?:[0-9a-f]{64}|[0-9a-f]{40}|[0-9a-f]{32})",
    "date": r"(?:(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}|[0-9]{2}[/.][0-9]{2}[/.](?:19|20)[0-9]{2})",
    "ipv4": r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "phone": r"(?:\+1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}",
    "card": r"(?:[0-9]{4}[ -]){3}[0-9]{4}|[0-9]{13,16}",
}
#: Not within a longer word or number: a quick look behind and ahead.
PATTERN = r"(?<![A-Za-z0-9_])(?<![0-9][.])(?:" + "|".join(KINDS.values()) + r")(?![A-Za-z0-9_])(?!\.[0-9])"
DAY0 = "1900-01-01"
#: What a text must hold for any kind: a quick first look.
HINT = r"[0-9@]|[a-f]{32}"
#: Fixed numbers of valid values as products: days from 1900 to 2099, social security numbers, telephones.
DAYS = (17, 4297)
LEAST_NAME = 8
#: Days after the 12th up to the end of each month of a year that isn't a leap year.
LATE_DAYS = (19, 35, 54, 72, 91, 109, 128, 147, 165, 184, 202, 221)


def _luhn(digits: Column) -> Column:
    """Sum of the digits with every second from the right (the last but one first) doubled and reduced."""
    n = F.length(digits)
    each = F.transform(F.sequence(F.lit(1), n), lambda i: _spread(F.substring(digits, i, 1).cast("int"), (n - i) % 2 == 1))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x)


def _spread(d: Column, double: Column) -> Column:
    return F.when(double, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d)


def _date(m: Column) -> Column:
    """The day that a date stands for; day first, or month first if only that is a day of the calendar."""
    iso = F.try_to_date(m, "yyyy-MM-dd")
    plain = F.regexp_replace(m, "[.]", "/")
    return F.when(m.rlike("^[0-9]{4}-"), iso).otherwise(F.coalesce(F.try_to_date(plain, "dd/MM/yyyy"), F.try_to_date(plain, "MM/dd/yyyy")))


def _kind(m: Column) -> Column:
    """A match's kind if it is valid, else null."""
    digits = F.regexp_replace(m, "[^0-9]", "")
    octets = F.transform(F.split(m, r"\."), lambda x: x.cast("int"))
    out = F.when(m.contains("@"), "email").when(m.rlike("^(?=.*[a-f])[0-9a-f]{32,64}$"), "secret")
    out = out.when(m.rlike("^(?:" + KINDS["date"] + ")$"), F.when(_date(m).isNull(), None).when(m.contains("-") | F.try_to_date(F.regexp_replace(m, "[.]", "/"), "dd/MM/yyyy").isNotNull(), "date").when(m.rlike("^02.29"), "date_leap").otherwise("date_late"))
    out = out.when(m.rlike("^" + KINDS["ipv4"] + "$"), F.when(F.forall(octets, lambda x: x < 256), "ipv4"))
    area, group, serial = F.substring(m, 1, 3).cast("int"), F.substring(m, 5, 2).cast("int"), F.substring(m, 8, 4).cast("int")
    out = out.when(m.rlike("^" + KINDS["ssn"] + "$"), F.when((area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0), "ssn"))
    ten = F.right(digits, F.lit(10))
    out = out.when(m.rlike("^(?:" + KINDS["phone"] + ")$"), F.when(F.length(digits) > 11, None).when(ten.rlike("^[2-9][0-9]{2}[2-9]"), "phone").when(m.rlike("[+(]"), "phone_other"))
    return out.when(m.rlike("^[0-9 -]+$") & (F.length(digits) >= 13), F.when(_luhn(digits) % 10 == 0, "card"))


def _number(m: Column, kind: Column) -> Column:
    """(l, r, a, b): the value as a pair in Z_a x Z_b."""
    digits = F.regexp_replace(m, "[^0-9]", "")
    pair = lambda left, right, a, b: F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"), F.lit(a).cast("long").alias("a") if isinstance(a, int) else a.cast("long").alias("a"), F.lit(b).cast("long").alias("b"))
    ten = F.right(digits, F.lit(10))
    prefix = F.substring(ten, 1, 6).cast("int")
    card = F.substr(digits, F.lit(1), F.length(digits) - 1)
    octet = lambda i: F.split(m, r"\.")[i].cast("long")
    day = F.datediff(_date(m), F.lit(DAY0).cast("date"))
    area = F.substring(m, 1, 3).cast("int")
    year = F.substring(m, 7, 4).cast("int")
    late = F.dayofyear(F.try_to_date(F.concat(F.lit("2001/"), F.substring(m, 1, 2), F.lit("/"), F.substring(m, 4, 2)), "yyyy/MM/dd")) - F.substring(m, 1, 2).cast("int") * 12 - 1
    return (
        F.when(kind == "card", pair(F.substr(card, F.lit(1), F.length(card) - 6), F.right(card, F.lit(6)), F.pow(F.lit(10.0), F.length(card) - 6), 10**6))
        .when(kind == "phone", pair((F.substring(ten, 1, 3).cast("int") - 200) * 800 + F.substring(ten, 4, 3).cast("int") - 200, F.substring(ten, 7, 4), 640_000, 10_000))
        .when(kind == "phone_other", pair(F.when(prefix < 200_000, prefix).otherwise(200_000 + F.floor(prefix / 1000 - 200) * 200 + prefix % 1000), F.substring(ten, 7, 4), 360_000, 10_000))
        .when(kind == "ipv4", pair(octet(0) * 256 + octet(1), octet(2) * 256 + octet(3), 65_536, 65_536))
        .when(kind == "ssn", pair(F.when(area > 666, area - 2).otherwise(area - 1), (F.substring(m, 5, 2).cast("int") - 1) * 9999 + F.substring(m, 8, 4).cast("int") - 1, 898, 99 * 9999))
        .when(kind == "date", pair(F.floor(day / DAYS[1]), day % DAYS[1], *DAYS))
        .when(kind == "date_late", pair(late, year - 1900, 221, 200))
        .when(kind == "date_leap", pair(F.floor((year - 1904) / 28), F.floor((year - 1904) / 4) % 7, 7, 7))
    )


def _feistel(key: str, kind: Column, x: Column) -> Column:
    """Eight rounds of addition modulo a or b of a keyed digest of the other half."""
    f = lambda i, half, mod: F.pmod(F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), kind, i.cast("string"), half.cast("string")).cast("binary"), 256), 1, 15), 16, 10).cast("long"), mod)

    def step(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        return F.struct(F.when(even, (s["l"] + f(i, s["r"], s["a"])) % s["a"]).otherwise(s["l"]).alias("l"), F.when(even, s["r"]).otherwise((s["r"] + f(i, s["l"], s["b"])) % s["b"]).alias("r"), s["a"].alias("a"), s["b"].alias("b"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), x, step)


def _into(shape: Column, digits: Column) -> Column:
    """digits set one after another into the places that hold digits in shape."""
    n = F.length(shape)
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def put(s: Column, i: Column) -> Column:
        ch = F.substr(shape, i, F.lit(1))
        is_digit = ch.rlike("[0-9]")
        return F.struct(F.concat(s["out"], F.when(is_digit, F.substr(digits, s["at"], F.lit(1))).otherwise(ch)).alias("out"), F.when(is_digit, s["at"] + 1).otherwise(s["at"]).alias("at"))

    return F.aggregate(F.sequence(F.lit(1), n), start, put, lambda s: s["out"])


def _written(m: Column, kind: Column, y: Column) -> Column:
    """The permuted value in the match's own format."""
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    digits = F.regexp_replace(m, "[^0-9]", "")
    body = F.concat(F.lpad(y["l"].cast("string"), F.length(digits) - 7, F.lit("0")), pad(y["r"], 6))
    check = (10 - _luhn(F.concat(body, F.lit("0"))) % 10) % 10
    plan = F.concat(pad(F.floor(y["l"] / 800) + 200, 3), pad(y["l"] % 800 + 200, 3), pad(y["r"], 4))
    rest = y["l"] - 200_000
    other = F.concat(pad(F.when(rest < 0, y["l"]).otherwise((F.floor(rest / 200) + 200) * 1000 + rest % 200), 6), pad(y["r"], 4))
    prefix = F.when(F.length(digits) == 11, "1").otherwise("")
    area = F.when(y["l"] + 1 >= 666, y["l"] + 2).otherwise(y["l"] + 1)
    day = F.date_add(F.lit(DAY0).cast("date"), (y["l"] * DAYS[1] + y["r"]).cast("int"))
    month = F.size(F.filter(F.array(*map(F.lit, LATE_DAYS)), lambda c: c <= y["l"])) + 1
    late = F.concat(F.date_format(F.date_add(F.lit("2001-01-01").cast("date"), (y["l"] + month * 12).cast("int")), "MMdd"), (y["r"] + 1900).cast("string"))
    leap = F.concat(F.lit("0229"), ((y["l"] * 7 + y["r"]) * 4 + 1904).cast("string"))
    return (
        F.when(kind == "card", _into(m, F.concat(body, check.cast("string"))))
        .when(kind == "phone", _into(m, F.concat(prefix, plan)))
        .when(kind == "phone_other", _into(m, F.concat(prefix, other)))
        .when(kind == "ipv4", F.concat_ws(".", *[x.cast("string") for x in (F.floor(y["l"] / 256), y["l"] % 256, F.floor(y["r"] / 256), y["r"] % 256)]))
        .when(kind == "ssn", F.concat_ws("-", pad(area, 3), pad(F.floor(y["r"] / 9999) + 1, 2), pad(y["r"] % 9999 + 1, 4)))
        .when(kind == "date", F.when(m.contains("-"), F.date_format(day, "yyyy-MM-dd")).otherwise(_into(m, F.date_format(day, "ddMMyyyy"))))
        .when(kind == "date_late", _into(m, late))
        .when(kind == "date_leap", _into(m, leap))
    )


def pseudonyms(found: Column, key: str) -> Column:
    """array<struct<m, kind>> with the matches replaced that have a kind.

    Number, network and writing are a transform each: what a lambda is given is computed once, however often it is used.
    """
    x = F.transform(found, lambda f: F.struct(f["m"].alias("m"), f["kind"].alias("kind"), _number(f["m"], f["kind"]).alias("x")))
    y = F.transform(x, lambda f: F.struct(f["m"].alias("m"), f["kind"].alias("kind"), F.when(f["x"].isNotNull(), _feistel(key, f["kind"], f["x"])).alias("y"), F.sha2(F.concat_ws("|", F.lit(key), f["kind"], f["m"]).cast("binary"), 256).alias("digest")))

    def written(f: Column) -> Column:
        m, name = f["m"], F.substring_index(f["m"], "@", 1)
        mail = F.concat(F.rpad(F.translate(f["digest"], "0123456789", "ghijklmnop"), F.greatest(F.length(name), F.lit(LEAST_NAME)), F.lit("x")), F.lit("@"), F.substring_index(m, "@", -1))
        new = F.when(f["kind"] == "email", mail).when(f["kind"] == "secret", F.substr(f["digest"], F.lit(1), F.length(m))).when(f["kind"].isNotNull(), _written(m, f["kind"], f["y"]))
        return F.struct(F.coalesce(new, m).alias("m"), f["kind"].alias("kind"))

    return F.transform(y, written)


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """docs with the text replaced, and `pii` array<struct<kind, start, length>>: spans in the new text (0-based code points)."""
    text = F.col(text_col)
    # Columns of the documents stand in a struct meanwhile, so that no name of theirs can meet one of these.
    x = docs.select(F.struct(*docs.columns).alias("_row"), text.alias("_text"))
    found = F.transform(F.regexp_extract_all("_text", F.lit(PATTERN), F.lit(0)), lambda m: F.struct(m.alias("m"), _kind(m).alias("kind")))
    x = x.withColumn("_found", F.when(F.col("_text").rlike(HINT), found))
    some = F.exists("_found", lambda f: f["kind"].isNotNull())
    x = x.withColumn("_new", F.when(some, pseudonyms(F.col("_found"), key)))
    spans = "array<struct<kind:string,start:int,length:int>>"
    span = lambda s, z: F.array(F.struct(z["new"]["kind"].alias("kind"), s["at"].alias("start"), F.length(z["new"]["m"]).alias("length")))
    walk = F.aggregate(
        F.arrays_zip(F.slice("_parts", 2, F.size("_parts")).alias("after"), F.col("_new").alias("new")),
        F.struct(F.length(F.col("_parts")[0]).alias("at"), F.array().cast(spans).alias("spans"), F.array(F.col("_parts")[0]).alias("out")),
        lambda s, z: F.struct(
            (s["at"] + F.length(z["new"]["m"]) + F.length(z["after"])).alias("at"),
            F.when(z["new"]["kind"].isNull(), s["spans"]).otherwise(F.concat(s["spans"], span(s, z))).alias("spans"),
            F.concat(s["out"], F.array(z["new"]["m"], z["after"])).alias("out"),
        ),
    )
    changed = F.col("_new").isNotNull()
    x = x.withColumn("_parts", F.when(changed, F.split("_text", PATTERN, -1))).withColumn("_walk", F.when(changed, walk))
    own = [F.col("_row").getField(c).alias(c) for c in docs.columns if c not in (text_col, "pii")]
    text = F.when(changed, F.array_join(F.col("_walk")["out"], "")).otherwise(F.col("_text"))
    return x.select(*own, text.alias(text_col), F.coalesce(F.col("_walk")["spans"], F.array().cast(spans)).alias("pii"))
