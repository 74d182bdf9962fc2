"""Seeded partner feeds: all people are made up, numbers come from hashes of their place."""

from __future__ import annotations

import argparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.mapping import PartnerMapping, parse_mapping

FIRST = ("Ada", "Ben", "Cleo", "Dan", "Eva", "Finn", "Gus", "Hana", "Ivo", "Jana", "Kai", "Lena", "Milo", "Nora", "Otis", "Pia", "Quin", "Rosa", "Sven", "Tara")
SYLLABLES = ("bar", "den", "fol", "gar", "hin", "kel", "lor", "mun", "nes", "pal", "rud", "sor", "tam", "vel", "wex", "zan")
STREETS = ("Oak St", "Elm Ave Apt 4", "Lake Rd", "Hill Ct Apt 12", "Mill Ln")
#: Fixed places of the scenarios in the two pools.
CROSS_A, LOOKALIKE_A, DUPLICATE_A, NO_NAME_A, NO_DOB_A, SHORT_A, DELETED_A = (5, 10), (50, 55), 20, 25, 30, 35, 40
DUPLICATE_B, NO_NAME_B, NO_DOB_B, SHORT_B = 5, 10, 15, 20
A_COLUMNS = ("member_id", "FirstName", "LastName", "DOB", "SSN", "Street", "City", "State", "Zip", "Phone", "Email")
B_COLUMNS = ("ext_id", "given_name", "family_name", "date_of_birth", "ssn_last4", "address_line1", "address_city", "address_state", "address_zip", "phone_number", "email_address")

PARTNER_A = """
partner_id: PARTNER_A
format: csv
date_format: "%m/%d/%Y"
date_format_alternates: ["%m/%d/%y"]
ssn_field: SSN
mapping: {partner_member_id: member_id, first_name: FirstName, last_name: LastName, dob: DOB, ssn: SSN, street: Street, city: City, state: State, zip: Zip, phone: Phone, email: Email}
field_tiers: {partner_member_id: required, first_name: required, last_name: required, dob: required, ssn: verification, ssn_last4: verification, street: verification, city: verification, state: verification, zip: verification, phone: enrichment, email: enrichment}
"""
PARTNER_B = """
partner_id: PARTNER_B
format: csv
date_format: "%Y-%m-%d"
date_format_alternates: ["%y-%m-%d"]
ssn_field: ssn_last4
mapping: {partner_member_id: ext_id, first_name: given_name, last_name: family_name, dob: date_of_birth, ssn_last4: ssn_last4, street: address_line1, city: address_city, state: address_state, zip: address_zip, phone: phone_number, email: email_address}
field_tiers: {partner_member_id: required, first_name: required, last_name: required, dob: required, ssn_last4: verification, street: verification, city: verification, state: verification, zip: verification, phone: enrichment, email: enrichment}
"""


def mappings() -> tuple[PartnerMapping, PartnerMapping]:
    return parse_mapping(PARTNER_A), parse_mapping(PARTNER_B)


def pick(values: tuple[str, ...], n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(n, F.lit(len(values))) + 1).cast("int"))


def people(spark: SparkSession, partner: str, n: int, seed: int) -> DataFrame:
    """n people of a partner's pool, place i from 0."""
    h = lambda k: F.pmod(F.xxhash64(F.lit(seed), F.lit(partner), F.lit(k), "i"), F.lit(1 << 40))
    title = F.initcap(F.concat(pick(SYLLABLES, h(2)), pick(SYLLABLES, h(3)), pick(SYLLABLES, h(4))))
    x = spark.range(n).withColumnRenamed("id", "i")
    return x.select(
        "i", pick(FIRST, h(1)).alias("first"), title.alias("last"), F.date_add(F.lit("1940-01-01").cast("date"), (h(5) % 24106).cast("int")).alias("dob"),
        F.concat(F.lpad((h(6) % 99 + 901).cast("string"), 3, "0"), F.lit("-"), F.lpad((h(7) % 99 + 1).cast("string"), 2, "0"), F.lit("-"), F.lpad((h(8) % 9999 + 1).cast("string"), 4, "0")).alias("ssn"),
        F.concat((h(9) % 9000 + 1).cast("string"), F.lit(" "), pick(STREETS, h(10))).alias("street"), pick(("Ames", "Bow", "Cary", "Dover"), h(11)).alias("city"), pick(("IA", "NH", "NC", "DE"), h(11)).alias("state"),
        F.lpad((h(12) % 90000 + 10000).cast("string"), 5, "0").alias("zip"), F.concat(F.lit("555-01"), (h(13) % 10).cast("string"), F.lit("-"), F.lpad((h(14) % 10000).cast("string"), 4, "0")).alias("phone"),
        F.concat(F.lower(title), "i", F.lit("@example.invalid")).alias("email"),
    )


def drop_third(c: Column) -> Column:
    return F.when(F.length(c) < 3, F.concat(c, F.lit("x"))).otherwise(F.concat(F.substring(c, 1, 2), F.substr(c, F.lit(4))))


def rewrite_address(c: Column) -> Column:
    return F.when(c.contains("Apt"), F.regexp_replace(c, "Apt ?", "#")).otherwise(F.concat(c, F.lit(" #1")))


def prior_street(c: Column) -> Column:
    return F.concat(c, F.lit(" (prior)"))


def rows_a(x: DataFrame, day: int) -> DataFrame:
    i = F.col("i")
    dob = F.when(i == NO_DOB_A, "").when(i == SHORT_A, F.lit("4/12/85")).otherwise(F.date_format("dob", "MM/dd/yyyy"))
    out = x.select(F.concat(F.lit("A"), F.lpad(i.cast("string"), 5, "0")).alias("member_id"), F.col("first").alias("FirstName"), F.when(i == NO_NAME_A, "").otherwise(F.col("last")).alias("LastName"), dob.alias("DOB"), F.col("ssn").alias("SSN"), F.col("street").alias("Street"), F.col("city").alias("City"), F.col("state").alias("State"), F.col("zip").alias("Zip"), F.col("phone").alias("Phone"), F.col("email").alias("Email"), i.alias("_line"))
    return out.withColumn("EligibilityStartDate", F.lit("01/01/2024")) if day == 2 else out


def rows_b(x: DataFrame, ident: Column, line: Column) -> DataFrame:
    i = F.col("i")
    dob = F.when(ident == "B00015", "").when(ident == "B00020", F.lit("85-04-12")).otherwise(F.date_format("dob", "yyyy-MM-dd"))
    return x.select(ident.alias("ext_id"), F.col("first").alias("given_name"), F.when(ident == "B00010", "").otherwise(F.col("last")).alias("family_name"), dob.alias("date_of_birth"), F.right("ssn", F.lit(4)).alias("ssn_last4"), F.col("street").alias("address_line1"), F.col("city").alias("address_city"), F.col("state").alias("address_state"), F.col("zip").alias("address_zip"), F.col("phone").alias("phone_number"), F.col("email").alias("email_address"), (line + i * 0).alias("_line"))


def feed_a(spark: SparkSession, day: int, n: int = 300, seed: int = 42) -> DataFrame:
    pool = people(spark, "A", n, seed)
    if day == 2:
        return rows_a(pool.filter(F.col("i") != DELETED_A), 2)
    again = rows_a(pool.filter(F.col("i") == DUPLICATE_A).withColumn("street", prior_street(F.col("street"))), 1).withColumn("_line", F.lit(n).cast("long"))
    return rows_a(pool, 1).unionByName(again)


def feed_b(spark: SparkSession, day: int, n: int = 300, seed: int = 42) -> DataFrame:
    pool, other = people(spark, "B", n, seed), people(spark, "A", n, seed)
    i = F.col("i")
    own = rows_b(pool, F.concat(F.lit("B"), F.lpad(i.cast("string"), 5, "0")), i)
    typo, address = other.filter(i == CROSS_A[0]).withColumn("last", drop_third(F.col("last"))), other.filter(i == CROSS_A[1]).withColumn("street", rewrite_address(F.col("street")))
    out = own.unionByName(rows_b(typo, F.lit("B90000"), F.lit(n + 1))).unionByName(rows_b(address, F.lit("B90001"), F.lit(n + 2)))
    if day == 2:
        back = other.filter(i == DELETED_A).withColumn("last", drop_third(F.col("last")))
        return out.unionByName(rows_b(back, F.lit("B99999"), F.lit(n + 3)))
    again = rows_b(pool.filter(i == DUPLICATE_B).withColumn("street", prior_street(F.col("street"))), F.lit("B00005"), F.lit(n))
    alike = other.filter(i.isin(*LOOKALIKE_A)).select("i", "first", F.concat(F.lit("Zz"), F.reverse("last")).alias("last"), F.date_add("dob", 4321).alias("dob"), "ssn", F.lit("77 Nowhere Blvd West").alias("street"), F.lit("Xanadu").alias("city"), F.lit("WY").alias("state"), F.lit("82001").alias("zip"), F.lit("").alias("phone"), F.lit("").alias("email"))
    return out.unionByName(again).unionByName(rows_b(alike, F.when(i == LOOKALIKE_A[0], "B80000").otherwise("B80001"), F.lit(n + 4) + F.when(i == LOOKALIKE_A[0], 0).otherwise(1)))


def write_csv(rows: DataFrame, path: str) -> None:
    """One CSV file with a header in the folder path, rows in the order of their lines."""
    rows.orderBy("_line").drop("_line").coalesce(1).write.mode("overwrite").options(header=True, escape='"', emptyValue="").csv(path)


def generate(spark: SparkSession, path: str, seed: int = 42, count: int = 300) -> None:
    """Four feeds as CSV and the inventory of scenarios as JSON."""
    for feed, make in (("a", feed_a), ("b", feed_b)):
        for day in (1, 2):
            write_csv(make(spark, day, count, seed), f"{path}/partner_{feed}_day{day}.csv")
    each = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(("partner_member_id", "scenario", "feed"), r, strict=True)]) for r in inventory(count)])
    one = spark.range(1).select(F.lit(1).alias("schema_version"), F.lit(seed).alias("seed"), F.lit(count).alias("count_per_partner"), F.array(F.lit("PARTNER_A"), F.lit("PARTNER_B")).alias("partners"), each.alias("records"))
    one.coalesce(1).write.mode("overwrite").json(f"{path}/scenario_inventory.json")


def scenario_counts(records: DataFrame) -> DataFrame:
    return records.groupBy("feed", "scenario").agg(F.count(F.lit(1)).alias("n"))


def inventory(n: int = 300) -> list[tuple[str, str, str]]:
    """(partner_member_id, scenario, feed) of the seeded scenarios."""
    return [
        ("A00020", "within_feed_duplicate", "A1"), ("B00005", "within_feed_duplicate", "B1"), ("A00025", "missing_last_name", "A1"), ("B00010", "missing_last_name", "B1"), ("A00030", "blank_dob", "A1"), ("B00015", "blank_dob", "B1"),
        ("A00035", "short_year", "A1"), ("B00020", "short_year", "B1"), ("A00040", "deletion_target", "A1"), ("B99999", "deletion_target", "B2"), ("B90000", "cross_partner", "B1"), ("B90001", "cross_partner", "B1"), ("B80000", "look_alike", "B1"), ("B80001", "look_alike", "B1"),
    ]


def main() -> None:
    args = argparse.ArgumentParser(description=generate.__doc__)
    args.add_argument("path")
    args.add_argument("--seed", type=int, default=42)
    args.add_argument("--count", type=int, default=300)
    a = args.parse_args()
    generate(SparkSession.builder.getOrCreate(), a.path, a.seed, a.count)


if __name__ == "__main__":
    main()
