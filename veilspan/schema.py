"""Types shared by every operator: findings, replacements, state tables, dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FINDING = (
    "struct<start:int,end:int,type:string,text:string,detector:string,"
    "priority:int,meta:map<string,string>>"
)
FINDINGS = f"array<{FINDING}>"
REPLACEMENT = (
    "struct<in_start:int,in_end:int,out_start:int,out_end:int,type:string,"
    "original:string,replacement:string,detector:string>"
)
REPLACEMENTS = f"array<{REPLACEMENT}>"

# State tables, one row per key; every table is partitioned by ``project`` on disk.
STATE_SCHEMAS = {
    "mappings": (
        "project string, type string, original string, surrogate string, "
        "count bigint, first_seen timestamp, last_seen timestamp"
    ),
    "token_map": "project string, map string, token string, surrogate string",
    "networks": "project string, version int, cidr string, lo string, hi string",
    "placeholders": "project string, type string, hash string, n bigint",
}
HISTORY = (
    "project string, id bigint, ts timestamp, action string, source string, "
    f"input string, output string, replacements {REPLACEMENTS}, "
    "warnings array<string>, sensitive_warnings array<string>"
)

# Entity types, their categories and the default rule of a category.
CATEGORIES = {
    "tracking": ("TRACKING",),
    "secrets": ("SECRET", "PRIVATE_KEY", "CERTIFICATE"),
    "finance": ("IBAN", "CREDIT_CARD"),
    "persons": ("PERSON", "EMAIL", "USERNAME", "PHONE", "SID"),
    "orgs": ("ORG", "LOCATION"),
    "network": ("IPV4", "IPV6", "MAC", "DOMAIN", "HOSTNAME"),
    "infra": ("IDENTIFIER",),
    "ids": ("FINGERPRINT",),
    "custom": ("CUSTOM",),
}
DEFAULT_RULES = {
    "tracking": "auto", "secrets": "ask", "finance": "ask", "persons": "ask", "orgs": "ask",
    "network": "ask", "infra": "ask", "ids": "ask", "custom": "ignore",
}
CRITICAL_TYPES = ("SECRET", "PRIVATE_KEY", "CREDIT_CARD", "IBAN")
IP_TYPES = ("IPV4", "IPV6")
CASE_INSENSITIVE_TYPES = ("DOMAIN", "EMAIL", "HOSTNAME", "USERNAME")
SECRET_TYPES = ("SECRET", "PRIVATE_KEY")

TYPES = tuple(t for types in CATEGORIES.values() for t in types)
CATEGORY_OF = {t: c for c, types in CATEGORIES.items() for t in types}


def category_rules(spark: SparkSession, rules: dict | None = None, mode: str = "critical") -> DataFrame:
    """The 21-row dimension (type, category, rule, critical).

    ``mode`` is the watch mode: ``notify`` asks where a rule says auto, ``always`` changes
    where a rule says ask, anything else leaves the rules alone.
    """
    merged = {**DEFAULT_RULES, **(rules or {})}
    shift = {("notify", "auto"): "ask", ("always", "ask"): "auto"}
    rows = []
    for typ in TYPES:
        rule = merged.get(CATEGORY_OF[typ], "ask")
        rule = rule if rule in ("auto", "ask", "ignore") else "ask"
        rows.append((typ, CATEGORY_OF[typ], shift.get((mode, rule), rule), typ in CRITICAL_TYPES))
    return spark.createDataFrame(rows, "type string, category string, rule string, critical boolean")
