"""Text files with unknown encoding, output names, findings as JSON, term lines, layered settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Name parts per mode, and the characters of Windows-1252 in 0x80-0x9F.
MODE_SUFFIX = {"pseudonymize": "pseudo", "anonymize": "anon", "redact": "redacted", "revert": "restored"}
CP1252 = "€\u0081‚ƒ„…†‡ˆ‰Š‹Œ\u008dŽ\u008f\u0090‘’“”•–—˜™š›œ\u009džŸ"
_C1 = "".join(chr(c) for c in range(0x80, 0xA0))


def decode_bytes(content: Column) -> Column:
    """STRUCT<text, encoding>: UTF-8 with or without mark, else Windows-1252, else Latin-1."""
    utf8 = F.try_validate_utf8(content.cast("string"))
    latin = F.decode(content, "ISO-8859-1")
    undefined = F.regexp_like(latin, F.lit("[\u0081\u008d\u008f\u0090\u009d]"))
    bom = F.startswith(F.hex(F.substring(content, 1, 3)), F.lit("EFBBBF"))
    return F.when(utf8.isNotNull() & bom, F.struct(F.substring(utf8, F.lit(2), F.length(utf8)).alias("text"), F.lit("utf-8-sig").alias("encoding"))) \
        .when(utf8.isNotNull(), F.struct(utf8.alias("text"), F.lit("utf-8").alias("encoding"))) \
        .when(~undefined, F.struct(F.translate(latin, _C1, CP1252).alias("text"), F.lit("cp1252").alias("encoding"))) \
        .otherwise(F.struct(latin.alias("text"), F.lit("latin-1").alias("encoding")))


def encode_text(text: Column, encoding: Column) -> Column:
    """Bytes in the encoding of the source; UTF-8 where a character does not exist in it."""
    back = F.translate(text, CP1252, _C1)
    single = F.encode(F.when(encoding == "cp1252", back).otherwise(text), "ISO-8859-1")
    fits = ~F.regexp_like(F.when(encoding == "cp1252", back).otherwise(text), F.lit("[^\u0000-ÿ]"))
    mark = F.encode(F.concat(F.lit("﻿"), text), "UTF-8")
    return F.when(encoding == "utf-8-sig", mark).when(
        encoding.isin("cp1252", "latin-1") & fits, single).otherwise(F.encode(text, "UTF-8"))


def read_texts(spark: SparkSession, path: str, **options) -> DataFrame:
    """(path, text, encoding): one row per file, line ends as they are."""
    files = spark.read.format("binaryFile").options(**options).load(path)
    return files.select("path", F.inline(F.array(decode_bytes(F.col("content")))))


def output_name(path: Column, mode: str) -> Column:
    """notes.md -> notes.pseudo.md"""
    name = F.substring_index(path, "/", -1)
    folder = F.substring(path, F.lit(1), F.length(path) - F.length(name))
    stem, ext = F.regexp_extract(name, r"^(.+?)(\.[^.]+)?$", 1), F.regexp_extract(name, r"^(.+?)(\.[^.]+)?$", 2)
    return F.concat(folder, stem, F.lit("." + MODE_SUFFIX.get(mode, mode)), ext)


def write_texts(result: DataFrame, path: str, mode: str) -> None:
    """Parquet with the name and the bytes each file is to have."""
    result.select(output_name(F.col("path"), mode).alias("path"), encode_text(
        F.col("output"), F.col("encoding")).alias("content")).write.mode("overwrite").parquet(path)


def findings_json(found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """One JSON line per finding: start, end, type, text, detector."""
    return found.select(doc_id, F.inline_outer("spans")).where("start is not null").select(
        doc_id, F.to_json(F.struct("start", "end", "type", "text", "detector")).alias("json"))


def parse_terms(lines: DataFrame, column: str = "value") -> DataFrame:
    """``term|TYPE|replacement`` lines -> term rows."""
    part = F.split(F.col(column), r"\|")

    def at(i: int) -> Column:
        return F.trim(F.coalesce(F.get(part, F.lit(i)), F.lit("")))

    return lines.select(at(0).alias("term"), F.upper(at(1)).alias("type"), at(2).alias("replacement")).where("term <> ''")


def layered(settings: DataFrame) -> DataFrame:
    """(key, value): the value of the strongest layer (default < machine < user < policy)."""
    rank = F.create_map(*[F.lit(x) for p in (("default", 0), ("machine", 1), ("user", 2), ("policy", 3)) for x in p])
    return settings.groupBy("key").agg(F.max_by("value", rank[F.col("layer")]).alias("value"))


def merged_list(base: DataFrame, additions: DataFrame) -> DataFrame:
    """Additive lists: (list_name, value, place). Values of a policy come in front (place 0), the others
    behind (place 1), each value once."""
    both = additions.select("list_name", "value", F.lit(0).alias("place")).union(base.select("list_name", "value", F.lit(1)))
    return both.groupBy("list_name", "value").agg(F.min("place").alias("place"))
