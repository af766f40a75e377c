"""The state of a project: mappings, token maps, surrogate networks, placeholders."""

from __future__ import annotations

from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.functions import text as tx
from veilspan.functions.tables import empty_frame, union_all
from veilspan.schema import STATE_SCHEMAS

WORD_LABELS = {"words": "WORD", "first": "FIRST_NAME", "last": "LAST_NAME", "users": "USER_TOKEN"}


@dataclass
class State:
    mappings: DataFrame
    token_map: DataFrame
    networks: DataFrame
    placeholders: DataFrame

    @classmethod
    def empty(cls, spark: SparkSession) -> State:
        return cls(**{name: empty_frame(spark, schema) for name, schema in STATE_SCHEMAS.items()})

    # ------------------------------------------------------------ storage
    @classmethod
    def load(cls, spark: SparkSession, path: str) -> State:
        """The newest complete version below ``path`` (an empty state if there is none)."""
        version = _latest(spark, path)
        if version is None:
            return cls.empty(spark)
        return cls(**{
            name: spark.read.schema(schema).parquet(f"{path}/v{version:010d}/{name}")
            for name, schema in STATE_SCHEMAS.items()})

    def save(self, path: str) -> int:
        """Write a new version, partitioned by project; a marker makes it visible when all tables are
        there, so a job that dies leaves the version before."""
        spark = self.mappings.sparkSession
        version = (_latest(spark, path) or 0) + 1
        for name in STATE_SCHEMAS:
            getattr(self, name).write.mode("overwrite").partitionBy("project").parquet(
                f"{path}/v{version:010d}/{name}")
        fs, root = _file_system(spark, path)
        fs.create(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v{version:010d}/_COMPLETE"), True).close()
        return version

    # ------------------------------------------------------------ maintenance
    def drop(self, project: str, keys: DataFrame | None = None, tokens: DataFrame | None = None) -> State:
        """Without tables: clear a project. ``keys(type, original)`` and ``tokens(map, token)`` remove
        single rows."""
        here = F.col("project") == project
        if keys is None and tokens is None:
            return State(*[getattr(self, n).where(~here) for n in STATE_SCHEMAS])
        mappings, token_map = self.mappings, self.token_map
        if keys is not None:
            gone = keys.select("type", "original").distinct().withColumn("project", F.lit(project))
            mappings = mappings.join(gone, ["project", "type", "original"], "left_anti")
        if tokens is not None:
            gone = tokens.select("map", "token").distinct().withColumn("project", F.lit(project))
            token_map = token_map.join(gone, ["project", "map", "token"], "left_anti")
        return State(mappings, token_map, self.networks, self.placeholders)

    def overview(self, project: str) -> DataFrame:
        """All mappings, and the tokens that are no full entry."""
        entries = self.mappings.where(F.col("project") == project).drop("project")
        label = F.create_map(*[F.lit(x) for pair in WORD_LABELS.items() for x in pair])
        tokens = self.token_map.where(F.col("project") == project).select(
            label[F.col("map")].alias("type"), F.col("token").alias("original"), "surrogate",
            F.lit(0).cast("bigint").alias("count"), F.lit(None).cast("timestamp").alias("first_seen"),
            F.lit(None).cast("timestamp").alias("last_seen"))
        listed = entries.select(F.lower("original").alias("original")).distinct()
        return entries.unionByName(tokens.join(listed, "original", "left_anti"))

    def search(self, project: str, needle: str = "", type_: str | None = None) -> DataFrame:
        rows = self.overview(project)
        if type_:
            rows = rows.where(F.col("type") == type_)
        low = F.lit(needle.lower())
        return rows.where(F.contains(F.lower("original"), low) | F.contains(F.lower("surrogate"), low))

    def projects(self) -> DataFrame:
        """Names of the projects with the time of their last change."""
        seen = self.mappings.groupBy("project").agg(F.max("last_seen").alias("changed"))
        others = union_all([getattr(self, n).select("project") for n in ("token_map", "networks", "placeholders")])
        return others.distinct().join(seen, "project", "full_outer").withColumn("slug", tx.slugify(F.col("project")))

    # ------------------------------------------------------------ interchange
    def export_csv(self, project: str, path: str) -> None:
        """``;`` separated, sorted by type and lower-case original."""
        columns = ["type", "original", "surrogate", "count", "first_seen", "last_seen"]
        self.overview(project).select(*columns).orderBy("type", F.lower("original")).write.mode("overwrite").option(
            "sep", ";").option("header", True).csv(path)

    def to_json(self, project: str) -> DataFrame:
        """(kind, row): one JSON document per state row."""
        return union_all([
            getattr(self, n).where(F.col("project") == project).select(
                F.lit(n).alias("kind"), F.to_json(F.struct("*")).alias("row")) for n in STATE_SCHEMAS])

    @classmethod
    def from_json(cls, rows: DataFrame) -> State:
        return cls(*[
            rows.where(F.col("kind") == n).select(F.from_json("row", schema).alias("r")).select("r.*")
            for n, schema in STATE_SCHEMAS.items()])


def create_project(spark: SparkSession, path: str, project: str) -> bool:
    """Take the name of a project in the catalogue below ``path``: False if its slug is taken already.

    The marker is made by the file system's create without overwrite, which one of many writers wins
    (on stores without it, keep the catalogue in a table with a unique key)."""
    to = spark._jvm.org.apache.hadoop.fs.Path
    fs, _ = _file_system(spark, path)
    fs.mkdirs(to(f"{path}/projects"))
    try:
        out = fs.create(_marker(spark, path, project), False)
    except Py4JJavaError as error:
        if error.java_exception.getClass().getSimpleName() != "FileAlreadyExistsException":
            raise
        return False
    out.write(bytearray(project.encode()))
    out.close()
    return True


def project_exists(spark: SparkSession, path: str, project: str) -> bool:
    return _file_system(spark, path)[0].exists(_marker(spark, path, project))


def delete_project(spark: SparkSession, path: str, project: str) -> None:
    """Give the name free; the rows go with ``State.drop``."""
    _file_system(spark, path)[0].delete(_marker(spark, path, project), False)


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """(project, slug, created) of the names that are taken."""
    folder = f"{path}/projects"
    if not _file_system(spark, folder)[0].exists(spark._jvm.org.apache.hadoop.fs.Path(folder)):
        return spark.createDataFrame([], "project string, slug string, created timestamp")
    files = spark.read.format("binaryFile").load(folder)
    return files.select(F.col("content").cast("string").alias("project"), F.regexp_extract("path", r"([^/]+)\.project$", 1).alias("slug"),
                        F.col("modificationTime").alias("created"))


def _marker(spark: SparkSession, path: str, project: str):
    slug = spark.range(1).select(tx.slugify(F.lit(project))).first()[0]
    return spark._jvm.org.apache.hadoop.fs.Path(f"{path}/projects/{slug}.project")


def encrypt_rows(rows: DataFrame, key: Column, aad: str = "veilspan-state") -> DataFrame:
    """(kind, payload): AES-256-GCM per row with a random nonce; the key is 32 bytes from the caller."""
    return rows.select("kind", F.base64(F.aes_encrypt(
        F.encode("row", "UTF-8"), key, F.lit("GCM"), F.lit("DEFAULT"), F.unhex(F.substring(F.sha2(F.uuid(), 256), 1, 24)),
        F.lit(aad))).alias("payload"))


def decrypt_rows(rows: DataFrame, key: Column, aad: str = "veilspan-state") -> DataFrame:
    """Back to (kind, row); rows that fail authentication have a NULL row."""
    return rows.select("kind", F.try_aes_decrypt(
        F.unbase64("payload"), key, F.lit("GCM"), F.lit("DEFAULT"), F.lit(aad)).cast("string").alias("row"))


def _file_system(spark: SparkSession, path: str):
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    return root.getFileSystem(spark._jsc.hadoopConfiguration()), root


def _latest(spark: SparkSession, path: str) -> int | None:
    fs, root = _file_system(spark, path)
    if not fs.exists(root):
        return None
    found = [
        int(s.getPath().getName()[1:]) for s in fs.listStatus(root)
        if s.getPath().getName().startswith("v")
        and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_COMPLETE"))]
    return max(found) if found else None
