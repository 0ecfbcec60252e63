"""Reading and writing the lake: JSON lines, snapshots, partitioned fan-out, CSV, GeoJSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Rows of JSON-lines files; blank lines are skipped, broken lines come out in _corrupt_record with null fields."""
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if "_corrupt_record" not in fields.fieldNames():
        fields = T.StructType([*fields.fields, T.StructField("_corrupt_record", T.StringType())])
    return spark.read.schema(fields).option("mode", "PERMISSIVE").json(path)


def read_nested(spark: SparkSession, path: str, schema: str, items: str, keep: list[str], source: str | None = None) -> DataFrame:
    """One row per element of the array `items` of each document, with the columns `keep`; documents without any are dropped.

    `source` names a column for the file a row comes from.
    """
    docs = read_jsonl(spark, path, schema).where("_corrupt_record is null").drop("_corrupt_record")
    if source:
        docs, keep = docs.withColumn(source, F.input_file_name()), [*keep, source]
    return docs.select(*keep, F.explode(items).alias("item")).select(*keep, "item.*")


def broken_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines that aren't documents of the schema, counted per file: file, errors."""
    lines = spark.read.text(path).where("trim(value) <> ''").withColumn("file", F.input_file_name())
    read = F.from_json("value", schema + ", _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return lines.withColumn("read", read).where("read._corrupt_record is not null").groupBy("file").agg(F.count("*").alias("errors"))


def file_listing(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """Files under a path: file, bytes, modified; the first `most` by name where given. Contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    files = files.select(F.col("path").alias("file"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))
    return files if most is None else files.orderBy("file").limit(most)


def latest_snapshot(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of the file modified last (the greatest name among equals)."""
    last = file_listing(spark, path).agg(F.max(F.struct("modified", "file")).alias("m")).first()
    if last is None or last.m is None:
        return spark.createDataFrame([], T.StructType.fromDDL(schema))
    return read_jsonl(spark, last.m.file, schema).drop("_corrupt_record")


def url_list(spark: SparkSession, path: str) -> DataFrame:
    """URLs of a text file, without comments and blank lines."""
    line = F.trim("value")
    return spark.read.text(path).select(line.alias("url")).where("url <> '' and not startswith(url, '#')")


def write_jsonl(rows: DataFrame, path: str, metadata: dict[str, str] | None = None) -> None:
    """Rows as JSON lines; `metadata` lies beside them in _metadata/."""
    rows.write.mode("overwrite").json(path)
    if metadata:
        one = rows.sparkSession.createDataFrame([(metadata,)], "metadata map<string,string>")
        one.coalesce(1).write.mode("overwrite").json(f"{path}/_metadata")


def batch_path(root: str, source: str, content: str, at: str) -> str:
    """Where a batch lies by default: raw/source/content/YYYY-MM/batch_time of the moment `at` (YYYY-MM-DD HH:MM:SS)."""
    stamp = at.replace("-", "").replace(":", "").replace(" ", "_")
    return f"{root}/raw/{source}/{content}/{at[:7]}/batch_{stamp}"


def key_of(c: Column) -> Column:
    """A value as a folder name: lower case, blanks and slashes as underscores, 'unknown' for null or blank."""
    text = F.regexp_replace(F.lower(F.trim(c)), "[ /]", "_")
    return F.when(F.coalesce(text, F.lit("")) == "", "unknown").otherwise(text)


def fan_out(rows: DataFrame, path: str, keys: dict[str, str]) -> None:
    """`rows` as a whole under all/, partitioned under each folder of `keys` (folder -> column), and counts per key under stats/."""
    rows.write.mode("overwrite").json(f"{path}/all")
    stats = rows.agg(F.count("*").alias("n")).select(F.lit("all").alias("folder"), F.lit("").alias("key"), "n")
    for folder, column in keys.items():
        keyed = rows.withColumn("key", key_of(F.col(column)))
        keyed.write.mode("overwrite").partitionBy("key").json(f"{path}/{folder}")
        stats = stats.unionByName(keyed.groupBy("key").agg(F.count("*").alias("n")).select(F.lit(folder).alias("folder"), "key", "n"))
    stats.coalesce(1).write.mode("overwrite").json(f"{path}/stats")


def _files(spark: SparkSession, path: str):
    """The file system of a path, by the session's own configuration."""
    jvm = spark._jvm  # noqa: SLF001  the public API has no file operations
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path  # noqa: SLF001


def move_processed(spark: SparkSession, files: list[str], folder: str) -> int:
    """Move files that were processed into `folder`, by renaming; the number moved. Missing ones are left out."""
    fs, path = _files(spark, folder)
    fs.mkdirs(path(folder))
    return sum(bool(fs.exists(path(f)) and fs.rename(path(f), path(f"{folder}/{f.rstrip('/').rsplit('/', 1)[-1]}"))) for f in files)


def backup(spark: SparkSession, source: str, target: str) -> int:
    """Copy a parquet table; the number of rows copied."""
    rows = spark.read.parquet(source)
    rows.write.mode("overwrite").parquet(target)
    return spark.read.parquet(target).count()


def write_keyed(rows: DataFrame, path: str, key: str, order: str) -> None:
    """Put rows into a parquet table by key: the last of a key by `order` wins, among old and new ones. Null keys are left out.

    The new table is written beside the old one and takes its place at the end, so a lost job leaves the old one whole.
    """
    spark = rows.sparkSession
    fs, p = _files(spark, path)
    old = spark.read.parquet(path) if fs.exists(p(path)) else rows.limit(0)
    whole = F.struct(*rows.columns)
    both = rows.unionByName(old.select(*rows.columns)).where(F.col(key).isNotNull())
    last = both.groupBy(key).agg(F.max_by(whole, F.col(order)).alias("r")).select("r.*")
    last.write.mode("overwrite").parquet(f"{path}.new")
    fs.delete(p(path), True)
    fs.rename(p(f"{path}.new"), p(path))


def insert_missing(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """`target` with the rows whose keys it lacks, each key once (any of equal rows)."""
    return target.unionByName(rows.dropDuplicates(keys).join(target.select(*keys), keys, "left_anti").select(*target.columns))


def without_keys(tables: dict[str, DataFrame], key: str, gone: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """A reset: the tables without the rows of the keys in `gone`, in the order given, and the dry run's counts (table, rows).

    Null keys are never removed.
    """
    gone = gone.select(key).where(F.col(key).isNotNull()).distinct()
    left = {name: df.join(gone, key, "left_anti") for name, df in tables.items()}
    counts = None
    for name, df in tables.items():
        one = df.join(gone, key, "left_semi").agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows")
        counts = one if counts is None else counts.unionByName(one)
    return left, counts


def bridge(rows: DataFrame, row_id: str, items: str, name: str) -> DataFrame:
    """The many-to-many rows of an array column: row_id, name; nulls left out, each pair once."""
    return rows.select(row_id, F.explode(items).alias(name)).where(F.col(name).isNotNull()).distinct()


def split_location(c: Column) -> tuple[Column, Column]:
    """City and country of 'place, city, country': the last part is the country, the one before the city; null where missing."""
    parts = F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")
    n = F.size(parts)
    return F.when(n > 1, F.try_element_at(parts, n - 1)).when(n == 1, F.try_element_at(parts, F.lit(1))), F.when(n > 1, F.try_element_at(parts, F.lit(-1)))


def markdown(rows: DataFrame, title: str, score: str, text: str) -> DataFrame:
    """A Markdown paragraph per row, with blank parts left out: line."""
    head = F.concat(F.lit("### "), F.coalesce(title, F.lit("(unnamed)")))
    rating = F.when(F.col(score).isNotNull(), F.format_string("**%.1f / 5**", F.col(score).cast("double")))
    return rows.select(F.concat_ws("\n\n", head, rating, F.when(F.length(F.trim(text)) > 0, F.col(text))).alias("line"))


def map_link(lat: Column, lon: Column) -> Column:
    """A geo: link of a point, null where either coordinate is."""
    return F.when(lat.isNotNull() & lon.isNotNull(), F.format_string("geo:%.6f,%.6f", lat.cast("double"), lon.cast("double")))


def audit_trail(links: DataFrame, path: str) -> None:
    """Decisions of a resolution (a, b, tier, method, score, confidence) as JSON lines, a folder per method."""
    links.write.mode("overwrite").partitionBy("method").json(path)


class Collections:
    """Named collections of rows under a folder: create, list, count, get, delete, reset."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _at(self, name: str) -> str:
        if not name or "/" in name or name.startswith("."):
            raise ValueError(f"not a name of a collection: {name!r}")
        return f"{self.root}/{name}"

    def create(self, name: str, rows: DataFrame) -> None:
        rows.write.mode("errorifexists").parquet(self._at(name))

    def names(self) -> list[str]:
        fs, p = _files(self.spark, self.root)
        return sorted(f.getPath().getName() for f in fs.listStatus(p(self.root))) if fs.exists(p(self.root)) else []

    def get(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self._at(name))

    def count(self, name: str) -> int:
        return self.get(name).count()

    def delete(self, name: str) -> bool:
        fs, p = _files(self.spark, self.root)
        return bool(fs.delete(p(self._at(name)), True))

    def reset(self) -> int:
        return sum(self.delete(n) for n in self.names())


def write_stages_csv(rows: DataFrame, path: str, key: str, stages: str) -> None:
    """One CSV row per key and entry of the map column `stages`."""
    rows.select(key, F.explode(stages).alias("stage", "status")).write.mode("overwrite").option("header", "true").csv(path)


def geojson(rows: DataFrame, row_id: str, name: str, lat: str, lon: str) -> DataFrame:
    """A GeoJSON feature (text) per located row, longitude first."""
    point = F.struct(F.lit("Point").alias("type"), F.array(F.col(lon), F.col(lat)).alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), F.struct(F.col(row_id), F.col(name)).alias("properties"))
    return rows.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).select(F.to_json(feature).alias("feature"))
