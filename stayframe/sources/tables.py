"""Table scans, CSV scans, sinks, the feature spec and the repeatable sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T



def read_table(spark: SparkSession, name: str, base: str | None = None, fmt: str = "parquet") -> DataFrame:
    """A catalog table, or ``<base>/<name>.<fmt>`` when ``base`` is given."""
    if base is None:
        return spark.table(name)
    return spark.read.format(fmt).load(f"{base.rstrip('/')}/{name}.{fmt}")


def use_namespace(spark: SparkSession, name: str) -> None:
    """Unqualified table names resolve in this catalog namespace from now on."""
    spark.catalog.setCurrentDatabase(name)


def read_jdbc(spark: SparkSession, url: str, table: str, partition_column: str | None = None,
              lower: int | None = None, upper: int | None = None, num_partitions: int = 64,
              properties: dict | None = None) -> DataFrame:
    """S01 over JDBC, split on a numeric column so the scan runs in parallel."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    for k, v in (properties or {}).items():
        reader = reader.option(k, v)
    if partition_column is not None:
        reader = (reader.option("partitionColumn", partition_column).option("lowerBound", lower)
                  .option("upperBound", upper).option("numPartitions", num_partitions))
    return reader.load()


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
             drop_index: bool = True) -> DataFrame:
    """Header CSV with an explicit schema; a leading unnamed index column
    (written by pandas) is dropped."""
    reader = spark.read.option("header", True)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    df = reader.csv(path)
    if drop_index:
        unnamed = [c for c in df.columns if c in ("", "_c0") or c.startswith("Unnamed")]
        df = df.drop(*unnamed)
    return df


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None,
                mode: str = "overwrite") -> None:
    """Write a stage table."""
    w = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        w = w.option("header", True)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def to_timestamp_ntz(c, fmt: str | None = None) -> Column:
    """Text -> timestamp without zone (NULL on bad input)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.try_to_timestamp(c, F.lit(fmt)).cast("timestamp_ntz") if fmt else c.try_cast("timestamp_ntz")


SPEC_SCHEMA = ("name string, `table` string, variable string, item_id long, item_id_2 long, "
               "item_id_3 long, item_id_4 long, item_id_5 long, item_id_6 long")


def spec_items(spec: DataFrame) -> dict[str, list]:
    """The long spec as {feature: [items]}: one column set per feature follows
    from it, so it is metadata and held by the driver."""
    out: dict[str, list] = {}
    for r in sorted(spec.select("feature", "item").collect(), key=lambda r: (r.feature, r.item)):
        out.setdefault(r.feature, []).append(r.item)
    return out


def load_feature_spec(spark: SparkSession, path: str | None = None, csv_text: str | None = None,
                      item_type: str = "long") -> DataFrame:
    """The feature spec as a long table (feature, table, variable, item).

    Names are lower-cased, as the original SQL folds them. Spec rows with no
    item id at all are dropped; remaining ids are unpivoted into one row each.
    """
    schema = SPEC_SCHEMA.replace(" long", f" {item_type}")
    if path is not None:
        wide = spark.read.option("header", True).schema(schema).csv(path)
    else:
        import csv
        import io
        rows = list(csv.DictReader(io.StringIO(csv_text)))
        id_cols = [k for k in rows[0] if k.startswith("item_id")]
        conv = int if item_type == "long" else str
        data = [(r["name"], r["table"], r["variable"],
                 *[conv(r[k]) if r[k] else None for k in id_cols]) for r in rows]
        n_ids = len(id_cols)
        schema = ", ".join(schema.split(", ")[:3 + n_ids])
        wide = spark.createDataFrame(data, schema)
    id_cols = [c for c in wide.columns if c.startswith("item_id")]
    long = wide.unpivot(["name", "table", "variable"], id_cols, "slot", "item")
    return (long.where(F.col("item").isNotNull())
            .select(F.lower("name").alias("feature"), "table", "variable", F.col("item").cast(item_type).alias("item")))


def fixed_size_sample(df: DataFrame, n: int, key_cols: list[str], seed: int = 42) -> DataFrame:
    """A repeatable sample of exactly ``min(n, count)`` rows: the ``n`` rows
    with the smallest md5(key|seed).

    The ordering is only applied to a pre-filtered candidate set: rows whose
    hash prefix is under a threshold expected to keep about 4n rows (widened
    until at least n rows pass), so no task ever ships ``n`` rows per map
    partition to a single reducer."""
    h = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in key_cols], F.lit(str(seed))))
    d = df.withColumn("_h", h)
    total = df.count()
    if total <= n:
        return d.orderBy("_h", *key_cols).drop("_h")
    frac = min(1.0, 4.0 * n / total)
    while True:
        thr = format(min(int(frac * 16 ** 8), 16 ** 8 - 1), "08x")
        cand = d.where(F.substring("_h", 1, 8) <= F.lit(thr))
        if frac >= 1.0 or cand.count() >= n:
            break
        frac = min(1.0, frac * 4)
    return cand.orderBy("_h", *key_cols).limit(n).drop("_h")
