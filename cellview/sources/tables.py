"""Sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellview.domain import Domain
from cellview.functions import noise
from cellview.plans.network import Hierarchy


def load_table(spark: SparkSession, path: str, domain: Domain, fmt: str = "parquet", **options) -> DataFrame:
    """Records of a domain: its attributes only, in its order, as integers."""
    df = spark.read.format(fmt).options(**options).load(path)
    return select_domain(df, domain)


def select_domain(df: DataFrame, domain: Domain) -> DataFrame:
    missing = [a for a in domain.attrs if a not in df.columns]
    if missing:
        raise ValueError(f"the table lacks domain attributes: {missing}")
    return df.select(*[F.col(a).cast("int").alias(a) for a in domain.attrs])


def read_delimited(spark: SparkSession, path: str, schema: str, sep: str = ",", header: bool = False) -> DataFrame:
    """Comma-, tab- or blank-separated text with a declared schema."""
    return spark.read.schema(schema).option("sep", sep).option("header", header).csv(path)


def write_delimited(df: DataFrame, path: str, sep: str = ",", header: bool = False, mode: str = "error") -> None:
    df.write.mode(mode).option("sep", sep).option("header", header).csv(path)


def write_domain(spark: SparkSession, domain: Domain, path: str) -> None:
    """Domain as a one-line JSON text next to the data."""
    spark.createDataFrame([(domain.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_domain(spark: SparkSession, path: str) -> Domain:
    return Domain.from_json(spark.read.text(path).collect()[0].value)


def write_dataset(
    root: str, codes: DataFrame, raw: DataFrame, domain: Domain, split_key: list[str], seed: str, test_fraction: float = 0.1
) -> None:
    """Codes, raw rows, their train/test parts and the domain, below ``root``.

    ``codes`` and ``raw`` share the key columns, so both split alike.
    """
    from cellview.sources.sampling import train_test_split

    for name, df in (("data", codes), ("raw", raw)):
        keep = [c for c in df.columns if c not in split_key]
        parts = train_test_split(df, split_key, seed, test_fraction)
        df.select(*keep).write.mode("overwrite").parquet(f"{root}/{name}")
        parts.select(*keep, "part").write.mode("overwrite").partitionBy("part").parquet(f"{root}/{name}_parts")
    write_domain(codes.sparkSession, domain, f"{root}/domain")


def save_view(view: DataFrame, root: str, method: str, epsilon: float, trial: int) -> None:
    """Store one release in its own partition, in place of an earlier run's; reading back by
    method, epsilon and trial prunes."""
    tagged = view.withColumn("method", F.lit(method)).withColumn("eps", F.lit(float(epsilon))).withColumn("trial", F.lit(trial))
    tagged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("method", "eps", "trial").parquet(root)


def load_views(spark: SparkSession, root: str, method: str | None = None, epsilon: float | None = None, trial: int | None = None) -> DataFrame:
    df = spark.read.parquet(root)
    for column, wanted in (("method", method), ("eps", epsilon), ("trial", trial)):
        if wanted is not None:
            df = df.filter(F.col(column) == F.lit(wanted))
    return df


def save_results(results: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON record per workload, method and epsilon; a rerun replaces its results."""
    results.write.mode(mode).json(path)


def libsvm_lines(
    records: DataFrame, levels: dict[str, Hierarchy], label: str, positives: list[int], raw: dict[str, tuple[float, float]] | None = None
) -> DataFrame:
    """One text line per record: ``+1``/``-1``, then ``index:value`` pairs.

    Categories are one-hot; numeric codes are centred and scaled to [0, 1].
    ``raw`` gives ``(low, high)`` of attributes that hold raw numbers.
    """
    hit = F.col(label).isin([int(p) for p in positives])
    parts, index = [F.when(hit, F.lit("+1")).otherwise(F.lit("-1"))], 1
    for a, h in levels.items():
        if a == label:
            continue
        if h.uppers or h.depth == 1:
            parts.append(F.concat((F.col(a) + F.lit(index)).cast("string"), F.lit(":1")))
            index += h.sizes[0]
        else:
            if raw and a in raw:
                low, high = raw[a]
                step = (high - low) / h.sizes[0]
                value = (F.col(a) - F.lit(float(low))) / F.lit(step) / F.lit(float(h.sizes[0]))
            else:
                value = (F.col(a) + F.lit(0.5)) / F.lit(float(h.sizes[0]))
            parts.append(F.concat(F.lit(f"{index}:"), F.format_string("%.6f", value)))
            index += 1
    return records.select(F.concat_ws(" ", *parts).alias("value"))


def export_libsvm(records: DataFrame, levels: dict[str, Hierarchy], label: str, positives: list[int], path: str, **kw) -> None:
    libsvm_lines(records, levels, label, positives, **kw).write.mode("overwrite").text(path)


def keep_ratio(records: DataFrame, ratio: float, key: list[str], seed: str) -> DataFrame:
    """Each row independently with probability ``ratio``."""
    return records.filter(noise.unit(seed, "keep", *[F.col(c) for c in key]) <= F.lit(ratio))
