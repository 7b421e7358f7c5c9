"""Result tables of experiments: storing, averaging, comparing levels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import RESULT_COLUMNS

#: Heap sizes that are searched for each k.
MAX_HEAP_SIZES = {
    1: [10, 30, 50, 100, 200],
    5: [10, 30, 50, 100, 200],
    10: [10, 30, 50, 100, 150, 200],
    20: [20, 30, 40, 60, 100, 150, 200],
    30: [30, 40, 60, 100, 150, 200],
    50: [50, 75, 100, 150, 250],
    100: [100, 150, 200, 300, 500, 700, 1000],
    300: [300, 500, 750],
    500: [500, 750, 1000],
    1000: [1000, 1200],
}
#: Level sizes above the bottom that suit the known data sets.
LEVEL_SUBSET_SIZES = {
    "audio": [5300, 550, 40],
    "enron": [1800, 40],
    "deep1m": [20_000, 400, 40],
    "glove-100": [24_000, 500, 40],
    "sift": [25_000, 600, 40],
    "siftsmall": [200, 40],
    "300K": [10_000, 400, 40],
    "3M": [100_000, 3_300, 150, 30],
    "10M": [350_000, 12_000, 500, 30],
}


def max_heap_sizes(k: int, override: list[int] | None = None) -> list[int]:
    return override if override is not None else MAX_HEAP_SIZES.get(k, [k])


def level_subset_sizes(dataset: str) -> list[int] | None:
    return LEVEL_SUBSET_SIZES.get(dataset)


def write_results(rows: DataFrame, path: str, config: str = "") -> None:
    """Semicolons, a header, and the configuration as a last comment line in a file of its own."""
    rows.write.mode("append").option("sep", ";").option("header", True).csv(path)
    if config:
        lines = rows.sparkSession.createDataFrame([(f"# Config: {x}",) for x in config.splitlines()], "value string")
        lines.coalesce(1).write.mode("append").text(path)


def read_results(spark: SparkSession, path: str, schema: str = RESULT_COLUMNS) -> DataFrame:
    return spark.read.option("sep", ";").option("header", True).option("comment", "#").option("enforceSchema", False).schema(schema).csv(path + "/*.csv")


def has_nan(rows: DataFrame, columns: tuple[str, ...] = ("recall", "qps")) -> DataFrame:
    return rows.agg(*(F.coalesce(F.bool_or(F.isnan(c) | F.col(c).isNull()), F.lit(False)).alias(f"{c}_nan") for c in columns))


def plot_rows(rows: DataFrame, top_layer_only: bool = False, exclude: dict[str, tuple] | None = None) -> DataFrame:
    """Mean qps and recall and the first elapsed time (by seq) of each builder, data set, k, heap sizes and layer."""
    kept = renamed(rows)
    for column, values in (exclude or {}).items():
        kept = kept.where(~F.col(column).isin(*values))
    keys = [F.col("builder_type"), F.col("dataset"), F.col("k"), F.col("higher_level_max_heap_size").alias("hlmhs"), F.col("max_heap_size").alias("mhs"), F.col("layer_count").alias("layer")]
    out = kept.groupBy(*keys).agg(F.avg("qps").alias("qps"), F.avg("recall").alias("recall"), F.min_by("elapsed_time", F.struct("seq", "elapsed_time")).alias("build_time_raw"))
    if top_layer_only:
        top = F.max("layer").over(Window.partitionBy("builder_type", "dataset", "k", "hlmhs", "mhs"))
        out = out.withColumn("top", top).where("layer = top").drop("top")
    return out


def gains(plot: DataFrame, layers: tuple[int, ...] = (1, 4, 5, 6)) -> DataFrame:
    """What the top layer gains over the bottom one: qps and recall, absolute and in per cent."""
    g = plot.where(F.col("layer").isin(*layers)).groupBy("builder_type", "dataset", "k", "hlmhs", "mhs").agg(
        *(f(c, "layer").alias(f"{c}_{n}") for c in ("qps", "recall") for f, n in ((F.max_by, "top"), (F.min_by, "bottom")))
    )
    out = g
    for c in ("qps", "recall"):
        diff = F.col(f"{c}_top") - F.col(f"{c}_bottom")
        out = out.withColumn(f"{c}_diff", diff).withColumn(f"{c}_diff_percentage", diff / F.nullif(F.col(f"{c}_bottom"), F.lit(0.0)) * 100)
    return out.select("builder_type", "dataset", "k", "hlmhs", "mhs", "qps_diff_percentage", "qps_diff", "recall_diff_percentage", "recall_diff", "recall_bottom", "qps_bottom")


def compare_levels(plot: DataFrame, k: int, hlmhs: int = 1, ends_only: bool = False) -> DataFrame:
    """The rows of plot_rows at one k and one heap size above the bottom, in which builders are compared; ends_only: the bottom and each builder's own top layer."""
    out = plot.where((F.col("k") == k) & (F.col("hlmhs") == hlmhs))
    if ends_only:
        out = out.withColumn("top", F.max("layer").over(Window.partitionBy("builder_type"))).where("layer = 1 or layer = top").drop("top")
    return out


def compare_ef_higher(plot: DataFrame, k: int, ends_only: bool = False) -> DataFrame:
    """The rows at one k, in which heap sizes above the bottom (as text) are compared; ends_only: the bottom and the highest layer of all."""
    out = plot.where(F.col("k") == k)
    if ends_only:
        top = out.agg(F.max("layer").alias("top"))  # one row
        out = out.join(F.broadcast(top), (F.col("layer") == 1) | (F.col("layer") == F.col("top"))).drop("top")
    return out.withColumn("hlmhs", F.col("hlmhs").cast("string"))


def with_heap_sizes(rows: DataFrame, k: str = "k") -> DataFrame:
    """rows with max_heap_size, one for each heap size that is searched for its k."""
    known = F.create_map(*(x for key, sizes in MAX_HEAP_SIZES.items() for x in (F.lit(key), F.array(*map(F.lit, sizes)))))
    return rows.withColumn("max_heap_size", F.explode(F.coalesce(F.try_element_at(known, F.col(k).cast("int")), F.array(F.col(k).cast("int")))))


def with_level_sizes(rows: DataFrame, dataset: str = "dataset") -> DataFrame:
    """rows with level (from 1) and size of the levels that suit their data set; rows of unknown sets are left out."""
    known = F.create_map(*(x for name, sizes in LEVEL_SUBSET_SIZES.items() for x in (F.lit(name), F.array(*map(F.lit, sizes)))))
    placed = rows.select("*", F.posexplode(F.try_element_at(known, F.col(dataset))).alias("level", "size"))
    return placed.withColumn("level", F.col("level") + 1).withColumn("size", F.col("size").cast("long"))


def described(rows: DataFrame, *columns: str) -> DataFrame:
    """rows with params: the columns as name=value, joined by a bar, None for null."""
    return rows.withColumn("params", F.concat_ws("|", *(F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("None"))) for c in columns)))


def renamed(rows: DataFrame) -> DataFrame:
    """data_set becomes dataset, and bare LAION sizes get their prefix."""
    out = rows.withColumnRenamed("data_set", "dataset")
    return out.withColumn("dataset", F.when(F.col("dataset").isin("300K", "3M", "10M", "100M"), F.concat(F.lit("LAION-"), "dataset")).otherwise(F.col("dataset")))


def first_params(rows: DataFrame) -> DataFrame:
    return rows.groupBy("builder_type").agg(F.min_by("params", F.struct("seq", "params")).alias("params"))


def union_results(first: DataFrame, *others: DataFrame) -> DataFrame:
    for o in others:
        first = first.unionByName(o, allowMissingColumns=True)
    return first


def latex_table(gain_rows: DataFrame) -> str:
    """The gains as rows of a LaTeX table; a report of a few dozen lines."""
    cols = gain_rows.columns
    body = [" & ".join(f"{v:.2f}" if isinstance(v, float) else str(v) for v in r) + r" \\" for r in gain_rows.collect()]
    return "\n".join([r"\begin{tabular}{" + "l" * len(cols) + "}", " & ".join(c.replace("_", r"\_") for c in cols) + r" \\", *body, r"\end{tabular}"])
