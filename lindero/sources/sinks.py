"""Writers: one record each in partitions, resuming, an archive with guards, tab-separated tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY_SHAPE = r"AIza[0-9A-Za-z_-]{20,}|sk-[0-9A-Za-z]{20,}"


def checkpoint_records(records: DataFrame, path: str, by: tuple[str, ...] = ("arm", "run_no")) -> None:
    """Records as JSON lines in a folder for each arm and run."""
    records.write.partitionBy(*by).mode("append").json(path)


def not_yet_done(planned: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Planned work that has no record yet."""
    return planned.join(done.select(*keys), keys, "left_anti")


def archive(records: DataFrame) -> DataFrame:
    """(records, digest): the number of records and a digest that doesn't depend on their order; refuses synthetic records and key material."""
    body = F.to_json(F.struct(*sorted(records.columns)))
    guarded = records.select(F.when(body.rlike(KEY_SHAPE), F.raise_error(F.lit("key material in a record"))).when(body.contains('"synthetic":true'), F.raise_error(F.lit("synthetic record"))).otherwise(body).alias("body"))
    digest = F.sha2(F.concat_ws(",", F.sum(F.xxhash64("body").cast("decimal(38,0)")).cast("string"), F.count("*").cast("string")), 256)
    return guarded.agg(F.count("*").alias("records"), digest.alias("digest"))


def tab_separated(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, sep="\t", header=True)


def verdict_json(checks: DataFrame) -> DataFrame:
    """One row of JSON from checks (name, pass): the verdict and what it rests on."""
    told = F.transform(F.array_sort(F.collect_list(F.struct("name", F.col("pass").alias("passed")))), lambda c: F.concat(c["name"], F.lit(": "), F.when(c["passed"], "yes").otherwise("NO")))
    return checks.agg(F.to_json(F.struct(F.when(F.bool_and("pass"), "pass").otherwise("deviates").alias("verdict"), F.array_join(told, "; ").alias("reason"))).alias("verdict"))


def wide_sheet(cells: DataFrame, columns: list[int]) -> DataFrame:
    """Cells (sheet, row_no, col_no, value) as rows of sheets, a column for each number of `columns`."""
    return cells.groupBy("sheet", "row_no").pivot("col_no", columns).agg(F.first("value"))
