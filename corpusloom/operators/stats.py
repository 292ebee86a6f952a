"""Reports over sources: rows, proportions and tokens, and the JSON files made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import python_round


def rows_per_source(df: DataFrame, source: str = "dataset") -> DataFrame:
    return df.groupBy(source).agg(F.count(F.lit(1)).alias("n_rows"))


def _share(df: DataFrame, value: str, total: str) -> DataFrame:
    """df with the total of value over all of it: a window over one row per source, not over data."""
    return df.withColumn(total, F.sum(value).over(Window.partitionBy()))


def mixture_proportions(df: DataFrame, source: str = "dataset", digits: int = 3) -> DataFrame:
    rows = _share(rows_per_source(df, source), "n_rows", "total_rows")
    return rows.withColumn("proportion", F.round(F.col("n_rows") / F.col("total_rows"), digits))


def token_distribution(df: DataFrame, source: str = "dataset", count: str = "num_tokens", digits: int = 4) -> DataFrame:
    """Tokens of each source and their share; no rows give no rows."""
    by = df.groupBy(source).agg(F.sum(count).alias("tokens"))
    shared = _share(by, "tokens", "total_tokens")
    return shared.withColumn("percentage", F.round(F.when(F.col("total_tokens") > 0, F.col("tokens") / F.greatest("total_tokens", F.lit(1))).otherwise(F.lit(0.0)), digits))


def with_declared_sources(dist: DataFrame, names: list[str], source: str = "dataset") -> DataFrame:
    """dist with a row for every declared name; names without tokens get 0."""
    declared = dist.sparkSession.createDataFrame([(n,) for n in names], f"{source} string")
    return declared.join(dist, source, "left").select(source, F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("percentage", F.lit(0.0)).alias("percentage"))


def mixture_report(df: DataFrame, weights: dict[str, int | None], seed: int = 0, source: str = "dataset") -> dict:
    """data_distribution.json: the driver gets one row per declared source."""
    got = {r[0]: r[1] for r in rows_per_source(df.where(F.col(source).isin(list(weights))), source).collect()}
    total = sum(got.values())
    if not total:
        raise ZeroDivisionError("the mixture has no rows")
    return {"seed": seed, "weights": weights, "total_rows": total, "proportions": {k: python_round(got.get(k, 0) / total, 3) for k in weights}}


def token_report(df: DataFrame, source: str = "dataset", count: str = "num_tokens") -> dict:
    """token_distribution.json: the driver gets one row per source."""
    got = {r[0]: r[1] for r in df.groupBy(source).agg(F.sum(count)).collect()}
    total = sum(got.values())
    return {"total_tokens": total, "tokens_per_source": got, "percentages": {k: python_round(v / total, 4) for k, v in got.items()} if total else {}}


#: What token_distribution.json holds.
TOKEN_REPORT = "total_tokens long, tokens_per_source map<string,long>, percentages map<string,double>"


def token_report_row(dist: DataFrame, source: str = "dataset") -> DataFrame:
    """The token report as a row of TOKEN_REPORT, of what token_distribution() returns: a row per source is gathered."""
    entries = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(source), F.col(c)))))
    return dist.agg(F.coalesce(F.max("total_tokens"), F.lit(0)).cast("long").alias("total_tokens"), entries("tokens").alias("tokens_per_source"), entries("percentage").alias("percentages"))


def token_report_rows(report: DataFrame, names: list[str] | None = None, source: str = "dataset") -> DataFrame:
    """(source, tokens, percentage, total_tokens) of every source that a report has a share of, or of names alone.

    Fields and sources that the report lacks count as 0.
    """
    empty = lambda kind: F.map_from_arrays(F.array(), F.array()).cast(f"map<string,{kind}>")
    share, count = F.coalesce("percentages", empty("double")), F.coalesce("tokens_per_source", empty("long"))
    listed = F.map_keys(share) if names is None else F.lit(names).cast("array<string>")
    rows = report.select(F.coalesce("total_tokens", F.lit(0)).alias("total_tokens"), share.alias("share"), count.alias("count"), F.explode(listed).alias(source))
    return rows.select(source, F.coalesce(F.col("count")[F.col(source)], F.lit(0)).alias("tokens"), F.coalesce(F.col("share")[F.col(source)], F.lit(0.0)).alias("percentage"), "total_tokens")


def packing_report(stats: DataFrame, length: int, input_dir: str, eos_token_id: int = 0) -> dict:
    """packing_stats.json of the one row that packing_stats() returns."""
    r = stats.first()
    keys = ("total_sequences", "total_tokens", "avg_tokens_per_sequence", "avg_examples_per_sequence")
    return {"config": {"max_seq_length": length, "eos_token_id": eos_token_id, "input_dir": input_dir}, "statistics": {"train": {k: r[k] for k in keys}}}


def token_summary(report: dict) -> str:
    """The token report as text: sources by share, with thousands separators."""
    lines = [f"Total tokens: {report['total_tokens']:,}"]
    for name, share in sorted(report["percentages"].items(), key=lambda x: -x[1]):
        lines.append(f"  {name:<20} {report['tokens_per_source'].get(name, 0):>15,} ({share:.1%})")
    return "\n".join(lines)


def packing_summary(statistics: dict) -> str:
    return "\n".join(
        [
            f"Packed sequences: {statistics['total_sequences']:,}",
            f"Total tokens: {statistics['total_tokens']:,}",
            f"Avg tokens per sequence: {statistics['avg_tokens_per_sequence']:.1f}",
            f"Avg examples per sequence: {statistics['avg_examples_per_sequence']:.2f}",
        ]
    )
