"""What the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from presswork.session import shared_dir, stored  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """The default place of a public tokenizer file; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)
