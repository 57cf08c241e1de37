"""A catalogue of models and which of them a device can run."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.errors import DimensionMismatch

TIERS = {"low": 0, "mid": 1, "high": 2}


@dataclass(frozen=True)
class Device:
    tier: str = "mid"
    gpu: bool = False
    memory_gb: float | None = None


def tier_of(memory_gb: Column, cores: Column, gpu: Column) -> Column:
    """high: 8 GB, 8 cores and a GPU; low: under 4 GB or 4 cores; else mid."""
    return F.when((memory_gb >= 8) & (cores >= 8) & gpu, "high").when((memory_gb < 4) | (cores < 4), "low").otherwise("mid")


class Registry:
    """Embedding models (id, dimensions, size_mb, tier) and language models (id, provider, size_gb, tier, needs_gpu)."""

    def __init__(self, embedding: list[tuple] = (), language: list[tuple] = ()):
        self.embedding = {r[0]: r for r in embedding}
        self.language = {r[0]: r for r in language}

    def tables(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        return spark.createDataFrame(list(self.embedding.values()), "id string, dimensions int, size_mb int, tier string"), spark.createDataFrame(list(self.language.values()), "id string, provider string, size_gb double, tier string, needs_gpu boolean")

    def check_dimensions(self, model: str, dimensions: int) -> None:
        """Unknown models pass: their adapter tells."""
        known = self.embedding.get(model)
        if known and known[1] != dimensions:
            raise DimensionMismatch(dimensions, known[1])

    def can_run(self, model: str, device: Device) -> tuple[bool, str]:
        """Whether, and if not why."""
        if model in self.language:
            _, _, size, tier, needs_gpu = self.language[model]
            if needs_gpu and not device.gpu:
                return False, f"{model} needs a GPU"
            if device.memory_gb is not None and size > device.memory_gb:
                return False, f"{model} needs {size} GB"
        elif model in self.embedding:
            tier = self.embedding[model][3]
        else:
            return True, ""
        return (True, "") if TIERS[tier] <= TIERS[device.tier] else (False, f"{model} is for devices from {tier}")


def recommend(language: DataFrame, device: Device, gpu_provider: str) -> DataFrame:
    """The smallest model the device can run, one of the GPU's provider first: one row or none."""
    tier = F.when(F.col("tier") == "low", 0).when(F.col("tier") == "mid", 1).otherwise(2)
    fits = language.where((tier <= TIERS[device.tier]) & (~F.col("needs_gpu") | F.lit(device.gpu)))
    return fits.orderBy(F.desc(F.col("provider") == gpu_provider), "size_gb", "id").limit(1)
