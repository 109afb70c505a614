"""Versioned models: stage, check, promote, load."""

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from shelfcast.operators.encoding import Encoders
from shelfcast.operators.trees import Ensemble
from shelfcast.sources.files import append_entry, exists, last_entry, read_pointer

# The combination codes may be absent in older versions.
REQUIRED_ARTIFACTS = ("model", "region", "store", "product", "product_store", "month_product", "metrics")
OPTIONAL_WHEN_LOADING = ("product_store", "month_product")


@dataclass
class Artifacts:
    version: str
    model: Ensemble | PipelineModel
    encoders: Encoders
    metrics: DataFrame


def version_dir(root: str, version: str) -> str:
    return f"{root.rstrip('/')}/versions/{version}"


def stage(root: str, version: str, model: Ensemble | PipelineModel, encoders: Encoders, metrics: DataFrame) -> str:
    """Write all parts of a version; nothing becomes active. A model is an ensemble, or a pipeline of the user's own candidates."""
    path = version_dir(root, version)
    if isinstance(model, Ensemble):
        model.save(metrics.sparkSession, f"{path}/model")
    else:
        model.write().overwrite().save(f"{path}/model")
    for name, table in encoders.tables().items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")
    metrics.write.mode("overwrite").parquet(f"{path}/metrics")
    return path


def missing_artifacts(spark: SparkSession, root: str, version: str) -> list[str]:
    path = version_dir(root, version)
    # An ensemble's head is written after its nodes, a pipeline's metadata before its stages.
    done = {"model": ("model/ensemble/_SUCCESS", "model/metadata/_SUCCESS")}
    return [
        name
        for name in REQUIRED_ARTIFACTS
        if not any(exists(spark, f"{path}/{file}") for file in done.get(name, (f"{name}/_SUCCESS",)))
    ]


class Conflict(RuntimeError):
    """Another version was promoted in the meantime."""


def promote(spark: SparkSession, root: str, version: str, *, instead_of: str | None = None) -> None:
    """Make a complete version the active one; an incomplete one changes nothing.

    The active version is the last entry of a log, and an entry is added only where the log ended when it was read: of two
    writers one is told of a ``Conflict``. ``instead_of`` also asks that this version is the active one now.
    """
    missing = missing_artifacts(spark, root, version)
    if missing:
        raise RuntimeError(f"version {version} is incomplete, without {', '.join(missing)}")
    log = f"{root.rstrip('/')}/active"
    number, _ = last_entry(spark, log)
    if instead_of is not None and active_version(spark, root) != instead_of:
        raise Conflict(f"{active_version(spark, root)} is active, not {instead_of}")
    if not append_entry(spark, log, number + 1, version):
        raise Conflict(f"another version was promoted before {version}")


def active_version(spark: SparkSession, root: str) -> str | None:
    """The last promoted version; roots without a log may have a pointer file."""
    return last_entry(spark, f"{root.rstrip('/')}/active")[1] or read_pointer(spark, f"{root.rstrip('/')}/CURRENT")


def load(spark: SparkSession, root: str, version: str | None = None) -> Artifacts | None:
    """The active version, or None if there is none."""
    version = version or active_version(spark, root)
    if version is None:
        return None
    path = version_dir(root, version)
    tables = {
        name: spark.read.parquet(f"{path}/{name}")
        for name in ("region", "store", "product", "product_store", "month_product")
        if name not in OPTIONAL_WHEN_LOADING or exists(spark, f"{path}/{name}/_SUCCESS")
    }
    of_trees = exists(spark, f"{path}/model/ensemble/_SUCCESS")
    model = Ensemble.load(spark, f"{path}/model") if of_trees else PipelineModel.load(f"{path}/model")
    return Artifacts(
        version, model, Encoders(**tables), spark.read.parquet(f"{path}/metrics")
    )
