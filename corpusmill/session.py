"""Session settings and the few driver-side helpers that every operator shares."""

from __future__ import annotations

import atexit
import json
import shutil
import sys
import tempfile
from collections.abc import Iterable

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

#: Settings that results depend on, and those that let plans adapt at run time.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(app: str = "corpusmill", master: str | None = None, options: dict[str, str] | None = None) -> SparkSession:
    """A session with DEFAULTS, then ``options`` over them (explicit options win)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **(options or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def merge_options(*layers: dict | None) -> dict:
    """Options from weakest to strongest layer; None values do not override."""
    out: dict = {}
    for layer in layers:
        out.update({k: v for k, v in (layer or {}).items() if v is not None})
    return out


def dotlist(pairs: Iterable[str]) -> dict:
    """Options given as ``a.b=value``; values are read as YAML (numbers, booleans, null, lists), which holds JSON."""
    out: dict = {}
    for pair in pairs:
        key, _, text = pair.partition("=")
        at = out
        *parents, last = key.split(".")
        for name in parents:
            at = at.setdefault(name, {})
        at[last] = _yaml(text)
    return out


def _yaml(text: str):
    try:
        import yaml
    except ImportError:
        return json.loads(text)
    return yaml.safe_load(text)


def deep_merge(low: dict, high: dict) -> dict:
    """``high`` over ``low``, dictionary by dictionary."""
    return {**low, **{k: deep_merge(low[k], v) if isinstance(v, dict) and isinstance(low.get(k), dict) else v for k, v in high.items()}}


def load_options(spark: SparkSession, path: str, overrides: Iterable[str] = ()) -> dict:
    """Options of a YAML (or JSON) file. Files named under ``defaults`` fill the fields they are named for, below the file's own values;
    ``overrides`` (``a.b=value``) go over both. Relative names are relative to the file's folder."""
    read = lambda p: _yaml(spark.read.text(p, wholetext=True).first()["value"]) or {}
    own = read(path)
    folder = path.rpartition("/")[0]
    named = own.pop("defaults", None) or {}
    below = {k: read(p if p.startswith("/") or "://" in p else f"{folder}/{p}") for k, p in named.items()}
    return deep_merge(deep_merge(below, own), dotlist(overrides))


def ship_by_value(module_name: str = "corpusmill") -> None:
    """Let worker functions travel with the task, so that executors need no installed copy of the package."""
    module = sys.modules[module_name]
    if module_name not in cloudpickle.list_registry_pickle_by_value():
        cloudpickle.register_pickle_by_value(module)


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The parquet table ``name`` of a data directory."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints: the one the cluster names, or a temporary one where none is set (tests only)."""
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not named:
        named = tempfile.mkdtemp(prefix="corpusmill-checkpoint-")
        atexit.register(shutil.rmtree, named, True)
    context.setCheckpointDir(named)
    return context._jsc.sc().getCheckpointDir().get()


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back: survives the loss of executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores, where it comes in fewer partitions than there are cores (small files). Large tables stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def require_columns(df: DataFrame, columns: Iterable[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
