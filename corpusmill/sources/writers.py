"""Writers (K1-K11): shards, token files, manifests, side outputs, safe replacement."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators.stats import size_errors
from corpusmill.session import cut_lineage


def write_jsonl(df: DataFrame, path: str, rows_per_file: int = 50_000, mode: str = "errorifexists") -> None:
    """K4, K5: JSON lines in shards (``part-*.jsonl``) of a bounded number of rows; other letters than ASCII stay as they are."""
    df.write.mode(mode).option("maxRecordsPerFile", rows_per_file).option("ignoreNullFields", False).json(path)
    spark = df.sparkSession
    make = spark._jvm.org.apache.hadoop.fs.Path
    system = make(path).getFileSystem(spark._jsc.hadoopConfiguration())
    # Spark names such files json, which elsewhere stands for one value per file.
    for status in system.globStatus(make(f"{path}/part-*.json")) or []:
        system.rename(status.getPath(), make(status.getPath().toString() + "l"))


def write_split_tokens(df: DataFrame, path: str, tokens: str = "tokens", eos: int | None = None, mode: str = "errorifexists") -> None:
    """K1-K3: token arrays by stage and split, with an end token per document if given."""
    ids = F.concat(F.col(tokens), F.array(F.lit(eos))) if eos is not None else F.col(tokens)
    df.withColumn(tokens, ids).where(F.size(tokens) > 0).write.mode(mode).partitionBy("stage", "split").parquet(path)


def write_token_files(df: DataFrame, path: str, order: list[str], tokens: str = "tokens", dtype: str = "uint16", eos: int | None = None) -> DataFrame:
    """K1-K3: one binary file per task, in the order of the rows: file, n_docs, n_tokens, n_bytes. Ids beyond the dtype are an error.

    Files are numbered as the ranges of the order are, so the files one after the other are the ordered stream. With ``eos`` each
    document ends with it. ``path`` is an address that all workers reach (a mounted folder, hdfs, s3, gs). An attempt writes a file of its own and
    renames it when it is whole, so a repeated task replaces what it wrote.
    """
    import pandas as pd

    def write(batches):
        import numpy as np
        from pyarrow import fs
        from pyspark import TaskContext

        task = TaskContext.get()
        system, folder = fs.FileSystem.from_uri(re.sub(r"^(?:file:)?/+", "file:///", path))
        system.create_dir(folder, recursive=True)
        target, draft = f"{folder}/part-{task.partitionId():05d}.bin", f"{folder}/_part-{task.partitionId():05d}.{task.taskAttemptId()}.tmp"
        most, count, docs = np.iinfo(dtype).max, 0, 0
        with system.open_output_stream(draft) as handle:
            for batch in batches:
                for ids in batch[tokens]:
                    values = np.asarray(ids, dtype="int64")
                    values = np.append(values, eos) if eos is not None else values
                    if len(values) and (values.max() > most or values.min() < 0):
                        raise ValueError(f"token id outside {dtype}")
                    handle.write(values.astype(np.dtype(dtype).newbyteorder("<")).tobytes())
                    count, docs = count + len(values), docs + 1
        system.move(draft, target)
        yield pd.DataFrame({"file": [target], "n_docs": [docs], "n_tokens": [count], "n_bytes": [system.get_file_info(target).size]})

    return df.repartitionByRange(*order).sortWithinPartitions(*order).select(tokens).mapInPandas(write, "file string, n_docs long, n_tokens long, n_bytes long")


def encode_corpus(docs: DataFrame, path: str, order: list[str], eos: int, dtype: str = "uint16") -> DataFrame:
    """Token arrays of documents (dataset, stage, split, tokens) as ordered files per dataset, stage and split, with their manifest.

    Returns dataset, stage, split, file, n_docs, n_tokens, n_bytes; a file whose bytes are not tokens times item size is an error. The groups are
    listed by the driver: there is one per dataset, stage and split.
    """
    import numpy as np

    groups = docs.select("dataset", "stage", "split").distinct().orderBy("dataset", "stage", "split").collect()
    parts = []
    for g in groups:
        mine = docs.where(F.col("dataset").eqNullSafe(g["dataset"]) & (F.col("stage") == g["stage"]) & (F.col("split") == g["split"]))
        name = re.sub(r"[^\w.-]", "_", (g["dataset"] or "none").replace("/", "__"))
        written = write_token_files(mine.select(*order, "tokens"), f"{path}/{g['stage']}/{g['split']}/{name}", order, "tokens", dtype, eos)
        parts.append(written.select(F.lit(g["dataset"]).cast("string").alias("dataset"), F.lit(g["stage"]).alias("stage"), F.lit(g["split"]).alias("split"), "*"))
    if not parts:
        return docs.sparkSession.createDataFrame([], "dataset string, stage string, split string, file string, n_docs long, n_tokens long, n_bytes long")
    manifest = parts[0]
    for part in parts[1:]:
        manifest = manifest.unionByName(part)
    manifest = cut_lineage(manifest)
    if size_errors(manifest, np.dtype(dtype).itemsize).limit(1).count():
        raise ValueError("a token file is not as long as its tokens")
    return manifest


def write_manifest(path: str, counts: dict, **settings) -> None:
    """K6: counts and settings as one JSON file, through the session's file systems."""
    spark = SparkSession.getActiveSession()
    text = json.dumps({**settings, "counts": counts}, ensure_ascii=False, indent=2)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    stream = system.create(target, True)
    stream.write(bytearray(text.encode("utf-8")))
    stream.close()


def replace_table(df: DataFrame, path: str, before: int | None = None) -> bool:
    """K7: writes beside the table and swaps folders, and only if rows were removed. Folders are renamed by the session's file system.

    If the second rename fails the old table is put back. A store without renames (plain object stores) should get a table format instead.
    """
    if before is not None and df.count() == before:
        return False
    spark = df.sparkSession
    make = spark._jvm.org.apache.hadoop.fs.Path
    table, fresh, old = make(path), make(f"{path}.new"), make(f"{path}.old")
    system = table.getFileSystem(spark._jsc.hadoopConfiguration())
    df.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}.new")
    system.delete(old, True)
    system.rename(table, old)
    if not system.rename(fresh, table):
        system.rename(old, table)
        raise OSError(f"{path} could not be replaced")
    system.delete(old, True)
    return True


def rejects(decided: DataFrame, key: str = "question_id") -> DataFrame:
    """K8: reason and key of the rows that leak."""
    return decided.where(F.col("reason").rlike("^(near_)?leak:")).select("reason", key)


def write_results(results: DataFrame, summary: DataFrame, path: str) -> None:
    """K9: results and summaries by dataset."""
    results.write.mode("overwrite").partitionBy("dataset").json(f"{path}/results")
    summary.write.mode("overwrite").partitionBy("dataset").json(f"{path}/summary")


def append_history(row: DataFrame, path: str) -> None:
    """One row more in a history."""
    row.write.mode("append").json(path)


def skip_if_there(df: DataFrame, path: str) -> None:
    """T-7: writes unless the output is there already."""
    df.write.mode("ignore").parquet(path)
