"""Document keys, hash buckets and the splits made of them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The groups of fields that identify a document, then the single fields.
KEY_GROUPS = (("max_stars_repo_name", "max_stars_repo_path"), ("repo_name", "path"), ("url",), ("id",), ("blob_id",), ("content_id",))
KEY_FIELDS = ("max_stars_repo_name", "max_stars_repo_path", "repo_name", "path", "url", "id", "blob_id", "content_id")


def document_key(columns: list[str], source: Column, row: Column) -> Column:
    """P5: the first group whose fields are all filled, else the first filled field, else source and row number."""
    def filled(name: str) -> Column:
        return F.nullif(F.col(name).cast("string"), F.lit(""))

    options = []
    for group in KEY_GROUPS:
        if all(name in columns for name in group):
            # concat is null as soon as one of its parts is: a group that is only partly filled falls through
            options.append(F.concat(*[part for k, name in enumerate(group) for part in (F.lit(("|" if k else "") + name + "="), filled(name))]))
    options += [F.concat(F.lit(name + "="), filled(name)) for name in KEY_FIELDS if name in columns]
    return F.coalesce(*options, F.concat(F.lit("src="), source, F.lit("|row="), row.cast("string")))


def sha_bucket(key: Column, salt: str) -> Column:
    """The first 32 bits of SHA-256 of salt, line break and key, as a number in [0, 1)."""
    digits = F.substring(F.sha2(F.concat(F.lit(salt + "\n"), key), 256), 1, 8)
    return F.conv(digits, 16, 10).cast("double") / float(1 << 32)


def blake_bucket(salt: str):
    """Vectorised UDF: the same with 64 bits of BLAKE2b, which Spark does not have."""

    def bucket(keys: pd.Series) -> pd.Series:
        import hashlib

        def one(key: str) -> float:
            digest = hashlib.blake2b(f"{salt}\n{key}".encode(), digest_size=8).digest()
            return int.from_bytes(digest, "big") / float(1 << 64)

        return pd.Series([None if k is None else one(k) for k in keys], dtype="float64")

    return F.pandas_udf(bucket, T.DoubleType())


def split_of(bucket: Column, ratio: float) -> Column:
    """``val`` below the ratio, which lies in [0, 1)."""
    if not 0 <= ratio < 1:
        raise ValueError("ratio must lie in [0, 1)")
    return F.when(bucket < ratio, "val").otherwise("train")


def rank_shard(index: Column, world: int) -> Column:
    """The worker that reads a row."""
    return F.pmod(index, F.lit(world))


def contiguous_shard(index: Column, rows: Column, shards: int) -> Column:
    """The shard whose range [i*n/k, (i+1)*n/k) holds the row."""
    return F.floor(((index + 1) * shards - 1) / rows)
