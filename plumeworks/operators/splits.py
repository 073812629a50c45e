"""Exact disjoint splits: the k-th smallest hash is found by histograms, without a sort of all keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hexadecimal digits of a histogram's bucket, and keys of a bucket that are put in order on the driver.
DIGITS, FEW = 3, 4096
#: Digits of a hash.
LENGTH = 32


def split_hash(key: Column, seed: int) -> Column:
    return F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")).cast("binary"))


def kth_hash(hashes: DataFrame, k: int) -> str:
    """The k-th smallest of the distinct strings `h`, from 1.

    Each pass counts the next DIGITS digits of those that share the prefix found so far, 16 ** DIGITS
    numbers at most, and walks to the bucket that holds the k-th; a pass leaves one of thousands.
    """
    prefix, rest, size = "", k, None
    while len(prefix) < LENGTH and (size is None or size > FEW):
        at = len(prefix)
        inside = hashes.where(F.col("h").startswith(prefix)) if prefix else hashes
        counts = inside.groupBy(F.substring("h", at + 1, DIGITS).alias("d")).agg(F.count("*").alias("n")).collect()
        for d, n in sorted(map(tuple, counts)):
            if rest <= n:
                prefix, size = prefix + d, n
                break
            rest -= n
        else:
            raise ValueError(f"there are fewer than {k} hashes")
    return hashes.where(F.col("h").startswith(prefix)).orderBy("h").limit(rest).agg(F.max("h")).first()[0]


def part_size(n: int, share: float) -> int:
    """round(share * n), halves to even, and one at least."""
    return max(1, round(n * share))


def split_disjoint(rows: DataFrame, key: str, share: float = 0.2, seed: int = 7) -> DataFrame:
    """Rows with `validation` and `training`: of n keys the part_size(n, share) of least hash are for validation.

    All rows of a key are in one part. A single key is in both, so that none is empty; rows without a
    key are for training and don't count. The result is a filter on each row's own hash: neither rows
    nor keys are joined or sorted.
    """
    h = split_hash(F.col(key), seed)
    # kept for the passes; what a lost executor held is made again
    hashes = rows.where(F.col(key).isNotNull()).select(h.alias("h")).distinct().persist()
    n = hashes.count()
    last = kth_hash(hashes, part_size(n, share)) if n else ""
    hashes.unpersist()
    validation = F.coalesce(h <= F.lit(last), F.lit(False))
    return rows.withColumns({"validation": validation, "training": ~validation | F.lit(n == 1)})
