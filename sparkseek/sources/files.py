"""Report files (SRC-10, SRC-11, SRC-17) and the binary dictionary (SRC-8)."""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame, SparkSession


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, sep="\t", header=True)


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True, inferSchema=True)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def pack_dictionary(entries: dict[str, int]) -> bytes:
    """Count, then for each key in order: its length, the key, its number."""
    out = [struct.pack("<I", len(entries))] if entries else []
    for key, i in sorted(entries.items()):
        raw = key.encode()
        out.append(struct.pack("<I", len(raw)) + raw + struct.pack("<I", i))
    return b"".join(out)


def unpack_dictionary(data: bytes) -> dict[str, int]:
    """The reverse; no bytes are an empty dictionary, cut-off bytes an error."""
    if not data:
        return {}
    try:
        (n,), at, out = struct.unpack_from("<I", data), 4, {}
        for _ in range(n):
            (size,) = struct.unpack_from("<I", data, at)
            key = data[at + 4 : at + 4 + size]
            (i,) = struct.unpack_from("<I", data, at + 4 + size)
            out[key.decode()] = i
            at += 8 + size
    except (struct.error, UnicodeDecodeError) as e:
        raise ValueError("dictionary is damaged") from e
    if at != len(data):
        raise ValueError("dictionary is damaged")
    return out
