"""Byte-balanced shards by histogram sort.

The sort key is (XXH64 of the text, row number), so equal texts are neighbours and stay in one shard unless a shard border has to fall
inside their group. Probes for the borders are refined by exact byte counts over all partitions (parlance.llm.splitters) until each border is
within tolerance, then one exchange moves every row to its place. The ranges of that exchange are finer than shards: row-count quantiles are
found in the same passes, so a shard is sorted by many tasks, and since the rows below each range are known exactly, slots need no second
exchange.

docs is read twice and must give the same partitions each time, as a table's scan does.

Size: UTF-8 bytes of the text (null: none) plus ROW_BYTES. Null, empty and very long texts are rows like others; repeated rows take slots of
their own. An empty table gives an empty result. Extra columns are carried when asked for.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import arrow_map, materialise, signed, utf8
from parlance.llm.splitters import Search, find

SHARDS, ROW_BYTES = 40, 16
#: Columns that the operator adds; a carried column of such a name gets as many "_doc" behind it as make it unique.
OWN = ("size", "text_crc32", "shard", "slot")
#: How far a border may be from its exact place, as a part of a shard's bytes.
TOLERANCE = 0.002
#: Rows of one range of the exchange at most, up to ranges of equal rows for each shuffle partition.
RANGE_ROWS = 1_000_000


def _measured(docs: DataFrame, text_col: str) -> DataFrame:
    """docs with _k (text hash), _u (row number), _w (bytes) and _crc; all else is carried."""
    names = docs.columns
    at = names.index(text_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = utf8(batch.column(at))
        k = signed(np.fromiter(map(xxhash.xxh64_intdigest, texts), np.uint64, len(texts)))
        w = np.fromiter(map(len, texts), np.int64, len(texts)) + ROW_BYTES
        crc = np.fromiter(map(zlib.crc32, texts), np.int64, len(texts))
        return pa.record_batch([*batch.columns, pa.array(k), pa.array(w), pa.array(crc)], [*batch.schema.names, "_k", "_w", "_crc"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return arrow_map(docs.withColumn("_u", F.monotonically_increasing_id()), run, f"{fields}, _u bigint, _k bigint, _w bigint, _crc bigint")


def shards(docs: DataFrame, n_shards: int = SHARDS, text_col: str = "text", carry: list[str] | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """carry (default: all columns of docs), then size, text_crc32, shard and slot of every row."""
    spark = docs.sparkSession
    carry = docs.columns if carry is None else carry
    own = [f"c{i}" for i in range(len(carry))]
    inner = docs.select(*[F.col(c).alias(o) for c, o in zip(carry, own)], F.col(text_col).alias("_text"))
    measured = _measured(inner, "_text")
    narrow = materialise(measured.select("_k", "_u", "_w", "_crc"), "shard-keys")
    rows = measured.drop("_text")  # carried columns are read again for the exchange, not stored
    keys = narrow.select(F.lit(0).alias("g"), F.col("_k").alias("k"), F.col("_u").alias("u"), F.col("_w").alias("w"))
    weight, n, last = (int(x or 0) for x in keys.agg(F.sum("w"), F.count("*"), F.max("u")).first())
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // RANGE_ROWS))
    by_bytes = [Search(0, weight * i / n_shards, tolerance=tolerance * weight / n_shards, top_u=last + 1) for i in range(1, n_shards)]
    by_rows = [Search(0, n * i / ranges, by_rows=True, tolerance=0.05 * n / ranges, top_u=last + 1) for i in range(1, ranges)]
    find(keys, by_bytes + by_rows, {0: (weight, n)})
    starts = sorted({(0, 0): 0} | {s.at: s.below[1] for s in by_bytes + by_rows}) if n else [(0, 0)]
    known = {(0, 0): 0} | {s.at: s.below[1] for s in by_bytes + by_rows}
    rows_below = [known[x] for x in starts]
    borders = sorted(s.at for s in by_bytes)
    shard_of = [bisect_left(borders, (x[0], x[1] + 1)) for x in starts]
    first = [rows_below[shard_of.index(s)] for s in shard_of]
    offset = np.array([a - b for a, b in zip(rows_below, first)], np.int64)
    shard_of = np.array(shard_of, np.int32)
    top = np.array([min(x[0], (1 << 64) - 1) for x in starts], np.uint64)
    ties = np.array([x[1] for x in starts], np.uint64)
    last_k = any(x[0] >= 1 << 64 for x in starts)
    if last_k:  # ranges that begin behind every key stay empty
        keep = [i for i, x in enumerate(starts) if x[0] < 1 << 64]
        top, ties, offset, shard_of = top[keep], ties[keep], offset[keep], shard_of[keep]

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        k = batch.column(batch.schema.get_field_index("_k")).to_numpy(zero_copy_only=False).view(np.uint64)
        u = batch.column(batch.schema.get_field_index("_u")).to_numpy(zero_copy_only=False).view(np.uint64)
        at = np.searchsorted(top, k, side="right") - 1
        while (early := (top[at] == k) & (ties[at] > u)).any():  # several ranges may begin within one text
            at = at - early
        return pa.record_batch([*batch.columns, pa.array(at.astype(np.int32))], [*batch.schema.names, "_range"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    placed = arrow_map(rows, place, f"{fields}, _range int")
    moved = placed.repartitionById(len(top), F.col("_range")).sortWithinPartitions("_range", F.col("_k").bitwiseXOR(F.lit(-(1 << 63))), "_u")
    n_own = len(own)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = -1, 0
        for b in batches:
            r = b.column(b.schema.get_field_index("_range")).to_numpy(zero_copy_only=False)
            begins = np.flatnonzero(np.r_[True, r[1:] != r[:-1]]) if len(r) else np.zeros(0, np.int64)
            if not len(r):
                continue
            run = np.arange(len(r)) - np.repeat(begins, np.diff(np.r_[begins, len(r)]))
            if r[0] == last:
                run[: begins[1] if len(begins) > 1 else len(r)] += seen
            last, seen = int(r[-1]), int(run[-1]) + 1
            names = b.schema.names
            yield pa.record_batch(
                [*b.columns[:n_own], b.column(names.index("_w")), b.column(names.index("_crc")), pa.array(shard_of[r]), pa.array(offset[r] + run)],
                [*own, "_w", "_crc", "_shard", "_slot"],
            )

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:n_own])
    out = moved.mapInArrow(number, f"{kinds + ', ' if own else ''}_w bigint, _crc bigint, _shard int, _slot bigint")
    return out.toDF(*_renamed(carry), *OWN)


def _renamed(carry: list[str]) -> list[str]:
    """Names of the carried columns beside OWN, unlike each other in any case."""
    taken, out = {c.lower() for c in (*OWN, *(x for x in carry if x.lower() not in OWN))}, []
    for c in carry:
        if c.lower() in OWN:
            while c.lower() in taken:
                c += "_doc"
            taken.add(c.lower())
        out.append(c)
    return out


def shard_documents(docs: DataFrame, n_shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every document."""
    return shards(docs, n_shards, carry=["doc_id"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
