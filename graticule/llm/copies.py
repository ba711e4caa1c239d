"""Duplicates hidden by formatting differences (problem 4).

Rows become canonical hashes of 128 bits. Every map task builds Bloom filters of the hashes that it has seen once and
repeatedly; the filters are merged piece by piece (the bits that two partitions share join the repeated filter), so that
the merged "repeated" filter holds every hash that stands in more than one row. Only rows that hit it, true repeats and
the filter's few false positives, are shuffled and grouped exactly; all others are singletons and never move.

A filter has ``BITS_PER_ROW`` bits for each row, so about one singleton in 400 passes, however many rows there are. One
filter has at most ``MAX_BITS`` (32 MB); beyond that the hashes are taken in ranges, each with a filter of its own that is
built, probed and dropped before the next. A pass reads the kept hashes (24 bytes a row) and nothing else, so the number of
passes, rows / 16 million, costs reading, while shuffle, memory and broadcast stay those of one range. Pieces travel
compressed and mostly empty ones shrink to little. A group that holds a third of all rows is split by a salt: its minimum and its count are combined in
partial aggregates, and its rows meet the group's row once per salt.

Defined cases: a null key and a null value are values of their own, unlike the empty text; a null map is an empty one;
names that become equal are kept as a set of (name, value) pairs; repeated rows are copies; ties don't exist as ids are
unique; empty tables give no rows; further columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from graticule.session import checkpointed

MIN_BITS, MAX_BITS = 1 << 20, 1 << 28
#: Bits per row of the input that the filter aims at, and bits set per hash.
BITS_PER_ROW, PROBES = 16, 4
#: The filter is merged in pieces of this many bytes.
PIECE = 1 << 16
SALTS = 64
#: Texts made of these characters only are composed already.
COMPOSED = r"^[\x00-\x{02FF}\x{2002}-\x{2125}]*$"


@F.pandas_udf(StringType())
def _compose(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def canonical_hashes(df: DataFrame, row: str, key: str, cols: str) -> DataFrame:
    """(row, _a, _b): two independent 64-bit hashes of a row's canonical form."""
    pairs = F.map_entries(F.coalesce(F.col(cols), F.create_map().cast("map<string,string>")))
    # one text per row holds all parts, so that the rare characters of any part are composed in one call
    mark = "\u0001"
    part = lambda c: F.coalesce(F.regexp_replace(c, "[\u0001\u0002\u0003]", " "), F.lit("\u0003"))
    text = F.concat(part(F.col(key)), F.array_join(F.transform(pairs, lambda e: F.concat(F.lit(mark), part(e["key"]), F.lit("\u0002"), part(e["value"]))), ""))
    rows = df.select(F.col(row).alias(row), text.alias("_t"))
    rare = ~F.col("_t").rlike(COMPOSED)
    rows = rows.withColumn("_t", F.when(rare, _compose(F.when(rare, F.col("_t")))).otherwise(F.col("_t")))
    folded = F.regexp_replace(F.lower(F.upper("_t")), r"[^\p{L}\p{N}\p{M}\x01\x02\x03]+", " ")
    folded = F.regexp_replace(folded, r" ?([\x01\x02]) ?|^ | $", "$1")
    parts = F.split(folded, mark)
    form = F.concat_ws(mark, parts[0], F.array_join(F.array_sort(F.array_distinct(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))))), mark))
    return rows.select(row, form.alias("_f")).select(row, F.xxhash64("_f").alias("_a"), F.xxhash64(F.lit(1), "_f", F.lit(2)).alias("_b"))


def _bits(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    """PROBES bit positions of each hash, all in one piece."""
    a, b = a.view(np.uint64), b.view(np.uint64) | np.uint64(1)
    size = min(bits, PIECE * 8)
    base = (a >> np.uint64(20)) % np.uint64(bits // size) * np.uint64(size)
    return np.stack([base + ((a + np.uint64(i) * b) >> np.uint64(7)) % np.uint64(size) for i in range(PROBES)])


class _Filter:
    def __init__(self, bits: int):
        self.bits, self.words = bits, np.zeros(bits // 8, np.uint8)

    def add(self, at: np.ndarray) -> None:
        np.bitwise_or.at(self.words, at >> np.uint64(3), np.left_shift(np.uint8(1), (at & np.uint64(7)).astype(np.uint8)))

    def has(self, at: np.ndarray) -> np.ndarray:
        hit = (self.words[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1
        return hit.all(axis=0)


def filter_pieces(hashes: DataFrame, bits: int) -> DataFrame:
    """(piece, once, repeated): of every map task, the non-empty pieces of its two filters."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, repeated = _Filter(bits), _Filter(bits)
        for batch in batches:
            a, b = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            pairs, n = np.unique(np.stack([a, b]), axis=1, return_counts=True)
            at = _bits(np.ascontiguousarray(pairs[0]), np.ascontiguousarray(pairs[1]), bits)
            again = once.has(at) | (n > 1)
            repeated.add(at[:, again].ravel())
            once.add(at.ravel())
        step = min(PIECE, bits // 8)
        for i in range(bits // 8 // step):
            o, r = once.words[i * step : (i + 1) * step], repeated.words[i * step : (i + 1) * step]
            if o.any():
                yield pa.RecordBatch.from_pydict({"piece": pa.array([i], pa.int32()), "once": pa.array([o.tobytes()], pa.binary()), "repeated": pa.array([r.tobytes() if r.any() else None], pa.binary())})

    return hashes.select("_a", "_b").mapInArrow(build, "piece int, once binary, repeated binary")


def merge_pieces(pieces: DataFrame) -> DataFrame:
    """(piece, repeated): a bit is repeated if a task says so or two tasks have seen it. One small group per piece."""

    def merge(key: tuple[Any, ...], frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        once = repeated = None
        for f in frames:
            for o, r in zip(f["once"], f["repeated"]):
                o = np.frombuffer(o, np.uint8)
                once, repeated = (np.zeros_like(o), np.zeros_like(o)) if once is None else (once, repeated)
                repeated |= once & o
                once |= o
                if r is not None:
                    repeated |= np.frombuffer(r, np.uint8)
        if repeated is not None and repeated.any():
            yield pd.DataFrame({"piece": [key[0]], "repeated": [repeated.tobytes()]})

    return pieces.groupBy("piece").applyInPandas(merge, "piece int, repeated binary")


def possible_repeats(hashes: DataFrame, bits: int) -> DataFrame:
    """The rows whose hash is in the merged filter of repeated hashes."""
    step = min(PIECE, bits // 8)
    merged = np.zeros(bits // 8, np.uint8)
    for r in merge_pieces(filter_pieces(hashes, bits)).toLocalIterator():  # at most bits / 8 bytes in all
        merged[r[0] * step : (r[0] + 1) * step] = np.frombuffer(r[1], np.uint8)
    shared = hashes.sparkSession.sparkContext.broadcast(merged.tobytes())

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = _Filter(8)
        f.words = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            a, b = (batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in ("_a", "_b"))
            yield batch.filter(pa.array(f.has(_bits(a, b, bits)).astype(bool)))

    return hashes.mapInArrow(probe, hashes.schema)


def filter_plan(rows: int, most: int | None = None) -> tuple[int, int]:
    """(ranges, bits): how many ranges of hashes there are, and the size of each one's filter."""
    most = most or MAX_BITS
    ranges = 1
    while rows * BITS_PER_ROW > ranges * most:
        ranges *= 2
    bits = min(MIN_BITS, most)
    while bits < min(most, rows * BITS_PER_ROW // ranges):
        bits *= 2
    return ranges, bits


def repeats(hashes: DataFrame, ranges: int, bits: int) -> DataFrame:
    """The rows whose hash may stand in more than one row, range by range."""
    if ranges == 1:
        return possible_repeats(hashes, bits)
    out = None
    for r in range(ranges):
        # bits of the second hash choose the range; the filter's positions come from others
        own = hashes.filter(F.pmod(F.shiftrightunsigned("_b", 40), F.lit(ranges)) == r)
        some = checkpointed(possible_repeats(own, bits))  # ends the use of the range's filter
        out = some if out is None else out.unionAll(some)
    return out


def copies(df: DataFrame, row: str = "row_id", key: str = "primary_key", cols: str = "cols", most: int | None = None, salts: int = SALTS) -> DataFrame:
    """(keep_id, dup_id, copies): for every record that stands there more than once, its other rows and its number of rows."""
    # 24 bytes a row, read by the filters, the probes and the salted groups
    hashes = checkpointed(canonical_hashes(df, row, key, cols))
    some = repeats(hashes, *filter_plan(hashes.count(), most)).withColumn("_s", F.pmod(F.xxhash64(row), F.lit(salts)).cast("int"))
    salted = some.groupBy("_a", "_b", "_s").agg(F.min(row).alias("_min"), F.count("*").alias("_n"))
    groups = salted.groupBy("_a", "_b").agg(F.min("_min").alias("keep_id"), F.sum("_n").alias("copies"), F.collect_list("_s").alias("_ss")).filter("copies > 1")
    spread = groups.select("_a", "_b", "keep_id", "copies", F.explode("_ss").alias("_s"))
    return some.join(spread, ["_a", "_b", "_s"]).filter(F.col(row) != F.col("keep_id")).select("keep_id", F.col(row).alias("dup_id"), "copies")


def collapsed(df: DataFrame, row: str = "row_id", key: str = "primary_key", cols: str = "cols") -> DataFrame:
    """One row per record, that of its smallest id, with the number of its copies; singletons included."""
    found = copies(df, row, key, cols)
    counts = found.groupBy("keep_id").agg(F.first("copies").alias("copies"))
    kept = df.join(found.select(F.col("dup_id").alias(row)), row, "left_anti")
    return kept.join(counts.withColumnRenamed("keep_id", row), row, "left").withColumn("copies", F.coalesce("copies", F.lit(1).cast("bigint")))
