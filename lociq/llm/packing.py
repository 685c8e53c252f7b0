"""Conflict-constrained best-fit packing of documents into training sequences.

A document is as long as its count of words; one longer than a bin is cut into
full pieces, each a bin of its own, and a rest.  Two pieces in a bin must not
share a source or a duplicate cluster.  Bins are kept ordered by the room they
have left and carry bitmaps of the sources and clusters they hold; the search
starts at the tightest bin that is large enough and goes on to its successors
until a compatible one is found, else a bin is opened.  Longest come first.

Documents are dealt into shards by a hash of all that is known of them, so that a
hot source, cluster or id is spread over all of them and a shard's size is bounded
on average; bins do not span shards.  Equal rows are counted before the shuffle
and dealt by their number, so even they spread.  Only (id, source, cluster,
length) is shuffled.

Null or blank text has length 0 and takes no bin: it is left out.  A null
source or cluster conflicts with nothing.  Ties in length go to the smaller
doc_id; repeated rows are packed each.  Null ids are packed like others.  An
empty table gives an empty result; extra columns are left out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lociq.llm._common import table

SHARD_DOCS, COPIES = 8192, 4096
OUT = "doc_id long, piece int, shard int, bin int, start int, length int, bin_used int"


def n_words(text: Column) -> Column:
    """Words are runs of anything but ASCII white space."""
    return F.length(F.regexp_replace(F.regexp_replace(text, r"[^\x20\x09-\x0D]+", "w"), r"[\x20\x09-\x0D]+", ""))


class Bins:
    """Open bins, ordered by room left (ties: older first), with bitmaps of sources and clusters."""

    def __init__(self, capacity: int, sources: int, clusters: int):
        self.capacity, self.n = capacity, 0
        self.room = np.empty(64, np.int64)
        self.order = np.empty(64, np.int64)
        self.held = [np.zeros((64, (k + 63) // 64), np.uint64) for k in (sources, clusters)]

    def _grow(self) -> None:
        if self.n == len(self.room):
            self.room, self.order = np.resize(self.room, 2 * self.n), np.resize(self.order, 2 * self.n)
            self.held = [np.vstack([h, np.zeros_like(h)]) for h in self.held]

    def place(self, size: int, bits: tuple[int, int]) -> tuple[int, int]:
        """Number of the bin that takes a piece, and where in it the piece starts; a bit below 0 conflicts with nothing."""
        at, step = int(np.searchsorted(self.room[: self.n], size)), 32
        found = -1
        while found < 0 and at < self.n:
            bins = self.order[at : min(at + step, self.n)]
            taken = np.zeros(len(bins), bool)
            for h, bit in zip(self.held, bits, strict=True):
                if bit >= 0:
                    taken |= (h[bins, bit >> 6] >> np.uint64(bit & 63)) & np.uint64(1) == 1
            free = np.flatnonzero(~taken)
            if len(free):
                found = at + int(free[0])
            at, step = at + step, step * 4
        if found < 0:
            self._grow()
            number, left, found = self.n, self.capacity, self.n
            self.n += 1
        else:
            number, left = int(self.order[found]), int(self.room[found])
        for h, bit in zip(self.held, bits, strict=True):
            if bit >= 0:
                h[number, bit >> 6] |= np.uint64(1 << (bit & 63))
        new = left - size
        to = int(np.searchsorted(self.room[:found], new, side="right"))
        to = min(to, found)
        self.room[to + 1 : found + 1], self.order[to + 1 : found + 1] = self.room[to:found].copy(), self.order[to:found].copy()
        self.room[to], self.order[to] = new, number
        return number, self.capacity - left


def _codes(values: pd.Series) -> np.ndarray:
    """Dense bit of each value; -1 for null and for values that occur once, which can't conflict."""
    many = values.map(values.value_counts()) > 1
    return pd.factorize(values.where(many))[0]


def pack_shard(rows: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Best-fit decreasing over (doc_id, source, cluster, length, shard)."""
    rows = rows.sort_values(["length", "doc_id"], ascending=[False, True], kind="stable", na_position="last")
    sources, clusters = _codes(rows["source"]), _codes(rows["cluster"])
    out, full = [], []
    for d, n, s, c in zip(rows["doc_id"], rows["length"], sources, clusters, strict=True):
        pieces = int(n) // capacity
        full += [(d, p, capacity) for p in range(pieces)]
        if int(n) % capacity:
            out.append((d, pieces, int(n) % capacity, int(s), int(c)))
    out.sort(key=lambda x: -x[2])
    bins = Bins(capacity, int(sources.max(initial=-1)) + 1, int(clusters.max(initial=-1)) + 1)
    placed = [(d, p, *bins.place(n, (s, c)), n) for d, p, n, s, c in out]
    placed += [(d, p, bins.n + i, 0, n) for i, (d, p, n) in enumerate(full)]
    made = pd.DataFrame(placed, columns=["doc_id", "piece", "bin", "start", "length"])
    made["shard"] = rows["shard"].iloc[0]
    made["bin_used"] = made.groupby("bin")["length"].transform("sum")
    return made[["doc_id", "piece", "shard", "bin", "start", "length", "bin_used"]].astype({"doc_id": "Int64"})


def pack(docs: DataFrame, capacity: int = 2048, shard_docs: int = SHARD_DOCS, cluster: Column | None = None) -> DataFrame:
    """One row per piece: its shard and bin, and its place there.  cluster defaults to exact copies of the text."""
    cluster = F.md5(F.col("text").cast("binary")) if cluster is None else cluster
    rows = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string").alias("source"), cluster.cast("string").alias("cluster"), n_words(F.col("text")).alias("length"))
    n = max(1, -(-docs.count() // shard_docs))
    facts = ["doc_id", "source", "cluster", "length"]
    equal = rows.where("length > 0").groupBy(*facts).agg((F.count("*") - 1).alias("last"))
    # every copy's number, in two steps, so that no array of all of them is made
    high = equal.select(*facts, "last", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("last") / COPIES).cast("long"))).alias("high"))
    copies = high.select(*facts, F.explode(F.sequence(F.col("high") * COPIES, F.least(F.col("last"), F.col("high") * COPIES + (COPIES - 1)))).alias("copy"))
    shard = F.pmod(F.xxhash64(*facts, "copy"), F.lit(n)).cast("int")
    return copies.select(*facts, shard.alias("shard")).groupBy("shard").applyInPandas(lambda p: pack_shard(p, capacity), OUT)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


QUERIES = {"op1_best_fit_packing": op1_best_fit_packing}
SQL: dict[str, str] = {}
