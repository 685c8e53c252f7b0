"""Protein-to-genome alignments: suppression of overlapping ones, stop and frameshift facts.

Alignments: aln_id (file order), marker, contig, start, end, score, and where
needed protein, cigar and identity.
"""

from __future__ import annotations

from heapq import heapify, heappop, heapreplace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lociq.functions.scalars import cleaned_protein, frameshifts, internal_stops
from lociq.operators.intervals import BIN, islands

#: Share of the longer alignment that must be shared.
SHARED = 0.80


#: Neighbours of places that are held at a time.
HELD = 1 << 20


def _suppressed(g: pd.DataFrame) -> pd.DataFrame:
    """aln_id of the rows of one island that the sequential rule removes.

    Rows of one place (start and end) have the same neighbours, so a turn goes
    through the rows left of the places near its own, merged by their order, and
    ends at the first that scores higher; all before it are removed, each once.
    """
    g = g.sort_values("aln_id", kind="stable")
    ids, start, end, score = (g[c].to_numpy() for c in ("aln_id", "start", "end", "score"))
    n = len(g)
    order = np.lexsort((np.arange(n), end, start))
    new = np.ones(n, bool)
    new[1:] = (np.diff(start[order]) != 0) | (np.diff(end[order]) != 0)
    head = np.flatnonzero(new)  # the first row left of each place, as a position in order; -1 if none is
    low, high = start[order][head], end[order][head]
    size, reach = high - low, (high - low).max()
    before, after = np.arange(n) - 1, np.arange(n) + 1  # the rows left beside a row in its place
    before[head], after[head[1:] - 1], after[-1] = -1, -1, -1
    place = np.empty(n, np.int64)
    place[order] = np.cumsum(new) - 1
    gone, near, held = np.zeros(n, bool), {}, 0

    def neighbours(p: int) -> np.ndarray:
        q = np.arange(np.searchsorted(low, low[p] - reach), np.searchsorted(low, high[p]))
        inside = ((low[q] >= low[p]) & (low[q] < high[p])) | ((high[q] > low[p]) & (high[q] <= high[p]))
        shared = np.minimum(high[q], high[p]) - np.maximum(low[q], low[p]) > SHARED * np.maximum(size[q], size[p])
        return q[inside & shared & (low[q] > 0)]

    def remove(x: int) -> None:
        j, b, a = order[x], before[x], after[x]
        gone[j] = True
        if b < 0:
            head[place[j]] = a
        else:
            after[b] = a
        if a >= 0:
            before[a] = b

    at = np.empty(n, np.int64)
    at[order] = np.arange(n)
    for i in range(n):
        if gone[i]:
            continue
        p = int(place[i])
        if p not in near:
            if held > HELD:
                near, held = {}, 0
            near[p] = neighbours(p)
            held += len(near[p])
        x = head[near[p]]
        x = x[x >= 0]
        left = list(zip(order[x].tolist(), x.tolist()))
        heapify(left)
        mine, least = ids[i], score[i]
        while left:
            j, x = left[0]
            if ids[j] != mine:
                if score[j] > least:
                    remove(at[i])
                    break
                remove(x)
            a = int(after[x])
            if a >= 0:
                heapreplace(left, (int(order[a]), a))
            else:
                heappop(left)
    return pd.DataFrame({"aln_id": ids[gone]})


def suppress_overlapping(alignments: DataFrame) -> DataFrame:
    """Alignments left after going through the pairs in file order: of two the lower score goes, j on a tie; what is gone removes nothing.

    A pair (i, j) is of one contig and marker; j starts or ends inside i,
    shares more than 80 % of the longer and does not start at 0.  The pairs of
    an island are never made: their number grows with the square of its depth.
    """
    held = alignments.select("aln_id", "contig", "marker", "start", "end", "score").where("aln_id is not null and contig is not null and marker is not null and start is not null and end is not null")
    groups = islands(held, ["contig", "marker"], "start", "end", "island", width=BIN).groupBy("contig", "marker", "island")
    removed = groups.applyInPandas(_suppressed, T.StructType([alignments.schema["aln_id"]]))
    return alignments.join(removed, "aln_id", "left_anti")


def with_facts(alignments: DataFrame) -> DataFrame:
    """Adds internal stops, the protein without stops, and frameshift events and length."""
    out = alignments.withColumns({"stops": internal_stops(F.col("protein")), "_f": frameshifts(F.col("cigar"))})
    return out.withColumns({"protein": cleaned_protein(F.col("protein")), "frameshift_events": F.col("_f.events"), "frameshift_length": F.col("_f.length")}).drop("_f")


def genes_per_marker(alignments: DataFrame) -> DataFrame:
    return alignments.groupBy("marker").agg(F.array_sort(F.collect_set("gene")).alias("genes"))
