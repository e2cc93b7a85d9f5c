"""SimHash near-dedup by a self-join of binary tries.

Texts with the same fingerprint are one class.  Two classes link when their
fingerprints differ in few bits.  The join walks pairs of trie nodes from the
root, adds up the bits in which their prefixes differ, and leaves a pair as soon
as the error budget is exceeded.

One trie cannot be dealt out: with errors allowed from the first bit, every
subtree meets nearly every other.  But of ``budget + 1`` blocks of bits, two
fingerprints within the budget agree in one at least.  So the walk runs over
``budget + 1`` tries, each with another block of bits moved to the front, and
starts below nodes that agree in that block.  Such a node is one key of the
shuffle; a node with too many fingerprints is cut into slices that are joined
pair by pair, so no task holds more than two slices.  A task returns the links
of a spanning forest, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.registry import query
from quern.llm.shared import forest, group_bounds, link_classes, read_table, stored, whole_groups

WORDS = 4
BUDGET = 4
SEED = 42
#: Fingerprints below one node before it is cut into slices.
SLICE = 4096
CELL = ["turn", "node", "a", "b"]


def fingerprint(text: str | None) -> int:
    """Signed 64 bits over the 4-word shingles of a whole text; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(words) > WORDS:
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[s:e], SEED) for s, e in zip(starts.tolist(), ends[WORDS - 1 :].tolist())]
    else:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    octets = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(octets), 4096):
        counts += np.unpackbits(octets[at : at + 4096], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(text: Column) -> Column:
    """The fingerprint of each whole text; a narrow step."""
    @F.pandas_udf("long")
    def measure(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t) for t in texts], dtype="int64")

    return measure(text)


def _blocks(budget: int) -> list[tuple[int, int]]:
    """(first bit, width) of ``budget + 1`` blocks that cover 64 bits."""
    cuts = [64 * k // (budget + 1) for k in range(budget + 2)]
    return [(lo, hi - lo) for lo, hi in zip(cuts, cuts[1:])]


def close_pairs(bits: np.ndarray, starts: list[tuple[int, int, int, int]], depth: int, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions i, j of all pairs within the budget between the given node pairs.

    ``bits`` (uint64) is ascending within each node; a node is a range of
    positions that share their first ``depth`` bits, and (lo, hi, lo, hi) joins
    a node with itself.
    """
    ones: dict[int, np.ndarray] = {}

    def split(lo: np.ndarray, hi: np.ndarray, d: int) -> np.ndarray:
        if d not in ones:
            ones[d] = np.concatenate([[0], np.cumsum((bits >> np.uint64(63 - d)) & np.uint64(1)).astype(np.int64)])
        return hi - (ones[d][hi] - ones[d][lo])

    todo = [(depth, np.array(starts, np.int64).reshape(-1, 4).T, np.zeros(len(starts), np.int64))]
    while todo:
        d, (alo, ahi, blo, bhi), errors = todo.pop()
        if len(errors) > 200_000:  # depth first over parts of the frontier
            half = len(errors) // 2
            nodes = np.array([alo, ahi, blo, bhi])
            todo += [(d, nodes[:, :half], errors[:half]), (d, nodes[:, half:], errors[half:])]
            continue
        small = ((ahi - alo) * (bhi - blo) <= 32) | (d >= 64)
        if small.any():
            yield from _verified(bits, alo[small], ahi[small], blo[small], bhi[small], budget)
            alo, ahi, blo, bhi, errors = alo[~small], ahi[~small], blo[~small], bhi[~small], errors[~small]
        if not len(errors):
            continue
        amid, bmid = split(alo, ahi, d), split(blo, bhi, d)
        crossed = alo != blo  # a node with itself has only one mixed pair of children
        below = [
            (alo, amid, blo, bmid, errors, np.ones(len(errors), bool)),
            (amid, ahi, bmid, bhi, errors, np.ones(len(errors), bool)),
            (alo, amid, bmid, bhi, errors + 1, np.ones(len(errors), bool)),
            (amid, ahi, blo, bmid, errors + 1, crossed),
        ]
        nodes, sums = [], []
        for w, x, y, z, e, real in below:
            keep = real & (w < x) & (y < z) & (e <= budget) & ((w != y) | (x - w > 1))
            nodes.append(np.array([w[keep], x[keep], y[keep], z[keep]]))
            sums.append(e[keep])
        sums = np.concatenate(sums)
        if len(sums):
            todo.append((d + 1, np.concatenate(nodes, axis=1), sums))


def _verified(bits, alo, ahi, blo, bhi, budget) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    wide = bhi - blo
    sizes = (ahi - alo) * wide
    for part in np.array_split(np.arange(len(sizes)), sizes.sum() // 1_000_000 + 1):
        if not len(part):
            continue
        n = sizes[part]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        w = np.repeat(wide[part], n)
        i, j = np.repeat(alo[part], n) + at // w, np.repeat(blo[part], n) + at % w
        near = (i < j) & (np.bitwise_count(bits[i] ^ bits[j]) <= budget)
        yield i[near], j[near]


def _join_cells(budget: int):
    shift = [lo for lo, _ in _blocks(budget)]
    depth = min(width for _, width in _blocks(budget))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_groups(frames, CELL, 50_000):
            bits = frame["bits"].to_numpy().astype(np.int64).view(np.uint64)
            at, a, b, side = group_bounds(frame, CELL), frame["a"].to_numpy(), frame["b"].to_numpy(), frame["side"].to_numpy()
            starts = []
            for lo, hi in zip(at.tolist(), at[1:].tolist()):
                if a[lo] == b[lo]:
                    if hi - lo > 1:
                        starts.append((lo, hi, lo, hi))
                else:
                    mid = lo + int((side[lo:hi] == a[lo]).sum())
                    if lo < mid < hi:
                        starts.append((lo, mid, mid, hi))
            i, j = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            held = 0
            for x, y in close_pairs(bits, starts, depth, budget):
                i.append(x)
                j.append(y)
                held += len(x)
                if held > 2_000_000:  # only what the links join is kept
                    root = forest(len(bits), np.concatenate(i), np.concatenate(j))
                    i, j = [np.arange(len(bits))], [root]
                    held = len(bits)
            root = forest(len(bits), np.concatenate(i), np.concatenate(j))
            linked = np.flatnonzero(root != np.arange(len(bits)))
            if len(linked):
                turn = np.array(shift, np.uint64)[frame["turn"].to_numpy()]
                back = np.where(turn == 0, bits, (bits >> turn) | (bits << ((np.uint64(64) - turn) % np.uint64(64)))).view(np.int64)
                yield pd.DataFrame({"u": back[linked], "v": back[root[linked]]})

    return run


def close_links(distinct: DataFrame, budget: int = BUDGET, slice_rows: int = SLICE) -> DataFrame:
    """Links (u, v) that join all distinct fingerprints ``fp`` within the budget, as spanning forests."""
    fp = F.col("fp")
    turned = []
    for k, (lo, width) in enumerate(_blocks(budget)):
        bits = F.shiftleft(fp, lo).bitwiseOR(F.shiftrightunsigned(fp, 64 - lo)) if lo else fp
        turned.append(F.struct(F.lit(k).alias("turn"), F.shiftrightunsigned(bits, 64 - width).alias("node"), bits.alias("bits")))
    cells = distinct.select(F.explode(F.array(*turned)).alias("c")).select("c.*")
    # At most (budget + 1) * 2^13 nodes with a count each, whatever the input.
    full = cells.groupBy("turn", "node").count().where(F.col("count") > slice_rows)
    full = full.select("turn", "node", F.ceil(F.col("count") / slice_rows).cast("int").alias("slices"))
    cut = cells.join(F.broadcast(full), ["turn", "node"], "left").withColumn("slices", F.coalesce("slices", F.lit(1)))
    cut = cut.withColumn("side", F.pmod(F.xxhash64("bits"), F.col("slices")).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    cut = cut.select("turn", "node", F.least("side", "other").alias("a"), F.greatest("side", "other").alias("b"), "side", "bits")
    dealt = cut.repartition(*CELL).sortWithinPartitions(*CELL, "side", "bits")
    return dealt.mapInPandas(_join_cells(budget), "u long, v long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = BUDGET) -> DataFrame:
    """Per row: id, fp (signed), component_id, the smallest id reachable over links.

    Null and empty texts have the fingerprint 0 and link like others.  Null ids
    never name a component while another id is in it; a component of nothing
    else gets null.  Repeated rows are rows of one class.  An empty table gives
    no rows; columns beside the two named are not read.
    """
    rows = stored(df.select(F.col(id_col).alias("id"), fingerprints(F.col(text_col)).alias("fp")), "fingerprints")
    classes = rows.groupBy("fp").agg(F.min("id").alias("least"))
    roots = link_classes(close_links(classes.select("fp"), budget)).select(F.col("node").alias("fp"), "root")
    rooted = classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(rooted.select("fp", "root").join(named, "root").select("fp", "component_id"), "fp").select("id", "fp", "component_id")


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, with all their columns: those whose id names their component.

    Rows that repeat an id share its fate; rows without an id stay.
    """
    found = near_duplicates(df, id_col, text_col)
    gone = found.where("id <> component_id").select(F.col("id").alias(id_col)).distinct()
    return df.join(gone, id_col, "left_anti").select(*[df[c] for c in df.columns])


@query("op1_trie_join")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
