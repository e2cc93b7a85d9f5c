"""Hard negatives by threshold joins over an inverted index with norm bounds.

Vectors of integers are searched for the highest inner products with given anchors,
all of them at or above a threshold.  The rows lie in blocks of one label.  In a
block every row has its components in the order of the dimensions' energy, and the
norms of what is left after each ``STEP`` of them, its suffix norms.

* The index of a block omits a row from the lists of all dimensions whose suffix norm
  times the anchors' own cannot reach the lowest threshold asked; rows that lie in no
  list are never touched.
* Partial scores accumulate list by list.  A pair leaves as soon as its partial score
  and the product of the two remaining norms stay below the threshold.
* What is left is completed with the omitted dimensions, so scores are exact.

Searches ask for high scores first.  As long as a window holds fewer rows than it
wants, its threshold is lowered and only it is asked again, until it is full or its
lower end is reached; so nothing is lost.  A block answers with its best few for each
window, and the best of those are the best of all.  Anchors travel in packs to the
blocks that may hold a partner; no table of all pairs is made.

Rows without a label, an id or a vector, or with a null or non-finite component, take
no part.  Shorter vectors count as padded with zeros.  Every row counts by itself:
with repeated ids, ``other rows`` are all but the anchor's own row, and each of them
has its partners.  Equal scores go by the smaller id.  Tables without rows give none.
Columns other than the three named do not matter.  Scores are exact below 2 ** 63;
a partner whose score does not fit in a long keeps its rank, but has no window.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.registry import query
from quern.llm.shared import numbered, read_table, stored
from quern.operators.running import top_per_key

#: Rows of a block, anchors of a pack, and dimensions between two prunings.
BLOCK, PACK, STEP = 2048, 256, 8
#: Fractions of an anchor's own score, or of a window's upper end, at which a search begins and goes on.
POSITIVE_STEPS, NEGATIVE_STEPS = (0.5, 0.25, 0.125), (0.9, 0.75)
_MOST = (1 << 63) - 1
#: From this product of two norms on, sums in 64 bits could run over.
_WIDE = 2.0**62
#: Pairs whose products are summed at once in integers of any size.
_PAIRS = 4096
#: Under this share of open pairs they are followed one by one.
_SPARSE = 0.1


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component in double precision, as long."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def usable(vector: Column) -> Column:
    """A vector whose components are all present and finite."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < math.inf))


def energy_order(rows: DataFrame) -> list[int]:
    """The dimensions, those with the most energy over all rows first."""
    energy = rows.select(F.posexplode("vec").alias("dim", "x")).groupBy("dim").agg(F.sum(F.col("x").cast("double") ** 2).alias("e")).collect()
    return [r.dim for r in sorted(energy, key=lambda r: (-r.e, r.dim))]


def packed(vec: Column, order: list[int]) -> Column:
    """The components in the order of the blocks as one binary value, little-endian 64-bit integers; zeros where they are missing."""

    @F.arrow_udf("binary")
    def pack(rows: pa.Array) -> pa.Array:
        return pa.array([ordered(r.values.to_numpy(zero_copy_only=False), order).tobytes() for r in rows], pa.binary())

    return pack(vec)


def ordered(vec: np.ndarray, order: list[int]) -> np.ndarray:
    padded = np.zeros(len(order), "<i8")
    padded[: len(vec)] = vec
    return padded[order]


def blocks_of(rows: DataFrame, order: list[int]) -> DataFrame:
    """``rows`` (uid, id, label, vec; uid gapless in the order of labels) in blocks: block, labels, uids, ids, row_labels, matrix, norm (the largest)."""

    def pack(table: pa.Table) -> pa.Table:
        # The rows of a group come in any order; labels are looked up as slices.
        table = table.sort_by("uid")
        matrix = np.stack([ordered(np.asarray(v, np.int64), order) for v in table.column("vec").to_pylist()])
        uids, ids, labels = (table.column(c).to_numpy().astype("<i8") for c in ("uid", "id", "label"))
        norm = float(np.sqrt((matrix.astype(np.float64) ** 2).sum(1)).max())
        return pa.table({
            "block": [int(uids[0]) // BLOCK], "labels": pa.array([np.unique(labels)], pa.list_(pa.int64())), "uids": [uids.tobytes()],
            "ids": [ids.tobytes()], "row_labels": [labels.tobytes()], "matrix": [matrix.tobytes()], "norm": [norm],
        })

    # One group is BLOCK rows, however many a label has.
    grouped = rows.withColumn("block", F.floor(F.col("uid") / BLOCK)).groupBy("block")
    return grouped.applyInArrow(pack, "block long, labels array<long>, uids binary, ids binary, row_labels binary, matrix binary, norm double")


class Index:
    """The lists of one block for one lowest threshold."""

    def __init__(self, matrix: np.ndarray, edges: list[int]):
        self.matrix, self.edges = matrix, edges
        self.suffix = suffix_norms(matrix, edges)

    def scores(self, anchors: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All pairs (anchor, row) that score at least the anchor's ``least``, with their scores."""
        rests = suffix_norms(anchors, self.edges)
        total = float(rests[:, 0].max(initial=0)) * float(self.suffix[:, 0].max(initial=0))
        kind = np.float64 if total < 2.0**52 else np.int64
        # Whole numbers this large are rounded where they meet a bound.
        slack = 0.0 if total < 2.0**52 else total * 2.0**-48
        rows, own = self.matrix.astype(kind), anchors.astype(kind)
        # Scores are whole numbers; a bound counts when it stays half below.
        floor = least.astype(np.float64) - 0.5
        lowest = floor.min()
        # Row i lies in the lists of the first `listed[i]` steps.
        reach = self.suffix[:, :-1] * rests[:, :-1].max(0, initial=0)
        listed = (reach * (1 + 1e-9) >= lowest).sum(1) if lowest > 0 else np.full(len(rows), len(self.edges) - 1)
        order = np.argsort(-listed, kind="stable")
        rows, norms, listed = rows[order], self.suffix[order], listed[order]
        open_i, open_j, part = None, None, np.zeros((len(own), int((listed > 0).sum()) if lowest > 0 else len(rows)), kind)
        wide = rests[:, 0][:, None] * norms[: part.shape[1], 0][None] >= _WIDE
        alive = ~wide
        for k, (a, b) in enumerate(zip(self.edges, self.edges[1:])):
            n = int((listed > k).sum())
            if open_i is None:
                part[:, :n] += own[:, a:b] @ rows[:n, a:b].T
                rest = rests[:, None, k + 1] * norms[None, : part.shape[1], k + 1]
                # Rows whose lists have ended keep their omitted dimensions in the bound.
                ended = np.minimum(listed[: part.shape[1]], k + 1)
                rest[:, n:] = rests[:, ended[n:]] * norms[np.arange(n, part.shape[1]), ended[n:]][None]
                alive &= part + rest * (1 + 1e-9) + slack >= floor[:, None]
                if alive.mean() < _SPARSE if alive.size else True:
                    open_i, open_j = np.nonzero(alive)
                    part = part[open_i, open_j]
            else:
                inside = open_j < n
                part[inside] += np.einsum("ij,ij->i", own[open_i[inside], a:b], rows[open_j[inside], a:b])
                ended = np.minimum(listed[open_j], k + 1)
                keep = part + rests[open_i, ended] * norms[open_j, ended] * (1 + 1e-9) + slack >= floor[open_i]
                open_i, open_j, part = open_i[keep], open_j[keep], part[keep]
        if open_i is None:
            open_i, open_j = np.nonzero(alive)
            part = part[open_i, open_j]
        # The omitted dimensions of what is left.
        for k, (a, b) in enumerate(zip(self.edges, self.edges[1:])):
            late = listed[open_j] <= k
            part[late] += np.einsum("ij,ij->i", own[open_i[late], a:b], rows[open_j[late], a:b])
        found = part.astype(np.int64)
        if wide.any():
            i, j = np.nonzero(wide)
            open_i, open_j, found = np.concatenate([open_i, i]), np.concatenate([open_j, j]), np.concatenate([found, wide_products(own, rows, i, j)])
        keep = found >= least[open_i]
        return open_i[keep], order[open_j[keep]], found[keep]


def wide_products(left: np.ndarray, right: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of the rows ``i`` and ``j`` without overflow; what does not fit in a long is its largest or smallest value."""
    out = [np.zeros(0, np.int64)]
    for at in range(0, len(i), _PAIRS):
        products = left[i[at : at + _PAIRS]].astype(object) * right[j[at : at + _PAIRS]].astype(object)
        out.append(np.array([max(-_MOST, min(_MOST, int(p))) for p in products.sum(1)], np.int64))
    return np.concatenate(out)


def suffix_norms(matrix: np.ndarray, edges: list[int]) -> np.ndarray:
    """For each row, the norm of its components from every edge on; 0 at the last."""
    squares = matrix.astype(np.float64) ** 2
    sums = np.stack([squares[:, a:b].sum(1) for a, b in zip(edges, edges[1:])], 1) if len(edges) > 1 else np.zeros((len(matrix), 0))
    after = np.concatenate([np.cumsum(sums[:, ::-1], 1)[:, ::-1], np.zeros((len(matrix), 1))], 1)
    return np.sqrt(after)


def _search(width: int, most: int, same: bool):
    """Packs of windows that have come to a block, to the block's best ``most`` rows for each window."""
    edges = [*range(0, width, STEP), width]
    numbers = lambda data: np.frombuffer(data, "<i8")

    def of_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, dict]]:
        """Each pack with its block, whose indexes are kept while packs of the same block follow."""
        block = {"block": None}
        for batch in batches:
            for k in range(batch.num_rows):
                if block["block"] != (at := batch.column("block")[k].as_py()):
                    row = {c: batch.column(c)[k].as_py() for c in ("uids", "ids", "row_labels", "matrix")}
                    block = {c: numbers(v) for c, v in row.items()} | {"block": at, "indexes": {}}
                    block["matrix"] = block["matrix"].reshape(len(block["uids"]), width)
                yield block, batch.column("windows")[k].as_py()

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, windows in of_block(batches):
            out = []
            # Rows lie in the order of their labels: the same label is a slice, the others are what is around it.
            for label in sorted({w["label"] for w in windows}) if same else [None]:
                first, last = (np.searchsorted(block["row_labels"], label, side) for side in ("left", "right")) if same else (0, len(block["ids"]))
                asked = [w for w in windows if not same or w["label"] == label]
                if first == last:
                    continue
                if label not in block["indexes"]:
                    block["indexes"][label] = Index(block["matrix"][first:last], edges)
                out += best_of(asked, block["indexes"][label], *(block[c][first:last] for c in ("uids", "ids", "row_labels")))
            columns = list(zip(*out)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["uid", "window", "other", "other_id", "score"])

    def best_of(asked: list[dict], index: Index, uids: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> list[tuple]:
        # Windows of one anchor share its vector and are searched together.
        anchors = {w["uid"]: w for w in asked}
        place = {uid: k for k, uid in enumerate(anchors)}
        least = np.full(len(place), _MOST, np.int64)
        for w in asked:
            least[place[w["uid"]]] = min(least[place[w["uid"]]], w["low"])
        i, j, score = index.scores(numbers(b"".join(w["vec"] for w in anchors.values())).reshape(len(place), width), least)
        if not same:
            apart = np.array([w["label"] for w in anchors.values()])[i] != labels[j]
            i, j, score = i[apart], j[apart], score[apart]
        order = np.lexsort((ids[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        bounds, out = np.searchsorted(i, np.arange(len(place) + 1)), []
        for w in asked:
            start, end = bounds[place[w["uid"]]], bounds[place[w["uid"]] + 1]
            down = -score[start:end]  # rising
            first, last = np.searchsorted(down, -w["high"]), np.searchsorted(down, -w["low"], "right")
            # One more than wanted, as the anchor's own row may be among them.
            hits = [h for h in range(start + first, start + min(last, first + most + 1)) if uids[j[h]] != w["uid"]][:most]
            out += [(w["uid"], w["window"], int(uids[j[h]]), int(ids[j[h]]), int(score[h])) for h in hits]
        return out

    return answer


def best_partners(windows: DataFrame, blocks: DataFrame, width: int, most: int, same: bool, steps: tuple[float, ...]) -> DataFrame:
    """For each of ``windows`` the first ``most`` rows of the same label, or of other ones, that score within it.

    ``windows`` has uid, window, label, vec (packed, in the blocks' order), norm,
    top, high and least: the first threshold is ``steps[0] * top``, the next
    ``steps[1] * top`` and so on, the last ``least``; none is below ``least``.
    Returns uid, window, other, other_id, score, rank.
    """
    spark, found, open_ = windows.sparkSession, None, windows
    keys = ["uid", "window"]
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    n_blocks = blocks.count()
    if not n_blocks:
        steps = ()
    packs_of = F.floor(F.approx_count_distinct("uid") / PACK) + 1
    n_packs = windows.agg(packs_of).first()[0]
    here = blocks.repartition(parts, "block")
    for fraction in [*steps, None]:
        low = F.col("least") if fraction is None else F.greatest(F.col("least"), F.ceil(F.col("top") * fraction).cast("long"))
        asked = open_.withColumn("low", low).withColumn("pack", F.pmod(F.xxhash64("uid"), F.lit(n_packs)))
        packs = asked.groupBy("pack", *(["label"] if same else [])).agg(
            F.collect_list(F.struct("uid", "window", "label", "vec", "low", "high")).alias("windows"),
            F.min("low").alias("lowest"), F.max("norm").alias("own_norm"),
        )
        if same:  # to the blocks that hold the label
            places = blocks.select("block", F.explode("labels").alias("label"))
            sent = packs.join(places, "label")
        else:  # a stated set of anchors against all blocks
            sent = packs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)).cast("array<long>")))
        met = sent.select("block", "windows", "lowest", "own_norm").repartition(parts, "block").join(here, "block")
        # Not where the longest row of the block stays below the lowest threshold of the pack.
        met = met.where(F.col("own_norm") * F.col("norm") * (1 + 1e-9) >= F.col("lowest").cast("double") - 1)
        hits = met.select("block", "windows", "uids", "ids", "row_labels", "matrix").mapInArrow(
            _search(width, most, same), "uid long, window long, other long, other_id long, score long"
        )
        ranked = stored(top_per_key(hits, keys, [F.desc("score"), F.col("other_id"), F.col("other")], most), "partners")
        full = ranked.groupBy(*keys).agg(F.count("*").alias("have"))
        state = open_.withColumn("low", low).join(full, keys, "left")
        done = (F.coalesce("have", F.lit(0)) >= most) | (F.col("low") <= F.col("least"))
        settled = ranked.join(state.where(done).select(*keys), keys)
        found = settled if found is None else found.union(settled)
        if fraction is None:
            return found
        open_ = stored(state.where(~done).select(*windows.columns), "windows")
        if open_.isEmpty():
            return found


def hard_negatives(
    vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3, share: tuple[int, int] = (50, 95),
    id_col: str = "vec_id", label_col: str = "label", vec_col: str = "vec",
) -> DataFrame:
    """For each anchor and each of its positives the hardest rows of other labels.

    ``vectors`` has integer components; ``anchor`` says which rows are anchors.
    Positives are the first ``positives`` other rows of the anchor's label;
    negatives score from ``share[0]`` to ``share[1]`` per cent of the positive.
    Returns anchor_id, positive_id, rank, negative_id, positive_score, negative_score.
    """
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vec_col).isNotNull())
    rows = rows.select(
        F.lit(0).alias("tree"), F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"),
        F.col(vec_col).cast("array<long>").alias("vec"), anchor.alias("anchor"),
    )
    rows = stored(numbered(rows, "tree", ["label", "id"]).withColumnRenamed("idx", "uid"), "vectors")
    order = energy_order(rows)
    blocks = stored(blocks_of(rows, order), "blocks")
    own = F.aggregate("vec", F.lit(0).cast("double"), lambda a, x: a + x.cast("double") * x)
    anchors = rows.where("anchor").select("uid", "id", "label", packed(F.col("vec"), order).alias("vec"), F.sqrt(own).alias("norm"), own.alias("top"))
    anchors = stored(anchors, "anchors")
    asked = anchors.select("uid", F.lit(1).cast("long").alias("window"), "label", "vec", "norm", "top", F.lit(_MOST).alias("high"), F.lit(-_MOST).alias("least"))
    near = best_partners(asked, blocks, len(order), positives, True, POSITIVE_STEPS)
    near = stored(near.select("uid", F.col("rank").cast("long").alias("window"), F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    low, high = share
    p = F.col("positive_score")
    asked = near.join(anchors, "uid").select(
        "uid", "window", "label", "vec", "norm", "positive_score",
        # Of scores from 0 on, down and up to whole numbers.
        F.expr(f"CAST(positive_score AS decimal(20,0)) * {high} div 100").alias("high"),
        F.expr(f"(CAST(positive_score AS decimal(20,0)) * {low} + 99) div 100").alias("least"),
    )
    asked = stored(asked.where((p >= 0) & (p < _MOST) & (F.col("least") <= F.col("high"))).withColumn("top", F.col("high").cast("double")).drop("positive_score"), "windows")
    hard = best_partners(asked, blocks, len(order), negatives, False, NEGATIVE_STEPS)
    named = hard.join(near, ["uid", "window"]).join(anchors.select("uid", F.col("id").alias("anchor_id")), "uid")
    return named.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


CHECK = """
WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
    FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
met AS (
    SELECT a.vec_id AS a, o.vec_id AS o, a.label = o.label AS same, CAST(list_dot_product(a.e, o.e) AS BIGINT) AS score
    FROM v a JOIN v o ON a.vec_id % 50 = 0 AND a.vec_id <> o.vec_id),
positives AS (SELECT a, o, score FROM met WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, o) <= 5)
SELECT p.a AS anchor_id, p.o AS positive_id, CAST(row_number() OVER (PARTITION BY p.a, p.o ORDER BY n.score DESC, n.o) AS INTEGER) AS rank,
    n.o AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN met n ON n.a = p.a AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
QUALIFY row_number() OVER (PARTITION BY p.a, p.o ORDER BY n.score DESC, n.o) <= 3
"""


@query("op12_threshold_join", CHECK)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth vector, one label in seven moved on."""
    rows = read_table(spark, sf_dir, "embeddings").where(usable(F.col("embedding")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = rows.select("vec_id", label.alias("label"), quantised(F.col("embedding")).alias("vec"))
    return hard_negatives(rows, F.col("vec_id") % 50 == 0)
