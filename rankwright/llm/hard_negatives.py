"""Hard negatives: rows of other labels that are nearly as similar to an anchor as its positives.

Scores are inner products. An anchor's positives are its ``positives`` best other rows of the same label; for each
positive, the best ``negatives`` rows of other labels are returned whose score is between ``low`` and ``high`` per cent of the positive's.

The search is a GNAT-style hyperplane tree. One more component lifts all rows onto a sphere around 0 (an anchor has 0 there), so that a score is
a distance and a window of scores an annulus around the anchor. Each node has several split points, a row goes to the nearest
(ties: the first), and every split point stores the range of its distances to the rows of each sibling subtree. A subtree
goes where the annulus, moved by the distance of anchor and split point, misses one of its ranges. The tree's split
points come from a sample of ``sample_rows`` rows (those of the smallest hashes); every row is indexed and the ranges are over
all rows. The sample also bounds what an anchor can do without: its fifth best score of the label, its third best in a window.
Leaves are searched exactly; one over ``most_rows`` is dealt into parts, and the anchors that reach a part come in blocks,
so that no task holds more than a part and a block.

Rows with a null id, label or vector, or a null or non-finite component, take no part. Vectors of unlike length count as filled up with
zeros. Of rows that share an id the one with the smallest label, then vector, takes part. Scores of 2 ** 53 and over are computed
with whole numbers of any size, those that fit no long are cut to its ends. An anchor without another row of its label gives no row. Ties go to
the smaller id. An empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankwright.llm.common import session, table, written

#: Slack of distances in parts of the radius: squares are off by some 1e-15 parts, so distances, near 0, by 1e-7 at most.
SLACK = 1e-6


@dataclass(frozen=True)
class Mining:
    """``low`` and ``high`` in per cent of the positive's score; the others bound the tree, its sample and a task's share.

    Leaves are as large as parts: where rows of many dimensions leave the ranges nothing to exclude, every anchor reaches every
    leaf, and its best of each are sent on.
    """

    positives: int = 5
    negatives: int = 3
    low: int = 50
    high: int = 95
    fanout: int = 8
    leaf_rows: int = 4096
    most_leaves: int = 1024
    sample_rows: int = 4096
    most_rows: int = 4096


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers, as longs."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if top < 2.0**53:
        return (a @ b.T).astype(np.int64)
    whole = lambda x: np.array([[int(v) for v in row] for row in x], object).reshape(x.shape)
    ends = np.iinfo(np.int64)
    return np.clip(whole(a) @ whole(b).T, ends.min, ends.max).astype(np.int64)


def _matrix(column, width: int | None = None) -> np.ndarray:
    """Rows of a list column, filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    width = int(sizes.max(initial=0)) if width is None else width
    values = column.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == width).all():
        return values.reshape(len(sizes), width).astype(np.float64)
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = values
    return out


def rows_of(df: DataFrame, vec_id: str, label: str, vector: str, adjust: Column | None = None, scale: int = 256) -> DataFrame:
    """(id, label, v) of the rows that take part, one for each id; components are floor(scale * x)."""
    # the floor as a double, which no long limits
    floor = lambda y: F.rint(y) - (F.rint(y) > y).cast("double")
    v = F.transform(F.col(vector), lambda x: floor(x.cast("double") * scale))
    finite = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    good = df.where(F.col(vec_id).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull()).where(finite)
    rows = good.select(F.col(vec_id).cast("long").alias("id"), (F.col(label) if adjust is None else adjust).cast("long").alias("label"), v.alias("v"))
    if rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return rows
    return rows.groupBy("id").agg(F.min(F.struct("label", "v")).alias("x")).select("id", "x.*")


class Tree:
    """Split points of nested nodes; every child that is not split further is a leaf.

    ``points[k]`` holds the split points of node k, lifted; ``child[k][j]`` is the node below its j-th, or -1 - leaf.
    ``low[k][i, j]``, ``high[k][i, j]``: the distances of its i-th point to all rows of its j-th subtree.
    """

    def __init__(self, sample: np.ndarray, radius2: float, leaves: int, fanout: int):
        self.radius2, self.points, self.child, self.leaves = radius2, [], [], 1
        lifted = self.lift(sample)
        self.root = self._split(lifted, np.arange(len(lifted)), leaves, fanout) if leaves > 1 else -1
        if self.root < 0:
            self.points, self.child, self.leaves = [], [], 1
        self.low = [np.full((len(p), len(p)), np.inf) for p in self.points]
        self.high = [np.full((len(p), len(p)), -np.inf) for p in self.points]

    def lift(self, x: np.ndarray) -> np.ndarray:
        """``x`` with the component that brings its length to the radius."""
        rest = np.sqrt(np.maximum(self.radius2 - np.einsum("ij,ij->i", x, x), 0.0))
        return np.concatenate([x, rest[:, None]], axis=1)

    def _split(self, lifted: np.ndarray, rows: np.ndarray, leaves: int, fanout: int) -> int:
        """The number of a node over ``rows`` of the sample with about ``leaves`` leaves; -1 if they are all equal."""
        # split points far from each other: each next one is farthest from those before
        chosen, gap = [rows[0]], ((lifted[rows] - lifted[rows[0]]) ** 2).sum(axis=1)
        while len(chosen) < min(fanout, leaves) and gap.max() > 0:
            chosen.append(rows[int(gap.argmax())])
            gap = np.minimum(gap, ((lifted[rows] - lifted[chosen[-1]]) ** 2).sum(axis=1))
        if len(chosen) < 2:
            return -1
        at = len(self.points)
        self.points.append(lifted[chosen])
        self.child.append([])
        near = distances(lifted[rows], self.points[at]).argmin(axis=1)
        for j in range(len(chosen)):
            mine = rows[near == j]
            share = round(leaves * len(mine) / len(rows))
            below = self._split(lifted, mine, share, fanout) if share > 1 and len(mine) > 1 else -1
            if below < 0:
                below = -self.leaves
                self.leaves += 1
            self.child[at].append(below)
        return at

    def walk(self, x: np.ndarray):
        """(node, rows, distances to its points, index of the nearest) of every node that rows of ``x`` reach, and each row's leaf."""
        lifted, steps, leaf = self.lift(x), [], np.zeros(len(x), np.int64)
        todo = [(self.root, np.arange(len(x)))] if self.points else []
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            far = distances(lifted[rows], self.points[node])
            near = far.argmin(axis=1)
            steps.append((node, rows, far, near))
            for j, below in enumerate(self.child[node]):
                mine = rows[near == j]
                if below < 0:
                    leaf[mine] = -below
                else:
                    todo.append((below, mine))
        return steps, leaf

    def reached(self, x: np.ndarray, inner: np.ndarray, outer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row of x, leaf) that may hold rows at distances from ``inner`` to ``outer`` of each row (one annulus or more each)."""
        asking, out = np.concatenate([x, np.zeros((len(x), 1))], axis=1), []
        if not self.points:
            return np.arange(len(x)), np.zeros(len(x), np.int64)
        todo = [(self.root, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            far = distances(asking[rows], self.points[node])[:, None, :]
            # of each annulus, the distances from each split point that it can have
            least = np.maximum(np.maximum(far - outer[rows][:, :, None], inner[rows][:, :, None] - far), 0.0)
            most = far + outer[rows][:, :, None]
            open_ = (outer[rows] >= inner[rows])[:, :, None]
            meets = (least[..., None] <= self.high[node]) & (most[..., None] >= self.low[node])
            hit = (meets.all(axis=2) & open_).any(axis=1)
            for j, below in enumerate(self.child[node]):
                mine = rows[hit[:, j]]
                if not len(mine):
                    continue
                if below < 0:
                    out.append((mine, np.full(len(mine), -below)))
                else:
                    todo.append((below, mine))
        if not out:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*out))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows, from differences, so that equal rows are at 0."""
    out = np.empty((len(a), len(b)))
    for j, p in enumerate(b):
        gap = a - p
        out[:, j] = np.sqrt(np.einsum("ij,ij->i", gap, gap))
    return out


@dataclass
class Index:
    """A fitted tree, its sample, and ``rows`` (id, label, v, leaf, part) dealt into ``parts`` (leaf, n_parts)."""

    tree: Tree
    sample: tuple[np.ndarray, np.ndarray, np.ndarray]
    rows: DataFrame
    parts: DataFrame
    n: int
    width: int


def build(rows: DataFrame, how: Mining) -> Index:
    """Index all of ``rows`` (id, label, v), a written table."""
    spark = rows.sparkSession
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    facts = rows.agg(F.count("*").alias("n"), F.max(square).alias("radius2"), F.max(F.size("v")).alias("width")).first()
    n, width = facts.n, facts.width or 0
    held = rows.orderBy(F.xxhash64("id"), "id").limit(how.sample_rows).toArrow()
    sample = (held["id"].to_numpy(), held["label"].to_numpy(), _matrix(held["v"], width))
    tree = Tree(sample[2], facts.radius2 or 0.0, min(how.most_leaves, n // how.leaf_rows), how.fanout)
    shared = spark.sparkContext.broadcast(tree)

    def place(batches):
        for batch in batches:
            leaf = shared.value.walk(_matrix(batch.column(2), width))[1]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(leaf)], ["id", "label", "v", "leaf"])

    def ranges(batches):
        found = {}
        for batch in batches:
            for node, _, far, near in shared.value.walk(_matrix(batch.column(0), width))[0]:
                for j in np.unique(near):
                    some = far[near == j]
                    for i, (a, b) in enumerate(zip(some.min(axis=0), some.max(axis=0))):
                        x, y = found.get((node, i, j), (np.inf, -np.inf))
                        found[node, i, j] = (min(x, a), max(y, b))
        if found:
            keys, values = zip(*found.items())
            yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in keys], pa.int64()) for i in range(3)] + [pa.array([v[i] for v in values], pa.float64()) for i in range(2)], ["node", "i", "j", "low", "high"])

    placed = written(rows.mapInArrow(place, "id long, label long, v array<double>, leaf long"), "placed")
    if tree.points:
        # a row per pair of split points of a node: bounded by the tree
        for r in rows.select("v").mapInArrow(ranges, "node long, i long, j long, low double, high double").groupBy("node", "i", "j").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect():
            tree.low[r.node][r.i, r.j], tree.high[r.node][r.i, r.j] = r.low, r.high
    parts = written(placed.groupBy("leaf").agg(F.ceil(F.count("*") / how.most_rows).cast("int").alias("n_parts")), "parts")
    dealt = placed.join(F.broadcast(parts), "leaf").select("id", "label", "v", "leaf", F.pmod(F.xxhash64("id"), F.col("n_parts")).cast("int").alias("part"))
    return Index(tree, sample, dealt, parts, n, width)


def annuli(tree: Tree, x: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distances of ``x``, not lifted, from lifted rows of the scores ``high`` and ``low``; an outer one of -1 where there are none."""
    square = np.einsum("ij,ij->i", x, x)[:, None] + tree.radius2
    far = lambda s: np.sqrt(np.maximum(square - 2 * s, 0.0))
    slack = SLACK * (1 + tree.radius2**0.5)
    return np.maximum(far(high) - slack, 0.0), np.where(low > high, -1.0, far(low) + slack)


def _best(scores: np.ndarray, ids: np.ndarray, ok: np.ndarray, k: int) -> np.ndarray:
    """Indexes of the ``k`` best of one anchor: by score, then id."""
    at = np.flatnonzero(ok)
    if len(at) > k:
        least = np.partition(scores[at], len(at) - k)[len(at) - k]
        at = at[scores[at] >= least]
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def _windows(scores: np.ndarray, how: Mining, positive) -> np.ndarray:
    """Which scores are in the window of a positive's score, by whole numbers."""
    p = int(positive)
    # low * p <= 100 * s <= high * p
    least, most = -((-how.low * p) // 100), (how.high * p) // 100
    return (scores >= least) & (scores <= most)


def search(anchors: DataFrame, index: Index, how: Mining, negatives: bool) -> DataFrame:
    """(anchor_id, positive_id, positive_score, other_id, score): for each of ``anchors`` (id, label, v, found) the best rows
    of each leaf that can matter. Without ``negatives`` they are of the anchor's label; with them, of other labels, for each positive in ``found``."""
    spark = anchors.sparkSession
    shared = spark.sparkContext.broadcast((index.tree, index.sample))
    width = index.width
    block = how.most_rows

    def bounds(x, id_, label, found, ids, labels, vs):
        """Lowest and highest scores of one row's windows that can still matter."""
        scores = product(x[None, :], vs)[0]
        if not negatives:
            mine = scores[(labels == label) & (ids != id_)]
            least = np.partition(mine, len(mine) - how.positives)[len(mine) - how.positives] if len(mine) >= how.positives else np.iinfo(np.int64).min
            return [(least, np.iinfo(np.int64).max)]
        out = []
        for _, p in found:
            inside = scores[(labels != label) & _windows(scores, how, p)]
            k = how.negatives
            least = -((-how.low * p) // 100)
            out.append((np.partition(inside, len(inside) - k)[len(inside) - k] if len(inside) >= k else least, (how.high * p) // 100))
        return out

    def route(batches):
        tree, (ids, labels, vs) = shared.value
        for batch in batches:
            x = _matrix(batch.column(2), width)
            found = [[(f["positive_id"], f["score"]) for f in fs or []] for fs in batch.column(3).to_pylist()]
            spans = [bounds(x[i], id_, label, found[i], ids, labels, vs) for i, (id_, label) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))]
            most = max(map(len, spans), default=0)
            if not most:
                continue
            low = np.array([[s[j][0] if j < len(s) else 1 for j in range(most)] for s in spans], np.float64)
            high = np.array([[s[j][1] if j < len(s) else 0 for j in range(most)] for s in spans], np.float64)
            row, leaf = tree.reached(x, *annuli(tree, x, low, high))
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(pa.array(row)) for i in range(4)), pa.array(leaf)], ["id", "label", "v", "found", "leaf"])

    schema = "id long, label long, v array<double>, found array<struct<positive_id:long,score:long>>"
    routed = anchors.select("id", "label", "v", "found").mapInArrow(route, f"{schema}, leaf long").join(F.broadcast(index.parts), "leaf")
    n_blocks = F.lit(max(1, -(-anchors.count() // block)))
    asked = routed.select("id", "label", "v", "found", "leaf", F.explode(F.sequence(F.lit(0), F.col("n_parts") - 1)).alias("part"), F.pmod(F.xxhash64("id"), n_blocks).cast("int").alias("block"))
    held = index.rows.select("id", "label", "v", "leaf", "part", F.explode(F.sequence(F.lit(0), n_blocks - 1)).alias("block"))

    def exact(rows: pa.Table, asking: pa.Table) -> pa.Table:
        out = []
        if rows.num_rows and asking.num_rows:
            ids, labels = rows["id"].to_numpy(), rows["label"].to_numpy()
            scores = product(_matrix(asking["v"], width), _matrix(rows["v"], width))
            for s, id_, label, found in zip(scores, asking["id"].to_pylist(), asking["label"].to_pylist(), asking["found"].to_pylist()):
                if not negatives:
                    out += [(id_, None, None, int(ids[i]), int(s[i])) for i in _best(s, ids, (labels == label) & (ids != id_), how.positives)]
                for f in found or []:
                    ok = (labels != label) & _windows(s, how, f["score"])
                    out += [(id_, f["positive_id"], f["score"], int(ids[i]), int(s[i])) for i in _best(s, ids, ok, how.negatives)]
        names = ["anchor_id", "positive_id", "positive_score", "other_id", "score"]
        return pa.table([pa.array([r[k] for r in out], pa.int64()) for k in range(5)], names)

    keys = ("leaf", "part", "block")
    return held.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(exact, "anchor_id long, positive_id long, positive_score long, other_id long, score long")


def mine(rows: DataFrame, anchor: Column, how: Mining = Mining()) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score); ``rows`` is (id, label, v) of ``rows_of``, ``anchor`` a condition on its id."""
    rows = written(rows, "vectors")
    index = build(rows, how)
    none = F.lit(None).cast("array<struct<positive_id:long,score:long>>")
    anchors = rows.where(anchor).select("id", "label", "v", none.alias("found"))
    best = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "other_id")
    positives = search(anchors, index, how, False).withColumn("at", F.row_number().over(best)).where(F.col("at") <= how.positives)
    found = positives.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct(F.col("other_id").alias("positive_id"), "score"))).alias("found"))
    asking = written(rows.where(anchor).join(found, F.col("id") == F.col("anchor_id")).select("id", "label", "v", "found"), "anchors")
    each = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("score"), "other_id")
    ranked = search(asking, index, how, True).withColumn("rank", F.row_number().over(each)).where(F.col("rank") <= how.negatives)
    return ranked.select("anchor_id", "positive_id", "rank", F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every row whose id is divisible by 50; labels of ids divisible by 7 are moved on by one."""
    df = table(session(spark), sf_dir, "embeddings").select("vec_id", "label", "embedding")
    moved = F.when(F.pmod("vec_id", F.lit(7)) == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    return mine(rows_of(df, "vec_id", "label", "embedding", moved), F.pmod("id", F.lit(50)) == 0)


SQL_OP13 = r"""
WITH vectors AS MATERIALIZED (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS MATERIALIZED (
  SELECT a.id AS anchor_id, b.id AS other_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM vectors a JOIN vectors b ON a.id % 50 = 0 AND a.id <> b.id),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)::INTEGER AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) <= 3
"""
