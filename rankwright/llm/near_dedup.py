"""Near-duplicates by an LSH forest of MinHash signatures, confirmed on full shingle sets.

Documents with equal sets form a class, represented by its smallest id. Each class has a signature
of MinHash values; each tree of the forest sorts the classes by a rotation of the signature. Classes
that share the first value of a tree are a region; a region of over a quarter of ``most_rows`` goes one value
deeper, again and again, so that the depth adapts to how dense it is. Candidates are the
neighbours in the sorted order, those with the longest common prefixes, and in dense regions also
its hub, the class that agrees most with the region's commonest values, and the best of a few spread over it. Candidates whose
signatures are too far apart for the threshold are left; the others are confirmed on the full sets:
first each class's best candidate, then each component's best to another one, then all that are still between components.
After each of these, components are contracted, so that links count by component and not by pair. Neighbours and
hubs are bounded in number, so regions that still hold several components are then searched for
every candidate across components; pairs within a component are left out, as they can change nothing.
A pair is searched in the first tree in which it shares a region, and in no other. Many candidates of a block, as
texts of one template give, are confirmed together: products of 0/1 matrices count what their full sets have in common.
A region that is over that size at the deepest level gets its first candidates in parts of about it;
the search across components takes it whole: over ``most_rows``, every part with every part, each two in a block of their own.

Words are lower-cased (A-Z); a set holds the distinct runs of ``words`` words, or the whole text
as one run if it has fewer words. Null text and text without words has an empty set, is linked with
nothing and is its own component. Rows of distinct id and text are documents of their own, equal rows are one; rows
without id come after all others, and a component of such rows only has the id null. Ties (equal similarity) are
settled by the smaller id. An empty table gives an empty table. Sets hold 64-bit hashes of the runs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest, xxh3_128_digest

from rankwright.llm.common import bitmap, discard, in_bitmap, row_ids, session, shuffle_partitions, table, text_bytes, written
from rankwright.llm.components import merged

_C = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Forest:
    """Linked: 100 * intersection >= percent * union. Neighbours and pivots bound the first candidates
    of one class in one tree; ``across`` finds what they miss. A region of over a quarter of ``most_rows`` goes deeper;
    a block has up to about ``most_rows``, in which a set counts once, and once more for every ``set_values`` shingles,
    so that a block's sets are bounded in bytes."""

    words: int = 5
    percent: int = 80
    trees: int = 16
    values: int = 64
    most_rows: int = 4000
    deepest: int = 4
    neighbours: int = 3
    pivots: int = 16
    least_agreeing: float = 0.6
    set_values: int = 2000


def shingles(raw: bytes, k: int) -> np.ndarray:
    """The sorted distinct hashes of runs of ``k`` words."""
    words = raw.lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, n)
    run = min(k, n)
    mixed = np.full(n - run + 1, run, np.uint64)
    for j in range(run):
        mixed = (mixed ^ (mixed >> np.uint64(31))) * _C + h[j : n - run + 1 + j]
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return np.unique(mixed ^ (mixed >> np.uint64(32)))


def _factors(n: int) -> np.ndarray:
    return np.random.default_rng(7).integers(1 << 40, 1 << 62, n, np.uint64) * np.uint64(2) + np.uint64(1)


def signature(found: np.ndarray, factors: np.ndarray) -> bytes:
    """The upper half of each minimum, big-endian, so that bytes sort as values do."""
    low = np.full(len(factors), np.uint64(0xFFFFFFFFFFFFFFFF))
    for a in range(0, len(found), 4096):
        low = np.minimum(low, (found[a : a + 4096, None] * factors[None, :]).min(axis=0))
    return (low >> np.uint64(32)).astype(">u4").tobytes()


def sign(docs: DataFrame, how: Forest, text: str = "text", doc: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, key, sig) of every row; key identifies the set, both are null if it is empty."""

    def run(batches):
        factors = _factors(how.values)
        for batch in batches:
            sizes, keys, sigs = [], [], []
            for x in batch.column(1):
                found = shingles(x.as_py() or b"", how.words)
                sizes.append(len(found))
                keys.append(xxh3_128_digest(found.tobytes()) if len(found) else None)
                sigs.append(signature(found, factors) if len(found) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())], ["doc_id", "n_shingles", "key", "sig"])

    return docs.select(F.col(doc).cast("long").alias("doc_id"), text_bytes(text)).mapInArrow(run, "doc_id long, n_shingles long, key binary, sig binary")


def regions(classes: DataFrame, how: Forest) -> DataFrame:
    """(whole, region, tree, rep, weight) of classes that share a region with another; ``region`` is the part of
    the whole region that is searched for first candidates. ``classes`` has rep, n_shingles and sig."""
    step = how.values // how.trees
    start = F.col("tree") * (4 * step)
    turned = F.concat(F.substring("sig", start + 1, F.lit(4 * how.deepest)), F.substring("sig", F.lit(1), F.lit(4 * how.deepest)))
    weight = (1 + F.col("n_shingles") / how.set_values).cast("int").alias("weight")
    rows = classes.select("rep", weight, F.explode(F.sequence(F.lit(0), F.lit(how.trees - 1))).alias("tree"), "sig").select("rep", "weight", "tree", F.substring(turned, 1, 4 * how.deepest).alias("prefix"))
    most = max(1, how.most_rows // 4)
    out, depth = None, 1
    while True:
        keyed = rows.withColumn("head", F.substring("prefix", 1, 4 * depth))
        # written, so that a join with a large region can be split
        counts = written(keyed.groupBy("tree", "head").agg(F.count("*").alias("size")).where("size > 1"), "heads")
        last = depth == how.deepest
        sized = written(keyed.join(counts, ["tree", "head"]).select("rep", "weight", "tree", "prefix", "head", "size"), "regions")
        discard(counts)
        # beyond the deepest level the first candidates are sought in parts, other ones in each tree
        part = F.when(F.col("size") > most, F.pmod(F.xxhash64("rep", "tree"), F.ceil(F.col("size") / most))).otherwise(0)
        done = sized if last else sized.where(F.col("size") <= most)
        done = done.select(F.xxhash64("tree", "head").alias("whole"), F.xxhash64("tree", "head", part).alias("region"), "tree", "rep", "weight")
        out = done if out is None else out.union(done)
        if last or sized.where(F.col("size") > most).isEmpty():
            return out
        rows, depth = sized.where(F.col("size") > most).select("rep", "weight", "tree", "prefix"), depth + 1


def _near(sigs: np.ndarray, reps: np.ndarray, how: Forest) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Candidates of one region, its rows in sorted order: (rep, rep, values that agree)."""
    n, out = len(reps), []
    least = how.least_agreeing * how.values

    def add(i, j):
        agree = (sigs[i] == sigs[j]).sum(axis=1)
        ok = (agree >= least) & (reps[i] != reps[j])
        out.append((np.minimum(reps[i], reps[j])[ok], np.maximum(reps[i], reps[j])[ok], agree[ok]))

    for d in range(1, min(how.neighbours, n - 1) + 1):
        add(np.arange(n - d), np.arange(d, n))
    if n > how.neighbours + 1:
        # hubs agree most with the commonest value of each place
        votes = np.zeros(n, np.int64)
        for c in range(how.values):
            _, back, counts = np.unique(sigs[:, c], return_inverse=True, return_counts=True)
            votes += counts[back]
        hubs = np.argsort(-votes, kind="stable")[:1]
        pivots = np.unique(np.concatenate([hubs, np.linspace(0, n - 1, min(n, how.pivots)).astype(np.int64)]))
        agree = np.stack([(sigs == sigs[p]).sum(axis=1) for p in pivots], axis=1)
        agree[pivots, np.arange(len(pivots))] = -1
        rows = np.arange(n)
        add(rows, np.full(n, hubs[0]))
        add(rows, pivots[np.argmax(agree, axis=1)])
    return out


#: How a row takes part in a block: on the left, on the right; and whether it is outside its region's largest component.
LEFT, RIGHT, FEW = 1, 2, 4


def _pairs(sigs: np.ndarray, reps: np.ndarray, parts: np.ndarray, how: Forest, sides: np.ndarray | None = None, sizes: np.ndarray | None = None, homes: np.ndarray | None = None, whole: int = 0):
    """Every candidate of one block between different components, left with right: (place, place, values that agree), some at a time.

    Left rows are never in the region's largest component, so that a dense group costs little. Without
    ``sides`` the block is a region of its own. Pairs whose ``sizes`` (of sets) are too far apart to be linked are left out, and
    so are pairs that share a region in a tree before that of ``whole``: ``homes`` has each row's region in each tree.
    """
    names, back, counts = np.unique(parts, return_inverse=True, return_counts=True)
    if len(names) < 2:
        return
    if sides is None:
        sides = np.where(back != counts.argmax(), LEFT | RIGHT | FEW, RIGHT)
    least = how.least_agreeing * how.values
    left, right = np.flatnonzero(sides & LEFT), np.flatnonzero(sides & RIGHT)
    earlier = () if homes is None else homes.T[: int(np.argmax(homes[0] == whole))]
    by_value = np.ascontiguousarray(sigs.T)
    step = max(1, (1 << 20) // max(1, len(right)))
    for a in range(0, len(left), step):
        some = left[a : a + step]
        # a pair of which neither row is in the largest component is met twice
        still = (sides[right] & FEW == 0)[None, :] | (reps[right][None, :] > reps[some][:, None])
        still &= back[some][:, None] != back[right][None, :]
        if sizes is not None:
            p, q = sizes[some][:, None], sizes[right][None, :]
            still &= (100 * p >= how.percent * q) & (100 * q >= how.percent * p)
        for home in earlier:
            still &= home[some][:, None] != home[right][None, :]
        i, j = np.nonzero(still)
        if 4 * len(i) > still.size:
            dense = np.zeros(still.shape, np.uint16)
            for value in by_value:
                dense += value[some][:, None] == value[right][None, :]
            agree = dense[i, j]
        else:
            # value by value, as whole signatures of so many pairs would take hundreds of MB
            p, q, agree = some[i], right[j], np.zeros(len(i), np.uint16)
            for value in by_value:
                agree += value[p] == value[q]
        ok = agree >= least
        if ok.any():
            yield some[i[ok]], right[j[ok]], agree[ok]


def _across(sigs: np.ndarray, reps: np.ndarray, parts: np.ndarray, how: Forest, sides: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The pairs of ``_pairs`` by ids: (rep, rep, values that agree)."""
    return [(np.minimum(reps[i], reps[j]), np.maximum(reps[i], reps[j]), agree) for i, j, agree in _pairs(sigs, reps, parts, how, sides)]


def _values(column: pa.Array) -> np.ndarray:
    """A column as an array: signatures and lists as rows of values."""
    if pa.types.is_binary(column.type):
        return np.frombuffer(b"".join(column.to_pylist()), ">u4").astype(np.uint32).reshape(len(column), -1)
    if pa.types.is_list(column.type):
        return column.flatten().to_numpy().reshape(len(column), -1)
    return column.to_numpy()


def _searched(rows: DataFrame, search, *columns: str) -> DataFrame:
    """(region, a, b, agree) with a < b that ``search`` gives for each region of
    (region, rep, sig, order, *columns); it gets signatures, ids and ``columns`` in the region's order."""
    rows = rows.repartition(shuffle_partitions(rows.sparkSession), "region").sortWithinPartitions("region", "order", "rep").select("region", "sig", "rep", *columns)

    def run(batches):
        held: list[list[np.ndarray]] = []

        def pairs(blocks):
            region, *columns = (np.concatenate(x) for x in zip(*blocks))
            out = []
            cuts = np.flatnonzero(np.diff(region)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(region)]):
                if b - a > 1:
                    out += [(np.full(len(x[0]), region[a]), *x) for x in search(*(c[a:b] for c in columns))]
            if out:
                made = [np.concatenate(x).astype(np.int64) for x in zip(*out)]
                if len(made[0]):
                    return pa.RecordBatch.from_arrays(list(map(pa.array, made)), ["region", "a", "b", "agree"])
            return None

        for batch in batches:
            values = list(map(_values, batch.columns))
            region = values[0]
            # the last region of a batch may go on in the next one
            cut = int(np.searchsorted(region != region[-1], False)) if region[0] == region[-1] else int(np.flatnonzero(region != region[-1])[-1]) + 1
            if cut:
                made = pairs([*held, [x[:cut] for x in values]])
                held = []
                if made is not None:
                    yield made
            held.append([x[cut:] for x in values])
        if held and (made := pairs(held)) is not None:
            yield made

    return rows.mapInArrow(run, "region long, a long, b long, agree long")


def candidates(found: DataFrame, classes: DataFrame, how: Forest) -> DataFrame:
    """Distinct (a, b, agree) with a < b: neighbours and hubs of the regions in ``found``."""
    step = 4 * (how.values // how.trees)
    start = F.col("tree") * step
    order = F.concat(F.substring("sig", start + 1, F.lit(4 * how.values)), F.substring("sig", F.lit(1), start))
    rows = found.join(classes.select("rep", "sig"), "rep").select("region", "rep", "sig", order.alias("order"))
    return _searched(rows, lambda sigs, reps: _near(sigs, reps, how)).groupBy("a", "b").agg(F.max("agree").alias("agree"))


def blocks(found: DataFrame, parts: DataFrame, how: Forest) -> DataFrame:
    """(region, whole, rep, part, side) of the blocks in which all of each region in ``found`` that holds several
    components is searched: rows outside its largest component against all rows.

    A region of up to ``most_rows`` is one block. A larger one is dealt into parts of about half as many,
    those of the left and those of the right, and each left part meets each right part in a block. Regions in which all
    are neighbours have been searched fully by ``candidates``.
    """
    named = found.join(parts.toDF("rep", "part"), "rep", "left").select("whole", "rep", "weight", F.coalesce("part", "rep").alias("part"))
    sized = named.groupBy("whole", "part").agg(F.sum("weight").alias("n")).groupBy("whole").agg(F.sum("n").alias("size"), F.count("*").alias("n_parts"), F.max(F.struct("n", "part")).alias("top"))
    sized = sized.where((F.col("n_parts") > 1) & (F.col("size") > min(how.neighbours + 1, how.most_rows)))
    dealt = lambda n: F.when(F.col("size") > how.most_rows, F.greatest(F.lit(1), F.ceil(2 * n / how.most_rows))).otherwise(1).cast("int")
    sized = sized.select("whole", F.col("top.part").alias("largest"), dealt(F.col("size") - F.col("top.n")).alias("n_left"), dealt(F.col("size")).alias("n_right"))
    few, at = F.col("part") != F.col("largest"), F.xxhash64("rep", "whole")
    rows = named.join(sized, "whole").select("whole", "rep", "part", "n_left", "n_right", few.alias("few"), F.pmod(at, "n_left").cast("int").alias("i"), F.pmod(at, "n_right").cast("int").alias("j"))
    own = F.col("few").cast("int") * FEW
    as_left = F.transform(F.sequence(F.lit(0), F.col("n_right") - 1), lambda j: F.struct(F.col("i").alias("i"), j.alias("j"), (own + LEFT + F.when(j == F.col("j"), RIGHT).otherwise(0)).alias("side")))
    as_right = F.transform(F.filter(F.sequence(F.lit(0), F.col("n_left") - 1), lambda i: ~F.col("few") | (i != F.col("i"))), lambda i: F.struct(i.alias("i"), F.col("j").alias("j"), (own + RIGHT).alias("side")))
    spread = rows.select("whole", "rep", "part", F.explode(F.when(F.col("few"), F.concat(as_left, as_right)).otherwise(as_right)).alias("b"))
    return spread.select(F.xxhash64("whole", "b.i", "b.j").alias("region"), "whole", "rep", "part", F.col("b.side").alias("side"))


#: What ``_pairs`` takes of a row, besides its signature and id.
OF_PAIRS = ("part", "side", "n_shingles", "homes", "whole")


def across(found: DataFrame, classes: DataFrame, parts: DataFrame, how: Forest) -> DataFrame:
    """(region, rep, sig, part, side, n_shingles, homes, whole) of classes with a candidate in another component, in one of the ``blocks``.

    At most one row per class and block; the pairs themselves are not emitted. A pair counts in the first tree in which
    it shares a region, so later trees only search what is left.
    """
    rows = written(blocks(found, parts, how), "blocks")
    # who has no region in a tree is alone there
    home = [F.coalesce(F.max(F.when(F.col("tree") == t, F.col("whole"))), F.col("rep")) for t in range(how.trees)]
    known = written(found.groupBy("rep").agg(F.array(*home).alias("homes")).join(classes.select("rep", "sig", "n_shingles"), "rep"), "known")

    def members(sigs, reps, parts, sides, sizes, homes, wholes):
        seen = np.zeros(len(reps), bool)
        for i, j, _ in _pairs(sigs, reps, parts, how, sides, sizes, homes, wholes[0]):
            seen[i] = seen[j] = True
        return [(reps[seen], reps[seen], np.zeros(seen.sum(), np.int64))]

    made = _searched(rows.join(known, "rep").select("region", "rep", "sig", F.lit(0).alias("order"), *OF_PAIRS), members, *OF_PAIRS)
    return made.select("region", F.col("a").alias("rep")).join(rows, ["region", "rep"]).join(known, "rep").select("region", "rep", "sig", *OF_PAIRS)


def linked(p: np.ndarray, q: np.ndarray, how: Forest) -> bool:
    """Whether two sets, sorted and distinct, are similar enough."""
    if 100 * min(len(p), len(q)) < how.percent * max(len(p), len(q)):
        return False
    both = np.concatenate([p, q])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= how.percent * (len(both) - common)


class Common:
    """How many values rows of a block have in common, for many pairs at once.

    Values of one row only are in no intersection. Those of at least every sixteenth row are counted by products of 0/1
    matrices, the others through the list of rows that have them, so that neither grows with rows times distinct values.
    """

    def __init__(self, sets: list[np.ndarray], columns: int = 1024):
        self.n, self.columns = len(sets), columns
        _, value, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(self.n), [len(x) for x in sets])
        often = counts >= max(2, self.n / 16)
        place = np.cumsum(often) - 1
        dense = often[value]
        self.dense = np.zeros((self.n, int(often.sum())), np.uint8)
        self.dense[row[dense], place[value[dense]]] = 1
        rare = (counts[value] > 1) & ~dense
        value, row = value[rare], row[rare]
        self.starts = np.searchsorted(row, np.arange(self.n + 1))
        self.of_row = value
        self.rows = row[np.argsort(value, kind="stable")]
        self.ends = np.cumsum(np.bincount(value, minlength=len(counts)))
        self.lengths = np.diff(self.ends, prepend=0)

    def counts(self, rows: np.ndarray) -> np.ndarray:
        """Values that each of ``rows`` has in common with every other row; of itself those that another row has too."""
        out = np.zeros((len(rows), self.n), np.float32)
        for a in range(0, self.dense.shape[1], self.columns):
            some = self.dense[:, a : a + self.columns].astype(np.float32)
            out += some[rows] @ some.T
        for k, r in enumerate(rows):
            mine = self.of_row[self.starts[r] : self.starts[r + 1]]
            if len(mine):
                lengths = self.lengths[mine]
                first = np.repeat(self.ends[mine] - np.cumsum(lengths), lengths)
                out[k] += np.bincount(self.rows[first + np.arange(len(first))], minlength=self.n)
        return out


class Joined:
    """Which parts a task has joined."""

    def __init__(self):
        self.root: dict[int, int] = {}

    def top(self, x: int) -> int:
        while (up := self.root.get(x, x)) != x:
            self.root[x] = self.root.get(up, up)
            x = up
        return x

    def join(self, p: int, q: int) -> None:
        p, q = self.top(p), self.top(q)
        self.root[max(p, q)] = min(p, q)


def _links(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["a", "b"])


def confirm(pairs: DataFrame, sets: DataFrame, how: Forest) -> DataFrame:
    """(a, b): links between parts, of the pairs (a, b, part_a, part_b) that are similar by their full sets.

    A task compares no pair whose parts it has joined already, so it gives fewer links than it sees parts.
    """
    left = sets.select(F.col("rep").alias("a"), F.col("found").alias("x"))
    right = sets.select(F.col("rep").alias("b"), F.col("found").alias("y"))

    def run(batches):
        joined = Joined()
        for batch in batches:
            p, q = (batch.column(i).to_pylist() for i in (0, 1))
            x, y = batch.column(2), batch.column(3)
            made = []
            for i in range(batch.num_rows):
                if joined.top(p[i]) != joined.top(q[i]) and linked(np.frombuffer(x[i].as_buffer(), np.uint64), np.frombuffer(y[i].as_buffer(), np.uint64), how):
                    joined.join(p[i], q[i])
                    made.append((p[i], q[i]))
            yield _links(made)

    joined = pairs.select("a", "b", "part_a", "part_b").join(left, "a").join(right, "b")
    return joined.select("part_a", "part_b", "x", "y").mapInArrow(run, "a long, b long").distinct()


def between(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """(a, b, agree, part_a, part_b) of the pairs whose parts differ; who has no part is one."""
    of_a, of_b = parts.toDF("a", "part_a"), parts.toDF("b", "part_b")
    named = pairs.select("a", "b", "agree").join(of_a, "a", "left").join(of_b, "b", "left")
    return named.select("a", "b", "agree", F.coalesce("part_a", "a").alias("part_a"), F.coalesce("part_b", "b").alias("part_b")).where("part_a <> part_b")


def best_of_each(pairs: DataFrame) -> DataFrame:
    """The best pair of each part; of equals the one with the smallest ids."""
    pair = F.struct((-F.col("agree")).alias("less"), "a", "b", "part_a", "part_b")
    of = lambda side: pairs.groupBy(F.col(side).alias("part")).agg(F.min(pair).alias("pair"))
    best = of("part_a").union(of("part_b")).groupBy("part").agg(F.min("pair").alias("pair")).select("pair.*").distinct()
    return best.select("a", "b", (-F.col("less")).alias("agree"), "part_a", "part_b")


def confirm_by_region(members: DataFrame, sets: DataFrame, how: Forest) -> DataFrame:
    """(a, b): links between components within a block of ``across``.

    A task holds the sets of one block, which ``most_rows`` bounds, and gives no more links than
    join the block's components.
    """
    columns = ["sig", "rep", *OF_PAIRS, "found"]
    rows = members.join(sets, "rep").select("region", *columns)
    dealt = rows.repartition(shuffle_partitions(members.sparkSession), "region").sortWithinPartitions("region", "rep")

    def links(held):
        sigs, reps, parts, sides, sizes, homes, wholes = (np.concatenate(x) for x in zip(*(x[:-1] for x in held)))
        full = [np.frombuffer(x.as_buffer(), np.uint64) for *_, some in held for x in some]
        names, back = np.unique(parts, return_inverse=True)
        joined, common = Joined(), None
        for i, j, _ in _pairs(sigs, reps, parts, how, sides, sizes, homes, wholes[0]):
            top = np.array([joined.top(x) for x in names.tolist()])[back]
            apart = top[i] != top[j]
            i, j = i[apart], j[apart]
            if many := len(i) > 4 * len(reps):
                common = common or Common(full)
                rows, place = np.unique(i, return_inverse=True)
                both = common.counts(rows)[place, j]
                near = 100 * both >= how.percent * (sizes[i] + sizes[j] - both)
                i, j = i[near], j[near]
            for a, b in zip(i.tolist(), j.tolist()):
                p, q = int(parts[a]), int(parts[b])
                if joined.top(p) != joined.top(q) and (many or linked(full[a], full[b], how)):
                    joined.join(p, q)
                    yield p, q

    def run(batches):
        at, held = None, []
        for batch in batches:
            region = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(region)) + 1), len(region)]
            for a, b in zip(cuts, cuts[1:]):
                if region[a] != at:
                    if held:
                        yield _links(list(links(held)))
                    at, held = region[a], []
                part = batch.slice(a, b - a)
                held.append([*map(_values, part.columns[1:-1]), part.column(part.num_columns - 1)])
        if held:
            yield _links(list(links(held)))

    return dealt.mapInArrow(run, "a long, b long").distinct()


#: Bits of the membership bitmap, and the most classes for which it is used.
BITMAP_BITS, BITMAP_ROWS = 1 << 24, 1 << 20


def full_sets(docs: DataFrame, reps: DataFrame, how: Forest, text: str = "text", doc: str = "doc_id") -> DataFrame:
    """(rep, found) of the classes in ``reps``; found is the set as sorted 64-bit values.

    Up to ``BITMAP_ROWS`` classes a broadcast bitmap of fixed size leaves out most other rows before
    the join; beyond that the texts themselves are joined.
    """
    rows = docs.select(F.col(doc).alias("rep"), text_bytes(text).alias("_text"))
    shared = None
    if reps.count() <= BITMAP_ROWS:
        place = F.pmod(F.xxhash64("rep"), F.lit(BITMAP_BITS)).cast("int").alias("place")
        shared = docs.sparkSession.sparkContext.broadcast(bitmap(reps.select(place), BITMAP_BITS))
        rows = rows.select("rep", "_text", place)
    else:
        rows = rows.join(reps, "rep", "left_semi")

    def run(batches):
        for batch in batches:
            if shared is not None:
                batch = batch.filter(pa.array(in_bitmap(shared.value, batch.column(2).to_numpy())))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(x.as_py() or b"", how.words).tobytes() for x in batch.column(1)], pa.binary())], ["rep", "found"])

    sets = rows.mapInArrow(run, "rep long, found binary")
    return sets if shared is None else sets.join(reps, "rep", "left_semi")


def components(docs: DataFrame, how: Forest, text: str, doc: str) -> DataFrame:
    """(doc_id, n_shingles, component) of every row; ``doc`` is a long that tells documents apart."""
    signed = written(sign(docs, how, text, doc), "signed")
    classes = written(signed.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n_shingles")), "classes")
    found = written(regions(classes, how), "found")
    pairs = written(candidates(found, classes, how), "pairs")
    reps = written(pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct(), "reps")
    sets = written(full_sets(docs, reps, how, text, doc), "sets")

    # the best candidate of each class, then of each component, then whatever that leaves between components
    parts = classes.select(F.col("rep").alias("node"), F.col("rep").alias("part")).limit(0)
    left = pairs.select("*", F.col("a").alias("part_a"), F.col("b").alias("part_b"))
    for k, some in enumerate((best_of_each, best_of_each, lambda x: x)):
        if k:
            left = written(between(left, parts), "left")
        links = written(confirm(some(left), sets, how), "linked")
        parts = merged(parts, links)
        discard(links)
    discard(pairs, reps, sets)

    # then whatever neighbours and hubs have missed
    more = written(across(found, classes, parts, how), "more")
    reps = written(more.select("rep").distinct(), "reps")
    sets = written(full_sets(docs, reps, how, text, doc), "sets")
    links = written(confirm_by_region(more, sets, how), "linked")
    parts = merged(parts, links)
    discard(found, more, reps, sets, links)

    named = classes.join(parts, classes["rep"] == parts["node"], "left").select("key", F.coalesce("part", "rep").alias("component"))
    return signed.join(named, "key", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component"))


def near_duplicates(docs: DataFrame, how: Forest = Forest(), text: str = "text", doc: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row."""
    rows, again = row_ids(docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("text")))
    out = components(rows, how, "text", "_row")
    if again:
        names = written(rows.select("_row", F.col("doc_id").alias("name")).distinct(), "names")
        first = names.select(F.col("_row").alias("component"), F.col("name").alias("component_id"))
        out = out.join(names, out["doc_id"] == names["_row"]).join(first, "component", "left")
        return out.select(F.col("name").alias("doc_id"), "n_shingles", "component_id", (F.col("_row") == F.col("component")).alias("kept"))
    return out.select("doc_id", "n_shingles", F.col("component").alias("component_id"), (F.col("doc_id") == F.col("component")).alias("kept"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component and verdict of every document, by runs of four words."""
    return near_duplicates(table(session(spark), sf_dir, "documents").select("doc_id", "text"), Forest(words=4))


#: Candidates share one of their rarest shingles: sets that are linked must, so none is lost.
SQL_OP9 = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT doc_id, w, least(4, len(w)) AS n, unnest(range(1, len(w) - least(4, len(w)) + 2)) AS i FROM words WHERE len(w) > 0),
shingles AS MATERIALIZED (SELECT DISTINCT doc_id, md5_number(array_to_string(w[i : i + n - 1], ' ')) AS s FROM starts),
sets AS MATERIALIZED (SELECT doc_id, count(*) AS n, md5(string_agg(s::VARCHAR, ',' ORDER BY s)) AS k FROM shingles GROUP BY doc_id),
classes AS MATERIALIZED (SELECT k, min(doc_id) AS rep, any_value(n) AS n FROM sets GROUP BY k),
own AS MATERIALIZED (SELECT rep, n, s FROM shingles JOIN classes ON doc_id = rep),
rarity AS (SELECT s, count(*) AS f FROM own GROUP BY s),
ranked AS (SELECT rep, n, s, row_number() OVER (PARTITION BY rep ORDER BY f, s) AS r FROM own JOIN rarity USING (s)),
prefixes AS MATERIALIZED (SELECT rep, n, s FROM ranked WHERE r <= n - (4 * n + 4) // 5 + 1),
pairs AS MATERIALIZED (
  SELECT DISTINCT x.rep AS a, y.rep AS b, x.n AS p, y.n AS q FROM prefixes x JOIN prefixes y ON x.s = y.s AND x.rep < y.rep AND 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)),
links AS MATERIALIZED (
  SELECT a, b FROM pairs JOIN own x ON x.rep = a JOIN own y ON y.rep = b AND y.s = x.s GROUP BY a, b, p, q HAVING 100 * count(*) >= 80 * (p + q - count(*))),
edges AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT rep, rep FROM classes UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a),
components AS (SELECT a AS rep, min(b) AS component FROM reach GROUP BY a)
SELECT doc_id, coalesce(sets.n, 0)::BIGINT AS n_shingles, coalesce(component, doc_id) AS component_id, coalesce(component, doc_id) = doc_id AS kept
FROM words LEFT JOIN sets USING (doc_id) LEFT JOIN classes USING (k) LEFT JOIN components USING (rep)
"""
