"""Similarity join on word shingles by chosen paths.

Texts with equal sets of shingles are one set, with its copies counted. A set's sketch has ``COORDINATES`` minima, on each of which two sets of
similarity s agree with probability s. A run walks down a tree: a node samples each coordinate with probability 1 / (threshold *
COORDINATES) from the hash of its path, and its sets are split by their values at the sampled coordinates. Sets over the threshold so stay
together with the probability that a branching process with one child on average survives; ``runs_for`` repeats runs until the target recall
for a pair right at the threshold. Nodes of up to ``SMALL`` sets compare all pairs of sketches. Larger nodes compare all with one pivot and
split on; at ``DEPTH`` levels, the sets of a still larger node that did not match its pivot are compared with all others, in blocks.

What sketches find alike at ``LOOSE`` makes up loose components. In them all pairs of sets are compared exactly, in pairs of blocks of
``BLOCK`` sets, by products of incidence matrices. These blocks give each set's number of links and the links' spanning trees, never a row
for each pair. So every link between sets of one loose component is found.

Nulls and texts without words have no shingles and no links, and are classes of their own. Texts of fewer words than a shingle have one
shingle of all their words. Repeated rows count as copies. Rows without a
doc_id are joined like others; class_id is null where no member has one. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged, table
from .graph import components
from .words import mixed, shingles, sketch

THRESHOLD = 0.8
COORDINATES = 64
RECALL = 0.999
SMALL = 40
DEPTH = 3
LOOSE = 0.6
BLOCK = 512
#: Ids of a task's forest, beyond which its edges are given and it starts anew.
FOREST = 500_000
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def runs_for(recall: float = RECALL, depth: int = DEPTH) -> int:
    """How many runs find a pair at the threshold with probability ``recall``: a path has Poisson(1) shared children at each level."""
    alive = 1.0
    for _ in range(depth):
        alive = 1 - math.exp(-alive)
    return math.ceil(math.log(1 - recall) / math.log(1 - alive))


def _children(path: np.ndarray, sketches: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows and the paths of the nodes below theirs."""
    of = mixed(path[:, None] + _GOLD * np.arange(1, COORDINATES + 1, dtype=np.uint64)[None, :])
    row, at = np.nonzero(of < np.uint64(int(2**64 / (threshold * COORDINATES))))
    return row, mixed(of[row, at] ^ (sketches[row, at].astype(np.uint64) * _GOLD))


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, COORDINATES)


def _sets(docs: DataFrame, k: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            rows = []
            for doc, version, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                items = shingles(text.as_py(), k)
                rows.append((doc, version, xxhash.xxh3_128_digest(items.tobytes()), len(items), sketch(items, COORDINATES).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary()))], names=["doc_id", "version", "key", "n", "sketch"])

    return docs.mapInArrow(run, "doc_id long, version long, key binary, n long, sketch binary")


def _alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each row of a, the rows of b whose sketches agree enough."""
    return np.stack([(x == b).sum(axis=1) for x in a]) >= LOOSE * COORDINATES


def _top(root, x: int) -> int:
    """The root of ``x`` in a forest."""
    while root[x] != x:
        root[x] = root[root[x]]
        x = root[x]
    return x


def _edges(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)], names=["a", "b"])


class _Forest:
    """What a task has found connected; gives one edge for each id, to the least id it is connected with in this task."""

    def __init__(self):
        self.root: dict[int, int] = {}

    def unite(self, a: int, b: int) -> None:
        a, b = (_top(self.root, self.root.setdefault(x, x)) for x in (a, b))
        self.root[max(a, b)] = min(a, b)

    def edges(self, at_least: int = 0):
        if len(self.root) > at_least:
            yield _edges([(x, top) for x in self.root if (top := _top(self.root, x)) != x])
            self.root = {}


def _spanning(batches):
    """Edges (a, b) of a task as a forest."""
    forest = _Forest()
    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            forest.unite(a, b)
        yield from forest.edges(FOREST)
    yield from forest.edges()


def _blocks(rows: DataFrame, into: str, block: str) -> DataFrame:
    """The sets of each path in blocks of about BLOCK: path, block, and the list of sets."""
    sizes = rows.groupBy("path").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    dealt = rows.join(sizes, "path").withColumn(block, F.pmod(F.xxhash64("id"), F.col("blocks")))
    return dealt.groupBy("path", block).agg(F.collect_list(F.struct("id", "sketch")).alias(into))


def _sketches(sets: list[dict]) -> np.ndarray:
    return np.frombuffer(b"".join(x["sketch"] for x in sets), np.uint32).reshape(-1, COORDINATES)


def _with_pivot(batches):
    for batch in batches:
        near = (_matrix(batch.column("sketch")) == _matrix(batch.column("pivot_sketch"))).sum(axis=1) >= LOOSE * COORDINATES
        yield pa.RecordBatch.from_arrays([*batch.select(["path", "id", "sketch", "pivot"]).columns, pa.array(near, pa.bool_())], names=["path", "id", "sketch", "pivot", "near"])


def loose_edges(sets: DataFrame, threshold: float, runs: int) -> DataFrame:
    """Edges (a, b) between sets (id, sketch) that connect all those that lie in one node of some run and whose sketches agree enough."""

    def start(batches):
        seeds = mixed(np.arange(1, runs + 1, dtype=np.uint64))
        for batch in batches:
            if batch.num_rows:
                own = _matrix(batch.column("sketch"))
                row = np.repeat(np.arange(batch.num_rows), runs)
                at, path = _children(np.tile(seeds, batch.num_rows), own[row], threshold)
                yield pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), batch.column("id").take(pa.array(row[at]))], names=["path", "id"])

    def descend(batches):
        for batch in batches:
            if batch.num_rows:
                row, path = _children(batch.column("path").to_numpy().view(np.uint64), _matrix(batch.column("sketch")), threshold)
                yield pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), batch.column("id").take(pa.array(row))], names=["path", "id"])

    def small(batches):
        forest = _Forest()
        for batch in batches:
            for node in batch.column("node").to_pylist():
                own = _sketches(node)
                for i, j in zip(*(x.tolist() for x in np.nonzero(np.triu(_alike(own, own), 1)))):
                    forest.unite(node[i]["id"], node[j]["id"])
            yield from forest.edges(FOREST)
        yield from forest.edges()

    def rest(batches):
        forest = _Forest()
        for batch in batches:
            for mine, others in zip(batch.column("mine"), batch.column("others")):
                mine, others = mine.as_py(), others.as_py()
                for i, j in zip(*(x.tolist() for x in np.nonzero(_alike(_sketches(mine), _sketches(others))))):
                    forest.unite(mine[i]["id"], others[j]["id"])
            yield from forest.edges(FOREST)
        yield from forest.edges()

    found = []
    nodes = sets.mapInArrow(start, "path long, id long")
    for level in range(DEPTH):
        nodes = staged(nodes.distinct(), "nodes")
        sizes = nodes.groupBy("path").agg(F.count("*").alias("size"), F.min("id").alias("pivot")).where("size > 1")
        members = staged(nodes.join(sizes, "path").join(sets, "id").select("path", "id", "sketch", "size", "pivot"), "members")
        few = members.where(F.col("size") <= SMALL).groupBy("path").agg(F.collect_list(F.struct("id", "sketch")).alias("node"))
        found.append(few.select("node").mapInArrow(small, "a long, b long"))
        many = members.where(F.col("size") > SMALL)
        if many.isEmpty():
            break
        pivots = many.where("id = pivot").select("path", F.col("sketch").alias("pivot_sketch"))
        tried = many.join(pivots, "path").select("path", "id", "sketch", "pivot", "pivot_sketch").mapInArrow(_with_pivot, "path long, id long, sketch binary, pivot long, near boolean")
        tried = staged(tried, "tried")
        found.append(tried.where("near and id <> pivot").select(F.col("id").alias("a"), F.col("pivot").alias("b")).mapInArrow(_spanning, "a long, b long"))
        if level == DEPTH - 1:
            pairs = _blocks(tried, "mine", "own").join(_blocks(tried.where("not near"), "others", "other"), "path")
            found.append(pairs.repartition("path", "own", "other").select("mine", "others").mapInArrow(rest, "a long, b long"))
        nodes = many.select("path", "sketch", "id").mapInArrow(descend, "path long, id long")
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    # the forests of many tasks overlap: all that one set is connected with hangs on the least of it, of which there are few
    ends = out.groupBy("a").agg(F.collect_set("b").alias("to")).select("a", "to", F.array_min("to").alias("b"))
    return ends.select(F.explode(F.array_append("to", F.col("a"))).alias("a"), "b").where("a <> b").distinct()


def _counts(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, through incidence matrices of a slice of the items at a time."""
    items, at = np.unique(np.concatenate([*a, *b]), return_inverse=True)
    owner = np.repeat(np.arange(len(a) + len(b)), [len(x) for x in (*a, *b)])
    out = np.zeros((len(a), len(b)), np.float32)
    order = np.argsort(at, kind="stable")
    at, owner = at[order], owner[order]
    for low in range(0, len(items), 4096):
        here = slice(*np.searchsorted(at, [low, low + 4096]))
        m = np.zeros((len(a) + len(b), 4096), np.float32)
        m[owner[here], at[here] - low] = 1
        out += m[: len(a)] @ m[len(a) :].T
    return out


def _compared(threshold: float):
    def run(group: pa.Table) -> pa.Table:
        group = group.take(np.unique(group.column("id").to_numpy(), return_index=True)[1])  # rows that repeat a doc_id
        ids, copies = group.column("id").to_numpy(), group.column("copies").to_numpy()
        side = group.column("side").to_numpy()
        items = [np.frombuffer(x, np.uint64) for x in group.column("items").to_pylist()]
        one = group.column("low")[0] == group.column("high")[0]
        left = np.nonzero(side == 0)[0]
        right = left if one else np.nonzero(side == 1)[0]
        links, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
        if len(left) and len(right):
            size = np.array([len(x) for x in items], np.float32)
            shared = _counts([items[i] for i in left], [items[i] for i in right])
            linked = shared >= threshold * (size[left][:, None] + size[right][None, :] - shared) - 1e-3
            if one:
                np.fill_diagonal(linked, False)
            links[left] += linked @ copies[right]
            if not one:
                links[right] += linked.T @ copies[left]

            for i, row in zip(left, linked):
                for j in right[row]:
                    a, b = _top(root, i), _top(root, j)
                    if a != b:
                        root[max(a, b)] = min(a, b)
            root = np.array([_top(root, x) for x in range(len(ids))])
        return pa.table({"id": ids, "links": links, "root": ids[root]})

    return run


def join(docs: DataFrame, threshold: float = THRESHOLD, k: int = 5, recall: float = RECALL) -> DataFrame:
    """doc_id, class_id (the least doc_id of the class), n_links: how many other rows a row is linked with, copies included. Also version, a hash of the text, and stays: whether
    the row is its class's first, by doc_id (none last) and version."""
    text = F.col("text").cast("string")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("version"), text.alias("text"))
    rows = staged(_sets(docs, k), "sketches")
    # a set goes by a hash of its items, as a doc_id may stand on several texts
    sets = rows.where("n > 0").groupBy("key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "version")).alias("head"), F.count("*").alias("copies"), F.first("sketch").alias("sketch"))
    sets = staged(sets.withColumn("id", F.xxhash64("key")), "sets")
    loose = components(loose_edges(sets.select("id", "sketch"), threshold, runs_for(recall)))
    members = staged(sets.select("id", F.col("head.doc_id").alias("of"), F.col("head.version").alias("of_version"), "key", "copies").join(loose, "id"), "loose")

    def items(batches):
        for batch in batches:
            made = [shingles(x.as_py(), k).tobytes() for x in batch.column("text")]
            own = pa.array([xxhash.xxh3_128_digest(x) == key for x, key in zip(made, batch.column("key").to_pylist())], pa.bool_())
            out = [*batch.select(["id", "copies", "component"]).columns, pa.array(made, pa.binary())]
            yield pa.RecordBatch.from_arrays(out, names=["id", "copies", "component", "items"]).filter(own)

    own = F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("version") == F.col("of_version"))
    full = docs.join(members.hint("merge"), own).select("id", "copies", "component", "key", "text").mapInArrow(items, "id long, copies long, component long, items binary")
    blocks = members.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = full.join(blocks, "component").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other")).withColumn("side", F.when(F.col("own") == F.col("low"), 0).otherwise(1))
    dealt = dealt.select("component", "low", "high", "side", "id", "copies", "items")
    compared = staged(dealt.groupBy("component", "low", "high").applyInArrow(_compared(threshold), "id long, links long, root long"), "compared")
    links = compared.groupBy("id").agg(F.sum("links").alias("links"))
    classes = components(compared.select(F.col("id").alias("a"), F.col("root").alias("b")))
    least = sets.select("id", "head").join(classes, "id").groupBy("component").agg(F.min("head").alias("class"))
    of = classes.join(least, "component").select("id", "class")
    named = sets.join(links, "id", "left").join(of, "id", "left").select("key", F.coalesce("class", "head").alias("class"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    out = rows.select("doc_id", "version", "n", "key").join(named, "key", "left")
    empty = F.col("n") == 0
    stays = empty | (F.col("doc_id").eqNullSafe(F.col("class.doc_id")) & (F.col("version") == F.col("class.version")))
    class_id = F.when(empty, F.col("doc_id")).otherwise(F.col("class.doc_id"))
    return out.select("doc_id", class_id.alias("class_id"), F.when(empty, F.lit(0)).otherwise(F.col("links")).cast("long").alias("n_links"), "version", stays.alias("stays"))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")
