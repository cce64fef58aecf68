"""Hard negatives by a multiway hyperplane tree with distance ranges (GNAT).

Vectors are compared by the inner product of ``floor(scale * x)``, an integer. A row's positives
are the highest-scoring other rows of its label; for each positive, the highest-scoring rows of
other labels within a window of scores below that of the positive are its hard negatives.

**Tree.** A node has a few split points, and each vector goes to the subtree of the nearest.
Each split point stores the least and the greatest distance to the vectors of every sibling
subtree; a subtree also has the least and greatest length of its vectors. The upper levels
are chosen on a sample of ``SAMPLE_ROWS`` rows; all rows are indexed by them, and their ranges
cover all rows. A cell of the upper levels is cut into blocks of about ``BLOCK_ROWS`` rows, however
many it has, and each block has a tree of its own below that ends in leaves.

**Search.** A window of scores is a window of distances, given the length of the query and those
of a subtree: an annulus around the query. A subtree is left out if for some split point the
distances it stores do not meet those that the annulus allows. Leaves compute all their
scores, so the result is exact. The lower end of a window rises to the last of the
best rows found so far, at first among the sample, then in the block.

**Work.** Queries are sent to the blocks they cannot leave out; a block of rows and its queries,
at most ``QUERY_ROWS`` at a time, meet in one task as a sorted stream of rows, so a task holds one
block and one batch of queries. The best of all blocks are merged by query. Nothing
but the sample and the ranges of the cells (at most ``FANOUT ** LEVELS``) reaches the driver.

Rows with a null label, vector or id, or with a null or non-finite component, take no part. Shorter
vectors count as if filled with zeros. Rows with equal ids are told apart, but are never each other's
positives. An anchor without positives, and a window without rows, gives no rows; so does an empty
table. Equal scores rank by id. Scores beyond 2**53 in size are computed in 64-bit integers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from platewise.llm.common import arrow_schema, importable, shuffle_partitions, staged, table

SCALE = 256
SAMPLE_ROWS = 4096
FANOUT = 8
LEVELS = 2
BLOCK_ROWS = 8192
BLOCK_FANOUT = 16
LEAF_ROWS = 128
QUERY_ROWS = 1 << 16
#: Queries that a task searches side by side.
QUERY_BATCH = 2048
LEAST, MOST = -(1 << 62), 1 << 62

ROWS = "vec_id long, label int, vector array<double>, cell int, place long"
#: Places of a row among the query's: its own id, label and number, and its window of scores.
ROUTED = "block long, kind int, vec_id long, label int, vector array<double>, query long, low long, high long"
FOUND = "query long, vec_id long, score long"


def usable(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, vector) of the rows that take part, with integers as components."""
    finite = F.forall(
        "embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("double"))
    return vectors.filter(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite
    ).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), whole.alias("vector"))


# The tree


@dataclass
class Node:
    """Split points, and for each subtree (second index) the range of its distances to each
    split point (first index) and of the squared lengths of its vectors."""

    points: np.ndarray
    near: np.ndarray
    far: np.ndarray
    short: np.ndarray
    long: np.ndarray
    #: By subtree: a node, a (begin, end) range of a block, or the number of a cell.
    below: list = field(default_factory=list)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``a`` to all of ``b``."""
    both = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * (a @ b.T)
    return np.maximum(both, 0)


def split_points(vectors: np.ndarray, n: int) -> np.ndarray:
    """``n`` vectors far from each other, or fewer if fewer differ."""
    some = vectors[:: max(1, len(vectors) // 512)]
    chosen = [0]
    least = squared(some, some[:1])[:, 0]
    while len(chosen) < n and least.max() > 0:
        chosen.append(int(least.argmax()))
        least = np.minimum(least, squared(some, some[chosen[-1:]])[:, 0])
    return some[chosen]


def nearest(vectors: np.ndarray, points: np.ndarray) -> np.ndarray:
    return squared(vectors, points).argmin(axis=1)


class BlockTree:
    """The tree over the rows of a block, which it brings into an order in which every
    subtree is a range; rows of a leaf are in order of id."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        self.order = np.argsort(ids, kind="stable")
        self.source = vectors
        self.root = self._node(0, len(ids))
        self.ids, self.labels = ids[self.order], labels[self.order]
        self.vectors = vectors[self.order]
        self.length = np.sqrt((self.vectors * self.vectors).sum(axis=1).max(initial=0))

    def _node(self, begin: int, end: int):
        if end - begin <= LEAF_ROWS:
            return begin, end
        own = self.source[self.order[begin:end]]
        points = split_points(own, BLOCK_FANOUT)
        if len(points) < 2:
            return begin, end
        distance = squared(own, points)
        to = distance.argmin(axis=1)
        by_child = np.argsort(to, kind="stable")
        self.order[begin:end] = self.order[begin:end][by_child]
        ends = np.cumsum(np.bincount(to, minlength=len(points)))
        distance, lengths = np.sqrt(distance[by_child]), (own * own).sum(axis=1)[by_child]
        parts = [slice(a, b) for a, b in zip([0, *ends[:-1]], ends) if a < b]
        node = Node(
            points,
            np.array([distance[p].min(axis=0) for p in parts]).T,
            np.array([distance[p].max(axis=0) for p in parts]).T,
            np.array([lengths[p].min() for p in parts]),
            np.array([lengths[p].max() for p in parts]),
        )
        whole = len(parts) == 1
        for p in parts:
            range_ = begin + int(p.start), begin + int(p.stop)
            node.below.append(range_ if whole else self._node(*range_))
        return node


def may_hold(node: Node, queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Which subtrees (second index) may hold a vector whose score with the query (first
    index) is from ``low`` to ``high``: those that the annulus of each split point meets."""
    own = (queries * queries).sum(axis=1)[:, None]
    # Distances that the window allows in each subtree, with room for rounding.
    outer = own + node.long - 2.0 * low[:, None]
    inner = np.sqrt(np.maximum(own + node.short - 2.0 * high[:, None], 0))
    possible = (outer >= -1) & (low <= high)[:, None]
    outer = np.sqrt(np.maximum(outer, 0))
    to_point = np.sqrt(squared(queries, node.points))
    slack = 1e-6 * (to_point.max(axis=1, initial=0)[:, None] + outer + inner + node.far.max(initial=0)) + 1e-6
    for i in range(len(node.points)):
        d = to_point[:, i : i + 1]
        possible &= node.near[i] - d <= outer + slack
        possible &= d - node.far[i] <= outer + slack
        possible &= d + node.far[i] >= inner - slack
    return possible


# Search of a block


class Search:
    """The ``k`` best rows of a block for a batch of queries."""

    def __init__(self, tree: BlockTree, queries: dict, k: int, same_label: bool) -> None:
        self.tree, self.k, self.same = tree, k, same_label
        self.id, self.label, self.high = queries["vec_id"], queries["label"], queries["high"]
        self.vector, self.low = queries["vector"], queries["low"].copy()
        n = len(self.id)
        self.score = np.full((n, k), LEAST, np.int64)
        self.row = np.full((n, k), -1, np.int64)
        size = np.sqrt((self.vector * self.vector).sum(axis=1).max(initial=0)) * tree.length
        self.exact = size < 2.0**53
        self._visit(tree.root, np.arange(n))

    def _visit(self, below, some: np.ndarray) -> None:
        if isinstance(below, tuple):
            self._leaf(*below, some)
            return
        possible = may_hold(below, self.vector[some], self.low[some].astype(float), self.high[some].astype(float))
        for child, to in enumerate(below.below):
            here = some[possible[:, child]]
            if len(here):
                self._visit(to, here)

    def _leaf(self, begin: int, end: int, some: np.ndarray) -> None:
        tree = self.tree
        own = tree.vectors[begin:end]
        if self.exact:
            score = np.rint(self.vector[some] @ own.T).astype(np.int64)
        else:
            score = self.vector[some].astype(np.int64) @ own.T.astype(np.int64)
        same = tree.labels[begin:end] == self.label[some][:, None]
        if self.same:
            allowed = same & (tree.ids[begin:end] != self.id[some][:, None])
        else:
            allowed = ~same
        allowed &= (score >= self.low[some][:, None]) & (score <= self.high[some][:, None])
        hit = allowed.any(axis=1)
        some, score = some[hit], np.where(allowed[hit], score[hit], LEAST)
        if not len(some):
            return
        # Of equal scores the smaller id is further left, in a leaf and among those kept.
        best = np.argsort(-score, axis=1, kind="stable")[:, : self.k]
        score = np.concatenate([self.score[some], np.take_along_axis(score, best, 1)], axis=1)
        row = np.concatenate([self.row[some], begin + best], axis=1)
        order = np.lexsort([np.where(row >= 0, tree.ids[row], MOST), -score], axis=1)[:, : self.k]
        self.score[some] = np.take_along_axis(score, order, 1)
        self.row[some] = np.take_along_axis(row, order, 1)
        full = self.score[some, -1]
        self.low[some] = np.maximum(self.low[some], full)

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, row and score of what was found."""
        query, place = np.nonzero(self.score > LEAST)
        return query, self.row[query, place], self.score[query, place]


def matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """Lists of numbers as rows of a matrix, filled with zeros."""
    offsets = vectors.offsets.to_numpy().astype(np.int64)
    values = vectors.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(offsets)
    out = np.zeros((len(sizes), width))
    row = np.repeat(np.arange(len(sizes)), sizes)
    column = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[row, column] = values[offsets[0] : offsets[-1]] if len(row) else 0
    return out


# The upper levels


@dataclass
class Router:
    """The upper levels of the tree, by cell: for each split point on the way to it the range
    of distances of the cell's rows."""

    width: int
    root: Node | int
    cells: int
    points: list[tuple[int, np.ndarray]]  #: (cell, split points) of each node above each cell
    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    ranges: list[Node] = field(default_factory=list)
    blocks: np.ndarray | None = None  #: by cell

    @classmethod
    def of(cls, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> Router:
        router = cls(vectors.shape[1], 0, 0, [], ids, labels, vectors)

        def grow(rows: np.ndarray, above: list[np.ndarray]):
            points = split_points(rows, FANOUT) if len(above) < LEVELS and len(rows) > 2 * FANOUT else rows[:0]
            if len(points) < 2:
                router.points += [(router.cells, p) for p in above]
                router.cells += 1
                return router.cells - 1
            to = nearest(rows, points)
            none = np.zeros((0, 0))
            node = Node(points, none, none, none, none)
            node.below = [grow(rows[to == i], [*above, points]) for i in range(len(points))]
            return node

        router.root = grow(vectors, [])
        return router

    def cell(self, vectors: np.ndarray) -> np.ndarray:
        """The cell of each vector."""
        out = np.zeros(len(vectors), np.int64)

        def go(node, some: np.ndarray) -> None:
            if not isinstance(node, Node):
                out[some] = node
                return
            to = nearest(vectors[some], node.points)
            for child, below in enumerate(node.below):
                if (here := some[to == child]).size:
                    go(below, here)

        go(self.root, np.arange(len(vectors)))
        return out

    def known(self, queries: dict, k: int, same_label: bool) -> np.ndarray:
        """The lower ends of the windows, raised to the last of the ``k`` best of the sample."""
        tree = BlockTree(self.ids, self.labels, self.vectors)
        return Search(tree, queries, k, same_label).low

    def may_hold(self, queries: dict) -> np.ndarray:
        """Which cells (second index) may hold rows of the window of each query."""
        n = len(queries["low"])
        out = np.tile(self.blocks > 0, (n, 1))
        low, high = queries["low"].astype(float), queries["high"].astype(float)
        for node in self.ranges:
            cell = node.below[0]
            some = np.flatnonzero(out[:, cell])
            out[some, cell] = may_hold(node, queries["vector"][some], low[some], high[some])[:, 0]
        return out


def _place(batches: Iterator[pa.RecordBatch], router, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows with their cell and a number of their own."""
    place = TaskContext.get().partitionId() << 40
    for batch in batches:
        cells = router.value.cell(matrix(batch.column("vector"), router.value.width))
        numbers = place + np.arange(batch.num_rows)
        place += batch.num_rows
        columns = [*batch.columns, pa.array(cells.astype(np.int32)), pa.array(numbers)]
        yield pa.RecordBatch.from_arrays(columns, schema=schema)


def _ranges(batches: Iterator[pa.RecordBatch], router, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """For each cell, node above it and split point: the range of distances and lengths, and
    the number of rows, of this task."""
    own = router.value
    nodes = len(own.points)
    seen: dict[int, list] = {}
    for batch in batches:
        vectors = matrix(batch.column("vector"), own.width)
        cells = batch.column("cell").to_numpy()
        lengths = (vectors * vectors).sum(axis=1)
        for cell in np.unique(cells):
            some = cells == cell
            above = [p for c, p in own.points if c == cell]
            d = [np.sqrt(squared(vectors[some], p)) for p in above]
            now = [
                [x.min(axis=0) for x in d], [x.max(axis=0) for x in d],
                lengths[some].min(), lengths[some].max(), int(some.sum()),
            ]
            if cell in seen:
                was = seen[cell]
                now = [
                    [np.minimum(a, b) for a, b in zip(now[0], was[0])],
                    [np.maximum(a, b) for a, b in zip(now[1], was[1])],
                    min(now[2], was[2]), max(now[3], was[3]), now[4] + was[4],
                ]
            seen[cell] = now
    rows = []
    for cell, (near, far, short, long, n) in seen.items():
        if not near:
            rows.append((int(cell), 0, 0, 0.0, 0.0, short, long, n))
        for node, (a, b) in enumerate(zip(near, far)):
            rows += [(int(cell), node, i, x, y, short, long, n) for i, (x, y) in enumerate(zip(a, b))]
    if rows:
        columns = zip(*rows, strict=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
        )


@dataclass
class Index:
    rows: DataFrame  #: (vec_id, label, vector, block)
    router: object  #: broadcast


def build_index(vectors: DataFrame) -> Index | None:
    """The index of the usable rows; None if there are none."""
    spark = vectors.sparkSession
    rows = usable(vectors)
    # At most SAMPLE_ROWS rows, the same ones however the table is cut.
    by_hash = [F.xxhash64("vec_id", "vector"), F.col("vec_id")]
    sample = rows.orderBy(*by_hash).limit(SAMPLE_ROWS).toArrow()
    if not sample.num_rows:
        return None
    width = rows.agg(F.max(F.size("vector"))).first()[0]
    lists = sample["vector"].combine_chunks()
    router = Router.of(sample["vec_id"].to_numpy(), sample["label"].to_numpy(), matrix(lists, width))
    schema = T.StructType.fromDDL(ROWS)
    first = spark.sparkContext.broadcast(router)
    placed = staged(
        importable(rows).mapInArrow(partial(_place, router=first, schema=arrow_schema(schema)), schema),
        "vector-cells",
    )
    schema = T.StructType.fromDDL(
        "cell int, node int, point int, near double, far double, short double, long double, n long"
    )
    ranges = importable(placed).mapInArrow(partial(_ranges, router=first, schema=arrow_schema(schema)), schema)
    # One row for each split point above each cell: bounded by the shape of the upper levels.
    found = (
        ranges.groupBy("cell", "node", "point")
        .agg(F.min("near"), F.max("far"), F.min("short"), F.max("long"), F.sum("n"))
        .orderBy("cell", "node", "point")
        .collect()
    )
    _set_ranges(router, found)
    shared = spark.sparkContext.broadcast(router)
    n_blocks = F.array(*[F.lit(int(n)) for n in router.blocks])[F.col("cell")]
    block = F.col("cell").cast("long") * (1 << 32) + F.pmod("place", n_blocks)
    return Index(placed.select("vec_id", "label", "vector", block.alias("block")), shared)


def _set_ranges(router: Router, found: list) -> None:
    router.blocks = np.zeros(router.cells, np.int64)
    by_node: dict[tuple, list] = {}
    for r in found:
        router.blocks[r[0]] = -(-r[7] // BLOCK_ROWS)
        by_node.setdefault((r[0], r[1]), []).append(r)
    above: dict[int, list[np.ndarray]] = {}
    for cell, points in router.points:
        above.setdefault(cell, []).append(points)
    for (cell, number), rows in by_node.items():
        if cell in above:
            near, far = (np.array([[r[i]] for r in rows]) for i in (3, 4))
            short, long = np.array([rows[0][5]]), np.array([rows[0][6]])
            router.ranges.append(Node(above[cell][number], near, far, short, long, [cell]))


def search(index: Index, queries: DataFrame, k: int, same_label: bool) -> DataFrame:
    """(query, vec_id, score, rank): the ``k`` best rows of each query (query, vec_id, label,
    vector, low, high) with scores from ``low`` to ``high`` and its label, or any other."""
    n_parts = max(1, -(-queries.count() // QUERY_ROWS))
    schema = T.StructType.fromDDL(ROUTED)
    route = partial(_route, router=index.router, k=k, same=same_label, parts=n_parts, schema=arrow_schema(schema))
    routed = importable(queries.select("query", "vec_id", "label", "vector", "low", "high")).mapInArrow(route, schema)
    # Blocks of rows meet blocks of queries: the rows go once to each block of queries.
    part = F.explode(F.sequence(F.lit(0), F.lit(n_parts - 1)))
    none = F.lit(None).cast("long")
    rows = index.rows.withColumn("part", part).select(
        (F.col("block") * n_parts + F.col("part")).alias("block"), F.lit(0).alias("kind"), "vec_id", "label",
        "vector", none.alias("query"), none.alias("low"), none.alias("high"),
    )
    met = (
        rows.unionByName(routed)
        .repartition(shuffle_partitions(rows), "block")
        .sortWithinPartitions("block", "kind")
    )
    schema = T.StructType.fromDDL(FOUND)
    run = partial(_meet, router=index.router, k=k, same=same_label, schema=arrow_schema(schema))
    found = importable(met).mapInArrow(run, schema)
    best = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def _queries(batch: pa.RecordBatch, width: int) -> dict:
    out = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("query", "vec_id", "label", "low", "high")}
    return out | {"vector": matrix(batch.column("vector"), width)}


def _route(
    batches: Iterator[pa.RecordBatch], router, k: int, same: bool, parts: int, schema: pa.Schema
) -> Iterator[pa.RecordBatch]:
    """Each query once for each block that it cannot leave out."""
    own = router.value
    for whole in batches:
        for begin in range(0, whole.num_rows, QUERY_BATCH):
            batch = whole.slice(begin, QUERY_BATCH)
            queries = _queries(batch, own.width)
            queries["low"] = own.known(queries, k, same)
            query, cell = np.nonzero(own.may_hold(queries))
            n = own.blocks[cell]
            row = np.repeat(query, n)
            number = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            block = (np.repeat(cell, n) << 32) + number
            # A query belongs to one block of queries.
            block = block * parts + queries["query"][row] % parts
            for some in range(0, len(row), QUERY_BATCH):
                at = row[some : some + QUERY_BATCH]
                take = pa.array(at)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(block[some : some + QUERY_BATCH]),
                        pa.array(np.ones(len(at), np.int32)),
                        batch.column("vec_id").take(take),
                        batch.column("label").take(take),
                        batch.column("vector").take(take).cast(schema.field("vector").type),
                        batch.column("query").take(take),
                        pa.array(queries["low"][at]),
                        batch.column("high").take(take),
                    ],
                    schema=schema,
                )


def _meet(
    batches: Iterator[pa.RecordBatch], router, k: int, same: bool, schema: pa.Schema
) -> Iterator[pa.RecordBatch]:
    """Rows of a block, then its queries, block after block."""
    width = router.value.width
    block, rows, tree = None, [], None
    for batch in batches:
        blocks, kinds = batch.column("block").to_numpy(), batch.column("kind").to_numpy()
        edges = np.flatnonzero((np.diff(blocks) != 0) | (np.diff(kinds) != 0)) + 1
        for begin, end in zip([0, *edges], [*edges, batch.num_rows]):
            if begin == end:
                continue
            part = batch.slice(begin, end - begin)
            if blocks[begin] != block:
                block, rows, tree = blocks[begin], [], None
            if kinds[begin] == 0:
                rows.append(part)
                continue
            if tree is None:
                together = pa.Table.from_batches(rows).combine_chunks().to_batches()[0] if rows else None
                if together is None:
                    continue
                tree = BlockTree(
                    together.column("vec_id").to_numpy(), together.column("label").to_numpy(),
                    matrix(together.column("vector"), width),
                )
                rows = []
            for some in range(0, part.num_rows, QUERY_BATCH):
                queries = _queries(part.slice(some, QUERY_BATCH), width)
                query, row, score = Search(tree, queries, k, same).found()
                columns = [queries["query"][query], tree.ids[row], score]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=schema)


def mine(
    vectors: DataFrame,
    is_anchor: Column,
    n_positives: int = 5,
    n_negatives: int = 5,
    low_percent: int = 80,
    high_percent: int = 100,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: hard negatives
    of the rows (vec_id, label, embedding) for which ``is_anchor`` holds. Scores of negatives lie
    between these percentages of that of the positive."""
    spark = vectors.sparkSession
    schema = T.StructType.fromDDL(
        "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    )
    index = build_index(vectors)
    if index is None:
        return spark.createDataFrame([], schema)
    anchors = staged(
        index.rows.filter(is_anchor).select(
            F.monotonically_increasing_id().alias("anchor"), "vec_id", "label", "vector"
        ),
        "anchors",
    )
    every = anchors.withColumns({"query": F.col("anchor"), "low": F.lit(LEAST), "high": F.lit(MOST)})
    positives = search(index, every, n_positives, same_label=True).select(
        F.col("query").alias("anchor"), F.col("vec_id").alias("positive_id"),
        F.col("score").alias("positive_score"), F.col("rank").alias("positive"),
    )

    def percent(p: int, up: int) -> Column:
        """That part of the score, to the next integer above (``up`` 99) or below (0)."""
        hundreds = F.expr("(positive_score - pmod(positive_score, 100)) div 100")
        rest = F.pmod("positive_score", F.lit(100)) * p + up
        return hundreds * p + F.floor(rest / 100)

    windows = staged(
        anchors.join(positives, "anchor").withColumns(
            {
                "query": F.col("anchor") * n_positives + F.col("positive") - 1,
                "low": percent(low_percent, 99).cast("long"),
                "high": percent(high_percent, 0).cast("long"),
            }
        ),
        "windows",
    )
    found = search(index, windows.filter("low <= high"), n_negatives, same_label=False).select(
        "query", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")
    )
    return (
        windows.select("query", F.col("vec_id").alias("anchor_id"), "positive_id", "positive_score")
        .join(found, "query")
        .select(*schema.names)
    )


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(vectors.withColumn("label", label), F.col("vec_id") % 100 == 0)
