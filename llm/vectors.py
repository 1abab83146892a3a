"""Near-duplicate vectors by a subspace pigeonhole join.

Unit vectors with a cosine of at least c differ by a squared distance of at most D = 2 (1 - c). All
vectors are turned by one fixed random rotation and split into blocks of equal dimension. If two
vectors are that close, then in at least one block their squared distance is at most the block's
proportional share, D / blocks. Each block is a range join: vectors are cut into strips along the
block's first axis, as wide as the share's root, and each strip meets itself and the next one. Pairs
within the share are confirmed on whole vectors in double precision, and a pair is counted only in
the first block that finds it, so the union of the blocks is exact and nothing is counted twice.

Equal vectors of a label are folded into one class with a count before the join. Strips are split
into chunks of bounded size and chunk meets chunk, so no strip, however full, is one task's work.
Pairs are not listed: a cell returns, for each vector, how many links it has, and a spanning forest
of its links.

Cases: vectors that are null, empty, zero, or hold nulls, NaN or infinities, and rows without a
label, link with nothing and are their own component. Vectors of different lengths link with
nothing. Equal vec_ids are kept as separate rows and share their component; rows with a null vec_id
link with nothing. Other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import components, cut

BLOCKS = 8
#: Vectors of a strip that one chunk takes.
CHUNK = 2_000
#: Allows for rounding in the search; links themselves are decided in double precision.
SLACK = 1e-9


def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.Generator(np.random.PCG64(9)).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def edges_of(dim: int, blocks: int) -> list[int]:
    return [dim * b // min(blocks, dim) for b in range(min(blocks, dim) + 1)]


def shares(dim: int, blocks: int, cosine: float) -> np.ndarray:
    """Each block's part of the squared distance, by its dimensions."""
    return 2 * (1 - cosine) * np.diff(edges_of(dim, blocks)) / dim + SLACK


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _unit(matrix: np.ndarray) -> np.ndarray:
    # scaled first, so that squares neither overflow nor vanish
    matrix = matrix / np.abs(matrix).max(axis=1, keepdims=True)
    return matrix / np.sqrt(np.einsum("ij,ij->i", matrix, matrix))[:, None]


def _strips(vectors: DataFrame, cosine: float, blocks: int) -> DataFrame:
    """For each vector its strip in every block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.diff(batch.column(2).offsets.to_numpy())
            strips: list = [None] * batch.num_rows
            for dim in np.unique(lengths):
                rows = np.flatnonzero(lengths == dim)
                turned = _unit(_matrix(batch.column(2).take(pa.array(rows)), int(dim))) @ rotation(int(dim))
                edges = edges_of(int(dim), blocks)
                cells = np.floor(turned[:, edges[:-1]] / np.sqrt(shares(int(dim), blocks, cosine))).astype(np.int32)
                for row, cell in zip(rows.tolist(), cells.tolist()):
                    strips[row] = cell
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(strips, pa.list_(pa.int32()))], names=[*batch.schema.names, "strips"])

    columns = "class_id long, label " + vectors.schema["label"].dataType.simpleString() + ", vector array<double>, copies long, strips array<int>"
    return vectors.select("class_id", "label", "vector", "copies").mapInArrow(run, columns)


def _cell(group: pa.Table, cosine: float, blocks: int) -> pa.Table:
    """Links between vectors of a cell: counts for each, and a spanning forest."""
    block = group.column("block")[0].as_py()
    ids = group.column("class_id").to_numpy()
    copies = group.column("copies").to_numpy()
    home = group.column("side").to_numpy(zero_copy_only=False)
    same = group.column("same")[0].as_py()
    column = group.column("vector").combine_chunks()
    dim = len(column[0])
    unit = _unit(_matrix(column, dim))
    turned = unit @ rotation(dim)
    edges, share = edges_of(dim, blocks), shares(dim, blocks, cosine)
    left, right = np.flatnonzero(home == 0), np.flatnonzero(home == 0 if same else home == 1)
    counts = np.zeros(len(ids), np.int64)
    parent = np.arange(len(ids))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    forest = []

    def near(u: np.ndarray, v: np.ndarray, b: int) -> np.ndarray:
        x, y = turned[u, edges[b] : edges[b + 1]], turned[v, edges[b] : edges[b + 1]]
        return (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * x @ y.T <= share[b]

    for at in range(0, len(left), 256):
        u = left[at : at + 256]
        x, y = np.nonzero(near(u, right, block))
        if same:
            x, y = x[u[x] < right[y]], y[u[x] < right[y]]
        a, b = u[x], right[y]
        for lo in range(0, len(a), 200_000):
            p, q = a[lo : lo + 200_000], b[lo : lo + 200_000]
            fits = np.einsum("ij,ij->i", unit[p], unit[q]) >= cosine
            p, q = p[fits], q[fits]
            gaps = np.add.reduceat((turned[p] - turned[q]) ** 2, edges[:-1], axis=1) if len(p) else np.empty((0, len(share)))
            # the first block that finds the pair counts it; the search's own rounding is settled the same way in every block
            first = np.argmax(gaps <= share - SLACK / 2, axis=1) == block
            p, q = p[first], q[first]
            np.add.at(counts, p, copies[q])
            np.add.at(counts, q, copies[p])
            for i, j in zip(p.tolist(), q.tolist()):
                i, j = root(i), root(j)
                if i != j:
                    parent[i] = j
                    forest.append((i, j))
    some = np.flatnonzero(counts)
    rows = [(int(ids[i]), None, int(counts[i])) for i in some] + [(int(ids[i]), int(ids[j]), 0) for i, j in forest]
    return pa.table({k: pa.array(c, pa.int64()) for k, c in zip(("a", "b", "links"), zip(*rows) if rows else ((), (), ()))})


def near_duplicates(spark: SparkSession, vectors: DataFrame, cosine: float = 0.93, blocks: int = BLOCKS) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    vector = F.col("embedding").cast("array<double>")
    sound = F.coalesce(
        F.col("label").isNotNull() & F.col("vec_id").isNotNull() & (F.size("embedding") > 0)
        & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
        & F.exists(vector, lambda x: x != 0),
        F.lit(False),
    )
    print_ = F.when(sound, F.md5(F.to_json(F.struct(vector.alias("v"), "label"))))
    rows = cut(spark, vectors.select("vec_id", "label", vector.alias("vector"), print_.alias("print")), "vectors")
    classes = rows.where("print is not null").groupBy("print").agg(F.min("vec_id").alias("class_id"), F.count("*").alias("copies"))
    named = cut(spark, rows.select("vec_id", "print").join(classes, "print", "left"), "classes")
    # one row for each class; the label tells apart classes that an equal vec_id would join
    heads = rows.where("print is not null").select("label", "vector", "print", F.col("vec_id").alias("class_id")).join(classes, ["print", "class_id"]).dropDuplicates(["print"])
    strips = cut(spark, _strips(heads, cosine, blocks), "strips")

    placed = strips.select("class_id", "label", "copies", "vector", F.posexplode("strips").alias("block", "strip"), F.size("vector").alias("dim"))
    key = ["label", "dim", "block", "strip"]
    full = placed.groupBy(key).agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    following = full.select("label", "dim", "block", (F.col("strip") - 1).alias("strip"), F.col("chunks").alias("after"))
    before = full.select("label", "dim", "block", (F.col("strip") + 1).alias("strip"), F.col("chunks").alias("before"))
    plan = full.join(following, key, "left").join(before, key, "left").na.fill(0, ["after", "before"])
    chunk = F.pmod(F.xxhash64("class_id"), F.col("chunks")).cast("int")
    # cell: strip, place of the other side (0 this strip, 1 the next), chunk of each side; side 0 stands in the cell's own strip
    def cell(strip, nxt, i, j, side):
        return F.struct(strip.alias("strip"), F.lit(nxt).alias("next"), i.alias("i"), j.alias("j"), F.lit(side).alias("side"))

    none = F.array().cast("array<struct<strip:int,next:int,i:int,j:int,side:int>>")
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    own = F.transform(upto(F.col("chunks")), lambda o: F.when(o >= F.col("chunk"), cell(F.col("strip"), 0, F.col("chunk"), o, 0)).otherwise(cell(F.col("strip"), 0, o, F.col("chunk"), 1)))
    ahead = F.transform(upto(F.col("after")), lambda o: cell(F.col("strip"), 1, F.col("chunk"), o, 0))
    behind = F.transform(upto(F.col("before")), lambda o: cell(F.col("strip") - 1, 1, o, F.col("chunk"), 1))
    cells = placed.join(plan, key).withColumn("chunk", chunk).select("class_id", "label", "dim", "block", "copies", "vector", F.explode(F.concat(none, own, ahead, behind)).alias("c"))
    cells = cells.select("class_id", "label", "dim", "block", "copies", "vector", F.col("c.strip").alias("at"), F.col("c.next").alias("next"), F.col("c.i").alias("i"), F.col("c.j").alias("j"), F.col("c.side").alias("side"))
    cells = cells.withColumn("same", (F.col("next") == 0) & (F.col("i") == F.col("j")))
    found = cells.groupBy("label", "dim", "block", "at", "next", "i", "j").applyInArrow(lambda t: _cell(t, cosine, blocks), "a long, b long, links long")
    found = cut(spark, found, "links")

    counts = found.where("b is null").groupBy(F.col("a").alias("class_id")).agg(F.sum("links").alias("links"))
    settled = components(spark, found.where("b is not null").select("a", "b")).select(F.col("node").alias("class_id"), "component")
    out = named.join(counts, "class_id", "left").join(settled, "class_id", "left")
    return out.select(
        "vec_id",
        F.when(F.col("print").isNull(), F.lit(0)).otherwise(F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"),
        F.coalesce("component", "class_id", "vec_id").alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
