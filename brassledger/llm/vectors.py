"""Embedding near-duplicates by int8 tile products with proven error bounds.

Vectors of a label are dealt into blocks of bounded bytes. Two blocks make a
tile, whose int8 products cost one matrix product. For unit vectors u = s*q + e
(q int8, e the exact residual) the product of the quantised vectors is off by at
most |e_u||s_v q_v| + |s_u q_u||e_v| + |e_u||e_v|, so only pairs whose product
plus that bound reaches the threshold are recomputed in double precision. A
tile returns link counts and a spanning forest of its links, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, materialize, short_batches
from .components import connected_components

THRESHOLD = 0.93
#: Components (rows times dimensions) of a block: 8192 vectors of 64. A block is
#: sent to every other one of its label, so larger blocks are sent less often.
BLOCK_CELLS = 1 << 19
#: Blocks of a label at least, if it has so many rows, so that tasks share it.
LEAST_BLOCKS, LEAST_ROWS = 8, 512
#: Vectors on each side of one matrix product.
TILE = 1024
SLACK = 1e-9


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scale, norm of the quantised vector and norm of its residual."""
    scale = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    near = codes * scale[:, None]
    return codes, scale, np.linalg.norm(near, axis=1), np.linalg.norm(unit - near, axis=1)


def _scaled(x: np.ndarray) -> np.ndarray:
    """Vectors times powers of two, which keeps their cosines, so that squares
    neither overflow nor vanish."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def tile_links(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Boolean matrix: cosine of x[i] and y[j] in double precision >= threshold."""
    x, y = _scaled(x), _scaled(y)
    nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    (qx, sx, mx, ex), (qy, sy, my, ey) = quantise(x / nx[:, None]), quantise(y / ny[:, None])
    # Products of int8 codes are whole numbers that single precision holds
    # exactly up to 1024 dimensions; wider vectors are added up in slices.
    near = np.zeros((len(x), len(y)))
    for at in range(0, x.shape[1], 1024):
        near += qx[:, at : at + 1024].astype(np.float32) @ qy[:, at : at + 1024].astype(np.float32).T
    near *= sx[:, None] * sy[None, :]
    near += np.outer(ex, my) + np.outer(mx, ey) + np.outer(ex, ey)
    i, j = np.nonzero(near >= threshold - SLACK)
    linked = np.zeros((len(x), len(y)), bool)
    step = max(1, (1 << 22) // max(1, x.shape[1]))
    for at in range(0, len(i), step):
        a, b = i[at : at + step], j[at : at + step]
        linked[a, b] = np.einsum("ij,ij->i", x[a], y[b]) / (nx[a] * ny[b]) >= threshold
    return linked


def forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Cells of ``linked`` that connect rows and columns as all its cells do."""
    rows, cols = linked.any(axis=1), linked.any(axis=0)
    cells = []
    while rows.any():
        front = [(int(rows.argmax()), True)]
        rows[front[0][0]] = False
        while front:
            k, is_row = front.pop()
            line, left = (linked[k], cols) if is_row else (linked[:, k], rows)
            found = np.flatnonzero(line & left)
            left[found] = False
            cells += [(k, int(f)) if is_row else (int(f), k) for f in found]
            front += [(int(f), not is_row) for f in found]
    return cells


def _members(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    out = []
    for row in column:
        rows = row.values
        ids, copies = rows.field("cls").to_numpy(), rows.field("copies").to_numpy()
        flat = rows.field("v").flatten().to_numpy().astype(np.float64)
        out.append((ids, copies, flat.reshape(len(ids), -1)))
    return out


def _one_tile(left: tuple, right: tuple, own: bool, threshold: float) -> pa.RecordBatch:
    """(a, -1, links of a with the other side) and (a, b, 0) for a forest's links."""
    (ids, copies, x), (jds, jopies, y) = left, right
    linked = tile_links(x, y, threshold)
    if own:
        np.fill_diagonal(linked, False)
    out = [(ids, linked @ jopies)] + ([] if own else [(jds, linked.T @ copies)])
    cells = np.array(forest(linked), np.int64).reshape(-1, 2)
    a = np.concatenate([*(i[n > 0] for i, n in out), ids[cells[:, 0]]])
    n = np.concatenate([*(n[n > 0] for _, n in out), np.zeros(len(cells), np.int64)])
    b = np.concatenate([np.full(len(a) - len(cells), -1, np.int64), jds[cells[:, 1]]])
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(n.astype(np.int64))], ["a", "b", "n"])


def _tiles(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = batch.column(0).to_pylist()
            for own, (ids, copies, x), (jds, jopies, y) in zip(
                same, _members(batch.column(1)), _members(batch.column(2)), strict=True
            ):
                for i in range(0, len(ids), TILE):
                    for j in range(i if own else 0, len(jds), TILE):
                        p, q = slice(i, i + TILE), slice(j, j + TILE)
                        yield _one_tile((ids[p], copies[p], x[p]), (jds[q], jopies[q], y[q]), own and i == j, threshold)

    return run


def near_vectors(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    threshold: float = THRESHOLD,
    block_cells: int = BLOCK_CELLS,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row for each row.

    Rows link if their labels are equal and not null, their dimensions are
    equal and their cosine is at least ``threshold``. Null, empty and zero
    vectors, and those with a null or non-finite component, link with nothing:
    0 links, their own component. Equal vectors of a label are one class, so
    copies are counted without being paired. Rows that repeat an id count as
    rows of their own; a null id is a component of its own unless it links.
    """
    short_batches(vectors.sparkSession)
    v = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"), F.col(label_col).alias("label")
    )
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    usable = F.coalesce(
        F.col("label").isNotNull() & (F.size("v") > 0) & F.forall("v", fine) & F.exists("v", lambda x: x != 0), F.lit(False)
    )
    v = v.withColumn("usable", usable)
    classes = (
        v.where("usable")
        .groupBy("label", "v")
        .agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
        .withColumn("dim", F.size("v"))
    )
    # A class is named by a number of its own: ids may be null or shared.
    classes = materialize(classes.withColumn("cls", F.monotonically_increasing_id()), "vector-classes")
    sizes = classes.groupBy("label", "dim").agg(F.count("*").alias("n"))
    per_block = F.greatest(F.lit(64), F.floor(F.lit(block_cells) / F.col("dim")))
    shared = F.least(F.lit(LEAST_BLOCKS), F.ceil(F.col("n") / LEAST_ROWS))
    sizes = sizes.select("label", "dim", F.greatest(shared, F.ceil(F.col("n") / per_block)).cast("int").alias("blocks"))
    blocks = (
        classes.join(sizes, ["label", "dim"])
        .withColumn("block", F.pmod(F.xxhash64("cls"), "blocks").cast("int"))
        .groupBy("label", "dim", "block", "blocks")
        .agg(F.collect_list(F.struct("cls", "copies", "v")).alias("rows"))  # a block's rows are bounded
    )
    blocks = materialize(blocks, "vector-blocks")
    # A pair of blocks is a key of its own, so that no key carries more than two blocks.
    own, every = F.col("block"), F.col("blocks")
    left = blocks.select("label", "dim", own.alias("i"), F.explode(F.sequence(own, every - 1)).alias("j"), F.col("rows").alias("x"))
    right = blocks.select("label", "dim", F.explode(F.sequence(F.lit(0), own)).alias("i"), own.alias("j"), F.col("rows").alias("y"))
    tiles = left.join(right, ["label", "dim", "i", "j"]).select((F.col("i") == F.col("j")).alias("own"), "x", "y")
    with arrow_rows(vectors.sparkSession, 2):  # a row is two blocks
        found = materialize(tiles.mapInArrow(_tiles(threshold), "a long, b long, n long"), "vector-links")
    counts = found.where("b = -1").groupBy(F.col("a").alias("cls")).agg(F.sum("n").alias("n"))
    comp = connected_components(found.where("b <> -1").select("a", "b"))
    tagged = (
        classes.select("label", "v", "cls", "copies", "least")
        .join(counts, "cls", "left")
        .join(comp.select(F.col("node").alias("cls"), "component"), "cls", "left")
        .withColumn("root", F.coalesce("component", "cls"))
    )
    ids = tagged.groupBy("root").agg(F.min("least").alias("component_id"))
    named = materialize(
        tagged.join(ids, "root").select(
            "label", "v", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"
        ),
        "vector-components",
    )
    linked = v.where("usable").join(named, ["label", "v"]).select("vec_id", "n_links", "component_id")
    alone = v.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
