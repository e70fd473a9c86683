"""Vector code compression: product codebooks whose nearest entry a GNAT finds.

Every vector is scaled to integers, cut into parts, and each part is replaced by
the number of the nearest entry of its position's codebook; a few rounds of
assigning and averaging fit the codebooks to all rows. All arithmetic is on
integers, so results do not depend on partitioning.

The entries of a codebook form a geometric near-neighbour access tree (Brin,
"Near Neighbor Search in Large Metric Spaces", VLDB 1995): a node has a few
split points, each with the entries nearest to it as a child, and stores for
each split point and child the range of distances between them. A query at
distance d of a split point and r of its best entry so far skips a child whose
range lies outside [d - r, d + r]. Distances are rounded away from each other
before the test, so a child is skipped only if all of its entries are farther
than the best one; what is left is compared by exact squared distance, then by
index.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_rows, join_hot, materialize, short_batches

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Split points of a GNAT node.
DEGREE = 4
#: Components of the vectors that one numpy step takes.
STEP_CELLS = 1 << 19
#: Components above this in size are clipped to it, as a cast to long does.
LIMIT = (1 << 63) - 1


# --- the tree ---


def _squares(rows: np.ndarray, entry: np.ndarray) -> np.ndarray:
    apart = rows - entry
    return (apart * apart).sum(axis=1)


def roots(squares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Square roots of whole numbers rounded down and up, exactly."""
    if squares.dtype == object:
        down = np.array([isqrt(int(s)) for s in squares], object)
    else:
        down = np.sqrt(squares.astype(np.float64)).astype(np.int64)
        down -= down * down > squares
        down += (down + 1) * (down + 1) <= squares
    return down, down + (down * down < squares)


@dataclass
class Node:
    """Split points by number, the node below each, and for each pair (split
    point, child) the least and greatest distance, rounded down and up."""

    splits: list[int]
    children: list[Node | None]
    low: list[list[int]]
    high: list[list[int]]


def build(entries: np.ndarray, numbers: list[int], degree: int = DEGREE) -> Node | None:
    """The tree over ``entries[numbers]``. Split points are chosen far apart, the
    first number first; equal entries end up below one of them."""
    if not numbers:
        return None
    splits, gap = [numbers[0]], _squares(entries[numbers], entries[numbers[0]])
    while len(splits) < min(degree, len(numbers)):
        far = int(np.argmax(gap))
        if gap[far] == 0:
            break
        splits.append(numbers[far])
        gap = np.minimum(gap, _squares(entries[numbers], entries[numbers[far]]))
    below: list[list[int]] = [[] for _ in splits]
    for n in numbers:
        if n not in splits:
            to = [int(_squares(entries[[s]], entries[n])[0]) for s in splits]
            below[to.index(min(to))].append(n)
    low, high = [], []
    for s in splits:
        ranges = [roots(_squares(entries[[t, *b]], entries[s])) for t, b in zip(splits, below, strict=True)]
        low.append([int(down.min()) for down, _ in ranges])
        high.append([int(up.max()) for _, up in ranges])
    return Node(splits, [build(entries, b, degree) for b in below], low, high)


def nearest(node: Node | None, entries: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(entry number, squared distance) of each row's nearest entry, the lower
    number on ties, and how many distances were computed."""
    best = np.full(len(rows), len(entries), np.int64)
    found = np.zeros(len(rows), rows.dtype)
    computed = 0

    def visit(node: Node, at: np.ndarray) -> None:
        nonlocal computed
        open_ = np.ones((len(at), len(node.splits)), bool)
        for i, s in enumerate(node.splits):
            k = np.flatnonzero(open_[:, i])
            if not len(k):
                continue
            here = at[k]
            squares = _squares(rows[here], entries[s])
            computed += len(k)
            first = best[here] == len(entries)
            better = first | (squares < found[here]) | ((squares == found[here]) & (s < best[here]))
            best[here[better]], found[here[better]] = s, squares[better]
            down, up = roots(squares)
            radius = roots(found[here])[1]
            for j in range(len(node.splits)):
                outside = (down - radius > node.high[i][j]) | (up + radius < node.low[i][j])
                open_[k[outside], j] = False
        for j, child in enumerate(node.children):
            if child is not None:
                left = at[open_[:, j]]
                if len(left):
                    visit(child, left)

    if node is not None and len(rows):
        visit(node, np.arange(len(rows)))
    return best, found, computed


# --- vectors ---


def _safe(dim: int) -> int:
    """Components below this leave every squared distance of two vectors within int64."""
    return isqrt((1 << 60) // max(1, dim))


def whole(x: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x); int64 where all squared distances surely fit in it, else Python integers."""
    # Powers of two scale exactly; others as the product in double precision does.
    with np.errstate(over="ignore"):
        up = np.floor(np.nan_to_num(x * float(scale), posinf=1e300, neginf=-1e300))
    if np.abs(up).max(initial=0) < _safe(x.shape[1]):
        return up.astype(np.int64)
    return np.array([min(LIMIT, max(-LIMIT - 1, int(v))) for v in up.ravel()], object).reshape(up.shape)


def cuts(dim: int, parts: int) -> list[slice]:
    """Consecutive parts; where ``parts`` does not divide ``dim`` the first ones are longer by one."""
    size, more = divmod(dim, parts)
    ends = [p * size + min(p, more) for p in range(parts + 1)]
    return [slice(a, b) for a, b in zip(ends, ends[1:], strict=False)]


class Books:
    """The codebooks of one length of vectors, with their trees."""

    def __init__(self, entries: list[np.ndarray]):
        self.entries = entries
        self.trees = [build(e, list(range(len(e)))) for e in entries]
        self.parts = len(entries)

    def assign(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry numbers (rows x parts) and squared distances of the parts."""
        codes, errors = [], []
        for p, cut in enumerate(cuts(rows.shape[1], self.parts)):
            entries = self.entries[p]
            # int64 only where both sides are; a product of mixed ones would wrap round.
            part = rows[:, cut].astype(object) if entries.dtype == object else rows[:, cut]
            entries = entries.astype(object) if rows.dtype == object else entries
            code, error, _ = nearest(self.trees[p], entries, part)
            codes.append(code)
            errors.append(error)
        return np.stack(codes, 1), np.stack(errors, 1)

    def text(self) -> str:
        return ",".join(str(int(v)) for e in self.entries for v in e.ravel())


def _stepped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, pa.RecordBatch]]:
    """(length, vectors, rows) for the rows of each length in each piece of the input."""
    for batch in batches:
        lengths = np.asarray(pc.list_value_length(batch["v"]))
        for dim in np.unique(lengths):
            rows = batch.filter(pa.array(lengths == dim))
            step = max(1, STEP_CELLS // max(1, int(dim)))
            for at in range(0, rows.num_rows, step):
                piece = rows.slice(at, step)
                flat = piece["v"].flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                yield int(dim), flat.reshape(piece.num_rows, int(dim)), piece


def _sums(books: dict[int, Books], scale: int):
    """(dim, part, entry, n, sums) over a task's rows: at most parts x entries rows a length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[tuple, int] = {}
        sums: dict[tuple, np.ndarray] = {}
        for dim, x, _ in _stepped(batches):
            rows = whole(x, scale)
            codes, _ = books[dim].assign(rows)
            for p, cut in enumerate(cuts(dim, books[dim].parts)):
                for e in np.unique(codes[:, p]):
                    mine = rows[codes[:, p] == e, cut]
                    key = (dim, p, int(e))
                    n[key] = n.get(key, 0) + len(mine)
                    # A piece's sum fits in int64 (under 2**31 a component, STEP_CELLS rows); a task's is a Python integer.
                    sums[key] = sums.get(key, 0) + mine.sum(axis=0).astype(object)
        keys = sorted(n)
        yield pa.RecordBatch.from_pydict(
            {
                "dim": pa.array([k[0] for k in keys], pa.int32()),
                "part": pa.array([k[1] for k in keys], pa.int32()),
                "entry": pa.array([k[2] for k in keys], pa.int32()),
                "n": pa.array([n[k] for k in keys], pa.int64()),
                "sums": pa.array([[Decimal(int(v)) for v in sums[k]] for k in keys], pa.list_(pa.decimal128(38, 0))),
            }
        )

    return run


def _encoded(books: dict[int, Books], digests: dict[int, str], scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, x, rows in _stepped(batches):
            codes, errors = books[dim].assign(whole(x, scale))
            total = [min(LIMIT, int(t)) for t in errors.astype(object).sum(axis=1)]
            yield pa.RecordBatch.from_arrays(
                [
                    rows["vec_id"], rows["label"],
                    pa.array(["".join(f"{c:02x}" for c in row) for row in codes.tolist()]),
                    pa.array(total, pa.int64()), pa.array([digests[dim]] * len(total)),
                ],
                ["vec_id", "label", "code", "error", "codebooks_sha256"],
            )

    return run


def usable(vector: Column) -> Column:
    """Not null, and no component null, NaN or infinite."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(vector.isNotNull() & F.forall(vector, fine), F.lit(False))


def _fit(kept: DataFrame, parts: int, entries: int, rounds: int, scale: int) -> dict[int, Books]:
    """Codebooks by length of vector. The driver holds entries x length integers a length, never rows."""
    first = Window.partitionBy("dim").orderBy(F.col("vec_id").asc_nulls_last(), "v")
    start = kept.select("vec_id", "v", F.size("v").alias("dim")).withColumn("place", F.row_number().over(first)).where(F.col("place") <= entries)
    seeds: dict[int, list] = {}
    for row in start.orderBy("dim", "place").collect():  # at most `entries` rows a length
        seeds.setdefault(row.dim, []).append(list(row.v))
    books = {}
    for dim, rows in seeds.items():
        x = whole(np.array(rows, np.float64).reshape(len(rows), dim), scale)
        books[dim] = Books([x[:, cut] for cut in cuts(dim, parts)])
    for _ in range(rounds):
        partial = kept.select("v").mapInArrow(_sums(books, scale), "dim int, part int, entry int, n long, sums array<decimal(38,0)>")
        by = ["dim", "part", "entry"]
        cells = partial.select(*by, "n", F.posexplode_outer("sums").alias("at", "s")).groupBy(*by, "at").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
        new = {dim: [e.copy() for e in b.entries] for dim, b in books.items()}
        for r in cells.where("at IS NOT NULL").collect():  # a row a component of an entry
            value = int(r.s) // int(r.n)
            if new[r.dim][r.part].dtype != object and abs(value) >= _safe(r.dim):
                new[r.dim][r.part] = new[r.dim][r.part].astype(object)
            new[r.dim][r.part][r.entry, r.at] = value
        books = {dim: Books(e) for dim, e in new.items()}
    return books


def compressed(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256), one row for each usable row.

    Vectors that are null or hold a null or non-finite component are dropped, as
    the contract says; an empty vector is usable and costs nothing. Vectors of
    another length have codebooks of their own. The first entries are the vectors
    with the smallest ids, null ids last, repeated ids in order of the vectors;
    fewer rows than entries make a shorter codebook. Components and errors beyond
    the range of a long are clipped to it. Rows that repeat an id or a vector
    count as rows of their own. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    short_batches(spark)
    kept = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v")).where(usable(F.col("v")))
    kept = materialize(kept, "code-vectors")
    with arrow_rows(spark, 8192):
        books = _fit(kept, parts, entries, rounds, scale)
        digests = {dim: hashlib.sha256(b.text().encode()).hexdigest() for dim, b in books.items()}
        kinds = dict(kept.dtypes)
        schema = f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long, codebooks_sha256 string"
        coded = materialize(kept.mapInArrow(_encoded(books, digests, scale), schema), "codes")
    named = coded.withColumn("_label", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("null")))
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LIMIT).cast("decimal(38,0)")).cast("long")
    sums = materialize(named.groupBy("_label").agg(total.alias("label_error"), F.count("*").alias("_rows")), "code-labels")
    return join_hot(named, sums, "_label", "_rows").select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def oracle_sql() -> str:
    """The same in SQL (DuckDB) at the default parameters, for vectors of 64 components."""
    width = 64 // PARTS
    rounds = []
    for r in range(ROUNDS + 1):
        rounds.append(f"""
a{r} AS MATERIALIZED (
  SELECT vec_id, part, arg_min(entry, d * {ENTRIES} + entry) AS entry, min(d) AS d FROM (
    SELECT p.vec_id, p.part, b.entry, sum((p.x - b.x) * (p.x - b.x))::BIGINT AS d
    FROM p JOIN b{r} b ON p.part = b.part AND p.pos = b.pos GROUP BY ALL)
  GROUP BY ALL)""")
        if r < ROUNDS:
            rounds.append(f"""
b{r + 1} AS MATERIALIZED (
  SELECT b.part, b.entry, b.pos, coalesce(m.x, b.x) AS x
  FROM b{r} b LEFT JOIN (
    SELECT part, entry, pos, ((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS x
    FROM p JOIN a{r} USING (vec_id, part) GROUP BY ALL) m
  ON b.part = m.part AND b.entry = m.entry AND b.pos = m.pos)""")
    return f"""
WITH k AS MATERIALIZED (
  SELECT vec_id, label, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (
  SELECT vec_id, (i - 1) // {width} AS part, (i - 1) % {width} AS pos, floor({SCALE} * embedding[i]::DOUBLE)::BIGINT AS x
  FROM k, range(1, 65) r(i)),
b0 AS MATERIALIZED (
  SELECT part, s.place AS entry, pos, x
  FROM p JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS place FROM k ORDER BY vec_id LIMIT {ENTRIES}) s USING (vec_id)),{",".join(rounds)},
e AS (
  SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{ROUNDS} GROUP BY ALL)
SELECT e.vec_id, e.code, e.error, (sum(e.error) OVER (PARTITION BY k.label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, entry, pos)) FROM b{ROUNDS}) AS codebooks_sha256
FROM e JOIN k USING (vec_id)
"""
