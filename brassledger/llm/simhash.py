"""SimHash near-duplicates with the generalised pigeonhole principle.

Fingerprints of 64 bits are cut into m bit groups. If the thresholds t_i of
the groups add up to T - m + 1, any two fingerprints within T bits are within
t_i bits on some group i (t_i = -1 skips the group). Correlated bits are put in
the same group, and a dynamic programme shares out the thresholds by the
candidate counts that it expects from the bits' joint statistics over all
fingerprints. See Qin et al., "GPH: Similarity Search in Hamming Space" (ICDE
2018). The choice changes the cost only: every candidate is verified, and no
link is lost.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_hot, keep_least, materialize, row_hash, short_batches
from .components import connected_components

BITS = 64
SHINGLE = 3
SEED = 42
MAX_BITS = 3
#: Fingerprints in one bucket beyond which the bucket is dealt out again by
#: more bits. The split is exact too, so this bounds memory, not results.
BUCKET_ROWS = 4096
LEVELS = 3
#: What a key costs in units of one verified pair.
KEY_COST = 300.0


# --- fingerprints ---------------------------------------------------------


def fingerprint_of(text: str | None) -> int:
    """The fingerprint as an unsigned integer; 0 if the text has no word."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = list(itertools.accumulate(map(len, words), lambda a, n: a + 1 + n))
    starts = [0, *(x + 1 for x in ends[:-1])]
    k = min(SHINGLE, len(words))
    hashed = xxhash.xxh64_intdigest
    return majority(np.fromiter((hashed(line[a:b], SEED) for a, b in zip(starts, ends[k - 1 :], strict=False)), np.uint64))


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes, as an unsigned integer; 0 for none."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        bits = np.unpackbits(hashes[at : at + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: Column) -> Column:
    """The 64-bit fingerprint of a text column, as a signed long."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint_of(x) for x in texts], np.uint64).view(np.int64))

    return of(text)


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


# --- plan: groups of bits and their thresholds ----------------------------


def _joint_counts(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and how many have bits i and j both set."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((BITS, BITS)), 0
        for b in batches:
            x = np.unpackbits(b.column(0).to_numpy().astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            x = x.astype(np.float32)
            total += x.T @ x
            n += len(x)
        cells = np.append(total.reshape(-1), n).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells))), pa.array(cells)], ["cell", "n"])

    # Always 64 * 64 + 1 rows, whatever the input.
    rows = fps.select("fp").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    got = np.zeros(BITS * BITS + 1)
    for r in rows:
        got[r["cell"]] = r["n"]
    return int(got[-1]), got[:-1].reshape(BITS, BITS)


def _correlated_groups(corr: np.ndarray, m: int) -> list[list[int]]:
    left, groups = set(range(BITS)), []
    for i in range(m):
        size = (BITS - sum(map(len, groups))) // (m - i)
        seed = max(left, key=lambda b: (sum(corr[b, c] for c in left), -b))
        group = [seed]
        left.discard(seed)
        while len(group) < size:
            nxt = max(left, key=lambda b: (corr[b, group].mean(), -b))
            group.append(nxt)
            left.discard(nxt)
        groups.append(group)
    return groups


def _within(group: list[int], agree: np.ndarray, corr: np.ndarray) -> list[float]:
    """Chance that two fingerprints differ in exactly 0, 1, 2 bits of a group.

    A tree over the bits carries the strongest correlations: each bit's chance
    to agree is taken given that its nearest earlier bit agrees.
    """
    same = [agree[group[0], group[0]]]
    for k, b in enumerate(group[1:], 1):
        p = max(group[:k], key=lambda c: corr[b, c])
        same.append(min(1.0, agree[b, p] / max(agree[p, p], 1e-9)))
    p0 = float(np.prod(same))
    odds = [(1 - s) / max(s, 1e-9) for s in same]
    one = sum(odds)
    two = (one * one - sum(o * o for o in odds)) / 2
    return [p0, p0 * one, p0 * two]


def plan(n: int, both: np.ndarray, max_bits: int = MAX_BITS) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each group, at the least expected cost."""
    n1 = max(n, 1)
    one = np.diag(both) / n1
    pair = both / n1
    var = np.maximum(one * (1 - one), 1e-9)
    corr = np.abs(pair - np.outer(one, one)) / np.sqrt(np.outer(var, var))
    p11, p10 = pair, one[:, None] - pair
    p01, p00 = one[None, :] - pair, 1 - one[:, None] - one[None, :] + pair
    agree = p11**2 + p10**2 + p01**2 + p00**2
    agree[np.diag_indices(BITS)] = one**2 + (1 - one) ** 2
    best, chosen = math.inf, []
    for m in range(2, max_bits + 3):
        groups = _correlated_groups(corr, m)
        costs = []
        for g in groups:
            p, w = _within(g, agree, corr), len(g)
            half = n1 * n1 / 2
            # A pair meets in every key that masks all bits in which it differs.
            costs.append({-1: 0.0, 0: KEY_COST * n1 + half * p[0], 1: KEY_COST * n1 * w + half * (w * p[0] + p[1])})
            if w <= 32:
                costs[-1][2] = KEY_COST * n1 * w * (w - 1) / 2 + half * (w * (w - 1) / 2 * p[0] + (w - 1) * p[1] + p[2])
        need = max_bits - m + 1
        table: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for c in costs:
            step: dict[int, tuple[float, list[int]]] = {}
            for total, (cost, ts) in table.items():
                for t, extra in c.items():
                    if cost + extra < step.get(total + t, (math.inf,))[0]:
                        step[total + t] = (cost + extra, [*ts, t])
            table = step
        if need in table and table[need][0] < best:
            best, chosen = table[need][0], list(zip(groups, table[need][1], strict=True))
    return [(g, t) for g, t in chosen if t >= 0]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def _masks(groups: list[tuple[list[int], int]]) -> list[tuple[int, int]]:
    """(number, mask) of each kind of key: the group less up to t of its bits."""
    masks = [
        sum(1 << b for b in g) & ~sum(1 << b for b in out) for g, t in groups for out in itertools.combinations(g, t)
    ]
    return list(enumerate(map(_signed, masks)))


# --- probe and verify -----------------------------------------------------


def _tree(group: np.ndarray, max_bits: int, whole: int = 0) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links that join all of a bucket that is connected: at most one a row, but
    all links of what is connected and has up to ``whole`` rows."""
    a, b, open_ = [], [], group
    while open_.size > 1:
        front, open_, tree = [open_[0]], open_[1:], len(b)
        first = np.array(front, np.uint64)
        while front and open_.size:
            x = front.pop()
            near = np.bitwise_count(open_ ^ x) <= max_bits
            if near.any():
                found, open_ = open_[near], open_[~near]
                a.append(np.full(found.size, x, np.uint64))
                b.append(found)
                front.extend(found)
        if b[tree:] and (rows := np.concatenate([first, *b[tree:]])).size <= whole:
            i, j = np.nonzero(np.triu(np.bitwise_count(rows[:, None] ^ rows[None, :]) <= max_bits, 1))
            a[tree:], b[tree:] = [rows[i]], [rows[j]]
    return a, b


def _verify(max_bits: int, whole: int = 0):
    def links(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        edge = np.flatnonzero(np.diff(keys)) + 1
        starts = np.concatenate([[0], edge])
        sizes = np.diff(np.concatenate([starts, [len(keys)]]))
        a, b = [], []
        of_row = np.repeat(sizes, sizes)
        for s in range(1, 8):  # small buckets: each row with those after it
            i = np.flatnonzero((keys[:-s] == keys[s:]) & (of_row[:-s] <= 8)) if len(keys) > s else []
            if len(i):
                i = i[np.bitwise_count(fps[i] ^ fps[i + s]) <= max_bits]
                a.append(fps[i])
                b.append(fps[i + s])
        for k in np.flatnonzero(sizes > 8):
            x, y = _tree(fps[starts[k] : starts[k] + sizes[k]], max_bits, whole)
            a += x
            b += y
        a, b = (np.concatenate(x) if x else np.empty(0, np.uint64) for x in (a, b))
        lo, hi = np.minimum(a.view(np.int64), b.view(np.int64)), np.maximum(a.view(np.int64), b.view(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(lo), pa.array(hi)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)))
            rows += batch.num_rows
            if rows >= 1 << 14:
                keys, fps = (np.concatenate(x) for x in zip(*held, strict=True))
                whole = int(np.searchsorted(keys, keys[-1]))  # the last bucket may go on
                if whole:
                    yield links(keys[:whole], fps[:whole])
                held, rows = [(keys[whole:], fps[whole:])], len(keys) - whole
        if rows:
            yield links(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return run


def _submask(fixed: int, max_bits: int = MAX_BITS) -> list[int]:
    free = [b for b in range(BITS) if not (fixed >> b) & 1]
    return [sum(1 << b for b in free[i :: max_bits + 1]) for i in range(max_bits + 1)]


def links_within(
    fps: DataFrame, max_bits: int = MAX_BITS, bucket_rows: int = BUCKET_ROWS, levels: int = LEVELS, whole: int = 0
) -> DataFrame:
    """Links (a, b) that connect distinct fingerprints ``fps`` (fp) as all pairs
    within ``max_bits`` do. A bucket gives a spanning tree, not all its pairs,
    but all pairs of a group of up to ``whole``.
    """
    n, both = _joint_counts(fps)
    kinds = _masks(plan(n, both, max_bits))
    if not kinds:
        return fps.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    probe = F.explode(F.array(*(F.struct(F.lit(i).alias("kind"), F.lit(m).cast("long").alias("fixed")) for i, m in kinds)))
    keys = fps.select("fp", probe.alias("k")).select(
        "fp", F.col("k.fixed").alias("fixed"), F.xxhash64("k.kind", F.col("fp").bitwiseAND(F.col("k.fixed"))).alias("key")
    )
    spark, done = fps.sparkSession, []
    masks = {m for _, m in kinds}
    for _ in range(levels):
        # Buckets too large for one task: dealt out again by max_bits + 1 more
        # sets of bits, one of which any two that link must share in full.
        hot = keys.groupBy("key").count().where(F.col("count") > bucket_rows).select("key")
        hot = materialize(hot, "hot-buckets")
        if hot.isEmpty():
            break
        done.append(keys.join(hot, "key", "left_anti").select("key", "fp"))
        subs = {m: [_signed(s) for s in _submask(m & (2**64 - 1), max_bits)] for m in masks}
        table = spark.createDataFrame(
            [(m, i, s, _signed((m | s) & (2**64 - 1))) for m, ss in subs.items() for i, s in enumerate(ss)],
            "fixed long, sub int, more long, next long",
        )  # at most max_bits + 1 rows for each mask, and as many masks from each a level
        keys = (
            keys.join(hot, "key", "left_semi")
            .join(F.broadcast(table), "fixed")
            .select("fp", F.col("next").alias("fixed"), F.xxhash64("key", "sub", F.col("fp").bitwiseAND(F.col("more"))).alias("key"))
        )
        masks = {_signed((m | s) & (2**64 - 1)) for m, ss in subs.items() for s in ss}
    done.append(keys.select("key", "fp"))
    out = None
    for part in done:
        found = part.repartition("key").sortWithinPartitions("key").mapInArrow(_verify(max_bits, whole), "a long, b long")
        out = found if out is None else out.union(found)
    return out


def components_of(slim: DataFrame) -> DataFrame:
    """(fp, root, component_id, n) of each fingerprint of ``slim`` (doc_id, fp), n its rows.

    Equal fingerprints are one node, so copies cost nothing. root is the
    component's smallest fingerprint, component_id its smallest document.
    """
    classes = materialize(slim.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "simhash-classes")
    comp = connected_components(links_within(classes.select("fp")))
    tagged = classes.join(comp, classes.fp == comp.node, "left").select(
        "fp", F.coalesce("component", "fp").alias("root"), "least", "n"
    )
    ids = tagged.groupBy("root").agg(F.min("least").alias("component_id"))
    return materialize(tagged.join(ids, "root").select("fp", "root", "component_id", "n"), "simhash-components")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) of every row of ``docs``.

    component_id is the smallest id reachable over links of ``MAX_BITS`` or
    fewer differing bits. Null or wordless texts have fingerprint 0 and link
    like others. Rows that repeat an id each get a row; null ids take part, and
    a component of null ids only has a null component_id. Extra columns are
    ignored; an empty table gives an empty result.
    """
    short_batches(docs.sparkSession)
    slim = materialize(docs.select(F.col(id_col).alias("doc_id"), fingerprint(F.col(text_col)).alias("fp")), "simhash")
    return join_hot(slim, components_of(slim), "fp", "n").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` less all but one of each near-duplicate group.

    The row with the smallest (id, hash of the row) stays; null ids come last.
    Among rows equal in every column one stays. All columns are returned.
    """
    short_batches(docs.sparkSession)
    tie = row_hash(docs)
    slim = materialize(
        docs.select(F.col(id_col).alias("doc_id"), tie.alias("tie"), fingerprint(F.col(text_col)).alias("fp")), "simhash"
    )
    return keep_least(docs, join_hot(slim, components_of(slim), "fp", "n").select("doc_id", "tie", "root"), id_col)
