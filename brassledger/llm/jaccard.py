"""Near-duplicates by SimHash, every link verified by Jaccard similarity of word shingles.

Texts are searched for by the generalised pigeonhole of ``simhash``: fingerprints
of the sets of shingles that differ in ``NEAR_BITS`` or fewer bits. A link counts
only if the two whole sets are similar enough.

At similarity 0.8 fingerprints differ in about 10 bits and in up to 20, more than
a pigeonhole over 64 bits can search without comparing nearly all pairs. So texts
that are similar but farther apart in bits, and that no link of fingerprints has
joined, meet where one of ``BANDS`` groups of ``ROWS`` min-hashes is equal (Broder,
"On the Resemblance and Containment of Documents", 1997; Leskovec et al., "Mining
of Massive Datasets", ch. 3). Two texts of similarity s share none with
probability (1 - s**ROWS) ** BANDS: 3e-6 at 0.8, 1e-8 at 0.85. No pair that
shares a key is left out: it is joined to what is one component already, or compared.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, discard, join_hot, keep_least, materialize, row_hash, short_batches, small_or_shuffled
from .components import connected_components
from .simhash import links_within, majority

#: Words in a shingle, and the least similarity of a link.
WIDTH, SIMILARITY = 5, 0.8
#: Bits in which the fingerprints of a pair may differ. Nine take at most 64 keys a
#: text; from ten on the plan needs hundreds where there are millions of texts.
NEAR_BITS = 9
#: Fingerprints in a bucket that is dealt out again by more bits, once.
NEAR_ROWS = 1 << 14
#: Fingerprints up to which a group in a bucket gives all its pairs. A larger one
#: gives a spanning tree; where a link of it is not similar, min-hashes find others.
NEAR_GROUP = 64
#: Texts of one fingerprint up to which each takes part in all its pairs.
NEAR_EQUAL = 8
#: Rows in an Arrow batch of keys, which are two longs.
KEY_ROWS = 1 << 13
#: Keys of a text, and min-hashes that each is made of.
BANDS, ROWS = 32, 5
#: Rounds in which a key's texts are compared with one of them.
STARS = 2
#: Texts of a key in one block, where all are compared.
BLOCK_ROWS = 1024
#: Bits of a parity sketch for each shingle, and at most.
SKETCH, MOST_BITS = 4, 1 << 16
#: Bytes kept of a shingle's hash where sets are compared.
HASH_BYTES = 6
_FACTORS, _SHIFTS = (np.array([xxhash.xxh64_intdigest(name, i) for i in range(BANDS * ROWS)], np.uint64) for name in (b"factor", b"shift"))
_FACTORS |= np.uint64(1)


def shingles_of(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted hashes of the distinct shingles; a shorter text is one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    ends = ends[min(width, len(words)) - 1 :].tolist()
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(line[a:b]) for a, b in zip(starts, ends, strict=False)), np.uint64))


def _share(similarity: float) -> tuple[int, int]:
    return Fraction(str(similarity)).as_integer_ratio()


def similar(x: np.ndarray, y: np.ndarray, similarity: float = SIMILARITY) -> bool:
    """Whether two sets are at least so similar. Empty sets are like each other."""
    part, whole = _share(similarity)
    if whole * min(len(x), len(y)) < part * max(len(x), len(y)):
        return False
    both = np.sort(np.concatenate([x, y]), kind="stable")
    same = int((both[1:] == both[:-1]).sum())
    return whole * same >= part * (len(x) + len(y) - same)


def bands_of(x: np.ndarray) -> list[int]:
    """The keys of a set of shingles; none for an empty one."""
    if not len(x):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(x), 2048):
        np.minimum(least, (x[at : at + 2048] * _FACTORS[:, None] + _SHIFTS[:, None]).min(axis=1), out=least)
    raw = least.tobytes()
    return [xxhash.xxh64_intdigest(raw[8 * ROWS * i : 8 * ROWS * (i + 1)], i) - (1 << 63) for i in range(BANDS)]


def _bits(x: np.ndarray) -> bytes:
    """A parity sketch of ``SKETCH`` bits an element or more; the number is a power of two."""
    n = min(MOST_BITS, max(64, 1 << (SKETCH * len(x) - 1).bit_length())) if len(x) else 64
    odd = np.bincount((x & np.uint64(n - 1)).astype(np.int64), minlength=n) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _apart(x: bytes, y: bytes) -> int:
    """In how many elements two sets differ at least, by their ``_bits``."""
    p, q = sorted((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)), key=len)
    return int(np.bitwise_count(np.bitwise_xor.reduce(q.reshape(-1, len(p)), axis=0) ^ p).sum())


def _packed(x: np.ndarray) -> bytes:
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 8 - HASH_BYTES :].tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // HASH_BYTES, 8), np.uint8)
    out[:, 8 - HASH_BYTES :] = np.frombuffer(raw, np.uint8).reshape(-1, HASH_BYTES)
    return out.view("<u8").reshape(-1)


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, text_col: str, width: int, similarity: float, repeated: bool) -> DataFrame:
    """The pairs (a, b) that are similar: first by sizes and parities, then by whole
    sets. ``repeated``: several rows of ``docs`` may have one tie."""
    part, whole = _share(similarity)

    @F.pandas_udf("binary")
    def cut(texts: pd.Series) -> pd.Series:
        return pd.Series([_packed(shingles_of(t, width)) for t in texts])

    def may(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, m, x, y = (b.column(k).to_pylist() for k in range(2, 6))
            ok = [
                whole * min(i, j) >= part * max(i, j) and _apart(s, t) * (whole + part) <= (i + j) * (whole - part)
                for i, j, s, t in zip(n, m, x, y, strict=True)
            ]
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = ([_unpacked(s) for s in b.column(k).to_pylist()] for k in (2, 3))
            ok = [similar(s, t, similarity) for s, t in zip(x, y, strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    x, y = (classes.select(F.col("node").alias(k), F.col("size").alias(f"n{k}"), F.col("bits").alias(f"s{k}")) for k in "ab")
    found = pairs.join(x, "a").join(y, "b").select("a", "b", "na", "nb", "sa", "sb")
    found = materialize(found.mapInArrow(may, "a long, b long"), "jaccard-pairs")
    need = found.select(F.col("a").alias("node")).union(found.select("b")).distinct()
    own = materialize(classes.join(need, "node", "left_semi").select("node", "tie"), "jaccard-own")
    texts = docs.select(row_hash(docs).alias("tie"), F.col(text_col).alias("t"))
    sets = texts.join(small_or_shuffled(own), "tie").select("node", cut("t").alias("shingles"))
    if repeated:
        sets = sets.dropDuplicates(["node"])
    x, y = (sets.select(F.col("node").alias(k), F.col("shingles").alias(f"s{k}")) for k in "ab")
    found = found.join(x, "a").join(y, "b").select("a", "b", "sa", "sb")
    with arrow_rows(docs.sparkSession, 64):  # a row is two sets
        return materialize(found.mapInArrow(check, "a long, b long"), "jaccard-links")


def by_fingerprint(classes: DataFrame) -> DataFrame:
    """The pairs (a, b) of texts, nodes of ``classes`` (node, size, fp), within
    ``NEAR_BITS``: all of small groups, a spanning tree of those over ``NEAR_GROUP``.
    Where more than ``NEAR_EQUAL`` texts have one fingerprint, the least of them
    stands for it and the others are tied to it."""
    own = classes.where("size > 0").select("node", "fp")
    lead = own.groupBy("fp").agg(F.min("node").alias("lead"), F.count("*").alias("n"), (F.count("*") <= NEAR_EQUAL).alias("few"))
    lead = materialize(lead, "jaccard-fingerprints")
    with arrow_rows(classes.sparkSession, KEY_ROWS):
        near = materialize(links_within(lead.select("fp"), NEAR_BITS, NEAR_ROWS, levels=1, whole=NEAR_GROUP).distinct(), "jaccard-near")
    led = join_hot(own, lead, "fp", "n")
    named = materialize(led.where("few OR node = lead").select("fp", "node"), "jaccard-named")
    x, y = (named.select(F.col("fp").alias(k), F.col("node").alias(f"n{k}")) for k in "ab")
    near = near.union(lead.where("few AND n > 1").select("fp", "fp"))
    across = near.join(x, "a").join(y, "b").where("na <> nb").select("na", "nb")
    tied = led.where("NOT few AND node <> lead").select("node", "lead")
    return across.union(tied).select(F.greatest("na", "nb").alias("a"), F.least("na", "nb").alias("b")).distinct()


def components_of(docs: DataFrame, slim: DataFrame, text_col: str, width: int, similarity: float) -> DataFrame:
    """(node, component) of each node that has links.

    ``slim`` has tie, node, size, fp, bands and bits of each row of ``docs``.
    """
    classes = slim.groupBy("node").agg(
        F.min("tie").alias("tie"), *(F.first(c).alias(c) for c in ("size", "fp", "bands", "bits")),
    )
    repeated = not slim.groupBy("tie").count().where("count > 1").isEmpty()  # rows equal in every column
    classes = materialize(classes, "jaccard-classes")
    comp = connected_components(_verified(by_fingerprint(classes), classes, docs, text_col, width, similarity, repeated))
    # What is similar but farther apart in bits meets by min-hashes.
    keys = classes.select("node", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.min("node").alias("first"), F.max("node").alias("last")).where("first < last")
    shared = materialize(keys.join(shared.select("key"), "key", "left_semi"), "jaccard-keys")
    open_ = _still_open(shared, comp)
    discard(shared)
    # First a key's texts against one of them, so that a large group costs a fixed
    # number of pairs a row. What such a round joins needs no comparing later.
    for turn in range(STARS):
        # One order for all keys, so that those of a large group mostly choose the same text.
        by, who = F.xxhash64("node", F.lit(turn)), F.struct("node", "c")
        lead = open_.groupBy("key").agg(F.min_by(who, by).alias("l")).select("key", F.col("l.node").alias("b"), F.col("l.c").alias("d"))
        pairs = open_.join(lead, "key").where("c <> d").select(F.greatest("node", "b").alias("a"), F.least("node", "b").alias("b")).distinct()
        comp = _joined(comp, _verified(pairs, classes, docs, text_col, width, similarity, repeated))
        before, open_ = open_, _still_open(open_, comp)
        discard(before)
    # Then all that a key still has in different components.
    pairs = _across(open_, classes, similarity)
    return _joined(comp, _verified(pairs, classes, docs, text_col, width, similarity, repeated))


def _joined(comp: DataFrame, links: DataFrame) -> DataFrame:
    """The components with more links. What is known of them stands in for the links that led to it."""
    return connected_components(links.union(comp.select("node", "component")))


def _still_open(keys: DataFrame, comp: DataFrame) -> DataFrame:
    """(key, node, c) of the keys whose texts lie in different components c.

    Components only grow, so a key of one component stays so."""
    placed = keys.select("key", "node").join(comp, "node", "left").select("key", "node", F.coalesce("component", "node").alias("c"))
    mixed = placed.groupBy("key").agg(F.min("c").alias("first"), F.max("c").alias("last")).where("first < last")
    return materialize(placed.join(mixed.select("key"), "key", "left_semi"), "jaccard-open")


def _across(open_: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of texts that share a key, lie in different components and
    may be similar by their sizes and parities: every such pair.

    A key's texts are cut into blocks of about ``BLOCK_ROWS``; a task takes two
    blocks at a time.
    """
    part, whole = _share(similarity)

    def near(x: list[tuple], y: list[tuple] | None) -> Iterator[tuple[int, int]]:
        """Pairs of x and y, or of x alone; a row is node, component, size, bits."""
        rows = x + (y or [])
        side = np.repeat([0, 1], [len(x), len(rows) - len(x)])
        node, comp, size = (np.array([r[k] for r in rows], np.int64) for k in range(3))
        length = np.array([len(r[3]) for r in rows])
        for n in np.unique(length):
            at, twice = np.flatnonzero(length == n), np.flatnonzero(length == 2 * n)
            bits = np.frombuffer(b"".join(rows[i][3] for i in at), np.uint64).reshape(len(at), n // 8)
            more = np.frombuffer(b"".join(rows[i][3] for i in twice), np.uint64).reshape(len(twice), 2, n // 8)
            all_, every = np.concatenate([at, twice]), np.concatenate([bits, more[:, 0] ^ more[:, 1]])
            for k, i in enumerate(at):
                j = all_[k + 1 :]
                ok = (comp[j] != comp[i]) & (whole * np.minimum(size[j], size[i]) >= part * np.maximum(size[j], size[i]))
                if y is not None:
                    ok &= side[j] != side[i]
                to = np.flatnonzero(ok)
                apart = np.bitwise_count(every[k + 1 :][to] ^ bits[k]).sum(axis=1, dtype=np.int64)
                to = j[to[apart * (whole + part) <= (size[j[to]] + size[i]) * (whole - part)]]
                yield from ((max(node[i], o), min(node[i], o)) for o in node[to])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(b.column(k).to_pylist() for k in range(8)), strict=True))
        for (_, i, j), tile in itertools.groupby(rows, lambda r: r[:3]):
            sides = ([], [])
            for r in tile:
                sides[r[3] != i].append(r[4:])
            found = list(near(sides[0], None if i == j else sides[1]))
            for k in range(0, len(found), 1 << 14):
                lo = np.array(found[k : k + (1 << 14)], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(lo[:, 0]), pa.array(lo[:, 1])], ["a", "b"])

    blocks = open_.groupBy("key").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))
    dealt = open_.join(blocks, "key").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    dealt = dealt.select("key", "node", "c", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    tiles = dealt.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "c")
    tiles = tiles.join(classes.select("node", "size", "bits"), "node").select("key", "i", "j", "block", "node", "c", "size", "bits")
    found = tiles.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, "a long, b long")
    return found.distinct()


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` less all but one of each group of near-duplicates.

    Groups are connected by links of texts whose sets of ``width``-word shingles
    (ASCII lower case) have at least this Jaccard similarity, found by their
    fingerprints and, beyond the bits that these can differ in, by min-hashes. Null
    and wordless texts are one group. Which row stays, and repeated rows, are as
    in ``simhash.keep_one``; all columns are returned.
    """
    short_batches(docs.sparkSession)

    @F.pandas_udf("node long, size int, fp long, bands array<long>, bits binary")
    def of(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            x = shingles_of(t, width)
            node, fp = (np.uint64(i).view(np.int64) for i in (xxhash.xxh64_intdigest(x.tobytes()), majority(x)))
            rows.append((node, len(x), fp, bands_of(x), _bits(x)))
        return pd.DataFrame(rows, columns=["node", "size", "fp", "bands", "bits"])

    slim = docs.select(F.col(id_col).alias("doc_id"), row_hash(docs).alias("tie"), of(F.col(text_col)).alias("s"))
    slim = materialize(slim.select("doc_id", "tie", "s.*"), "jaccard")
    comp = components_of(docs, slim, text_col, width, similarity)
    counted = slim.groupBy("node").agg(F.count("*").alias("n"))
    roots = materialize(counted.join(comp, "node", "left").select("node", F.coalesce("component", "node").alias("root"), "n"), "jaccard-roots")
    rooted = join_hot(slim.select("doc_id", "tie", "node"), roots, "node", "n")
    return keep_least(docs, rooted.select("doc_id", "tie", "root"), id_col)
