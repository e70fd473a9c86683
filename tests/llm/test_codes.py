"""Vector codes against a plain search, and on awkward tables."""

import hashlib
import math

import numpy as np
import pytest
from brassledger.llm import codes
from brassledger.llm.queries import ORACLE_SQL, QUERIES
from conftest import rows_of
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<double>, label int, code string, error int, dim string, v int, _label int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", 1, "y", 2, 3) for i, v, label in rows], SCHEMA).repartition(3)


def plain(rows, parts=8, entries=16, rounds=6):
    """The same by lists of Python integers, all entries compared."""
    kept = [(i, [math.floor(4096 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]
    find = lambda v, book: min((sum((a - b) ** 2 for a, b in zip(v, e, strict=True)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p, book in enumerate(books):
            groups = {}
            for _, v, _ in kept:
                groups.setdefault(find(cut(v, p), book)[1], []).append(cut(v, p))
            books[p] = [[sum(c) // len(groups[k]) for c in zip(*groups[k], strict=True)] if k in groups else e for k, e in enumerate(book)]
    out, by_label = [], {}
    for i, v, label in kept:
        found = [find(cut(v, p), book) for p, book in enumerate(books)]
        out.append((i, label, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found)))
        by_label[label] = by_label.get(label, 0) + out[-1][3]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    key = lambda r: (r[0] is None, r)
    return sorted(((i, c, e, min(by_label[label], codes.LIMIT), digest) for i, label, c, e in out), key=key)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0] is None, r))


def test_equals_sql(spark, sf_dir, duck):
    have = QUERIES["op11_codes"](spark, sf_dir).toPandas()
    assert rows_of(have) == rows_of(duck.sql(ORACLE_SQL["op11_codes"]).df())


@pytest.mark.parametrize("size", [1.0, 1e5])
def test_equals_plain_search(spark, size):
    rng = np.random.default_rng(3)
    rows = [(int(i) * 7 % 301, (rng.normal(size=16) * size).round(2).tolist(), int(i) % 3 or None) for i in range(150)]
    rows += [(900 + i, rows[5][1], 1) for i in range(20)]  # copies
    rows += [(1, None, 1), (2, [float("nan")] * 16, 1), (3, [None] * 16, None), (4, [float("inf")] * 16, 2), (5, [0.0] * 16, None)]
    assert got(codes.compressed(table(spark, rows))) == plain(rows)


@pytest.mark.parametrize("degree,integers", [(2, True), (4, True), (5, True), (4, False)])
def test_tree_finds_the_nearest(degree, integers):
    """Small ranges give many ties; big ones go by Python integers."""
    rng = np.random.default_rng(5)
    for high in (2, 4, 50) if integers else (1 << 60,):
        entries, rows = rng.integers(-high, high, (40, 3)), rng.integers(-high, high, (500, 3))
        if not integers:
            entries, rows = entries.astype(object), rows.astype(object)
        squares = ((rows[:, None] - entries[None]) ** 2).sum(axis=2)
        best, found, computed = codes.nearest(codes.build(entries, list(range(40)), degree), entries, rows)
        assert (best == squares.argmin(axis=1)).all() and (found == squares.min(axis=1)).all()
        assert computed < 500 * 40


def test_roots_are_exact():
    squares = np.array([0, 1, 2, 3, 4, (1 << 31) ** 2 - 1, (1 << 30) ** 2, (1 << 30) ** 2 + 1, 94906267**2 - 1])
    down, up = codes.roots(squares)
    assert down.tolist() == [math.isqrt(int(s)) for s in squares]
    assert all((u - 1) ** 2 < s <= u**2 for u, s in zip(up.tolist(), squares.tolist(), strict=True) if s)


def test_awkward_rows(spark):
    empty = codes.compressed(table(spark, []))
    assert empty.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and empty.count() == 0
    rows = [(1, [0.5] * 8, 1), (1, [0.5] * 8, 1), (None, [0.25] * 8, None), (2, [], None), (3, [1.0] * 10, 1), (4, [1e300] * 8, 2), (5, [-1e300] * 8, 2)]
    have = [tuple(r)[:4] for r in codes.compressed(table(spark, rows), entries=3).collect()]
    # Lengths 0 and 10 have codebooks of their own. Of the three entries, 0.5 twice
    # and 1e300, the first moves to -1e300, which is nearer to it than to 1e300.
    assert sorted(have, key=str) == sorted(
        [(1, "01" * 8, 935712, 1871424)] * 2
        + [(None, "01" * 8, 3720992, 3720992), (2, "00" * 8, 0, 3720992), (3, "00" * 8, 0, 1871424), (4, "02" * 8, 0, 0), (5, "00" * 8, 0, 0)],
        key=str,
    )


def test_repeated_ids_and_partitions(spark):
    rng = np.random.default_rng(8)
    rows = [(i // 3, rng.normal(size=8).round(3).tolist(), 1) for i in range(90)]
    df = table(spark, rows)
    assert got(codes.compressed(df)) == got(codes.compressed(df.repartition(7).orderBy(F.desc("vec_id")))) == plain(rows)
