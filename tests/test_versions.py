"""Versions of tables in folders by month: what changes, what stays, who wins."""

import datetime as dt

import pytest
from brassledger import versions as vs
from brassledger.operators import dims
from pyspark.sql import functions as F

LEDGER = "id long, account_id long, txn_month string, merchant_norm string, category string, category_source string, status string, statement_id long, amount_cents long"
ROWS = [
    (1, 1, "2025-01", "Engen", None, "default", "active", 10, -100), (2, 1, "2025-01", "Vida", "Coffee & Snacks", "rule", "duplicate", 10, -200),
    (3, 1, "2025-02", "Engen", "Fuel", "rule", "active", 11, -300), (4, 2, "2025-03", "Vida", None, None, "duplicate", 20, -400),
    (5, 2, None, "Vida", None, None, "active", 20, -500), (6, 2, "a/b=c d%", "Vida", None, None, "active", 21, -600), (6, 2, "a/b=c d%", "Vida", None, None, "active", 21, -600),
]


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*[f.split()[0] for f in LEDGER.split(", ")]).collect()), key=repr)


@pytest.fixture
def store(spark, tmp_path):
    root = str(tmp_path)
    merchants = spark.createDataFrame([(None, "engen", "Fuel")], "account_id long, canonical string, default_category string")
    seen = spark.createDataFrame([(10,), (11,), (20,), (21,)], "statement_id long")
    new = {"ledger": vs.Change(spark.createDataFrame(ROWS, LEDGER), "txn_month"), "rules": vs.Change(dims.rules(spark)), "merchants": vs.Change(merchants), "statements": vs.Change(seen)}
    vs.commit(spark, root, new, vs.Version())
    return root


def folders(v):
    return v.tables["ledger"]["folders"]


def differing(a, b):
    return {k for k in folders(a).keys() | folders(b).keys() if folders(a).get(k) != folders(b).get(k)}


def test_a_change_writes_its_months_only(spark, store):
    first = vs.version(spark, store)
    assert rows_of(vs.read(spark, store, "ledger")) == sorted(ROWS, key=repr) and len(folders(first)) == 5
    old = vs.read(spark, store, "ledger", first)
    second = vs.set_category(spark, store, spark.createDataFrame([(1, "Gifts")], "id long, new_category string"))
    assert differing(first, second) == {"2025-01"} and second.number == 2
    want = [(*r[:4], "Gifts", "user", *r[6:]) if r[0] == 1 else r for r in ROWS]
    assert rows_of(vs.read(spark, store, "ledger")) == sorted(want, key=repr)
    assert rows_of(old) == rows_of(vs.read(spark, store, "ledger", vs.version(spark, store, 1))) == sorted(ROWS, key=repr)
    learned = vs.read(spark, store, "rules").where("source = 'user'").collect()
    assert [(r.account_id, r.pattern, r.category) for r in learned] == [(1, "engen", "Gifts")]
    assert {(r.account_id, r.default_category) for r in vs.read(spark, store, "merchants").collect()} == {(None, "Fuel"), (1, "Gifts")}
    third = vs.resolve(spark, store, spark.createDataFrame([(4, "distinct"), (5, "duplicate"), (6, "duplicate")], "id long, resolution string"))
    assert differing(second, third) == {"2025-03", vs.NONE, "a/b=c d%"}
    got = {r.id: r.status for r in vs.read(spark, store, "ledger").collect()}
    assert got == {1: "active", 2: "duplicate", 3: "active", 4: "active", 5: "duplicate", 6: "duplicate"} and vs.read(spark, store, "ledger").count() == len(ROWS)


def test_a_month_without_rows_goes_and_comes_back(spark, store):
    first = vs.version(spark, store)
    second = vs.remove_statements(spark, store, spark.createDataFrame([(11,), (20,), (99,)], "statement_id long"))
    assert differing(first, second) == {"2025-02", "2025-03", vs.NONE} and set(folders(second)) == {"2025-01", "a/b=c d%"}
    assert {r.id for r in vs.read(spark, store, "ledger").collect()} == {1, 2, 6}
    assert {r[0] for r in vs.read(spark, store, "statements").collect()} == {10, 21}
    third = vs.append(spark, store, "ledger", spark.createDataFrame([ROWS[2], ROWS[4]], LEDGER))
    assert differing(second, third) == {"2025-02", vs.NONE}
    assert {r.id for r in vs.read(spark, store, "ledger").collect()} == {1, 2, 3, 5, 6}
    assert rows_of(vs.read(spark, store, "ledger", vs.revert(spark, store, 1))) == sorted(ROWS, key=repr)


def test_nothing_to_do_makes_no_version(spark, store):
    none = spark.createDataFrame([(77, "Gifts")], "id long, new_category string")
    assert vs.set_category(spark, store, none).number == 1 and vs.set_category(spark, store, none.limit(0)).number == 1
    assert vs.append(spark, store, "ledger", vs.read(spark, store, "ledger").limit(0)).number == 1 and vs.numbers(spark, store) == [1]


def test_the_first_of_two_changes_wins(spark, store):
    base = vs.version(spark, store)
    change = {"statements": vs.Change(spark.range(3).toDF("statement_id"))}
    vs.commit(spark, store, change, base)
    with pytest.raises(vs.Conflict):
        vs.commit(spark, store, {"statements": vs.Change(spark.range(5).toDF("statement_id"))}, base)
    assert vs.read(spark, store, "statements").count() == 3 and vs.numbers(spark, store) == [1, 2]


def test_a_change_that_fails_shows_nothing(spark, store, monkeypatch):
    real, left = vs._write, [1]

    def tripped(*a):
        if not left[0]:
            raise OSError("lost")
        left[0] -= 1
        real(*a)

    monkeypatch.setattr(vs, "_write", tripped)
    with pytest.raises(OSError, match="lost"):
        vs.set_category(spark, store, spark.createDataFrame([(1, "Gifts")], "id long, new_category string"))
    monkeypatch.undo()
    assert rows_of(vs.read(spark, store, "ledger")) == sorted(ROWS, key=repr) and vs.read(spark, store, "rules").where("source = 'user'").isEmpty()


def test_rows_of_other_months_are_refused(spark, store):
    base = vs.version(spark, store)
    with pytest.raises(ValueError, match="2025-02"):
        vs.commit(spark, store, {"ledger": vs.Change(vs.read(spark, store, "ledger"), "txn_month", ("2025-01",))}, base)
    assert vs.numbers(spark, store) == [1]


def test_new_columns_are_null_where_nothing_changed(spark, store):
    vs.change(spark, store, "ledger", spark.createDataFrame([(3,)], "id long"), "id", lambda part: part.withColumn("note", F.lit("seen")))
    assert {r.id: r.note for r in vs.read(spark, store, "ledger").collect()} == {1: None, 2: None, 3: "seen", 4: None, 5: None, 6: None}


def test_expired_versions_free_their_folders(spark, store, tmp_path):
    for k in (1, 2, 3):
        vs.set_category(spark, store, spark.createDataFrame([(3, f"c{k}")], "id long, new_category string"))
    vs.expire(spark, store, 2)
    assert vs.numbers(spark, store) == [3, 4] and vs.read(spark, store, "ledger").where("id = 3").first().category == "c3"
    assert vs.read(spark, store, "ledger", vs.version(spark, store, 3)).where("id = 3").first().category == "c2"
    assert len(list(tmp_path.glob("ledger/*/txn_month=2025-02"))) == 2 and len(list(tmp_path.glob("ledger/*/txn_month=2025-03"))) == 1


def test_dates_as_folders(spark, tmp_path):
    root, day = str(tmp_path), dt.date(2025, 3, 1)
    t = spark.createDataFrame([(1, day), (2, day + dt.timedelta(1)), (3, None)], "id long, d date")
    vs.commit(spark, root, {"t": vs.Change(t, "d")}, vs.Version())
    v = vs.change(spark, root, "t", spark.createDataFrame([(2,), (3,)], "id long"), "id", lambda part: part.where("id <> 2"))
    assert set(v.tables["t"]["folders"]) == {"2025-03-01", vs.NONE} and {r.id: r.d for r in vs.read(spark, root, "t").collect()} == {1: day, 3: None}
    assert vs.read(spark, root, "t", v, only=()).columns == ["id", "d"]
