"""Discretionary scores, wanted savings and the capped ledger that grants them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..store import written
from .dims import DELIVERY_WORDS, HINT_WORDS, service_groups, with_category_facts
from .recurring import price_creep, recurring, spikes
from .report import category, merchant, outflows

_WANT = "account_id long, seq int, key string, categories array<string>, want long"


def _any_of(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def frivolity(ledger: DataFrame, threshold: float = 0.6, flagged: DataFrame | None = None) -> DataFrame:
    """Outflows whose score reaches the threshold, with the reasons. ``flagged``
    holds the merchants that people marked as such."""
    o = with_category_facts(outflows(ledger).withColumn("category", category())).withColumn("merchant", merchant())
    days = F.datediff(F.max("txn_date").over(Window.partitionBy("account_id")), F.min("txn_date").over(Window.partitionBy("account_id"))) + 1
    visits = F.count("*").over(Window.partitionBy("account_id", "merchant"))
    o = o.withColumn("per_month", visits / (days / 30.44)).withColumn("cents", -F.col("amount_cents"))
    base = F.when(F.col("kind").isin("excluded", "income"), 0.0).otherwise(F.col("frivolity") / 3 * F.when(F.col("kind") == "essential", 0.45).otherwise(1.0))
    hint = _any_of(F.lower("merchant"), HINT_WORDS)
    if flagged is not None:
        marks = flagged.select("merchant").distinct().withColumn("_flag", F.lit(True))
        o = o.join(marks, "merchant", "left")
        hint = hint | F.coalesce("_flag", F.lit(False))
    habit = (F.col("per_month") >= 6) & (F.col("cents") <= 15000)
    s = F.when(hint, F.greatest(base, F.lit(0.9))).otherwise(base) + F.when(habit, 0.15).otherwise(0.0)
    s = F.when(F.col("kind").isin("excluded", "income"), 0.0).otherwise(F.least(F.lit(1.0), s))
    reasons = F.array_compact(F.array(F.when(F.col("frivolity") >= 2, "category"), F.when(hint, "merchant"), F.when(habit, "habit")))
    return o.select("account_id", "id", "category", "cents", F.round(s, 3).alias("score"), F.concat_ws(",", reasons).alias("reasons")).where(F.col("score") >= threshold)


def frivolity_ranked(ledger: DataFrame, k: int = 200, **options) -> DataFrame:
    """Each account's first ``k`` of these by score, then amount, then age, with the
    total of all of them, beyond the first too."""
    part = Window.partitionBy("account_id")
    f = frivolity(ledger, **options).withColumn("total_cents", F.sum("cents").over(part))
    return f.withColumn("rank", F.row_number().over(part.orderBy(F.desc("score"), F.desc("cents"), "id"))).where(F.col("rank") <= k)


def monthly_by_category(ledger: DataFrame) -> DataFrame:
    o = outflows(ledger).withColumn("category", category())
    days = ledger.groupBy("account_id").agg(((F.datediff(F.max("txn_date"), F.min("txn_date")) + 1) / 30.44).alias("months"))
    m = o.groupBy("account_id", "category").agg(F.sum(-F.col("amount_cents")).alias("cents")).join(days, "account_id")
    return with_category_facts(m).withColumn("monthly", (F.col("cents") / F.col("months")).cast("long"))


def habits(ledger: DataFrame) -> DataFrame:
    """Frequent small spending: six rows or more of at most 20 000 on average,
    four or more a month, in a category that is wanted rather than needed."""
    days = ledger.groupBy("account_id").agg(((F.datediff(F.max("txn_date"), F.min("txn_date")) + 1) / 30.44).alias("months"))
    h = outflows(ledger).groupBy("account_id", merchant().alias("merchant"), category().alias("category")).agg(
        F.count("*").alias("n"), F.sum(-F.col("amount_cents")).alias("cents")
    )
    h = with_category_facts(h.where("n >= 6 AND cents / n <= 20000")).join(days, "account_id")
    h = h.where(~F.col("kind").isin("excluded", "income") & (F.col("frivolity") >= 2) & (F.col("n") / F.col("months") >= 4))
    return h.select("account_id", "merchant", "category", "n", "cents", (F.col("cents") / F.col("months") * 0.5).cast("long").alias("want"))


def deliveries(ledger: DataFrame) -> DataFrame:
    d = outflows(ledger).where(_any_of(F.lower("merchant_norm"), DELIVERY_WORDS))
    return d.groupBy("account_id", merchant().alias("merchant")).agg(F.count("*").alias("n"), F.sum(-F.col("amount_cents")).alias("cents"))


def _want(df: DataFrame, seq: int, key: Column, categories: Column, want: Column) -> DataFrame:
    return df.select("account_id", F.lit(seq).alias("seq"), key.alias("key"), categories.alias("categories"), want.cast("long").alias("want")).where("want > 0")


def _in_order(place: str) -> Column:
    """The distinct categories of a group of charges, as they first appear by ``place``."""
    return F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct(place, "category"))), lambda x: x["category"]))  # an account's few subscriptions


def wants(ledger: DataFrame, monthly: DataFrame | None = None) -> DataFrame:
    """What each finding would like to save a month; independent of one another.
    ``monthly`` is what ``monthly_by_category`` gives, if it is there already."""
    m = monthly_by_category(ledger) if monthly is None else monthly
    months = ledger.groupBy("account_id").agg(((F.datediff(F.max("txn_date"), F.min("txn_date")) + 1) / 30.44).alias("months"))
    own = F.array("category")
    found = written(recurring(ledger).where("active"), "advice-recurring")
    subs = with_category_facts(found.where("subscription"))
    services = service_groups(ledger.sparkSession)
    over = subs.join(F.broadcast(services), F.contains(F.lower("merchant_norm"), F.col("word")))  # some 25 words
    over = over.dropDuplicates(["account_id", "service", "merchant_norm"])
    rank = F.row_number().over(Window.partitionBy("account_id", "service").orderBy(F.desc("monthly_cents"), "merchant_norm"))
    over = over.withColumn("r", rank).where("r > 1").groupBy("account_id", "service").agg(
        F.sum("monthly_cents").alias("w"), _in_order("r").alias("c")
    )
    small = subs.where("monthly_cents <= 30000 AND frivolity >= 2 AND kind NOT IN ('excluded', 'income')").groupBy("account_id").agg(
        F.count("*").alias("k"), F.sum("monthly_cents").alias("w"), _in_order("rank").alias("c")
    ).where("k >= 3")
    creep = price_creep(ledger).join(subs.select("account_id", "merchant_norm", "category", "rank"), ["account_id", "merchant_norm"])
    creep = creep.groupBy("account_id").agg(F.sum(F.floor("new_cents") - F.floor("old_cents")).alias("w"), _in_order("rank").alias("c"))
    sp = with_category_facts(spikes(ledger)).where("frivolity >= 2 AND kind NOT IN ('excluded', 'income')")
    dl = deliveries(ledger).where("n >= 3").groupBy("account_id").agg(F.sum("cents").alias("cents")).join(months, "account_id")
    spill = F.array(F.lit("Delivery Fees & Convenience"), F.lit("Eating Out & Takeaways"), F.lit("Groceries"))
    parts = [
        _want(m.where("category IN ('Fines & Penalties', 'Interest & Penalties')"), 1, F.col("category"), own, F.col("monthly") * 0.9),
        _want(m.where("category = 'Bank Fees' AND monthly >= 2000"), 2, F.lit("bank fees"), own, F.col("monthly") * 0.45),
        _want(over, 3, F.col("service"), F.col("c"), F.col("w")),
        _want(dl, 4, F.lit("delivery"), spill, F.col("cents") / F.col("months") * 0.25),
        _want(habits(ledger), 5, F.col("merchant"), own, F.col("want")),
        _want(m.where("category = 'Gambling & Betting'"), 6, F.lit("gambling"), own, F.col("monthly") * 0.95),
        _want(small, 7, F.lit("small subscriptions"), F.col("c"), F.col("w") * 0.4),
        _want(creep, 8, F.lit("price creep"), F.col("c"), F.col("w")),
        _want(sp, 9, F.col("category"), own, (F.col("latest_cents") - F.col("mean_cents")) * 0.6),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def headroom(ledger: DataFrame, monthly: DataFrame | None = None) -> DataFrame:
    m = monthly_by_category(ledger) if monthly is None else monthly
    return m.select("account_id", "category", (F.col("monthly") * F.col("reducible")).cast("long").alias("ceiling"), "kind", "frivolity", "monthly")


def granted(single: DataFrame, ceilings: DataFrame) -> DataFrame:
    """Grants of claims on one category each (account_id, category, seq, want), in
    order, as a running sum clamped at the category's ceiling."""
    w = Window.partitionBy("account_id", "category").orderBy("seq", "key")
    run = F.sum("want").over(w.rowsBetween(Window.unboundedPreceding, 0))
    j = single.join(ceilings.select("account_id", "category", "ceiling"), ["account_id", "category"]).withColumn("run", run)
    grant = F.least("ceiling", "run") - F.least(F.col("ceiling"), F.col("run") - F.col("want"))
    return j.select("account_id", "category", "seq", "key", "want", grant.alias("granted"))


def _after(state: Column, claim: Column, limits: dict[int, int]) -> Column:
    """The state (room, used, out) after a claim: what its categories still have goes
    to it, one after the other; a finding counts against its cap if it gets something."""
    room = F.aggregate(
        claim["categories"],
        F.struct(state["room"].alias("room"), claim["want"].alias("want")),
        lambda t, name: F.struct(
            F.transform_values(t["room"], lambda k, v: F.when(k == name, v - F.greatest(F.lit(0), F.least(t["want"], v))).otherwise(v)).alias("room"),
            (t["want"] - F.greatest(F.lit(0), F.least(t["want"], F.coalesce(F.try_element_at(t["room"], name), F.lit(0))))).alias("want"),
        ),
    )
    given = lambda r: claim["want"] - r["want"]
    found = lambda r: F.array(F.struct(claim["seq"].alias("seq"), claim["key"].alias("key"), given(r).alias("saving")))
    one = lambda r: F.struct(
        r["room"].alias("room"),
        F.transform_values(state["used"], lambda k, v: v + F.when((k == claim["seq"]) & (given(r) > 0), 1).otherwise(0)).alias("used"),
        F.when(given(r) > 0, F.concat(state["out"], found(r))).otherwise(state["out"]).alias("out"),
    )
    caps = F.create_map(*(F.lit(x) for pair in limits.items() for x in pair))
    full = F.coalesce(F.try_element_at(state["used"], claim["seq"]) >= F.try_element_at(caps, claim["seq"]), F.lit(False))
    # One array of one element, so that the grant is computed once.
    return F.when(full, state).otherwise(F.element_at(F.transform(F.array(room), one), 1))


def walked(claims: DataFrame, room: DataFrame, max_habits: int = 6, max_spikes: int = 3, max_trims: int = 5) -> DataFrame:
    """(account_id, seq, key, saving): the claims of each account granted one after
    the other, by seq, then want, then key, and the closing trims of what is left.

    A fold over an account's claims, which are findings and not rows (a few dozen),
    with the room of its categories as state; it runs inside the JVM."""
    limits = {5: max_habits, 9: max_spikes}
    c = claims.groupBy("account_id").agg(F.array_sort(F.collect_list(F.struct("seq", (-F.col("want")).alias("less"), "key", "want", "categories"))).alias("claims"))
    may = F.col("kind").isin("discretionary", "cash") & (F.col("frivolity") >= 2) & (F.col("monthly") >= 10000)
    r = room.groupBy("account_id").agg(
        F.map_from_entries(F.collect_list(F.struct("category", "ceiling"))).alias("room"), F.collect_list(F.when(may, F.col("category"))).alias("trims")
    )
    zero = F.struct(
        F.col("room").alias("room"), F.create_map(*(x for k in limits for x in (F.lit(k), F.lit(0)))).alias("used"),
        F.array().cast("array<struct<seq:int,key:string,saving:bigint>>").alias("out"),
    )
    none = F.array().cast("array<struct<seq:int,less:bigint,key:string,want:bigint,categories:array<string>>>")
    end = F.aggregate(F.coalesce("claims", none), zero, lambda s, x: _after(s, x, limits))
    done = r.join(c, "account_id", "left").select("account_id", "trims", end.alias("end"))
    left = lambda n: F.coalesce(F.try_element_at(F.col("end.room"), n), F.lit(0))
    rest = F.array_sort(F.transform(F.filter("trims", lambda n: left(n) >= 5000), lambda n: F.struct((-left(n)).alias("less"), n.alias("key"))))
    trims = F.transform(F.slice(rest, 1, max_trims), lambda t: F.struct(F.lit(10).alias("seq"), t["key"].alias("key"), (-t["less"]).alias("saving")))
    return done.select("account_id", F.explode(F.concat("end.out", trims)).alias("f")).select("account_id", "f.*")


def advice(ledger: DataFrame, **limits) -> DataFrame:
    """(account_id, seq, key, saving) of findings that get something.

    Claims that spill over several categories, caps that count granted findings
    only and the closing trim depend on what is left, so an account's claims are
    granted in order.
    """
    ledger = written(ledger.select("account_id", "id", "txn_date", "merchant_norm", "category", "status", "amount_cents"), "advice-ledger")  # a dozen claims are drawn from it
    monthly = written(monthly_by_category(ledger), "advice-monthly")
    return walked(written(wants(ledger, monthly), "advice-claims"), headroom(ledger, monthly), **limits)


# --- fixed values: kind of finding | severity | how hard it is ---
KINDS = (
    (1, 3.0, "easy"), (2, 2.5, "easy"), (3, 2.8, "easy"), (4, 2.4, "moderate"), (5, 2.2, "moderate"),
    (6, 4.0, "hard"), (7, 2.0, "easy"), (8, 1.8, "moderate"), (9, 2.1, "moderate"), (10, 1.5, "moderate"),
)


def _kind(i: int) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for row in KINDS for x in (row[0], row[i]))), F.col("seq"))


def ranked(findings: DataFrame) -> DataFrame:
    """Findings with severity and difficulty, and their place in the account's
    list: by saving, then severity."""
    f = findings.withColumn("severity", _kind(1)).withColumn("difficulty", _kind(2))
    return f.withColumn("rank", F.row_number().over(Window.partitionBy("account_id").orderBy(F.desc("saving"), F.desc("severity"), "seq", "key")))


def advice_totals(findings: DataFrame, ledger: DataFrame) -> DataFrame:
    """Per account: findings, savings a month and a year, and a month by difficulty;
    ``valid`` if neither all savings together nor one of them exceed the spend."""
    months = ledger.groupBy("account_id").agg(((F.datediff(F.max("txn_date"), F.min("txn_date")) + 1) / 30.44).alias("months"))
    m = with_category_facts(outflows(ledger).withColumn("category", category())).where("kind NOT IN ('excluded', 'income')")
    spend = m.groupBy("account_id").agg(F.sum(-F.col("amount_cents")).alias("spend")).join(months, "account_id")
    spend = spend.select("account_id", (F.col("spend") / F.col("months")).cast("long").alias("monthly_spend"))
    of = lambda d: F.coalesce(F.sum(F.when(F.col("difficulty") == d, F.col("saving"))), F.lit(0)).alias(f"{d}_cents")
    f = findings.withColumn("difficulty", _kind(2)).groupBy("account_id").agg(
        F.count("*").alias("n"), F.sum("saving").alias("monthly_cents"), (F.sum("saving") * 12).alias("annual_cents"), of("easy"), of("moderate"), of("hard"), F.max("saving").alias("largest_cents")
    )
    f = f.join(spend, "account_id", "left").fillna(0, ["monthly_spend"])
    return f.withColumn("valid", (F.col("monthly_cents") <= F.col("monthly_spend")) & (F.col("largest_cents") <= F.col("monthly_spend"))).drop("largest_cents")
