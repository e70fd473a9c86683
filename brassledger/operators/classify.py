"""Rule classification of narrations.

Rules meet distinct narrations only. A text rule (contains, exact, startswith)
is found by the rarest of its trigrams: narrations are taken apart into their
trigrams, an equi-join finds the rules that may match, and these are verified,
so a large rule pack costs each narration only what it may match. Regexes and
patterns of under three characters are few and met by a nested loop. Each output
field comes from the first rule, by (priority, user rules first, id), that sets it.
"""

from __future__ import annotations

import re

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import canonical_key, clean_description, merchant_name
from ..store import beside, written
from .dims import INCOME_WORDS

GRAM = 3


def rejected_rules(rules: DataFrame) -> DataFrame:
    """The rules whose lower-cased regular expression does not compile; they match
    nothing. It must be one in Python, whose expressions rules are written in, and
    in Java, which runs them.

    Rules are a dimension that people write by hand; only its regexes visit the driver."""
    spark, bad = rules.sparkSession, []
    for r in rules.where("match_type = 'regex' AND pattern IS NOT NULL").select("rule_id", F.lower("pattern").alias("p")).collect():
        try:
            re.compile(r["p"])
            spark._jvm.java.util.regex.Pattern.compile(r["p"])
        except (re.error, IllegalArgumentException):
            bad.append(r["rule_id"])
    return rules.where(F.col("rule_id").isin(bad) & (F.col("match_type") == "regex")) if bad else rules.limit(0)


def valid_rules(rules: DataFrame) -> DataFrame:
    """The rules less those whose regular expression does not compile."""
    bad = [r["rule_id"] for r in rejected_rules(rules).select("rule_id").collect()]
    return rules.where(~(F.col("rule_id").isin(bad) & (F.col("match_type") == "regex"))) if bad else rules


#: Rules that are broadcast at once; a larger pack is left to shuffled joins.
RULES_AT_ONCE = 5000
_FIELDS = ("category", "merchant", "txn_type")


def _subject() -> Column:
    return F.when(F.col("field") == "merchant", F.lower("cleaned")).otherwise(F.col("text"))


def _matches() -> Column:
    subject = _subject()
    hit = (
        ((F.col("match_type") == "contains") & F.contains(subject, F.col("p")))
        | ((F.col("match_type") == "exact") & (F.trim(subject) == F.trim("p")))
        | ((F.col("match_type") == "startswith") & F.startswith(subject, F.col("p")))
        | ((F.col("match_type") == "regex") & F.regexp_like(subject, F.concat(F.lit("(?i)"), "p")))
    )
    allowed = ~F.col("inflow") | F.col("category").isin("Transfers", "Savings & Investment")
    return hit & allowed & (subject != "")


def _grams(text: Column) -> Column:
    """Distinct trigrams; none of a shorter text."""
    n = F.length(text) - (GRAM - 1)
    starts = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(GRAM))))


def _small(table: DataFrame, rows: int) -> DataFrame:
    """A table of ``rows`` rows marked for broadcast if they are few, else written, so that Spark knows its size."""
    return F.broadcast(table) if rows <= RULES_AT_ONCE else written(table, "rules")


def _indexed() -> Column:
    return F.col("match_type").isin("contains", "exact", "startswith") & (F.length(F.trim("p")) >= GRAM)


def _hits(facts: DataFrame, rules: DataFrame, n_text: int, n_nested: int, owned: bool = False) -> DataFrame:
    """Every fact, and every fact with each rule that matches it. ``facts`` has text,
    cleaned and inflow; ``owned`` rules meet the facts of their own account only.
    There are ``n_text`` rules to index and ``n_nested`` others."""
    same = [F.col("account_id") == F.col("owner")] if owned else []
    by_text, nested = rules.where(_indexed()), rules.where(~F.coalesce(_indexed(), F.lit(False)))
    merchant = F.coalesce(F.col("field") == "merchant", F.lit(False))
    whole = F.when(F.col("match_type") == "exact", F.trim("p")).otherwise(F.col("p"))
    of_rules = by_text.select("owner", "rule_id", merchant.alias("on_name"), F.explode(_grams(whole)).alias("gram"))
    of_facts = facts.withColumn("on_name", F.explode(F.array(F.lit(False), F.lit(True))))
    of_facts = of_facts.withColumn("gram", F.explode(_grams(F.when(F.col("on_name"), F.lower("cleaned")).otherwise(F.col("text")))))
    seen = of_facts.join(_small(of_rules.select("on_name", "gram").distinct(), 16 * n_text), ["on_name", "gram"], "left_semi").groupBy("on_name", "gram").agg(F.count("*").alias("n"))
    ranked = of_rules.join(seen, ["on_name", "gram"], "left")
    key = ranked.groupBy("owner", "rule_id", "on_name").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    keyed = by_text.withColumn("on_name", merchant).alias("r").join(
        key.alias("k"), F.col("r.owner").eqNullSafe(F.col("k.owner")) & (F.col("r.rule_id") == F.col("k.rule_id")) & (F.col("r.on_name") == F.col("k.on_name"))
    ).select("r.*", "k.gram")
    keyed = _small(keyed, n_text).alias("r")
    found = of_facts.alias("f").join(keyed, [F.col("f.on_name") == F.col("r.on_name"), F.col("f.gram") == F.col("r.gram"), *same]).where(_matches())
    found = found.select(*(F.col(f"f.{c}") for c in facts.columns), *(F.col(f"r.{c}") for c in rules.columns))
    if n_nested:
        more = facts.alias("f").join(_small(nested, n_nested).alias("r"), [*same, _matches()] if same else _matches())
        found = found.unionByName(more.select(*(F.col(f"f.{c}") for c in facts.columns), *(F.col(f"r.{c}") for c in rules.columns)))
    return facts.unionByName(found, allowMissingColumns=True)


def _first(m: DataFrame, *keys: str) -> DataFrame:
    """Each field from the first rule by (priority, user first, id) that sets it."""
    order = F.struct("priority", (F.col("source") != "user"), "rule_id")
    first = lambda c: F.min_by(F.when(F.col(c).isNotNull(), F.struct(c, order.alias("o"))), F.when(F.col(c).isNotNull(), order))
    return m.groupBy(*keys).agg(*(first(c).alias(f"r_{c}") for c in _FIELDS))


def _defaults(merchants: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(shared, own) default categories, one row a key: those without an account,
    and those of an account. Of several rows of a key the least category counts."""
    m = merchants.where("default_category IS NOT NULL AND canonical IS NOT NULL")
    least = F.min("default_category")
    if "account_id" not in merchants.columns:
        return m.groupBy("canonical").agg(least.alias("shared_default")), None
    shared = m.where("account_id IS NULL").groupBy("canonical").agg(least.alias("shared_default"))
    return shared, m.where("account_id IS NOT NULL").groupBy("account_id", "canonical").agg(least.alias("own_default"))


def classify(rows: DataFrame, rules: DataFrame, merchants: DataFrame | None = None) -> DataFrame:
    """Adds merchant, category, txn_type and category_source to rows with
    description_raw and amount_cents; the rows' number and order of columns stay.

    ``merchants`` (canonical, default_category, and account_id if defaults belong
    to accounts) fills in what no rule sets: the account's own default first, then
    one without an account. Rules with an account_id are that account's own: they
    meet its narrations only, and come before the others."""
    facts = rows.select("description_raw", (F.col("amount_cents") > 0).alias("inflow")).distinct()
    keys = ["description_raw", "inflow", "text", "cleaned"]
    worded = lambda f: f.withColumn("text", F.lower(F.coalesce("description_raw", F.lit("")))).withColumn("cleaned", merchant_name(clean_description(F.col("description_raw"))))
    facts = written(worded(facts), "narrations")
    owner = F.col("account_id") if "account_id" in rules.columns else F.lit(None).cast("long")
    r = valid_rules(rules).select(owner.alias("owner"), "rule_id", "priority", "field", "match_type", F.lower("pattern").alias("p"), *_FIELDS, "source")
    n = {(k.own, k.text): k["count"] for k in r.groupBy(F.col("owner").isNotNull().alias("own"), F.coalesce(_indexed(), F.lit(False)).alias("text")).count().collect()}
    m = _first(_hits(facts, r.where("owner IS NULL"), n.get((False, True), 0), n.get((False, False), 0)), *keys)
    m = m.select(*keys, *(F.col(f"r_{c}.{c}").alias(f"r_{c}") for c in _FIELDS))
    m = m.withColumn("merchant", F.coalesce("r_merchant", "cleaned")).withColumn("canonical", canonical_key(F.col("merchant")))
    shared, own_defaults = _defaults(merchants) if merchants is not None else (None, None)
    m = m.join(shared, "canonical", "left") if shared is not None else m.withColumn("shared_default", F.lit(None).cast("string"))
    income = F.lit(False)
    for w in INCOME_WORDS:
        income = income | F.contains("text", F.lit(w))
    m = m.select(
        "description_raw", "inflow", "merchant", "canonical", "r_category", "shared_default", income.alias("income"),
        F.when(F.col("inflow") & F.col("r_category").isNull(), "credit").otherwise(F.coalesce("r_txn_type", F.lit("other"))).alias("txn_type"),
    )
    given = [c for c in rows.columns if c not in (*_FIELDS, "category_source", "inflow")]
    a, b = rows.withColumn("inflow", F.col("amount_cents") > 0).alias("a"), beside(m).alias("b")
    out = a.join(b, F.col("a.description_raw").eqNullSafe(F.col("b.description_raw")) & (F.col("a.inflow") == F.col("b.inflow")))
    default = F.col("b.shared_default")
    if own_defaults is not None and "account_id" in rows.columns:
        out = out.join(own_defaults.alias("o"), (F.col("a.account_id") == F.col("o.account_id")) & (F.col("b.canonical") == F.col("o.canonical")), "left")
        default = F.coalesce("o.own_default", default)
    inflow, ruled = F.col("a.inflow"), F.col("b.r_category")
    category = F.coalesce(ruled, F.when(inflow, "Income"), default, F.lit("Uncategorised"))
    source = F.when(ruled.isNotNull() | (inflow & F.col("b.income")), "rule").when(default.isNotNull() & ~inflow, "merchant").otherwise("default")
    out = out.select(*(F.col(f"a.{c}") for c in given), inflow.alias("inflow"), "b.merchant", category.alias("category"), "b.txn_type", source.alias("category_source"))
    n_own = n.get((True, True), 0) + n.get((True, False), 0)
    if not n_own or "account_id" not in rows.columns:
        return out.drop("inflow")
    mine = r.where("owner IS NOT NULL")
    owners = rows.join(_small(mine.select(F.col("owner").alias("account_id")).distinct(), n_own), "account_id", "left_semi")
    own = written(worded(owners.select("account_id", "description_raw", (F.col("amount_cents") > 0).alias("inflow")).distinct()), "own-narrations")
    u = _first(_hits(own, mine, n.get((True, True), 0), n.get((True, False), 0), owned=True).where("rule_id IS NOT NULL"), "account_id", "description_raw", "inflow")
    o = out.alias("a").join(
        u.alias("u"), (F.col("a.account_id") == F.col("u.account_id")) & F.col("a.description_raw").eqNullSafe(F.col("u.description_raw")) & (F.col("a.inflow") == F.col("u.inflow")), "left"
    )
    kept = [F.col(f"a.{c}") for c in given]
    by_user = F.col("u.r_category").isNotNull()
    return o.select(*kept, *(F.coalesce(F.col(f"u.r_{c}")[c], F.col(f"a.{c}")).alias(c) for c in ("merchant", "category", "txn_type")), F.when(by_user, "rule").otherwise(F.col("a.category_source")).alias("category_source"))


def reclassified(ledger: DataFrame, rules: DataFrame, all_but_user: bool = False, merchants: DataFrame | None = None) -> DataFrame:
    """The ledger with rows classified again that no rule has classified, or all
    that no user has. The old type stays where the new one says nothing."""
    old = ["merchant", "category", "txn_type", "category_source"]
    source = F.coalesce("category_source", F.lit("default"))
    open_ = source != "user" if all_but_user else source == "default"
    kept = ledger.where(~open_)
    again = ledger.where(open_).withColumnRenamed("txn_type", "_old_type").drop(*(c for c in old if c != "txn_type"))
    again = classify(again, rules, merchants)
    again = again.withColumn("txn_type", F.when(F.col("txn_type") == "other", F.coalesce("_old_type", "txn_type")).otherwise(F.col("txn_type"))).drop("_old_type")
    return kept.unionByName(again)
