"""URL rules and classifier against plain Python, and on awkward tables."""

import math
import re

import pytest
from brassledger.llm import urls
from brassledger.llm.queries import ORACLE_SQL, QUERIES
from conftest import rows_of

SCHEMA = "page_id long, url string, html string, host int, path string, rule int, verdict string, score string, odds int, found string"


def table(spark, found):
    return spark.createDataFrame([(i, u, "x", 1, "y", 2, "z", "s", 3, "f") for i, u in enumerate(found)], SCHEMA).repartition(3)


def cut(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3 :]
    host = re.match(r"[^/?#]*", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match(r"[^?#]*", rest[len(host) :])[0]


def grams(host, path):
    out = []
    for kind, text in ((1, f"^{host}$"), (2, f"{path}$")):
        for n in urls.GRAMS:
            for i in range(len(text) - n + 1):
                value = kind * 8 + n
                for c in text[i : i + n]:
                    value = (value * 8191 + ord(c)) % 1_000_003
                out.append(value % urls.BUCKETS)
    return out


def rule_of(host, path, rules):
    fit = [(len(r), r, v) for r, v in rules for h, s, p in [r.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith(s + p)]
    return max(fit)[1:] if fit else (None, None)


WEIRD = [
    None, "", "no scheme", "http://", "://a", "HTTP://EXAMPLE.ORG/en/12?x#y", "http://notexample.org/es/", "http://a.example.org/es/", "http://example.org", "http://org/x",
    "http://example.com?/fr/", "http://x.com/fr/1", "http://x.com/de/1#a?b", "http://Zürich.org/ü/中文?q", "http://a//b", "http://h/" + "long/" * 60000, "mailto:x://com/de/", "http://ÀB.com/\n/fr/", "http://😀.net/😀x",
]


def test_equals_sql(spark, sf_dir, duck):
    have = QUERIES["op12_urls"](spark, sf_dir).toPandas()
    assert rows_of(have) == rows_of(duck.sql(ORACLE_SQL["op12_urls"]).df())


@pytest.fixture(scope="module")
def fitted(spark):
    return urls.fit(urls.labelled(spark))


def test_equals_plain(spark, fitted):
    """Whole rows, weird URLs among them, with the rules row by row and by host."""
    weights, bias = fitted
    found = WEIRD + [u for u in WEIRD[-10:]] + [r.url for r in urls.labelled(spark).collect()]
    by_host = {}
    for few in (64, 0):
        rules = spark.createDataFrame([*urls.RULES, ("example.org/es/", "allow"), (None, "block"), ("x.com/", None)], "rule string, verdict string")
        by_host[few] = {r.page_id: r for r in urls.judged(table(spark, found), rules, few_rules=few, model=fitted).collect()}
    default = {r.page_id: r for r in urls.judged(table(spark, found), model=fitted).collect()}
    assert len(default) == len(found)
    for i, url in enumerate(found):
        host, path = cut(url)
        odds = bias + sum(weights[b] for b in grams(host, path)) / math.sqrt(max(1, len(grams(host, path))))
        rule, said = rule_of(host, path, urls.RULES)
        for have in (default[i], by_host[64][i], by_host[0][i]):
            assert (have.host, have.path, have.rule, have.verdict) == (host, path, rule, said or ("block" if odds > 0 else "allow")), url
            assert have.score == pytest.approx(1 / (1 + math.exp(-odds / urls.UNIT)))


def test_fit_by_plain_steps(spark, fitted):
    rows = [(grams(*cut(r.url)), r.blocked) for r in urls.labelled(spark).collect()]
    weights, speed, bias, pace = [0] * urls.BUCKETS, [0] * urls.BUCKETS, 0, 0
    for _ in range(urls.STEPS):
        gradient, all_ = [None] * urls.BUCKETS, 0
        for g, y in rows:
            e = y - 1 / (1 + math.exp(-(bias + sum(weights[b] for b in g) / math.sqrt(len(g))) / urls.UNIT))
            all_ += round(e * urls.UNIT)
            for b in g:
                gradient[b] = (gradient[b] or 0) + round(e / math.sqrt(len(g)) * urls.UNIT)
        pace = math.floor(urls.MOMENTUM * pace + urls.RATE * all_ / 8)
        bias += pace
        for b, d in enumerate(gradient):
            if d is not None:
                speed[b] = math.floor(urls.MOMENTUM * speed[b] + urls.RATE * d - urls.RATE * urls.PENALTY * weights[b])
                weights[b] += speed[b]
    # Exponentials of the two languages may differ in the last bit, and a rounded gradient by one.
    assert max(abs(a - b) for a, b in zip(weights, fitted[0], strict=True)) < 200


def test_held_out_hosts(spark, fitted):
    """Names that the labelled table does not hold, with its words in them or not."""
    bad = ["casino-palace", "super-casino", "pills-4-you", "adult-zone", "ads-exchange", "spam-hub", "cheap-viagra-24"]
    good = ["lakeside", "parliament", "rivers", "grammar-school", "painter", "harvest", "telescope", "stonework"]
    found = [f"https://www.{h}.invalid/en/{k}" for k, h in enumerate(bad + good)]
    verdicts = [r.verdict for r in urls.judged(table(spark, found), model=fitted).orderBy("page_id").collect()]
    assert verdicts == ["block"] * len(bad) + ["allow"] * len(good)


def test_no_python_on_the_path(spark, fitted):
    df = urls.judged(table(spark, WEIRD), model=fitted)
    plan = df._jdf.queryExecution().toString()
    assert not re.search(r"Python|Arrow|Pandas|ExternalRDD", plan.replace("Scan ExistingRDD", ""))


def test_awkward_tables(spark, fitted):
    assert urls.judged(table(spark, []), model=fitted).count() == 0
    none = spark.createDataFrame([], "url string, blocked boolean")
    one = spark.createDataFrame([("http://a.b/", True), (None, None)], "url string, blocked boolean")
    for labels in (none, one):  # nothing to learn: only the prior speaks
        assert {r.verdict for r in urls.judged(table(spark, ["http://casino.net/"]), labels=labels).collect()} == {"allow"}
    with pytest.raises(ValueError):
        urls.fit(one.where("blocked"), max_labelled=0)
