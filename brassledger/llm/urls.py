"""URL filters: rules by host and path, and a classifier for the rest. DataFrame functions only.

A rule names a host, with all its subdomains, and the start of a path; of the
rules that fit a URL the longest decides. Where none fits, a logistic regression
on hashed character n-grams of host and path does. It is fitted to a small
labelled table by gradient steps, each one aggregation in Spark; gradients are
summed as whole numbers, so that the order of rows does not matter.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, small_or_shuffled

#: (rule, verdict) as given for the query.
RULES = (
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
)

#: Lengths of n-grams, buckets that they are hashed into, and steps of the fit.
GRAMS, BUCKETS, STEPS = (3, 4), 1 << 12, 25
#: Step length, share of the last step that goes on, and penalty on weights.
RATE, MOMENTUM, PENALTY = 0.1, 0.9, 1e-4
#: Share of URLs that are taken to be unwanted where no n-gram tells anything.
#: The labelled table holds far more, so the odds are moved by the difference.
PRIOR = 0.05
#: Gradients and weights are whole multiples of this part of one.
UNIT = 1_000_000
#: Labelled rows at most. They are the classifier's whole training table.
MAX_LABELLED = 10_000
#: Rules up to this many are tested row by row; more are joined by host.
FEW_RULES = 64

#: Names of hosts in the labelled table: kinds that a text corpus leaves out
#: (gambling, pills, adult, advertising, link farms, lures), and ordinary ones.
BLOCKED = (
    "casino-royale", "best-casino", "online-casino", "casino-bonus", "win-casino", "casino", "win-big", "big-win", "win-now", "jackpot-win",
    "free-slots", "slots-win", "poker-bets", "sports-bets", "bets-online", "free-bet", "bet-free", "bets", "live-bets", "cheap-meds", "cheap-viagra",
    "buy-pills", "pills-online", "pills-shop", "diet-pills", "cheap-pharma", "pills", "cheap-watches", "cheap-replica", "adult-video", "adult-dating",
    "adult-cams", "adult", "adult-chat", "xxx-cams", "sex-x", "porn-x", "xxx", "ads-server", "ads-network", "track-ads", "click-track", "ad-track",
    "tracker-ads", "ads", "tracking-pixel", "popup-ads", "ads-click", "banner-ads", "link-farm", "seo-farm", "content-farm", "farm-links", "spam-links",
    "spam-blog", "spam-mail", "spam", "seo-spam", "farm-spam", "free-prize", "free-money", "free-cash", "win-prize", "free-crypto", "get-rich",
    "cheap-loans", "free-followers",
)
ALLOWED = (
    "library", "news", "harbour", "encyclopedia", "university", "museum", "weather", "forum", "gardening", "project", "recipes", "city", "journal",
    "science", "archive", "letters", "thomas", "theatre", "transport", "school", "weekly", "culture", "mountain", "trail", "history", "nation",
    "politics", "radio", "station", "sharing", "reader", "thinking", "photo", "medicine", "standard", "linguistics", "orchestra", "translation",
    "nature", "birds", "painting", "chess", "walking", "kitchen", "southern", "another", "weathering", "through", "rather", "inner", "nation-wide",
    "river-trust", "farmhouse-museum", "open-data",
)
#: What stands around a name, the same for both kinds, so that it tells nothing.
SHAPES = (
    "https://www.{}.test/en/412", "http://{}.test/de/963?page=2", "https://blog.{}.test/en/7.html", "http://m.{}.test/fr/70/",
    "https://{}.test/en/539#top", "http://www.{}.test/es/articulo/5", "https://{}.test/2020/05/story.html?ref=x", "http://{}.test/",
)


def labelled(spark: SparkSession) -> DataFrame:
    """(url, blocked): each name above in two shapes, which go round."""
    rows = []
    for names, blocked in ((BLOCKED, True), (ALLOWED, False)):
        for k, name in enumerate(names):
            for shape in (SHAPES[k % len(SHAPES)], SHAPES[(k + 3) % len(SHAPES)]):
                rows.append(F.struct(F.lit(shape.format(name)).alias("url"), F.lit(blocked).alias("blocked")))
    return spark.range(1).select(F.inline(F.array(*rows)))


def host_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased, and path; both empty for null or where no ``://`` is."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.coalesce(F.translate(host, upper, lower), F.lit("")), F.coalesce(path, F.lit(""))


# --- the classifier ---


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is named."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _hashed(points: Column, n: int, kind: int, size: int) -> Column:
    """Buckets of the n-grams of code points: a polynomial, so that a gram costs no text."""

    def bucket(i: Column) -> Column:
        value = F.lit(kind * 8 + n).cast("long")
        for k in range(n):
            value = (value * 8191 + F.element_at(points, i + k)) % 1_000_003
        return (value % size).cast("int")

    starts = F.when(F.size(points) >= n, F.sequence(F.lit(1), F.size(points) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, bucket)


def _grams_of(kind: int, grams: tuple[int, ...], size: int, points: Column) -> Column:
    return F.concat(*(_hashed(points, n, kind, size) for n in grams))


def buckets(host: Column, path: Column, grams: tuple[int, ...] = GRAMS, size: int = BUCKETS) -> Column:
    """Bucket of each n-gram of ``^host$`` and of ``path$``, repeats included. Linear in the URL's length."""
    out = []
    for kind, text in ((1, F.concat(F.lit("^"), host, F.lit("$"))), (2, F.concat(path, F.lit("$")))):
        points = F.transform(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), lambda c: F.ascii(c).cast("long"))
        out.append(_let(points, partial(_grams_of, kind, grams, size)))
    return F.concat(*out)


def score(grams: Column, weights: list[int], bias: int) -> Column:
    """Log-odds in units: the bias, and the weights of the n-grams over the root of their count."""
    # One constant, which Spark computes once from its text.
    table = F.split(F.lit(",".join(map(str, weights))), ",").cast("array<long>")
    total = F.aggregate(grams, F.lit(0).cast("long"), lambda s, b: s + F.element_at(table, b + 1))
    return F.lit(bias) + total / F.sqrt(F.greatest(F.size(grams), F.lit(1)).cast("double"))


def fit(
    rows: DataFrame, steps: int = STEPS, size: int = BUCKETS, grams: tuple[int, ...] = GRAMS, prior: float = PRIOR, max_labelled: int = MAX_LABELLED
) -> tuple[list[int], int]:
    """(weights by bucket, bias) in units, from (url, blocked).

    Rows without a label are left out; a table of more than ``max_labelled`` rows
    is refused, as it is meant to be small. Without rows of both labels all
    weights are zero. The driver holds the weights only.
    """
    rows = rows.where("blocked IS NOT NULL")
    n, yes = rows.agg(F.count("*"), F.sum(F.col("blocked").cast("long"))).first()
    if n > max_labelled:
        raise ValueError(f"{n} labelled rows; the classifier is fitted to at most {max_labelled}")
    weights, bias = [0] * size, 0
    if not n or not 0 < yes < n:
        return weights, math.floor(UNIT * math.log(prior / (1 - prior)))
    host, path = host_path(F.col("url"))
    x = materialize(rows.select(buckets(host, path, grams, size).alias("g"), F.col("blocked").cast("double").alias("y")).coalesce(1), "url-grams")
    speed, bias_speed = [0] * size, 0
    for _ in range(steps):
        chance = 1 / (1 + F.exp(-score(F.col("g"), weights, bias) / UNIT))
        missed = x.select("g", (F.col("y") - chance).alias("e"))
        each = F.round(F.col("e") / F.sqrt(F.greatest(F.size("g"), F.lit(1)).cast("double")) * UNIT).cast("long")
        whole = F.round(F.col("e") * UNIT).cast("long")
        cells = missed.select(each.alias("d"), whole.alias("all"), F.explode(F.concat("g", F.array(F.lit(-1)))).alias("b"))
        total = F.sum(F.when(F.col("b") < 0, F.col("all")).otherwise(F.col("d")))
        # A row a bucket that the table touches, and one for the bias.
        for r in cells.groupBy("b").agg(total.alias("d")).collect():
            if r.b < 0:
                bias_speed = math.floor(MOMENTUM * bias_speed + RATE * r.d / 8)
                bias += bias_speed
            else:
                speed[r.b] = math.floor(MOMENTUM * speed[r.b] + RATE * r.d - RATE * PENALTY * weights[r.b])
                weights[r.b] += speed[r.b]
    return weights, bias + math.floor(UNIT * (math.log(prior / (1 - prior)) - math.log(yes / (n - yes))))


# --- rules ---


def rule_parts(rule: Column) -> tuple[Column, Column]:
    """Host and start of the path of a rule such as ``example.org/en/``; without a slash any path fits."""
    host = F.regexp_extract(rule, r"^([^/]*)", 1)
    return host, F.substring(rule, F.length(host) + 1, F.length(rule))


def _by_row(rows: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Longest fitting rule of few rules, tested in order of length."""
    fitting = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        host, slash, start = rule.partition("/")
        fits = ((F.col("host") == host) | F.endswith(F.col("host"), F.lit("." + host))) & F.startswith(F.col("path"), F.lit(slash + start))
        fitting = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(fitting)
    return rows.withColumn("found", fitting)


def _by_host(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """Longest fitting rule of many: hosts and their suffixes are looked up, for each distinct (host, path) once."""
    host, start = rule_parts(F.col("rule"))
    rules = rules.select(host.alias("suffix"), start.alias("start"), "rule", "verdict")
    pairs = rows.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffixes = pairs.select("host", "path", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("suffix"))
    found = (
        suffixes.join(small_or_shuffled(rules, 256), "suffix")
        .where(F.startswith("path", "start"))
        .groupBy("host", "path")
        .agg(F.max(F.struct(F.length("rule"), "rule", "verdict")).alias("m"))
        .select("host", "path", F.struct("m.rule", "m.verdict").alias("found"))
    )
    return rows.join(small_or_shuffled(materialize(found, "url-rules"), 256), ["host", "path"], "left")


def judged(
    pages: DataFrame,
    rules: DataFrame | tuple[tuple[str, str], ...] = RULES,
    labels: DataFrame | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
    few_rules: int = FEW_RULES,
    model: tuple[list[int], int] | None = None,
) -> DataFrame:
    """(page_id, host, path, rule, verdict, score), one row for each row.

    ``rules`` has (rule, verdict) and ``labels`` (url, blocked); both have
    defaults. ``model`` is what ``fit`` returned; it is fitted here if not given. Of rules of equal length the greater by code points decides, of
    one rule with two verdicts the greater verdict. score is the classifier's
    probability of ``block``, whether or not a rule decides. A URL that is null
    or has no ``://`` has an empty host and path and goes by that alone; so does
    an empty one. Rows that repeat an id or URL are judged alike; other columns
    are ignored; an empty table gives an empty result.
    """
    spark = pages.sparkSession
    weights, bias = model or fit(labels if labels is not None else labelled(spark))
    host, path = host_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    if isinstance(rules, DataFrame):
        rules = rules.where("rule IS NOT NULL AND verdict IS NOT NULL").groupBy("rule").agg(F.max("verdict").alias("verdict"))
        few = rules.limit(few_rules + 1).collect()
        rows = _by_row(rows, [tuple(r) for r in few]) if len(few) <= few_rules else _by_host(rows, rules)
    else:
        rows = _by_row(rows, list(rules))
    odds = score(buckets(F.col("host"), F.col("path")), weights, bias)
    rows = rows.withColumn("odds", odds)
    verdict = F.coalesce(F.col("found.verdict"), F.when(F.col("odds") > 0, "block").otherwise("allow"))
    chance = 1 / (1 + F.exp(-F.col("odds") / UNIT))
    return rows.select("page_id", "host", "path", F.col("found.rule").alias("rule"), verdict.alias("verdict"), chance.alias("score"))


def oracle_sql() -> str:
    """Hosts, paths, rules and verdicts in SQL (DuckDB) at the default parameters, the fit included."""
    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    urls = [(SHAPES[k % len(SHAPES)], SHAPES[(k + 3) % len(SHAPES)], name, blocked) for names, blocked in ((BLOCKED, 1), (ALLOWED, 0)) for k, name in enumerate(names)]
    rows = ", ".join(f"({quoted(s.format(name))}, {blocked})" for a, b, name, blocked in urls for s in (a, b))
    rules = ", ".join(f"({quoted(r)}, {quoted(r.split('/', 1)[0])}, {quoted('/' + r.split('/', 1)[1])}, {quoted(v)})" for r, v in RULES)

    def grams(source: str) -> str:
        return " UNION ALL ".join(
            f"SELECT url, {_poly(text, n, kind)} % {BUCKETS} AS b "
            f"FROM {source}, range(1, length({text}) - {n - 2}) r(i)"
            for kind, text in ((1, "('^' || host || '$')"), (2, "(path || '$')"))
            for n in GRAMS
        )

    parts = """CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END"""
    split = lambda source, more: f"""
  SELECT url{more}, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(h) + 1), '^([^?#]*)', 1) AS path
  FROM (SELECT *, regexp_extract(rest, '^([^/?#]*)', 1) AS h FROM (SELECT *, coalesce({parts}, '') AS rest FROM {source}))"""  # noqa: E731
    steps = []
    for s in range(STEPS):
        steps.append(f"""
e{s} AS MATERIALIZED (
  SELECT f.url, any_value(y) - 1 / (1 + exp(-(any_value(z.w) + sum(c * w{s}.w)::BIGINT / sqrt(any_value(n))) / {UNIT})) AS e
  FROM f JOIN w{s} USING (b), w{s} z WHERE z.b = -1 GROUP BY f.url),
w{s + 1} AS MATERIALIZED (
  SELECT b, (w + v)::BIGINT AS w, v FROM (
    SELECT b, w, floor(CASE WHEN b < 0 THEN {MOMENTUM}::DOUBLE * v + {RATE}::DOUBLE * d / 8
                            ELSE {MOMENTUM}::DOUBLE * v + {RATE}::DOUBLE * d - {RATE * PENALTY!r}::DOUBLE * w END)::BIGINT AS v
    FROM w{s} JOIN (
      SELECT b, sum(c * round(e / sqrt(n) * {UNIT})::BIGINT)::BIGINT AS d FROM f JOIN e{s} USING (url) GROUP BY b
      UNION ALL SELECT -1, sum(round(e * {UNIT})::BIGINT)::BIGINT FROM e{s}) USING (b)))""")
    return f"""
WITH lab(url, y) AS (VALUES {rows}),
rules(rule, rh, rp, verdict) AS (VALUES {rules}),
lp AS MATERIALIZED ({split("lab", ", y")}),
g AS ({grams("lp")}),
f AS MATERIALIZED (
  SELECT c.*, n, y FROM (SELECT url, b, count(*) AS c FROM g GROUP BY ALL) c
  JOIN (SELECT url, count(*) AS n FROM g GROUP BY ALL) USING (url) JOIN lab USING (url)),
w0 AS MATERIALIZED (SELECT DISTINCT b, 0::BIGINT AS w, 0::BIGINT AS v FROM f UNION ALL SELECT -1, 0, 0),{",".join(steps)},
p AS MATERIALIZED ({split("(SELECT page_id, url FROM pages)", ", page_id")}),
pg AS MATERIALIZED (SELECT DISTINCT host || ' ' || path AS url, host, path FROM p),
q AS ({grams("pg")}),
odds AS (
  SELECT url, sum(coalesce(w, 0))::BIGINT / sqrt(count(*)) AS o FROM q LEFT JOIN w{STEPS} USING (b) GROUP BY url),
bias AS (SELECT w + (SELECT floor({UNIT} * (ln({PRIOR} / {1 - PRIOR}) - ln(sum(y) / (count(*) - sum(y)))))::BIGINT FROM lab) AS w FROM w{STEPS} WHERE b = -1),
r AS (
  SELECT page_id, p.host, p.path, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS said
  FROM p LEFT JOIN rules ON (p.host = rh OR ends_with(p.host, '.' || rh)) AND starts_with(p.path, rp) GROUP BY ALL)
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN (SELECT w FROM bias) + coalesce(o, 0) > 0 THEN 'block' ELSE 'allow' END) AS verdict
FROM r LEFT JOIN odds ON odds.url = host || ' ' || path
"""


def _poly(text: str, n: int, kind: int) -> str:
    value = f"{kind * 8 + n}::BIGINT"
    for k in range(n):
        value = f"(({value} * 8191 + unicode(substr({text}, i::INT + {k}, 1))) % 1000003)"
    return value
