"""Operator 5: URL filters, in DataFrame functions only.

Rules of host and path come first: a rule fits its host and all subdomains if
the URL's path starts with the rule's, and the longest fitting rule wins.  Other
URLs go to a logistic regression on hashed character n-grams of host and path.
It is trained on a small labelled table: the buckets of at most MOST_LABELLED rows
are made by one query, and the gradient steps over them need no further job.  The
BUCKETS + 1 weights then stand in the plan as a literal, so scoring is a
projection without join or shuffle.

Defined results: a null URL or one without "://" has empty host and path, no
rule, and the model's verdict on an empty text; only A-Z are lower-cased; ports
and user names stay part of the host; repeated rows give repeated rows; other
columns are dropped, so their names cannot clash; an empty table gives no rows,
and without labelled rows all weights are 0.
"""

from __future__ import annotations

from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

BUCKETS = 2039
GRAMS = (3, 4, 5)
EPOCHS = 300
RATE = 4.0
DECAY = 1e-4
MOST_LABELLED = 512
THRESHOLD = 0.5

#: (host, path, verdict) of the standing rules.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]

# The labelled table is built from names by a rule: prefixes, zones and paths go
# round alike in both labels, so only the names tell them apart.  Blocked names are
# pairs of words of one trade, allowed ones are ordinary words and pairs of them.
TRADES = [
    "casino poker slots jackpot betting bets bonus lucky win spins".split(),
    "pills meds pharmacy drugs cheap discount online tablets diet".split(),
    "adult cams dating singles hot webcam x sexy videos".split(),
    "spam links farm clicks seo traffic backlinks bulk mail".split(),
    "ads banner track popups tracker pixel adserver network clicks".split(),
    "free money prizes lottery gifts cash offers bets win".split(),
]
ORDINARY = """library news garden weather history museum science nation other thanks thesis anthem reading interest station recipes thought ocean forest school
travel music theory edition whether things painting health weaving nothing earth union northern atlas shelter honest bridge tender breath winter orchestra
mountain river teacher father mother brother leather feather gather throne author method rhythm theatre athlete mathematics philosophy photograph author
motion notion lotion action fiction section position tradition question relation location mission vision another together further neither bother
healthy wealthy stand hand land thin then there those three thunder thread thirty""".split()


def names() -> tuple[list[str], list[str]]:
    """Blocked and allowed names."""
    blocked = [f"{a}-{words[(i + step) % len(words)]}" for words in TRADES for i, a in enumerate(words) for step in (3, 4)]
    allowed = ORDINARY + [f"{a}-{b}s" for a, b in zip(ORDINARY, ORDINARY[7:])] + [f"{a}{b}" for a, b in zip(ORDINARY, ORDINARY[11:])]
    return blocked, allowed


def examples(names: list[str]) -> list[str]:
    """A URL of each name."""
    out = []
    for i, name in enumerate(names):
        prefix, zone, lang, tail = ("", "www.", "blog.", "m.")[i % 4], ("com", "net", "org")[i % 3], ("en", "en", "fr", "de", "es")[i % 5], ("", "/", ".html")[i % 3]
        out.append(f"https://{prefix}{name}.example.{zone}/{lang}/{(i * 37) % 1000}{tail}")
    return out


def labelled_rows() -> list[tuple[str, float]]:
    return [(u, y) for y, own in zip((1.0, 0.0), names()) for u in examples(own)]


def labelled(spark: SparkSession) -> DataFrame:
    """url, label (1: block)."""
    rows = F.array(*(F.struct(F.lit(u).alias("url"), F.lit(y).alias("label")) for u, y in labelled_rows()))
    return spark.range(1).select(F.inline(rows))


def _after(url: Column) -> Column:
    """What follows the first "://", or null."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host(url: Column) -> Column:
    found = F.regexp_extract(_after(url), r"^[^/?#]*", 0)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _kinds(host, path, joined) -> list[tuple[int, object]]:
    """Salts and the marked texts that n-grams are taken from."""
    return [(17, joined("^", host, "$")), (29, joined(path, "$"))]


def buckets(host: Column, path: Column, n_buckets: int = BUCKETS) -> Column:
    """Bucket numbers of the n-grams: their character codes as digits, modulo n_buckets, plus 1; bucket 0 is the bias."""
    found = [F.array(F.lit(0))]
    for salt, whole in _kinds(host, path, lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))):
        codes = F.transform(F.split(whole, ""), lambda c: F.ascii(c).cast("long"))
        # a lambda variable holds the codes, so they are made once
        found.append(F.get(F.transform(F.array(codes), _grams(salt, n_buckets)), 0))
    return F.concat(*found)


def _grams(salt: int, n_buckets: int):
    def of(codes: Column) -> Column:
        found = []
        for n in GRAMS:
            places = F.when(F.size(codes) >= n, F.sequence(F.lit(0), F.size(codes) - n)).otherwise(F.array().cast("array<int>"))
            found.append(F.transform(places, _bucket(codes, salt + n, n, n_buckets)))
        return F.concat(*found)

    return of


def _bucket(codes: Column, salt: int, n: int, n_buckets: int):
    def at(i: Column) -> Column:
        value = F.lit(salt).cast("long")
        for k in range(n):
            value = value * 131 + F.get(codes, i + k)
        return (value % n_buckets + 1).cast("int")

    return at


def fit(rows: list[tuple[float, list[int]]], n_buckets: int = BUCKETS, epochs: int = EPOCHS, rate: float = RATE, decay: float = DECAY) -> list[float]:
    """Weights of the bias and the buckets, from labels and bucket numbers, by gradient steps with momentum."""
    w, speed = np.zeros(n_buckets + 1), np.zeros(n_buckets + 1)
    label, size = np.array([y for y, _ in rows]), np.array([len(found) for _, found in rows], np.int64)
    row, bucket = np.repeat(np.arange(len(rows)), size), np.array([b for _, found in rows for b in found], np.int64)
    scale = 1 / np.sqrt(size)
    for _ in range(epochs if rows else 0):
        error = (1 / (1 + np.exp(-np.bincount(row, w[bucket], len(rows)) * scale)) - label) * scale
        speed = 0.9 * speed - rate * (np.bincount(bucket, error[row], n_buckets + 1) / len(rows) + decay * w)
        w = w + speed
    return w.tolist()


def train(rows: DataFrame, n_buckets: int = BUCKETS, epochs: int = EPOCHS, rate: float = RATE, decay: float = DECAY) -> list[float]:
    """Weights of the bias and the buckets, from at most MOST_LABELLED rows of url and label; one job."""
    made = rows.filter(F.col("url").isNotNull() & F.col("label").isNotNull()).select(F.col("url").cast("string").alias("url"), F.col("label").cast("double").alias("y"))
    made = made.orderBy(F.md5("url"), "url", "y").limit(MOST_LABELLED).withColumn("b", buckets(host(F.col("url")), path(F.col("url")), n_buckets))
    return fit([(r["y"], r["b"]) for r in made.collect()], n_buckets, epochs, rate, decay)


def probability(found: str, weights: list[float]) -> Column:
    """The model's probability of blocking, from a column of bucket numbers."""
    w = F.lit(weights)
    z = F.aggregate(found, F.lit(0.0), lambda s, i: s + F.get(w, i)) / F.sqrt(F.size(found).cast("double"))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def filter_urls(pages: DataFrame, weights: list[float], rules: list[tuple[str, str, str]] = RULES, key: str = "page_id") -> DataFrame:
    """key, host, path, rule, verdict, score (the model's probability of blocking)."""
    out = pages.select(F.col(key), F.col("url").cast("string").alias("url")).select(key, host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, told in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((F.col("host") == h) | F.endswith(F.col("host"), F.lit(f".{h}"))) & F.startswith(F.col("path"), F.lit(p))
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, told).otherwise(verdict)
    out = out.withColumn("rule", rule).withColumn("found", buckets(F.col("host"), F.col("path"), len(weights) - 1)).withColumn("score", probability("found", weights))
    return out.withColumn("verdict", F.coalesce(verdict, F.when(F.col("score") >= THRESHOLD, "block").otherwise("allow"))).select(key, "host", "path", "rule", "verdict", "score")


@cache
def _weights() -> tuple[float, ...]:
    """What train(labelled()) gives, for the SQL, from the same rows in the same order."""
    from hashlib import md5

    rows = []
    for url, y in sorted(labelled_rows(), key=lambda r: (md5(r[0].encode()).hexdigest(), r)):
        rest = url.split("://", 1)[1]
        cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        found = [0]
        for salt, whole in _kinds(rest[:cut].lower(), rest[cut:], lambda *parts: "".join(parts)):
            for n in GRAMS:
                for i in range(len(whole) - n + 1):
                    value = salt + n
                    for c in whole[i : i + n]:
                        value = value * 131 + ord(c)
                    found.append(value % BUCKETS + 1)
        rows.append((y, found))
    return tuple(fit(rows[:MOST_LABELLED]))


def sql() -> str:
    """The same verdicts in SQL; the weights are the trained ones, all else is worked out anew."""
    marked = {17: "'^' || host || '$'", 29: "path || '$'"}
    digits = lambda n: " + ".join(f"unicode(substr(t, i + {k}, 1))::BIGINT * {131 ** (n - 1 - k)}" for k in range(n))
    grams = " UNION ALL ".join(
        f"SELECT page, (({salt + n} * {131**n}::BIGINT + {digits(n)}) % {BUCKETS} + 1)::INT AS b FROM (SELECT page, t, unnest(range(1, length(t) - {n} + 2)) AS i FROM (SELECT page, {whole} AS t FROM parts))"
        for salt, whole in marked.items() for n in GRAMS
    )
    fits = " UNION ALL ".join(
        f"SELECT page, '{h + p}' AS rule, '{told}' AS told FROM parts WHERE (host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}')" for h, p, told in RULES
    )
    return f"""
WITH rests AS (
  SELECT row_number() OVER () AS page, page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM (SELECT page, page_id, coalesce(rest, '') AS rest FROM rests)),
fits AS ({fits}),
longest AS (SELECT page, arg_max(rule, length(rule)) AS rule, arg_max(told, length(rule)) AS told FROM fits GROUP BY page),
weights AS (SELECT unnest(range(0, {BUCKETS + 1}))::INT AS b, unnest([{', '.join(map(repr, _weights()))}]::DOUBLE[]) AS w),
grams AS (SELECT page, 0 AS b FROM parts UNION ALL {grams}),
sums AS (SELECT page, sum(w) / sqrt(count(*)) AS z FROM grams JOIN weights USING (b) GROUP BY page)
SELECT page_id, host, path, rule, coalesce(told, CASE WHEN 1 / (1 + exp(-z)) >= {THRESHOLD} THEN 'block' ELSE 'allow' END) AS verdict
FROM parts JOIN sums USING (page) LEFT JOIN longest USING (page)
"""
