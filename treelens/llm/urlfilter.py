"""URL filter: longest-prefix rules, then logistic regression on hashed character n-grams.

A URL is as bad as its worst piece (a run of letters and digits of its host or
path), so that a long host or path does not dilute what one word says.  The
labelled URLs teach pieces: all pieces of a good URL are good, a piece that only
bad URLs have is bad.

Training happens in SQL on a small labelled table: logistic regression by
gradient descent from zero keeps its weights in the span of the examples, so
the descent runs on one coefficient per example (their Gram matrix is tiny)
inside a single higher-order expression; the weights follow from one
aggregation.  Scoring a URL is a sum of table look-ups.  No Python runs on
the executors.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import save

#: (host and its subdomains, path prefix, verdict); the longest fitting rule wins.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)

# The labelled URLs that the model is trained from unless another table is given: invented hosts, by a rule.
_BAD = "casino poker slots betting bets gambling jackpot viagra pills pharma porn xxx adult escort webcam spam spamlinks clickfarm warez cracks keygen malware phishing replica payday".split()
_GOOD = "news docs library university museum recipes weather wiki forum journal school research garden travel music health science sports city maps history theatre kitchen river reading building clothing evening printing spring teaching spanish special spain space parking carpet cinema pilot penguin portal".split()
_PLAIN = "velora minathe sorenth tarion ondale thestin larenth evonne marisol brennach dolive castelle norand ithera penwick aldine".split()
_ENDINGS = ("com", "net", "org", "info")
# words that good and bad URLs have alike
_COMMON = "offer free join bonus best order login download online video watch play room tables world service apply verify sale odds shop farm link cheap win buy now hot track index archive author topic".split()


def _labelled() -> list[tuple[str, int]]:
    """(url, label): 1 means block."""
    rows = []
    for i, word in enumerate(_BAD):
        rows += [(f"https://{word}-{_PLAIN[i % 16]}.{_ENDINGS[i % 4]}/{('offer', 'free', 'join', 'bonus')[i % 4]}/{i}", 1), (f"http://www.best-{word}.{_ENDINGS[(i + 1) % 4]}/{word}/{7 * i}", 1)]
        rows += [(f"http://{word}{_BAD[(i + 7) % 24]}.{_PLAIN[(i + 9) % 16]}.{_ENDINGS[(i + 2) % 4]}/{_BAD[(i + 3) % 24]}", 1)]
        rows += [(f"http://{_COMMON[(5 * i) % len(_COMMON)]}{word}.{_PLAIN[(i + 3) % 16]}.{_ENDINGS[i % 4]}/{_COMMON[(i + 11) % len(_COMMON)]}{word}", 1)]
    for i, word in enumerate(_GOOD):
        rows += [(f"https://{word}.{_PLAIN[i % 16]}.{_ENDINGS[i % 4]}/en/{3 * i}", 0), (f"http://www.{_PLAIN[(i + 5) % 16]}-{word}.{_ENDINGS[(i + 1) % 4]}/{('article', 'guide', 'page', 'de')[i % 4]}/{i}.html", 0)]
        rows += [(f"http://{word}{('', '-')[i % 2]}{_GOOD[(i + 7) % 24]}.{_PLAIN[(i + 9) % 16]}.{_ENDINGS[(i + 2) % 4]}/{_GOOD[(i + 3) % 24]}", 0)]
    rows += [(f"https://www.{_PLAIN[i % 16]}.{_ENDINGS[i % 4]}/{word}/{_COMMON[(i + 5) % len(_COMMON)]}-{i}.html", 0) for i, word in enumerate(_COMMON)]
    for i, word in enumerate(_PLAIN):
        rows += [(f"https://{('m', 'blog', 'www')[i % 3]}.{word}.{_ENDINGS[k]}/{('en', 'de', 'fr', 'es')[k]}/{37 * i + k}{('', '/', '.html', '?page=2')[k]}", 0) for k in range(4)]
    return rows


LABELLED = tuple(_labelled())

DIMENSIONS = 1 << 15
ORDERS = (3, 4, 5)
STEPS, RATE, PENALTY = 400, 0.1, 0.001
#: Value of the bias's feature; less than an example's length, or the bias alone would sway in the descent.
BIAS = 0.3
#: The labelled table must be small: pieces of its URLs at most.
MAX_EXAMPLES = 500

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, "^(?s:.*?)://([^/?#]*+)", 1), _UPPER, _LOWER), F.lit(""))


def path(url: Column) -> Column:
    """From the end of the host up to ? or # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, "^(?s:.*?)://[^/?#]*+([^?#]*+)", 1), F.lit(""))


def pieces(host: Column, path: Column) -> Column:
    """The distinct runs of letters and digits of host and path that have a letter, in lower case; one empty piece if there is none."""
    found = F.array_distinct(F.filter(F.split(F.lower(F.concat_ws("/", host, path)), r"[^\p{L}\p{N}]+"), lambda p: p.rlike(r"\p{L}")))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("")))


def grams(piece: Column, dimensions: int = DIMENSIONS) -> Column:
    """Distinct buckets of the character n-grams of a piece with its ends."""
    text = F.concat(F.lit("^"), piece, F.lit("$"))

    def of(n: int) -> Column:
        starts = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.pmod(F.xxhash64(F.substring(text, i, F.lit(n))), F.lit(dimensions)).cast("int"))

    return F.array_distinct(F.concat(*[of(n) for n in ORDERS]))


def labelled_urls(spark: SparkSession) -> DataFrame:
    return spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{url}', {label})" for url, label in LABELLED) + " AS labelled(url, label)")


def train(labelled: DataFrame, dimensions: int = DIMENSIONS, steps: int = STEPS, rate: float = RATE, penalty: float = PENALTY) -> tuple[list[float], float]:
    """(weight of each bucket, bias) from ``url, label`` (1: block).

    The examples are the URLs' pieces: 0 if any good URL has the piece, else 1.
    Rows with a null or a label other than 0 and 1 are ignored; a table
    without usable rows gives zero weights; more than MAX_EXAMPLES pieces are
    an error, since the descent runs in one task.
    """
    rows = labelled.where("url is not null and label in (0, 1)")
    rows = rows.select("label", F.explode(pieces(host(F.col("url")), path(F.col("url")))).alias("piece")).groupBy("piece").agg(F.min("label").cast("double").alias("y"))
    rows = rows.where("piece <> ''").select("piece", "y", grams(F.col("piece"), dimensions).alias("x"))
    count = rows.count()
    if count > MAX_EXAMPLES:
        raise ValueError(f"{count} pieces of labelled URLs; at most {MAX_EXAMPLES} are meant for training")
    # unit-length examples: each n-gram weighs 1 / sqrt(number of n-grams)
    data = rows.agg(F.array_sort(F.collect_list(F.struct("piece", "y", "x"))).alias("d"))
    n = F.size("d")
    ids = F.sequence(F.lit(0), n - 1)

    def dot(a: Column, b: Column) -> Column:
        return F.size(F.array_intersect(a["x"], b["x"])) / F.sqrt(F.size(a["x"]) * F.size(b["x"]).cast("double"))

    # written and read back, here and below: else the optimiser would put the matrix into the descent's loops
    data = save(data.where(n > 0).withColumn("k", F.transform("d", lambda a: F.transform("d", lambda b: dot(a, b) + BIAS * BIAS))), "gram")
    zero = F.transform("d", lambda _: F.lit(0.0))

    def step(alpha: Column, _: Column) -> Column:
        def moved(i: Column) -> Column:
            z = F.aggregate(F.arrays_zip(alpha.alias("a"), F.get("k", i).alias("k")), F.lit(0.0), lambda s, t: s + t["a"] * t["k"])
            return F.get(alpha, i) * (1 - rate * penalty) + rate * (F.get("d", i)["y"] - 1 / (1 + F.exp(-z)))

        return F.transform(ids, moved)

    fitted = save(data.select("d", F.aggregate(F.sequence(F.lit(1), F.lit(steps)), zero, step).alias("alpha")), "descent")
    each = fitted.select(F.explode(F.arrays_zip("d", "alpha")).alias("e")).select(F.col("e.alpha").alias("alpha"), F.col("e.d.x").alias("x"))
    weights = each.select("alpha", F.explode("x").alias("g"), F.size("x").alias("m")).groupBy("g").agg(F.sum(F.col("alpha") / F.sqrt(F.col("m").cast("double"))).alias("w"))
    out = [0.0] * dimensions
    for r in weights.collect():  # at most `dimensions` rows
        out[r.g] = r.w
    return out, BIAS * BIAS * each.agg(F.coalesce(F.sum("alpha"), F.lit(0.0))).first()[0]


def rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule as a struct (rule, verdict), or null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for name, prefix, verdict in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(prefix)
        found = F.when(fits, F.struct(F.lit(name + prefix).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def judge(pages: DataFrame, labelled: DataFrame | None = None, rules=RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` of every page's url.

    The verdict is the rule's if one fits, else block where the model's score
    (probability of block of the worst piece) is at least 0.5.  Null urls and
    urls without :// have an empty host and path, no rule, and the verdict of
    the model on an empty piece; repeated rows each get a row; null page_ids stay null;
    extra columns are ignored; an empty table gives an empty table.
    """
    weights, bias = train(labelled if labelled is not None else labelled_urls(pages.sparkSession))
    table = F.from_json(F.lit(json.dumps(weights)), "array<double>")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    rows = rows.withColumn("_rule", rule(F.col("host"), F.col("path"), rules)).withColumn("_x", F.transform(pieces(F.col("host"), F.col("path")), lambda p: grams(p)))

    def strength(x: Column) -> Column:
        return F.aggregate(x, F.lit(0.0), lambda s, g: s + F.get(table, g)) / F.sqrt(F.greatest(F.size(x), F.lit(1)).cast("double"))

    z = F.array_max(F.transform("_x", strength)) + F.lit(bias)
    rows = rows.withColumn("score", 1 / (1 + F.exp(-z)))
    verdict = F.coalesce(F.col("_rule.verdict"), F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return rows.select("page_id", "host", "path", F.col("_rule.rule").alias("rule"), verdict.alias("verdict"), "score")
