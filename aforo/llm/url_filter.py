"""URL filters: host and path rules, else logistic regression on hashed character n-grams.

The classifier is trained with MLlib on a small labelled table of URLs and used as a SQL expression:
its weights are one array literal of fixed length, looked up by the hashes of the n-grams. N-grams of host and path
have buckets of their own and are each normalised by their number, so that a long path hides no host. URLs
are judged row by row in the JVM, without shuffle, Python or UDF.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A to Z lower-cased; path: what
follows up to ``?``, ``#`` or the end. Null urls and urls without ``://`` have an empty host and
path, fit no rule and get the classifier's verdict on two empty strings. N-grams come from one pass
of a look-ahead pattern, so that very long urls cost linear time. Repeated rows are judged alike; an
empty table gives an empty result; other columns than the id and the url are not read.
"""

from __future__ import annotations

from functools import cache

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel, Normalizer, VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aforo.llm.common import LOWER, UPPER

#: Buckets for hashed n-grams of host and of path, lengths of n-grams, ridge penalty, probability from which a url is blocked.
BUCKETS, LENGTHS, PENALTY, THRESHOLD = 16384, (3, 4, 5), 0.00001, 0.5

#: (verdict, rule): host and path of a rule as one string, parted by its first slash.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))

#: The small labelled table is made of words that tell an unwanted url, and of ordinary ones, some of which look like them.
_UNWANTED = """
viagra cialis pills meds pharma casino poker slots roulette jackpot bets betting gambling bingo lotto porn xxx sex sexy adult cams nude escort
hookup dating payday loans lender prize giveaway replica warez crack keygen torrent spam ads adserver adtrack banner popup click tracker phish
malware botnet cheats linkfarm backlinks followers winmoney easycash
""".split()
_ORDINARY = """
library museum university archive weather town garden recipes mountain river data radio theatre school language physics history maths chess
birds travel railway harbour orchestra times herald gazette tribune research institute theory methods nation station tradition interest other
northern southern western eastern theorem anthem thinking inland outland handmade standing listing reading writing thread throne third thistle
enterprise hound ounce leather essex sussex specialist uploads roads leads alphabets tibet cracker pillar mediterranean slotting lookout
updating banners-museum tracking-birds market kitchen bakery cinema football cycling hiking science biology chemistry geology astronomy poetry
painting sculpture photography software hardware network security database compiler hospital clinic dentist lawyer council parliament election
economy finance banking insurance school-bus children family parents teacher student college campus conference journal magazine newspaper
""".split()
#: What stands beside such words in either kind.
_BESIDE = "best free online my super the shop world zone club pro city home 24 365 new top net web hub".split()
#: Paths of pages of either kind, and paths that are unwanted by themselves.
_PATHS = ("/", "/en/17", "/de/58.html", "/fr/203/", "/es/911", "/2024/05/story", "/articles/spring-market.html", "/about/team", "/wiki/history_of_science", "")
_UNWANTED_PATHS = ("/buy-{}-online", "/{}/{}", "/go/{}-{}.html", "/cheap_{}", "/best-{}-2024/", "/offers/free-{}")
_ORDINARY_PATHS = ("/{}", "/{}/{}.html", "/read-{}-online", "/best-{}-2024/", "/news/{}-and-{}", "/shop/{}_{}")
_DOMAINS = ("{}.example.com", "www.{}.example.net", "blog.{}.example.org", "m.{}.com", "{}.org", "{}.net")


def labelled_urls(spark: SparkSession) -> DataFrame:
    """(url, label): the default training table, some thousand rows made of the words above in turn."""
    rows, n = [], 0

    def turn(items, i):
        return items[i % len(items)]

    def hosts(words):
        for i, w in enumerate(words):
            side, other = turn(_BESIDE, i), turn(words, i + 7)
            yield from (w, f"{w}-{other}", f"{other}{w}", f"{side}-{w}", f"{w}-{turn(_BESIDE, i + 5)}", f"{turn(_BESIDE, i + 9)}{w}", f"{w}{turn(_BESIDE, i + 13)}")

    for label, words in ((1.0, _UNWANTED), (0.0, _ORDINARY)):
        for name in hosts(words):
            for k in (0, 1):
                path = turn(_PATHS, n + k) if n % 3 or k else turn(_ORDINARY_PATHS, n).format(turn(_ORDINARY, n), turn(_ORDINARY, n + 31))
                rows.append((f"https://{turn(_DOMAINS, n + k).format(name)}{path}", label))
            n += 1
    clean = list(hosts(_ORDINARY))
    for i, w in enumerate(_UNWANTED):  # an unwanted path on an ordinary host
        for j, form in enumerate(_UNWANTED_PATHS):
            rows.append((f"https://{turn(_DOMAINS, i + j).format(turn(clean, 11 * i + j))}{form.format(w, turn(_UNWANTED, i + j + 3))}", 1.0))
    for i, w in enumerate(_ORDINARY):  # and an ordinary one with such a form
        for j, form in enumerate(_ORDINARY_PATHS):
            rows.append((f"https://{turn(_DOMAINS, i + j).format(turn(clean, 13 * i + j))}{form.format(w, turn(_ORDINARY, i + j + 3))}", 0.0))
    return spark.createDataFrame(rows, "url string, label double")


def host_and_path(url: Column) -> tuple[Column, Column]:
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, parts, 1), UPPER, LOWER), F.regexp_extract(url, parts, 2)


def ngram_buckets(text: Column, buckets: int = BUCKETS) -> Column:
    """Distinct buckets of a text's character n-grams, any digit taken for 0."""
    text, parts = F.translate(text, "123456789", "000000000"), []
    for n in LENGTHS:
        grams = F.regexp_extract_all(text, F.lit(f"(?s)(?=({'.' * n}))"), F.lit(1))
        parts.append(F.transform(grams, lambda g: F.pmod(F.xxhash64(g), F.lit(buckets)).cast("int")))
    return F.array_distinct(F.concat(*parts))


def _grams(host: Column, path: Column, buckets: int) -> tuple[Column, Column]:
    return ngram_buckets(F.concat(F.lit("^"), host, F.lit("$")), buckets), ngram_buckets(path, buckets)


def vectors(urls: DataFrame, buckets: int) -> DataFrame:
    """With a column features for MLlib: the n-grams of host and path, each normalised."""
    host, path = host_and_path(F.col("url"))
    for name, at in zip(("host", "path"), _grams(host, path, buckets)):
        words = CountVectorizerModel.from_vocabulary([str(i) for i in range(buckets)], inputCol=f"{name}_at", outputCol=f"{name}_counts")
        words.setBinary(True)
        urls = words.transform(urls.withColumn(f"{name}_at", at.cast("array<string>")))
        urls = Normalizer(inputCol=f"{name}_counts", outputCol=f"{name}_x").transform(urls)
    return VectorAssembler(inputCols=["host_x", "path_x"], outputCol="features").transform(urls)


def fit(labelled: DataFrame, buckets: int = BUCKETS) -> LogisticRegressionModel:
    """MLlib's model of a labelled table of (url, label); the table is small by contract."""
    return LogisticRegression(regParam=PENALTY, maxIter=100, standardization=False).fit(vectors(labelled.coalesce(1), buckets).persist())


def train(labelled: DataFrame, buckets: int = BUCKETS) -> tuple[tuple[float, ...], float]:
    """Weights (of the host's buckets, then of the path's) and intercept."""
    model = fit(labelled, buckets)
    return tuple(float(f"{x:.6g}") for x in model.coefficients.toArray()), float(model.intercept)


@cache
def _default_model(application: str) -> tuple[tuple[float, ...], float]:
    return train(labelled_urls(SparkSession.getActiveSession()))


def score(host_at: Column, path_at: Column, weights, bias: float) -> Column:
    """Probability that a url with these n-gram buckets is unwanted."""

    def part(at: Column, own) -> Column:
        w = F.split(F.lit(",".join(map(repr, own))), ",").cast("array<double>")  # a literal after constant folding
        return F.aggregate(at, F.lit(0.0), lambda s, i: s + F.get(w, i)) / F.sqrt(F.greatest(F.size(at), F.lit(1)))

    half = len(weights) // 2
    return 1.0 / (1.0 + F.exp(-(F.lit(bias) + part(host_at, weights[:half]) + part(path_at, weights[half:]))))


def longest_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Rule and verdict of the longest rule that fits a host (or a domain above it) and path, else null."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        domain, _, start = text.partition("/")
        fits = ((host == domain) | host.endswith(f".{domain}")) & path.startswith(f"/{start}")
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rule, verdict


def filter_urls(pages: DataFrame, labelled: DataFrame | None = None, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict (allow or block), score."""
    weights, bias = _default_model(pages.sparkSession.sparkContext.applicationId) if labelled is None else train(labelled)
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, said = longest_rule(F.col("host"), F.col("path"), rules)
    host_at, path_at = _grams(F.col("host"), F.col("path"), len(weights) // 2)
    rows = rows.select("*", rule.alias("rule"), said.alias("said"), host_at.alias("host_at"), path_at.alias("path_at"))
    rows = rows.withColumn("score", score(F.col("host_at"), F.col("path_at"), weights, bias))
    return rows.select("page_id", "host", "path", "rule", F.coalesce("said", F.when(F.col("score") >= THRESHOLD, "block").otherwise("allow")).alias("verdict"), "score")


def op4_url_filter(spark, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))
