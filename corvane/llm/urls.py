"""URL filters: host rules first, else logistic regression on hashed character n-grams of host and path.

Everything on the main path is a Spark SQL expression. The model is trained with Spark ML on a small labelled URL table
whose size does not depend on the pages; its weights are one bounded array literal, so scoring is a narrow projection.
"""

from __future__ import annotations

from functools import cache
from typing import NamedTuple

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import fresh, let

BUCKETS = 1 << 12
NGRAMS = (3, 4)
BLOCK_AT = 0.5


class HostRule(NamedTuple):
    host: str
    path: str
    verdict: str


#: The rules in force.
RULES = [HostRule("net", "/", "block"), HostRule("example.net", "/en/", "allow"), HostRule("example.com", "/de/", "block"), HostRule("org", "/fr/", "allow")]

#: The small labelled table, general site names by label and topic. Each name is combined with sub-domains
#: and paths. No part of a name that stands for an unwanted site in the test pages is in it.
UNWANTED = [
    # Gambling.
    "poker-bonus", "pokerstakes", "slots-jackpot", "megaslots", "jackpotroom", "wagerline", "sportsbook-odds", "dicehouse", "baccarat-live", "highroller-club", "gamblers-lounge", "texasholdem",
    # Medicines and diets without a doctor.
    "viagra-shop", "discountmeds", "diet-drops", "miracle-weightloss", "steroid-store", "potency-gel", "slimming-patch", "nodoctor-rx",
    # Sex.
    "livesexcams", "porn-tube", "sexvideos", "hotgirls", "escortsnow", "xxx-movies", "erotic-chat",
    # Link schemes and advertisements.
    "backlinks-store", "linkexchange-hub", "buyfollowers", "seo-booster", "clickfraud", "popupserver", "pixelcount", "doorway-pages", "autoblogger", "instant-likes", "bannerrotator", "affiliate-traffic",
    # Money.
    "payday-loans", "fastloans", "crypto-doubler", "get-rich-quick", "giftcard-prizes", "claim-prize-now", "forex-signals", "pyramid-income",
    # Counterfeits and stolen works.
    "replica-watches", "fake-handbags", "cracked-software", "warez-archive", "keygen-store", "torrent-movies", "serial-codes", "bootleg-streams",
]
WANTED = [
    "library", "research", "gardening", "townhall", "museum", "weather", "recipes", "schoolnews", "history", "science", "travelnotes", "university", "newspaper", "cityguide", "hospital", "astronomy",
    "biology", "chemistry", "mathematics", "physics", "philosophy", "literature", "poetry", "theatre", "orchestra", "photography", "architecture", "engineering", "carpentry", "cooking-class", "bread-baking",
    "cycling-tours", "hiking-maps", "swimming-pool", "football", "chess-club", "bird-watching", "bee-keeping", "agriculture", "forestry", "rivers-trust", "oceanography", "geology", "archaeology", "linguistics",
    "online-dictionary", "encyclopedia", "translation", "parliament", "consumer-rights", "public-health", "fire-service", "railway-times", "road-transport", "harbour-museum", "airport-bus", "social-housing",
    "city-planning", "volunteers", "community-centre", "language-learning", "open-source", "programming", "databases", "software-manual", "statistics", "economics", "small-business", "insurance-law", "tax-office",
    "music-lessons", "grammar-school", "book-reviews", "local-news", "art-gallery", "family-doctor", "history-society", "online-course", "sports-club",
]
LABELLED_PREFIXES = ["", "www.", "m.", "blog."]
LABELLED_SUFFIXES = [".example.com", ".example.org", ".example.net"]
LABELLED_PATHS = ["/en/12", "/fr/345.html", "/de/6789/", "/es/88"]


def host_of(url: Column) -> Column:
    """Text after the first :// up to / ? # or the end, with A-Z lower-cased; empty without ://."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def matched_rule(host: Column, path: Column, rules: list[HostRule]) -> Column:
    """Struct(rule, verdict) of the longest rule that fits, else null; ties cannot occur between different rules that
    fit one host and path at equal length, as both are read from the same text."""
    longest = sorted(rules, key=lambda r: (-len(r.host + r.path), r.host, r.path))
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in reversed(longest):
        fits = ((host == r.host) | F.endswith(host, F.lit(f".{r.host}"))) & F.startswith(path, F.lit(r.path))
        found = F.when(fits, F.struct(F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(found)
    return found


def ngram_buckets(host: Column, path: Column) -> Column:
    """Hash buckets of the character n-grams of host and path, each with its field's name, without repeats."""

    def grams(field: str, text: Column) -> list[Column]:
        padded = F.concat(F.lit("^"), text, F.lit("$"))
        return [F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - (n - 1), F.lit(1))), lambda i, n=n: F.pmod(F.xxhash64(F.lit(field), F.substring(padded, i, F.lit(n))), F.lit(BUCKETS)).cast("int")) for n in NGRAMS]

    return F.array_distinct(F.concat(*grams("h", host), *grams("p", path)))


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The labelled table (url, label): label 1 is unwanted. Its size is fixed."""
    rows = [(f"http://{a}{name}{b}{p}", label) for label, names in ((1, UNWANTED), (0, WANTED)) for name in names for k, a in enumerate(LABELLED_PREFIXES) for b in LABELLED_SUFFIXES for p in [LABELLED_PATHS[(k + len(name)) % len(LABELLED_PATHS)]]]
    return spark.createDataFrame(rows, "url string, label int")


def train(labelled: DataFrame) -> list[float]:
    """Weights by bucket, the intercept last. labelled: columns url and label, small by contract."""
    buckets = ngram_buckets(host_of(F.col("url")), path_of(F.col("url"))).cast("array<string>")
    rows = labelled.select(F.col("label").cast("double").alias("label"), buckets.alias("buckets"))
    present = CountVectorizerModel.from_vocabulary([str(i) for i in range(BUCKETS)], "buckets", "features")
    features = present.transform(rows).persist()
    features.count()  # n-grams are cut once, by all cores; the fit passes over them in one fixed order
    model = LogisticRegression(maxIter=40, regParam=0.001, standardization=False).fit(features.coalesce(1))
    features.unpersist()
    return [float(x) for x in model.coefficients] + [float(model.intercept)]


@cache
def general_weights() -> list[float]:
    """Weights from the labelled table, which is fixed, so they are found once in a session."""
    return train(labelled_urls(SparkSession.active()))


def probability(host: Column, path: Column, weights: list[float]) -> Column:
    """Chance that a url is unwanted. weights is BUCKETS + 1 numbers."""
    table = F.from_json(F.lit("[" + ",".join(repr(round(w, 9)) for w in weights) + "]"), "array<double>")
    total = lambda t: F.aggregate(ngram_buckets(host, path), F.lit(weights[-1]), lambda a, i: a + F.get(t, i))
    return let(table, lambda t: F.lit(1.0) / (F.lit(1.0) + F.exp(-total(t))))


def judge(pages: DataFrame, url: str = "url", rules: list[HostRule] | None = None, weights: list[float] | None = None) -> DataFrame:
    """pages with host, path, rule, score and verdict; input columns of these names are replaced. A null url, or one
    without ://, has an empty host and path and is judged by the model, which knows only the empty n-grams then.
    Repeated rows are judged alike; an empty table gives an empty table."""
    weights = general_weights() if weights is None else weights
    source, found = fresh(pages, "url"), fresh(pages, "rule")
    out = pages.withColumn(source, F.col(url)).withColumns({"host": host_of(F.col(source)), "path": path_of(F.col(source))})
    out = out.withColumn(found, matched_rule(F.col("host"), F.col("path"), RULES if rules is None else rules))
    out = out.withColumn("score", probability(F.col("host"), F.col("path"), weights))
    by_model = F.when(F.col("score") >= BLOCK_AT, "block").otherwise("allow")
    return out.withColumns({"rule": F.col(found)["rule"], "verdict": F.coalesce(F.col(found)["verdict"], by_model)}).drop(source, found)
