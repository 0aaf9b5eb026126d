"""Operator 12: URL filters by rules and, where no rule fits, by gradient-boosted trees on lexical features.

Everything is DataFrame functions and Spark's own trees; no Python runs on the executors. Of the rules that fit a URL's host
(or a parent domain of it) and path the longest decides. The URLs that a rule decides are the labelled ones: the trees learn
from them what blocked URLs look like (lengths, depths, digit ratios, entropies, counts of parameters, statistics of suffixes)
and judge the others.

Statistics of suffixes (the last one, two and three labels of the host, the first part of the path) are counted over all
URLs: how many have it, and how many of its labelled ones are blocked, smoothed towards the share of all. Suffixes share
``BUCKETS`` buckets a kind by hash, so the table has at most 4 * BUCKETS rows and is broadcast; a very common host is one
bucket that is summed before the shuffle. The trees are fitted on at most ``FIT_ROWS`` labelled URLs, those with the least
hashes, in one task, so that a repeated run gives the same trees.

Defined cases: a null URL and one without ``://`` have an empty host and path, no rule, and the verdict that the trees give
for an empty URL; equal URLs have equal verdicts; without labelled URLs all others are allowed, and where all have one label
they get that label; an empty table gives no rows; only page_id and url are read, so other columns may have any names.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspark.llm.shared import least_hashes

FIT_ROWS = 10_000
BUCKETS = 1 << 15
#: Labelled URLs that a suffix's own share of blocked ones is weighed against.
PRIOR = 20.0
LEVELS = ("last_1", "last_2", "last_3", "head")
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = [Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"), Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/")]


def host_and_path(url: Column) -> tuple[Column, Column]:
    start = F.position(F.lit("://"), url)
    rest = F.when(start > 0, F.substr(url, start + 3))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), CAPITALS, SMALL)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def fitting_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest fitting rule (verdict, host, path, text; of equally long ones the one whose text sorts first), null if none
    fits. The rules are part of the plan, so they should be hundreds rather than millions."""
    if not rules:
        return F.lit(None).cast("struct<verdict: string, host: string, path: string, text: string>")
    ordered = F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in (*r._asdict().items(), ("text", r.text)))) for r in sorted(rules, key=lambda r: (-len(r.text), r.text))))
    fits = lambda r: F.concat(F.lit("."), host).endswith(F.concat(F.lit("."), r["host"])) & path.startswith(r["path"])
    return F.get(F.filter(ordered, fits), F.lit(0))


def ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def n_of(text: Column, signs: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, signs, ""))


def entropy(text: Column) -> Column:
    """Bits per character."""
    signs = F.array_distinct(F.filter(F.split(text, ""), lambda c: c != ""))
    share = lambda c: (F.length(text) - F.length(F.replace(text, c))) / F.length(text)
    return F.aggregate(signs, F.lit(0.0), lambda total, c: total - share(c) * F.log2(share(c)))


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """Features of one URL."""
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    parameters = F.size(F.filter(F.split(query, "[&;]"), lambda p: p != ""))
    last = F.substring_index(path, "/", -1)
    found = {
        "url_length": F.length(url), "host_length": F.length(host), "path_length": F.length(path), "query_length": F.length(query),
        "host_depth": F.size(F.split(host, r"\.")), "path_depth": n_of(path, "/"), "parameters": parameters,
        "digits": ratio(n_of(url, "[0-9]"), F.length(url)), "host_digits": ratio(n_of(host, "[0-9]"), F.length(host)), "path_digits": ratio(n_of(path, "[0-9]"), F.length(path)),
        "first_digit": F.regexp_extract(path, "^[^0-9]*([0-9])", 1).try_cast("int"), "marks": n_of(url, "[^0-9A-Za-z]"), "host_hyphens": n_of(host, "-"),
        "host_entropy": entropy(host), "path_entropy": entropy(path), "secure": url.startswith("https://").cast("int"), "fragment": url.contains("#").cast("int"),
        "extension": F.when(last.contains("."), F.length(F.substring_index(last, ".", -1))).otherwise(0),
    }
    return {k: F.coalesce(c.cast("double"), F.lit(-1.0)) for k, c in found.items()}


def buckets(host: Column, path: Column) -> list[Column]:
    """The buckets of a URL's suffixes, one for each of ``LEVELS``."""
    kinds = [F.substring_index(host, ".", -k) for k in (1, 2, 3)] + [F.get(F.split(path, "/"), F.lit(1))]
    return [F.pmod(F.xxhash64(F.lit(level), F.coalesce(x, F.lit(""))), F.lit(BUCKETS)).cast("int").alias(level) for level, x in zip(LEVELS, kinds)]


def suffix_statistics(urls: DataFrame, usual: float) -> DataFrame:
    """level, bucket, number of URLs (its logarithm) and the share of blocked ones among the labelled, smoothed towards ``usual``;
    ``blocked`` is null without a label."""
    long = urls.select("blocked", F.posexplode(F.array(*LEVELS)).alias("level", "bucket"))
    counts = long.groupBy("level", "bucket").agg(F.count(F.lit(1)).alias("n"), F.count("blocked").alias("labelled"), F.coalesce(F.sum("blocked"), F.lit(0)).alias("bad"))
    return counts.select("level", "bucket", F.log2("n").alias("seen"), ((F.col("bad") + PRIOR * usual) / (F.col("labelled") + PRIOR)).alias("share"))


def judge_urls(pages: DataFrame, rules: list[Rule] = RULES, trees: int = 20, depth: int = 5) -> DataFrame:
    """page_id, host, path, rule (its text or null), verdict (allow or block) and probability (of block, by the trees) of
    every row of ``pages`` (page_id, url)."""
    host, path = host_and_path(F.col("url"))
    urls = pages.select("page_id", pages.url.alias("url")).select("page_id", "url", host.alias("host"), path.alias("path"))
    ruled = urls.withColumn("fitting", fitting_rule(F.col("host"), F.col("path"), rules))
    labelled = ruled.select("page_id", "url", "host", "path", F.col("fitting.text").alias("rule"), F.col("fitting.verdict").alias("ruled"), (F.col("fitting.verdict") == "block").cast("int").alias("blocked"))
    counted = {r["blocked"]: r["n"] for r in labelled.where("blocked is not null").groupBy("blocked").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    if len(counted) < 2:
        same = 1.0 if counted.get(1) else 0.0
        return labelled.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.lit("block" if same else "allow")).alias("verdict"), F.lit(same).alias("probability"))

    out = hashed = labelled.select("*", *buckets(F.col("host"), F.col("path")))
    statistics = suffix_statistics(hashed, counted[1] / (counted[0] + counted[1]))
    for k, level in enumerate(LEVELS):
        own = statistics.where(F.col("level") == k).select(F.col("bucket").alias(level), F.col("seen").alias(f"{level}_seen"), F.col("share").alias(f"{level}_share"))
        out = out.join(F.broadcast(own), level)  # every bucket of a URL has a row; BUCKETS rows at most
    features = lexical(F.coalesce("url", F.lit("")), F.col("host"), F.col("path"))
    names = [*(f"{level}_{kind}" for level in LEVELS for kind in ("seen", "share")), *features]
    out = out.withColumns(features)

    labels = out.where("blocked is not null").select("page_id", "url", *names, F.col("blocked").cast("double").alias("label"))
    sample = least_hashes(labels, F.struct("page_id", "url"), FIT_ROWS, counted[0] + counted[1])
    vectors = VectorAssembler(inputCols=names, outputCol="features").transform
    model = GBTClassifier(maxIter=trees, maxDepth=depth, seed=7, maxBins=64).fit(vectors(sample).select("features", "label").coalesce(1))
    judged = model.transform(vectors(out))
    verdict = F.coalesce("ruled", F.when(F.col("prediction") == 1.0, "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), vector_to_array("probability")[1].alias("probability"))
