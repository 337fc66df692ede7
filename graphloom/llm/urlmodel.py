"""URL filter by the ratio of two character models, in DataFrame functions alone.

Two variable-order Markov models over characters, of accepted and of rejected URLs, are
smoothed by Witten-Bell interpolation: a context weighs in by how often it was seen
against how many characters followed it, down to the uniform distribution. A URL's score
is the difference of the two log-likelihoods, per character. The threshold is calibrated
on a fold of the labelled URLs that the models did not see.

Characters outside 33..126 count as one symbol, so there are at most 95**3 trigrams: the
tables of the model have a bound that does not depend on the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import materialize, spread_join

#: (host, path prefix, verdict): a rule fits its host and all subdomains.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
SYMBOLS = 95
ORDER = 3


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: str) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(F.col(url), r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: str) -> Column:
    return F.coalesce(F.regexp_extract(F.col(url), r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as a struct (rule, verdict); null where none does."""
    fits = F.lit(None).cast("struct<rule:string,verdict:string>")
    # Longest first; a rule's length is that of host and prefix together.
    for name, prefix, verdict in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0], r[1]), reverse=True):
        own = ((host == name) | host.endswith("." + name)) & path.startswith(prefix)
        fits = F.when(own, F.struct(F.lit(name + prefix).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(fits)
    return fits


def symbols(url: str) -> Column:
    """The URL as the models see it, opened by two marks and closed by one; every rare character is one symbol."""
    return F.concat(F.lit("\x02\x02"), F.regexp_replace(F.coalesce(F.col(url), F.lit("")), r"[^\x21-\x7e]", "\x7f"), F.lit("\x03"))


def _grams(urls: DataFrame, *keep: str) -> DataFrame:
    """A row for each of a text's runs of three characters."""
    chars = urls.select(*keep, F.split("__text", "").alias("__chars"))
    at = F.sequence(F.lit(0), F.size("__chars") - ORDER)
    gram = F.transform(at, lambda i: F.concat(*(F.get(F.col("__chars"), i + j) for j in range(ORDER))))
    return chars.select(*keep, F.explode(gram).alias("gram"))


def _log_ratio(grams: DataFrame) -> DataFrame:
    """gram, ratio: log10 P(last | first two) of the accepted model less that of the rejected one.

    grams: gram, good, bad (counts), of at most 95**3 rows.
    """
    table = grams
    for side in ("good", "bad"):
        # Counts of shorter grams are sums over the longer ones that end with them.
        uni = grams.groupBy(F.substring("gram", 3, 1).alias("c")).agg(F.sum(side).alias("n1"))
        all1, types1 = uni.agg(F.sum("n1"), F.sum(F.when(F.col("n1") > 0, 1).otherwise(0))).first()
        uni = uni.select("c", F.lit(1.0 / SYMBOLS).alias("p1") if not all1 else ((F.col("n1") + types1 / SYMBOLS) / (all1 + types1)).alias("p1"))
        bi = grams.groupBy(F.substring("gram", 2, 1).alias("h"), F.substring("gram", 3, 1).alias("c")).agg(F.sum(side).alias("n2"))
        context = bi.groupBy("h").agg(F.sum("n2").alias("all2"), F.sum(F.when(F.col("n2") > 0, 1).otherwise(0)).alias("types2"))
        bi = bi.join(F.broadcast(context), "h").join(F.broadcast(uni), "c")
        bi = bi.select(F.concat("h", "c").alias("tail"), F.when(F.col("all2") > 0, (F.col("n2") + F.col("types2") * F.col("p1")) / (F.col("all2") + F.col("types2"))).otherwise(F.col("p1")).alias("p2"))
        context = grams.groupBy(F.substring("gram", 1, 2).alias("head")).agg(F.sum(side).alias("all3"), F.sum(F.when(F.col(side) > 0, 1).otherwise(0)).alias("types3"))
        table = table.withColumns({"head": F.substring("gram", 1, 2), "tail": F.substring("gram", 2, 2)}).join(F.broadcast(context), "head").join(F.broadcast(bi), "tail")
        p3 = F.when(F.col("all3") > 0, (F.col(side) + F.col("types3") * F.col("p2")) / (F.col("all3") + F.col("types3"))).otherwise(F.col("p2"))
        table = table.withColumn(f"log_{side}", F.log10(p3)).drop("head", "tail", "all3", "types3", "p2")
    return table.select("gram", (F.col("log_good") - F.col("log_bad")).alias("ratio"))


def url_verdicts(pages: DataFrame, rules=RULES, calibration_fold: int = 4, folds: int = 5) -> DataFrame:
    """page_id, host, path, rule, verdict, score, threshold for every row of pages.

    A rule's verdict stands. Other URLs are allowed where their score reaches the
    threshold: of the scores of labelled URLs in the calibration fold, binned to 0.01, the
    one of the best balanced accuracy (of several the least). Null URLs, and those without
    '://', have empty host and path; rows that repeat a URL count each. Where rules label
    no URL, or of one verdict alone, the missing model is uniform; without a calibration
    fold the threshold is 0. Other columns of pages are not read.
    """
    read = pages.select("page_id", "url")
    parsed = read.select("page_id", "url", host_of("url").alias("host"), path_of("url").alias("path"))
    parsed = parsed.withColumn("__fit", rule_of(F.col("host"), F.col("path"), rules))
    parsed = parsed.select("page_id", "host", "path", F.col("__fit.rule").alias("rule"), F.col("__fit.verdict").alias("ruled"), symbols("url").alias("__text"), (F.crc32(F.coalesce("url", F.lit(""))) % folds == calibration_fold).alias("__calibrate"))
    # Equal texts score alike, so each distinct one is worked on once.
    texts = parsed.groupBy("__text").agg(
        F.count("*").alias("n"),
        F.sum(F.when((F.col("ruled") == "allow") & ~F.col("__calibrate"), 1).otherwise(0)).alias("good"),
        F.sum(F.when((F.col("ruled") == "block") & ~F.col("__calibrate"), 1).otherwise(0)).alias("bad"),
        F.sum(F.when((F.col("ruled") == "allow") & F.col("__calibrate"), 1).otherwise(0)).alias("held_good"),
        F.sum(F.when((F.col("ruled") == "block") & F.col("__calibrate"), 1).otherwise(0)).alias("held_bad"),
    )
    texts = materialize(texts, "urls")
    grams = _grams(texts, "good", "bad").groupBy("gram").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    ratio = materialize(_log_ratio(materialize(grams, "grams")), "ratio")
    scored = _grams(texts.select("__text"), "__text").join(F.broadcast(ratio), "gram").groupBy("__text").agg(F.round(F.avg("ratio"), 9).alias("score"))
    scored = materialize(texts.join(scored, "__text"), "scores")
    # At most a few thousand bins: scores of 95 symbols' models lie within some units of 0.
    bins = scored.groupBy(F.floor(F.col("score") * 100).alias("bin")).agg(F.sum("held_good").alias("good"), F.sum("held_bad").alias("bad"))
    rows = sorted((r.bin, r.good, r.bad) for r in bins.collect())
    good, bad = sum(r[1] for r in rows), sum(r[2] for r in rows)
    threshold = 0.0
    if good and bad:
        best, below_good, below_bad = -1.0, 0, 0
        for b, g, x in rows:
            balanced = (good - below_good) / good + below_bad / bad
            if balanced > best + 1e-12:
                best, threshold = balanced, b / 100
            below_good, below_bad = below_good + g, below_bad + x
    out = spread_join(parsed, scored.select("__text", "score", "n"), "__text")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("score") >= threshold, "allow").otherwise("block")).alias("verdict"), "score", F.lit(threshold).alias("threshold"))
