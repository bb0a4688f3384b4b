"""URL filter: host and path rules, and for all other URLs a ratio of two character language models.

The models are smoothed Markov models of variable order, one of URLs that rules allow and one of URLs that rules block.
A character's probability after a context is interpolated with its probability after the context one shorter, down to a
uniform start; contexts never seen hand over to shorter ones. All orders come from one count of the longest n-grams over
all pages. A URL scores the mean log-likelihood difference per character, and is allowed from a threshold on that parts
allowed from blocked URLs best (the sum of the shares on the right side; ties: nearest to 0, then smaller).

Log ratios are kept in whole millionths, so that sums do not depend on their order. Rows: a null url counts as empty, and
has no host and no path; repeated rows count as often as they stand. Without ruled URLs both models are uniform and every
URL scores 0, which is allowed. An empty table gives no rows. All work is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise

ORDER, WEIGHT, ALPHABET = 5, 2.0, 256
START, END = "\u0002", "\u0003"
BROADCAST_GRAMS = 200_000
BINS = 1000  # hundredths on either side of 0
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(url, "://", 1)).otherwise(F.lit(None))
    after = F.substring(url, F.length(rest) + 4, F.length(url))
    return F.coalesce(F.translate(F.regexp_extract(after, r"^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(url, "://", 1)).otherwise(F.lit(None))
    after = F.substring(url, F.length(rest) + 4, F.length(url))
    return F.coalesce(F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule that fits, or null. Rules: (verdict, host followed by the beginning of the path)."""
    fits = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, rest = rule.partition("/")
        inside = (host == name) | host.endswith("." + name)
        fits = F.when(inside & path.startswith(slash + rest), F.lit(rule)).otherwise(fits)
    return fits


def verdict_of(rule: Column, rules: list[tuple[str, str]]) -> Column:
    out = F.lit(None).cast("string")
    for verdict, name in rules:
        out = F.when(rule == name, F.lit(verdict)).otherwise(out)
    return out


def _grams(urls: DataFrame, *kept: str) -> DataFrame:
    """A row per character, the end mark included: the n-gram that ends in it."""
    chars = F.split(F.concat(F.lit(START * (ORDER - 1)), F.col("url"), F.lit(END)), "")
    urls = urls.select(*kept, chars.alias("chars"))
    long = F.size("chars") - (ORDER - 1)
    shifted = [F.slice("chars", k + 1, long).alias(f"c{k}") for k in range(ORDER)]
    rows = urls.select(*kept, F.explode(F.arrays_zip(*shifted)).alias("z"))
    return rows.select(*kept, F.concat(*(F.col("z")[f"c{k}"] for k in range(ORDER))).alias("gram"))


def log_ratios(urls: DataFrame) -> DataFrame:
    """gram and micro, the millionths of its last character's log ratio, for every n-gram of the URLs (url, good, bad:
    how many allowed and blocked rows have it)."""
    sums = [F.sum("good").alias("good"), F.sum("bad").alias("bad")]
    counts = {ORDER: materialise(_grams(urls, "good", "bad").groupBy("gram").agg(*sums))}
    for k in range(ORDER - 1, 0, -1):
        counts[k] = counts[k + 1].groupBy(F.substring("gram", 2, k).alias("gram")).agg(*sums)
        if k > 1:
            counts[k] = materialise(counts[k])
    level = None
    for k in range(1, ORDER + 1):
        context = F.substring("gram", 1, k - 1)
        before = counts[k].groupBy(context.alias("context")).agg(F.sum("good").alias("all_good"), F.sum("bad").alias("all_bad"))
        rows = counts[k].withColumn("context", context).join(before, "context")
        if level is None:
            rows = rows.withColumn("p_good", F.lit(1.0 / ALPHABET)).withColumn("p_bad", F.lit(1.0 / ALPHABET))
        else:
            rows = rows.withColumn("shorter", F.substring("gram", 2, k - 1)).join(level, "shorter")
        share = lambda n, whole, p: (F.col(n) + WEIGHT * F.col(p)) / (F.col(whole) + WEIGHT)
        rows = rows.select("gram", share("good", "all_good", "p_good").alias("p_good"), share("bad", "all_bad", "p_bad").alias("p_bad"))
        level = materialise(rows.withColumnRenamed("gram", "shorter"))
    micro = F.round((F.log("p_good") - F.log("p_bad")) * 1e6).cast("long")
    return level.select(F.col("shorter").alias("gram"), micro.alias("micro"))


def scores(urls: DataFrame, ratios: DataFrame) -> DataFrame:
    """h1, h2 (hashes of the url), total (millionths) and n (characters) of every distinct url."""
    if ratios.count() <= BROADCAST_GRAMS:  # some 10 MB; beyond that a join that splits frequent n-grams
        ratios = F.broadcast(ratios)
    rows = _grams(urls, "h1", "h2").join(ratios, "gram")
    return rows.groupBy("h1", "h2").agg(F.sum("micro").alias("total"), F.count("*").alias("n"))


def threshold(scored: DataFrame) -> DataFrame:
    """One row: the best of all thresholds, in hundredths. ``scored`` has total, n, good and bad."""
    bin_ = F.greatest(F.lit(-BINS), F.least(F.lit(BINS), F.floor(F.col("total") / (F.col("n") * 10_000)))).cast("long")
    bins = scored.where("good > 0 or bad > 0").groupBy(bin_.alias("t")).agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    below, all_ = Window.orderBy("t").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    share = lambda n: F.coalesce(F.sum(n).over(below), F.lit(0)) / F.greatest(F.sum(n).over(all_), F.lit(1))
    gain = F.round(share("bad") - share("good"), 9)
    best = bins.select("t", gain.alias("gain")).unionByName(bins.sparkSession.createDataFrame([(0, -2.0)], "t long, gain double"))
    return best.orderBy(F.desc("gain"), F.abs("t"), "t").limit(1).select("t")


def judged(pages: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """page_id, host, path, rule, verdict and score (mean log ratio per character)."""
    rows = pages.select("page_id", F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"))
    rows = rows.withColumn("h1", F.xxhash64("url")).withColumn("h2", F.xxhash64(F.lit(1), "url"))
    rows = rows.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    rows = rows.withColumn("rule", ruled(F.col("host"), F.col("path"), rules))
    told = verdict_of(F.col("rule"), rules)
    count = lambda v: F.count(F.when(told == v, 1))
    urls = materialise(rows.groupBy("h1", "h2", "url").agg(count("allow").alias("good"), count("block").alias("bad")))
    scored = materialise(scores(urls, log_ratios(urls)).join(urls.select("h1", "h2", "good", "bad"), ["h1", "h2"]))
    limit = threshold(scored).collect()
    t = limit[0].t if limit else 0
    own = scored.select("h1", "h2", (F.col("total") >= F.lit(t) * 10_000 * F.col("n")).alias("passes"), (F.col("total") / F.col("n") / 1e6).alias("score"))
    out = rows.join(own, ["h1", "h2"], "left")
    verdict = F.coalesce(told, F.when(F.coalesce("passes", F.lit(True)), "allow").otherwise("block"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
