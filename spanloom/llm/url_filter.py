"""URL filter: domain rules, and a character language-model ratio for the urls no rule decides. Native operators only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, materialize

#: The longest context of the models, and the symbols before and after a url.
ORDER, START, END = 5, "\x02", "\x03"

#: (verdict, rule) pairs; a rule is a host followed by the prefix of a path.
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (after the first ://, A-Z lower-cased) and path; both empty for null or when there is no ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return ascii_lower(host), path


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest fitting rule, or null. Rules are a short configured list, so they compile into one CASE."""
    out = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        h, slash, p = rule.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(slash + p)
        out = F.when(fits, rule).otherwise(out)
    return out


def padded(host: Column, url: Column) -> Column:
    """The url after its scheme, its host lower-cased, between ORDER start symbols and an end symbol."""
    rest = F.regexp_replace(F.coalesce(url, F.lit("")), r"^[^:/?#]*://", "")
    return F.concat(F.lit(START * ORDER), host, F.substring(rest, F.length(host) + 1, F.length(rest)), F.lit(END))


def grams(s: Column) -> Column:
    """Every symbol with the ORDER symbols before it."""
    return F.transform(F.sequence(F.lit(1), F.length(s) - ORDER), lambda i: F.substring(s, i, F.lit(ORDER + 1)))


def markov_ratio(counts: DataFrame) -> DataFrame:
    """(g, allow, block): how often the urls of each class hold each gram -> (g, ratio): micro-nats of log p_allow - log p_block.

    Witten-Bell back-off over the contexts of 0 to ORDER symbols that the urls hold: p of a symbol after a context is
    (n + t * p after the context without its first symbol) / (N + t), with n of N continuations being the symbol and t
    different ones seen; a context never seen gives way to the shorter one whole. So the order varies with what was learned,
    and the tables grow with the urls. They are joined by gram, one order after another.
    """
    symbols = counts.agg(F.count_distinct(F.substring("g", ORDER + 1, 1))).first()[0] + 1  # one for all unseen ones
    lower = None
    for k in range(ORDER + 1):
        own = counts.groupBy(F.substring("g", ORDER + 1 - k, k + 1).alias("gram")).agg(F.sum("allow").alias("allow"), F.sum("block").alias("block"))
        own = own.withColumn("context", F.substring("gram", 1, k))
        sums = [f for c in ("allow", "block") for f in (F.sum(c).alias(f"{c}_n"), F.count_if(F.col(c) > 0).alias(f"{c}_t"))]
        own = own.join(own.groupBy("context").agg(*sums), "context")
        if lower is None:
            own = own.withColumns({"allow_p": F.lit(1.0) / symbols, "block_p": F.lit(1.0) / symbols})
        else:
            own = own.withColumn("shorter", F.substring("gram", 2, k)).join(lower, "shorter")
        p = lambda c: F.when(F.col(f"{c}_n") == 0, F.col(f"{c}_p")).otherwise((F.col(c) + F.col(f"{c}_t") * F.col(f"{c}_p")) / (F.col(f"{c}_n") + F.col(f"{c}_t")))
        # a first symbol of all is as likely as any where a class taught nothing or only others
        base = {c: F.when(p(c) > 0, p(c)).otherwise(F.lit(1.0) / symbols) for c in ("allow", "block")}
        held = materialize(own.select("gram", base["allow"].alias("allow_p"), base["block"].alias("block_p")))
        lower = held.withColumnRenamed("gram", "shorter")
    return held.select(F.col("gram").alias("g"), F.round(1e6 * (F.log("allow_p") - F.log("block_p"))).cast("long").alias("ratio"))


def filter_urls(df: DataFrame, rules: list[tuple[str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", broadcast_rows: int = 100_000) -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict, score (mean log-likelihood difference per symbol).

    The urls decided by a rule train the two models: most of them (by a hash of the url) are counted, the rest set
    the threshold of best balanced accuracy. Ratios are broadcast only if they are counted to be at most broadcast_rows, of
    some 30 bytes each. Undefined cases: a null url has empty parts and is scored as an empty string; with one class of
    training urls only, or none, urls without a rule are allowed. Repeated rows stay, ties at the threshold are allowed,
    other input columns are ignored.
    """
    url = F.col(f"`{url_col}`")
    host, path = url_parts(url)
    base = df.select(F.col(f"`{id_col}`").alias("page_id"), host.alias("host"), path.alias("path"), padded(host, url).alias("s"))
    base = base.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    ruled = F.lit(None).cast("string")
    for verdict, rule in rules:
        ruled = F.when(F.col("rule") == rule, verdict).otherwise(ruled)
    base = base.withColumn("ruled", ruled).withColumn("fit", ~F.substring(F.md5("s"), 1, 1).isin("0", "1", "2"))
    taught = lambda v: F.count_if((F.col("ruled") == v) & F.col("fit")).alias(v)
    counts = base.select("ruled", "fit", F.explode(grams(F.col("s"))).alias("g")).groupBy("g").agg(taught("allow"), taught("block"))
    ratio = markov_ratio(materialize(counts))
    ratio = F.broadcast(ratio) if ratio.count() <= broadcast_rows else ratio
    # the row id keeps repeated rows apart and does not leave this plan
    hits = base.withColumn("rid", F.monotonically_increasing_id()).withColumn("g", F.explode(grams(F.col("s")))).join(ratio, "g")
    scored = materialize(hits.groupBy("rid", "page_id", "host", "path", "rule", "ruled", "fit").agg((F.sum("ratio") / F.count("*") / 1e6).alias("score")))
    cut = threshold(scored.where("ruled IS NOT NULL AND NOT fit"))
    by_model = F.when(F.col("score") >= cut, "allow").otherwise("block") if cut is not None else F.lit("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", by_model).alias("verdict"), "score")


def threshold(held: DataFrame, bins: int = 4000, reach: float = 10.0) -> float | None:
    """The score of best balanced accuracy on (ruled, score), from a histogram of a fixed number of bins: the middle between
    the last bin that is blocked and the first that is allowed."""
    at = F.floor((F.least(F.greatest(F.col("score"), F.lit(-reach)), F.lit(reach)) + reach) * (bins / (2 * reach))).alias("bin")
    rows = sorted(held.groupBy(at).agg(F.count_if(F.col("ruled") == "allow").alias("a"), F.count_if(F.col("ruled") == "block").alias("b")).collect())
    good, bad = sum(r["a"] for r in rows), sum(r["b"] for r in rows)
    if not good or not bad:
        return None
    best, cut, kept, dropped, before = -1.0, None, good, 0, None
    for r in rows:
        if (found := kept / good + dropped / bad) > best:
            best, cut = found, ((before + 1 + r["bin"]) / 2 if before is not None else r["bin"]) * 2 * reach / bins - reach
        kept, dropped, before = kept - r["a"], dropped + r["b"], r["bin"]
    return cut
