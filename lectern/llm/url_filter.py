"""URL filters: fixed host and path rules first, association rules mined with FP-growth for the rest."""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ascii_lower

#: (verdict, host and path): the fixed rules of the registered query.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
LABEL = "label="


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def fixed_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does. Rules are few: each is one branch.

    A rule fits its host and all subdomains if the path starts with the rule's. Of equally long rules the first by text wins.
    """
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, rule in sorted(rules, key=lambda r: (len(r[1]), tuple(-ord(c) for c in r[1]))):
        rule_host, slash, rest = rule.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(slash + rest)
        name, verdict = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


def tokens(url: Column, host: Column, path: Column) -> Column:
    """The URL's different tokens, sorted: scheme, host labels, path words, ending and query keys; numbers become ``#``."""
    tagged = lambda tag, parts: F.transform(parts, lambda x: F.concat(F.lit(tag), x))
    url = F.coalesce(url, F.lit(""))
    words = F.split(F.regexp_replace(F.regexp_replace(path, r"\.[A-Za-z0-9]{1,5}$", ""), "[0-9]+", "#"), "[/_.-]+")
    ending = F.regexp_extract_all(path, F.lit(r"\.([A-Za-z0-9]{1,5})$"), F.lit(1))
    keys = F.regexp_extract_all(F.regexp_extract(url, r"\?([^#]*)", 1), F.lit(r"(?:^|&)([^=&]+)"), F.lit(1))
    parts = F.concat(
        tagged("s:", F.regexp_extract_all(url, F.lit("^([A-Za-z]+)://"), F.lit(1))),
        tagged("h:", F.filter(F.split(host, r"\."), lambda x: x != "")),
        tagged("p:", F.filter(words, lambda x: x != "")),
        tagged("e:", ending),
        tagged("q:", keys),
    )
    return F.array_sort(F.array_distinct(parts))


def mine(
    labelled: DataFrame, scratch: Scratch, min_support: float = 0.01, min_confidence: float = 0.8, longest: int = 3,
    sample_rows: int = 200_000, id_col: str = "page_id",
) -> DataFrame:
    """``rule_id, antecedent, verdict, confidence, support, need`` mined from rows of ``tokens`` and ``verdict``.

    FP-growth finds the candidates, sets of at most ``longest`` tokens, in about ``sample_rows`` rows, chosen by a hash of the id, with four
    fifths of the support asked for. Support and confidence are then counted over all rows, so verdicts don't hang on the sample.
    A rule also goes when a rule on part of its tokens with the same verdict is at least as sure.
    """
    schema = "rule_id long, antecedent array<string>, verdict string, confidence double, support double, need int"
    n = labelled.count()
    if not n:
        return labelled.sparkSession.createDataFrame([], schema)
    lot = F.pmod(F.xxhash64(id_col, F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
    share = min(1.0, sample_rows / n)
    candidates = _candidates(labelled.where(lot < share) if share < 1 else labelled, scratch, 0.8 * min_support, longest)
    rules = _counted(labelled, candidates, scratch).where((F.col("hits") >= F.ceil(F.lit(min_support) * n)) & (F.col("hits") / F.col("total") >= min_confidence))
    rules = rules.select("antecedent", "verdict", F.round(F.col("hits") / F.col("total"), 9).alias("confidence"), F.round(F.col("hits") / n, 9).alias("support"), F.size("antecedent").alias("need"))
    rules = scratch.save(rules, "rules")
    less = rules.where("need > 1").select("antecedent", "verdict", "confidence", F.explode(_parts("antecedent", longest)).alias("part"))
    general = rules.select(F.col("antecedent").alias("part"), "verdict", F.col("confidence").alias("surer"))
    covered = less.join(general, ["part", "verdict"]).where("surer >= confidence").select("antecedent", "verdict").distinct()
    kept = rules.join(covered, ["antecedent", "verdict"], "left_anti")
    # xxhash64 names a rule by its content, so a task that runs again gives the same name
    return scratch.save(kept.select(F.xxhash64("antecedent", "verdict").alias("rule_id"), "antecedent", "verdict", "confidence", "support", "need"), "kept")


#: Frequent tokens of a basket that FP-growth gets at a time: it makes all subsets of what often occurs together. Longer baskets come as
#: all unions of three of their parts of PART tokens; every set of three tokens is in one of these.
BASKET, PART = 12, 4


def _candidates(sample: DataFrame, scratch: Scratch, least: float, longest: int) -> DataFrame:
    """``antecedent``: sets of at most ``longest`` tokens that occur with a verdict in a share of ``least`` of the sample, and some more.

    Parts of long baskets may count a set more than once, which only adds candidates.
    """
    sample = scratch.save(sample.select("tokens", "verdict"), "sample")
    n = sample.count()
    if not n:
        return sample.sparkSession.createDataFrame([], "antecedent array<string>")
    # at most (tokens of a URL) / least tokens are frequent: one row of a bounded array
    often = sample.select(F.explode("tokens").alias("t")).groupBy("t").count().where(F.col("count") >= least * n).agg(F.collect_list("t").alias("often"))
    basket = sample.crossJoin(F.broadcast(often)).select(F.array_intersect("tokens", "often").alias("b"), "verdict")
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size("b") - 1) / PART).cast("int")), lambda i: F.slice("b", i * PART + 1, PART))
    threes = F.flatten(F.transform(
        "parts", lambda x, i: F.flatten(F.transform(F.slice("parts", i + 2, F.size("parts")), lambda y, j: F.transform(F.slice("parts", i + j + 3, F.size("parts")), lambda z: F.concat(x, y, z))))
    ))
    split = basket.withColumn("parts", F.when(F.size("b") > BASKET, parts)).select("verdict", F.explode(F.when(F.size("b") > BASKET, threes).otherwise(F.array("b"))).alias("b"))
    items = scratch.save(split.select(F.array_append("b", F.concat(F.lit(LABEL), "verdict")).alias("items")), "baskets")
    model = FPGrowth(itemsCol="items", minSupport=max(1e-12, least * n / items.count())).fit(items)
    sets = model.freqItemsets.where(F.size("items").between(2, longest + 1) & F.exists("items", lambda x: x.startswith(LABEL)))
    return scratch.save(sets.select(F.array_sort(F.filter("items", lambda x: ~x.startswith(LABEL))).alias("antecedent")).where(F.size("antecedent") > 0).distinct(), "candidates")


def _counted(labelled: DataFrame, candidates: DataFrame, scratch: Scratch) -> DataFrame:
    """``antecedent, verdict, hits, total``: rows of ``labelled`` with all its tokens, of the verdict and in all. Equal rows are counted once, by number."""
    rows = scratch.save(labelled.groupBy("tokens", "verdict").agg(F.count(F.lit(1)).alias("c")), "counted")
    sets = scratch.save(rows.select("tokens", "verdict", "c", F.monotonically_increasing_id().alias("row")), "numbered")
    index = candidates.select("antecedent", F.explode("antecedent").alias("token"))
    met = sets.select("row", "verdict", "c", F.explode("tokens").alias("token")).join(index, "token")
    whole = met.groupBy("row", "antecedent").agg(F.count(F.lit(1)).alias("n"), F.first("verdict").alias("verdict"), F.first("c").alias("c")).where(F.col("n") == F.size("antecedent"))
    hits = scratch.save(whole.groupBy("antecedent", "verdict").agg(F.sum("c").alias("hits")), "hits")
    return hits.join(hits.groupBy("antecedent").agg(F.sum("hits").alias("total")), "antecedent")


def _parts(column: str, longest: int) -> Column:
    """All proper, non-empty parts of a sorted array of at most three tokens."""
    assert longest <= 3
    ones = F.transform(column, lambda x: F.array(x))
    twos = F.when(F.size(column) == 3, F.transform(column, lambda x: F.array_remove(column, x)))
    return F.concat(ones, F.coalesce(twos, F.array().cast("array<array<string>>")))


def judge(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple[tuple[str, str], ...] = RULES, default: str = "allow", **fit: float
) -> DataFrame:
    """One row per input row: id, ``host``, ``path``, ``rule``, ``verdict``, ``evidence``.

    ``rule`` is the fixed rule that decided, else null; the association rules, learned from the URLs that fixed rules
    decide, judge the others: of the rules whose tokens are all in the URL the surest decides (then the better supported, then
    the first by text), and ``default`` where none is. ``evidence`` holds that rule's tokens. Defined cases: null URLs
    and URLs without ``://`` have empty host and path and meet no fixed rule; rows that repeat are judged singly; an empty
    table gives an empty result; other columns are not read.
    """
    scratch = Scratch(pages.sparkSession, "urls")
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    read = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host.alias("host"), path.alias("path"))
    name, verdict = fixed_rule(F.col("host"), F.col("path"), rules)
    read = read.select("id", "host", "path", name.alias("rule"), verdict.alias("verdict"), tokens(F.col("url"), F.col("host"), F.col("path")).alias("tokens"))
    read = scratch.save(read, "tokens")
    mined = mine(read.where("verdict IS NOT NULL"), scratch, id_col="id", **fit)

    # the inverted index: token to rules; each different token set is judged once
    index = mined.select(F.explode("antecedent").alias("token"), "rule_id", "need", "confidence", "support", "antecedent", F.col("verdict").alias("says"))
    sets = scratch.save(read.where("verdict IS NULL").select("tokens").distinct(), "sets")
    hits = sets.select("tokens", F.explode("tokens").alias("token")).join(index, "token")
    fired = hits.groupBy("tokens", "rule_id").agg(
        F.count(F.lit(1)).alias("n"), *(F.first(c).alias(c) for c in ("need", "confidence", "support", "antecedent", "says"))
    ).where("n = need")
    order = F.struct(-F.col("confidence"), -F.col("support"), F.concat_ws(" ", "antecedent"), "says")
    best = fired.groupBy("tokens").agg(F.min(F.struct(order.alias("o"), "antecedent", "says")).alias("b"))
    best = scratch.save(best.select("tokens", F.col("b.antecedent").alias("evidence"), F.col("b.says").alias("says")), "best")
    out = read.join(best, "tokens", "left")
    decided = F.coalesce("verdict", "says", F.lit(default))
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", decided.alias("verdict"), F.when(F.col("rule").isNull(), F.col("evidence")).alias("evidence"))
