"""URL filters: written rules, and rules that FP-growth mines from labelled URLs.

A URL's tokens are its host suffixes and labels, the words of its path, its file extension, query names and fragment. FP-growth
mines token combinations that go with the label, tokens of exactly the same pages as one item; rules pruned by support,
confidence and lift are looked up in an inverted index by their rarest item and hold where all their items are there.
Where an item implies another (a folder those above it), a combination of both says no more than one without the other, and
nested items would make a rule of every subset. So wide baskets are first dealt to their items, each with those that are
more common and that it doesn't imply, until nothing is implied any more; only then FP-growth sees them.

Defined results: a null URL or one without `://` has an empty host and path, no rule and no tokens, and is allowed; repeated
rows are judged separately; pages without label only take part in matching; without labels no rule is mined; extra columns
are ignored; very long URLs are read whole.
"""

from __future__ import annotations

import functools

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import ascii_lower, materialize

BAD = "label=bad"
#: A rule must have held for so many bad pages at least, however many pages are labelled.
MIN_PAGES = 20
MIN_CONFIDENCE = 0.6
MIN_LIFT = 1.5
#: Items of a basket of which FP-growth may list all combinations, implied or not.
WIDEST = 10
#: Rules sent to all executors at most; more are joined by a shuffle.
BROADCAST_RULES = 100_000


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end."""
    at = F.locate("://", url)
    return F.when(at > 0, ascii_lower(F.regexp_extract(F.substring(url, at + 3, F.lit(2147483647)), r"(?s)^([^/?#]*)", 1))).otherwise("")


def path_of(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.regexp_extract(F.substring(url, at + 3, F.lit(2147483647)), r"(?s)^[^/?#]*([^?#]*)", 1)).otherwise("")


def with_parts(pages: DataFrame) -> DataFrame:
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    return pages.select("page_id", F.col("url").cast("string").alias("url"), host_of(url).alias("host"), path_of(url).alias("path"))


def written_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, like `net/`, and its verdict; rules are (verdict, host with path)."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda x: (len(x[1]), x[1])):
        rule_host, slash, rest = text.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens of a URL, as strings with a letter for their place."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.concat(F.lit("h:"), F.array_join(F.slice(labels, -k, k), ".")))
    words = F.transform(F.regexp_extract_all(host, F.lit(r"([a-z]+)"), F.lit(1)), lambda w: F.concat(F.lit("w:"), w))
    folders = F.transform(F.regexp_extract_all(ascii_lower(path), F.lit(r"/([a-z][a-z0-9_-]*)"), F.lit(1)), lambda w: F.concat(F.lit("p:"), w))
    extension = F.transform(F.regexp_extract_all(ascii_lower(path), F.lit(r"\.([a-z0-9]+)$"), F.lit(1)), lambda w: F.concat(F.lit("x:"), w))
    names = F.transform(F.regexp_extract_all(ascii_lower(url), F.lit(r"[?&]([a-z0-9_]+)="), F.lit(1)), lambda w: F.concat(F.lit("q:"), w))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(suffixes, words, folders, extension, names)))


def token_classes(labelled: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """token, class from (row, tokens): tokens that exactly the same labelled pages hold are one class, named by its first token.

    Host suffixes and host words always go together. Tokens of fewer pages than a rule needs have no class.
    """
    held = labelled.select("row", F.explode("tokens").alias("token"))
    same = [F.bit_xor(F.xxhash64(F.lit(k), "row")).alias(f"same{k}") for k in (0, 1)]
    marked = held.groupBy("token").agg(F.count("*").alias("n"), *same).filter(F.col("n") >= min_pages)
    return marked.join(marked.groupBy("n", "same0", "same1").agg(F.min("token").alias("class")), ["n", "same0", "same1"]).select("token", "class")


def in_classes(pages: DataFrame, classes: DataFrame, key: str) -> DataFrame:
    """key, tokens: the distinct classes of each page that has any."""
    held = pages.select(key, F.explode("tokens").alias("token")).join(classes, "token")
    return held.groupBy(key).agg(F.array_sort(F.collect_set("class")).alias("tokens"))


def _bases(baskets: DataFrame, min_pages: int) -> tuple[DataFrame, DataFrame | None]:
    """Conditional bases (prefix, bad, tokens) in which no token implies another, and the prefixes (prefix, n, bad_n).

    Each round deals the bases in which some token implies another to the tokens: the rows that hold it, with those of their
    tokens that are more common in the base and not implied. A chain of nested tokens is gone after one round.
    """
    spark = baskets.sparkSession
    base, clean, heads = materialize(baskets.select(F.array().cast("array<string>").alias("prefix"), "bad", "tokens"), "base"), [], []
    while base.head(1):
        one = base.select("prefix", "bad", F.explode("tokens").alias("a")).groupBy("prefix", "a").agg(F.count("*").alias("n"), F.count_if("bad").alias("bad_n"))
        one = materialize(one.filter(F.col("bad_n") >= min_pages), "tokens")
        both = base.select("prefix", F.explode("tokens").alias("a"), "tokens").select("prefix", "a", F.explode("tokens").alias("b")).filter("a <> b").groupBy("prefix", "a", "b").agg(F.count("*").alias("m"))
        implied = materialize(both.join(one.select("prefix", "a", "n"), ["prefix", "a"]).filter("m = n").groupBy("prefix", "a").agg(F.collect_set("b").alias("implied")), "implied")
        dirty = implied.select("prefix").distinct()
        clean.append(base.join(dirty, "prefix", "left_anti"))
        one = one.join(dirty, "prefix", "left_semi")
        heads.append(one.select(F.concat("prefix", F.array("a")).alias("prefix"), "n", "bad_n"))
        rank = one.select("prefix", "a", F.struct("n", "a").alias("own"))
        rows = base.join(dirty, "prefix", "left_semi").withColumn("row", F.monotonically_increasing_id())
        held = rows.select("prefix", "row", "bad", F.explode("tokens").alias("a")).join(rank, ["prefix", "a"])
        ordered = held.groupBy("prefix", "row", "bad").agg(F.array_sort(F.collect_list("own")).alias("all"))
        head = ordered.select("prefix", "bad", F.posexplode("all").alias("at", "own"), "all").select("prefix", "bad", F.col("own.a").alias("a"), F.expr("slice(all, at + 2, size(all))").alias("later"))
        head = head.join(implied, ["prefix", "a"], "left")
        left = F.array_except(F.transform("later", lambda x: x.a), F.coalesce("implied", F.array().cast("array<string>")))
        base = materialize(head.select(F.concat("prefix", F.array("a")).alias("prefix"), "bad", left.alias("tokens")).filter(F.size("tokens") > 0), "base")
    none = spark.createDataFrame([], "prefix array<string>, bad boolean, tokens array<string>")
    union = lambda parts, first: functools.reduce(DataFrame.unionByName, parts, first)
    return union(clean, none), union(heads[1:], heads[0]) if heads else None


def mine(labelled: DataFrame, min_pages: int = MIN_PAGES, min_confidence: float = MIN_CONFIDENCE, min_lift: float = MIN_LIFT, widest: int | None = None) -> DataFrame:
    """Rules from (tokens, bad): rule_id, tokens, confidence, lift, support.

    Tokens of fewer bad pages than a rule needs are left out. Baskets of more than `widest` tokens (`WIDEST`) are freed of implied ones
    first; what that leaves out are rules with a token that the others imply, which hold where a shorter one of the same
    confidence does. `matched` prefers the shorter, so pages get the same rules either way.
    """
    spark = labelled.sparkSession
    schema = T.StructType.fromDDL("rule_id long, tokens array<string>, confidence double, lift double, support double")
    n, bad_n = labelled.select(F.count("*"), F.count_if("bad")).first()
    if bad_n < min_pages:
        return spark.createDataFrame([], schema)
    numbered = labelled.select("bad", "tokens").withColumn("row", F.monotonically_increasing_id())
    held = numbered.select("row", "bad", F.explode("tokens").alias("token"))
    able = held.filter("bad").groupBy("token").count().filter(F.col("count") >= min_pages).select("token")
    baskets = materialize(held.join(able, "token").groupBy("row", "bad").agg(F.collect_list("token").alias("tokens")).drop("row"), "baskets")
    heads = None
    if (baskets.agg(F.max(F.size("tokens"))).first()[0] or 0) > (WIDEST if widest is None else widest):
        bases, heads = _bases(baskets, min_pages)
    else:
        bases = baskets.withColumn("prefix", F.array().cast("array<string>"))
    # items of different bases are different; tokens hold no control characters
    named = F.transform("tokens", lambda t: F.concat(F.array_join("prefix", "\x1f"), F.lit("\x1e"), t))
    items = materialize(bases.select(F.when(F.col("bad"), F.concat(named, F.array(F.lit(BAD)))).otherwise(named).alias("items")), "items")
    total = items.count()
    # half a page less: the total times the quotient may round to just above min_pages, of which FPGrowth takes the ceiling
    found = FPGrowth(itemsCol="items", minSupport=min(1.0, (min_pages - 0.5) / max(total, 1)), minConfidence=min_confidence).fit(items).associationRules.filter(F.col("consequent") == F.array(F.lit(BAD)))
    parts = F.flatten(F.transform("antecedent", lambda x: F.split(x, "[\x1e\x1f]")))
    rules = found.select(F.array_sort(F.array_distinct(F.filter(parts, lambda t: t != ""))).alias("tokens"), "confidence", F.round(F.col("support") * total).alias("bad_n"))
    if heads is not None:
        rules = rules.unionByName(heads.select(F.array_sort("prefix").alias("tokens"), (F.col("bad_n") / F.col("n")).alias("confidence"), F.col("bad_n").cast("double").alias("bad_n")))
    rules = rules.withColumn("lift", F.col("confidence") * n / bad_n).filter((F.col("confidence") >= min_confidence) & (F.col("lift") >= min_lift))
    return rules.dropDuplicates(["tokens"]).select(F.xxhash64("tokens").alias("rule_id"), "tokens", "confidence", "lift", (F.col("bad_n") / n).alias("support"))


def matched(pages: DataFrame, rules: DataFrame, key: str = "page_id") -> DataFrame:
    """key, rule_id, confidence of the best mined rule that holds for a page (page key, tokens): of equal confidence the one with the fewest tokens.

    The index lists each rule under its rarest token, so common tokens such as a top-level domain find few rules.
    """
    frequency = rules.select("rule_id", F.explode("tokens").alias("token"))
    seen = pages.select(F.explode("tokens").alias("token")).join(F.broadcast(frequency.select("token").distinct()) if rules.count() <= BROADCAST_RULES else frequency.select("token").distinct(), "token").groupBy("token").count()
    index = frequency.join(seen, "token").groupBy("rule_id").agg(F.min(F.struct("count", "token"))["token"].alias("token"))
    index = materialize(index.join(rules, "rule_id").select("rule_id", "token", F.col("tokens").alias("needed"), "confidence"), "rules")
    if index.count() <= BROADCAST_RULES:
        index = F.broadcast(index)
    hits = pages.select(key, "tokens", F.explode("tokens").alias("token")).join(index, "token").filter(F.size(F.array_except("needed", "tokens")) == 0)
    return hits.groupBy(key).agg(F.max(F.struct("confidence", (-F.size("needed")).alias("n"), "rule_id")).alias("best")).select(key, "best.rule_id", "best.confidence")


def judge(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str]], min_pages: int = MIN_PAGES) -> DataFrame:
    """page_id, host, path, rule, verdict, mined_rule, mined_confidence for each row of pages.

    labels: doc_id, toxic (and quality); a page is bad where its label is toxic.
    """
    parts = with_parts(pages)
    parts = materialize(parts.withColumn("tokens", tokens(F.coalesce("url", F.lit("")), F.col("host"), F.col("path"))).drop("url").withColumn("row", F.monotonically_increasing_id()), "urls")
    labelled = materialize(parts.join(labels.groupBy("doc_id").agg((F.max("toxic") > 0).alias("bad")), F.col("page_id") == F.col("doc_id")).select("row", "tokens", "bad"), "labelled")
    classes = materialize(token_classes(labelled, min_pages), "classes")
    baskets = labelled.filter(F.size("tokens") > 0).select("row", "bad").join(in_classes(labelled, classes, "row"), "row", "left").withColumn("tokens", F.coalesce("tokens", F.array().cast("array<string>")))
    mined = materialize(mine(baskets, min_pages), "mined")
    needed = classes.join(mined.select(F.explode("tokens").alias("class")).distinct(), "class", "left_semi")
    best = matched(materialize(in_classes(parts, needed, "row"), "page_classes"), mined, "row")
    rule, verdict = written_rule(F.col("host"), F.col("path"), rules)
    found = parts.join(best, "row", "left")
    by_mined = F.when(F.col("rule_id").isNotNull(), "block").otherwise("allow")
    return found.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, by_mined).alias("verdict"), F.col("rule_id").alias("mined_rule"), F.col("confidence").alias("mined_confidence"))
