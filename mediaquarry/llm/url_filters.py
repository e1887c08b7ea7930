r"""URL filters by association rules, with DataFrame operations only.

A URL becomes a set of tokens: all the domains that its host lies under (``d:example.net``), the words of its host
(``w:casino``), the segments of its path with digits as ``#`` (``s:en``), the path's extension (``x:html``) and the names of its
query's fields (``q:page``).  What goes with a label in at least ``min_support`` of the labelled URLs (and ``min_rows``) and with
``min_confidence`` is a rule, unless a rule of fewer tokens says the same at least as surely.  An inverted index, from tokens to
the rules that hold them, matches: a rule fits where all its tokens are found.

All frequent tokens of a URL are mined, and all sets of them: there is no cap on either.  What keeps that small loses no rule.
URLs of the same frequent tokens are one row with counts.  Tokens that occur in the same URLs are one class, and rules are of
classes; ``mine`` spells them out, ``judge`` matches them as they are.  Sets grow by one class a round, and only sets grow that
are rarer than all their parts and have both labels: others, and all that contain them, have a part that says the same as
surely.  So the rounds are as many as the longest rule has classes, and one more.

A short list of stated rules (``POLICY``) goes before what is mined: the longest that fits decides.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, table, with_groups, written

MIN_SUPPORT, MIN_ROWS, MIN_CONFIDENCE = 0.002, 8, 0.7
#: Of how many of its frequent tokens a URL's rules are made: of all.
TOKENS = None
#: Domains of more characters than a domain name can have are tokens by their digest, so that a host's tokens stay small.
DOMAIN_CHARS = 255
#: Rules that are broadcast at once; more are matched in as many passes as it takes.
RULES_AT_ONCE = 1 << 16
#: The stated rules: what a URL under a host or its subdomains, with a path that begins so, is.
POLICY = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_RULES = "tokens array<string>, verdict string, confidence double, support double, anchor string"
_CLASS_RULES = "classes array<long>, verdict string, confidence double, support double, anchor long"
NEW = ("host", "path", "rule", "verdict", "mined_tokens", "mined_confidence")


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty for null, or without one."""
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def stated(host: Column, path: Column, policy: Sequence[tuple[str, str]] = POLICY) -> tuple[Column, Column]:
    """(rule, verdict) of the longest stated rule that fits, or nulls; of equally long ones the first in the list.

    The list is a driver's constant of a few rules: it becomes an expression of the scan.
    """
    rule = verdict = F.lit(None).cast("string")
    for what, text in sorted(policy, key=lambda r: len(r[1]), reverse=True)[::-1]:
        domain, slash, rest = text.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it occurs there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def tokens_of(url: Column) -> Column:
    """The distinct tokens of a URL, as an array; empty for null, or without ``://``."""
    host, path = host_of(url), F.translate(path_of(url), _UPPER, _LOWER)
    segments = F.split(path, "/", -1)
    tagged = lambda tag, parts: F.transform(F.filter(parts, lambda s: s != ""), lambda s: F.concat(F.lit(tag), s))
    spelled = lambda d: F.when(F.length(d) <= DOMAIN_CHARS, d).otherwise(F.concat(F.lit("sha256="), F.sha2(d, 256)))
    under = lambda h, n: _let(F.call_function("substring_index", h, F.lit("."), -n), spelled)
    domains = _let(host, lambda h: F.transform(F.sequence(F.lit(1), F.size(F.split(h, r"\.", -1))), lambda n: under(h, n)))
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    return F.coalesce(
        F.array_distinct(F.concat(
            tagged("d:", domains), tagged("w:", F.split(host, r"[^a-z0-9]+", -1)),
            tagged("s:", F.transform(segments, lambda s: F.regexp_replace(s, r"\d+", "#"))),
            tagged("x:", F.array(F.regexp_extract(path, r"\.([a-z0-9]{1,5})$", 1))),
            tagged("q:", F.transform(F.split(query, "&", -1), lambda s: F.substring_index(s, "=", 1))),
        )),
        F.array().cast("array<string>"),
    )


def _vocabulary(labelled: DataFrame, least: float) -> DataFrame:
    """(token, code, n) of the tokens that at least ``least`` URLs of one label have."""
    rows = labelled.select("label", F.explode("tokens").alias("token"))
    each = rows.groupBy("token").agg(*(F.count_if(F.col("label") == y).alias(y) for y in ("allow", "block")))
    return written(each.filter(F.greatest("allow", "block") >= least).select("token", F.monotonically_increasing_id().alias("code"), (F.col("allow") + F.col("block")).alias("n")), "tokens")


def _profiles(labelled: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(profile, codes, allow, block): the distinct sets of frequent tokens, and how many URLs of each label have them."""
    rows = labelled.select("id", "label", F.explode("tokens").alias("token"))
    known = with_groups(rows, vocabulary, "token", "n", F.concat(F.lit("\0"), F.col("id"))).filter("code IS NOT NULL")
    sets = known.groupBy("id", "label").agg(F.array_sort(F.collect_list("code")).alias("codes"))
    counted = sets.groupBy("codes").agg(*(F.count_if(F.col("label") == y).alias(y) for y in ("allow", "block")))
    return written(counted.select(F.monotonically_increasing_id().alias("profile"), "codes", "allow", "block"), "profiles")


def _classes(profiles: DataFrame, vocabulary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``members`` (token, class, n) and ``held`` (profile, allow, block, class): tokens of the same profiles are a class.

    Hashes propose classes; one whose tokens some profile has in part falls apart into its tokens.
    """
    places = profiles.select("profile", F.explode("codes").alias("code"))
    signs = places.groupBy("code").agg(F.bit_xor(F.xxhash64("profile")).alias("a"), F.bit_xor(F.xxhash64("profile", F.lit("b"))).alias("b"))
    same = signs.groupBy("a", "b").agg(F.min("code").alias("class"), F.count(F.lit(1)).alias("width"))
    proposed = written(vocabulary.join(signs.join(same, ["a", "b"]), "code").select("code", "token", "n", "class", "width"), "classes")
    rows = profiles.select("profile", "allow", "block", F.explode("codes").alias("code"))
    placed = written(with_groups(rows, proposed.select("code", "n", "class", "width"), "code", "n", -1 - F.col("profile")), "placed")
    partly = placed.groupBy("profile", "class").agg(F.count(F.lit(1)).alias("n"), F.first("width").alias("width")).filter("n <> width")
    broken = written(partly.select(F.col("class").alias("broken")).distinct(), "broken")
    own = F.when(F.col("broken").isNull(), F.col("class")).otherwise(F.col("code")).alias("class")
    apart = lambda df: df.join(F.broadcast(broken), F.col("class") == F.col("broken"), "left")
    return apart(proposed).select("token", own, "n"), apart(placed).select("profile", "allow", "block", own).distinct()


def _grown(held: DataFrame, sets: DataFrame) -> DataFrame:
    """The sets of one class more in each profile: out of two of ``sets`` there that differ in their last class only."""
    near = held.join(sets.select("items"), "items", "left_semi")
    lasts = near.groupBy("profile", "allow", "block", F.slice("items", 1, F.size("items") - 1).alias("first")).agg(F.array_sort(F.collect_list(F.element_at("items", -1))).alias("lasts"))
    one = lasts.select("profile", "allow", "block", "first", "lasts", F.posexplode("lasts").alias("at", "one"))
    two = one.select("profile", "allow", "block", "first", "one", F.explode(F.slice("lasts", F.col("at") + 2, F.size("lasts"))).alias("two"))
    return two.select("profile", "allow", "block", F.concat("first", F.array("one", "two")).alias("items"))


def _counted(held: DataFrame, before: DataFrame | None, size: int, least: float) -> DataFrame:
    """The sets of ``size`` classes that are frequent with a label and rarer than each part: their counts, and the parts' confidences.

    ``before``: the sets of one class less that may grow.  A set with a part that may not is none.
    """
    found = held.groupBy("items").agg(F.sum("allow").alias("allow"), F.sum("block").alias("block")).filter(F.greatest("allow", "block") >= least)
    if before is None:
        found = found.select("*", F.lit(-1.0).alias("parts_allow"), F.lit(-1.0).alias("parts_block"))
    else:
        without = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.filter("items", lambda _, i: i != k))
        parts = found.select("items", "allow", "block", F.explode(without).alias("part"))
        known = before.select(F.col("items").alias("part"), (F.col("allow") + F.col("block")).alias("n"), *(F.greatest(f"parts_{y}", f"by_{y}").alias(f"best_{y}") for y in ("allow", "block")))
        met = parts.join(known, "part").groupBy("items", "allow", "block").agg(F.count(F.lit(1)).alias("met"), F.min("n").alias("n"), *(F.max(f"best_{y}").alias(f"parts_{y}") for y in ("allow", "block")))
        found = met.filter((F.col("met") == size) & (F.col("n") > F.col("allow") + F.col("block"))).drop("met", "n")
    return written(found.select("*", *((F.col(y) / (F.col("allow") + F.col("block"))).alias(f"by_{y}") for y in ("allow", "block"))), "sets")


def _mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_rows: int = MIN_ROWS, min_confidence: float = MIN_CONFIDENCE) -> tuple[DataFrame, DataFrame, int]:
    """Rules of classes (classes, verdict, confidence, support, anchor), the classes' ``members`` (token, class, n), and the longest rule's size."""
    rows = labelled.filter(F.col("url").isNotNull() & F.col("label").isin("allow", "block")).select("url", "label").distinct()
    rows = written(rows.select(F.monotonically_increasing_id().alias("id"), "label", tokens_of(F.col("url")).alias("tokens")), "labelled")
    total = rows.count()
    least = max(min_rows, min_support * total)
    vocabulary = _vocabulary(rows, least)
    if vocabulary.isEmpty():
        spark = labelled.sparkSession
        return spark.createDataFrame([], _CLASS_RULES), spark.createDataFrame([], "token string, class long, n long"), 0
    members, held = (written(df, label) for df, label in zip(_classes(_profiles(rows, vocabulary), vocabulary), ("members", "held")))
    held = held.select("profile", "allow", "block", F.array("class").alias("items"))
    levels, before = [], None
    while True:
        levels.append(_counted(held, before, len(levels) + 1, least))
        before = levels[-1].filter("allow > 0 AND block > 0")
        if before.limit(len(levels) + 1).count() <= len(levels):  # a larger set has more parts than that
            break
        held = written(_grown(held, before), "held")
    said = lambda y: (F.col(y) >= least) & (F.col(f"by_{y}") >= min_confidence) & (F.col(f"by_{y}") > F.col(f"parts_{y}"))
    rules = [sets.filter(said(y)).select(F.col("items").alias("classes"), F.lit(y).alias("verdict"), F.col(f"by_{y}").alias("confidence"), (F.col(y) / total).alias("support")) for sets in levels for y in ("allow", "block")]
    found = rules[0]
    for more in rules[1:]:
        found = found.unionByName(more)
    found, counts = written(found, "rules"), members.groupBy("class").agg(F.min("n").alias("n"))
    anchors = found.select("classes", "verdict", F.explode("classes").alias("class")).join(counts, "class").groupBy("classes", "verdict").agg(F.min_by("class", F.struct("n", "class")).alias("anchor"))
    return written(found.join(anchors, ["classes", "verdict"]).select("classes", "verdict", "confidence", "support", "anchor"), "kept_rules"), members, len(levels)


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_rows: int = MIN_ROWS, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Rules (tokens sorted, verdict, confidence, support, anchor) out of labelled URLs: columns url and label (allow or block).

    ``anchor`` is the rule's rarest token.  A URL counts once for each label that it has, so that repeats weigh nothing.
    Rows without a URL or of other labels are no examples; without examples there are no rules.  Other columns are not read.
    """
    rules, members, longest = _mine(labelled, min_support, min_rows, min_confidence)
    spelled = rules.select("classes", "verdict", "confidence", "support", F.array().cast("array<struct<n:bigint,token:string>>").alias("own"))
    for at in range(longest):  # a token of each class, in all ways
        one = members.select("class", F.struct("n", "token").alias("one"))
        joined = spelled.join(one, F.get("classes", F.lit(at)) == F.col("class"), "left")
        spelled = joined.select("classes", "verdict", "confidence", "support", F.when(F.col("one").isNull(), F.col("own")).otherwise(F.concat("own", F.array("one"))).alias("own"))
    return written(spelled.select(F.array_sort(F.col("own")["token"]).alias("tokens"), "verdict", "confidence", "support", F.array_min("own")["token"].alias("anchor")), "spelled_rules")


def match(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The best rule of each URL that any fits: (url, verdict, confidence, support, tokens).  ``urls`` should be distinct.

    Best: the surest, then the more often seen, then the smaller by verdict and tokens.
    """
    members = rules.select(F.explode("tokens").alias("token")).distinct().withColumn("class", F.col("token"))
    return _match(urls, rules.withColumnRenamed("tokens", "classes"), members)


def _match(urls: DataFrame, rules: DataFrame, members: DataFrame) -> DataFrame:
    """``match`` by rules of classes: a rule fits where some token of each of its classes is found, the smallest ones tell it.

    The index has each rule under its anchor, its rarest class, and a rule found there is held against the URL's other classes.
    """
    rules = written(rules, "indexed")
    asked = written(urls.select(F.monotonically_increasing_id().alias("id"), "url", tokens_of(F.col("url")).alias("tokens")), "asked")
    rows = asked.select("id", F.explode("tokens").alias("token"))
    used = members.join(rules.select(F.explode("classes").alias("class")).distinct(), "class", "left_semi").select("token", "class")
    sizes = written(rows.groupBy("token").agg(F.count(F.lit(1)).alias("n")).join(used, "token"), "sizes")
    known = with_groups(rows, sizes, "token", "n", F.concat(F.lit("\0"), F.col("id"))).filter("class IS NOT NULL")
    least = known.groupBy("id", "class").agg(F.min("token").alias("token"))
    own = written(least.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("class", "token"))).alias("own")), "own")
    has = F.map_keys("own")
    passes, found = max(1, math.ceil(rules.count() / RULES_AT_ONCE)), None
    for k in range(passes):
        some = rules.filter(F.pmod(F.xxhash64("classes", "verdict"), F.lit(passes)) == k)
        index = some.groupBy("anchor").agg(F.collect_list(F.struct((-F.col("confidence")).alias("unsure"), (-F.col("support")).alias("rare"), "verdict", "classes")).alias("entries"))
        hits = own.select("id", "own", F.explode(has).alias("anchor")).join(F.broadcast(index), "anchor")
        fitting = F.filter("entries", lambda e: F.forall(e["classes"], lambda c: F.array_contains(has, c)))
        told = F.transform(fitting, lambda e: F.struct(e["unsure"].alias("unsure"), e["rare"].alias("rare"), e["verdict"].alias("verdict"), F.array_sort(F.transform(e["classes"], lambda c: F.element_at("own", c))).alias("tokens")))
        hits = hits.select("id", F.array_min(told).alias("rule")).filter("rule IS NOT NULL")
        found = hits if found is None else found.unionByName(hits)
    best = found.groupBy("id").agg(F.min("rule").alias("rule")).join(asked.select("id", "url"), "id")
    return best.select("url", "rule.verdict", (-F.col("rule.unsure")).alias("confidence"), (-F.col("rule.rare")).alias("support"), "rule.tokens")


def judge(pages: DataFrame, labels: DataFrame | None = None, url_col: str = "url", policy: Sequence[tuple[str, str]] = POLICY, otherwise: str = "allow", **mining) -> DataFrame:
    """``pages`` with host, path, rule, verdict, and tokens and confidence of the mined rule where one decided.

    ``labels``: further labelled URLs (url, label: allow or block).  URLs that a stated rule judges are examples with its
    verdict, the others take theirs from ``labels``; where neither a stated nor a mined rule fits, the verdict is
    ``otherwise``, as for null and empty URLs.  Repeated rows are all judged, alike.  An empty table stays empty.
    Columns of the same names as the new ones are replaced; all others stay.
    """
    kept = [F.col(f"`{c}`") for c in pages.columns if c.lower() not in NEW]
    key, spread = fresh(pages.columns, "__url"), fresh(pages.columns, "__spread")
    url = F.col(f"`{key}`")
    rows = pages.withColumn(key, F.col(f"`{url_col}`"))
    rule, verdict = stated(host_of(url), path_of(url), policy)
    urls = written(rows.filter(url.isNotNull()).groupBy(url.alias("url")).agg(F.count(F.lit(1)).alias("n")), "urls")
    ruled = urls.withColumn("label", stated(host_of(F.col("url")), path_of(F.col("url")), policy)[1])
    examples, open_ = ruled.filter("label IS NOT NULL").select("url", "label"), ruled.filter("label IS NULL").select("url", "n")
    if labels is not None:
        examples = examples.unionByName(labels.select("url", "label").join(open_, "url", "left_semi"))
    rules, members, _ = _mine(examples, **mining)
    best = _match(open_, rules, members)
    mined = written(open_.join(best, "url").select(F.col("url").alias(key), F.col("n").alias("__n"), F.struct("verdict", "tokens", "confidence").alias("__mined")), "mined")
    # a URL without a mined rule, null too, is nobody's key: its rows go anywhere
    loose = F.concat(F.lit("\0"), F.monotonically_increasing_id().cast("string"))
    placed = rows.withColumn(spread, loose).withColumn(key, F.coalesce(key, spread))
    judged = with_groups(placed, mined, key, "__n", F.col(spread))
    url = F.when(~url.startswith("\0"), url)
    rule, verdict = stated(host_of(url), path_of(url), policy)
    return judged.select(
        *kept, host_of(url).alias("host"), path_of(url).alias("path"), rule.alias("rule"), F.coalesce(verdict, F.col("__mined.verdict"), F.lit(otherwise)).alias("verdict"),
        F.col("__mined.tokens").alias("mined_tokens"), F.col("__mined.confidence").alias("mined_confidence"),
    )


def op11_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of all ``pages``.  Nothing in the tables labels URLs themselves: examples are the pages that a stated rule judges,
    and of the others those whose id has a row in ``labels`` (block: of low quality or toxic).  Null URLs have empty host and path."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.when((F.col("quality") == 0) | (F.col("toxic") == 1), "block").otherwise("allow").alias("label"))
    return judge(pages, pages.join(labels, "page_id").select("url", "label")).select("page_id", "host", "path", "rule", "verdict", "mined_tokens", "mined_confidence")
