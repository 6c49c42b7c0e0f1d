"""URL filters, in DataFrame functions only: host and path rules, and gradient-boosted trees on lexical
features for the URLs that no rule fits.

The trees are trained from the URLs that rules label. Features become small whole numbers, so that all
labelled URLs fold into one row for each combination, and a level of a tree is one aggregation over those
rows: sums of gradients for each node, feature and bin. Only these bounded sums reach the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host and path) of a rule: it fits the host and its subdomains where the path starts so.
Rule = tuple[str, str]
#: So many suffixes, the most frequent ones, have statistics of their own as features; all others are pooled in one.
SUFFIXES = 256
BINS = 32


def host_of(url: str) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: str) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(rules: list[Rule]) -> Column:
    """The longest rule that fits columns host and path; of equally long ones the first. Null if none does."""
    out = F.lit(None).cast("string")
    for _, rule in sorted(reversed(rules), key=lambda r: len(r[1])):
        host, slash, path = rule.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(slash + path)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def _count(text: Column, mark: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))


def lexical_features() -> dict[str, Column]:
    """Small whole numbers from columns url and host; null urls count as empty."""
    url = F.coalesce("url", F.lit(""))
    size = F.greatest(F.length(url), F.lit(1))
    bin_ = lambda c: F.least(F.greatest(F.floor(c), F.lit(0)), F.lit(BINS - 1)).cast("int")
    # Shannon entropy of the distribution of all the url's characters
    parts = F.array_distinct(F.split(url, ""))
    entropy = F.aggregate(parts, F.lit(0.0), lambda acc, c: acc - F.when(c == "", 0.0).otherwise(_count(url, c) / size * F.log2(F.greatest(_count(url, c), F.lit(1)) / size)))
    return {
        "length": bin_(F.length(url) / 6),
        "depth": bin_(_count(F.col("path"), "/")),
        "digits": bin_(F.length(F.regexp_replace(url, "[^0-9]", "")) / size * BINS),
        "entropy": bin_(entropy * 5),
        "parameters": bin_(F.size(F.split(F.regexp_extract(url, r"(?s)\?([^#]*)", 1), "&")) - F.when(F.regexp_extract(url, r"(?s)\?([^#]*)", 1) == "", 1).otherwise(0)),
        "labels": bin_(_count(F.col("host"), ".")),
        "hyphens": bin_(_count(F.col("host"), "-")),
    }


def suffix_of() -> Column:
    return F.element_at(F.split("host", r"\."), -1)


class Trees:
    """A sum of trees over binned features, and the suffixes' statistics that two features look up."""

    def __init__(self, suffixes: dict[str, tuple[int, int]], rest: tuple[int, int], bias: float):
        self.suffixes, self.rest, self.bias, self.trees = suffixes, rest, bias, []

    def suffix_features(self) -> dict[str, Column]:
        rate, seen = F.lit(self.rest[0]), F.lit(self.rest[1])
        if self.suffixes:
            pairs = sorted(self.suffixes.items())
            rate = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for k, v in pairs for x in (k, v[0])]), suffix_of()), rate)
            seen = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for k, v in pairs for x in (k, v[1])]), suffix_of()), seen)
        return {"suffix_rate": rate, "suffix_seen": seen}

    def node(self, tree: dict, at: int = 1) -> Column:
        """The number of the leaf (or unsplit node) that a row reaches."""
        if at not in tree["splits"]:
            return F.lit(at)
        feature, cut = tree["splits"][at]
        return F.when(F.col(feature) <= cut, self.node(tree, 2 * at)).otherwise(self.node(tree, 2 * at + 1))

    def margin(self) -> Column:
        def leaf(tree: dict, at: int = 1) -> Column:
            if at not in tree["splits"]:
                return F.lit(tree["values"].get(at, 0.0))
            feature, cut = tree["splits"][at]
            return F.when(F.col(feature) <= cut, leaf(tree, 2 * at)).otherwise(leaf(tree, 2 * at + 1))

        return sum((leaf(t) for t in self.trees), F.lit(self.bias))


def train(labelled: DataFrame, rounds: int = 8, depth: int = 2, rate: float = 0.5, smooth: float = 1.0) -> Trees:
    """labelled: url, host, path, blocked (boolean). All rows count; with none, everything is allowed. Of splits of
    equal gain the first feature's, at the smallest bin, is taken; of suffixes of equal count the first by name.

    Statistics of the SUFFIXES most frequent suffixes, and of all others together, are features."""
    top = labelled.groupBy(suffix_of().alias("suffix")).agg(F.count("*").alias("n"), F.sum(F.col("blocked").cast("long")).alias("bad")).orderBy(F.desc("n"), "suffix").limit(SUFFIXES).collect()
    told = lambda n, bad: (int((bad + 0.5) / (n + 1) * (BINS - 1)), min(BINS - 1, int(math.log2(n + 1))))
    every = labelled.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("blocked").cast("long")), F.lit(0)).alias("bad")).first()
    model = Trees({r.suffix: told(r.n, r.bad) for r in top}, told(every.n - sum(r.n for r in top), every.bad - sum(r.bad for r in top)), 0.0)
    names = [*lexical_features(), *model.suffix_features()]
    cells = materialize(
        labelled.withColumns(lexical_features() | model.suffix_features()).groupBy(*names).agg(F.count("*").alias("n"), F.sum(F.col("blocked").cast("long")).alias("bad")), "cells"
    )
    n, bad = cells.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0))).first()
    model.bias = math.log((bad + 0.5) / (n - bad + 0.5)) if n else -1.0
    for _ in range(rounds if 0 < bad < n else 0):
        tree = {"splits": {}, "values": {}}
        p = F.lit(1.0) / (1 + F.exp(-model.margin()))
        scored = cells.select(*names, (F.col("bad") - F.col("n") * p).alias("g"), (F.col("n") * p * (1 - p)).alias("h"))
        totals: dict[int, tuple[float, float]] = {}  # of each node: all its rows' gradients
        for level in range(depth):
            each = scored.select(model.node(tree).alias("node"), "g", "h", F.explode(F.array(*(F.struct(F.lit(i).alias("f"), F.col(c).alias("bin")) for i, c in enumerate(names)))).alias("x"))
            sums = each.groupBy("node", "x.f", "x.bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
            for node in {r.node for r in sums if r.node >= 1 << level}:
                best = (1e-6, None, None, None)
                for f in range(len(names)):
                    rows = sorted((r.bin, r.g, r.h) for r in sums if r.node == node and r.f == f)
                    g, h = totals.setdefault(node, (sum(r[1] for r in rows), sum(r[2] for r in rows)))
                    gain = lambda a, b: a * a / (b + smooth)
                    a = b = 0.0
                    for bin_, x, y in rows[:-1]:
                        a, b = a + x, b + y
                        got = round(gain(a, b) + gain(g - a, h - b) - gain(g, h), 6)
                        if got > best[0]:
                            best = (got, names[f], bin_, ((a, b), (g - a, h - b)))
                if best[1]:
                    tree["splits"][node] = best[1:3]
                    totals[2 * node], totals[2 * node + 1] = best[3]
        tree["values"] = {n: round(rate * g / (h + smooth), 9) for n, (g, h) in totals.items() if n not in tree["splits"]}
        model.trees.append(tree)
    return model


def judge(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """page_id, host, path, rule, verdict of every row: the longest fitting rule's verdict, else the trees'.

    A null url, or one without ://, has an empty host and path, and no rule. All of a url counts, however long; of
    rules of equal length the first wins. A margin of 0 allows. Repeated rows get a row each; other columns are
    ignored, whatever their names. An empty table gives no rows."""
    parts = pages.select("page_id", "url").withColumns({"host": host_of("url"), "path": path_of("url")}).withColumn("rule", matching_rule(rules))
    says = F.create_map(*[F.lit(x) for verdict, rule in rules for x in (rule, verdict)])
    model = train(parts.where("rule is not null").select("url", "host", "path", (F.element_at(says, F.col("rule")) == "block").alias("blocked")))
    scored = parts.withColumns(lexical_features() | model.suffix_features())
    method = F.when(model.margin() > 0, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce(F.element_at(says, F.col("rule")), method).alias("verdict"), F.round(1 / (1 + F.exp(-model.margin())), 6).alias("block_probability"))
