"""URL filters: rules of host and path prefix, found through hashes of the expressions of a URL.

A URL is expanded into the joins of its host's suffixes with its path's prefixes, of the shapes that occur among the rules. Their
SHA-256 digests meet those of the rules in an equi-join on the first four bytes; the full digest confirms, and the longest rule wins.
Each distinct (host, path) is judged once, after a map-side combine, and the verdicts are joined back; only URLs with a rule come back.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased, nothing else changed (ports and names of users
belong to it). Path: from there up to ``?``, ``#`` or the end. A null URL, or one without ``://``, has both empty. A rule fits its host and all
hosts below it, if the path begins with the rule's path. Among rules that fit the longest text host + path wins, then the longer host,
then block before allow. No rule: null, and the verdict ``otherwise``.

Defined results. Rows that repeat, with null ids too, come out as often as they came in. Rules with a null or empty host, a null
verdict, or a path that no URL can have (not empty and without a leading ``/``) fit nothing; a null path is the empty one. URLs of any length are taken whole. Columns
other than the named ones are not read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsift.plans.sizing import join_small

RULE_SCHEMA = "host string, path string, verdict string"
#: Bytes of a digest that the join uses.
SHORT = 4


def host(url: Column) -> Column:
    """The host of a URL as it is matched, empty without ``://``."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1)
    return F.translate(found, string.ascii_uppercase, string.ascii_lowercase)


def path(url: Column) -> Column:
    """The path of a URL with its leading slash, empty where there is none."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def digest(expression: Column) -> Column:
    return F.unhex(F.sha2(expression, 256))


def short(digested: str) -> Column:
    return F.substring(digested, 1, SHORT)


def prepared(rules: DataFrame) -> DataFrame:
    """(short, digest, rule, size, host_size, blocks, verdict): each fitting rule once."""
    lowered = F.translate("host", string.ascii_uppercase, string.ascii_lowercase)
    rows = rules.select(lowered.alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
    rows = rows.where("host <> '' and verdict is not null and not host rlike '[/?#]'")
    rows = rows.where("not path rlike '[?#]' and (path = '' or startswith(path, '/'))")
    blocks = (F.col("verdict") == "block").cast("int")
    rows = rows.groupBy("host", "path").agg(F.max(F.struct(blocks.alias("blocks"), "verdict")).alias("said"))
    rows = rows.withColumns({"rule": F.concat("host", "path"), "digest": digest(F.concat("host", "path"))})
    labels = F.length("host") - F.length(F.replace("host", F.lit("."), F.lit(""))) + 1
    return rows.select(
        short("digest").alias("short"), "digest", "rule", F.length("rule").alias("size"), F.length("host").alias("host_size"),
        labels.alias("labels"), F.length("path").alias("depth"), F.endswith("path", F.lit("/")).alias("closed"), "said.verdict",
    )


def shapes(rules: DataFrame) -> Column:
    """Array of (labels, depth, closed) that occur among prepared rules; at most labels times path lengths of one rule set."""
    rows = rules.select("labels", "depth", "closed").distinct().collect()
    each = [F.struct(F.lit(r["labels"]).alias("labels"), F.lit(r["depth"]).alias("depth"), F.lit(r["closed"]).alias("closed")) for r in rows]
    return F.array(*each) if each else F.array().cast("array<struct<labels:int,depth:int,closed:boolean>>")


def expressions(kinds: Column) -> Column:
    """The host-suffix and path-prefix expressions of the columns ``host`` and ``path`` that have the shape of a rule."""
    n_labels = F.length("host") - F.length(F.replace("host", F.lit("."), F.lit(""))) + 1

    def possible(shape: Column) -> Column:
        ends = ~shape["closed"] | (F.substring(F.col("path"), shape["depth"], F.lit(1)) == "/")
        return (shape["labels"] <= n_labels) & (shape["depth"] <= F.length("path")) & ends

    def expression(shape: Column) -> Column:
        return F.concat(F.call_function("substring_index", F.col("host"), F.lit("."), -shape["labels"]), F.left(F.col("path"), shape["depth"]))

    return F.transform(F.filter(kinds, possible), expression)


def judge(pages: DataFrame, rules: DataFrame, page_id: str = "page_id", url: str = "url", otherwise: str = "allow") -> DataFrame:
    """(<page_id>, host, path, rule, verdict) of every row. ``rules`` has host, path and verdict (``block`` or ``allow``)."""
    rules = prepared(rules)
    rows = pages.select(F.col(page_id).alias("page"), host(F.col(url)).alias("host"), path(F.col(url)).alias("path"))
    places = rows.select("host", "path").where("host <> ''").distinct()
    made = places.withColumn("expression", F.explode(expressions(shapes(rules))))
    made = made.select("host", "path", digest(F.col("expression")).alias("made")).withColumn("short", short("made"))
    known = rules.select("short", "digest", "rule", "size", "host_size", "verdict")
    fits = join_small(made, known, ["short"]).where("made = digest")
    best = fits.groupBy("host", "path").agg(F.max(F.struct("size", "host_size", "rule", "verdict")).alias("best"))
    judged = best.select("host", "path", "best.rule", "best.verdict")
    found = rows.join(judged, ["host", "path"], "left")
    return found.select(F.col("page").alias(page_id), "host", "path", "rule", F.coalesce("verdict", F.lit(otherwise)).alias("verdict"))
