"""URL rules by a sort-merge range join.

A host is written with its labels reversed and a dot after each, so a rule's
host and all its subdomains are the keys of one prefix, an interval.  Rules and
points are sorted together and swept: the running sum of starts and ends is the
depth of the stack of nested active rules, and the last start at a level is what
stands there on the stack.  One sweep over hosts finds each host's stack of rule
hosts, a second over host and path the longest rule path that fits.

The sweep runs in key ranges of even size; each range begins with the depth and
the stack that the ranges before it leave.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lookup, materialize

#: Ranges of a sweep, and the keys drawn to place their borders.  They set how the work is dealt, never the result.
RANGES = 64
DRAWN = 2048
DEFAULT_VERDICT = "allow"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/ ? #`` or the end, A-Z lowered; path: from there up to ``? #`` or the end."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.regexp_replace(rest, r"^[^/?#]*", ""), r"^[^?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def reversed_host(host: Column) -> Column:
    """``www.example.com`` as ``com.example.www.``"""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def sweep(points: DataFrame, starts: DataFrame, every: bool) -> DataFrame:
    """``key, id`` of the active prefixes of each point: all on the stack (``every``) or the innermost.

    points(key binary), distinct; starts(key binary, id string), distinct keys.
    A prefix is active from its key up to its key followed by byte 255, which no
    UTF-8 text holds; so prefixes nest or are apart.
    """
    bound = F.concat(F.col("key"), F.unhex(F.lit("FF")))
    rows = (
        points.select("key", F.lit(1).alias("kind"), F.lit(0).alias("delta"), F.lit(None).cast("string").alias("id"))
        .unionByName(starts.select("key", F.lit(0).alias("kind"), F.lit(1).alias("delta"), "id"))
        .unionByName(starts.select(bound.alias("key"), F.lit(0).alias("kind"), F.lit(-1).alias("delta"), F.lit(None).cast("string").alias("id")))
    )
    rows = materialize(rows, "sweep")
    drawn = sorted(bytes(r["key"]) for r in rows.orderBy(F.xxhash64("key"), "key").limit(DRAWN).select("key").collect())
    borders = sorted({drawn[i * len(drawn) // RANGES] for i in range(1, RANGES)}) if drawn else []
    part = F.size(F.filter(F.array(*[F.lit(b) for b in borders]), lambda b: b <= F.col("key"))) if borders else F.lit(0)
    rows = rows.withColumn("part", part)
    change, depth, carried = {r["part"]: r["d"] for r in rows.groupBy("part").agg(F.sum("delta").alias("d")).collect()}, 0, []
    for p in range(len(borders) + 1):  # depth before each range
        carried.append(F.lit(depth))
        depth += change.get(p, 0)
    order = Window.partitionBy("part").orderBy("key", "kind")
    rows = rows.withColumn("depth", (F.sum("delta").over(order) + F.element_at(F.array(*carried), F.col("part") + 1)).cast("int"))
    rows = materialize(rows.where("kind = 1 or delta = 1").select("part", "key", "kind", "depth", "id"), "sweep")
    # the last start of each level in each range stands at the beginning of all later ranges, unless one between replaces it
    last = rows.where("kind = 0").groupBy("part", "depth").agg(F.max_by("id", "key").alias("id"))
    later = last.where(F.col("part") < len(borders)).withColumn("to", F.explode(F.sequence(F.col("part") + 1, F.lit(len(borders)))))
    later = later.groupBy("to", "depth").agg(F.max_by("id", "part").alias("id"))
    levels = F.sequence(F.lit(1), F.col("depth")) if every else F.array("depth")
    asked = rows.where("kind = 1 and depth > 0").withColumn("level", F.explode(levels))
    stacked = (
        asked.select("part", "level", "key", "kind", "id")
        .unionByName(rows.where("kind = 0").select("part", F.col("depth").alias("level"), "key", "kind", "id"))
        .unionByName(later.select(F.col("to").alias("part"), F.col("depth").alias("level"), F.unhex(F.lit("")).alias("key"), F.lit(-1).alias("kind"), "id"))
    )
    here = Window.partitionBy("part", "level").orderBy("key", "kind")
    return stacked.withColumn("id", F.last("id", ignorenulls=True).over(here)).where("kind = 1").select("key", "id")


def judge(pages: DataFrame, rules: DataFrame, default: str = DEFAULT_VERDICT) -> DataFrame:
    """``page_id, host, path, rule, verdict`` for every row of ``pages(page_id, url)``.

    rules(host, path, verdict): a rule fits its host and all subdomains where
    the url's path starts with its path; the longest (host and path together,
    then host) wins; of rules given twice with unlike verdicts ``block`` wins.
    No rule: null and ``default``.  A null url or one without ``://`` has an
    empty host and path.  Repeated rows each give a row; other columns are not
    read; without pages or rules the result is empty or all ``default``.
    """
    host, path = host_and_path(F.col("url"))
    seen = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"))
    seen = seen.select("page_id", host.alias("host"), path.alias("path"))
    given = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict")).where("host <> ''")
    given = given.select(F.concat("host", "path").alias("rule"), reversed_host(F.col("host")).alias("rkey"), F.length("host").alias("host_length"), "path", "verdict")
    given = materialize(given, "rules")

    urls = materialize(seen.groupBy("host", "path").agg(F.count("*").alias("n")).withColumn("rkey", reversed_host(F.col("host"))), "urls")
    hosts = urls.groupBy("rkey").agg(F.count("*").alias("n"))
    binary = lambda c: F.encode(c, "UTF-8")
    stacks = sweep(hosts.select(binary("rkey").alias("key")), given.select(binary("rkey").alias("key"), F.col("rkey").alias("id")).distinct(), True)
    stacks = stacks.groupBy(F.decode("key", "UTF-8").alias("rkey")).agg(F.collect_list("id").alias("stack"))  # a host's labels bound it
    facts = hosts.join(stacks, "rkey").select("rkey", "stack", "n")
    n_urls = urls.count()
    nested = lookup(urls.select("host", "path", "rkey"), facts, ["rkey"], n_urls, "path").where("stack is not null")
    nested = materialize(nested.select("host", "path", F.explode("stack").alias("at")), "urls")

    joint = lambda r, p: binary(F.concat(r, F.lit("\x01"), p))
    asked = nested.groupBy("at", "path").agg(F.count("*").alias("n")).select(joint(F.col("at"), F.col("path")).alias("key"), "n")
    fits = sweep(asked.select("key"), given.select(joint(F.col("rkey"), F.col("path")).alias("key"), F.to_json(F.struct("rule", "verdict", "host_length")).alias("id")), False)
    fits = asked.join(fits, "key")
    won = lookup(nested.withColumn("key", joint(F.col("at"), F.col("path"))), fits, ["key"], nested.count(), "host").where("id is not null")
    won = won.withColumn("id", F.from_json("id", "rule string, verdict string, host_length int")).groupBy("host", "path").agg(
        F.max(F.struct(F.length("id.rule").alias("size"), F.col("id.host_length").alias("host_length"), F.col("id.rule").alias("rule"), F.col("id.verdict").alias("verdict"))).alias("won")
    )
    facts = urls.join(won, ["host", "path"]).select("host", "path", F.col("won.rule").alias("rule"), F.col("won.verdict").alias("verdict"), "n")
    out = lookup(seen, facts, ["host", "path"], pages.count(), "page_id")
    return out.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
