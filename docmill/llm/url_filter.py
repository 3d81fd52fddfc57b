"""URL filters by a sorted sweep over reversed-host keys.

A rule names a host and the start of a path; it fits that host and all its subdomains. The labels of a host, reversed
and each closed by "/", make a key under which a rule's hosts are one interval: all keys that start with the rule's.
Such intervals nest or are disjoint. Rule keys and url keys are sorted together and swept: the stack of open rules
holds one place a label depth, which the latest key of that depth takes; a place counts while the url's key still
starts with it. The rules of the open places are then held against the path, and the longest text (host, then path)
wins; of equal texts the longer host, and of two verdicts for one text "block".

The sweep is a window inside (first label, salt). The salt is a hash of the row, so that a host or a label with most
of the rows is swept in many tasks; rules are repeated for each salt, urls are not.

Null url, or one without "://": host and path are empty and no rule fits. Empty tables, repeated rows, null ids and
columns of any other name pass through: one row comes back for each row of pages. Rules with a null or empty host
raise no error and fit nothing; a null path is an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmill.llm.common import ascii_lower


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (ASCII lower case) and path of a url; both empty where there is no "://"."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    """com/example/www/ for www.example.com. A host holds no "/", so keys are prefixes just where hosts are suffixes."""
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "/"), F.lit("/")))


def filter_urls(pages: DataFrame, rules: DataFrame, *, id_col: str = "page_id", url_col: str = "url", default: str = "allow", salts: int | None = None) -> DataFrame:
    """pages: id_col, url_col; rules: host, path, verdict (allow or block). Returns id_col, host, path, rule, verdict.

    default: the verdict where no rule fits. salts: tasks for each first label; by default the session's number of
    shuffle partitions, which is set to the size of the input.
    """
    spark = pages.sparkSession
    salts = salts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    host, path = url_parts(F.col("url"))
    urls = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).select("id", host.alias("host"), path.alias("path"))
    urls = urls.withColumn("key", host_key(F.col("host"))).withColumn("salt", F.pmod(F.xxhash64("id", "host", "path"), F.lit(salts)).cast("int"))

    clean = rules.select(ascii_lower(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), F.col("verdict")).filter("host != ''")
    text = F.concat("host", "path")
    ranked = F.struct(F.length(text).alias("n"), F.length("host").alias("h"), (F.col("verdict") == "block").alias("b"), text.alias("rule"), F.col("path").alias("path"), F.col("verdict").alias("verdict"))
    nodes = clean.groupBy(host_key(F.col("host")).alias("key")).agg(F.collect_set(ranked).alias("rules"))
    depth = lambda key: F.length(key) - F.length(F.replace(key, F.lit("/"), F.lit("")))
    deepest = nodes.agg(F.max(depth(F.col("key")))).first()[0] or 0

    nodes = nodes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    both = urls.withColumn("rules", F.lit(None).cast(nodes.schema["rules"].dataType)).unionByName(nodes, allowMissingColumns=True)
    both = both.withColumn("first", F.substring_index("key", "/", 1)).withColumn("is_url", F.col("host").isNotNull())
    sweep = Window.partitionBy("first", "salt").orderBy("key", "is_url").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    place = F.struct(F.col("key"), F.col("rules"))
    stack = [F.last(F.when(~F.col("is_url") & (depth(F.col("key")) == d), place), ignorenulls=True).over(sweep).alias(f"open_{d}") for d in range(1, deepest + 1)]
    swept = both.select("id", "host", "path", "key", "is_url", *stack).filter("is_url")
    if not stack:
        return swept.select(F.col("id").alias(id_col), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    open_rules = [F.when(F.startswith(F.col("key"), F.col(f"open_{d}.key")), F.col(f"open_{d}.rules")) for d in range(1, deepest + 1)]
    fits = F.filter(F.flatten(F.array_compact(F.array(*open_rules))), lambda r: F.startswith(F.col("path"), r["path"]))
    won = swept.withColumn("won", F.array_max(fits))
    return won.select(F.col("id").alias(id_col), "host", "path", F.col("won.rule").alias("rule"), F.coalesce("won.verdict", F.lit(default)).alias("verdict"))
