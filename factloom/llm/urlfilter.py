"""URL filter whose decisions reach a page's aliases: components over redirects and canonical links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import checkpoint, components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Up to so many rules are written into the plan; more are joined by host.
INLINE_RULES = 500
TAGS = "(?is)<(?:link|meta)[^>]*>"
CANONICAL, REFRESH = "(?is)rel=[\"'']?canonical[\"'' />]", "(?is)http-equiv=[\"'']?refresh"
HREF, REFRESH_URL = "(?is)href=[\"'']?([^\"'' >]*)", "(?is)content=[\"''][^\"''>]*url=([^\"''>]*)"


# SQL text that Spark and the oracle share.
def host_sql(url: str) -> str:
    return f"translate(regexp_extract(coalesce({url}, ''), '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}')"


def path_sql(url: str) -> str:
    return f"regexp_extract(coalesce({url}, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1)"


def node_sql(url: str, every: str = "") -> str:
    """Host, path and query, without scheme, fragment and tracking parameters: what pages are known by."""
    query = f"regexp_replace(regexp_replace(regexp_extract({url}, '(?s)^[^?#]*[?]([^#]*)', 1), '(^|&)(utm_[^&]*|ref=[^&]*)', ''{every}), '^&', '')"
    return f"{host_sql(url)} || {path_sql(url)} || CASE WHEN {query} = '' THEN '' ELSE '?' || {query} END"


def resolve_sql(target: str, url: str) -> str:
    host, path = host_sql(url), path_sql(url)
    return f"""CASE WHEN regexp_extract({target}, '^[A-Za-z][A-Za-z0-9+.-]*://', 0) <> '' THEN {target}
        WHEN substr({target}, 1, 2) = '//' THEN 'http:' || {target}
        WHEN substr({target}, 1, 1) = '/' THEN 'http://' || {host} || {target}
        WHEN {target} = '' OR substr({target}, 1, 1) = '#' THEN {url}
        WHEN substr({target}, 1, 1) = '?' THEN 'http://' || {host} || {path} || {target}
        ELSE 'http://' || {host} || CASE WHEN {path} = '' THEN '/' ELSE regexp_extract({path}, '(?s)^(.*/)', 1) END || {target} END"""


def target_sql(tag: str, like: str) -> str:
    """The alias that a tag names, or null."""
    return f"""replace(trim(CASE WHEN {like}({tag}, '{CANONICAL}') THEN regexp_extract({tag}, '{HREF}', 1)
        WHEN {like}({tag}, '{REFRESH}') THEN nullif(regexp_extract({tag}, '{REFRESH_URL}', 1), '') END), '&amp;', '&')"""


def _spark(sql: str) -> str:
    """A quote within a string is written with a backslash in Spark and doubled in SQL."""
    return sql.replace('"\'\'', '"\\\'')


def parse_rule(action: str, rule: str) -> tuple[str, str, str, str]:
    """(rule, host, path, action) of a rule written as host and path together."""
    host, slash, rest = rule.partition("/")
    return rule, host, slash + rest, action


def with_rule(rows: DataFrame, rules: list[tuple[str, str]], host: str = "host", path: str = "path") -> DataFrame:
    """``rows`` with the longest fitting ``rule`` and its ``action``, else nulls.

    A rule fits its host and all subdomains, if the path starts with the rule's.  Equally long ones: the one with
    the longer host, then allow before block.
    """
    known = [parse_rule(a, r) for a, r in rules]
    order = sorted(known, key=lambda r: (-len(r[0]), -len(r[1]), r[3]))
    if len(order) <= INLINE_RULES:
        found: Column | None = None
        for rule, rule_host, rule_path, action in order:
            own = ((F.col(host) == rule_host) | F.col(host).endswith("." + rule_host)) & F.col(path).startswith(rule_path)
            value = F.struct(F.lit(rule).alias("rule"), F.lit(action).alias("action"))
            found = F.when(own, value) if found is None else found.when(own, value)
        found = F.lit(None).cast("struct<rule:string,action:string>") if found is None else found
        return rows.withColumn("_found", found).withColumns({"rule": F.col("_found.rule"), "action": F.col("_found.action")}).drop("_found")
    spark = rows.sparkSession
    table = spark.createDataFrame([(i, *r) for i, r in enumerate(order)], "_place int, rule string, _host string, _path string, action string")
    # Each distinct host and path meets the rules of its own host and of each parent.
    pairs = rows.select(host, path).distinct()
    labels = F.split(F.col(host), r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    met = pairs.withColumn("_host", F.explode(parents)).join(table, "_host").where(F.col(path).startswith(F.col("_path")))
    best = met.groupBy(host, path).agg(F.min_by(F.struct("rule", "action"), "_place").alias("_found"))
    return rows.join(best, [host, path], "left").withColumns({"rule": F.col("_found.rule"), "action": F.col("_found.action")}).drop("_found")


def alias_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(a, b): nodes of a page and of what its canonical link or refresh names."""
    low = F.lower(F.col(html_col))
    tagged = pages.where(low.contains("canonical") | low.contains("http-equiv")).where(F.col(url_col).contains("://"))
    tags = tagged.select(F.col(url_col).alias("u"), F.explode(F.regexp_extract_all(F.col(html_col), F.lit(TAGS), F.lit(0))).alias("tag"))
    named = tags.select("u", F.expr(_spark(target_sql("tag", "regexp_like"))).alias("t")).where("t IS NOT NULL")
    full = named.select("u", F.expr(resolve_sql("t", "u")).alias("t"))
    return full.select(F.expr(node_sql("u")).alias("a"), F.expr(node_sql("t")).alias("b")).where("a <> b")


def judge(pages: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, host, path, rule and verdict of every page.

    A page's own rule decides.  A page without one is blocked if its component has a blocked member and no
    member that a rule explicitly allows; otherwise it is allowed.  Members are the pages and what their
    canonical links and refreshes name.  Null urls, and those without ``://``, have empty host and path and no
    aliases; null html names nothing.  Repeated rows are judged alike.
    """
    groups = components(alias_edges(pages, url_col, html_col))
    roots = groups.select(F.col("component").alias("node"), "component").distinct()
    members = groups.unionByName(roots).withColumns(
        {"host": F.regexp_extract("node", r"^([^/?#]*)", 1), "path": F.regexp_extract("node", r"^[^/?#]*([^?#]*)", 1)}
    )
    ruled = checkpoint(with_rule(members, rules).select("node", "component", "action"))
    blocked = ruled.groupBy("component").agg(F.max((F.col("action") == "block").cast("int")).alias("b"), F.max((F.col("action") == "allow").cast("int")).alias("a"))
    blocked = blocked.where("b = 1 AND coalesce(a, 0) = 0").select("component")
    aliases = ruled.join(blocked, "component").select("node", F.lit("block").alias("alias"))
    own = pages.select(
        F.col(id_col).alias("page_id"),
        F.expr(host_sql(f"`{url_col}`")).alias("host"),
        F.expr(path_sql(f"`{url_col}`")).alias("path"),
        F.when(F.col(url_col).contains("://"), F.expr(node_sql(f"`{url_col}`"))).alias("node"),
    )
    return with_rule(own, rules).join(aliases, "node", "left").select("page_id", "host", "path", "rule", F.coalesce("action", "alias", F.lit("allow")).alias("verdict"))
