"""URL filters with redirect equivalence.

A url's host and path are held against (host, path) rules: a rule fits its host and all its subdomains where the path
starts with the rule's, and the longest rule that fits decides. A few rules become one expression; any number, from a
table, meet the urls in equi joins on the hosts' suffixes and the paths' beginnings.

Urls that name one page form classes: connected components over alias edges (a url and its plain form, without www./m.,
fragment, tracking parameters, closing slash or .html), canonical links and immediate redirects that the pages declare,
and any further edges given. A page without a rule of its own gets its class's decision: allow if any member is allowed
by a rule (allow has precedence), else block if any is blocked, else allow. alias_class is the class's smallest url.

Defined results: a null url, or one without ://, has empty host and path, no rule, no class, and is allowed. Repeated
rows are judged alike. Of equally long rules that fit, one that allows wins, then the greater name. DataFrame
operations only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, scratch, table
from .components import components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: So many rules are compiled into one expression at most; more are joined.
IN_LINE = 200


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)

_CANONICAL = r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*\bhref\s*=\s*["']?([^"'\s>]+)"""
_REFRESH = r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*\bcontent\s*=\s*["']?\s*\d*\s*;\s*url\s*=\s*["']?([^"'\s>]+)"""
_TRACKING = r"(?i)(^|&)(utm_[^=&]*|ref|gclid|fbclid|msclkid|sessionid)(=[^&]*)?(?=&|$)"


def host_of(url: Column) -> Column:
    return F.when(url.contains("://"), F.translate(F.regexp_extract(_after(url), r"^[^/?#]*", 0), UPPER, LOWER)).otherwise("")


def path_of(url: Column) -> Column:
    return F.when(url.contains("://"), F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def _after(url: Column) -> Column:
    return F.substring(url, F.instr(url, "://") + 3, F.length(url))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """The longest rule that fits, as struct(rule, verdict); null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.name), r.verdict == "allow", r.name)):
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def rules_by_join(places: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, r) of the places (host, path) that a rule of the table (verdict, host, path) fits: the longest, as rule_of().

    A host is cut into suffixes of as many labels as rules have, a path into beginnings as long as the paths of the
    rules of that suffix; both are looked up in equi joins.
    """
    most = rules.agg(F.max(F.size(F.split("host", r"\."))).alias("n")).first().n or 0
    named = rules.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), "verdict")
    sizes = named.groupBy("rule_host").agg(F.collect_set(F.length("rule_path")).alias("sizes"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(max(most, 1)))), lambda k: F.array_join(F.slice(labels, -k, k), "."))
    hosts = places.select("host").distinct().select("host", F.explode(suffixes).alias("rule_host")).join(sizes, "rule_host")
    cut = places.distinct().join(hosts, "host").select("host", "path", "rule_host", F.explode(F.filter("sizes", lambda k: k <= F.length("path"))).alias("k"))
    fits = cut.withColumn("rule_path", F.left("path", F.col("k"))).join(named, ["rule_host", "rule_path"])
    name = F.concat("rule_host", "rule_path")
    best = F.max(F.struct(F.length(name).alias("size"), (F.col("verdict") == "allow").alias("allows"), name.alias("rule"), "verdict"))
    return fits.groupBy("host", "path").agg(best.alias("b")).select("host", "path", F.struct("b.rule", "b.verdict").alias("r"))


def url_node(url: Column) -> Column:
    """host, path and query of a url: its scheme and fragment aside; null if it is none."""
    query = F.regexp_extract(_after(url), r"^[^?#]*(\?[^#]*)", 1)
    return F.when(url.contains("://"), F.concat(host_of(url), path_of(url), query))


def plain_node(url: Column) -> Column:
    """The plain form of url_node(): what urls of one page have in common."""
    query = F.regexp_replace(F.regexp_replace(F.regexp_extract(_after(url), r"^[^?#]*\?([^#]*)", 1), _TRACKING, ""), "^&", "")
    key = F.concat(F.regexp_replace(host_of(url), r"^(www|m)\.", ""), F.regexp_replace(path_of(url), r"(/|\.html?)$", ""), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(url.contains("://"), key)


def resolve(link: Column, url: Column) -> Column:
    """A link of the page at url as an absolute url."""
    link = F.replace(F.trim(link), F.lit("&amp;"), F.lit("&"))
    base = F.concat(F.lit("x://"), host_of(url))
    return (
        F.when(link == "", None)
        .when(link.contains("://"), link)
        .when(link.startswith("//"), F.concat(F.lit("x:"), link))
        .when(link.startswith("/"), F.concat(base, link))
        .when(link.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), None)
        .otherwise(F.concat(base, F.regexp_extract(path_of(url), "^(.*/)?", 0), link))
    )


def declared_links(pages: DataFrame) -> DataFrame:
    """(url, target) of the canonical link and the immediate redirect in each page's html."""
    found = F.array(*(resolve(F.regexp_extract("html", p, 1), F.col("url")) for p in (_CANONICAL, _REFRESH)))
    return pages.where("url is not null and html is not null").select("url", F.explode(found).alias("target")).where("target is not null")


def judge(pages: DataFrame, rules: tuple[Rule, ...] | DataFrame = RULES, links: DataFrame | None = None) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, alias_class.

    rules: a tuple, or a table (verdict, host, path); links: further (url, target) edges.
    """
    spark, url = pages.sparkSession, F.col("url")
    with scratch(spark):
        rows = pages.select("page_id", F.coalesce(host_of(url), F.lit("")).alias("host"), F.coalesce(path_of(url), F.lit("")).alias("path"), url_node(url).alias("node"), plain_node(url).alias("plain"))
        if isinstance(rules, tuple) and len(rules) > IN_LINE:
            rules = spark.createDataFrame([(r.verdict, r.host, r.path) for r in rules], "verdict string, host string, path string")
        if isinstance(rules, tuple):
            rows = rows.withColumn("r", rule_of(F.col("host"), F.col("path"), rules))
        else:
            rows = materialise(rows, "url-places")
            rows = rows.join(materialise(rules_by_join(rows.select("host", "path"), rules), "url-rules"), ["host", "path"], "left")
        rows = materialise(rows.select("page_id", "host", "path", "node", "plain", F.col("r.rule").alias("rule"), F.col("r.verdict").alias("verdict")), "url-rows", keep=True)
        declared = declared_links(pages)
        if links is not None:
            declared = declared.unionByName(links.select("url", "target"))
        declared = materialise(declared, "url-links")
        ends = declared.select("url").unionByName(declared.select(F.col("target").alias("url")))
        edges = rows.select(F.col("node").alias("a"), F.col("plain").alias("b"))
        edges = edges.unionByName(ends.select(url_node(url).alias("a"), plain_node(url).alias("b")))
        edges = edges.unionByName(declared.select(url_node(url).alias("a"), url_node(F.col("target")).alias("b")))
        roots = components(edges)
        classes = roots.groupBy("root").agg(F.min("node").alias("alias_class"))
        roots = materialise(roots.join(classes, "root").select("node", "alias_class"), "url-classes", keep=True)
        decided = rows.where("rule is not null").groupBy("node").agg(F.max(F.col("verdict") == "allow").alias("allowed"))
        by_class = decided.join(roots, "node", "left").groupBy(F.coalesce("alias_class", "node").alias("alias_class")).agg(F.max("allowed").alias("allowed"))
        by_class = materialise(by_class, "url-decisions", keep=True)
    rows = rows.join(roots, "node", "left").withColumn("alias_class", F.coalesce("alias_class", "node"))
    own = rows.where("rule is not null").select("page_id", "host", "path", "rule", "verdict", "alias_class")
    other = rows.where("rule is null").join(by_class, "alias_class", "left")
    by_method = F.when(~F.coalesce("allowed", F.lit(True)), "block").otherwise("allow").alias("verdict")
    return own.unionByName(other.select("page_id", "host", "path", "rule", by_method, "alias_class"))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


#: The tables' pages declare no canonical links or redirects, so the edges here are the aliases.
OP9_SQL = r"""
WITH RECURSIVE a AS (
  SELECT page_id, url,
    CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest,
    coalesce(contains(url, '://'), false) AS good
  FROM pages
), b AS (
  SELECT page_id, good, coalesce(translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path,
    regexp_extract(rest, '^[^?#]*(\?[^#]*)', 1) AS query
  FROM a
), q AS (
  SELECT *, array_to_string(list_filter(string_split(substr(query, 2), '&'),
      lambda x: NOT regexp_matches(x, '^(?i)(utm_[^=&]*|ref|gclid|fbclid|msclkid|sessionid)(=.*)?$')), '&') AS kept FROM b
), c AS (
  SELECT page_id, host, path,
    CASE WHEN good THEN host || path || query END AS node,
    CASE WHEN good THEN regexp_replace(host, '^(www|m)\.', '') || regexp_replace(path, '(/|\.html?)$', '') || CASE WHEN kept <> '' THEN '?' || kept ELSE '' END END AS plain,
    CASE WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
         WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
         WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
         WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
         WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM q
), d AS (
  SELECT *, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS own FROM c
), e AS (
  SELECT node AS a, plain AS b FROM d WHERE node <> plain UNION SELECT plain, node FROM d WHERE node <> plain
), r AS (
  SELECT DISTINCT a, a AS b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a
), k AS (
  SELECT a AS node, min(b) AS alias_class FROM r GROUP BY a
), f AS (
  SELECT d.*, coalesce(k.alias_class, d.node) AS alias_class FROM d LEFT JOIN k ON d.node = k.node
), g AS (
  SELECT alias_class, bool_or(own = 'allow') AS allowed FROM f WHERE own IS NOT NULL GROUP BY alias_class
)
SELECT f.page_id, f.host, f.path, f.rule, f.alias_class,
  coalesce(f.own, CASE WHEN g.allowed = false THEN 'block' ELSE 'allow' END) AS verdict
FROM f LEFT JOIN g ON f.alias_class = g.alias_class
"""
