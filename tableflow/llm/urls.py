"""URL filters: block and allow rules, carried over to the other addresses of a page.

A rule names a host (with all its subdomains) and the start of a path; of the rules that fit a url, the longest
decides. Urls joined by redirects or canonical links are aliases of one page: connected components
over these links, worked out by joins, hand the decision on to the urls that no rule fits. Allow goes first: a rule
that fits a url is never overruled, and aliases of which a rule allows one are allowed, also if another is blocked.
Without any decision a url is allowed.

A link is a canonical link or a refresh (a redirect written in the page) found in the html outside comments and scripts,
or a row of the table ``redirects`` (``source``, ``target``), as a crawler's log has them. Urls are told apart by their text without
the fragment, with scheme and host in lower case. A target is made absolute against the url of its page; dots in paths stay.

Only urls with a link enter the components; the table of rules is broadcast after a count, else joined by host.

* Host and path of a null url, or of one without ``://``, are empty, and no rule fits them; links of such pages
  count only if the url is not null and the target is absolute.
* Null or empty html has no links. Links to itself or to nowhere are none.
* Equal urls have equal verdicts. Repeated rows stay, one row each. An empty table gives no rows.
* Of equally long rules that fit, allow goes first, then the order of host and path.
* No other columns than key, url and html are read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tableflow.llm.graph import components
from tableflow.llm.store import stored

ALLOW, BLOCK = "allow", "block"

Rule = tuple[str, str, str]

# Rules up to which their table is sent to every executor.
BROADCAST_ROWS = 100_000

UNREAD = r"(?is)<!--.*?-->|<script\b.*?</script\s*>"
CANONICAL = r"""(?is)<link\b[^>]*\brel\s*=\s*["']?[^"'>]*\bcanonical\b[^>]*>"""
REFRESH = r"""(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?\s*refresh\b[^>]*>"""
HREF = r"""(?is)\bhref\s*=\s*(?:"\s*([^"]*)|'\s*([^']*)|([^\s"'>]+))"""
REFRESH_URL = r"""(?is)\bcontent\s*=\s*["']?\s*[\d.]*\s*[;,]\s*url\s*=\s*["']?\s*([^"'>]+)"""
SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"

HOST = r"(?s)^.*?://([^/?#]*)"
PATH = r"(?s)^.*?://[^/?#]*([^?#]*)"
ORIGIN = r"(?s)^(.*?://[^/?#]*)"

CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(text: Column) -> Column:
    return F.translate(text, CAPITALS, SMALL)


def host(url: Column) -> Column:
    """From the first ``://`` up to a slash, question mark, hash or the end, in lower case; else empty."""
    return F.coalesce(lowered(F.regexp_extract(url, HOST, 1)), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PATH, 1), F.lit(""))


def node(url: Column) -> Column:
    """A url as its aliases are told apart: no fragment, scheme and host in lower case."""
    origin = F.regexp_extract(url, ORIGIN, 1)
    return F.concat(lowered(origin), F.regexp_replace(F.substr(url, F.length(origin) + 1), r"(?s)#.*$", ""))


def absolute(target: Column, base: Column) -> Column:
    """``target`` as a page at ``base`` means it; null where it has no meaning."""
    origin = F.regexp_extract(base, ORIGIN, 1)
    folder = F.regexp_extract(F.regexp_extract(base, PATH, 1), r"(?s)^(.*/)", 1)
    placed = (
        F.when(target.startswith("//"), F.concat(F.regexp_extract(base, r"^([^:]*:)", 1), target))
        .when(target.startswith("/"), F.concat(origin, target))
        .when(target.startswith("?"), F.concat(origin, path(base), target))
        .otherwise(F.concat(origin, F.when(folder == "", "/").otherwise(folder), target))
    )
    return (
        F.when((target == "") | target.startswith("#"), None)
        .when(target.contains("://") & target.rlike(SCHEME), target)
        .when(target.rlike(SCHEME) | (origin == ""), None)
        .otherwise(placed)
    )


def page_links(html: Column) -> Column:
    """The targets of canonical links and refreshes, as they are written."""
    seen = F.when(F.contains(F.lower(html), F.lit("canonical")) | F.contains(F.lower(html), F.lit("refresh")), html)
    seen = F.regexp_replace(F.coalesce(seen, F.lit("")), UNREAD, " ")
    # A pattern with three places for the value: quoted, in single quotes, bare.
    href = lambda tag: F.concat(*[F.regexp_extract(tag, HREF, i) for i in (1, 2, 3)])
    canonical = F.transform(F.regexp_extract_all(seen, F.lit(CANONICAL), F.lit(0)), href)
    refresh = F.transform(F.regexp_extract_all(seen, F.lit(REFRESH), F.lit(0)), lambda tag: F.regexp_extract(tag, REFRESH_URL, 1))
    return F.transform(F.concat(canonical, refresh), lambda x: F.replace(F.trim(x), F.lit("&amp;"), F.lit("&")))


def table_of(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    """Rules as a table."""
    names = ("rule_host", "rule_path", "rule_verdict")
    rows = [F.struct(*[F.lit(x).alias(n) for n, x in zip(names, rule)]) for rule in rules or [("", "", "")]]
    return spark.range(1 if rules else 0).select(F.inline(F.array(*rows)))


def decided(urls: DataFrame, rules: Sequence[Rule] | DataFrame) -> DataFrame:
    """``urls`` (``node``, one row each) with ``rule`` and ``decision`` of the longest rule that fits; null if none does."""
    if not isinstance(rules, DataFrame):
        rules = table_of(urls.sparkSession, rules)
    rules = rules.select("rule_host", "rule_path", "rule_verdict")
    if rules.count() <= BROADCAST_ROWS:
        rules = F.broadcast(rules)
    labels = F.split(host(F.col("node")), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    asked = urls.select("node", path(F.col("node")).alias("path"), F.explode(suffixes).alias("suffix")).where("suffix <> ''")
    fits = (F.col("suffix") == F.col("rule_host")) & F.col("path").startswith(F.col("rule_path"))
    text = F.concat("rule_host", "rule_path")
    # The smallest is the longest, then allow, then the first by text.
    order = F.struct((-F.length(text)).alias("size"), F.col("rule_verdict").alias("decision"), text.alias("rule"))
    best = asked.join(rules, fits).groupBy(F.col("node").alias("fit_node")).agg(F.min(order).alias("best"))
    joined = urls.join(best, F.col("node") == F.col("fit_node"), "left")
    return joined.select("node", F.col("best.rule").alias("rule"), F.col("best.decision").alias("decision"))


def passed_on(links: DataFrame, decisions: DataFrame) -> DataFrame:
    """``alias`` and ``passed``: what the rules say about a url or, if nothing, about its aliases; one row per url with a link."""
    roots = stored(components(links), "aliases")
    known = roots.join(decisions.select(F.col("node").alias("ruled"), "decision"), F.col("node") == F.col("ruled"), "left")
    # In order of the alphabet, allow goes before block.
    classes = known.groupBy(F.col("root").alias("class")).agg(F.min("decision").alias("passed"))
    return roots.join(classes, F.col("root") == F.col("class")).select(F.col("node").alias("alias"), "passed")


def judged(
    pages: DataFrame,
    rules: Sequence[Rule] | DataFrame,
    redirects: DataFrame | None = None,
    key: str = "page_id",
    url: str = "url",
    html: str = "html",
) -> DataFrame:
    """``key``, ``host``, ``path``, ``rule`` (null if none fits) and ``verdict``, one row per page.

    ``rules`` are (host, path, verdict), as a list or a table (``rule_host``, ``rule_path``, ``rule_verdict``).
    The html is read once; afterwards only urls and links are.
    """
    read = stored(
        pages.select(
            F.col(key).alias("id"),
            F.col(url).alias("url"),
            node(F.col(url)).alias("node"),
            F.transform(page_links(F.col(html)), lambda x: node(absolute(x, F.col(url)))).alias("targets"),
        ),
        "urls",
    )
    links = read.select("node", F.explode("targets").alias("target"))
    if redirects is not None:
        links = links.unionByName(redirects.select(node(F.col("source")).alias("node"), node(F.col("target")).alias("target")))
    links = stored(links.where("node <> target").distinct(), "alias-links")
    nodes = read.select("node").union(links.select("node")).union(links.select("target")).where("node is not null").distinct()
    decisions = stored(decided(nodes, rules), "decisions")
    passed = passed_on(links, decisions)
    found = decisions.join(passed, F.col("node") == F.col("alias"), "left").select(
        F.col("node").alias("known"), "rule", F.coalesce("decision", "passed", F.lit(ALLOW)).alias("verdict")
    )
    # A hot url has many pages and one row here.
    rows = read.join(found, F.col("node") == F.col("known"), "left")
    return rows.select(
        F.col("id").alias(key),
        host(F.col("url")).alias("host"),
        path(F.col("url")).alias("path"),
        "rule",
        F.coalesce("verdict", F.lit(ALLOW)).alias("verdict"),
    )
