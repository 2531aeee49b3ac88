"""URL filter with redirect equivalence.

Host and path rules decide a url by the longest rule that fits it. Urls that redirect to one another
or name one another as canonical (``<meta http-equiv="refresh">`` and ``<link rel="canonical">``)
are one page under several names: the components of that graph are found over the whole table, and
a block of any name, page or mere link target, goes to all names without a rule of their own. A
name's own rule takes precedence, so an explicit allow stays allowed in a blocked component.

Nodes of the graph are host, path and query; scheme, fragment and the host's case make no other
page. Only urls with such a link take part, so the graph is as large as the links, not the table.

Nulls, ties, repeats: a null url, or one without ``://``, has an empty host and path, fits no rule
and takes part in no component: it is allowed. Null html has no links. Repeated urls are one node;
every row is judged. A link to itself is none. No two rules of equal length fit one url. No rows
give no rows. Other columns are not read.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogops.llm.components import connected_components
from catalogops.llm.registry import query, table


class Rule(NamedTuple):
    """``host`` and its subdomains, where the path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return f"{self.host}{self.path}"


RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    found = F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)
    return F.coalesce(found, F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null; rules are few and constant."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (len(r.host) + len(r.path), r.text)):
        fits = ((host == rule.host) | host.endswith(f".{rule.host}")) & path.startswith(rule.path)
        out = F.when(fits, F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(out)
    return out


def node_of(url: Column) -> Column:
    """The url without scheme and fragment, the host lower-cased; null without ``://``."""
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    rest = F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))
    return F.when(url.contains("://"), F.concat(host_of(url), rest))


def link_targets(html: Column) -> Column:
    """The addresses that a page's canonical links and refreshes name, as they stand."""
    tags = F.regexp_extract_all(html, F.lit(r"(?is)<(?:link|meta)\s[^>]*>"), F.lit(0))

    def target(tag: Column) -> Column:
        href = F.regexp_extract(tag, r"""(?is)\shref\s*=\s*["']?\s*([^"'\s>]+)""", 1)
        refresh = F.regexp_extract(tag, r"""(?is)\scontent\s*=\s*["']?\s*[\d.]*\s*[;,]\s*url\s*=\s*["']?\s*([^"'\s>]+)""", 1)
        return (
            F.when(tag.rlike(r"""(?is)^<link\s.*\brel\s*=\s*["']?\s*canonical\b"""), href)
            .when(tag.rlike(r"""(?is)^<meta\s.*\bhttp-equiv\s*=\s*["']?\s*refresh\b"""), refresh)
            .otherwise(F.lit(""))
        )

    return F.filter(F.transform(tags, target), lambda x: x != "")


def resolved(target: Column, url: Column) -> Column:
    """The whole address of a link found on ``url``."""
    target = F.replace(target, F.lit("&amp;"), F.lit("&"))
    origin = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*(?:/[^?#]*)?/)", 1)
    folder = F.when(folder == "", F.concat(origin, F.lit("/"))).otherwise(folder)
    return (
        F.when(target.contains("://"), target)
        .when(target.startswith("//"), F.concat(F.lit("http:"), target))
        .when(target.startswith("/"), F.concat(origin, target))
        .when(target.startswith("?"), F.concat(F.regexp_extract(url, r"(?s)^([^?#]*)", 1), target))
        .when(target.startswith("#"), url)
        .otherwise(F.concat(folder, target))
    )


def equivalences(pages: DataFrame) -> DataFrame:
    """(a, b) of url nodes that a redirect or canonical link makes one."""
    linked = pages.where(F.col("url").contains("://") & F.col("html").rlike(r"(?i)<(?:link|meta)\s[^>]*(?:canonical|refresh)"))
    found = linked.select("url", F.explode(link_targets(F.col("html"))).alias("target"))
    edges = found.select(node_of(F.col("url")).alias("a"), node_of(resolved(F.col("target"), F.col("url"))).alias("b"))
    return edges.where("a <> b").distinct()


def judge(pages: DataFrame, links: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """page_id, url, host, path, rule, verdict of every row; ``links`` adds (a, b) urls known to redirect."""
    edges = equivalences(pages)
    if links is not None:
        edges = edges.union(links.select(node_of(F.col("a")).alias("a"), node_of(F.col("b")).alias("b")).where("a <> b"))
    names = connected_components(edges)
    full = F.concat(F.lit("http://"), F.col("node"))
    ruled = names.withColumn("verdict", rule_of(host_of(full), path_of(full), rules)["verdict"])
    blocked = ruled.groupBy("root").agg(F.max(F.col("verdict") == "block").alias("blocked")).where("blocked")
    # Only names that take a block and have no rule: repeats of a name are one row here.
    aliases = ruled.where("verdict IS NULL").join(blocked, "root").select("node", "blocked")
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rows = pages.select("page_id", "url", host.alias("host"), path.alias("path"), node_of(F.col("url")).alias("node"))
    rows = rows.withColumn("own", rule_of(F.col("host"), F.col("path"), rules)).join(aliases, "node", "left")
    verdict = F.coalesce(F.col("own.verdict"), F.when(F.col("blocked"), "block"), F.lit("allow"))
    return rows.select("page_id", "url", "host", "path", F.col("own.rule").alias("rule"), verdict.alias("verdict"))


def _oracle(rules: tuple[Rule, ...] = RULES) -> str:
    """The whole judgement for DuckDB, the components by recursion over the links."""
    host = lambda u: rf"translate(regexp_extract({u}, '^.*?://([^/?#]*)', 1, 's'), '{_UPPER}', '{_LOWER}')"
    path = lambda u: rf"regexp_extract({u}, '^.*?://[^/?#]*([^?#]*)', 1, 's')"
    rest = lambda u: rf"regexp_extract({u}, '^.*?://[^/?#]*([^#]*)', 1, 's')"
    node = lambda u: f"CASE WHEN contains({u}, '://') THEN {host(u)} || CASE WHEN starts_with({rest(u)}, '/') THEN {rest(u)} ELSE '/' || {rest(u)} END END"

    def ruled(h: str, p: str, what: str) -> str:
        longest = sorted(rules, key=lambda r: -len(r.text))
        arms = " ".join(
            f"WHEN ({h} = '{r.host}' OR ends_with({h}, '.{r.host}')) AND starts_with({p}, '{r.path}') THEN '{r.text if what == 'rule' else r.verdict}'" for r in longest
        )
        return f"CASE {arms} END"

    return f"""
WITH RECURSIVE tags AS (
  SELECT url, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\\s[^>]*>')) AS tag FROM pages WHERE contains(url, '://')),
targets AS (
  SELECT url, replace(CASE
    WHEN regexp_matches(tag, '(?is)^<link\\s.*\\brel\\s*=\\s*["'']?\\s*canonical\\b') THEN regexp_extract(tag, '(?is)\\shref\\s*=\\s*["'']?\\s*([^"''\\s>]+)', 1)
    WHEN regexp_matches(tag, '(?is)^<meta\\s.*\\bhttp-equiv\\s*=\\s*["'']?\\s*refresh\\b') THEN regexp_extract(tag, '(?is)\\scontent\\s*=\\s*["'']?\\s*[0-9.]*\\s*[;,]\\s*url\\s*=\\s*["'']?\\s*([^"''\\s>]+)', 1)
    ELSE '' END, '&amp;', '&') AS t FROM tags),
whole AS (
  SELECT url, CASE WHEN contains(t, '://') THEN t WHEN starts_with(t, '//') THEN 'http:' || t
    WHEN starts_with(t, '/') THEN regexp_extract(url, '^(.*?://[^/?#]*)', 1) || t
    WHEN starts_with(t, '?') THEN regexp_extract(url, '^([^?#]*)', 1) || t WHEN starts_with(t, '#') THEN url
    WHEN regexp_extract(url, '^(.*?://[^/?#]*(?:/[^?#]*)?/)', 1) = '' THEN regexp_extract(url, '^(.*?://[^/?#]*)', 1) || '/' || t
    ELSE regexp_extract(url, '^(.*?://[^/?#]*(?:/[^?#]*)?/)', 1) || t END AS u FROM targets WHERE t <> ''),
edges AS (SELECT {node('url')} AS a, {node('u')} AS b FROM whole),
both_ways AS (SELECT a, b FROM edges WHERE a <> b UNION SELECT b, a FROM edges WHERE a <> b),
reach AS (SELECT a AS node, b AS other FROM both_ways UNION SELECT r.node, e.b FROM reach r JOIN both_ways e ON r.other = e.a),
blocked AS (
  SELECT DISTINCT node FROM reach WHERE {ruled(host("('http://' || other)"), path("('http://' || other)"), 'verdict')} = 'block'),
judged AS (
  SELECT page_id, coalesce({host('url')}, '') AS host, coalesce({path('url')}, '') AS path, {node('url')} AS node FROM pages)
SELECT page_id, host, path, {ruled('host', 'path', 'rule')} AS rule,
  coalesce({ruled('host', 'path', 'verdict')}, CASE WHEN node IN (SELECT node FROM blocked) THEN 'block' END, 'allow') AS verdict
FROM judged"""


@query("op6_redirect_url_filter", _oracle())
def op6_redirect_url_filter(spark, sf_dir):
    """Every page's rule and verdict."""
    return judge(table(spark, sf_dir, "pages").select("page_id", "url", "html")).drop("url")
