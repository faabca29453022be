"""URL filters with redirect equivalence, in DataFrame operations only.

Rules name a host and a path prefix; a rule fits its host and all subdomains,
the longest fitting one wins.  URLs are nodes of a graph (scheme and fragment
dropped, host lowered, dot segments folded); every canonical link and every
refresh redirect of a page is an edge to its target, resolved against the page
(or its ``base`` tag) as RFC 3986 has it.  Connected components of that graph are found by
distributed rounds (see ``common.connected_components``); URLs that stand on
several pages are one node.  A page without a rule takes its component's
verdict: allow where any member has an allow rule (explicit allow comes
first), else block where any member has a block rule, else allow.

Defined results: a null url or one without ``://`` has empty host and path, no
rule and no node, and is allowed; a null html has no edges; repeated rows are
judged each; targets that are no page still connect pages; a target of another
scheme without ``://`` (``mailto:``) has no edge; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import Scratch, connected_components

#: (host, path, verdict) of the task, fixed values.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

# rel is a list of words, canonical is any of them
_LINK = r"""(?i)<link\s[^>]*rel\s*=\s*(?:"(?:[^">]*\s)?canonical(?:\s[^">]*)?"|'(?:[^'>]*\s)?canonical(?:\s[^'>]*)?'|canonical(?=[\s/>]))[^>]*>"""
_META = r"""(?i)<meta\s[^>]*http-equiv\s*=\s*["']?refresh["']?[^>]*>"""
_HREF = r"""(?i)href\s*=\s*["']?([^"'\s>]+)"""
_BASE = r"""(?i)<base\s[^>]*href\s*=\s*["']?([^"'\s>]+)"""
_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"
_TARGET = r"""(?i)url\s*=\s*['"]?([^"'\s>]+)"""


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _rest(url: Column) -> Column:
    """What follows the first ``://``, empty where there is none."""
    at = F.instr(F.coalesce(url, F.lit("")), "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return _lower(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of ``value``, which stands in the plan once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _folded(path: Column) -> Column:
    """A path without ``.`` and ``..`` segments."""
    nothing = F.array().cast("array<string>")

    def fold(parts: Column) -> Column:
        kept = F.aggregate(F.slice(parts, 2, F.size(parts)), nothing, lambda acc, s: F.when(s == ".", acc).when(
            s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s))))
        # a path that ends in a dot segment names a folder
        tail = F.when(F.element_at(parts, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(nothing)
        return F.concat(F.lit("/"), F.array_join(F.concat(kept, tail), "/"))
    return F.when(path.contains("/."), _let(F.split(path, "/"), fold)).otherwise(path)


def node_of(url: Column) -> Column:
    """Identity of a URL in the graph; null without host."""
    def node(rest: Column) -> Column:
        host = _lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))
        path = _let(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), _folded)
        return F.when(host != "", F.concat(host, path, F.regexp_extract(rest, r"^[^?#]*(\?[^#]*)", 1)))
    return _let(_rest(url), node)


def resolved(to: Column, url: Column) -> Column:
    """The target ``to`` of a page at ``url`` as a whole URL; null without a target."""
    def whole(to: Column, url: Column, site: Column, path: Column) -> Column:
        folder = F.regexp_replace(path, r"[^/]*$", "")
        return (F.when(to == "", None).when(to.rlike(_SCHEME + "//"), to).when(to.rlike(_SCHEME), None)
                .when(to.startswith("//"), F.concat(F.lit("http:"), to)).when(to.startswith("/"), F.concat(site, to))
                .when(to.startswith("#"), url).when(to.startswith("?"), F.concat(site, path, to))
                .otherwise(F.concat(site, F.when(folder == "", "/").otherwise(folder), to)))
    return _let(F.struct(to.alias("to"), url.alias("url"), F.concat(F.regexp_extract(url, r"^([^:]*://)", 1), host_of(url)).alias("site"),
                         path_of(url).alias("path")), lambda v: whole(v["to"], v["url"], v["site"], v["path"]))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null without one; of
    equally long ones the first by name."""
    rule = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):   # later ones win
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def edges_of(pages: DataFrame) -> DataFrame:
    """(a, b): a page's node and the nodes it declares itself an alias of."""
    def plain(c: Column) -> Column:
        return F.replace(c, F.lit("&amp;"), F.lit("&"))

    def targets(tag: str, value: str) -> Column:
        return F.transform(F.regexp_extract_all("html", F.lit(tag), F.lit(0)), lambda t: plain(F.regexp_extract(t, value, 1)))
    found = pages.select("url", plain(F.regexp_extract("html", _BASE, 1)).alias("base"),
                         F.explode(F.concat(targets(_LINK, _HREF), targets(_META, _TARGET))).alias("to"))
    whole = found.select("url", "to", F.coalesce(resolved(F.col("base"), F.col("url")), "url").alias("base"))
    return (whole.select(node_of(F.col("url")).alias("a"), node_of(resolved(F.col("to"), F.col("base"))).alias("b"))
            .where("a is not null and b is not null and a <> b").distinct())


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and component (null for a URL that
    no edge touches)."""
    scratch = Scratch(pages.sparkSession, "url-filters")
    edges = scratch.save(edges_of(pages.select("url", "html")), "edges")
    parts = connected_components(edges, scratch, "cc")
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"), node_of(F.col("url")).alias("node"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    urls = urls.select("page_id", "host", "path", "node", rule.alias("rule"), verdict.alias("own"))
    # nodes with a rule, also those that are targets only
    ends = parts.select("node", "component", F.regexp_extract("node", r"^([^/?]*)", 1).alias("h"), F.regexp_extract("node", r"^[^/?]*([^?]*)", 1).alias("p"))
    _, node_verdict = rule_of(F.col("h"), F.col("p"), rules)
    # partial sums meet per component, so a hot component is pre-aggregated
    spread = ends.groupBy("component").agg(F.bool_or(node_verdict == "allow").alias("allowed"), F.bool_or(node_verdict == "block").alias("blocked"))
    whole = parts.join(spread, "component").select("node", "component", F.when(F.col("allowed"), "allow").when(F.col("blocked"), "block").alias("shared"))
    return (urls.join(whole, "node", "left")
            .select("page_id", "host", "path", "rule", F.coalesce("own", "shared", F.lit("allow")).alias("verdict"), "component"))
