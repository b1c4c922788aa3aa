"""URL rules whose block decisions reach the aliases of a page."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import components
from tidemark.session import materialize

#: (verdict, host, path): a rule holds for its host and all subdomains where the path starts with the rule's.
Rule = tuple[str, str, str]
RULES: tuple[Rule, ...] = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without ``://``."""
    after = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    return F.translate(F.regexp_extract(after, r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_place(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """Place in ``rules`` of the longest rule that fits, or null. Of equally long ones the first wins."""
    order = sorted(range(len(rules)), key=lambda k: -len(rules[k][1] + rules[k][2]))
    tests = [F.when(((host == rules[k][1]) | host.endswith("." + rules[k][1])) & path.startswith(rules[k][2]), F.lit(k)) for k in order]
    return F.coalesce(*tests) if tests else F.lit(None).cast("int")


#: What hides tags, the tags themselves, and their attributes; a value stands in double, single or no quotes.
HIDDEN = r"(?is)<!--.*?-->|<(script|style)\b.*?</(script|style)\s*>"
TAGS = r"(?i)<(?:link|meta)\b[^>]*>"
CANONICAL = (r"""(?i)^<link\b[^>]*\srel\s*=\s*(?:"(?:[^"]*\s)?canonical(?:\s[^"]*)?"|'(?:[^']*\s)?canonical(?:\s[^']*)?'|canonical[\s/>])""")
REFRESH = r"""(?i)^<meta\b[^>]*\shttp-equiv\s*=\s*["']?refresh["'\s/>]"""
HREF = r"""(?i)\shref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
CONTENT = r"""(?i)\scontent\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
MOVED = r"""(?i)\burl\s*=\s*["']?([^"']*)"""
WEB, SCHEME = r"(?i)^https?://", r"^[A-Za-z][A-Za-z0-9+.\-]*:"


def _value(tag: Column, pattern: str) -> Column:
    return F.concat(*[F.regexp_extract(tag, pattern, k) for k in (1, 2, 3)])


def targets_of(html: Column) -> Column:
    """Where a page says it really is: ``href`` of links whose ``rel`` names canonical, and the address of refresh redirects.

    Comments, scripts and styles are left out first; ``&amp;`` is decoded and outer blanks go.
    """
    tags = F.regexp_extract_all(F.regexp_replace(F.coalesce(html, F.lit("")), HIDDEN, ""), F.lit(TAGS), F.lit(0))
    links = F.transform(F.filter(tags, lambda t: t.rlike(CANONICAL)), lambda t: _value(t, HREF))
    moves = F.transform(F.filter(tags, lambda t: t.rlike(REFRESH)), lambda t: F.regexp_extract(_value(t, CONTENT), MOVED, 1))
    found = F.transform(F.concat(links, moves), lambda u: F.trim(F.replace(u, F.lit("&amp;"), F.lit("&"))))
    return F.filter(found, lambda u: u != "")


def without_dots(path: Column) -> Column:
    """A path without ``.`` and ``..`` segments; none leads above the root."""
    parts = F.split(path, "/")
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda done, x: F.when(x == ".", done).when(
        x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.least(F.size(done), F.lit(1))))).otherwise(F.concat(done, F.array(x))))
    last = F.element_at(parts, -1)
    ended = F.concat(F.array_join(kept, "/"), F.when(last.isin(".", "..") , "/").otherwise(""))
    return F.when(F.contains(path, F.lit("/.")), ended).otherwise(path)


def absolute(target: Column, url: Column) -> Column:
    """A target as the page at ``url`` means it, after the rules for relative references.

    Web addresses stand for themselves, other schemes (mail, scripts) are no
    addresses and give null. An empty path (only a query or fragment) keeps the
    path of the page; others start at the host's root or beside the page.
    """
    host, path = host_of(url), path_of(url)
    folder = F.regexp_extract(path, r"(?s)^(.*/)", 1)
    base = F.concat(F.lit("http://"), host)
    return (F.when(target.rlike(WEB), target).when(target.rlike(SCHEME), F.lit(None)).when(target.startswith("//"), F.concat(F.lit("http:"), target))
            .when(target.rlike("^[?#]") | (target == ""), F.concat(base, path)).when(target.startswith("/"), F.concat(base, target))
            .otherwise(F.concat(base, F.when(folder == "", "/").otherwise(folder), target)))


def judge(pages: DataFrame, rules: Sequence[Rule] = RULES, redirects: DataFrame | None = None,
          id_col: str = "page_id", url_col: str = "url", html_col: str | None = "html") -> DataFrame:
    """page_id, host, path, rule and verdict of every page.

    A page's own rule decides. Pages without one inherit: canonical links,
    refresh redirects and the optional table ``redirects (source, target)``
    connect addresses (host and path; scheme, query and fragment tell no pages
    apart), and in each connected component an explicit allow of any address
    comes before an explicit block of any; a component without either is allowed.

    Only addresses that a link touches take part in the components. A null url or
    one without ``://`` has empty host and path, no rule and no links, and is
    allowed. Repeated rows are judged each; other columns are not read.
    """
    page = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), *([F.col(html_col).alias("html")] if html_col else []))
    said = []
    if html_col:
        found = page.select("url", F.explode(targets_of(F.col("html"))).alias("target"))
        said.append(found.select("url", absolute(F.col("target"), F.col("url")).alias("target")))
    if redirects is not None:
        said.append(redirects.select(F.col("source").alias("url"), absolute(F.col("target"), F.col("source")).alias("target")))
    address = lambda u: F.struct(host_of(u).alias("host"), path_of(u).alias("path"))
    longest = rule_place(F.col("host"), F.col("path"), rules)
    shown = page.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).withColumn("_rule", longest)
    inherited = F.lit(None).cast("string")
    if said:
        every = said[0] if len(said) == 1 else said[0].unionByName(said[1])
        # A target's dots are resolved; a page's own address stays as it is, which its row is found by.
        place = F.struct(host_of(F.col("target")).alias("host"), without_dots(path_of(F.col("target"))).alias("path"))
        edges = every.filter("target is not null").select(address(F.col("url")).alias("a"), place.alias("b")).filter("a.host <> '' and b.host <> '' and a <> b")
        parts = components(edges, "a", "b").select(F.col("node.host").alias("host"), F.col("node.path").alias("path"), "label")
        ruled = parts.withColumn("_rule", longest)
        kind = F.get(F.array(*[F.lit(r[0]) for r in rules]), F.col("_rule"))
        # "allow" comes before "block", so the smallest explicit verdict has precedence.
        verdicts = materialize(ruled.groupBy("label").agg(F.min(kind).alias("_inherited")).filter("_inherited is not null"), "verdicts")
        aliases = materialize(parts.join(verdicts, "label").select("host", "path", "_inherited"), "aliases")
        shown = shown.join(aliases, ["host", "path"], "left")
        inherited = F.col("_inherited")
    names, kinds = [F.array(*[F.lit(x) for x in xs]) for xs in ([r[1] + r[2] for r in rules], [r[0] for r in rules])]
    return shown.select("page_id", "host", "path", F.get(names, F.col("_rule")).alias("rule"),
                        F.coalesce(F.get(kinds, F.col("_rule")), inherited, F.lit("allow")).alias("verdict"))
