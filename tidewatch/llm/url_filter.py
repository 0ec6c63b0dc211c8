"""URL filter with redirect equivalence: rules judge addresses, components carry decisions to aliases.

Addresses that a redirect or a canonical link joins are one thing under several
names. Rules (host, path prefix, allow or block) judge an address by the
longest rule that fits. Where none fits, the address takes its component's
decision: allow if any alias is allowed by a rule, else block if any is
blocked, else the default.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm._shared import materialise, remove
from tidewatch.llm.components import connected_components


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str = "/"

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    Rule("allow", "com"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)
DEFAULT = "allow"


def host_of(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What stands after the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """(text, verdict) of the longest rule that fits, null if none does: one CASE over the rule table, longest first."""
    found = None
    for r in sorted(rules, key=lambda r: (-len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        value = F.struct(F.lit(r.text).alias("text"), F.lit(r.verdict).alias("verdict"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return found if found is not None else F.lit(None).cast("struct<text:string,verdict:string>")


def node(url: Column) -> Column:
    """A key for an address: scheme and fragment left out, host lower-cased, hashed to 128 bits."""
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.md5(F.concat(host_of(url), F.when(rest == "", F.lit("/")).otherwise(rest)))


def resolved(to: Column, url: Column) -> Column:
    """``to`` as an address, resolved against the address ``url``; null for other schemes and for a bare fragment."""
    host = F.concat(F.lit("http://"), host_of(url))
    path = F.when(path_of(url) == "", "/").otherwise(path_of(url))
    folder = F.regexp_extract(path, r"(?s)^(.*/)", 1)
    local = F.when(to.startswith("/"), to).when(to.startswith("?"), F.concat(path, to)).otherwise(F.concat(folder, to))
    steps = F.split(F.regexp_extract(local, r"(?s)^/([^?#]*)", 1), "/")
    up = lambda done: F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
    left = F.aggregate(steps, F.array().cast("array<string>"), lambda done, x: F.when(x == "..", up(done)).when(x == ".", done).otherwise(F.array_append(done, x)))
    left = F.when(F.element_at(steps, -1).isin(".", ".."), F.array_append(left, F.lit(""))).otherwise(left)
    whole = F.concat(host, F.lit("/"), F.array_join(left, "/"), F.regexp_extract(local, r"(?s)([?#].*)$", 1))
    return F.when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), to).when(to.startswith("//"), F.concat(F.lit("http:"), to)).when(to.rlike(r"^(?:#|[A-Za-z][A-Za-z0-9+.-]*:)"), None).otherwise(whole)


#: Character references that addresses hold, & last.
ENTITIES = ((r"&(?i:quot|#34|#x22);", '"'), (r"&(?i:apos|#39|#x27);", "'"), (r"&(?i:#61|#x3d|equals);", "="), (r"&(?i:amp|#38|#x26);", "&"))


def attribute(tag: Column, name: str) -> Column:
    """The value of an attribute of a tag, in double, single or no quotes, blanks around it left out; empty if it has none."""
    found = F.regexp_extract(tag, rf"(?is)[\s\"'/]{name}\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", 1)
    value = F.trim(F.regexp_replace(found, r"^[\"']|[\"']$|[\t\r\n]", ""))
    for pattern, character in ENTITIES:
        value = F.regexp_replace(value, pattern, character)
    return value


def links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(a, b): each page's address and all that its markup redirects to or calls canonical, resolved against its base.

    The base is the page's address, or its first ``<base href>`` resolved
    against that. Attributes may stand in any order. Left out: tags with ``<``
    or ``>`` inside an attribute, character references other than those of
    quotes, ``=`` and ``&``, redirects by script, and schemes without ``://``.
    """
    tags = F.regexp_extract_all(F.col(html), F.lit(r"(?is)<(?:link|meta)\s[^<>]*>"), F.lit(0))
    base_tag = F.regexp_extract(F.col(html), r"(?is)<base\s[^<>]*>", 0)

    def target(tag: Column) -> Column:
        canonical = tag.rlike(r"(?i)^<link") & F.concat(F.lit(" "), F.lower(attribute(tag, "rel")), F.lit(" ")).contains(" canonical ")
        refresh = tag.rlike(r"(?i)^<meta") & (F.lower(attribute(tag, "http-equiv")) == "refresh")
        to = F.regexp_extract(attribute(tag, "content"), r"(?is)^[\d.\s]*[;,\s]\s*url\s*=\s*[\"']?\s*([^\"']+)", 1)
        return F.when(canonical, attribute(tag, "href")).when(refresh, F.trim(to))

    to = F.explode(F.filter(F.transform(tags, target), lambda x: x != ""))
    base = F.when(base_tag != "", F.nullif(attribute(base_tag, "href"), F.lit("")))
    named = pages.where(F.col(html).rlike(r"(?i)canonical|refresh") & F.col(url).contains("://")).select(F.col(url).alias("a"), base.alias("base"), to.alias("to"))
    named = named.withColumn("base", F.coalesce(resolved(F.col("base"), F.col("a")), "a"))
    return named.select("a", resolved(F.col("to"), F.col("base")).alias("b")).where("b IS NOT NULL")


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, redirects: DataFrame | None = None, default: str = DEFAULT, url: str = "url", html: str = "html", key: str = "page_id") -> DataFrame:
    """(key, host, path, rule, verdict) for each row of ``pages``; ``redirects`` may add (a, b) addresses.

    A null address, or one without ``://``, has an empty host and path, fits no
    rule, has no aliases and gets the default. Null markup has no links.
    Repeated rows are judged alike, an empty table gives an empty result, and
    columns not named here are ignored.
    """
    edges = links(pages, url, html)
    if redirects is not None:
        edges = edges.unionByName(redirects.select("a", "b"))
    edges, edges_path = materialise(edges.distinct(), "links")
    components = connected_components(edges.select(node(F.col("a")).alias("a"), node(F.col("b")).alias("b")))
    ends = edges.select(F.col("a").alias("url")).unionByName(edges.select(F.col("b").alias("url"))).distinct()
    own = ends.select(node(F.col("url")).alias("node"), matching_rule(host_of(F.col("url")), path_of(F.col("url")), rules)["verdict"].alias("own"))
    decided = (
        own.join(components, "node")
        .groupBy("component")
        .agg(F.max((F.col("own") == "allow").cast("int")).alias("allowed"), F.max((F.col("own") == "block").cast("int")).alias("blocked"))
        .withColumn("decision", F.when(F.col("allowed") == 1, "allow").when(F.col("blocked") == 1, "block").otherwise(default))
    )
    aliases, _ = materialise(components.join(decided, "component").select(F.col("node").alias("__node"), "decision"), "aliases")
    remove(pages.sparkSession, edges_path)
    host, path = host_of(F.col(url)), path_of(F.col(url))
    judged = pages.select(F.col(key).alias("__id"), host.alias("host"), path.alias("path"), node(F.when(F.col(url).contains("://"), F.col(url))).alias("__key"))
    judged = judged.withColumn("__rule", matching_rule(F.col("host"), F.col("path"), rules))
    judged = judged.join(aliases, F.col("__key") == F.col("__node"), "left")
    return judged.select(F.col("__id").alias(key), "host", "path", F.col("__rule")["text"].alias("rule"), F.coalesce(F.col("__rule")["verdict"], "decision", F.lit(default)).alias("verdict"))


def query(pages: DataFrame) -> DataFrame:
    return judge(pages.select("page_id", "url", "html"))


def _sql_case(host: str, path: str, field: str) -> str:
    rows = sorted(RULES, key=lambda r: (-len(r.text), r.text))
    return "CASE " + reduce(lambda a, r: a + f"WHEN ({host} = '{r.host}' OR ends_with({host}, '.{r.host}')) AND starts_with({path}, '{r.path}') THEN '{getattr(r, field)}' ", rows, "") + "END"


# Written apart from the operator: addresses are cut with split_part and instr, folders with string functions, dot segments by a fold over text.
SQL = rf"""
WITH RECURSIVE
cut(u, host, path, query) AS MATERIALIZED (
  SELECT u, translate(left(rest, h), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), left(substr(rest, h + 1), p), split_part(substr(rest, h + p + 1), '#', 1)
  FROM (SELECT u, rest, h, length(regexp_replace(substr(rest, h + 1), '(?s)[?#].*$', '')) AS p
        FROM (SELECT u, rest, length(regexp_replace(rest, '(?s)[/?#].*$', '')) AS h
              FROM (SELECT DISTINCT url AS u, substr(url, instr(url, '://') + 3) AS rest FROM pages WHERE instr(url, '://') > 0)))),
tags AS (SELECT url, html, unnest(regexp_extract_all(html, '(?i)<(?:link|meta)\s[^<>]*>')) AS tag FROM pages WHERE instr(url, '://') > 0),
attrs AS (SELECT url, tag, regexp_extract(html, '(?i)<base\s[^<>]*>') AS base_tag,
                 list_transform(['rel', 'href', 'http-equiv', 'content'], lambda n: regexp_extract(tag, '(?i)[\s"''/]' || n || '\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)', 1)) AS raw,
                 regexp_extract(regexp_extract(html, '(?i)<base\s[^<>]*>'), '(?i)[\s"''/]href\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)', 1) AS raw_base FROM tags),
clean AS (SELECT url, tag, list_transform(list_append(raw, raw_base), lambda v: replace(replace(replace(trim(regexp_replace(v, '^["'']|["'']$|[\t\r\n]', '', 'g')), '&#38;', '&'), '&quot;', '"'), '&amp;', '&')) AS v FROM attrs),
asked AS (SELECT url, v[5] AS base, CASE WHEN tag ILIKE '<link%' AND list_contains(string_split(lower(v[1]), ' '), 'canonical') THEN v[2]
                                         WHEN tag ILIKE '<meta%' AND lower(v[3]) = 'refresh' THEN trim(regexp_extract(v[4], '(?i)^[\d.\s]*[;,\s]\s*url\s*=\s*["'']?\s*([^"'']+)', 1)) END AS t FROM clean),
want AS (SELECT DISTINCT url, base, t FROM asked WHERE t <> ''),
-- twice the same step: the base against the page, the target against the base
step1 AS (SELECT w.url, w.t, CASE WHEN w.base = '' OR regexp_matches(w.base, '^(#|[A-Za-z][A-Za-z0-9+.-]*:)') AND NOT regexp_matches(w.base, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN 'http://' || c.host || c.path || c.query
                                  WHEN regexp_matches(w.base, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN w.base WHEN starts_with(w.base, '//') THEN 'http:' || w.base
                                  WHEN starts_with(w.base, '/') THEN 'http://' || c.host || w.base
                                  ELSE 'http://' || c.host || coalesce(nullif(regexp_extract(c.path, '(?s)^.*/'), ''), '/') || w.base END AS base FROM want w JOIN cut c ON c.u = w.url),
step2 AS (SELECT url, t, substr(base, instr(base, '://') + 3) AS rest FROM step1),
step3 AS (SELECT url, t, regexp_replace(rest, '(?s)[/?#].*$', '') AS h, regexp_replace(regexp_replace(rest, '(?s)[?#].*$', ''), '^[^/]*', '') AS p FROM step2),
joined AS (SELECT url, CASE WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN t WHEN starts_with(t, '//') THEN 'http:' || t
                            WHEN regexp_matches(t, '^(#|[A-Za-z][A-Za-z0-9+.-]*:)') THEN NULL
                            ELSE 'http://' || h || CASE WHEN starts_with(t, '/') THEN t WHEN starts_with(t, '?') THEN coalesce(nullif(p, ''), '/') || t
                                                       ELSE coalesce(nullif(regexp_extract(p, '(?s)^.*/'), ''), '/') || t END END AS b,
                  regexp_matches(t, '^([A-Za-z][A-Za-z0-9+.-]*:)?//') AS absolute FROM step3),
parted AS (SELECT url, b, absolute, translate(regexp_replace(substr(b, instr(b, '://') + 3), '(?s)[/?#].*$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS h,
                  regexp_replace(split_part(substr(b, instr(b, '://') + 3), '#', 1), '^[^/?]*', '') AS rest FROM joined WHERE b IS NOT NULL),
folded AS (SELECT url, h, absolute, rest, string_split(split_part(rest, '?', 1), '/') AS seg, CASE WHEN instr(rest, '?') > 0 THEN substr(rest, instr(rest, '?')) ELSE '' END AS q FROM parted),
dotted AS (SELECT url, h, CASE WHEN absolute THEN rest ELSE list_reduce(seg, lambda a, x: CASE WHEN x = '..' THEN regexp_replace(a, '/[^/]*$', '') WHEN x = '.' THEN a ELSE a || '/' || x END)
                                    || CASE WHEN seg[-1] IN ('.', '..') THEN '/' ELSE '' END || q END AS rest FROM folded),
ends AS (SELECT url, h AS host, regexp_replace(rest, '(?s)\?.*$', '') AS path, h || CASE WHEN rest = '' THEN '/' ELSE rest END AS m FROM dotted),
pg AS (SELECT u, host, path, host || CASE WHEN path || query = '' THEN '/' ELSE path || query END AS n FROM cut),
e AS (SELECT p.n, m FROM ends JOIN pg p ON p.u = url UNION SELECT m, p.n FROM ends JOIN pg p ON p.u = url),
own AS (SELECT n, {_sql_case('host', 'path', 'verdict')} AS v FROM pg WHERE n IN (SELECT n FROM e) UNION SELECT m, {_sql_case('host', 'path', 'verdict')} FROM ends),
reach AS (SELECT n, n AS m FROM e UNION SELECT r.n, e.m FROM reach r JOIN e ON r.m = e.n),
d AS (SELECT r.n, CASE WHEN bool_or(own.v = 'allow') THEN 'allow' WHEN bool_or(own.v = 'block') THEN 'block' ELSE '{DEFAULT}' END AS decision
      FROM reach r JOIN own ON own.n = r.m GROUP BY r.n)
SELECT page_id, coalesce(pg.host, '') AS host, coalesce(pg.path, '') AS path, {_sql_case("coalesce(pg.host, '')", "coalesce(pg.path, '')", 'text')} AS rule,
       coalesce({_sql_case("coalesce(pg.host, '')", "coalesce(pg.path, '')", 'verdict')}, d.decision, '{DEFAULT}') AS verdict
FROM pages LEFT JOIN pg ON pg.u = url LEFT JOIN d ON d.n = pg.n
"""
