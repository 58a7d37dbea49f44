"""URL rules, carried over redirects and canonical links; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, table
from .components import connected_components

#: (verdict, host, path); a fixed value of the contract.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Where a page names the address it stands for, or sends its reader to.
LINK = r"""(?is)<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*>"""
HREF = r"""(?is)\bhref\s*=\s*["']?([^"'\s>]+)"""
META = r"""(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>"""
TO = r"""(?is)\burl\s*=\s*["']?([^"'\s>;]+)"""


def parts(df: DataFrame, url: str = "url") -> DataFrame:
    """df with host, path and node of the address in column `url`.

    host: from the first :// up to / ? # or the end, A-Z lower-cased; path: then up to ? or #; both
    empty for null or without ://. node: what two addresses of one resource share, namely host, path
    and query; null without a host.
    """
    after = lambda rest: F.coalesce(F.regexp_extract(url, rf"(?s)^.*?://{rest}", 1), F.lit(""))
    df = df.withColumn("host", F.translate(after("([^/?#]*)"), UPPER, LOWER)).withColumn("path", after("[^/?#]*([^?#]*)"))
    return df.withColumn("node", F.when(F.col("host") != "", F.concat("host", after("[^/?#]*([^#]*)"))))


def _fits(rule: Column, of_host: Column, of_path: Column) -> Column:
    return ((of_host == rule["host"]) | F.endswith(of_host, F.concat(F.lit("."), rule["host"]))) & F.startswith(of_path, rule["path"])


def best_rule(of_host: Column, of_path: Column, rules=RULES, most: int = 10_000) -> Column:
    """struct(name, verdict) of the longest rule that fits (of equally long ones an allow), else null.

    The rules stand in the plan as an array; over `most` of them are refused with a ValueError.
    """
    if len(rules) > most:
        raise ValueError(f"more than {most} rules")
    order = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "allow", r))
    listed = F.array(*(F.struct(F.lit(h + p).alias("name"), F.lit(v).alias("verdict"), F.lit(h).alias("host"), F.lit(p).alias("path")) for v, h, p in order))
    return F.get(F.filter(listed, lambda r: _fits(r, of_host, of_path)), F.lit(0))


def _absolute(to: Column) -> Column:
    """The target of a link found on a page with columns host and path: absolute, or of the same host, or beside it."""
    base = F.concat(F.lit("x://"), F.col("host"))
    beside = F.regexp_extract("path", r"(?s)^(.*/)", 1)
    return (
        F.when(to.contains("://"), to).when(to.startswith("//"), F.concat(F.lit("x:"), to)).when(to.startswith("/"), F.concat(base, to))
        .when(F.col("host") != "", F.concat(base, F.when(beside == "", F.lit("/")).otherwise(beside), to))
    )


def page_links(pages: DataFrame) -> DataFrame:
    """(a, b): nodes of each page and of its canonical address and redirect target, where it has them."""
    found = F.array(F.regexp_extract(F.regexp_extract("html", LINK, 0), HREF, 1), F.regexp_extract(F.regexp_extract("html", META, 0), TO, 1))
    each = pages.select("url", F.explode(found).alias("to")).where("to <> ''").withColumn("to", F.replace("to", F.lit("&amp;"), F.lit("&")))
    return _nodes(parts(each).select(F.col("node").alias("a"), _absolute(F.col("to")).alias("to")))


def _nodes(links: DataFrame) -> DataFrame:
    pairs = materialize(parts(links, "to").select("a", F.col("node").alias("b")), "links")  # else Catalyst writes the filter out to the very URLs
    return pairs.where("a is not null and b is not null and a <> b")


def judge(pages: DataFrame, redirects: DataFrame | None = None, rules=RULES) -> DataFrame:
    """Verdict on every row of pages: page_id, host, path, rule, verdict, aliases_say.

    pages: page_id, url, html; redirects, if given: from_url, to_url. Other columns are ignored.
    Addresses linked by redirects or canonical links, directly or through others, are aliases. A
    page's own rule decides (an explicit allow is never overruled). Else its aliases do: allow
    if a rule allows any of them, block if a rule blocks any, also of those that are not pages
    themselves; else allow. aliases_say is null where no alias has a rule.
    A null url, or one without ://, has empty host and path, no rule and no alias, and is allowed.
    Null html holds no link. Repeated rows each give a row; an empty table gives an empty result.
    """
    links = page_links(pages)
    if redirects is not None:
        links = links.unionByName(_nodes(parts(redirects.select("from_url", F.col("to_url").alias("to")), "from_url").select(F.col("node").alias("a"), "to")))
    labels = connected_components(links)
    ruled = parts(labels.select("component", F.concat(F.lit("x://"), F.col("node")).alias("url")))
    ruled = ruled.withColumn("verdict", best_rule(F.col("host"), F.col("path"), rules)["verdict"])
    of = ruled.groupBy("component").agg(F.max(F.col("verdict") == "allow").alias("allowed"), F.max(F.col("verdict") == "block").alias("blocked"))
    said = F.when(F.col("allowed"), F.lit("allow")).when(F.col("blocked"), F.lit("block"))
    decisions = labels.join(of.select("component", said.alias("aliases_say")), "component").where("aliases_say is not null").select("node", "aliases_say")
    decisions = materialize(decisions, "alias-decisions")
    own = parts(pages.select("page_id", "url")).withColumn("best", best_rule(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce(F.col("best.verdict"), F.col("aliases_say"), F.lit("allow"))
    return own.join(decisions, "node", "left").select("page_id", "host", "path", F.col("best.name").alias("rule"), verdict.alias("verdict"), "aliases_say")


def op8_url_filter(spark, sf_dir: str) -> DataFrame:
    """Verdicts on the urls of all pages; see the functions above."""
    return judge(table(spark, sf_dir, "pages"))


def _sql() -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    rest = lambda u: f"case when instr({u}, '://') > 0 then substr({u}, instr({u}, '://') + 3) else '' end"
    of_host = lambda u: f"translate(regexp_extract({rest(u)}, '^[^/?#]*'), '{UPPER}', '{LOWER}')"
    of_path = lambda u: f"regexp_extract({rest(u)}, '^[^/?#]*([^?#]*)', 1)"
    of_node = lambda u: f"case when {of_host(u)} <> '' then {of_host(u)} || regexp_extract({rest(u)}, '^[^/?#]*([^#]*)', 1) end"
    order = sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r[0] != "allow", r))
    fit = lambda h, p, r: f"(({h} = {q(r[1])} or suffix({h}, {q('.' + r[1])})) and prefix({p}, {q(r[2])}))"
    pick = lambda h, p, i: "case " + " ".join(f"when {fit(h, p, r)} then {q((r[1] + r[2], r[0])[i])}" for r in order) + " end"
    return f"""
with recursive own as (select page_id, {of_host("url")} as host, {of_path("url")} as path, {of_node("url")} as node, url, html from pages),
found as (select url, host, path, node, regexp_extract(regexp_extract(html, {q(LINK)}), {q(HREF)}, 1) as t from own
  union all select url, host, path, node, regexp_extract(regexp_extract(html, {q(META)}), {q(TO)}, 1) from own),
targets as (select node, host, path, replace(t, '&amp;', '&') as t from found where t <> ''),
absolute as (select node as a, case when contains(t, '://') then t when prefix(t, '//') then 'x:' || t when prefix(t, '/') then 'x://' || host || t
  when host <> '' then 'x://' || host || case when regexp_extract(path, '(?s)^(.*/)', 1) = '' then '/' else regexp_extract(path, '(?s)^(.*/)', 1) end || t end as u from targets),
links as (select a, {of_node("u")} as b from absolute),
edges as (select a, b from links where a is not null and b is not null and a <> b union select b, a from links where a is not null and b is not null and a <> b),
reach(a, b) as (select a, a from edges union select r.a, e.b from reach r join edges e on r.b = e.a),
ruled as (select a, {pick(of_host("'x://' || b"), of_path("'x://' || b"), 1)} as v from reach),
says as (select a as node, case when bool_or(v = 'allow') then 'allow' when bool_or(v = 'block') then 'block' end as aliases_say from ruled group by a)
select page_id, host, path, {pick("host", "path", 0)} as rule, coalesce({pick("host", "path", 1)}, aliases_say, 'allow') as verdict, aliases_say
from own left join says using (node)
"""


SQL = _sql()
