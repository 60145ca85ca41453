"""URL filter with redirect equivalence.

Rules name a host and a path prefix; the longest that fits decides. What no rule decides inherits a block
from its aliases: pages tied by redirects or canonical links form components (distributed, over edge tables
only), and a component with a blocked address is blocked, except where an explicit allow rule fits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline.llm.common import SPACE, let, literal_table, lower_ascii
from kerbline.llm.components import components
from kerbline.scratch import Scratch

#: The contract's rules.
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]

#: Patterns that the SQL counterpart reads too, so without anything that only one of the two engines has.
_NOISE = r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)"
_CANONICAL = r"""(?is)^<link\b.*[\s"'/]rel\s*=\s*(?:"[^"]*\bcanonical\b|'[^']*\bcanonical\b|canonical\b)"""
_REFRESH = r"""(?is)^<meta\b.*[\s"'/]http-equiv\s*=\s*["']?\s*refresh\b"""
_VALUE = r"""(?is)[\s"'/]{}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
_URL = r"""(?is)\burl\s*=\s*["']?([^"']*)"""
_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"
#: A tag's parts are runs without quotes, and quoted values, which may hold ``>``; no part is tried in two ways.
_TAG = r"""(?is)<(?:link|meta)\b(?:[^<>"']++|"[^"<]*+"|'[^'<]*+'|["']){0,500}+>"""
#: Character references by name that occur in addresses.
NAMED = [("amp;", "&"), ("quot;", '"'), ("apos;", "'"), ("lt;", "<"), ("gt;", ">")]


def host(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)://([^/?#]*)", 1), F.lit("")))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)://[^/?#]*([^?#]*)", 1), F.lit(""))


def address(url: Column) -> Column:
    """Digest that names an address whatever its scheme and fragment; null where there is no host."""
    query = F.regexp_extract(url, r"(?s)://[^?#]*(\?[^#]*)", 1)
    return F.when(host(url) != "", F.unhex(F.md5(F.concat(host(url), path(url), query))))


def rule_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """``verdict, rule, rule_host, rule_path`` of rules like ``("block", "example.com/de/")``."""
    t = literal_table(spark, rules, "verdict string, rule string")
    at = F.instr("rule", "/")
    return t.select("verdict", "rule", F.expr("substring_index(rule, '/', 1)").alias("rule_host"), F.when(at > 0, F.expr("substring(rule, instr(rule, '/'))")).otherwise("").alias("rule_path"))


def match(places: DataFrame, rules: DataFrame) -> DataFrame:
    """``host, path, rule, verdict``: the longest rule for each distinct place that any rule fits.

    Two hash joins, whatever the number of rules: host suffixes meet the rules' hosts, then path prefixes of
    just the lengths in use there meet the rules' paths. Equal length: allow wins.
    """
    suffix = F.expr("explode(transform(sequence(1, size(labels)), i -> array_join(slice(labels, i, size(labels)), '.')))")
    p = places.where("host <> ''").distinct().withColumn("labels", F.split("host", "[.]")).select("host", "path", suffix.alias("suffix"))
    lengths = rules.groupBy("rule_host").agg(F.collect_set(F.length("rule_path")).alias("lengths"))
    p = p.join(lengths, p.suffix == lengths.rule_host).select("host", "path", "suffix", F.explode("lengths").alias("n")).where("n <= length(path)")
    p = p.select("host", "path", "suffix", F.expr("substring(path, 1, n)").alias("prefix"))
    hit = p.join(rules, (p.suffix == rules.rule_host) & (p.prefix == rules.rule_path))
    best = F.max(F.struct(F.length("rule").alias("n"), (F.col("verdict") == "allow").alias("allow"), "rule", "verdict"))
    return hit.groupBy("host", "path").agg(best.alias("b")).select("host", "path", "b.rule", "b.verdict")


def _attribute(tag: Column, name: str) -> Column:
    return F.btrim(F.concat(*[F.regexp_extract(tag, _VALUE.format(name), k) for k in (1, 2, 3)]), F.lit(SPACE))


def unescape(text: Column) -> Column:
    """Character references decoded once: numbers, decimal or hexadecimal, and the names of ``NAMED``; others stay."""

    def decoded(part: Column) -> Column:
        hexed, plain = F.regexp_extract(part, "^#[xX]([0-9a-fA-F]{1,6});", 1), F.regexp_extract(part, "^#([0-9]{1,7});", 1)
        code = F.when(hexed != "", F.conv(hexed, 16, 10)).when(plain != "", plain).cast("long")
        valid = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        out = F.when(valid, F.concat(F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"), F.regexp_replace(part, "^[^;]*;", "")))
        for name, char in NAMED:
            out = out.when(part.startswith(name), F.concat(F.lit(char), F.substring(part, len(name) + 1, 1 << 30)))
        return out.otherwise(F.concat(F.lit("&"), part))

    split = lambda parts: F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(F.slice(parts, F.lit(2), F.size(parts)), decoded), ""))
    return F.when(text.contains("&"), let(F.split(text, "&"), split)).otherwise(text)


def _without_dots(path: Column) -> Column:
    """A path without its segments ``.`` and ``..``."""
    walk = F.aggregate(F.slice(F.split(path, "/"), F.lit(2), F.size(F.split(path, "/"))), F.lit(""), lambda done, part: (
        F.when(part == "..", F.regexp_replace(done, "/[^/]*$", "")).when(part == ".", done).otherwise(F.concat(done, F.lit("/"), part))
    ))
    return F.when(path.contains("/."), F.concat(walk, F.when(path.rlike(r"/\.\.?$"), "/").otherwise(""))).otherwise(path)


def resolved(base: Column, target: Column) -> Column:
    """The address that ``target`` names on the page ``base``; null where it names the page itself or none with a host."""
    scheme, authority = F.regexp_extract(base, r"(?s)^(.*?)://", 1), F.regexp_extract(base, r"(?s)://([^/?#]*)", 1)
    folder = F.regexp_replace(path(base), "[^/]*$", "")
    rest = F.regexp_extract(target, r"(?s)^[^?#]*(.*)$", 1)
    own = F.regexp_extract(target, r"(?s)^([^?#]*)", 1)
    full = F.when(own == "", path(base)).when(own.startswith("/"), _without_dots(own)).otherwise(_without_dots(F.concat(F.when(folder == "", "/").otherwise(folder), own)))
    return (
        F.when(target.rlike(_SCHEME + "//"), target)
        .when((target == "") | target.startswith("#") | target.rlike(_SCHEME) | ~base.contains("://"), None)
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .otherwise(F.concat(scheme, F.lit("://"), authority, full, rest))
    )


def page_links(pages: DataFrame) -> DataFrame:
    """``from_url, to_url`` of all canonical links and refresh redirects in the pages' html.

    Tags inside comments, scripts and styles are none; nor are those of over 500 parts. Character references are
    decoded, and relative targets resolved against the page's url; a ``base`` element is not read. Addresses without a host
    (``mailto:``) and a page's links to itself are left out.
    """
    html = F.coalesce("html", F.lit(""))
    # most pages have neither tag; the cheap test spares them the searches
    seen = pages.where(F.lower(html).rlike("canonical|http-equiv") & F.col("url").isNotNull())
    tags = seen.select(F.col("url").alias("from_url"), F.explode(F.regexp_extract_all(F.regexp_replace(html, _NOISE, " "), F.lit(_TAG), F.lit(0))).alias("tag"))
    refresh = F.btrim(F.regexp_extract(unescape(_attribute(F.col("tag"), "content")), _URL, 1), F.lit(SPACE))
    to = F.when(F.col("tag").rlike(_CANONICAL), unescape(_attribute(F.col("tag"), "href"))).when(F.col("tag").rlike(_REFRESH), refresh)
    found = tags.select("from_url", to.alias("to")).where("to is not null")
    return found.select("from_url", resolved(F.col("from_url"), F.col("to")).alias("to_url")).where("to_url is not null")


def judge(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None, scratch: Scratch | None = None) -> DataFrame:
    """``page_id, host, path, rule, verdict`` for each row of ``pages`` (page_id, url, html).

    ``redirects``: further edges ``from_url, to_url``, such as a crawler's redirect log. No rows: an empty table. A null url, or one
    without ``://``, has an empty host and path, meets no rule and is allowed. Repeated rows get the same
    verdict; repeated edges and loops change nothing; other columns are not read.
    """
    scratch = scratch or Scratch(pages.sparkSession, "urls")
    links = page_links(pages)
    if redirects is not None:
        links = links.unionByName(redirects.select("from_url", "to_url"))
    ends = lambda c: (address(F.col(c)), host(F.col(c)), path(F.col(c)))
    a, b = ends("from_url"), ends("to_url")
    links = links.select(a[0].alias("a"), a[1].alias("a_host"), a[2].alias("a_path"), b[0].alias("b"), b[1].alias("b_host"), b[2].alias("b_path")).where("a <> b").distinct()
    links, found = scratch.keep(links, "links")
    p = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), address(F.col("url")).alias("address"))
    places = p.select("host", "path")
    if not found["rows"]:
        ruled = match(places, rules).alias("r")
        j = p.alias("p").join(ruled, (F.col("p.host") == F.col("r.host")) & (F.col("p.path") == F.col("r.path")), "left")
        return j.select("page_id", "p.host", "p.path", "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"))
    nodes = links.select(F.col("a").alias("node"), F.col("a_host").alias("host"), F.col("a_path").alias("path")).union(links.select("b", "b_host", "b_path")).distinct()
    ruled = scratch.table(match(places.union(nodes.select("host", "path")), rules), "ruled")
    blocked = components(links, scratch).join(nodes.join(ruled.where("verdict = 'block'"), ["host", "path"], "left"), "node").groupBy("label", "node").agg(F.max("verdict").alias("verdict"))
    blocked = scratch.table(blocked, "members")
    bad = blocked.where("verdict = 'block'").select("label").distinct()
    bad = blocked.join(bad, "label").select(F.col("node").alias("address"), F.lit("block").alias("inherited")).alias("i")
    j = p.alias("p").join(ruled.alias("r"), (F.col("p.host") == F.col("r.host")) & (F.col("p.path") == F.col("r.path")), "left").join(bad, F.col("p.address") == F.col("i.address"), "left")
    return j.select("page_id", "p.host", "p.path", "rule", F.coalesce("verdict", "inherited", F.lit("allow")).alias("verdict"))
