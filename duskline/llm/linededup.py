"""Site-relative line dedup: drop the lines that stand on too large a share of a host's pages.

For each host, the pages that contain a line are divided by the host's pages; a line above `ratio`, on at
least `least` pages, is boilerplate and is dropped from every page of that host. DataFrame functions only.

A host of many pages can have a lower bar as well: a line above the second share of `common`, on at least its number of
pages, is boilerplate too. On few pages a low share is chance, so that number is larger than `least`.

A line counts once for a page and is compared without the white space around it; blank lines are neither
counted nor dropped. As each page adds its lines once, a host has at most (lines a page) / (the lower share) boilerplate
lines, however many pages it has; so one short array for each host goes to its pages. It is broadcast if the
counted hashes of all hosts are few, else joined by host and a part of its pages, so that no host lands in one task.

Null hosts belong to no site and null texts have no lines; such rows stay as they are. Repeated rows are pages
of their own. Lines are compared by 64-bit hashes within a host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, release, settle, settled, shuffle_partitions

RATIO = 0.2
LEAST_PAGES = 3
#: Lower bar for documents of a source: share and least pages. It stands in the gap of the shares of documents that pass the
#: quality rules: one line from 0.087 (sf0.1) or 0.1 (check_s) up, all others up to 0.054 or 0.044.
COMMON = (0.06, 20)


def host_of(url: Column) -> Column:
    """Lower-cased host of a URL, without user and port; null if there is none."""
    found = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.when(found != "", found)


def html_lines(html: Column) -> Column:
    """Text lines of a page: what stands between tags, without scripts, styles and comments."""
    bare = F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->", "\n")
    lines = F.split(F.regexp_replace(bare, r"<[^>]*>", "\n"), "\n")
    return F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: x != "")


def _hash(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def boilerplate(df: DataFrame, ratio: float = RATIO, least: int = LEAST_PAGES, common: tuple[float, int] | None = None) -> DataFrame:
    """host, flagged: hashes of the boilerplate lines of the pages df (host, lines)."""
    distinct = F.array_distinct(F.transform(F.filter("lines", lambda x: F.trim(x) != ""), _hash))
    pages = settle(df.where("host is not null").select("host", distinct.alias("hashes")))  # pages are taken apart once for both counts
    counted = pages.select("host", F.explode("hashes").alias("line")).groupBy("host", "line").count().where(F.col("count") >= least)
    totals = pages.where("hashes is not null").groupBy("host").agg(F.count("*").alias("pages"))
    bar = F.col("count") > ratio * F.col("pages")
    if common:
        bar |= (F.col("count") > common[0] * F.col("pages")) & (F.col("count") >= common[1])
    over = counted.join(totals, "host").where(bar)
    return over.groupBy("host").agg(F.collect_list("line").alias("flagged"))


def drop_lines(df: DataFrame, ratio: float = RATIO, least: int = LEAST_PAGES, common: tuple[float, int] | None = None) -> DataFrame:
    """df (host, lines, ...) with a column `kept`: the lines that are no boilerplate of the host."""
    before = settled()
    flagged = settle(boilerplate(df, ratio, least, common))
    release(df.sparkSession, [x for x in settled()[:-1] if x not in before])
    held = flagged.agg(F.coalesce(F.sum(F.size("flagged")), F.lit(0))).first()[0]
    if held <= BROADCAST_ROWS:
        joined = df.join(F.broadcast(flagged), "host", "left")
    else:  # pages are dealt by a hash of their lines too, and a host's flagged lines go to each of its parts
        parts = shuffle_partitions(df.sparkSession)
        dealt = df.withColumn("__part", F.when(F.col("host").isNotNull(), F.pmod(F.xxhash64("lines"), F.lit(parts))))
        joined = dealt.join(flagged.withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))), ["host", "__part"], "left").drop("__part")
    kept = F.when(F.col("flagged").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x: (F.trim(x) == "") | ~F.array_contains("flagged", _hash(x))))
    return joined.withColumn("kept", kept).drop("flagged")


def clean_pages(pages: DataFrame, ratio: float = RATIO, least: int = LEAST_PAGES) -> DataFrame:
    """page_id, host, n_lines, n_dropped and the text that is left of every row of pages (page_id, url, html)."""
    lines = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"), html_lines(F.col("html")).alias("lines"))
    out = drop_lines(lines, ratio, least)
    n = F.coalesce(F.size("lines"), F.lit(0))
    n = F.when(F.col("lines").isNull(), F.lit(0)).otherwise(n)
    return out.select("page_id", "host", n.cast("long").alias("n_lines"), (n - F.when(F.col("kept").isNull(), F.lit(0)).otherwise(F.size("kept"))).cast("long").alias("n_dropped"), F.array_join("kept", "\n").alias("text"))


def clean_documents(df: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, least: int = LEAST_PAGES, common: tuple[float, int] | None = None) -> DataFrame:
    """df without the boilerplate lines of its hosts; all rows and columns stay."""
    names = df.columns
    packed = df.select(F.col(host).cast("string").alias("host"), F.split(F.col(text), "\n", -1).alias("lines"), F.struct(*[df[f"`{c}`"] for c in names]).alias("row"))
    out = drop_lines(packed, ratio, least, common)
    cleaned = F.when(F.size("kept") == F.size("lines"), F.col("row")[text]).otherwise(F.array_join("kept", "\n"))
    return out.select(*[cleaned.alias(c) if c == text else F.col("row")[c].alias(c) for c in names])


#: The same as clean_pages over the table pages, for DuckDB.
SQL = rf"""
with lined as (
  select row_number() over () as r, page_id,
    nullif(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '') as host,
    case when html is not null then list_filter(list_transform(string_split(regexp_replace(
      regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', chr(10), 'g'),
      '<[^>]*>', chr(10), 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '') end as lines
  from pages),
counted as (
  select host, line, count(*) as n from (select r, host, unnest(list_distinct(lines)) as line from lined where host is not null)
  group by all),
flagged as (
  select c.host, list(c.line) as gone from counted c
  join (select host, count(*) as pages from lined where host is not null and lines is not null group by host) t using (host)
  where c.n >= {LEAST_PAGES} and c.n > {RATIO} * t.pages group by c.host),
cleaned as (
  select l.*, list_filter(l.lines, lambda x: not list_contains(coalesce(f.gone, []), x)) as kept
  from lined l left join flagged f using (host))
select page_id, host, cast(coalesce(len(lines), 0) as bigint) as n_lines,
  cast(coalesce(len(lines) - len(kept), 0) as bigint) as n_dropped, array_to_string(kept, chr(10)) as text
from cleaned
"""
