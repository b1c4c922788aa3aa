"""Lines that a site repeats on most of its pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import SPACE
from tidemark.llm.urlfilter import host_of
from tidemark.session import materialize

#: A line on more than this share of a host's pages is boilerplate; hosts of fewer pages have none.
RATIO, LEAST_PAGES = 0.3, 4
#: Looser pair for lines that a host repeats on some of its pages only: a share, and pages that hold the line at least.
LOOSE_RATIO, LOOSE_SEEN = 0.05, 4


#: Parts of a page that hold no text, tags that end a line, and entities with their signs.
UNSEEN = r"(?is)<(script|style)\b.*?</(script|style)\s*>|<!--.*?-->"
BLOCK_TAGS = (r"(?i)</?(address|article|aside|blockquote|body|br|dd|div|dl|dt|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|p|pre"
              r"|section|table|td|th|title|tr|ul)\b[^>]*>")
ENTITIES = (("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&"))


def html_lines(html: Column) -> Column:
    """Lines of text of a raw page: scripts, styles and comments go, block tags end lines, other tags vanish."""
    text = F.regexp_replace(F.coalesce(html, F.lit("")), UNSEEN, "")
    text = F.regexp_replace(F.regexp_replace(text, BLOCK_TAGS, "\n"), r"<[^>]*>", "")
    for entity, sign in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(sign))
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, r"[\x20\x09-\x0D]+", " "))), lambda x: x != "")


def drop_site_lines(pages: DataFrame, ratio: float = RATIO, least_pages: int = LEAST_PAGES, id_col: str = "page_id",
                    host: Column | None = None, lines: Column | None = None, least_seen: int = 1) -> DataFrame:
    """page_id, host, lines, dropped_lines, text (lines that stay) of every page.

    For each host the pages that hold a line, counted once a page, are divided
    by the pages of the host; lines above ``ratio`` go from every page of it.
    Counts are summed before the shuffle, so a line or a host that a third of
    all rows share costs a row for each task. A host keeps at most its mean
    number of lines a page over ``ratio`` such lines, whatever its size, so a
    host's list is small; pages and lists are joined as plain scans, which
    adaptive execution splits on a large host.

    The default ratio is strict: it finds what a site shows on most pages and
    leaves lines that rotate. A low ratio (``LOOSE_RATIO``) finds those too, with
    ``least_seen`` pages that must hold a line (``LOOSE_SEEN``), since on a host of
    few pages every line is above a low ratio.

    Lines are compared without outer and doubled white space. Pages without a
    host (null url) count as one host; repeated rows count as pages of their own.
    """
    host = host_of(F.col("url")) if host is None else host
    lines = html_lines(F.col("html")) if lines is None else lines
    rows = materialize(pages.select(F.col(id_col).alias("page_id"), F.coalesce(host, F.lit("")).alias("host"), lines.alias("_lines")), "lines")
    totals = rows.groupBy("host").agg(F.count(F.lit(1)).alias("_pages"))
    seen = rows.select("host", F.explode(F.array_distinct("_lines")).alias("_line")).groupBy("host", "_line").agg(F.count(F.lit(1)).alias("_n"))
    # A line of fewer pages cannot be common on any host of enough pages; most lines go here, before hosts meet.
    seen = seen.filter((F.col("_n") > ratio * least_pages) & (F.col("_n") >= least_seen))
    seen, totals = materialize(seen, "seen"), materialize(totals, "totals")
    common = seen.join(totals, "host").filter((F.col("_pages") >= least_pages) & (F.col("_n") > ratio * F.col("_pages")))
    lists = materialize(common.groupBy("host").agg(F.collect_list("_line").alias("_common")), "common")
    judged = rows.join(lists, "host", "left").withColumn("_kept", F.when(F.col("_common").isNull(), F.col("_lines")).otherwise(
        F.filter("_lines", lambda x: ~F.array_contains("_common", x))))
    return judged.select("page_id", "host", F.size("_lines").cast("long").alias("lines"), (F.size("_lines") - F.size("_kept")).cast("long").alias("dropped_lines"),
                         F.array_join("_kept", "\n").alias("text"))
