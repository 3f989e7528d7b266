"""Boards as sources: when they are due, which shard owns them, what their payloads list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Hours between polls by status.
CADENCE_HOURS = {"active": 3, "quiet": 48, "blocked": 6, "dead": 168}

#: Where a board's payload lists its postings, their id, link and, if any, the field that says it is listed.
LAYOUTS = {
    "greenhouse": ("$.jobs", "id", "absolute_url", None),
    "lever": ("$", "id", "hostedUrl", None),
    "ashby": ("$.jobs", "id", "jobUrl", "isListed"),
    "workable": ("$.jobs", "shortcode", "url", None),
    "recruitee": ("$.offers", "id", "careers_url", None),
    "smartrecruiters": ("$.content", "id", "ref", None),
    "himalayas": ("$.jobs", "guid", "applicationLink", None),
}


def due(status: Column, polled: Column, now: Column) -> Column:
    """Whether a board is to be polled; of those never polled only active ones."""
    out = (status == "active") & polled.isNull()
    for name, hours in CADENCE_HOURS.items():
        out = out | ((status == name) & (polled <= now - F.expr(f"make_dt_interval(0, {hours})")))
    return F.coalesce(out, F.lit(False))


def shard_of(board: Column, shards: int) -> Column:
    """Shard that owns a board."""
    return F.pmod(F.crc32(board.cast("string").cast("binary")), F.lit(shards)).cast("int")


def poll_status(http_status: Column, body: Column) -> Column:
    """What a response says of a board: dead, blocked, degraded (anything odd), empty or ok."""
    data = F.try_parse_json(body)
    return (
        F.when(http_status == 404, "dead").when(http_status.isin(403, 429), "blocked").when(http_status != 200, "degraded")
        .when(F.trim(body).startswith("<") | data.isNull(), "degraded").when(F.trim(body).isin("[]", '{"jobs":[]}'), "empty").otherwise("ok")
    )


def listed(polls: DataFrame, ats: str, body: str = "body") -> DataFrame:
    """``polls`` exploded to the postings their payloads list: source_id, url and the posting as ``job`` (variant). Payloads
    that are no JSON, and postings without an id or not listed, give none."""
    path, key, url, flag = LAYOUTS[ats]
    items = F.try_variant_get(F.try_parse_json(F.col(body)), path, "array<variant>")
    rows = polls.withColumn("job", F.explode(items))
    get = lambda name: F.try_variant_get("job", f"$.{name}", "string")
    rows = rows.withColumn("source_id", get(key)).withColumn("url", get(url)).where(F.col("source_id").isNotNull())
    return rows.where(F.coalesce(F.try_variant_get("job", f"$.{flag}", "boolean"), F.lit(True))) if flag else rows


def read_polls(polls: DataFrame, ats: str, body: str = "body", content_type: str | None = None) -> DataFrame:
    """``polls`` (with http_status) and what each response is: ``status`` (ok, empty, dead, blocked, degraded), ``postings`` (how many it
    lists with an id) and ``skipped`` (how many without). A payload of another shape, markup, an element that is no object, or
    postings of which none has an id are degraded; a list whose postings are all unlisted is empty."""
    path, key, _, flag = LAYOUTS[ats]
    own = polls.withColumn("_items", F.try_variant_get(F.try_parse_json(F.col(body)), path, "array<variant>"))
    shown = F.filter("_items", lambda v: F.coalesce(F.try_variant_get(v, f"$.{flag}", "boolean"), F.lit(True))) if flag else F.col("_items")
    has_id = lambda v: F.coalesce(F.try_variant_get(v, f"$.{key}", "string"), F.lit("")) != ""
    own = own.withColumn("postings", F.size(F.filter(shown, has_id))).withColumn("skipped", F.size(F.filter(shown, lambda v: ~has_id(v))))
    markup = F.ltrim(F.col(body)).startswith("<")
    if content_type:
        markup = markup | F.coalesce(F.lower(F.col(content_type)).contains("html"), F.lit(False))
    odd = F.col("_items").isNull() | F.exists("_items", lambda v: ~F.schema_of_variant(v).startswith("OBJECT"))
    status = (
        F.when(F.col("http_status") == 404, "dead").when(F.col("http_status").isin(403, 429), "blocked").when(~F.col("http_status").eqNullSafe(200) | F.coalesce(markup | odd, F.lit(True)), "degraded")
        .when(F.col("postings") > 0, "ok").when(F.col("skipped") > 0, "degraded").otherwise("empty")
    )
    sound = F.col("status") == "ok"
    return own.withColumn("status", status).withColumns({c: F.when(sound, F.col(c)).otherwise(0) for c in ("postings", "skipped")}).drop("_items")


#: Rows of a full page and pages that are read at most, of boards paged by offset; pages of an aggregator, and the
#: share of its stated total that a list must reach.
PAGE, MOST_PAGES, MOST_NUMBERED, LEAST_SHARE = 100, 15, 60, 0.8


def offset_chains(pages: DataFrame, board: str) -> DataFrame:
    """(board, status, n, total, holes, overlaps): whether the pages of one poll of a board, taken as intervals of rows from ``start``
    with ``size`` rows, cover its list. ``pages``: board, start, size, total (what the page says there is, or null), http_status.

    The first page's answer stands for the board if it is not 200; a later one's makes the poll degraded. So do a hole between
    pages, a last page that ends before the stated total or, without one, is full, and more than ``MOST_PAGES`` pages. Rows that
    two pages share count once. One window over a board's pages."""
    by = W.partitionBy(board).orderBy("start", F.desc("size"))
    end = F.when(F.col("http_status") == 200, F.col("start") + F.col("size"))
    before = F.coalesce(F.max("_end").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    own = pages.withColumn("_end", end).withColumn("_before", before)
    good = F.col("http_status") == 200
    own = own.withColumn("_new", F.when(good, F.greatest(F.col("_end") - F.greatest("start", "_before"), F.lit(0))).otherwise(0))
    place = F.col("start")
    found = own.groupBy(board).agg(
        F.min_by("http_status", place).alias("_first"), F.count_if(~F.col("http_status").eqNullSafe(200)).alias("_bad"), F.sum("_new").cast("long").alias("n"), F.min_by("total", F.when(F.col("total").isNotNull(), place)).cast("long").alias("total"),
        F.count_if(good & (F.col("start") > F.col("_before"))).alias("holes"), F.count_if(good & (F.col("start") < F.col("_before"))).alias("overlaps"), F.count("*").alias("_pages"), F.max_by("size", place).alias("_last"),
    )
    ended = F.when(F.col("total").isNotNull(), F.col("n") >= F.col("total")).otherwise(F.col("_last") < PAGE)
    whole = (F.col("_bad") == 0) & (F.col("holes") == 0) & ended & (F.col("_pages") <= MOST_PAGES)
    status = F.when(F.col("_first") == 404, "dead").when(F.col("_first").isin(403, 429), "blocked").when(~whole, "degraded").when(F.col("n") == 0, "empty").otherwise("ok")
    return found.select(board, status.alias("status"), "n", "total", "holes", "overlaps")


def numbered_chains(pages: DataFrame, board: str, ids: str) -> DataFrame:
    """(board, status, n, total, distinct): whether the numbered pages of one poll end. ``pages``: board, page (from 1), http_status,
    total, and ``ids`` (array, one entry per posting; null: no list). Pages count up to the first empty one, which ends the list; a
    missing page, none that is empty, more than ``MOST_NUMBERED``, an answer but 200, or less than ``LEAST_SHARE`` of the
    first stated total make the poll degraded. The total is an upper bound. ``distinct`` counts ids once, nulls not."""
    size = F.when(F.col("http_status") == 200, F.size(ids))
    own = pages.withColumn("_size", size).withColumn("_empty", F.min(F.when(F.col("_size") == 0, F.col("page"))).over(W.partitionBy(board)))
    own = own.where(F.col("_empty").isNull() | (F.col("page") <= F.col("_empty")))
    found = own.groupBy(board).agg(
        F.min_by("http_status", F.when(~F.col("http_status").eqNullSafe(200), F.col("page"))).alias("_bad"), F.count_if(F.col("_size").isNull() | (F.col("_size") < 0)).alias("_odd"), F.max("_empty").alias("_end"), F.countDistinct("page").alias("_pages"),
        F.coalesce(F.sum(F.when(F.col("_size") > 0, F.col("_size"))), F.lit(0)).cast("long").alias("n"), F.min_by("total", F.when(F.col("total").isNotNull(), F.col("page"))).cast("long").alias("total"),
    )
    once = own.select(board, F.explode(ids).alias("_id")).where("_id is not null").groupBy(board).agg(F.countDistinct("_id").alias("distinct"))
    whole = F.col("_end").isNotNull() & (F.col("_pages") == F.col("_end")) & (F.col("_end") <= MOST_NUMBERED) & (F.col("_odd") == 0) & (F.col("total").isNull() | (F.col("n") >= F.col("total") * LEAST_SHARE))
    status = F.when(F.col("_bad") == 404, "dead").when(F.col("_bad") == 429, "blocked").when(~F.coalesce(whole, F.lit(False)), "degraded").otherwise("ok")
    return found.join(once, board, "left").select(board, status.alias("status"), "n", "total", F.coalesce("distinct", F.lit(0)).alias("distinct"))


def posting_key(identifier: Column, url: Column, title: Column, location: Column) -> Column:
    """Stable key of a posting on a careers page: its identifier, else its link, else its title and place."""
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.substring(F.sha2(F.coalesce(blank(identifier), blank(url), F.concat_ws("|", title, location)), 256), 1, 16)


def pseudo_slug(source: Column, name: Column) -> Column:
    """Slug of the board that stands for a saved query of an aggregator."""
    return F.concat(F.lit("agg-"), source, F.lit("-"), name)


def missing_boards(queries: DataFrame, stored: DataFrame, source: Column) -> DataFrame:
    """Slugs of the pseudo-boards of saved ``queries`` (name) that are not ``stored`` (slug) yet; stored ones are never edited."""
    return queries.select(pseudo_slug(source, F.col("name")).alias("slug")).distinct().join(stored, "slug", "left_anti")
