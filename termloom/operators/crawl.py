"""Links and frontiers over stored pages; nothing is fetched."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termloom.functions import urls
from termloom.functions.scores import priority
from termloom.plans.materialize import written

PER_SITE, BATCH, LIMIT, REFILL = 10, 10, 12_000, 1_000


def raw_links(pages: DataFrame) -> DataFrame:
    """page_id, url, href: every anchor, a page's repetitions included."""
    return pages.select("page_id", "url", "html").withColumn("href", F.explode(urls.anchors(F.col("html"))))


def links(pages: DataFrame, robots: DataFrame | None = None) -> DataFrame:
    """page_id, link, netloc: each page's distinct wanted links, resolved against its <base> or its own address.

    A <base> that is no address leaves no links. robots (netloc, prefix) lists what sites don't allow."""
    base = urls.base_href(F.col("html"))
    has_base = F.col("html").rlike("(?i)<base[ >]")
    valid = F.when(has_base, F.when(base.rlike(r"^https?://[^/?#\s]+"), base)).otherwise(F.col("url"))
    found = pages.withColumn("_from", valid).where(F.col("_from").isNotNull()).withColumn("href", F.explode(urls.anchors(F.col("html"))))
    found = found.where(urls.wanted(F.col("href"))).select("page_id", urls.resolve(F.col("_from"), F.col("href")).alias("link")).distinct()
    found = found.withColumn("netloc", urls.netloc(F.col("link")))
    if robots is not None:
        r = robots.select(F.col("netloc").alias("_site"), "prefix")
        found = found.join(r, (F.col("netloc") == F.col("_site")) & urls.path(F.col("link")).startswith(F.col("prefix")), "left_anti")
    return found


def site_counts(addresses: DataFrame, column: str = "url") -> DataFrame:
    return addresses.groupBy(urls.netloc(F.col(column)).alias("netloc")).agg(F.count("*").alias("n"))


def cap_sites(found: DataFrame, order: list, taken: DataFrame | None = None, most: int = PER_SITE, column: str = "url") -> DataFrame:
    """At most `most` addresses of a site, counting those taken before (netloc, n).

    The limit on the number in order comes first, alone: so it reaches the window, and of a hot site few rows are sorted."""
    place = F.row_number().over(Window.partitionBy("netloc").orderBy(*order))
    numbered = found.withColumn("netloc", urls.netloc(F.col(column))).withColumn("_rn", place).where(F.col("_rn") <= most)
    if taken is None:
        return numbered.drop("_rn")
    joined = numbered.join(taken.select("netloc", F.col("n").alias("_taken")), "netloc", "left")
    return joined.where(F.col("_rn") + F.coalesce("_taken", F.lit(0)) <= most).drop("_rn", "_taken")


def discovered(linked: DataFrame) -> DataFrame:
    """url, first_page: each link with the first page that names it."""
    return linked.groupBy(F.col("link").alias("url")).agg(F.min("page_id").alias("first_page"))


def seeds(pages: DataFrame, n: int = BATCH) -> DataFrame:
    """The first pages stand for a search engine's answer."""
    return pages.orderBy("page_id").limit(n)


def frontier(pages: DataFrame, start: DataFrame, robots: DataFrame | None = None) -> DataFrame:
    """url, netloc, first_page: what the start's pages link to and has not been seen, capped by site in order of discovery."""
    known = start.select("url").distinct()
    fresh = discovered(links(start, robots)).join(known, "url", "left_anti")
    return cap_sites(fresh, ["first_page", "url"], site_counts(start.select("url").distinct())).select("url", "netloc", "first_page")


def crawl_bfs(pages: DataFrame, levels: int, start: DataFrame | None = None, robots: DataFrame | None = None, limit: int = LIMIT) -> DataFrame:
    """url, netloc, level of all addresses that enter the queue; stored pages among its first `limit` are followed."""
    start = seeds(pages) if start is None else start
    seen = written(cap_sites(start.select("page_id", "url").dropDuplicates(["url"]), ["page_id"]).select("url", "netloc", F.lit(0).alias("level"), F.col("page_id").alias("first_page")))
    for level in range(1, levels + 1):
        before = seen.where(F.col("level") < level - 1).count()
        if before >= limit:
            break
        turn = seen.where(F.col("level") == level - 1).orderBy("first_page", "url").limit(limit - before).select("url")
        fresh = discovered(links(pages.join(turn, "url", "left_semi"), robots)).join(seen.select("url"), "url", "left_anti")
        capped = cap_sites(fresh, ["first_page", "url"], seen.groupBy("netloc").agg(F.count("*").alias("n")))
        seen = written(seen.unionByName(capped.select("url", "netloc", F.lit(level).alias("level"), "first_page")))
    return seen.select("url", "netloc", "level")


def link_importance(linked: DataFrame) -> DataFrame:
    """url, importance: how many pages name a link beyond the first."""
    return linked.groupBy(F.col("link").alias("url")).agg((F.count_distinct("page_id") - 1).alias("importance"))


def prioritised(pages: DataFrame, start: DataFrame, robots: DataFrame | None = None) -> DataFrame:
    """url, netloc, importance, novelty, score of the frontier. Both parts are a snapshot at the batch's start."""
    open_ = frontier(pages, start, robots)
    every = open_.select("netloc").unionByName(start.select("url").distinct().select(urls.netloc(F.col("url")).alias("netloc")))
    made = every.groupBy("netloc").agg(F.count("*").alias("novelty"))
    rated = open_.join(link_importance(links(start, robots)), "url").join(made, "netloc")
    return rated.select("url", "netloc", "importance", "novelty", F.round(priority(F.col("importance"), F.col("novelty")), 6).alias("score"))


def next_batch(rated: DataFrame, n: int = BATCH) -> DataFrame:
    return rated.orderBy(F.desc("score"), "url").limit(n)


def crawl_prioritised(pages: DataFrame, batches: int, start: DataFrame | None = None, limit: int = LIMIT, refill: int = REFILL) -> DataFrame:
    """url, batch in which an address is taken, the best first, `limit` addresses in all.

    Fetched pages wait, in order of page_id, and are read for links as long as the frontier holds less than `refill`."""
    start = seeds(pages) if start is None else start
    taken = written(start.select("url", F.lit(0).alias("batch")).distinct())
    read = written(start.select("page_id"))
    for batch in range(1, batches + 1):
        have = taken.count()
        if have >= limit:
            break
        known = pages.join(read, "page_id", "left_semi")
        open_ = written(prioritised(pages, known).join(taken.select("url"), "url", "left_anti"))
        taken = written(taken.unionByName(next_batch(open_, min(BATCH, limit - have)).select("url", F.lit(batch).alias("batch"))))
        left = open_.join(taken.select("url"), "url", "left_anti").count()
        waiting = pages.join(taken.select("url"), "url", "left_semi").join(read, "page_id", "left_anti")
        linked = discovered(links(known.unionByName(waiting))).join(taken.select("url"), "url", "left_anti")
        fresh = cap_sites(linked, ["first_page", "url"], site_counts(known.select("url").distinct())).groupBy(F.col("first_page").alias("page_id")).agg(F.count("*").alias("n"))
        # at most `limit` pages have been taken, so the window without keys is bounded
        before = F.sum("n").over(Window.orderBy("page_id").rowsBetween(Window.unboundedPreceding, -1))
        queue = waiting.select("page_id").join(fresh, "page_id", "left").withColumn("before", F.coalesce(before, F.lit(0)))
        read = written(read.unionByName(queue.where(F.col("before") + left < refill).select("page_id")))
    return taken


#: What a failed fetch logs, by its kind.
FAILURES = {"timeout": " connection time out", "url": " URLError", "other": " Other weird Error"}


def crawl_log(pages: DataFrame, scores: DataFrame | None = None, failures: DataFrame | None = None) -> DataFrame:
    """page_id, line: one for each stored page, its size in KB and, with scores (url, score), its priority.

    failures (page_id, url, kind, code) are fetches without a page: kind http logs its code, others as FAILURES says."""
    rows = pages.select("page_id", "url", (F.octet_length(F.coalesce("html", F.lit(""))) / 1024.0).alias("kb"))
    line = F.format_string("%d %s Size: %.2fkb Return code:200", F.col("page_id"), F.col("url"), F.bround("kb", 2))
    if scores is not None:
        rows = rows.join(scores.select("url", "score"), "url", "left")
        line = F.concat(line, F.when(F.col("score") != 0, F.format_string(" Priority score:%.2f", "score")).otherwise(""))
    logged = rows.select("page_id", line.alias("line"))
    if failures is None:
        return logged
    said = F.when(F.col("kind") == "http", F.concat(F.lit(" ErrorCode:"), F.col("code").cast("string")))
    for kind, text in FAILURES.items():
        said = said.when(F.col("kind") == kind, text)
    return logged.unionByName(failures.select("page_id", F.concat(F.col("page_id").cast("string"), F.lit(" "), "url", said.otherwise(FAILURES["other"])).alias("line")))


def crawl_size(pages: DataFrame) -> DataFrame:
    """files, megabytes."""
    return pages.agg(F.count("*").alias("files"), F.round(F.coalesce(F.sum(F.octet_length("html")), F.lit(0)) / (1024.0 * 1024.0), 2).alias("megabytes"))
