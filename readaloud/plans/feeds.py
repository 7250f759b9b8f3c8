"""Feed queries: due feeds, refresh (one / all / on add), metadata, health, listings."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import FEED_ENTRIES_ON_ADD, PARSE_ERROR, UNNAMED_FEED, UNTITLED_POST
from ..functions.status import content_status, feed_badge, feed_status, status_badge, truthy
from ..operators import feeds as O
from ..sources import fixtures as X
from ..sources.tables import read_table


def _now():
    return X.now_ts()


def _top(spark: SparkSession, sf_dir: str, feeds: DataFrame | None = None) -> DataFrame:
    """First entries of every feed (or of ``feeds``): numbers are ranked, then only the winners' texts are read."""
    numbers = X.entry_numbers(spark, sf_dir)
    if feeds is not None:
        numbers = numbers.join(feeds.select("feed_id"), "feed_id", "left_semi")
    return X.with_entry_texts(spark, sf_dir, O.top_numbers(numbers))


def feed_top_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top(spark, sf_dir).drop("entry_order")


def feed_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = O.due_feeds(X.feeds(spark, sf_dir), _now())
    mins = F.floor((F.unix_timestamp(_now().cast("timestamp")) - F.unix_timestamp(F.col("last_checked").cast("timestamp"))) / 60)
    return f.select("id", "url", "last_checked", mins.cast("bigint").alias("minutes_since_check"))


def feed_new_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One refresh of every due feed: the content rows it creates."""
    feeds = X.feeds(spark, sf_dir)
    due = O.due_feeds(feeds, _now()).select(F.col("id").alias("feed_id"))
    top = _top(spark, sf_dir, due)
    return O.new_entries(top, X.known_content_urls(spark, sf_dir), feeds)


def feed_refresh_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New items per due feed (0 included), the count the refresh reports."""
    feeds = X.feeds(spark, sf_dir)
    due = O.due_feeds(feeds, _now()).select(F.col("id").alias("feed_id"))
    new = feed_new_entries(spark, sf_dir).groupBy("feed_id").agg(F.count(F.lit(1)).alias("n_new"))
    return due.join(new, "feed_id", "left").select("feed_id", F.coalesce("n_new", F.lit(0).cast("bigint")).alias("n_new"))


def feed_refresh_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a refresh of all feeds reports at its end: feeds refreshed, those with anything new, new items in all."""
    return feed_refresh_all(spark, sf_dir).agg(F.count(F.lit(1)).alias("n_feeds"), F.count(F.when(F.col("n_new") > 0, 1)).alias("n_with_new"),
                                               F.coalesce(F.sum("n_new"), F.lit(0).cast("bigint")).alias("n_new"))


def feed_refresh_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each feed refreshed on its own, ignoring staleness; inactive feeds yield nothing."""
    feeds = X.feeds(spark, sf_dir)
    active = feeds.where("is_active").select(F.col("id").alias("feed_id"))
    top = _top(spark, sf_dir, active)
    cand = top.where(truthy(F.col("link")))
    cand = cand.join(X.known_content_urls(spark, sf_dir).select(F.col("url").alias("link")).distinct(), "link", "left_anti")
    per = cand.groupBy("feed_id").agg(F.countDistinct("link").alias("n_new"))
    return feeds.select(F.col("id").alias("feed_id"), "is_active").join(per, "feed_id", "left").select(
        "feed_id", "is_active",
        F.when(F.col("is_active"), F.coalesce("n_new", F.lit(0).cast("bigint"))).otherwise(F.lit(0).cast("bigint")).alias("n_new"))


def feed_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(feed_id, xml): the document each feed serves, with its first ten entries.

    Even feeds serve Atom and the others RSS; every eleventh document is cut
    short. Title and update time are missing from some.
    """
    top = _top(spark, sf_dir)
    i = F.col("id")
    own = X.feeds(spark, sf_dir).select("id", "description")
    updated = F.when(i % 3 != 1, X.epoch_ts() + F.make_dt_interval(i.cast("int")))
    rss = F.concat(F.lit("<item>"), _element("title", F.col("title")), _element("link", F.col("link")), F.lit("</item>"))
    atom = F.concat(F.lit("<entry>"), _element("title", F.col("title")), F.when(
        truthy(F.col("link")), F.concat(F.lit('<link rel="self" href="x"/><link href="'), F.col("link"), F.lit('"/>'))).otherwise(F.lit("")),
        F.lit("</entry>"))
    entry = F.when(F.col("feed_id") % 2 == 0, atom).otherwise(rss)
    bodies = top.groupBy("feed_id").agg(F.array_join(F.transform(  # at most ten entries a feed
        F.array_sort(F.collect_list(F.struct("pos", entry.alias("x")))), lambda s: s["x"]), "").alias("body"))
    j = own.join(bodies, own.id == bodies.feed_id, "left")
    title = _element("title", F.when(i % 4 != 2, F.concat(F.lit("Channel "), i.cast("string"))))
    body = F.coalesce("body", F.lit(""))
    mail = F.concat(F.date_format(updated + F.make_dt_interval(F.lit(0), F.lit(2)), "EEE, d MMM yyyy HH:mm:ss"), F.lit(" +0200"))
    iso = F.concat(F.date_format(updated - F.make_dt_interval(F.lit(0), F.lit(5)), "yyyy-MM-dd'T'HH:mm:ss"), F.lit(".250-05:00"))
    as_rss = F.concat(F.lit('<rss version="2.0"><channel>'), title, _element("description", F.col("description")),
                      _element("lastBuildDate", mail), body, F.lit("</channel></rss>"))
    as_atom = F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom">'), title, _element("subtitle", F.col("description")),
                       _element("updated", iso), body, F.lit("</feed>"))
    xml = F.when(i % 2 == 0, as_atom).otherwise(as_rss)
    return j.select(i.alias("feed_id"), F.when(i % 11 == 5, F.substring(xml, 1, 40)).otherwise(xml).alias("xml"))


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests to add every feed, with what their documents say; those with ``id % 4 = 0`` are subscribed already."""
    feeds = X.feeds(spark, sf_dir)
    existing = feeds.where(F.col("id") % 4 == 0).select("url", F.lit(True).alias("held"))
    parsed = O.parse_feed_documents(feed_snapshots(spark, sf_dir)).withColumnRenamed("feed_id", "id")
    return feeds.select("id", "url", "user_id").join(existing, "url", "left").join(parsed, "id", "left")


def feed_subscribe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed row each request creates, or why it creates none."""
    r = _requests(spark, sf_dir)
    held, ok = F.coalesce("held", F.lit(False)), F.coalesce("ok", F.lit(False))
    status = F.when(held, "exists").when(~ok, "rejected").otherwise("added")
    return r.select("id", "url", status.alias("status"), F.when(status == "added", F.col("feed_title")).alias("title"),
                    F.when(status == "added", F.col("feed_description")).alias("description"), "user_id",
                    F.when(status == "rejected", F.concat(F.lit(PARSE_ERROR), F.col("url"))).alias("message"))


def feed_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that don't parse, among all feed documents of ten entries each."""
    p = O.parse_feed_documents(feed_xml_documents(spark, sf_dir))
    return p.where(~F.col("ok")).select("feed_id", "block")


def feed_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 5 entries of every feed that is added, read from its document."""
    added = _requests(spark, sf_dir).where(F.col("held").isNull() & F.col("ok"))
    entries = added.select(F.col("id").alias("feed_id"), F.posexplode("entries").alias("pos", "e")).where(F.col("pos") < FEED_ENTRIES_ON_ADD)
    top = entries.select("feed_id", F.col("pos").cast("int").alias("pos"), F.col("e.link").alias("link"), F.col("e.title").alias("title"))
    return O.new_entries(top, X.known_content_urls(spark, sf_dir), X.feeds(spark, sf_dir))


def feed_metadata_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feed rows after the due feeds' documents were read; one that doesn't parse keeps its title and update time."""
    feeds = X.feeds(spark, sf_dir)
    parsed = O.parse_feed_documents(feed_snapshots(spark, sf_dir)).select(
        F.col("feed_id").alias("id"), F.col("feed_title").alias("new_title"), O.parse_feed_date(F.col("feed_updated")).alias("new_updated"))
    refreshed = O.due_feeds(feeds, _now()).select("id", F.lit(True).alias("_hit")).join(parsed, "id", "left")
    return O.metadata_upsert(feeds, refreshed, _now())


def feed_error_streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = O.failure_streak(X.feed_polls(spark, sf_dir))
    active = F.col("feed_id") % 4 != 0
    return s.select("feed_id", "n_polls", "error_count", feed_status(active, F.col("error_count")).alias("status"))


def feed_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feeds per status."""
    f = X.feeds(spark, sf_dir)
    return f.groupBy(feed_status(F.col("is_active"), F.col("error_count")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


def feed_toggle(spark: SparkSession, sf_dir: str) -> DataFrame:
    feeds = X.feeds(spark, sf_dir)
    return O.toggle(feeds, feeds.where(F.col("id") % 3 == 0).select("id"))


def feed_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content rows after deleting every feed with ``id % 5 = 1``."""
    feeds = X.feeds(spark, sf_dir)
    _, content = O.delete(feeds, X.content_jobs(spark, sf_dir), feeds.where(F.col("id") % 5 == 1).select("id"))
    return content.select("id", "feed_id")


def feed_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = X.feeds(spark, sf_dir)
    st = feed_status(F.col("is_active"), F.col("error_count"))
    return f.select(
        "id", F.when(truthy(F.col("title")), F.col("title")).otherwise(F.lit(UNNAMED_FEED)).alias("display_title"),
        "url", feed_badge(st).alias("badge"),
        F.coalesce(F.date_format("last_checked", "yyyy-MM-dd HH:mm"), F.lit("Never")).alias("checked"))


def feed_content_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feed-sourced content, newest first, with its feed (which may be gone)."""
    c = X.content_jobs(spark, sf_dir).where(F.col("feed_id").isNotNull())
    f = X.feeds(spark, sf_dir).select(F.col("id").alias("feed_id"), F.col("title").alias("feed_title"))
    j = c.join(f, "feed_id", "left")
    st = content_status(F.col("is_processed"), F.col("is_processing"), F.col("error"))
    return j.orderBy(F.col("created_at").desc(), F.col("id").desc()).select(
        "id", F.when(truthy(F.col("title")), F.col("title")).otherwise(F.lit(UNTITLED_POST)).alias("display_title"),
        "feed_id", "feed_title", F.date_format("created_at", "yyyy-MM-dd").alias("created"),
        status_badge(st).alias("badge"))


def _xml_escape(c):
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")),
                     F.lit(">"), F.lit("&gt;"))


def _element(name: str, value) -> Column:
    """An XML element, left out when the value is null or empty."""
    return F.when(truthy(value), F.concat(F.lit(f"<{name}>"), _xml_escape(value), F.lit(f"</{name}>"))).otherwise(F.lit(""))


def feed_xml_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feed XML built from documents, ten entries per document (bounded groups), RSS and Atom in turn.

    Entries without a link omit the element; every 13th block is cut short
    so that malformed feeds are present.
    """
    e = X.feed_entries(spark, sf_dir).select("feed_id", "entry_order", "link", F.md5("title").alias("title"),
                                             (F.col("entry_order") / 10).cast("bigint").alias("block"))
    dated = X.epoch_ts() + F.make_dt_interval(F.lit(0), F.lit(0), F.col("entry_order").cast("int"))
    rss = F.concat(F.lit("<item>"), _element("title", F.col("title")), _element("link", F.col("link")),
                   _element("pubDate", F.concat(F.date_format(dated, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))), F.lit("</item>"))
    atom = F.concat(F.lit("<entry>"), _element("title", F.col("title")),
                    F.when(truthy(F.col("link")), F.concat(F.lit('<link href="'), F.col("link"), F.lit('"/>'))).otherwise(F.lit("")),
                    _element("updated", F.concat(F.date_format(dated, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))), F.lit("</entry>"))
    is_atom = F.col("block") % 2 == 0
    g = e.groupBy("feed_id", "block").agg(F.array_sort(F.collect_list(F.struct(
        "entry_order", F.when(is_atom, atom).otherwise(rss).alias("x")))).alias("items"))
    body = F.array_join(F.transform("items", lambda s: s["x"]), "")
    title = _element("title", F.concat(F.lit("Feed "), F.col("feed_id").cast("string")))
    xml = F.when(is_atom, F.concat(F.lit("<feed>"), title, body, F.lit("</feed>"))).otherwise(
        F.concat(F.lit("<rss><channel>"), title, body, F.lit("</channel></rss>")))
    return g.select("feed_id", "block", F.when(F.col("block") % 13 == 5, F.substring(xml, 1, 60)).otherwise(xml).alias("xml"))


def feed_xml_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = O.parse_feed_xml(feed_xml_documents(spark, sf_dir))
    return rows.withColumn("dated", O.parse_feed_date(F.col("pub_date"))).drop("pub_date")


def wild_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(feed_id, xml): first entries of every feed in shapes that feeds come in.

    By ``feed_id % 5``: a link with an ``atom:link`` beside it, a permanent guid alone, a guid that is no link, Atom with prefixes and a link
    to itself first, and RSS with a bare ``&`` that breaks off in its fourth item.
    """
    top = _top(spark, sf_dir)
    f, k, title = F.col("feed_id"), F.col("feed_id") % 5, _element("title", F.md5("title"))
    link = F.coalesce("link", F.lit(""))
    item = F.when(k == 0, F.concat(title, _element("link", link), F.lit('<atom:link href="http://self/" rel="self"/>'))) \
        .when(k == 1, F.concat(title, _element("guid", link))) \
        .when(k == 2, F.concat(title, F.lit('<guid isPermaLink="false">'), link, F.lit("</guid>"))) \
        .when(k == 3, F.concat(F.replace(title, F.lit("title>"), F.lit("atom:title>")), F.lit("<atom:link rel='self' href='http://self/'/><atom:link href='"), link, F.lit("'/>"))) \
        .otherwise(F.concat(F.lit("<title><![CDATA["), F.md5("title"), F.lit("]]></title><x>a & b</x>"), _element("link", link)))
    tag = F.when(k == 3, "atom:entry").otherwise("item")
    entry = F.when((k == 4) & (F.col("pos") == 3), F.lit("<item><title>cut")).otherwise(F.concat(F.lit("<"), tag, F.lit(">"), item, F.lit("</"), tag, F.lit(">")))
    bodies = top.where((k != 4) | (F.col("pos") <= 3)).groupBy("feed_id").agg(F.array_join(F.transform(  # at most ten entries a feed
        F.array_sort(F.collect_list(F.struct("pos", entry.alias("x")))), lambda s: s["x"]), "").alias("body"))
    xml = F.when(k == 3, F.concat(F.lit('<atom:feed xmlns:atom="http://www.w3.org/2005/Atom"><atom:title>T</atom:title>'), "body", F.lit("</atom:feed>"))) \
        .when(k == 4, F.concat(F.lit("<rss><channel><title>T</title>"), "body")) \
        .otherwise(F.concat(F.lit('<rss xmlns:atom="http://www.w3.org/2005/Atom"><channel><title>T</title>'), "body", F.lit("</channel></rss>")))
    return bodies.select(f, xml.alias("xml"))


def feed_wild_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a refresh reads from documents in shapes that feeds come in, broken ones included."""
    p = O.read_feed_documents(wild_documents(spark, sf_dir))
    return p.select("feed_id", "ok", F.posexplode("entries").alias("pos", "e")).select(
        "feed_id", "ok", F.col("pos").cast("int").alias("pos"), F.col("e.title").alias("title"), F.col("e.link").alias("link"))


def feed_updated_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entry dates in the shapes that feeds use (and junk) parsed to UTC timestamps."""
    d = read_table(spark, sf_dir, "documents", "doc_id", "source")
    k = F.col("doc_id")
    ts = X.epoch_ts() + F.make_dt_interval(F.lit(0), F.lit(0), k.cast("int"))
    iso, mail = "yyyy-MM-dd'T'HH:mm:ss", "EEE, dd MMM yyyy HH:mm:ss"
    shapes = (F.concat(F.date_format(ts, iso), F.lit("Z")),
              F.concat(F.date_format(ts + F.make_dt_interval(F.lit(0), F.lit(2)), iso), F.lit("+02:00")),
              F.concat(F.date_format(ts, iso), F.lit(".123Z")),
              F.concat(F.date_format(ts + F.make_dt_interval(F.lit(0), F.lit(2)), mail), F.lit(" +0200")),
              F.concat(F.date_format(ts, "EEE, d MMM yyyy HH:mm:ss"), F.lit(" GMT")),
              F.concat(F.date_format(ts - F.make_dt_interval(F.lit(0), F.lit(5)), mail), F.lit(" EST")),
              F.date_format(ts, iso), F.lit("not a date"),
              F.date_format(ts, "yyyyMMdd'T'HHmmss'Z'"), F.concat(F.date_format(ts + F.make_dt_interval(F.lit(0), F.lit(1)), "dd MMM yy HH:mm"), F.lit(" CET")),
              F.date_format(ts, "yyyy-MM-dd"), F.lit("31 Foo 24 03:04 GMT"))
    raw = shapes[-1]
    for i, shape in enumerate(shapes):
        raw = F.when(k % len(shapes) == i, shape).otherwise(raw)
    return d.select("doc_id", "source", O.parse_feed_date(raw).alias("updated"))
