"""Feed operators: due feeds, top entries, ingestion, metadata, health.

A refresh of many feeds is one batch: the per-feed loop of the original
(N+1 lookups) becomes a ranked filter, an anti-join and one aggregate.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import FEED_ENTRIES_REFRESH, FEED_STALE_MINUTES
from ..functions.html import decode_entities, inner_tokens, text_of, tokens, tree
from ..functions.regex import let
from ..functions.status import feed_status, truthy

_ENTRY = ("title string, link array<struct<_VALUE string, _href string, _rel string>>, guid struct<_VALUE string, _isPermaLink string>, "
          "pubDate string, date string")
_ATOM_ENTRY = "title string, link array<struct<_href string, _rel string>>, published string, updated string"
#: RSS (channel with items), RDF (channel and items side by side) and Atom (entries), in one schema; namespaces are ignored,
#: so an item's own link and an ``atom:link`` beside it are one list.
FEED_SCHEMA = (f"channel struct<title string, description string, lastBuildDate string, pubDate string, date string, item array<struct<{_ENTRY}>>>, "
               f"item array<struct<{_ENTRY}>>, title string, subtitle string, updated string, entry array<struct<{_ATOM_ENTRY}>>")
#: Names of time zones in mail dates and their minutes from UTC.
ZONES = {"GMT": 0, "UTC": 0, "UT": 0, "Z": 0, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
         "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180, "MSK": 180, "JST": 540}
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


def due_feeds(feeds: DataFrame, now: Column) -> DataFrame:
    """Active feeds not checked in the last 30 minutes (never checked counts as due)."""
    stale = F.col("last_checked").isNull() | \
        (F.col("last_checked") <= now - F.expr(f"INTERVAL {FEED_STALE_MINUTES} MINUTES"))
    return feeds.where(F.col("is_active") & stale)


#: Parts that each feed is dealt into before the final ranking.
SALTS = 64


def top_numbers(entries: DataFrame, n: int = FEED_ENTRIES_REFRESH) -> DataFrame:
    """First ``n`` entries of every feed in document order, with 0-based ``pos``; other columns come through.

    Entries are ranked per feed and salt first, so a feed holding most
    entries is dealt over many tasks and the final ranking sees at most
    ``n`` rows per salt; both filters are planned as group limits.
    """
    salted = entries.withColumn("_salt", F.pmod(F.xxhash64("entry_order"), F.lit(SALTS)))
    part = Window.partitionBy("feed_id", "_salt").orderBy("entry_order")
    whole = Window.partitionBy("feed_id").orderBy("entry_order")
    few = salted.withColumn("_rn", F.row_number().over(part)).where(F.col("_rn") <= n).drop("_salt", "_rn")
    ranked = few.withColumn("_rn", F.row_number().over(whole)).where(F.col("_rn") <= n)
    return ranked.withColumn("pos", (F.col("_rn") - 1).cast("int")).drop("_rn")


def top_entries(entries: DataFrame, n: int = FEED_ENTRIES_REFRESH) -> DataFrame:
    return top_numbers(entries, n).select("feed_id", "pos", "link", "title", "entry_order")


def new_entries(top: DataFrame, known_urls: DataFrame, feeds: DataFrame) -> DataFrame:
    """Content rows a refresh creates.

    Linkless entries and links already stored are dropped after the top-N cut
    (and not replaced); a link seen twice in the same run keeps its first
    occurrence in feed order, then position. Each row takes its feed's owner.
    """
    cand = top.where(truthy(F.col("link")))
    cand = cand.join(known_urls.select(F.col("url").alias("link")), "link", "left_anti")
    # the least (feed, position) as one number is a hash aggregate, which the least struct is not; its row is joined back
    place = (F.col("feed_id").cast("decimal(20,0)") * F.lit(2 ** 31).cast("decimal(11,0)") + F.col("pos")).cast("decimal(32,0)")
    least = cand.withColumn("_place", place).groupBy("link").agg(F.min("_place").alias("_place"))
    first = cand.withColumn("_place", place).drop("link").join(least, "_place").select(F.col("link").alias("url"), "feed_id", "pos", "title")
    owners = feeds.select(F.col("id").alias("feed_id"), "user_id")
    return first.join(owners, "feed_id", "left")


def metadata_upsert(feeds: DataFrame, refreshed: DataFrame, now: Column) -> DataFrame:
    """Feed rows after a successful refresh of the feeds in ``refreshed``.

    ``refreshed`` holds (id, new_title, new_updated). Title falls back to the
    stored one when the document has none; the update time changes only when
    the document carries one; the error count resets.
    """
    j = feeds.join(refreshed, "id", "left")
    hit = F.col("_hit").isNotNull()
    return j.select(
        "id", "url",
        F.when(hit, F.coalesce(F.col("new_title"), F.col("title"))).otherwise(F.col("title")).alias("title"),
        F.when(hit, now).otherwise(F.col("last_checked")).alias("last_checked"),
        F.when(hit, F.coalesce(F.col("new_updated"), F.col("last_updated"))).otherwise(F.col("last_updated")).alias("last_updated"),
        F.when(hit, F.lit(0)).otherwise(F.col("error_count")).cast("int").alias("error_count"),
        "is_active")


def run_summaries(polls: DataFrame) -> DataFrame:
    """(feed_id, slice, n_polls, trailing, all_failed): what a feed's polls of one day say about its run of failures.

    ``trailing`` counts the failures after the day's last success. One scan and one shuffle, by feed and day, so that a
    feed polled most of all is dealt over its days. Summaries of different days can be kept, and merged in any order, by
    :func:`merged_streak`.
    """
    newest_first = Window.partitionBy("feed_id", "slice").orderBy(F.desc("ts"), F.desc("poll_id"))
    rows = polls.select("feed_id", F.date_trunc("day", "ts").alias("slice"), "ts", "poll_id", "ok")
    since = rows.withColumn("_oks", F.sum(F.col("ok").cast("int")).over(newest_first))
    return since.groupBy("feed_id", "slice").agg(
        F.count(F.lit(1)).alias("n_polls"), F.sum(F.when(F.col("_oks") == 0, 1).otherwise(0)).cast("bigint").alias("trailing"),
        F.every(~F.col("ok")).alias("all_failed"))


def merged_streak(summaries: DataFrame) -> DataFrame:
    """Consecutive failures since the last success, per feed, from its days' summaries, however they arrived.

    A day counts if every later day failed altogether: trailing failures add up back to the first success.
    """
    later = Window.partitionBy("feed_id").orderBy(F.desc("slice")).rowsBetween(Window.unboundedPreceding, -1)
    broken = F.coalesce(F.sum(F.when(F.col("all_failed"), 0).otherwise(1)).over(later), F.lit(0))
    return summaries.withColumn("_broken", broken).groupBy("feed_id").agg(
        F.sum("n_polls").alias("n_polls"), F.sum(F.when(F.col("_broken") == 0, F.col("trailing")).otherwise(0)).alias("error_count"))


def failure_streak(polls: DataFrame) -> DataFrame:
    """(feed_id, n_polls, error_count): consecutive failures since the last success, per feed, in one scan of the polls."""
    return merged_streak(run_summaries(polls))


def toggle(feeds: DataFrame, ids: DataFrame) -> DataFrame:
    """Flip ``is_active`` of the feeds listed in ``ids`` (column ``id``)."""
    j = feeds.join(ids.select("id").distinct().withColumn("_t", F.lit(True)), "id", "left")
    active = F.when(F.col("_t"), ~F.col("is_active")).otherwise(F.col("is_active"))
    return j.select("id", active.alias("is_active"), feed_status(active, F.col("error_count")).alias("status"))


def delete(feeds: DataFrame, content: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Remove feeds; their content rows stay, with the feed reference cleared."""
    gone = ids.select(F.col("id").alias("feed_id")).distinct()
    kept = feeds.join(gone.withColumnRenamed("feed_id", "id"), "id", "left_anti")
    # content without a feed, which may be most of it, stays out of the join
    c = content.where(F.col("feed_id").isNotNull()).join(gone.withColumn("_gone", F.lit(True)), "feed_id", "left")
    c = c.select(*[F.when(F.col("_gone"), F.lit(None).cast("bigint")).otherwise(F.col("feed_id")).alias("feed_id")
                   if x == "feed_id" else F.col(x) for x in content.columns])
    return kept, c.unionByName(content.where(F.col("feed_id").isNull()))


def item_link(links: Column, guid: Column, permanent: Column) -> Column:
    """The page an item links to: its own link, else an alternate one by address, else a guid that is a permanent link."""
    own = F.filter(links, lambda k: truthy(k["_VALUE"]))
    alternate = F.filter(links, lambda k: truthy(k["_href"]) & (F.coalesce(k["_rel"], F.lit("alternate")) == "alternate"))
    return F.coalesce(F.get(own, F.lit(0))["_VALUE"], F.get(alternate, F.lit(0))["_href"],
                      F.when(truthy(guid) & (F.coalesce(F.lower(permanent), F.lit("true")) != "false"), guid))


def _attribute(tag: Column, name: str) -> Column:
    found = [F.regexp_extract(tag, rf"(?is)\s{name}\s*=\s*{quoted}", 1) for quoted in ('"([^"]*)"', "'([^']*)'")]
    return F.nullif(decode_entities(F.concat(*found)), F.lit(""))


def loose_entries(xml: Column) -> Column:
    """The whole items or entries of a document that need not parse: title, link and date of each, in document order.

    Read from tokens and intervals as a page is, so one entry's errors don't reach the others; what breaks off is left out.
    """
    def local(n):
        return F.regexp_replace(n["name"], "^.*:", "")

    def entries(toks, nodes):
        def entry(item):
            own = F.filter(nodes, lambda n: n["parent"] == item["pos"])

            def named(name):
                return lambda n: local(n) == name

            def texts(children, *names):
                """Texts of the children with those names, in the names' order."""
                return F.flatten(F.array(*[F.transform(F.filter(children, named(x)), lambda n: F.nullif(
                    F.trim(text_of(inner_tokens(toks, n))), F.lit(""))) for x in names]))

            def read(children):
                links = F.transform(F.filter(children, named("link")), lambda n: let(F.get(toks, n["pos"] - 1)["text"], lambda t: F.struct(
                    F.nullif(F.trim(text_of(inner_tokens(toks, n))), F.lit("")).alias("_VALUE"), _attribute(t, "href").alias("_href"), _attribute(t, "rel").alias("_rel"))))
                guid = F.get(F.filter(children, named("guid")), F.lit(0))
                permanent = F.when(guid.isNotNull(), _attribute(F.get(toks, guid["pos"] - 1)["text"], "isPermaLink"))
                return F.struct(F.get(texts(children, "title"), F.lit(0)).alias("title"),
                                item_link(links, F.get(texts(children, "guid"), F.lit(0)), permanent).alias("link"),
                                F.get(texts(children, "pubdate", "published", "date", "updated"), F.lit(0)).alias("dated"))
            return let(own, read)
        whole = F.filter(nodes, lambda n: local(n).isin("item", "entry") & (F.get(toks, n["stop"] - 1)["name"] == n["name"]))
        return F.transform(whole, entry)
    plain = F.regexp_replace(xml, r"<!\[CDATA\[|\]\]>", "")
    return let(tokens(plain, void=()), lambda ts: let(tree(ts, void=()), lambda ns: entries(ts, ns)))


def read_feed_documents(docs: DataFrame, xml: str = "xml") -> DataFrame:
    """As :func:`parse_feed_documents`, but a document that doesn't parse gives the entries before its break: how a refresh reads it."""
    kept = docs.withColumn("_loose", F.col(xml))
    p = parse_feed_documents(kept, xml)
    return p.withColumn("entries", F.when(F.col("ok"), F.col("entries")).otherwise(loose_entries(F.col("_loose")))).drop("_loose")


def parse_feed_documents(docs: DataFrame, xml: str = "xml") -> DataFrame:
    """Feed XML (RSS, RDF or Atom) -> ``ok``, title, description, update time and the entries in document order.

    A document that does not parse, or has neither a channel nor a feed
    title or entries, gives ``ok`` false and nulls; that is how a malformed feed
    is rejected on add.
    """
    own = [c for c in docs.columns if c != xml]
    p = docs.select(*own, F.from_xml(F.col(xml), FEED_SCHEMA, {"ignoreNamespace": "true"}).alias("_f"))
    rss = F.col("_f.channel").isNotNull()
    atom = ~rss & (F.col("_f.title").isNotNull() | F.col("_f.entry").isNotNull())
    items = F.transform(F.coalesce("_f.channel.item", "_f.item", F.array()), lambda x: F.struct(
        x["title"].alias("title"), item_link(x["link"], x["guid"]["_VALUE"], x["guid"]["_isPermaLink"]).alias("link"),
        F.coalesce(x["pubDate"], x["date"]).alias("dated")))

    def page(links: Column) -> Column:
        """The page an entry links to: its alternate link, else its first."""
        plain = F.filter(links, lambda k: F.coalesce(k["_rel"], F.lit("alternate")) == "alternate")
        return F.coalesce(F.get(plain, F.lit(0))["_href"], F.get(links, F.lit(0))["_href"])
    entries = F.transform(F.coalesce("_f.entry", F.array()), lambda x: F.struct(
        x["title"].alias("title"), page(x["link"]).alias("link"), F.coalesce(x["published"], x["updated"]).alias("dated")))
    return p.select(
        *own, (rss | atom).alias("ok"), F.coalesce("_f.channel.title", "_f.title").alias("feed_title"),
        F.coalesce("_f.channel.description", "_f.subtitle").alias("feed_description"),
        F.coalesce("_f.channel.lastBuildDate", "_f.channel.pubDate", "_f.channel.date", "_f.updated").alias("feed_updated"),
        F.when(rss, items).when(atom, entries).alias("entries"))


def parse_feed_xml(docs: DataFrame, xml: str = "xml") -> DataFrame:
    """One row per entry of every document (one row with nulls for a document without any)."""
    own = [c for c in docs.columns if c != xml]
    p = parse_feed_documents(docs, xml)
    ex = p.select(*own, "ok", "feed_title", F.posexplode_outer("entries").alias("pos", "item"))
    return ex.select(*own, "ok", "feed_title", F.col("pos").cast("int").alias("pos"), F.col("item.title").alias("title"),
                     F.col("item.link").alias("link"), F.col("item.dated").alias("pub_date"))


def parse_feed_date(s: Column) -> Column:
    """A feed date to a UTC timestamp, null when it is none.

    ISO-8601, also without separators, with optional time, seconds, fraction and offset, or the mail form with
    optional weekday, one- or two-digit day, two-digit year (from 69 on of the last century) and a zone name or offset.
    """
    iso = (r"^\s*([0-9]{4})-?([0-9]{2})-?([0-9]{2})(?:[T ]([0-9]{2}):?([0-9]{2})(?::?([0-9]{2}))?(?:\.[0-9]+)?"
           r"\s*(Z|[+-][0-9]{2}:?[0-9]{2})?)?\s*$")
    mail = r"^\s*(?:[A-Za-z]{3,9},\s*)?([0-9]{1,2}) ([A-Za-z]{3})[a-z]* ([0-9]{4}|[0-9]{2}) ([0-9]{1,2}:[0-9]{2})(:[0-9]{2})?\s*([A-Z]{1,4}|[+-][0-9]{4})?\s*$"

    def groups(x: Column, pattern: str, n: int) -> Column:
        return F.array(*[F.regexp_extract(x, pattern, i) for i in range(1, n + 1)])

    def shift(zone: Column) -> Column:
        """Minutes from UTC of a zone name or offset; null for an unknown name."""
        named = F.create_map(*[x for k, v in ZONES.items() for x in (F.lit(k), F.lit(v))])
        digits = F.regexp_replace(zone, "[^0-9]", "")
        offset = (F.substring(digits, 1, 2).cast("int") * 60 + F.substring(digits, 3, 2).cast("int")) \
            * F.when(F.startswith(zone, F.lit("-")), -1).otherwise(1)
        return F.when(zone == "", 0).when(digits != "", offset).otherwise(F.try_element_at(named, zone))

    def utc(text: Column, zone: Column) -> Column:
        return text.try_cast("timestamp_ntz") - F.make_dt_interval(F.lit(0), F.lit(0), shift(zone))

    def seconds(x: Column) -> Column:
        return F.when(x != "", x).otherwise(F.lit(":00"))

    def from_iso(g: Column) -> Column:
        clock = [F.when(g[i] != "", g[i]).otherwise("00") for i in (3, 4, 5)]
        return utc(F.concat(F.concat_ws("-", g[0], g[1], g[2]), F.lit(" "), F.concat_ws(":", *clock)), g[6])

    def from_mail(g: Column) -> Column:
        month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.initcap(g[1]))
        century = F.when(F.length(g[2]) == 4, "").when(g[2] >= "69", "19").otherwise("20")
        return utc(F.concat(century, g[2], F.lit("-"), F.lpad(month.cast("string"), 2, "0"), F.lit("-"), F.lpad(g[0], 2, "0"), F.lit(" "),
                            F.lpad(g[3], 5, "0"), seconds(g[4])), g[5])
    return let(s, lambda x: F.when(x.rlike(iso), let(groups(x, iso, 7), from_iso)).when(x.rlike(mail), let(groups(x, mail, 6), from_mail)))
