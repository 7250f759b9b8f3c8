"""Job, request, quota, status and report queries."""
from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import ADMISSION_LIMIT, AUDIO_DIR, DEFAULT_VOICE, DOWNLOAD_DEFAULT_NAME, GUEST_CONVERSION_LIMIT, RESULT_TITLE, SHARE_MAIL, URL_INVALID, URL_MISSING, VOICES
from ..functions import status as S
from ..functions.text import content_hash
from ..functions.urls import domain, form_field, is_form, is_http_url, is_valid_url, matches_url_pattern
from ..operators.chunks import seconds
from ..operators.jobs import admit, cache_lookup, first_per_key, status_json
from ..schemas import CONTENT
from ..session import ensure_checkpoint_dir
from ..sources import fixtures as X
from ..sources.store import current, read_versions, write_version
from ..sources.tables import filter_computed, read_table
from .pages import page_jobs

BASE_URL = "http://localhost"
BAD_URLS = ("https://u:p@h:80/p?q#f", "http://a_b.com/", "ftp://f/x", "//h/p", "mailto:a@b",
            "http:///x", "foo", "", "http://", " http://x.com", "http://[::1/x", "HTTPS://UP.example.com")


def _status(df: DataFrame):
    return S.content_status(F.col("is_processed"), F.col("is_processing"), F.col("error"))


def content_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = X.content_jobs(spark, sf_dir)
    return c.groupBy(_status(c).alias("status")).agg(F.count(F.lit(1)).alias("n"))


def content_next_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = X.content_jobs(spark, sf_dir)
    view = (F.when(~F.col("is_processed"), F.lit("processing"))
            .when(S.truthy(F.col("error")), F.lit("index")).otherwise(F.lit("result")))
    return c.select("id", view.alias("next_view"))


def content_downloadable(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = X.content_jobs(spark, sf_dir)
    st = _status(c)
    return c.select(
        "id",
        (F.col("is_processed") & S.truthy(F.col("file_path")) & ~S.truthy(F.col("error"))).alias("downloadable"),
        ((st == "completed") & S.truthy(F.col("file_path"))).alias("playable"),
        (st == "pending").alias("convertible"),
        S.status_badge(st).alias("badge"),
        S.download_name(F.col("title"), DOWNLOAD_DEFAULT_NAME).alias("download_name"))


def request_cache_web(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache_lookup(X.submissions(spark, sf_dir), X.content_log(spark, sf_dir), api_rule=False)


def request_cache_api(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache_lookup(X.submissions(spark, sf_dir), X.content_log(spark, sf_dir), api_rule=True)


def request_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    limit, period = ADMISSION_LIMIT
    s = X.submissions(spark, sf_dir).select("request_id", "client", "ts")
    return admit(s, "client", "ts", "request_id", limit, period)


def guest_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversions per client against the guest allowance."""
    s = X.submissions(spark, sf_dir)
    g = s.groupBy("client").agg(F.count(F.lit(1)).alias("n_requests"))
    lim = F.lit(GUEST_CONVERSION_LIMIT).cast("bigint")
    return g.select("client", "n_requests", F.least("n_requests", lim).alias("n_allowed"),
                    (F.col("n_requests") > lim).alias("over_quota"))


def user_conversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completed conversions per user, recomputed (users without any get 0)."""
    c = X.content_jobs(spark, sf_dir)
    done = c.where(F.col("is_processed") & ~S.truthy(F.col("error")) & F.col("user_id").isNotNull())
    per_user = done.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    u = X.users(spark, sf_dir)
    j = u.join(per_user, u["id"] == per_user["user_id"], "left")
    return j.select(u["id"].alias("user_id"), "username", F.coalesce("n", F.lit(0).cast("bigint")).alias("conversion_count"))


def voices(spark: SparkSession) -> DataFrame:
    """The voice dimension: six rows, the default flagged."""
    return spark.createDataFrame([(v, v == DEFAULT_VOICE) for v in VOICES], "voice string, is_default boolean")


def voice_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requested voice -> voice used, counted; membership via the broadcast dimension."""
    s = X.submissions(spark, sf_dir).select(S.requested_voice(F.col("voice")).alias("voice_requested"))
    g = s.groupBy("voice_requested").agg(F.count(F.lit(1)).alias("n_requests"))
    dim = F.broadcast(voices(spark).select(F.col("voice").alias("known")))  # fixed six rows
    j = g.join(dim, g["voice_requested"] == dim["known"], "left")
    used = F.coalesce(F.col("known"), F.lit(DEFAULT_VOICE))
    return j.select("voice_requested", used.alias("voice_effective"), "n_requests",
                    F.col("known").isNotNull().alias("available"))


def share_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = X.content_jobs(spark, sf_dir)
    result_url = F.concat(F.lit(BASE_URL + "/result/"), F.col("id").cast("string"))
    title_txt = F.coalesce(F.col("title"), F.lit("None"))
    return c.select(
        "id",
        S.capitalize(F.coalesce(F.col("voice"), F.lit(DEFAULT_VOICE))).alias("voice_label"),
        result_url.alias("share_url"),
        F.concat(F.lit("https://twitter.com/intent/tweet?url="), S.url_quote(result_url),
                 F.lit("&text=Check out this audio version of '"), S.url_quote(title_txt), F.lit("'")).alias("twitter"),
        F.concat(F.lit("https://www.facebook.com/sharer/sharer.php?u="), S.url_quote(result_url)).alias("facebook"),
        F.concat(F.lit(SHARE_MAIL), result_url).alias("email"))


def result_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = filter_computed(page_jobs(spark, sf_dir), F.col("error").isNull())
    dur = seconds(F.col("word_count"))
    preview = F.when(S.truthy(F.col("processed_text")), F.col("processed_text")).otherwise(F.col("original_text"))
    return j.select(
        "content_id",
        F.coalesce("title", F.lit(RESULT_TITLE)).alias("heading"),
        S.truncate_words(F.col("url"), 50).alias("url_short"),
        F.round(dur / 60.0, 1).alias("minutes"),
        F.coalesce(F.col("word_count"), F.lit(0).cast("bigint")).alias("words"),
        S.truncate_words(preview, 500).alias("preview"),
        S.web_path(F.concat(F.lit("static/audio/"), S.output_name(F.col("url")))).alias("web_path"))


def status_json_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = X.content_jobs(spark, sf_dir)
    return c.select("id", status_json(c, BASE_URL).alias("json"))


def web_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The web page's status document: status, error (null included) and the processed flag."""
    c = X.content_jobs(spark, sf_dir)
    doc = F.to_json(F.struct(_status(c).alias("status"), F.col("error"), F.col("is_processed")), {"ignoreNullFields": "false"})
    return c.select("id", doc.alias("json"))


def output_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = X.content_jobs(spark, sf_dir)
    absolute = F.concat(F.lit("/srv/app/static/audio/"), S.output_name(F.col("url")))
    rel = S.relative_audio_path(absolute)
    return c.select("id", S.output_name(F.col("url")).alias("output_name"), rel.alias("file_path"),
                    S.web_path(rel).alias("web_path"), S.web_path(F.col("file_path")).alias("stored_web_path"))


def job_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run every pending job and return the content table after the run.

    A failed extraction changes the error and the flags only. Once the text
    is extracted, title, texts, hash and word count are committed and stay
    even if synthesis then fails; file, voice and duration come
    with success. The stored voice is the requested one.
    """
    c = X.content_jobs(spark, sf_dir)
    return _outcomes(spark, sf_dir, c, c.where(_waits()))


def _waits() -> Column:
    return ~F.col("is_processed") & ~F.col("is_processing")


def _outcomes(spark: SparkSession, sf_dir: str, c: DataFrame, to_run: DataFrame) -> DataFrame:
    """The content rows ``c`` after the jobs ``to_run`` (some of them) have run."""
    run = page_jobs(spark, sf_dir, to_run.select(F.col("id").alias("page_id")))
    res = run.select(F.col("content_id").alias("id"), F.col("title").alias("new_title"), "original_text", "processed_text",
                     F.col("word_count").alias("new_words"), F.col("error").alias("new_error"), F.lit(True).alias("ran"))
    j = c.join(res, "id", "left")
    ran = F.coalesce("ran", F.lit(False))
    extracted = ran & S.truthy(F.col("original_text"))
    ok = ran & F.col("new_error").isNull()
    out = j.select(
        "id",
        (ran | F.col("is_processed")).alias("is_processed"),
        (~ran & F.col("is_processing")).alias("is_processing"),
        F.when(ran, F.col("new_error")).otherwise(F.col("error")).alias("error"),
        F.when(extracted, F.col("new_title")).otherwise(F.col("title")).alias("title"),
        F.when(extracted, F.col("original_text")).alias("original_text"),
        F.when(extracted, F.col("processed_text")).alias("processed_text"),
        F.when(extracted, F.col("new_words")).otherwise(F.col("word_count")).alias("word_count"),
        F.when(extracted, content_hash(F.col("url"), F.col("original_text"))).alias("content_hash"),
        F.when(ok, F.concat(F.lit(AUDIO_DIR), S.output_name(F.col("url")))).otherwise(F.col("file_path")).alias("file_path"),
        F.when(ok, seconds(F.col("new_words"))).otherwise(F.col("duration")).alias("duration"),
        F.when(ok, S.requested_voice(F.col("voice"))).otherwise(F.col("voice")).alias("voice"))
    return out.select("*", S.content_status(F.col("is_processed"), F.col("is_processing"), F.col("error")).alias("status"))


def _stored_content(spark: SparkSession, sf_dir: str) -> str:
    """The folder of a content table to which rows were added and whose waiting jobs were marked, a version per write.

    Version 0 holds the rows of no feed, as written before the feed column existed; version 1
    adds the entries of feeds; version 2 marks every waiting job as taken.
    """
    path = os.path.join(ensure_checkpoint_dir(spark), "readaloud-content", uuid.uuid4().hex)
    c = X.content_jobs(spark, sf_dir)
    write_version(c.where(F.col("feed_id").isNull()).drop("feed_id"), path, 0)
    write_version(c.where(F.col("feed_id").isNotNull()), path, 1)
    waiting = current(spark, path, CONTENT, upto=1).where(_waits()).drop("version")
    write_version(waiting.withColumn("is_processing", F.lit(True)), path, 2)
    return path


def content_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The processing marks: a stored row for every job that was taken, beside the waiting row it replaces."""
    rows = read_versions(spark, _stored_content(spark, sf_dir), CONTENT)
    marks = rows.where("version = 2").select("id", "url", "version", "is_processed", "is_processing", "error", _status(rows).alias("status"))
    before = rows.where("version < 2").select("id", F.col("version").alias("replaces"), _status(rows).alias("status_before"))
    return marks.join(before, "id")


def content_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored content table after the marked jobs have run: the latest version of every row."""
    path = _stored_content(spark, sf_dir)
    taken = current(spark, path, CONTENT, upto=2).where("version = 2").drop("version")
    ran = _outcomes(spark, sf_dir, taken.drop("original_text", "processed_text"), taken).drop("status")
    kept = [n for n in taken.columns if n not in ran.columns]
    write_version(taken.select("id", *kept).join(ran, "id"), path, 3)
    rows = current(spark, path, CONTENT)
    return rows.select("id", "url", "feed_id", "user_id", "version", "is_processed", "is_processing", "error", "title", "original_text",
                       "processed_text", "word_count", "content_hash", "file_path", "duration", "voice", _status(rows).alias("status"))


def request_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON request bodies -> accepted request or error message, with the URL lookup."""
    e = read_table(spark, sf_dir, "events", "event_id")
    k = F.col("event_id")
    url = X.submission_url(k)
    body = (F.when(k % 10 == 0, F.lit("{bad json"))
            .when(k % 9 == 0, F.to_json(F.struct(X.voice_by(k).alias("voice"))))
            .when(k % 7 == 0, F.to_json(F.struct(F.lit("not a url").alias("url"))))
            .when(k % 11 == 0, F.lit('{"url": null}'))
            .otherwise(F.to_json(F.struct(url.alias("url"), X.voice_by(k).alias("voice")))))
    req = e.select(k.alias("request_id"), body.alias("body"))
    parsed = req.select("request_id", F.from_json("body", "url string, voice string").alias("j"),
                        F.array_contains(F.json_object_keys("body"), F.lit("url")).alias("given"))
    p = parsed.select("request_id", F.col("j.url").alias("url"), F.col("j.voice").alias("voice"), "given")
    # a body with a null url names the field, so it is invalid and not missing
    msg = (F.when(~F.coalesce("given", F.lit(False)), F.lit(URL_MISSING))
           .when(F.col("url").isNull(), F.lit(URL_INVALID))
           .when(~is_valid_url(F.col("url")), F.lit(URL_INVALID)))
    p = p.select("request_id", "url", S.requested_voice(F.col("voice")).alias("voice"), msg.alias("message"))
    first = first_per_key(X.content_log(spark, sf_dir), "url", "id", ["id"])
    j = p.join(first, "url", "left")
    return j.select("request_id", F.when(F.col("message").isNull(), F.lit("ok")).otherwise(F.lit("error")).alias("status"),
                    "message", "url", "voice", F.when(F.col("message").isNull(), F.col("id")).alias("content_id"))


def request_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form-encoded submissions -> what the form page does with them, and the records that are no form."""
    e = read_table(spark, sf_dir, "events", "event_id")
    k = F.col("event_id")
    url, voice = F.url_encode(X.submission_url(k)), X.voice_by(k)
    name = F.concat(F.lit("na+me+%26+m%C3%A9+50%+"), k.cast("string"))
    body = (F.when(k % 10 == 0, F.lit("no form at all"))
            .when(k % 9 == 0, F.concat(F.lit("voice="), F.coalesce(voice, F.lit(""))))
            .when(k % 7 == 0, F.lit("url=not+a+url&voice=x"))
            .when(k % 11 == 0, F.concat(F.lit("url=&url="), url))
            .when(k % 13 == 0, F.concat(F.lit("url="), url, F.lit("&u%72l=second&note="), name))
            .otherwise(F.concat(F.lit("note="), name, F.lit("&url="), url, F.lit("&voice="), F.coalesce(voice, F.lit("")), F.lit("&voice=z"))))
    r = e.select(k.alias("request_id"), body.alias("body"))
    p = r.select("request_id", is_form(F.col("body")).alias("_form"), form_field(F.col("body"), "url").alias("url"),
                 form_field(F.col("body"), "voice").alias("voice"), form_field(F.col("body"), "note").alias("note"), "body")
    status = F.when(~F.col("_form"), "corrupt").when(~S.truthy(F.col("url")) | ~is_valid_url(F.col("url")), "rejected").otherwise("accepted")
    return p.select("request_id", status.alias("status"), F.when(F.col("_form"), F.col("url")).alias("url"),
                    F.when(F.col("_form"), S.requested_voice(F.col("voice"))).alias("voice"), "note", F.when(~F.col("_form"), F.col("body")).alias("corrupt_record"))


def url_domain_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read_table(spark, sf_dir, "pages", "url")
    return p.groupBy(domain(F.col("url")).alias("domain")).agg(F.count(F.lit(1)).alias("n_pages"))


def url_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read_table(spark, sf_dir, "pages", "page_id", "url")
    extra = spark.createDataFrame([(-(i + 1), u) for i, u in enumerate(BAD_URLS)], "page_id long, url string")
    u = p.unionByName(extra)
    return u.select("page_id", "url", domain(F.col("url")).alias("netloc"),
                    is_valid_url(F.col("url")).alias("valid"), is_http_url(F.col("url")).alias("valid_http"),
                    matches_url_pattern(F.col("url")).alias("valid_pattern"))



def content_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status requests by content id, in bulk: found flag, status, or not-found.

    Request ids come from events (``event_id % 300``), so some name rows that
    do not exist; those answer ``not_found`` instead of failing the batch.
    """
    e = read_table(spark, sf_dir, "events", "event_id")
    req = e.select(F.col("event_id").alias("request_id"), (F.col("event_id") % 300).alias("content_id"))
    c = X.content_jobs(spark, sf_dir).select(F.col("id").alias("content_id"), "is_processed", "is_processing", "error")
    j = req.join(c, "content_id", "left")
    found = F.col("is_processed").isNotNull()
    st = S.content_status(F.col("is_processed"), F.col("is_processing"), F.col("error"))
    return j.select("request_id", "content_id", found.alias("found"),
                    F.when(found, st).otherwise(F.lit("not_found")).alias("status"))


def user_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user: content rows, completed ones and subscribed feeds (both one-to-many sides)."""
    c = X.content_jobs(spark, sf_dir).where(F.col("user_id").isNotNull())
    per_c = c.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n_contents"),
        F.count(F.when(F.col("is_processed") & ~S.truthy(F.col("error")), 1)).alias("n_completed"))
    per_f = X.feeds(spark, sf_dir).groupBy("user_id").agg(F.count(F.lit(1)).alias("n_feeds"))
    u = X.users(spark, sf_dir).select(F.col("id").alias("user_id"), "username")
    j = u.join(per_c, "user_id", "left").join(per_f, "user_id", "left")
    zero = F.lit(0).cast("bigint")
    return j.select("user_id", "username", F.coalesce("n_contents", zero).alias("n_contents"),
                    F.coalesce("n_completed", zero).alias("n_completed"), F.coalesce("n_feeds", zero).alias("n_feeds"))


def quota_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests, admitted and rejected per client under each of the three ceilings.

    Requests are counted once per client and minute; hours and days are
    sums of those counts, so the events are scanned and shuffled once.
    """
    from ..constants import RATE_API_SUBMIT, RATE_DEFAULT, RATE_WEB_SUBMIT
    s = X.submissions(spark, sf_dir).select("client", F.date_trunc("minute", "ts").alias("minute"))
    per_minute = s.groupBy("client", "minute").agg(F.count(F.lit(1)).alias("n"))
    ceilings = (("web", RATE_WEB_SUBMIT), ("api", RATE_API_SUBMIT), ("default", RATE_DEFAULT))
    spread_out = F.explode(F.array(*[F.struct(
        F.lit(name).alias("ceiling"), F.lit(limit).cast("bigint").alias("limit"),
        F.date_trunc(period.split()[1], "minute").cast("timestamp_ntz").alias("window_start"))
        for name, (limit, period) in ceilings])).alias("w")
    g = per_minute.select("client", "n", spread_out).groupBy("w.ceiling", "client", "w.window_start", "w.limit").agg(
        F.sum("n").alias("n_requests"))
    return g.select("ceiling", "client", "window_start", "n_requests", F.least("n_requests", "limit").alias("n_admitted"),
                    F.greatest(F.col("n_requests") - F.col("limit"), F.lit(0).cast("bigint")).alias("n_rejected"))


def quota_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The add-feed ceiling on bursts: a year's requests for one address are taken to fall into one minute."""
    from ..constants import RATE_ADD_FEED
    from ..operators.jobs import window_counts
    s = X.submissions(spark, sf_dir).select(F.col("url").alias("client"), F.date_trunc("year", "ts").cast("timestamp_ntz").alias("ts"))
    limit, period = RATE_ADD_FEED
    return window_counts(s, "client", "ts", limit, period).select(
        "client", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n_requests", "n_admitted", "n_rejected")
