"""From pages to budgeted rows: the extraction plan.

A page's tree is parsed once, in one Arrow UDF; everything else is column
expressions over what it returns. Strategies are branches of filters, not of a
CASE, so the UDF never sees pages that need no tree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loomtext.functions import clock, dom, services, text as T, urls

#: Thresholds of the content decisions, in characters; fixed values.
THIN_CONTENT, LARGE_PAGE, LEAST_READABLE, LEAST_DESCRIPTION, RELATIVE = 200, 5000, 200, 120, 0.6


def strategy(url: Column) -> Column:
    """How a URL's content is got."""
    out = F.when(urls.spotify_episode_id(url).isNotNull(), "podcast_episode").when(urls.apple_podcast_ids(url).isNotNull(), "podcast_show")
    out = out.when(urls.is_message_broadcast(url), "broadcast").when(urls.is_direct_media(url), "media").when(urls.is_video_page(url), "video")
    return out.when(urls.is_message_status(url), "message").otherwise("html")


def transcript_provider(url: Column, page: Column) -> Column:
    feed = F.coalesce(F.lower(F.substring(page, 1, 4096)).rlike("<rss|<feed"), F.lit(False)) | F.coalesce(F.lower(url).rlike(r"rss|podcast|feed\.xml"), F.lit(False))
    return F.when(urls.is_video_host(url), "youtube").when(~urls.is_direct_media(url) & (urls.is_podcast_host(url) | feed), "podcast").otherwise("generic")


def skips_probe(page: Column) -> Column:
    """No sign of media in a page: looking for a transcript is not worth it."""
    marks = F.lower(page).rlike("<video|<audio|<track|og:video|og:audio|youtube\\.com/embed|youtu\\.be/")
    return ~F.coalesce(marks, F.lit(False))


def needs_scraper(plain: Column, content: Column, html_chars: Column) -> Column:
    """A page that says it is blocked, or a large one of which little was got."""
    return F.coalesce(F.lower(plain).rlike(services.WALLS), F.lit(False)) | ((F.length(content) < THIN_CONTENT) & (html_chars >= LARGE_PAGE))


def prefers_readable(base: Column, readable: Column) -> Column:
    n, m = F.length(readable), F.length(base)
    return (n >= LEAST_READABLE) & ((m < THIN_CONTENT) | (n >= m * RELATIVE))


def prefers_description(description: Column, content: Column, podcast: Column, readable: Column) -> Column:
    n, m = F.length(description), F.length(content)
    return F.coalesce((n >= LEAST_DESCRIPTION) & (podcast | (~readable & ((m < THIN_CONTENT) | (n >= m * RELATIVE)))), F.lit(False))


def base_content(source: Column, said: Column) -> Column:
    """What was said, if anything, before what the source says."""
    return F.when(F.coalesce(said, F.lit("")) != "", F.concat(F.lit("Transcript:\n"), said)).otherwise(source)


def bypasses_summary(chars: Column, tokens: Column, target: int, limit: int, forced: Column, media: Column) -> Column:
    """Short enough to be its own summary."""
    return (chars <= target) & (tokens <= limit) & ~forced & ~media


#: What a summary is to be like, in characters and tokens; defaults.
TARGET_CHARS, TOKEN_LIMIT = 1500, 8192


def extract(pages: DataFrame, budget: int = 8000, url_col: str = "url", html_col: str = "html", transcript_col: str | None = None, segments_col: str | None = None, target: int = TARGET_CHARS, limit: int = TOKEN_LIMIT) -> DataFrame:
    """``pages`` without their HTML and with strategy, title, description, site
    name, content within ``budget``, its counts, video and decisions: whether a
    scraper is needed, there is only a video, looking for a transcript is worth it
    (``probe``) and the content is short enough to be its own summary (``short``).
    What was said, by its segments' times (array of startMs, text) or as one text,
    goes before what the page says."""
    url, rest = F.col(url_col), [c for c in pages.columns if c not in (html_col, transcript_col, segments_col)]
    said = F.col(transcript_col) if transcript_col else F.lit(None).cast("string")
    timed = F.col(segments_col) if segments_col else F.lit(None).cast("array<struct<startMs:bigint,text:string>>")
    page = F.col(html_col)
    rows = pages.withColumns({"strategy": strategy(url), "said_": T.normalize_for_prompt(F.coalesce(clock.timed_text(timed), said))})
    # what a page is itself its strategy says already
    rows = rows.withColumn("probe", (F.col("strategy") != "html") | ~skips_probe(page))
    kept_ = ["strategy", "said_", "probe"]
    read = rows.where("strategy = 'html'").withColumn("facts_", dom.facts(F.col(html_col), url))
    # each step's columns occur more than once in the next, so Spark computes them once
    read = read.select(
        *rest, *kept_, "facts_.video_url", F.col("facts_.site_name").alias("site_name"), F.col("facts_.article").isNotNull().alias("article_"),
        T.first_text(F.col("facts_.ld_title"), F.col("facts_.title")).alias("title"), T.first_text(F.col("facts_.ld_title"), F.col("facts_.read_title")).alias("heading_"), T.first_text(F.col("facts_.ld_description"), F.col("facts_.description")).alias("description"),
        T.normalize_for_prompt(F.array_join("facts_.segments", "\n")).alias("own_"), T.normalize_for_prompt(F.col("facts_.readable")).alias("readable_"),
        (urls.is_podcast_type(F.col("facts_.ld_type")) | urls.is_podcast_host(url)).alias("podcast_"), F.col("facts_.plain").alias("plain_"), F.col("facts_.html_chars").alias("chars_"),
    )
    own, readable, heading = F.col("own_"), F.col("readable_"), F.col("heading_")
    read = read.withColumns({"described_": T.normalize_for_prompt(F.col("description")), "use_": F.coalesce(prefers_readable(own, readable) & ~F.col("article_"), F.lit(False))})
    read = read.withColumn("chosen_", F.when(F.col("use_"), readable).otherwise(own))
    described = prefers_description(F.col("described_"), F.col("chosen_"), F.col("podcast_"), F.col("use_"))
    read = read.select(
        *rest, *kept_, "title", "description", "site_name", F.when(described, F.col("described_")).otherwise(T.strip_leading_title(F.col("chosen_"), heading)).alias("base_"),
        "video_url", needs_scraper(F.col("plain_"), own, F.col("chars_")).alias("needs_scraper"),
    )
    none = F.lit(None).cast("string")
    other = rows.where("strategy <> 'html'").select(*rest, *kept_, none.alias("title"), none.alias("description"), urls.bare_host(url).alias("site_name"), F.lit("").alias("base_"), urls.canonical_video_url(url).alias("video_url"), F.lit(False).alias("needs_scraper"))
    out = read.unionByName(other).withColumn("b_", T.content_budget(base_content(F.col("base_"), F.col("said_")), budget))
    out = out.withColumn("video_only_", (F.length("b_.content") < THIN_CONTENT) & F.col("video_url").isNotNull())
    media = F.col("video_only_") | F.col("strategy").isin("media", "podcast_episode", "podcast_show")
    short = bypasses_summary(F.length("b_.content"), T.token_estimate(F.col("b_.content")), target, limit, F.lit(False), media)
    return out.select(*rest, "strategy", "title", "description", "site_name", "b_.*", "video_url", "needs_scraper", F.col("video_only_").alias("is_video_only"), "probe", short.alias("short"))


def host_report(pages: DataFrame) -> DataFrame:
    """Pages, words and truncations by site, the wordiest first."""
    rows = extract(pages)
    return rows.groupBy("site_name").agg(F.count("*").alias("pages"), F.sum("word_count").alias("words"), F.count_if("truncated").alias("truncated")).orderBy(F.desc("words"), "site_name")
