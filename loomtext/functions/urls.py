"""URL predicates and parts as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from loomtext.functions.text import SPACE

_HEAD = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?"
#: Fixed lists: extensions of media files, hosts of podcasts, of short messages and of their mirrors.
MEDIA_EXTENSIONS = ("mp4", "mov", "m4v", "mkv", "webm", "mpeg", "mpg", "avi", "wmv", "flv", "mp3", "m4a", "wav", "flac", "aac", "ogg", "opus", "aiff", "wma")
PODCAST_HOSTS = ("spotify.com", "podcasts.apple.com", "podchaser.com", "podbean.com", "buzzsprout.com", "spreaker.com", "simplecast.com", "rss.com", "libsyn.com", "omny.fm", "acast.com", "transistor.fm", "captivate.fm", "soundcloud.com", "ivoox.com", "iheart.com", "megaphone.fm", "pca.st", "player.fm", "castbox.fm")
MESSAGE_HOSTS = ("x.com", "twitter.com", "mobile.twitter.com")
MIRROR_HOSTS = ("nitter.net", "nitter.poast.org", "nitter.catsarch.com", "nitter.privacydev.net", "nitter.1d4.us")
PAGE_EXTENSIONS = ("html", "htm", "php", "asp", "aspx")


def host(url: Column) -> Column:
    """Lower-cased host, null if the URL has none."""
    return F.nullif(F.lower(F.regexp_extract(url, _HEAD + r"(\[[^\]]*\]|[^/?#:]*)", 1)), F.lit(""))


def bare_host(url: Column) -> Column:
    return F.regexp_replace(host(url), r"^www\.", "")


def path(url: Column) -> Column:
    found = F.regexp_extract(url, _HEAD + r"[^/?#]*([^?#]*)", 1)
    return F.when(host(url).isNotNull(), F.when(found == "", "/").otherwise(found))


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*(\?[^#]*)", 1)


def parameter(url: Column, name: str) -> Column:
    """First value of a query parameter, decoded and trimmed; null if absent or blank."""
    raw = F.regexp_extract(query(url), rf"[?&]{name}=([^&]*)", 1)
    return F.nullif(F.trim(F.coalesce(F.try_url_decode(raw), raw)), F.lit(""))


def _on(name: Column, suffix: str) -> Column:
    return (name == suffix) | F.endswith(name, F.lit(f".{suffix}"))


def _yes(test: Column) -> Column:
    return F.coalesce(test, F.lit(False))


def is_video_host(url: Column) -> Column:
    """By host; a string that is no URL counts if it names one."""
    by_host = _on(host(url), "youtube.com") | (host(url) == "youtu.be")
    return F.when(host(url).isNotNull(), by_host).otherwise(_yes(F.lower(url).rlike(r"youtube\.com|youtu\.be")))


def is_video_page(url: Column) -> Column:
    p = path(url)
    on_site = F.when(p == "/watch", parameter(url, "v").isNotNull()).otherwise(p.rlike("^/(shorts|live|embed|v)/"))
    return _yes(F.when(host(url) == "youtu.be", p.rlike("^/*[^/]")).when(_on(host(url), "youtube.com"), on_site))


def _id(text: Column) -> Column:
    return F.when(text.rlike(r"^[a-zA-Z0-9_-]{11}\z"), text)


def _direct_id(url: Column) -> Column:
    p = path(url)
    on_site = F.when(F.startswith(p, F.lit("/watch")), F.coalesce(_id(parameter(url, "v")), _id(parameter(url, "vi"))))
    on_site = on_site.when(p.rlike("^/(shorts|live|embed|v)/"), _id(F.regexp_extract(p, "^/+[^/]+/+([^/]+)", 1)))
    return F.when(host(url) == "youtu.be", _id(F.regexp_extract(p, "^/*([^/]+)", 1))).when(_on(host(url), "youtube.com"), on_site)


def _followed(url: Column) -> Column:
    """Where a redirecting link points, else the URL."""
    raw = F.coalesce(*(parameter(url, n) for n in ("u", "url", "q")))
    nested = F.when(raw.rlike(_HEAD), raw).otherwise(F.concat(F.regexp_extract(url, r"^[^/?#]*//[^/?#]*", 0), F.regexp_replace(raw, "^/*", "/")))
    return F.when(_on(host(url), "youtube.com") & path(url).rlike("^/(attribution_link|redirect)"), nested).otherwise(url)


def video_id(url: Column, depth: int = 2) -> Column:
    """The eleven-character id; redirecting links are followed ``depth`` times.
    The URL is bound to a lambda's variable at each step, so the expression grows
    with the depth and not by its power."""
    hops = F.transform(F.array(url), lambda u: u)
    for _ in range(depth):
        hops = F.transform(hops, _followed)
    return F.get(F.transform(hops, _direct_id), F.lit(0))


def canonical_video_url(url: Column) -> Column:
    return F.concat(F.lit("https://www.youtube.com/watch?v="), video_id(url))


def is_direct_media(url: Column) -> Column:
    return _yes(url.rlike(rf"(?i)\.({'|'.join(MEDIA_EXTENSIONS)})(\?|#|\z)"))


def is_media_extension(extension: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(extension), r"^\.", "")).isin(*MEDIA_EXTENSIONS)


def is_podcast_host(url: Column) -> Column:
    name = bare_host(url)
    hit = F.startswith(name, F.lit("music.amazon.")) & F.contains(path(url), F.lit("/podcasts/"))
    for suffix in PODCAST_HOSTS:
        hit = hit | _on(name, suffix)
    return _yes(hit)


def is_podcast_type(kind: Column) -> Column:
    low = F.lower(kind)
    return _yes(F.contains(low, F.lit("podcast")) | low.isin("audioobject", "episode", "radioepisode", "musicrecording"))


def spotify_episode_id(url: Column) -> Column:
    found = F.regexp_extract(path(url), "/episode/+([^/]+)", 1)
    return F.when(F.endswith(bare_host(url), F.lit("spotify.com")) & found.rlike(r"^[A-Za-z0-9]+\z"), found)


def apple_podcast_ids(url: Column) -> Column:
    """struct(show, episode) or null."""
    show = F.nullif(F.regexp_extract(path(url), r"/id(\d+)(?:/|\z)", 1), F.lit(""))
    raw = parameter(url, "i")
    return F.when((bare_host(url) == "podcasts.apple.com") & show.isNotNull(), F.struct(show.alias("show"), F.when(raw.rlike(r"^\d+\z"), raw).alias("episode")))


def is_message_status(url: Column) -> Column:
    return _yes(bare_host(url).isin(*MESSAGE_HOSTS) & path(url).rlike(r"/status/\d+"))


def is_message_broadcast(url: Column) -> Column:
    return _yes(bare_host(url).isin(*MESSAGE_HOSTS) & path(url).rlike(r"(?i)^/i/broadcasts/[^/]+"))


def message_id(text: Column) -> Column:
    """A run of digits, or that of a status URL."""
    plain = F.trim(text)
    return F.when(plain.rlike(r"^\d+\z"), plain).when(is_message_status(plain), F.regexp_extract(path(plain), r"/status/(\d+)", 1))


def prefers_url_mode(url: Column) -> Column:
    return is_video_page(url) | is_message_status(url) | is_message_broadcast(url) | is_direct_media(url) | is_podcast_host(url)


def path_hash(text: Column) -> Column:
    """Wrapping 32-bit hash, h * 31 + code, of each character."""
    codes = F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("long"))
    wrap = lambda h: F.pmod(h + 2147483648, F.lit(4294967296)) - 2147483648
    return F.aggregate(F.when(text == "", F.array().cast("array<bigint>")).otherwise(codes), F.lit(0).cast("long"), lambda h, c: wrap(h * 31 + c))


def mirror_urls(url: Column) -> Column:
    """The URL on each mirror host, beginning with the one its hash picks; empty for other hosts."""
    rest = F.concat(path(url), query(url))
    n = len(MIRROR_HOSTS)
    at = (F.abs(path_hash(rest)) % n).cast("int")
    hosts = F.array(*map(F.lit, MIRROR_HOSTS * 2))
    fragment = F.regexp_extract(url, r"#.*$", 0)
    out = F.transform(F.slice(hosts, at + 1, F.lit(n)), lambda h: F.concat(F.lit("https://"), h, rest, fragment))
    return F.when(_yes(bare_host(url).isin(*MESSAGE_HOSTS)), out).otherwise(F.array().cast("array<string>"))


def is_blocked_message(text: Column) -> Column:
    return _yes(text.rlike(r"(?i)something went wrong|try again|privacy related extensions|please disable them and try again"))


def is_challenge_page(html: Column) -> Column:
    return _yes(F.contains(F.lower(html), F.lit("anubis")))


def repair(url: Column) -> Column:
    """Backslashes before ``? & =`` go, plain or percent-encoded."""
    return F.regexp_replace(F.regexp_replace(url, r"\\([?&=])", "$1"), r"(?i)%5c([?&=])", "$1")


def urls_in(text: Column) -> Column:
    """http(s) URLs in a text, without the punctuation around them: closing
    brackets go where they have no partner in the URL."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(rf"https?://[^{SPACE}]+"), F.lit(0)), trim_punctuation), lambda u: u != "")


def trim_punctuation(url: Column) -> Column:
    count = lambda u, c: F.length(u) - F.length(F.replace(u, F.lit(c), F.lit("")))
    state = lambda u, done: F.struct(u.alias("u"), done.alias("done"))

    def step(s, _):
        u = s["u"]
        last = F.substring(u, -1, 1)
        keep = ~last.rlike("[)\\].,;:'\">}”’»]") | (u == "")
        for opening, closing in ("()", "[]", "{}"):
            keep = keep | ((last == closing) & (count(u, closing) <= count(u, opening)))
        done = s["done"] | keep
        return state(F.when(done, u).otherwise(F.substring(u, F.lit(1), F.length(u) - 1)), done)

    turns = F.sequence(F.lit(1), F.greatest(F.length(url), F.lit(1)))
    trimmed = F.aggregate(turns, state(F.trim(url), F.lit(False)), step, lambda s: s["u"])
    return F.regexp_replace(trimmed, "^[('\"<{\\[“‘«]+", "")


def input_target(text: Column) -> Column:
    """struct(kind, value): stdin for ``-``, file for file: URLs and paths, else
    the last URL that the text holds; kind is null for anything else."""
    plain = F.trim(text)
    last = F.element_at(urls_in(plain), -1)
    pair = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    out = F.when(plain == "-", pair("stdin", F.lit(None).cast("string"))).when(plain.rlike("(?i)^file://"), pair("file", F.coalesce(F.try_url_decode(F.regexp_extract(plain, "(?i)^file://[^/]*(/.*)$", 1)), plain)))
    return out.when(F.size(urls_in(plain)) > 0, pair("url", repair(last))).when(plain.rlike("^[/.~]"), pair("file", plain)).otherwise(pair(None, F.lit(None).cast("string")))


def path_extension(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(path(url), r"[^/]\.([A-Za-z0-9]+)\z", 1)), F.lit(""))


def media_type(header: Column) -> Column:
    return F.nullif(F.lower(F.trim(F.split_part(header, F.lit(";"), F.lit(1)))), F.lit(""))


def url_kind(url: Column, content_type: Column, disposition: Column, head: Column) -> Column:
    """website or asset: by extension, then media type, attachment, first bytes."""
    kind = media_type(content_type)
    page = head.rlike(r"(?i)^\s*<(!doctype html|html|head)")
    out = F.when(path_extension(url).isNotNull() & ~path_extension(url).isin(*PAGE_EXTENSIONS), "asset")
    out = out.when(F.lower(disposition).rlike(r"\battachment\b"), "asset").when(kind.isin("text/html", "application/xhtml+xml"), "website").when(kind.isNotNull(), "asset")
    return out.when(page, "website").otherwise("website")


def disposition_filename(header: Column) -> Column:
    wide = F.regexp_extract(header, r"(?i)filename\*\s*=\s*([^;]+)", 1)
    raw = F.trim(F.when(wide != "", wide).otherwise(F.regexp_extract(header, r"(?i)filename\s*=\s*([^;]+)", 1)))
    value = F.regexp_replace(F.regexp_replace(raw, r"(?i)^utf-8''", ""), r'^"|"\z', "")
    return F.nullif(F.coalesce(F.try_url_decode(F.replace(value, F.lit("+"), F.lit("%2B"))), value), F.lit(""))


def mime_of(head: Column, header: Column, name: Column) -> Column:
    """Media type by first bytes, then header (if it says anything), then extension."""
    magic = F.hex(F.substring(head, 1, 12))
    first = F.when(magic.rlike("^25504446"), "application/pdf").when(magic.rlike("^89504E47"), "image/png").when(magic.rlike("^FFD8FF"), "image/jpeg").when(magic.rlike("^47494638"), "image/gif").when(magic.rlike("^504B0304"), "application/zip").when(magic.rlike("^.{8}66747970"), "video/mp4").when(magic.rlike("^494433|^FFFB"), "audio/mpeg")
    said = F.when(media_type(header) != "application/octet-stream", media_type(header))
    ext = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)\z", 1))
    known = {"txt": "text/plain", "md": "text/markdown", "json": "application/json", "xml": "application/xml", "csv": "text/csv", "html": "text/html", "pdf": "application/pdf", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp", "mp3": "audio/mpeg", "m4a": "audio/mp4", "mp4": "video/mp4", "zip": "application/zip"}
    by_name = F.create_map(*(F.lit(x) for pair in known.items() for x in pair))[ext]
    return F.coalesce(first, said, by_name, F.lit("application/octet-stream"))


def is_text_type(kind: Column) -> Column:
    return _yes(F.startswith(kind, F.lit("text/")) | kind.isin("application/json", "application/xml", "application/x-yaml", "application/yaml", "application/toml", "application/javascript", "application/x-javascript"))


def is_archive_type(kind: Column) -> Column:
    return _yes(kind.isin("application/zip", "application/x-zip-compressed", "application/x-7z-compressed", "application/x-rar-compressed", "application/x-tar", "application/gzip", "application/x-gzip"))


def is_convertible_type(kind: Column) -> Column:
    return _yes(kind.isin("application/pdf", "application/msword", "application/vnd.ms-excel", "application/vnd.ms-powerpoint", "application/rtf") | F.startswith(kind, F.lit("application/vnd.openxmlformats-officedocument.")))


def timestamp_link(url: Column, seconds: Column) -> Column:
    """The URL at a time, for hosts that know one; null for others."""
    at = F.floor(seconds).cast("long").cast("string")
    other = F.regexp_replace(F.regexp_replace(url, r"#.*$", ""), r"([?&])t=[^&]*&?", "$1")
    other = F.regexp_replace(other, r"[?&]\z", "")
    joined = F.concat(other, F.when(F.contains(other, F.lit("?")), F.lit("&")).otherwise(F.lit("?")), F.lit("t="), at)
    return F.when(video_id(url).isNotNull(), F.concat(canonical_video_url(url), F.lit("&t="), at, F.lit("s"))).when(_on(host(url), "vimeo.com"), F.concat(F.regexp_replace(url, r"#.*$", ""), F.lit("#t="), at, F.lit("s"))).when(_on(host(url), "loom.com") | _on(host(url), "dropbox.com"), joined)
