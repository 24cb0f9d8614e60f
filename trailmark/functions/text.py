"""Scalar text functions as Column expressions; all stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accented Latin letters and the plain ones that stand for them in keys.
ACCENTED = "áàâãäåéèêëíìîïóòôõöúùûüçñýÿÁÀÂÃÄÅÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÇÑÝ"
PLAIN = "aaaaaaeeeeiiiiooooouuuucnyyAAAAAAEEEEIIIIOOOOOUUUUCNY"
#: Hosts that only the writer's own machine knows.
LOCAL_HOST = r"^(https?://(localhost|127\.0\.0\.1|0\.0\.0\.0)|file:)"
#: Cells of the historical sheet that mean nothing.
SHEET_NULLS = ("", "-", "n/a", "?", "sumiu", "#DIV/0!", "#REF!", "#N/A")
#: The space separators (category Zs), which are what SQL's trim takes off.
SPACES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
#: The archive's media by extension.
IMAGE_EXT = ("jpg", "jpeg", "png", "heic", "heif", "webp", "gif", "tif", "tiff")
VIDEO_EXT = ("mp4", "mov", "m4v", "avi", "webm", "3gp", "mkv")
AUDIO_EXT = ("m4a", "mp3", "opus", "ogg", "wav", "aac")


def null_if_no_match(found: Column) -> Column:
    return F.when(found != "", found)


def extract(text: Column, pattern: str, group: int = 1) -> Column:
    """The group, or null where the pattern or the group doesn't match."""
    return null_if_no_match(F.regexp_extract(text, pattern, group))


def without_accents(text: Column) -> Column:
    return F.translate(text, ACCENTED, PLAIN)


def norm_key(text: Column) -> Column:
    """Lower-case letters and digits only; null counts as empty."""
    return F.regexp_replace(F.lower(without_accents(F.coalesce(text, F.lit("")))), "[^a-z0-9]+", "")


def route_slug(name: Column) -> Column:
    """Words joined by hyphens, at most 60 characters, no hyphen at the ends."""
    hyphened = F.regexp_replace(F.lower(without_accents(F.coalesce(name, F.lit("")))), "[^a-z0-9]+", "-")
    return F.btrim(F.substring(F.btrim(hyphened, F.lit("-")), 1, 60), F.lit("-"))


def iri_tail(iri: Column) -> Column:
    return F.regexp_extract(iri, r"([^/#]*)$", 1)


def series_label(code: Column) -> Column:
    return F.when(code == "S", F.lit("PH-S")).otherwise(code)


def external_route_id(url: Column, host: str = "routes.example.com") -> Column:
    return extract(url, rf"(?i){host.replace('.', '[.]')}/routes/(\d+)")


def own_route_slug(url: Column, host: str = "example.org") -> Column:
    """The slug of a link to a saved route, on the own host, its subdomains or a local one."""
    link = F.trim(url)
    part = lambda name: F.lower(F.try_parse_url(link, F.lit(name)))
    ours = [(part("HOST") == h) | part("HOST").endswith("." + h) for h in (host, "localhost", "127.0.0.1")]
    steps = F.split(F.regexp_replace(part("PATH"), "/$", ""), "/")
    fits = part("PROTOCOL").isin("http", "https") & (ours[0] | ours[1] | ours[2]) & (F.size(steps) == 3) & (F.get(steps, F.lit(1)) == "route")
    slug = F.get(steps, F.lit(2))
    return F.when(fits & part("QUERY").isNull() & part("REF").isNull() & slug.rlike("^[a-z0-9][a-z0-9-]*$"), slug)


def activity_url(line: Column) -> Column:
    """A recording's URL anywhere in a line."""
    return extract(line, r"(https?://\S*/(?:activities|trips)/\d+)")


def any_route_id(line: Column) -> Column:
    return extract(line, r"/routes/(\d+)")


def is_local_host(url: Column) -> Column:
    return url.rlike(LOCAL_HOST)


#: The series that a folder's name may give.
SERIES = ("PH", "BP", "BT", "SESC", "S")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _stripped(rest: Column) -> Column:
    return F.regexp_replace(rest, r"^\s+", "")


def _taken(rest: Column, kind: str, *known: str) -> Column:
    """token, that of a kind after blanks, or an empty one, and rest, what follows it; if known, one of these."""

    def after(r: Column) -> Column:
        token = F.regexp_extract(r, rf"^\s+({kind})", 1)
        token = F.when(token.isin(*known), token).otherwise("") if known else token
        return F.struct(token.alias("token"), F.when(token != "", F.substr(_stripped(r), F.length(token) + 1)).otherwise(r).alias("rest"))

    return _let(rest, after)


def _without_dash(rest: Column) -> Column:
    return F.when(_stripped(rest).startswith("-"), F.substr(_stripped(rest), F.lit(2))).otherwise(rest)


def parse_folder_name(name: Column) -> Column:
    """date, series, number, sn and title of an archive folder's name; all null if it has no date. What has more
    than 18 digits is no number but part of the title."""
    date = F.substring(name, 1, 10)

    def parts(series: Column, number: Column, sn: Column) -> Column:
        title = F.regexp_replace(_without_dash(sn["rest"]), r"^\s+|\s+$", "")
        return F.struct(date.alias("date"), null_if_no_match(series["token"]).alias("series"), null_if_no_match(number["token"]).cast("long").alias("number"), (sn["token"] != "").alias("sn"), title.alias("title"))

    from_sn = lambda a, b: _let(_taken(b["rest"], r"\w+", "SN"), lambda c: parts(a, b, c))
    from_number = lambda a: _let(_taken(_without_dash(a["rest"]), r"\d{1,18}(?!\d)"), lambda b: from_sn(a, b))
    found = _let(_taken(F.substr(name, F.lit(11)), r"\w+", *SERIES), from_number)
    return F.when(F.translate(date, "0123456789", "0000000000") == "0000-00-00", found)


def is_hash16(text: Column) -> Column:
    return F.coalesce(text.rlike("^[0-9a-f]{16}$"), F.lit(False))


def valid_token(token: Column) -> Column:
    return F.coalesce(token.rlike("^[0-9a-fA-F-]{1,64}$"), F.lit(False))


def stem_hash(stem: Column) -> Column:
    return F.substring(F.md5(stem), 1, 16)


def hamming_hex(a: Column, b: Column) -> Column:
    """Bits in which two strings of 16 hex digits differ; halves, since longs are signed."""
    half = lambda x, k: F.conv(F.substring(x, k, 8), 16, 10).cast("long")
    return sum(F.bit_count(half(a, k).bitwiseXOR(half(b, k))) for k in (1, 9))


#: Words before a contributor's name in the name of a subfolder.
NOISE = ("foto", "fotos", "video", "videos", "vídeo", "vídeos", "midia", "midias", "mídia", "mídias", "registro", "registros", "imagen", "imagens", "arquivo", "arquivos")
#: What a messaging app's copy is called after the app's name.
SHARED_KINDS = ("image", "video", "audio", "ptt")


def contributor_of(name: Column, subfolder: Column) -> Column:
    """Who shared a file: the subfolder's name if there is one, else what precedes the app's own name."""
    own = F.trim(F.substring_index(subfolder, " - ", 1))
    words = F.split(own, r"\s+", 2)
    own = F.when(F.lower(words[0]).isin(*NOISE) & (F.size(words) > 1), F.trim(F.get(words, F.lit(1)))).otherwise(own)
    halves = F.split(name, r"(?i)\s+whatsapp\s+", 2)
    kind = F.lower(F.regexp_extract(F.get(halves, F.lit(1)), r"^\w+", 0))
    sender = F.when(kind.isin(*SHARED_KINDS), null_if_no_match(F.trim(halves[0])))
    return F.when(F.coalesce(subfolder, F.lit("")) != "", null_if_no_match(own)).otherwise(sender)


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^./]+)$", 1))


def media_kind(name: Column) -> Column:
    ext = extension(name)
    return F.when(ext.isin(*IMAGE_EXT), "image").when(ext.isin(*VIDEO_EXT), "video").when(ext.isin(*AUDIO_EXT), "audio")


def is_shared_copy(name: Column) -> Column:
    """Whether a messaging app wrote the file, which strips its metadata."""
    after = F.split(name, r"(?i)\bwhatsapp\s+")
    return F.exists(F.slice(after, 2, F.size(after)), lambda x: F.lower(F.regexp_extract(x, r"^\w+", 0)).isin(*SHARED_KINDS))


def is_media_folder(name: Column) -> Column:
    return norm_key(name).rlike("^(midia.*|fotos|videos|video)$")


def original_ext(mime: Column) -> Column:
    """The extension for an uploaded picture's type; jpg unless it is another known one."""
    found = F.lit("jpg")
    for kind in ("heif", "heic", "png"):
        found = F.when(F.lower(mime).contains(kind), kind).otherwise(found)
    return found


def escape_xml(text: Column) -> Column:
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def unescape_xml(text: Column) -> Column:
    for entity, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return text


def edit_distance_le1(a: Column, b: Column) -> Column:
    """levenshtein() with a threshold gives -1 beyond it."""
    return F.levenshtein(a, b, 1) >= 0


def paragraphs(text: Column) -> Column:
    """The lines of a text without the space separators around them; empty ones are none."""
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x, F.lit(SPACES))), lambda x: x != "")  # F.trim alone would take the index for what to cut


def sheet_value(cell: Column) -> Column:
    """A cell of the historical sheet: null for its ways of saying nothing, without thousands' commas."""
    bare = F.trim(cell)
    return F.when(~bare.isin(*SHEET_NULLS), F.regexp_replace(bare, r"(?<=\d),(?=\d{3})", ""))
