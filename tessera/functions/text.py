"""String, path, JSON and display functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: File classes by extension.
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".gif", ".bmp", ".tga", ".psd", ".hdr", ".heic", ".heif")
VIDEO_EXTENSIONS = (".mp4", ".mov", ".avi", ".mkv", ".mts", ".m2ts", ".mpg", ".mpeg", ".wmv", ".webm", ".m4v", ".3gp")
RAW_EXTENSIONS = (".arw", ".cr2", ".cr3", ".nef", ".nrw", ".orf", ".raf", ".rw2", ".pef", ".dng", ".srw", ".3fr", ".iiq", ".erf", ".mef", ".mos", ".kdc", ".dcr")
COLOR_LABELS = ("Red", "Yellow", "Green", "Blue", "Purple")
#: Makers by what a model begins with or contains; the first that fits holds.
MAKER_RULES = (
    ("SONY", ("ILCE", "ILCA", "DSC", "SLT", "NEX"), ()),
    ("Canon", ("EOS",), ("Canon",)),
    ("NIKON CORPORATION", (), ("NIKON",)),
    ("FUJIFILM", ("X-", "GFX"), ("FUJIFILM",)),
    ("Panasonic", ("DC-", "DMC-"), ("Lumix",)),
    ("OLYMPUS", ("E-M", "E-P", "OM-"), ()),
    ("LEICA", (), ("LEICA",)),
    ("RICOH IMAGING COMPANY, LTD.", ("GR",), ("PENTAX",)),
)
#: Entities and what they stand for, replaced in this order.
ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "))


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ascii_lower(c: Column | str) -> Column:
    """A-Z lower-cased; other letters, accented ones too, stay."""
    return F.translate(_col(c), UPPER, LOWER)


def contains_text(field: Column | str, query: str) -> Column:
    """Case-insensitive (ASCII) substring; an empty field never matches."""
    return (_col(field) != "") & ascii_lower(field).contains(query.translate(str.maketrans(UPPER, LOWER)))


def any_field_contains(fields: list[Column | str], query: str) -> Column:
    found = F.lit(False)
    for field in fields:
        found = found | contains_text(field, query)
    return found


def parent_dir(path: Column | str) -> Column:
    return F.regexp_extract(_col(path), r"^(.*)/[^/]*$", 1)


def file_name(path: Column | str) -> Column:
    return F.regexp_extract(_col(path), r"([^/]*)$", 1)


def extension(path: Column | str) -> Column:
    """With its dot; empty if the name has none or only a leading one."""
    return F.regexp_extract(file_name(path), r"^.+(\.[^.]*)$", 1)


def stem(path: Column | str) -> Column:
    return F.regexp_replace(file_name(path), r"^(.+)\.[^.]*$", "$1")


def sidecar_path(path: Column | str) -> Column:
    return F.concat(parent_dir(path), F.lit("/"), stem(path), F.lit(".xmp"))


def join_path(*parts: Column | str) -> Column:
    """Parts with single slashes between them; empty parts are left out."""
    cols = [_col(p) for p in parts]
    return F.regexp_replace(F.concat_ws("/", *[F.when(c != "", c) for c in cols]), "/+", "/")


def media_class(ext: Column | str) -> Column:
    e = ascii_lower(ext)
    return F.when(e.isin(*IMAGE_EXTENSIONS), "image").when(e.isin(*RAW_EXTENSIONS), "raw").when(e.isin(*VIDEO_EXTENSIONS), "video").otherwise("")


def exact_case_raw(ext: Column | str) -> Column:
    """As the foreign catalog tests it: all upper or all lower case, without the dot."""
    bare = [e[1:] for e in RAW_EXTENSIONS]
    return _col(ext).isin(*bare, *[e.upper() for e in bare])


def maker_of(model: Column | str) -> Column:
    m = _col(model)
    out = F.lit("")
    for maker, starts, parts in reversed(MAKER_RULES):
        fits = F.lit(False)
        for s in starts:
            fits = fits | m.startswith(s)
        for p in parts:
            fits = fits | m.contains(p)
        out = F.when(fits, maker).otherwise(out)
    return out


def color_label(label: Column | str) -> Column:
    return F.when(_col(label).isin(*COLOR_LABELS), _col(label)).otherwise("")


def clean_text(text: Column | str) -> Column:
    """Entities replaced, runs of blanks made one, ends trimmed of spaces."""
    out = _col(text)
    for entity, plain in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(plain))
    return F.trim(F.regexp_replace(out, "[ \t\n\r]+", " "))


def pad_tokens(ids: Column | str, length: int = 64, pad: int = 0, end: int = 1) -> Column:
    """Ids cut to length - 1, an end id, then padding."""
    kept = F.concat(F.slice(_col(ids), 1, length - 1), F.array(F.lit(end)))
    return F.concat(kept, F.array_repeat(F.lit(pad), length - F.size(kept)))


def attention_mask(ids: Column | str, length: int = 64) -> Column:
    n = F.least(F.size(_col(ids)) + 1, F.lit(length))
    return F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), F.lit(length) - n))


def key_value(text: Column | str, key: str) -> Column:
    """The signed decimal after the first place where the key begins a word; if none follows there, null."""
    rest = F.regexp_extract(_col(text), rf"(?s)(?:^|[\n\r\t ]){key}(.*)$", 1)
    return F.regexp_extract(rest, r"^[ \t=]*([+-]?[0-9.]+)", 1).try_cast("double")


def location_of(query: Column | str) -> Column:
    """The last @token of a search text, without the sign; empty if there is none."""
    return F.coalesce(F.element_at(F.regexp_extract_all(_col(query), F.lit(r"(?:^| )@([^ ]+)"), F.lit(1)), -1), F.lit(""))


def text_of(query: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(_col(query), "(^| )@[^ ]*", " "), " +", " "))


def before_space(text: Column | str) -> Column:
    return F.substring_index(_col(text), " ", 1)


def rational(text: Column | str) -> Column:
    """a/b as a double, a plain number as it is, null for a zero or missing denominator."""
    parts = F.split(_col(text), "/")
    a, b = F.get(parts, F.lit(0)).try_cast("double"), F.get(parts, F.lit(1)).try_cast("double")
    return F.when(F.size(parts) == 1, a).otherwise(F.when(b != 0, a / b))


def xmp_coordinate(text: Column | str) -> Column:
    """Degrees and minutes with a hemisphere letter, as 35,41.25894N; 0 if malformed."""
    t = _col(text)
    degrees = F.regexp_extract(t, r"^([0-9]+),([0-9.]+)([NSEW])$", 1).try_cast("double")
    minutes = F.regexp_extract(t, r"^([0-9]+),([0-9.]+)([NSEW])$", 2).try_cast("double")
    sign = F.when(t.endswith("S") | t.endswith("W"), -1.0).otherwise(1.0)
    return F.coalesce(sign * (degrees + minutes / 60.0), F.lit(0.0))


def dms(d_num: Column, d_den: Column, m_num: Column, m_den: Column, s_num: Column, s_den: Column) -> Column:
    """Rational degrees, minutes, seconds as degrees; a part with a zero denominator counts as 0."""
    part = lambda a, b: F.when(b != 0, a / b).otherwise(0.0)
    return part(d_num, d_den) + part(m_num, m_den) / 60.0 + part(s_num, s_den) / 3600.0


def exif_seconds(text: Column | str) -> Column:
    """YYYY:MM:DD HH:MM:SS in the session's zone as epoch seconds; 0 if it cannot be read."""
    return F.coalesce(F.unix_timestamp(F.try_to_timestamp(F.substring(_col(text), 1, 19), F.lit("yyyy:MM:dd HH:mm:ss"))), F.lit(0)).cast("long")


def iso_to_exif(text: Column | str) -> Column:
    t = F.substring(_col(text), 1, 19)
    return F.when(F.length(t) == 19, F.concat(F.replace(F.substring(t, 1, 10), F.lit("-"), F.lit(":")), F.lit(" "), F.substring(t, 12, 8))).otherwise(_col(text))


def date_folder(exif: Column | str) -> Column:
    """YYYY/MM/DD of a capture time, or ``unknown``."""
    t = _col(exif)
    return F.when(t.rlike(r"^\d{4}:\d{2}:\d{2}"), F.concat_ws("/", F.substring(t, 1, 4), F.substring(t, 6, 2), F.substring(t, 9, 2))).otherwise("unknown")


def place_name(city: Column, town: Column, village: Column, county: Column, state: Column, country: Column) -> Column:
    """The first named of four, then state and country, joined by commas and cut at 50 characters."""
    blank = lambda c: F.when(c != "", c)
    text = F.concat_ws(", ", F.coalesce(blank(city), blank(town), blank(village), blank(county)), blank(state), blank(country))
    return F.when(F.length(text) > 50, F.concat(F.substring(text, 1, 50), F.lit("..."))).otherwise(text)


def megabytes(size: Column) -> Column:
    return F.format_string("%.1f MB", size / F.lit(1048576.0))


def coordinates(lat: Column, lon: Column) -> Column:
    side = lambda v, a, b: F.when(v >= 0, a).otherwise(b)
    return F.format_string("%.4f° %s, %.4f° %s", F.abs(lat), side(lat, "N", "S"), F.abs(lon), side(lon, "E", "W"))


def stars(rating: Column) -> Column:
    r = F.least(F.greatest(rating, F.lit(0)), F.lit(5))
    return F.concat(F.repeat(F.lit("*"), r), F.repeat(F.lit("."), 5 - r))


def tags_text(tags: Column | str) -> Column:
    """A JSON array of strings joined by commas; other text as it is."""
    return F.coalesce(F.array_join(F.from_json(_col(tags), "array<string>"), ", "), _col(tags))


def url_encoded(value: Column | str) -> Column:
    """Percent-encoding of all bytes but ASCII letters, digits and ``-_.~``."""
    return F.replace(F.replace(F.replace(F.url_encode(_col(value)), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def xml_unescaped(value: Column | str) -> Column:
    """The five named entities of XML; the ampersand last, so that nothing is read twice."""
    out = _col(value)
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(sign))
    return out
