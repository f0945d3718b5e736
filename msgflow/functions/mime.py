"""Media types: what is authorised, what is known, and what the first bytes say."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The media types in use.
PDF = ("application/pdf",)
IMAGE = ("image/png", "image/jpeg", "image/gif")
AUDIO = ("audio/mpeg", "audio/wav", "audio/x-aiff")
VIDEO = ("video/mp4",)
AUTHORIZED = PDF + IMAGE + AUDIO
KNOWN = AUTHORIZED + VIDEO
UNKNOWN = "unknown"
SIGNATURES = (
    ("25504446", "application/pdf"),
    ("89504E470D0A1A0A", "image/png"),
    ("FFD8FF", "image/jpeg"),
    ("474946383761", "image/gif"),
    ("474946383961", "image/gif"),
    ("494433", "audio/mpeg"),
    ("FFFB", "audio/mpeg"),
)
CONTAINERS = (("52494646", 17, "57415645", "audio/wav"), ("464F524D", 17, "41494646", "audio/x-aiff"), ("", 9, "66747970", "video/mp4"))


def base_type(mime: Column) -> Column:
    """Without parameters, in lower case."""
    return F.lower(F.trim(F.element_at(F.split(mime, ";"), 1)))


def matches(detected: Column, expected: Column) -> Column:
    return F.coalesce(base_type(detected) == base_type(expected), F.lit(False))


def match_type(detected: Column, expected: Column) -> Column:
    """``struct<mime, ok>``: the expected type, and whether the detected one is it."""
    return F.struct(expected.alias("mime"), matches(detected, expected).alias("ok"))


def _among(mime: Column, types: tuple[str, ...]) -> Column:
    return F.coalesce(base_type(mime).isin(*types), F.lit(False))


def is_pdf(mime: Column) -> Column:
    return _among(mime, PDF)


def is_image(mime: Column) -> Column:
    return _among(mime, IMAGE)


def is_audio(mime: Column) -> Column:
    return _among(mime, AUDIO)


def is_video(mime: Column) -> Column:
    """Word for word: parameters are not left out here."""
    return F.coalesce(mime.isin(*VIDEO), F.lit(False))


def is_authorized(mime: Column) -> Column:
    return F.coalesce(base_type(mime).isin(*AUTHORIZED), F.lit(False))


def effective(mime: Column) -> Column:
    """The type itself where it is known, word for word; parameters make it unknown."""
    return F.when(mime.isin(*KNOWN), mime).otherwise(UNKNOWN)


def sniff(content: Column) -> Column:
    """Type by the first 64 bytes."""
    head = F.hex(F.substring(content, 1, 64))
    out = F.lit(None).cast("string")
    for lead, at, tag, mime in reversed(CONTAINERS):
        out = F.when(head.startswith(lead) & (F.substring(head, at, len(tag)) == tag), mime).otherwise(out)
    for sign, mime in reversed(SIGNATURES):
        out = F.when(head.startswith(sign), mime).otherwise(out)
    return F.coalesce(out, F.lit("application/octet-stream"))


def by_extension(path: Column) -> Column:
    """Type by the name of a file, where its bytes aren't at hand."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    table = {"pdf": "application/pdf", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "mp3": "audio/mpeg", "wav": "audio/wav", "aiff": "audio/x-aiff", "mp4": "video/mp4", "txt": "text/plain"}
    out = F.lit("application/octet-stream")
    for k, v in table.items():
        out = F.when(ext == k, v).otherwise(out)
    return out
