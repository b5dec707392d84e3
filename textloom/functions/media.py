"""What kind of content bytes are, by their first ones: ordered signatures, some with bytes that may be anything."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes that are looked at.
SNIFFED = 512
#: Fixed values, the public table of content sniffing: tags that HTML begins with, after white space and before a space or '>'.
HTML_TAGS = "<!DOCTYPE HTML|<HTML|<HEAD|<SCRIPT|<IFRAME|<H1|<DIV|<FONT|<TABLE|<A|<STYLE|<TITLE|<B|<BODY|<BR|<P|<!--"
#: A pattern of the first bytes (as Latin-1) and the kind, in the order in which they are tried.
SIGNATURES = (
    (rf"(?i)^[\t\n\x0C\r ]*(?:{HTML_TAGS})[ >]", "text/html; charset=utf-8"),
    (r"^[\t\n\x0C\r ]*<\?xml", "text/xml; charset=utf-8"),
    (r"^%PDF-", "application/pdf"),
    (r"^%!PS-Adobe-", "application/postscript"),
    (r"^\xFE\xFF..", "text/plain; charset=utf-16be"),
    (r"^\xFF\xFE..", "text/plain; charset=utf-16le"),
    (r"^\xEF\xBB\xBF.", "text/plain; charset=utf-8"),
    (r"^\x00\x00[\x01\x02]\x00", "image/x-icon"),
    (r"^BM", "image/bmp"),
    (r"^GIF8[79]a", "image/gif"),
    (r"^RIFF....WEBPVP", "image/webp"),
    (r"^\x89PNG\r\n\x1A\n", "image/png"),
    (r"^\xFF\xD8\xFF", "image/jpeg"),
    (r"^FORM....AIFF", "audio/aiff"),
    (r"^ID3", "audio/mpeg"),
    (r"^OggS\x00", "application/ogg"),
    (r"^MThd\x00\x00\x00\x06", "audio/midi"),
    (r"^RIFF....AVI ", "video/avi"),
    (r"^RIFF....WAVE", "audio/wave"),
    ("mp4", "video/mp4"),
    (r"^\x1A\x45\xDF\xA3", "video/webm"),
    (r"^.{34}LP", "application/vnd.ms-fontobject"),
    (r"^\x00\x01\x00\x00", "font/ttf"),
    (r"^OTTO", "font/otf"),
    (r"^ttcf", "font/collection"),
    (r"^wOFF", "font/woff"),
    (r"^wOF2", "font/woff2"),
    (r"^\x1F\x8B\x08", "application/x-gzip"),
    (r"^PK\x03\x04", "application/zip"),
    (r"^Rar!\x1A\x07\x00", "application/x-rar-compressed"),
    (r"^Rar!\x1A\x07\x01\x00", "application/x-rar-compressed"),
    (r"^\x00\x61\x73\x6D", "application/wasm"),
    (r"^[^\x00-\x08\x0B\x0E-\x1A\x1C-\x1F]*$", "text/plain; charset=utf-8"),
)
#: What fits no signature.
BINARY = "application/octet-stream"


def mp4(content: Column, head: Column) -> Column:
    """Whether the first box is a file type that names mp4 as its kind or as one that it is compatible with."""
    size = F.conv(F.hex(F.substring(content, 1, 4)), 16, 10).cast("long")
    brands = F.substr(head, F.lit(9), (size - 8).cast("int"))
    whole = (F.length(head) >= 12) & (size % 4 == 0) & (size >= 12) & (F.length(head) >= size) & (F.substring(head, 5, 4) == "ftyp")
    return F.coalesce(whole & brands.rlike(r"(?s)^(?:mp4|.{8}(?:.{4})*mp4)"), F.lit(False))


def media_type(content: Column) -> Column:
    """The kind of a file's bytes by the first ``SNIFFED`` of them; no bytes are plain text."""
    bytes_ = F.substring(F.coalesce(content, F.lit(b"")), 1, SNIFFED)
    head = F.decode(bytes_, "ISO-8859-1")
    out = F.when(F.length(bytes_) == 0, "text/plain; charset=utf-8")
    for pattern, kind in SIGNATURES:
        out = out.when(mp4(bytes_, head) if pattern == "mp4" else head.rlike(f"(?s){pattern}"), kind)
    return out.otherwise(BINARY)


def is_text(content: Column) -> Column:
    return media_type(content).startswith("text/")
