"""Text as column expressions: subtitles, time stamps, markup, names, hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stamp_ms(text: Column) -> Column:
    """Milliseconds of ``HH:MM:SS,mmm`` (or a dot); a short fraction is filled up with zeros on the right."""
    part = lambda i: F.regexp_extract(text, r"(\d+):(\d{2}):(\d{2})[,.](\d{1,3})", i)
    whole = part(1).cast("long") * 3_600_000 + part(2).cast("long") * 60_000 + part(3).cast("long") * 1000
    return F.when(part(1) != "", whole + F.rpad(part(4), 3, "0").cast("long"))


def format_stamp(ms: Column, mark: str = ",") -> Column:
    div = lambda n, m: F.call_function("div", ms, F.lit(n).cast("long")) % m
    return F.format_string(f"%02d:%02d:%02d{mark}%03d", F.call_function("div", ms, F.lit(3_600_000).cast("long")), div(60_000, 60), div(1000, 60), ms % 1000)


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(text, r"<[^>]+>", "")


def normal_lines(text: Column) -> Column:
    """Without a byte order mark, with plain line ends."""
    return F.regexp_replace(F.regexp_replace(text, "^﻿", ""), r"\r\n?", "\n")


def srt_cues(text: Column) -> Column:
    """Array of cues (start_ms, end_ms, text) of an SRT document; blocks without a time line are left out."""
    blocks = F.split(F.trim(normal_lines(text), F.lit(" \n\t")), r"\n[ \t]*\n+")

    def cue(block: Column) -> Column:
        lines = F.split(F.trim(block, F.lit(" \n\t")), "\n")
        at = F.when(F.regexp_like(F.trim(F.get(lines, F.lit(0))), F.lit(r"^\d+$")), 1).otherwise(0)  # only a number may stand before the times
        times = F.split(F.coalesce(F.get(lines, at), F.lit("")), r"-->")
        body = F.array_join(F.slice(lines, at + 2, F.greatest(F.lit(0), F.size(lines))), "\n")
        return F.struct(stamp_ms(F.get(times, F.lit(0))).alias("start_ms"), stamp_ms(F.get(times, F.lit(1))).alias("end_ms"), F.trim(strip_tags(body), F.lit(" \n\t")).alias("text"))

    return F.filter(F.transform(blocks, cue), lambda c: c["start_ms"].isNotNull() & c["end_ms"].isNotNull())


def vtt_cues(text: Column) -> Column:
    """Array of cues (start_ms, end_ms, position, align, text) of a WebVTT document; notes and styles are left out.

    Only time stamps with hours count. Alignment is left, right or else center.
    """
    blocks = F.split(F.trim(normal_lines(text), F.lit(" \n\t")), r"\n[ \t]*\n+")

    def cue(block: Column) -> Column:
        lines = F.split(F.trim(block, F.lit(" \n\t")), "\n")
        at = F.when(F.contains(F.get(lines, F.lit(0)), F.lit("-->")), 0).otherwise(1)
        line = F.coalesce(F.get(lines, at), F.lit(""))
        part = lambda pattern: F.nullif(F.regexp_extract(line, pattern, 1), F.lit(""))
        full = r"\d{1,2}:\d{2}:\d{2}\.\d{1,3}"
        skipped = F.regexp_like(F.get(lines, F.lit(0)), F.lit("^(NOTE|STYLE|WEBVTT)"))
        return F.struct(
            F.when(~skipped, stamp_ms(part(rf"^\s*({full})\s*-->"))).alias("start_ms"),
            stamp_ms(part(rf"-->\s*({full})")).alias("end_ms"),
            part(r"position:(\d+(?:\.\d+)?)%?").cast("double").alias("position"),
            F.coalesce(F.when(part(r"align:(\S+)").isin("left", "right"), part(r"align:(\S+)")), F.lit("center")).alias("align"),
            F.trim(strip_tags(F.array_join(F.slice(lines, at + 2, F.greatest(F.lit(0), F.size(lines))), "\n")), F.lit(" \n\t")).alias("text"),
        )

    return F.filter(F.transform(blocks, cue), lambda c: c["start_ms"].isNotNull() & c["end_ms"].isNotNull())


def sanitize_html(html: Column) -> Column:
    """Markup without script blocks, style tags, event handlers and ends of foreign objects."""
    for pattern in (r"(?is)<script\b.*?</script\s*>", r"(?is)</?style\b[^>]*>", r"(?is)</foreignObject\s*>", r"""(?is)\son\w+\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)"""):
        html = F.regexp_replace(html, pattern, "")
    return html


def slug(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-")


def extension(name: Column) -> Column:
    return F.lower(F.nullif(F.regexp_extract(name, r"\.([^./]+)$", 1), F.lit("")))


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a over the text's characters, as a long."""
    chars = F.split(text, "")
    return F.aggregate(chars, F.lit(2_166_136_261), lambda h, c: (h.bitwiseXOR(F.ascii(c).cast("long")) * F.lit(16_777_619)).bitwiseAND(F.lit(4_294_967_295)))


#: Semitones of the note names above C.
NOTES = {"C": 0, "C#": 1, "D": 2, "D#": 3, "E": 4, "F": 5, "F#": 6, "G": 7, "G#": 8, "A": 9, "A#": 10, "B": 11}


def note_hertz(note: Column) -> Column:
    """Pitch of names such as A4 (440); rests and unknown names have 0."""
    table = F.create_map(*[F.lit(x) for pair in NOTES.items() for x in pair])
    name, octave = F.regexp_extract(note, r"^([A-G]#?)(\d)$", 1), F.regexp_extract(note, r"^([A-G]#?)(\d)$", 2)
    return F.coalesce(F.lit(440.0) * F.pow(F.lit(2.0), (F.try_element_at(table, name) + octave.try_cast("int") * 12 - 57) / 12.0), F.lit(0.0))
