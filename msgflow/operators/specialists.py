"""Pluggable analysis of file contents: a registry of functions by media type, run over Arrow batches."""

import re
import struct
import zlib
from collections.abc import Callable
from dataclasses import dataclass
from typing import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from msgflow.functions.mime import AUDIO, IMAGE, PDF, base_type
from msgflow.operators.routing import RESULT

PAGES_READ = 5  # first pages of a document that are kept


@dataclass(frozen=True)
class Specialist:
    """``analyse(file name, bytes) -> dict`` with any of ``score, label, transcription, title, author, pages``."""

    metric_id: str
    capabilities: tuple[str, ...]
    analyse: Callable[[str, bytes], dict]


def image_header(data: bytes) -> tuple[str, int, int, str]:
    """Format, width, height and mode from the header of a PNG, GIF or JPEG."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 26:
        w, h = struct.unpack(">II", data[16:24])
        return "PNG", w, h, {0: "L", 2: "RGB", 3: "P", 4: "LA", 6: "RGBA"}.get(data[25], "?")
    if data[:6] in (b"GIF87a", b"GIF89a") and len(data) >= 10:
        w, h = struct.unpack("<HH", data[6:10])
        return "GIF", w, h, "P"
    if data[:2] == b"\xff\xd8":
        i = 2
        while i + 9 < len(data):
            if data[i] != 0xFF:
                break
            marker, size = data[i + 1], struct.unpack(">H", data[i + 2 : i + 4])[0]
            if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", data[i + 5 : i + 9])
                return "JPEG", w, h, {1: "L", 3: "RGB", 4: "CMYK"}.get(data[i + 9], "?")
            i += 2 + size
    raise ValueError("no image header")


def describe_image(name: str, data: bytes) -> dict:
    kind, w, h, mode = image_header(data)
    return {"label": f"Format: {kind} | Res: {w}x{h} | Mode: {mode}", "score": 1.0}


def plain_text_pages(name: str, data: bytes) -> dict:
    """Reader of plain texts with form feeds between the pages; it is registered for no type."""
    pages = data.decode("utf-8", "replace").split("\f")[:PAGES_READ]
    return {"title": name, "author": "Unknown", "pages": [{"number": i + 1, "content": p} for i, p in enumerate(pages)]}


_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.DOTALL)
_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.DOTALL)
_STRING = rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)"
_SHOWN = re.compile(rb"(" + _STRING + rb"|<[0-9A-Fa-f\s]*>)\s*(?:Tj|'|\")|\[((?:" + _STRING + rb"|[^\]])*)\]\s*TJ|(T\*|\bT[dD]\b|\bET\b)", re.DOTALL)
_PIECE = re.compile(rb"(" + _STRING + rb"|<[0-9A-Fa-f\s]*>)", re.DOTALL)
_ESCAPE = re.compile(rb"\\([0-7]{1,3}|.|\r?\n)", re.DOTALL)
_PLAIN = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"", b"f": b"", b"\n": b"", b"\r\n": b""}


def _pdf_string(raw: bytes) -> str:
    if raw[:1] == b"<":
        data = bytes.fromhex(raw[1:-1].decode("ascii").replace(" ", "").ljust(len(raw) % 2, "0"))
    else:
        data = _ESCAPE.sub(lambda m: bytes([int(m.group(1), 8) & 255]) if m.group(1).isdigit() else _PLAIN.get(m.group(1), m.group(1)), raw[1:-1])
    return data[2:].decode("utf-16-be", "replace") if data[:2] == b"\xfe\xff" else data.decode("cp1252", "replace")


def pdf_pages(name: str, data: bytes) -> dict:
    """Title, author and the text of the first pages of a PDF whose text is in simple encodings; raises ``ValueError`` for what it can't read."""
    if data[:5] != b"%PDF-":
        raise ValueError("not a PDF")
    if b"/Encrypt" in data:
        raise ValueError("encrypted PDF")
    objects = {int(m.group(1)): m.group(2) for m in _OBJECT.finditer(data)}
    if not any(b"/Page" in body for body in objects.values()):
        raise ValueError("PDF without readable page objects")

    def text_of(number: int) -> str:
        body = objects.get(number, b"")
        found = _STREAM.search(body)
        if not found:
            return ""
        content = found.group(1)
        if b"/FlateDecode" in body:
            content = zlib.decompressobj().decompress(content)
        elif b"/Filter" in body:
            raise ValueError("PDF with an unknown filter")
        lines, line = [], []
        for m in _SHOWN.finditer(content):
            if m.group(3):
                lines.append("".join(line))
                line = []
            else:
                line += [_pdf_string(p) for p in _PIECE.findall(m.group(1) or m.group(2))]
        return "\n".join(x for x in [*lines, "".join(line)] if x)

    def entry(key: bytes) -> str | None:
        m = re.search(rb"/" + key + rb"\s*(" + _STRING + rb"|<[0-9A-Fa-f\s]*>)", data)
        return _pdf_string(m.group(1)) if m else None

    def leaves(number: int, seen: frozenset[int] = frozenset()) -> list[int]:
        body = objects.get(number, b"")
        kids = re.search(rb"/Kids\s*\[([^\]]*)\]", body)
        if number in seen or not kids:
            return [number] if re.search(rb"/Type\s*/Page\b", body) else []
        return [x for k in re.findall(rb"(\d+)\s+\d+\s+R", kids.group(1)) for x in leaves(int(k), seen | {number})]

    root = next((n for n, b in objects.items() if re.search(rb"/Type\s*/Pages\b", b) and b"/Parent" not in b), None)
    order = leaves(root) if root is not None else [n for n, b in objects.items() if re.search(rb"/Type\s*/Page\b", b)]
    pages = []
    for k, number in enumerate(order[:PAGES_READ], 1):
        refs = re.search(rb"/Contents\s*(?:\[([^\]]*)\]|(\d+)\s+\d+\s+R)", objects[number])
        parts = [int(x) for x in re.findall(rb"(\d+)\s+\d+\s+R", refs.group(1))] if refs and refs.group(1) is not None else [int(refs.group(2))] if refs else []
        pages.append({"number": k, "content": "\n".join(text_of(p) for p in parts)})
    return {"title": entry(b"Title") or name, "author": entry(b"Author") or "Unknown", "pages": pages}


def audio_specialist(transcribe: Callable[[bytes], list[str]], types: tuple[str, ...] = AUDIO) -> "Specialist":
    """A specialist around a recogniser that gives the segments of a recording; they are joined and trimmed."""
    return Specialist("audio", types, lambda name, data: {"transcription": " ".join(s.strip() for s in transcribe(data) if s and s.strip())})


def no_recogniser(data: bytes) -> list[str]:
    raise ValueError("no recogniser is registered for recordings")


REGISTRY: dict[str, Specialist] = {}


def register(specialist: Specialist) -> None:
    REGISTRY[specialist.metric_id] = specialist


register(Specialist("image", IMAGE, describe_image))
register(Specialist("pdf", PDF, pdf_pages))
register(audio_specialist(no_recogniser))


def analyse(files: DataFrame, registry: dict[str, Specialist] | None = None, key: str = "entity_id", name: str = "path", mime: str = "mime_type", content: str = "content") -> DataFrame:
    """One result row per file and capable specialist, gathered by file; an error is a result, not a failure."""
    known = dict(registry or REGISTRY)
    kind = base_type(F.col(mime))
    can = F.array_compact(F.array(*(F.when(kind.isin(*s.capabilities), F.lit(m)) for m, s in known.items())))
    tasks = files.select(F.col(key).cast("string").alias("entity_id"), F.col(name).alias("name"), F.col(content).alias("content"), F.explode(can).alias("metric_id"))
    columns = [c.split()[0] for c in RESULT.split(", ")]

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = []
            for r in pdf.itertuples(index=False):
                row = dict.fromkeys(columns) | {"entity_id": r.entity_id, "metric_id": r.metric_id}
                try:
                    row |= known[r.metric_id].analyse(r.name, bytes(r.content or b""))
                except Exception as error:
                    row["error"] = str(error) or type(error).__name__
                rows.append(row)
            yield pd.DataFrame(rows, columns=columns)

    return tasks.mapInPandas(run, RESULT)


