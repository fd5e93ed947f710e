"""The layers that open or rewrite content: inflating PDF streams, re-encoding images, sanitising SVG.

Spark deals the files; a task handles one file at a time, within fixed limits. Only files that need it come here, since callers filter first."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from xml.parsers import expat
from xml.sax.saxutils import escape, quoteattr

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sievework.functions.tables import IMAGE_PIXELS, IMAGE_SIDE, PDF_DEPTH, PDF_RATIO, PDF_STREAM_BYTES, PDF_TOTAL_BYTES, SVG_ATTRIBUTES, SVG_ELEMENTS


#: What malformed files raise. Anything else, as memory running out, is the task's failure, not a verdict.
BROKEN = (ValueError, ArithmeticError, LookupError, struct.error, zlib.error, TypeError)
RUN_ROWS, RUN_BYTES = 256, 4 << 20  # rows, and bytes of their files, that are handed back together; batches of no more bytes come in


def per_file(df: DataFrame, f: Callable[..., tuple], fields: list[T.StructField], *columns: str) -> DataFrame:
    """df with further columns that f makes of a row's columns (`content` by default; null bytes count as none). A malformed file, on which f raises one of BROKEN, gets its error as the last field and nulls before."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", RUN_BYTES)
    schema = T.StructType([*df.schema.fields, *fields])
    places = [df.columns.index(c) for c in columns or ("content",)]

    def one(batch: pa.RecordBatch, row: int) -> tuple:
        try:
            return f(*(batch.column(k)[row].as_py() if k != places[0] else batch.column(k)[row].as_py() or b"" for k in places))
        except BROKEN as broken:  # fail closed: the verdict names it
            return (*[None] * (len(fields) - 1), f"{type(broken).__name__}: {broken}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(T.StructType(fields))
        for batch in batches:
            at, done, size = 0, [], 0
            for row in range(batch.num_rows):
                done.append(one(batch, row))
                size += sum(len(v) for v in done[-1] if isinstance(v, bytes))
                if len(done) == RUN_ROWS or size >= RUN_BYTES or row + 1 == batch.num_rows:
                    own = zip(zip(*done, strict=True), kinds, strict=True)
                    yield pa.RecordBatch.from_arrays([*(c.slice(at, len(done)) for c in batch.columns), *(pa.array(list(v), k.type) for v, k in own)], names=schema.names)
                    at, done, size = row + 1, [], 0

    return df.mapInArrow(run, schema)


def pdf_streams(data: bytes) -> list[tuple[int, bytes]]:
    """(offset, body) of the streams of a PDF that aren't empty; an unclosed one ends the search."""
    out, at = [], 0
    while (start := data.find(b"stream", at)) >= 0:
        at = start + 6
        if data[max(0, start - 3) : start] == b"end":
            continue
        body = at + (data[at : at + 1] == b"\r")
        body += data[body : body + 1] == b"\n"
        end = data.find(b"endstream", body)
        if end < 0:
            break
        at = end + 9
        text = data[body:end]
        text = text.removesuffix(b"\n")
        text = text.removesuffix(b"\r")
        if text:
            out.append((body, text))
    return out


def _opened(data: bytes, raw: bool) -> tuple[bytes, bool] | None:
    """Inflated data within the limit of a stream, and whether it was cut; None if it isn't deflated."""
    for wbits, skip in ((15, 0), (-15, 2), (-15, 0)) if raw else ((15, 0),):
        try:
            out = zlib.decompressobj(wbits).decompress(data[skip:], PDF_STREAM_BYTES)
        except zlib.error:
            continue
        if out:
            return out, len(out) >= PDF_STREAM_BYTES
    return None


def streams_of(data: bytes, ratio: int = PDF_RATIO) -> Iterator[tuple]:
    """(stream, place, stored bytes, depth, cut, bomb, inflated) for each stream of a PDF, by number and by its body's place, as far as the limits allow. Layers of deflation are opened until one isn't deflated any more, PDF_DEPTH at most; depth 0 is a stream that isn't deflated, inflated then null. A bomb, or the total limit, ends the file."""
    total = 0
    for number, (place, body) in enumerate(pdf_streams(data)):
        now, depth, cut, bomb = body, 0, False, False
        while depth < PDF_DEPTH and not (cut or bomb) and (got := _opened(now, depth == 0)):
            now, cut = got
            depth += 1
            bomb = len(now) // len(body) > ratio
        if depth and not bomb:
            now = now[: max(0, PDF_TOTAL_BYTES - total - 1)]
            total += len(now) + 1
        full = total >= PDF_TOTAL_BYTES
        yield number, place, len(body), depth, cut or full, bomb, now if depth and not bomb else None
        if bomb or full:
            break


def inflate_pdf(data: bytes, ratio: int = PDF_RATIO) -> tuple:
    """(inflated, streams, opened, depth, cut, bomb, spans, error): what streams_of gives, joined with a line feed after each stream; spans are (start, length, stream) in that."""
    parts, total, deepest, cut, bomb, spans = [], 0, 0, False, False, []
    for number, _, _, depth, short, burst, now in streams_of(data, ratio):
        cut, bomb = cut or short, bomb or burst
        if now is not None:
            spans.append({"start": total, "len": len(now), "stream": number})
            parts.append(now)
            total += len(now) + 1
            deepest = max(deepest, depth)
    return b"".join(p + b"\n" for p in parts), len(pdf_streams(data)), len(parts), deepest, cut, bomb, spans, None


PDF_FIELDS = [
    T.StructField("inflated", T.BinaryType()),
    T.StructField("streams", T.LongType()),
    T.StructField("opened", T.LongType()),
    T.StructField("depth", T.LongType()),
    T.StructField("cut", T.BooleanType()),
    T.StructField("bomb", T.BooleanType()),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("len", T.LongType()), T.StructField("stream", T.LongType())]))),
    T.StructField("pdf_error", T.StringType()),
]


def dimensions(data: bytes) -> tuple[str, int, int] | None:
    """Type, width and height from the header of a PNG, JPEG or WebP."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return "png", *struct.unpack(">II", data[16:24])
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        kind = data[12:16]
        if kind == b"VP8X" and len(data) >= 30:
            return "webp", int.from_bytes(data[24:27], "little") + 1, int.from_bytes(data[27:30], "little") + 1
        if kind == b"VP8L" and len(data) >= 25:
            bits = int.from_bytes(data[21:25], "little")
            return "webp", (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
        if kind == b"VP8 " and len(data) >= 30:
            return "webp", int.from_bytes(data[26:28], "little") & 0x3FFF, int.from_bytes(data[28:30], "little") & 0x3FFF
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(data) and data[at] == 0xFF:
            mark, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
            if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
                return "jpeg", int.from_bytes(data[at + 7 : at + 9], "big"), int.from_bytes(data[at + 5 : at + 7], "big")
            at += 2 + max(size, 2)
    return None


def trailing(data: bytes, kind: str) -> int | None:
    """Bytes after the image's last end marker; None if it can't be told."""
    if kind == "webp":
        end = 8 + int.from_bytes(data[4:8], "little")
        return None if end > len(data) or end < 12 else len(data) - end
    mark, more = (b"\xff\xd9", 2) if kind == "jpeg" else (b"IEND", 8)
    at = data.rfind(mark)
    return None if at < 0 else max(0, len(data) - at - more)


def png_pixels(data: bytes) -> np.ndarray:
    """Pixels [height, width, channels] of an 8-bit PNG without interlace; a palette becomes true colour."""
    at, parts, palette, alpha = 8, [], None, None
    width, height, depth, colour, _, _, interlace = struct.unpack(">IIBBBBB", data[16:29])
    if depth != 8 or interlace or colour not in (0, 2, 3, 4, 6):
        raise ValueError("this kind of PNG isn't decoded")
    while at + 8 <= len(data):
        n, name = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        if zlib.crc32(name + body) != int.from_bytes(data[at + 8 + n : at + 12 + n], "big"):
            raise ValueError("a chunk's check sum is wrong")
        parts += [body] if name == b"IDAT" else []
        palette = np.frombuffer(body, np.uint8).reshape(-1, 3) if name == b"PLTE" else palette
        alpha = np.frombuffer(body, np.uint8) if name == b"tRNS" and colour == 3 else alpha
        at += 12 + n
        if name == b"IEND":
            break
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    flat = zlib.decompressobj().decompress(b"".join(parts), height * (width * channels + 1))
    rows = np.frombuffer(flat, np.uint8).reshape(height, width * channels + 1)
    out = rows[:, 1:].reshape(height, width, channels).copy()
    filtered = np.flatnonzero(rows[:, 0])  # the others are as they stand
    for y in filtered.tolist():
        above = out[y - 1].astype(np.int64) if y else np.zeros((width, channels), np.int64)
        how, line = rows[y, 0], rows[y, 1:].reshape(width, channels).astype(np.int64)
        if how == 1:
            line = np.cumsum(line, axis=0) & 255
        elif how == 2:
            line = (line + above) & 255
        elif how in (3, 4):
            left, corner = np.zeros(channels, np.int64), np.zeros(channels, np.int64)
            for x in range(width):
                up = above[x]
                if how == 3:
                    guess = (left + up) >> 1
                else:
                    p = left + up - corner
                    a, b, c = abs(p - left), abs(p - up), abs(p - corner)
                    guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
                corner = up
                left = line[x] = (line[x] + guess) & 255
        elif how:
            raise ValueError("unknown filter")
        out[y] = line
    if colour == 3:
        if palette is None or out.max(initial=0) >= len(palette):
            raise ValueError("a colour isn't in the palette")
        index = out[..., 0]
        out = palette[index]
        if alpha is not None:
            full = np.r_[alpha, np.full(max(0, len(palette) - len(alpha)), 255, np.uint8)]
            out = np.concatenate([out, full[index][..., None]], axis=2)
    return out


def png_bytes(pixels: np.ndarray, deflate: Callable[[bytes], bytes] = lambda lines: zlib.compress(lines, 6), last: int = 0) -> bytes:
    """A PNG with these pixels and nothing else. deflate: what makes a zlib stream of the lines; last: the filter of the last one, 0 none, 1 left, 2 above."""
    height, width, channels = pixels.shape
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    lines = np.concatenate([np.zeros((height, 1), np.uint8), pixels.reshape(height, -1)], axis=1)
    if last:
        lines[-1, 0] = last
        lines[-1, 1 + (channels if last == 1 else 0) :] -= pixels[-1, :-1].reshape(-1) if last == 1 else pixels[-2].reshape(-1) if height > 1 else np.uint8(0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, {1: 0, 2: 4, 3: 2, 4: 6}[channels], 0, 0, 0)) + chunk(b"IDAT", deflate(lines.tobytes())) + chunk(b"IEND", b"")


def reencode(data: bytes, clear_low_bits: bool = True, pixels: np.ndarray | None = None) -> tuple:
    """(rewritten, type, width, height, trailing bytes, why it is refused). JPEG and WebP have no codec here and are refused. pixels: the PNG's, where they are known already."""
    found = dimensions(data)
    if not found:
        return None, None, None, None, None, "no image header"
    kind, width, height = found
    if not width or not height or max(width, height) > IMAGE_SIDE or width * height > IMAGE_PIXELS:
        return None, kind, width, height, None, "dimensions"
    extra = trailing(data, kind)
    if kind != "png":
        return None, kind, width, height, extra, "no codec"
    pixels = (png_pixels(data) if pixels is None else pixels).copy()
    if clear_low_bits:
        colours = pixels.shape[2] - (pixels.shape[2] in (2, 4))
        pixels[..., :colours] &= 0xFE
    return png_bytes(pixels), kind, width, height, extra, None


IMAGE_FIELDS = [T.StructField("rewritten", T.BinaryType()), T.StructField("image_type", T.StringType()), T.StructField("width", T.LongType()), T.StructField("height", T.LongType()), T.StructField("trailing_bytes", T.LongType()), T.StructField("refused", T.StringType())]

_ELEMENTS, _ATTRIBUTES = {x.lower() for x in SVG_ELEMENTS}, {x.lower() for x in SVG_ATTRIBUTES}


def sanitise_svg(data: bytes) -> tuple:
    """(sanitised, removed elements by name, removed attributes by name, kept elements, comments, instructions, why it is refused). A removed element goes with all that it holds and counts once; attributes go by local name; comments and instructions stay; document types are refused. Names count without case, as first seen."""
    out, hidden, depth, root = [], 0, 0, None
    gone: dict[str, list] = {}
    lost: dict[str, list] = {}
    kept_elements, comments, instructions = 0, 0, 0
    parser = expat.ParserCreate(namespace_separator=None)
    local = lambda name: name.rsplit(":", 1)[-1]

    def count(names: dict[str, list], name: str) -> None:
        names.setdefault(name.lower(), [name, 0])[1] += 1

    def start(name: str, attributes: dict[str, str]) -> None:
        nonlocal hidden, depth, root, kept_elements
        root = root or local(name)
        depth += 1
        if hidden:
            hidden += 1
        elif local(name).lower() not in _ELEMENTS:
            hidden = 1
            count(gone, local(name))
        else:
            kept_elements += 1
            kept = {k: v for k, v in attributes.items() if k.startswith("xmlns") or local(k).lower() in _ATTRIBUTES}
            for k in attributes:
                if k not in kept:
                    count(lost, k)
            out.append(f"<{name}" + "".join(f" {k}={quoteattr(v)}" for k, v in kept.items()) + ">")

    def end(name: str) -> None:
        nonlocal hidden
        if hidden:
            hidden -= 1
        else:
            out.append(f"</{name}>")

    def doctype(*_: object) -> None:
        raise ValueError("a document type isn't allowed")

    def comment(text: str) -> None:
        nonlocal comments
        comments += 1
        if not hidden:
            out.append(f"<!--{text}-->")

    def instruction(target: str, text: str) -> None:
        nonlocal instructions
        instructions += 1
        if not hidden:
            out.append(f"<?{target} {text}?>")

    parser.StartElementHandler, parser.EndElementHandler, parser.StartDoctypeDeclHandler = start, end, doctype
    parser.CharacterDataHandler = lambda text: None if hidden else out.append(escape(text))
    parser.CommentHandler, parser.ProcessingInstructionHandler = comment, instruction
    try:
        parser.Parse(data, True)
    except (expat.ExpatError, ValueError) as broken:
        return None, None, None, None, None, None, f"SVG-PARSE: {broken}"
    report = dict(gone.values()), dict(lost.values()), kept_elements, comments, instructions
    if (root or "").lower() != "svg":
        return None, *report, "SVG-BADROOT"
    return "".join(out).encode(), *report, None


_COUNTS = T.MapType(T.StringType(), T.LongType())
SVG_FIELDS = [
    T.StructField("sanitised", T.BinaryType()),
    T.StructField("removed_elements", _COUNTS),
    T.StructField("removed_attributes", _COUNTS),
    T.StructField("kept_elements", T.LongType()),
    T.StructField("comments", T.LongType()),
    T.StructField("instructions", T.LongType()),
    T.StructField("svg_refused", T.StringType()),
]


def psnr(before: np.ndarray, after: np.ndarray) -> float:
    """Peak signal-to-noise ratio of 8-bit pixels in decibels; infinite where they are equal."""
    error = float(((before.astype(np.int32) - after.astype(np.int32)) ** 2).mean()) if before.size else 0.0
    return float("inf") if error == 0 else 10 * float(np.log10(255 * 255 / error))


OPENED = [*PDF_FIELDS[:-1], *IMAGE_FIELDS, *SVG_FIELDS, T.StructField("rebuilt", T.BinaryType()), PDF_FIELDS[-1]]


def opened(data: bytes, is_pdf: bool, kind: str | None, redo: bool) -> tuple:
    """OPENED: what the layers that open or rewrite a file find, its streams if it is a PDF and itself rewritten if it is an image or a drawing; and an image rebuilt for the comparison scanner that asks for no more (null if it can't be). An error of one part leaves the others."""
    failed = lambda fields, broken: (*(None,) * (len(fields) - 1), f"{type(broken).__name__}: {broken}")
    image, drawing, pdf, rebuilt = (None,) * len(IMAGE_FIELDS), (None,) * len(SVG_FIELDS), (None,) * len(PDF_FIELDS), None
    if is_pdf:
        try:
            pdf = inflate_pdf(data)
        except BROKEN as broken:
            pdf = failed(PDF_FIELDS, broken)
    if kind in ("jpeg", "png", "webp"):
        try:
            image = reencode(data)
        except BROKEN as broken:
            image = failed(IMAGE_FIELDS, broken)
    if kind == "svg":
        drawing = sanitise_svg(data)
    if redo:
        try:
            rebuilt = reencode(data, clear_low_bits=False)[0]
        except BROKEN:  # it denies what it can't rebuild
            rebuilt = None
    return (*pdf[:-1], *image, *drawing, rebuilt, pdf[-1])
