"""Media columns: GIF bytes to timed, composited frames with colour histograms, and back.

The decoder reads GIF87a/89a: code streams of variable width, global and local palettes,
interlacing, graphic controls (delay, disposal 0-3, transparency). The encoder stores 8-bit
samples as palette colours, in code streams with a growing string table, cut into timed frames:
what a frame shares with the canvas that the frames before left is stored as transparent.

Codes are found and followed one by one; their packing into bits of a growing width, and back, is
array arithmetic, as a code's width depends on its place since the last clear code only.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST = 4096  # entries of a string table
WIDTH = 64
MAX_ROWS = 512  # of a frame that the encoder writes
#: Sample i as a colour: its bits are three of red, three of green and two of blue, spread over 0 to 255.
PALETTE = np.array([((i >> 5) * 255 // 7, (i >> 2 & 7) * 255 // 7, (i & 3) * 255 // 3) for i in range(256)], np.uint8)
#: What becomes of the encoder's frames, in turn: they stay, are undone, or are cleared.
DISPOSALS = (1, 3, 2)
UNSEEN = 255  # the transparent index; no byte of UTF-8


@dataclass
class Frame:
    index: int
    delay_ms: int
    left: int
    top: int
    width: int
    height: int
    disposal: int
    rgb: np.ndarray  # the whole canvas after this frame is drawn, height x width x 3
    shown: np.ndarray  # which canvas pixels have been drawn and not cleared


# ---------------------------------------------------------------- code streams


def code_widths(min_size: int, n: int) -> np.ndarray:
    """The widths of the n codes after a clear code: one bit more whenever the table outgrows the codes."""
    k = np.arange(n)
    width = np.full(n, min_size + 1)
    for w in range(min_size + 1, 12):
        width += k >= (1 << w) - (1 << min_size) - 1
    return width


_WIDTHS = {m: code_widths(m, 2 * MOST) for m in range(2, 9)}
_ENDS = {m: np.cumsum(w) for m, w in _WIDTHS.items()}  # bits from a clear code to the end of each code after it
_MASKS = {m: ((1 << w) - 1).astype(np.uint32) for m, w in _WIDTHS.items()}
_LITERALS = [bytes([i]) for i in range(256)]


def pack_codes(codes: np.ndarray, min_size: int) -> bytes:
    """Codes, the first of them a clear code, as a stream of bits, lowest first."""
    clears = np.flatnonzero(codes == 1 << min_size)
    since = np.arange(len(codes)) - np.repeat(clears, np.diff(np.append(clears, len(codes))))  # 0 at a clear code
    since[clears[1:]] = np.diff(clears)
    since[0] = 1
    width = _WIDTHS[min_size][since - 1]
    ends = np.cumsum(width)
    at = ends - width
    value = codes.astype(np.int64) << (at & 7)
    size = int(ends[-1] + 7) >> 3
    out = np.zeros(size + 2)
    for k in range(3):  # a code touches three bytes at most, and no bit twice
        out += np.bincount((at >> 3) + k, (value >> (8 * k)) & 255, size + 2)
    return out[:size].astype(np.uint8).tobytes()


def lzw_encode(samples: bytes, min_size: int = 8) -> bytes:
    """The code stream of samples below 2**min_size, with a string table that grows until it is full and starts anew."""
    clear, end = 1 << min_size, (1 << min_size) + 1
    codes, following = [clear], end + 1
    table: dict[int, int] = {}
    get, put = table.get, codes.append
    rest = iter(samples)
    prefix = next(rest, None)
    if prefix is not None:
        for s in rest:
            key = prefix << 8 | s
            known = get(key)
            if known is not None:
                prefix = known
                continue
            put(prefix)
            if following < MOST:
                table[key] = following
                following += 1
            else:
                put(clear)
                table.clear()
                following = end + 1
            prefix = s
        put(prefix)
    put(end)
    return pack_codes(np.array(codes, np.int32), min_size)


def lzw_decode(data: bytes, min_size: int, count: int) -> np.ndarray:
    """The first ``count`` samples of a code stream. A broken or short stream raises ValueError."""
    if not 2 <= min_size <= 8:
        raise ValueError("code size out of range")
    clear, end = 1 << min_size, (1 << min_size) + 1
    base = [*_LITERALS[:clear], b"", b""]
    view = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.uint32)
    view = view[:-2] | view[1:-1] << 8 | view[2:] << 16  # what a code may touch, from each byte on
    total, bit, made, out = 8 * len(data), 0, 0, []
    table, prev = list(base), None  # a stream may do without the first clear code
    place = 0  # codes since the last clear code
    while made < count:
        # read on as if no clear code came, then go back to behind the first that did
        first = min(place, MOST)
        last = min(first + count - made + 1, 2 * MOST)
        ends = bit + _ENDS[min_size][first:last] - (_ENDS[min_size][first - 1] if first else 0)
        ends = ends[: np.searchsorted(ends, total, "right")]
        if not len(ends):
            break
        last = first + len(ends)
        at = ends - _WIDTHS[min_size][first:last]
        codes = (view[at >> 3] >> (at & 7).astype(np.uint32)) & _MASKS[min_size][first:last]
        stops = np.flatnonzero((codes == clear) | (codes == end))
        n = int(stops[0]) if len(stops) else len(codes)
        part = codes[:n].tolist()
        if part and prev is None:
            if part[0] > clear:
                raise ValueError("first code is no literal")
            prev = base[part[0]]
            out.append(prev)
            made += len(prev)
            new = part[1:]
        else:
            new = part
        known = len(table)
        grow, have = MOST - known, len(out)
        learn, put = table.append, out.append
        for code in new[:grow]:
            if code < known:
                word = table[code]
            elif code == known:
                word = prev + prev[:1]
            else:
                raise ValueError("code beyond the table")
            learn(prev + word[:1])
            known += 1
            put(word)
            prev = word
        if len(new) > grow:
            out += [table[code] for code in new[grow:]]  # twelve bits reach no further than a full table
            prev = out[-1]
        made += sum(map(len, out[have:]))
        place += n
        bit = int(ends[n - 1]) if n else bit
        if len(stops):
            if codes[n] == end:
                break
            bit = int(ends[n])
            table, prev, place = list(base), None, 0
    flat = b"".join(out)[:count]
    if len(flat) < count:
        raise ValueError("code stream is short")
    return np.frombuffer(flat, np.uint8)


def _blocks(data: bytes) -> bytes:
    """Into sub-blocks of at most 255 bytes and the closing empty one."""
    n = len(data)
    whole = n // 255
    body = np.empty((whole, 256), np.uint8)
    body[:, 0] = 255
    body[:, 1:] = np.frombuffer(data, np.uint8, whole * 255).reshape(-1, 255)
    rest = data[whole * 255 :]
    return body.tobytes() + (bytes([len(rest)]) + rest if rest else b"") + b"\0"


def _unblock(data: bytes, at: int) -> tuple[bytes, int]:
    """The joined sub-blocks from ``at`` and the offset behind them."""
    view = np.frombuffer(data, np.uint8)
    stops = np.flatnonzero(view[at::256] != 255)
    whole = int(stops[0]) if len(stops) else 0
    parts = [view[at : at + whole * 256].reshape(-1, 256)[:, 1:].tobytes()] if whole else []
    at += whole * 256
    while True:
        if at >= len(data):
            raise ValueError("sub-blocks do not end")
        n = data[at]
        if not n:
            return b"".join(parts), at + 1
        parts.append(data[at + 1 : at + 1 + n])
        at += 1 + n


# ---------------------------------------------------------------- files


def encode_gif(payload: bytes, width: int = WIDTH, delay_cs: int = 10) -> bytes:
    """8-bit samples as the palette's colours; ``len(payload)`` must be a positive multiple of width.

    Long payloads take several timed frames of at most MAX_ROWS rows. From the second on, samples
    that the canvas shows already are stored as UNSEEN where the frame has no such sample.
    """
    rows, rest = divmod(len(payload), width)
    if rest or not rows:
        raise ValueError("payload is no positive multiple of the width")
    out = [b"GIF89a", struct.pack("<HHBBB", width, min(rows, MAX_ROWS), 0xF7, 0, 0), PALETTE.tobytes()]
    samples = np.frombuffer(payload, np.uint8)
    step = MAX_ROWS * width
    canvas = np.full(min(len(payload), step), -1, np.int16)  # -1: nothing is shown
    for k, first in enumerate(range(0, len(samples), step)):
        part, disposal = samples[first : first + step], DISPOSALS[k % len(DISPOSALS)]
        clear = k > 0 and not (part == UNSEEN).any()
        stored = np.where(part == canvas[: len(part)], np.uint8(UNSEEN), part) if clear else part
        if disposal != 3:
            canvas[: len(part)] = part if disposal == 1 else -1
        out.append(struct.pack("<BBBBHBB", 0x21, 0xF9, 4, disposal << 2 | clear, delay_cs, UNSEEN if clear else 0, 0))
        out.append(struct.pack("<BHHHHBB", 0x2C, 0, 0, width, len(part) // width, 0, 8))
        out.append(_blocks(lzw_encode(stored.tobytes())))
    return b"".join(out) + b";"


def decode_gif(data: bytes) -> Iterator[Frame]:
    """Frames in order, each drawn on the canvas left by the disposal of the one before."""
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise ValueError("no GIF header")
    width, height, flags, _background, _ = struct.unpack_from("<HHBBB", data, 6)
    at, shared = 13, None
    if flags & 0x80:
        n = 3 << ((flags & 7) + 1)
        shared = np.frombuffer(data[at : at + n], np.uint8).reshape(-1, 3)
        at += n
    canvas, shown = np.zeros((height, width, 3), np.uint8), np.zeros((height, width), bool)
    control, index = (0, 0, None), 0
    while True:
        if at >= len(data):
            raise ValueError("no trailer")
        kind = data[at]
        if kind == 0x3B:
            return
        if kind == 0x21:
            label = data[at + 1]
            if label == 0xF9 and data[at + 2] == 4:
                bits, delay, clear = struct.unpack_from("<BHB", data, at + 3)
                control = ((bits >> 2) & 7, delay, clear if bits & 1 else None)
            _, at = _unblock(data, at + 2)
            continue
        if kind != 0x2C:
            raise ValueError("unknown block")
        left, top, w, h, bits = struct.unpack_from("<HHHHB", data, at + 1)
        at += 10
        palette = shared
        if bits & 0x80:
            n = 3 << ((bits & 7) + 1)
            palette = np.frombuffer(data[at : at + n], np.uint8).reshape(-1, 3)
            at += n
        if palette is None:
            raise ValueError("no palette")
        min_size = data[at]
        stream, at = _unblock(data, at + 1)
        samples = lzw_decode(stream, min_size, w * h).reshape(h, w)
        if bits & 0x40:
            order = np.concatenate([np.arange(s, h, d) for s, d in ((0, 8), (4, 8), (2, 4), (1, 2))])
            woven = np.empty_like(samples)
            woven[order] = samples
            samples = woven
        disposal, delay, clear = control
        before = (canvas.copy(), shown.copy()) if disposal == 3 else None
        ch, cw = min(h, height - top), min(w, width - left)
        part = samples[: max(ch, 0), : max(cw, 0)]
        colours = palette[np.minimum(part, len(palette) - 1)]
        area = (slice(top, top + part.shape[0]), slice(left, left + part.shape[1]))
        if clear is None:
            canvas[area], shown[area] = colours, True
        else:
            seen = part != clear
            canvas[area] = np.where(seen[..., None], colours, canvas[area])
            shown[area] |= seen
        yield Frame(index, delay * 10, left, top, w, h, disposal, canvas, shown)
        if disposal == 2:
            canvas[area], shown[area] = 0, False
        elif before:
            canvas, shown = before
        control, index = (0, 0, None), index + 1


def colour_histogram(rgb: np.ndarray, shown: np.ndarray, bins: int = 4) -> np.ndarray:
    """Counts of the shown pixels over bins x bins x bins colour boxes, red outermost."""
    step = 256 // bins
    c = (rgb // step).astype(np.int64)
    key = (c[..., 0] * bins + c[..., 1]) * bins + c[..., 2]
    return np.bincount(key[shown], minlength=bins**3)


def samples_of(f: Frame) -> bytes:
    """The samples that encode_gif stored in a frame, from the colours that the canvas shows."""
    area = (slice(f.top, f.top + f.height), slice(f.left, f.left + f.width))
    if not f.shown[area].all():
        raise ValueError("the frame leaves part of its area unseen")
    c = f.rgb[area]
    return ((c[..., 0] & 0xE0) | (c[..., 1] & 0xE0) >> 3 | c[..., 2] >> 6).tobytes()


def payload_of(text: str | bytes | None, width: int = WIDTH) -> bytes:
    """UTF-8 bytes padded by zero bytes to a positive multiple of ``width``."""
    raw = b"" if text is None else text.encode("utf-8", "surrogatepass") if isinstance(text, str) else bytes(text)
    return raw + bytes(max(width, -(-len(raw) // width) * width) - len(raw))


# ---------------------------------------------------------------- operators


def frames(df: DataFrame, media: str = "media", bins: int = 4, pixels: bool = True) -> DataFrame:
    """One row per frame of the GIF in column ``media``: df's other columns, then frame,
    delay_ms, at_ms (start time), width, height, disposal, rgb (canvas bytes, if ``pixels``),
    histogram (array of bins**3 counts) and error.

    A null or broken file gives one row with null frame columns and the reason in ``error``
    (null for a null file). Columns of df that clash with an added name are replaced by it.
    """
    new = "frame int, delay_ms long, at_ms long, width int, height int, disposal int, rgb binary, histogram array<long>, error string"
    names = [c.split()[0] for c in new.split(", ")]
    keep = [c for c in df.columns if c != media and c.lower() not in names]
    schema = ", ".join(f"`{c}` {t}" for c, t in df.select(*[F.col(f"`{c}`") for c in keep]).dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False, name=None):
                own, data = list(row[:-1]), row[-1]
                if data is None:
                    out.append([*own, *[None] * 9])
                    continue
                at = 0
                try:
                    for f in decode_gif(bytes(data)):
                        h, w = f.shown.shape
                        out.append([*own, f.index, f.delay_ms, at, w, h, f.disposal, f.rgb.tobytes() if pixels else None, colour_histogram(f.rgb, f.shown, bins), None])
                        at += f.delay_ms
                except (ValueError, IndexError, struct.error) as e:
                    out.append([*own, *[None] * 8, str(e)])
            yield pd.DataFrame(out, columns=[*keep, *names]).astype({c: "Int64" for c in ("frame", "delay_ms", "at_ms", "width", "height", "disposal")})

    picked = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{media}`"))
    return picked.mapInPandas(run, ", ".join(x for x in (schema, new) if x))


def store_texts(df: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """df with ``media``: the text's padded UTF-8 payload as a GIF. Null texts count as empty."""

    @F.arrow_udf("binary")
    def store(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield pa.array([encode_gif(payload_of(t)) for at in range(0, len(b), 64) for t in b.slice(at, 64).to_pylist()], pa.binary())

    return df.withColumn(media, store(F.col(text).cast("string").cast("binary")))


OUT = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, n_frames int, feature string"


def media_features(df: DataFrame, media: str = "media", bins: int = 4) -> DataFrame:
    """df's other columns, then what the GIFs of store_texts in column ``media`` hold, read frame by frame:
    payload_bytes, payload_sha256, tail_crc32 (of the last 64 bytes), media_bytes, media_sha256,
    n_frames and feature (the colour histograms of its frames, added up).

    A null file gives nulls; a broken one raises. Columns of df that clash with an added name are replaced by it.
    """
    names = [c.split()[0] for c in OUT.split(", ")]
    keep = [c for c in df.columns if c != media and c.lower() not in names]
    picked = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{media}`"))
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.string()]

    def one(data: bytes | None) -> tuple:
        if data is None:
            return (None,) * len(types)
        digest, size, tail, n, hist = hashlib.sha256(), 0, b"", 0, np.zeros(bins**3, np.int64)
        for f in decode_gif(data):
            part = samples_of(f)
            digest.update(part)
            size, tail, n, hist = size + len(part), (tail + part)[-64:], n + 1, hist + colour_histogram(f.rgb, f.shown, bins)
        return size, digest.hexdigest(), zlib.crc32(tail), len(data), hashlib.sha256(data).hexdigest(), n, ",".join(map(str, hist.tolist()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, max(b.num_rows, 1), 256):
                part = b.slice(at, 256)
                made = zip(*map(one, part.column(len(keep)).to_pylist()), strict=True) if part.num_rows else [[]] * len(types)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *(pa.array(c, t) for c, t in zip(made, types, strict=True))], [*keep, *names])

    return picked.mapInArrow(run, ", ".join([*(f"`{c}` {t}" for c, t in picked.dtypes[:-1]), OUT]))


def text_media(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Stores every whole text as a GIF (store_texts) and reads the stored bytes back (media_features):
    key, n_bytes (unpadded), and the columns of media_features.

    Null and empty texts are one row of 64 zero bytes. Rows are independent: nulls and
    repeats in ``key`` pass through, other columns are ignored, an empty table gives no rows.
    Memory is bounded by one Arrow batch of texts.
    """
    t = F.col(text).cast("string")
    own = df.select(F.col(key).alias("_key"), F.coalesce(F.octet_length(t), F.lit(0)).cast("long").alias("n_bytes"), t.alias("_text"))
    out = media_features(store_texts(own, "_text", "_media").drop("_text"), "_media")
    return out.withColumnRenamed("_key", key)
