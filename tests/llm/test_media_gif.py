import hashlib
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ferrowick.llm import media_gif as G


def slow_encode(samples, min_size):
    """One code at a time, bits by shifting."""
    clear = 1 << min_size
    acc, bits, size, table, prefix = clear, min_size + 1, min_size + 1, {(i,): i for i in range(clear)}, ()
    n = clear + 2

    def put(code):
        nonlocal acc, bits
        acc |= code << bits
        bits += size

    for s in samples:
        if prefix + (s,) in table:
            prefix += (s,)
            continue
        put(table[prefix])
        if n < 4096:
            table[prefix + (s,)] = n
            size += n == 1 << size and size < 12
            n += 1
        else:
            put(clear)
            size, n, table = min_size + 1, clear + 2, {(i,): i for i in range(clear)}
        prefix = (s,)
    if prefix:
        put(table[prefix])
        size += n == 1 << size and size < 12
    put(clear + 1)
    return acc.to_bytes(-(-(bits) // 8), "little")


def payloads():
    rng = random.Random(1)
    words = ["".join(rng.choices("etaoinshr", k=rng.randint(1, 9))) for _ in range(300)]
    for n in (1, 2, 63, 64, 511, 5000, 40_000):
        yield bytes(n)
        yield bytes(rng.randrange(256) for _ in range(n))
        yield (b"abcabcabd" * n)[:n]
        yield " ".join(rng.choices(words, k=n)).encode()[:n]


def test_code_streams_equal_a_plain_encoder_and_come_back():
    for data in [b"", *payloads()]:
        stream = G.lzw_encode(data)
        assert stream == slow_encode(data, 8)
        assert G.lzw_decode(stream, 8, len(data)).tobytes() == data
    for m in range(2, 8):
        data = bytes(random.Random(m).choices(range(1 << m), k=30_000)) + bytes(9000)
        stream = G.lzw_encode(data, m)
        assert stream == slow_encode(data, m) and G.lzw_decode(stream, m, len(data)).tobytes() == data
    text = b"the words of a text come again and again, " * 400
    assert len(G.lzw_encode(text)) < len(text) / 8  # the string table grows


def test_tables_that_stay_full_are_read():
    """Encoders may go on with a full table, and may leave the first clear code out."""
    rng, codes, have = random.Random(5), [256], 258
    for k in range(9000):
        codes.append(rng.randrange(256))
    width, acc, bits = 9, 0, 0
    for k, c in enumerate(codes):
        width = 9 if k == 0 else int(G.code_widths(8, k)[-1])
        acc |= c << bits
        bits += width
    acc |= 257 << bits
    stream = acc.to_bytes(-(-(bits + 12) // 8), "little")
    assert G.lzw_decode(stream, 8, 9000).tolist() == codes[1:] and have == 258
    with pytest.raises(ValueError):
        G.lzw_decode(stream, 8, 9001)


def test_files_hold_their_payload_in_frames():
    rng = random.Random(2)
    for rows in (1, 2, G.MAX_ROWS, G.MAX_ROWS + 3, 5 * G.MAX_ROWS + 1):
        n = 64 * rows
        for data in (bytes(n), bytes(rng.choices(range(256), k=n)), (b"abcabcabd" * n)[:n], bytes(rng.choices(b"abc", k=n))):
            frames = [(f.delay_ms, f.disposal, G.samples_of(f)) for f in G.decode_gif(G.encode_gif(data))]
            assert b"".join(x[2] for x in frames) == data and {x[0] for x in frames} == {100}
            assert [x[1] for x in frames] == [G.DISPOSALS[k % 3] for k in range(-(-rows // G.MAX_ROWS))]
    assert b"\x21\xf9\x04\x0d" in G.encode_gif(b"a" * 64 * G.MAX_ROWS * 2)  # undone, transparent


def gif(frames, w=4, h=2, palette=(0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255)):
    out = b"GIF89a" + struct.pack("<HHBBB", w, h, 0x80 | 1, 0, 0) + bytes(palette)
    for left, top, fw, fh, px, delay, disposal, clear in frames:
        out += struct.pack("<BBBBHBB", 0x21, 0xF9, 4, disposal << 2 | (clear is not None), delay, clear or 0, 0)
        out += struct.pack("<BHHHHB", 0x2C, left, top, fw, fh, 0) + b"\x02" + G._blocks(G.lzw_encode(bytes(px), 2))
    return out + b";"


def test_palette_disposal_and_transparency():
    f = [(f.delay_ms, f.rgb.copy(), f.shown.copy()) for f in G.decode_gif(gif([
        (0, 0, 4, 2, [1] * 8, 5, 1, None),        # red everywhere, stays
        (1, 0, 2, 1, [2, 3], 7, 3, 3),            # one green pixel, one see-through; then undone
        (0, 1, 2, 1, [3, 3], 9, 2, None),         # two blue pixels; then cleared
        (3, 1, 1, 1, [2], 1, 0, None),
    ]))]
    assert [x[0] for x in f] == [50, 70, 90, 10]
    red, green, blue, none = (255, 0, 0), (0, 255, 0), (0, 0, 255), (0, 0, 0)
    assert tuple(f[1][1][0, 1]) == green and tuple(f[1][1][0, 2]) == red
    assert tuple(f[2][1][0, 1]) == red and tuple(f[2][1][1, 0]) == blue
    assert tuple(f[3][1][1, 0]) == none and not f[3][2][1, 0] and tuple(f[3][1][1, 3]) == green


def test_broken_files_raise():
    good = G.encode_gif(bytes(64))
    for bad in (b"", b"GIF89a", good[:-1], good[:805], b"PNG" + good[3:], gif([(0, 0, 4, 2, [1] * 3, 1, 0, None)])):
        with pytest.raises((ValueError, IndexError, struct.error)):
            list(G.decode_gif(bad))


def brute_histogram(payload):
    """Canvas by canvas from the payload alone."""
    step, box = 64 * G.MAX_ROWS, np.array([(r >> 6) * 16 + (g >> 6) * 4 + (b >> 6) for r, g, b in G.PALETTE.tolist()])
    canvas, out = np.full(min(len(payload), step), -1), np.zeros(64, int)
    for k, at in enumerate(range(0, len(payload), step)):
        part = np.frombuffer(payload[at : at + step], np.uint8)
        before = canvas.copy()
        canvas[: len(part)] = box[part]
        out += np.bincount(canvas[canvas >= 0], minlength=64)
        if G.DISPOSALS[k % 3] == 3:
            canvas = before
        elif G.DISPOSALS[k % 3] == 2:
            canvas[: len(part)] = -1
    return out.tolist()


def test_text_media_contract_and_edges(spark):
    long = "é" * 700_000
    rows = [(1, None), (2, ""), (3, "hello"), (3, "hello"), (None, "x" * 64), (5, long)]
    out = {(r.doc_id, r.n_bytes): r for r in G.text_media(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(out) == 5
    for k, t in rows:
        raw = (t or "").encode()
        p = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        r = out[k, len(raw)]
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert r.feature == ",".join(map(str, brute_histogram(p)))
    assert out[5, 1_400_000].n_frames == 43 and out[1, 0].media_sha256 == out[2, 0].media_sha256
    assert G.text_media(spark.createDataFrame([], "doc_id long, text string, media int, n_bytes int")).count() == 0


def test_frames_operator(spark):
    df = spark.createDataFrame([(1, bytearray(gif([(0, 0, 4, 2, [1] * 8, 5, 1, None), (0, 0, 1, 1, [2], 7, 0, None)]))), (2, None), (3, bytearray(b"junk"))], "id int, media binary")
    out = G.frames(df).orderBy("id", "frame").collect()
    assert [(r.id, r.frame, r.at_ms) for r in out] == [(1, 0, 0), (1, 1, 50), (2, None, None), (3, None, None)]
    assert sum(out[0].histogram) == 8 and out[0].histogram[3 * 16] == 8 and out[3].error and not out[2].error
    assert G.frames(df.withColumn("frame", F.lit(9))).columns == G.frames(df).columns
    assert G.frames(G.store_texts(spark.createDataFrame([("abc",), (None,)], "text string")).select("media")).count() == 2
