"""Progressive JPEG: the payload's round trip, and the decoder against a plain encoder and a plain transform."""

import math
import random
import struct
import zlib

import numpy as np
import pytest

from spanforge.llm.progressive_jpeg import AC_BITS, ZIGZAG, decode_files, encode_payloads, padded, parse, payload_of, rgb_tensors, with_media, with_pictures


class Bits:
    def __init__(self):
        self.out, self.acc, self.n = bytearray(), 0, 0

    def put(self, value, n):
        for i in range(n - 1, -1, -1):
            self.acc, self.n = self.acc << 1 | (value >> i & 1), self.n + 1
            if self.n == 8:
                self.out.append(self.acc)
                if self.acc == 0xFF:
                    self.out.append(0)
                self.acc = self.n = 0

    def end(self):
        while self.n:
            self.put(1, 1)
        return bytes(self.out)


def category(v):
    return abs(v).bit_length()


def bits_of(v):
    c = category(v)
    return (v if v >= 0 else v + (1 << c) - 1), c


#: All 256 symbols with codes of nine bits: 9-bit canonical codes in order.
TABLE = bytes([0] * 8 + [255] + [0] * 7) + bytes(s for s in range(256) if s != 255)


def put_symbol(bits, s):
    bits.put(s, 9)


def segment(marker, body):
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def plain_encode(width, height, sampling, planes, restart):
    """One component or several, DC and AC with two bits of successive approximation, symbol by symbol as the standard says."""
    comps = len(sampling)
    h, v = max(s[0] for s in sampling), max(s[1] for s in sampling)
    down, across = -(-height // (8 * v)), -(-width // (8 * h))
    out = b"\xff\xd8" + segment(0xDB, b"\0" + bytes(range(1, 65))) + segment(0xC4, b"\x00" + TABLE) + segment(0xC4, b"\x10" + TABLE)
    out += segment(0xC2, struct.pack(">BHHB", 8, height, width, comps) + b"".join(bytes([c + 1, s[0] << 4 | s[1], 0]) for c, s in enumerate(sampling)))
    out += segment(0xDD, struct.pack(">H", restart)) if restart else b""

    def scan(cs, ss, se, ah, al, units, write):
        data, n = b"", 0
        for first in range(0, len(units), restart or len(units)):
            bits = Bits()
            write(bits, units[first : first + (restart or len(units))])
            data += (bytes([0xFF, 0xD0 + (n - 1) % 8]) if n else b"") + bits.end()
            n += 1
        return segment(0xDA, bytes([len(cs), *[x for c in cs for x in (c + 1, 0)], ss, se, ah << 4 | al])) + data

    mcus = []
    for y in range(down):
        for x in range(across):
            mcus.append([(c, y * s[1] + j, x * s[0] + i) for c, s in enumerate(sampling) for j in range(s[1]) for i in range(s[0])])
    if comps == 1:
        mcus = [[(0, y, x)] for y in range(-(-height // 8)) for x in range(-(-width // 8))]

    def dc_first(bits, units):
        pred = [0] * comps
        for unit in units:
            for c, y, x in unit:
                value = int(planes[c][y, x, 0]) >> 1
                code, n = bits_of(value - pred[c])
                put_symbol(bits, n)
                bits.put(code, n)
                pred[c] = value

    def dc_next(bits, units):
        for unit in units:
            for c, y, x in unit:
                bits.put(int(planes[c][y, x, 0]) & 1, 1)

    shift = lambda v, al: (abs(v) >> al) * (1 if v > 0 else -1)

    def ac_first(c, ss, se, al):
        def write(bits, units):
            for y, x in units:
                run = 0
                for k in range(ss, se + 1):
                    v = shift(int(planes[c][y, x, k]), al)
                    if not v:
                        run += 1
                        continue
                    while run > 15:
                        put_symbol(bits, 0xF0)
                        run -= 16
                    code, n = bits_of(v)
                    put_symbol(bits, run << 4 | n)
                    bits.put(code, n)
                    run = 0
                if run:
                    put_symbol(bits, 0)

        return write

    def ac_next(c, ss, se, al):
        def write(bits, units):
            for y, x in units:
                block = [int(planes[c][y, x, k]) for k in range(64)]
                fresh = [k for k in range(ss, se + 1) if abs(block[k]) >> al == 1]
                last, run, pending = (fresh[-1] if fresh else -1), 0, []
                for k in range(ss, se + 1):
                    size = abs(block[k]) >> al
                    if size > 1:
                        pending.append(size & 1)
                        continue
                    if size == 0:
                        if k < last and run == 15:
                            put_symbol(bits, 0xF0)
                            for b in pending:
                                bits.put(b, 1)
                            run, pending = 0, []
                        else:
                            run += 1
                        continue
                    put_symbol(bits, run << 4 | 1)
                    bits.put(block[k] > 0, 1)
                    for b in pending:
                        bits.put(b, 1)
                    run, pending = 0, []
                if run or pending:
                    put_symbol(bits, 0)
                    for b in pending:
                        bits.put(b, 1)

        return write

    every = tuple(range(comps))
    out += scan(every, 0, 0, 0, 1, mcus, dc_first)
    for c, s in enumerate(sampling):
        own = [(y, x) for y in range(-(-(-(-height * s[1] // v)) // 8)) for x in range(-(-(-(-width * s[0] // h)) // 8))]
        out += scan((c,), 1, 5, 0, 2, own, ac_first(c, 1, 5, 2)) + scan((c,), 6, 63, 0, 2, own, ac_first(c, 6, 63, 2))
        out += scan((c,), 1, 63, 2, 1, own, ac_next(c, 1, 63, 1)) + scan((c,), 1, 63, 1, 0, own, ac_next(c, 1, 63, 0))
    return out + scan(every, 0, 0, 1, 0, mcus, dc_next) + b"\xff\xd9"


def plain_samples(block, table):
    out = np.zeros((8, 8))
    for k in range(64):
        u, v = divmod(int(ZIGZAG[k]), 8)
        if value := int(block[k]) * table[k]:
            for y in range(8):
                for x in range(8):
                    out[y, x] += value * (math.sqrt(0.5) if u == 0 else 1) * (math.sqrt(0.5) if v == 0 else 1) / 4 * math.cos((2 * y + 1) * u * math.pi / 16) * math.cos((2 * x + 1) * v * math.pi / 16)
    return out + 128


@pytest.mark.parametrize("sampling,size,restart", [([(2, 2), (1, 1), (1, 1)], (37, 21), 0), ([(2, 2), (1, 1), (1, 1)], (33, 17), 2), ([(1, 1)], (19, 11), 1), ([(2, 1), (1, 1), (1, 1)], (24, 9), 3), ([(1, 1)] * 3, (8, 8), 0)])
def test_decoder(sampling, size, restart):
    rng = np.random.default_rng(8)
    width, height = size
    h, v = max(s[0] for s in sampling), max(s[1] for s in sampling)
    down, across = -(-height // (8 * v)), -(-width // (8 * h))
    planes, kept = [], []
    for c, s in enumerate(sampling):
        p = np.zeros((down * s[1], across * s[0], 64), int)
        p[:, :, 0] = rng.integers(-60, 60, p.shape[:2])
        hit = rng.random(p.shape) < np.array([0.35, 0.02])[rng.integers(0, 2, p.shape[:2])][:, :, None]
        hit[:, :, 0] = False
        p[hit] = rng.integers(-7, 8, hit.sum())
        own = (-(-(-(-height * s[1] // v)) // 8), -(-(-(-width * s[0] // h)) // 8))
        p[own[0] :, :, 1:] = 0
        p[:, own[1] :, 1:] = 0
        if len(sampling) == 1:
            p = p[: own[0], : own[1]]
        planes.append(p)
    data = plain_encode(width, height, sampling, planes, restart)
    first, second = decode_files([data, data])
    for a, b, c in zip(first.planes, second.planes, planes):
        assert (a[: c.shape[0], : c.shape[1]] == c).all() and (b[: c.shape[0], : c.shape[1]] == c).all()
    rgb = rgb_tensors([first])[0]
    assert rgb.shape == (height, width, 3)
    if len(sampling) == 1:
        want = np.clip(np.floor(plain_samples(planes[0][0, 0], list(range(1, 65))) + 0.5), 0, 255)
        assert np.abs(rgb[:8, :8, 0].astype(int) - want[: min(8, height), : min(8, width)]).max() <= 1
    else:
        y = plain_samples(planes[0][0, 0], list(range(1, 65)))[0, 0]
        cb, cr = (plain_samples(planes[c][0, 0], list(range(1, 65)))[0, 0] for c in (1, 2))
        y, cb, cr = (min(255, max(0, math.floor(q + 0.5))) for q in (y, cb, cr))
        want = [y + 1.402 * (cr - 128), y - 0.344136 * (cb - 128) - 0.714136 * (cr - 128), y + 1.772 * (cb - 128)]
        assert all(abs(int(rgb[0, 0, k]) - min(255, max(0, w))) <= 2 for k, w in enumerate(want))


def test_refused():
    good = encode_payloads([padded(b"abc")])[0]
    assert sum(AC_BITS) == 16
    for bad in (b"", b"GIF89a", good.replace(b"\xff\xc2", b"\xff\xc0"), good.replace(b"\xff\xc2", b"\xff\xc9")):
        with pytest.raises(ValueError):
            parse(bad)


def test_payloads():
    rng = random.Random(2)
    payloads = [padded(b""), padded(b"x"), bytes(range(256)) * 3, bytes([255]) * 1920, bytes(192), padded(rng.randbytes(70_001)), padded(rng.randbytes(384 * 65 - 1))]
    for p, picture in zip(payloads, decode_files(encode_payloads(payloads))):
        assert payload_of(picture) == p and len(p) % 192 == 0
    alone = [encode_payloads([p])[0] for p in payloads]
    assert alone == encode_payloads(payloads)  # a file doesn't depend on its batch
    tensors = rgb_tensors(decode_files(alone))
    assert all((a == rgb_tensors(decode_files([f]))[0]).all() for a, f in zip(tensors, alone))


def test_columns(spark):
    rows = [(1, "héllo"), (2, None), (3, ""), (None, "z"), (1, "héllo"), (4, "long " * 60_000)]
    df = spark.createDataFrame([(i, t, "c", 1) for i, t in rows], "doc_id bigint, text string, payload string, height int")
    got = with_pictures(with_media(df))
    assert got.columns == ["doc_id", "text", "media", "payload", "height", "width", "rgb"]
    found = got.collect()
    assert len(found) == len(rows)
    for r in found:
        assert bytes(r.payload) == padded((r.text or "").encode()) and len(r.rgb) == r.height * r.width * 3
    same = [zlib.crc32(r.media) for r in found if r.doc_id == 1]
    assert len(same) == 2 and len(set(same)) == 1
    other = spark.createDataFrame([(1, None)], "doc_id bigint, media binary")
    assert with_pictures(other).first().rgb is None
    assert with_pictures(with_media(df.limit(0))).collect() == []


def test_query_keeps_few_tensors_at_a_time(spark, tmp_path, monkeypatch):
    """Every row's digests are those of its whole text, and its tensor's feature is right, though only a part of the tensors is on disk at once."""
    import hashlib
    from collections import Counter
    from pathlib import Path

    from spanforge.llm import queries

    rng = random.Random(4)
    rows = [(i, "".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xC0, 0x200)])) for _ in range(rng.randrange(3000)))) for i in range(150)]
    rows += [(1000, None), (1001, ""), (None, "no id"), (0, rows[0][1]), (None, "no id")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    folder = Path(spark.sparkContext.getConf().get("spark.checkpoint.dir"))
    before, plain, alive = set(folder.iterdir()), queries.materialize, []

    def watched(df, label, **more):
        out = plain(df, label, **more)
        tables = [p for p in folder.iterdir() if p not in before and p.name.startswith("rgb-tensors")]
        alive.append((label, out.count(), sum(spark.read.parquet(str(p)).count() for p in tables)))
        return out

    monkeypatch.setattr(queries, "materialize", watched)
    got = queries.op1_progressive_jpeg(spark, str(tmp_path)).collect()
    assert sum(n for label, n, _ in alive if label == "rgb-tensors") == len(rows) and max(n for _, _, n in alive) < len(rows) / 4
    want = Counter()
    for i, text in rows:
        payload = padded((text or "").encode())
        (file,) = encode_payloads([payload])
        rgb = rgb_tensors(decode_files([file]))[0]
        feature = f"{rgb.shape[0]}x{rgb.shape[1]}x3:{zlib.crc32(rgb.tobytes()):08x}"
        digests = (hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(file), hashlib.sha256(file).hexdigest(), feature)
        want[i, len((text or "").encode()), len(payload), *digests] += 1
    assert Counter(map(tuple, got)) == want
