import hashlib
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from prospectrum.llm import media
from prospectrum.llm import progressive_jpeg as jpeg


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000))
def test_round_trip(raw):
    payload = media.padded(raw)
    assert jpeg.payload_of(jpeg.decode(jpeg.encode(payload))) == payload


def test_many_units_and_ff_bytes():
    rng = np.random.default_rng(0)
    for payload in (b"\xff" * 6400, rng.bytes(64 * 6 * 5000), bytes(64)):
        assert jpeg.payload_of(jpeg.decode(jpeg.encode(payload))) == payload


class Writer:
    """Writes any coefficients, a symbol at a time: one grey component, tables that give each symbol a 9-bit code."""

    def __init__(self):
        self.bits = ""

    def put(self, value, n):
        self.bits += format(value, f"0{n}b") if n else ""

    def symbol(self, s):
        self.put(s, 9)

    def number(self, v, size):
        self.put(v if v > 0 else v + (1 << size) - 1, size)

    def data(self):
        bits = self.bits + "1" * (-len(self.bits) % 8)
        return int(bits, 2).to_bytes(len(bits) // 8, "big") if bits else b""


def grey_file(coef, rows, cols):
    tables = jpeg.table(0, 0, {9: list(range(255))}) + jpeg.table(1, 0, {9: list(range(255))})
    out = [b"\xff\xd8", jpeg.segment(0xDB, bytes([0]) + bytes([1] * 64)), jpeg.segment(0xC2, bytes([8]) + (rows * 8).to_bytes(2, "big") + (cols * 8).to_bytes(2, "big") + bytes([1, 1, 0x11, 0])), jpeg.segment(0xC4, tables)]
    w, last = Writer(), 0
    for b in coef:
        d = (int(b[0]) >> 1) - last
        last += d
        size = abs(d).bit_length()
        w.symbol(size)
        w.number(d, size)
    out.append(jpeg.scan([1], 0, 0, 0, 0, 0, 1, w.data()))
    w = Writer()
    for b in coef:
        w.put(int(b[0]) & 1, 1)
    out.append(jpeg.scan([1], 0, 0, 0, 0, 1, 0, w.data()))
    for first, end in ((1, 5), (6, 63)):
        w, blank = Writer(), 0
        for b in coef:  # first pass, without the last bit
            v = [int(np.sign(x)) * (abs(int(x)) >> 1) for x in b[first : end + 1]]
            run = 0
            if any(v) and blank:
                n = blank.bit_length() - 1
                w.symbol(n << 4)
                w.put(blank - (1 << n), n)
                blank = 0
            tail = max((i for i, x in enumerate(v) if x), default=-1)
            for x in v[: tail + 1]:
                if not x:
                    run += 1
                    continue
                while run > 15:
                    w.symbol(0xF0)
                    run -= 16
                size = abs(x).bit_length()
                w.symbol(run << 4 | size)
                w.number(x, size)
                run = 0
            if tail + 1 < len(v):
                blank += 1
                if tail >= 0 or blank == 3:
                    n = blank.bit_length() - 1
                    w.symbol(n << 4)
                    w.put(blank - (1 << n), n)
                    blank = 0
        if blank:
            n = blank.bit_length() - 1
            w.symbol(n << 4)
            w.put(blank - (1 << n), n)
        out.append(jpeg.scan([1], 0, 0, first, end, 0, 1, w.data()))
    w = Writer()
    for b in coef:  # the last bit: an end of band after the last new coefficient of each block
        v = [int(x) for x in b[1:]]
        new = [i for i, x in enumerate(v) if abs(x) == 1]
        at = 0
        for i in new:
            zeros = [j for j in range(at, i) if abs(v[j]) < 2]
            while len(zeros) > 15:
                w.symbol(0xF0)
                stop = zeros[15]
                for j in range(at, stop + 1):
                    if abs(v[j]) > 1:
                        w.put(abs(v[j]) & 1, 1)
                at = stop + 1
                zeros = [j for j in range(at, i) if abs(v[j]) < 2]
            w.symbol(len(zeros) << 4 | 1)
            w.put(1 if v[i] > 0 else 0, 1)
            for j in range(at, i):
                if abs(v[j]) > 1:
                    w.put(abs(v[j]) & 1, 1)
            at = i + 1
        if at < 63:
            w.symbol(0)
            for j in range(at, 63):
                if abs(v[j]) > 1:
                    w.put(abs(v[j]) & 1, 1)
    out.append(jpeg.scan([1], 0, 0, 1, 63, 1, 0, w.data()))
    return b"".join(out) + b"\xff\xd9"


@pytest.mark.parametrize("seed", range(4))
def test_reader_of_ordinary_files(seed):
    rng = np.random.default_rng(seed)
    rows, cols = 3, 4
    coef = np.where(rng.random((rows * cols, 64)) < (0.1, 0.3, 0.7, 0.02)[seed], rng.integers(-40, 41, (rows * cols, 64)), 0)
    coef[:, 0] = rng.integers(-200, 200, rows * cols)
    coef[4] = 0
    frame = jpeg.decode(grey_file(coef, rows, cols))
    assert (frame.coefficients[1] == coef).all()
    x = np.zeros((rows * cols, 64))
    x[:, jpeg.ZIGZAG] = coef
    k = np.arange(8)
    basis = np.cos((2 * k[:, None] + 1) * k[None, :] * np.pi / 16) * np.where(k == 0, np.sqrt(1 / 8), 0.5)
    want = np.einsum("xu,yv,nuv->nxy", basis, basis, x.reshape(-1, 8, 8)) + 128
    got = jpeg.samples(frame, 1).reshape(rows, 8, cols, 8).transpose(0, 2, 1, 3).reshape(-1, 8, 8)
    assert np.abs(np.clip(np.rint(want), 0, 255) - got).max() <= 1


def test_op7(spark, sf_dir, edge_docs, empty_docs):
    docs = duckdb.sql(f"select doc_id, text from '{sf_dir}/documents.parquet'").fetchall()
    rows = {r.doc_id: r for r in media.op7_media_jpeg(spark, sf_dir).collect()}
    assert len(rows) == len(docs)
    for d, t in docs:
        raw = (t or "").encode()
        p = media.padded(raw)
        r = rows[d]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        m = jpeg.encode(p)
        assert (r.media_bytes, r.media_sha256) == (len(m), hashlib.sha256(m).hexdigest())
    stored = media.encode_media(edge_docs)
    assert media.digest_media(stored).count() == edge_docs.count()
    rgb = media.decode_media(stored).where("doc_id = 11").first()
    assert len(rgb.rgb) == rgb.width * rgb.height * 3
    assert media.digest_media(media.encode_media(empty_docs)).collect() == []


def test_refinements_are_read_together_as_one_by_one(monkeypatch):
    rng = np.random.default_rng(5)
    files = [jpeg.encode(media.padded(x)) for x in (b"", b"\xff" * 700, b"plain words " * 90, rng.integers(0, 256, 9000, np.uint8).tobytes())]
    opened, bits = [], jpeg.Bits
    monkeypatch.setattr(jpeg, "Bits", lambda part: opened.append(1) or bits(part))
    together = [jpeg.decode(m) for m in files]
    assert len(opened) <= 9 * len(files)  # of 31 scans each
    monkeypatch.setattr(jpeg, "planes_of", lambda *a: None)
    for a, b in zip(together, map(jpeg.decode, files), strict=True):
        assert all((a.coefficients[i] == b.coefficients[i]).all() for i in (1, 2, 3))
