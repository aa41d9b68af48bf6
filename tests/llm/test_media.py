import hashlib
import os
import struct
import zlib

import numpy as np
import pytest

from cairn.llm import media as M

from .helpers import awkward, documents


@pytest.mark.parametrize("payload", [b"", b"a", b"hello" * 30, os.urandom(5000), bytes([255, 0] * 200), b"\xff" * 640, bytes(range(256)) * 9])
def test_payloads_come_back(payload):
    p = M.padded(payload)
    assert len(p) % 64 == 0 and p.startswith(payload) and 0 < len(p) < len(payload) + 65
    (f,) = M.encoded([p])
    assert M.decoded([f]) == [p]
    assert f[:2] == b"\xff\xd8" and f[-2:] == b"\xff\xd9"


def test_long_payloads_take_several_images(monkeypatch):
    monkeypatch.setattr(M, "ROWS", 7)
    p = M.padded(os.urandom(64 * 30))
    (f,) = M.encoded([p])
    images = M.thumbnails([f])[0]
    assert [t.shape for _, t in images] == [(7, 64)] * 4 + [(2, 64)] and M.decoded([f]) == [p]


def test_many_files_at_once():
    ps = [M.padded(os.urandom(k * 37)) for k in range(40)]
    assert M.decoded(M.encoded(ps)) == ps


class Bits:
    """Writes codes one after the other, as a scan does."""

    def __init__(self):
        self.bits = ""

    def add(self, value, n):
        self.bits += f"{value:0{n}b}" if n else ""

    def flush(self):
        b = self.bits + "1" * (-len(self.bits) % 8)
        self.bits = ""
        raw = bytes(int(b[k : k + 8], 2) for k in range(0, len(b), 8))
        return raw.replace(b"\xff", b"\xff\x00")


AC = ((0, 2, 1, 2) + (0,) * 12, (0x00, 0x01, 0x11, 0xF0, 0x02))


def jpeg(width, height, sampling, dcs, restart=0, seed=0):
    """A JPEG with random AC coefficients, written symbol by symbol; dcs: by component, in scan order."""
    rng = np.random.default_rng(seed)
    dc_codes = {s: (c, n) for s, c, n in M.codes(M.DC_LENGTHS, M.DC_SYMBOLS)}
    ac_codes = {s: (c, n) for s, c, n in M.codes(*AC)}
    n = len(sampling)
    h, v = max(s[0] for s in sampling), max(s[1] for s in sampling)
    mcus = -(-width // (8 * h)) * -(-height // (8 * v)) if n > 1 else -(-width // 8) * -(-height // 8)
    part = lambda kind, body: struct.pack(">BBH", 0xFF, kind, len(body) + 2) + body
    out = b"\xff\xd8" + part(0xE0, b"JFIF\0") + part(0xDB, bytes([0] + [4] + [1] * 63)) + part(0xDB, bytes([0x11]) + struct.pack(">64H", *[300] * 64))
    out += part(0xC0, struct.pack(">BHHB", 8, height, width, n) + b"".join(bytes([k + 1, s[0] << 4 | s[1], min(k, 1)]) for k, s in enumerate(sampling)))
    out += part(0xC4, bytes([0x00, *M.DC_LENGTHS, *M.DC_SYMBOLS]) + bytes([0x10, *AC[0], *AC[1]]))
    out += part(0xDD, struct.pack(">H", restart)) if restart else b""
    out += part(0xDA, bytes([n]) + b"".join(bytes([k + 1, 0]) for k in range(n)) + bytes([0, 63, 0]))
    bits, last, at = Bits(), [0] * n, [0] * n
    for m in range(mcus):
        if restart and m and m % restart == 0:
            out += bits.flush() + bytes([0xFF, 0xD0 + (m // restart - 1) % 8])
            last = [0] * n
        for k, s in enumerate(sampling):
            for _ in range(s[0] * s[1] if n > 1 else 1):
                d = dcs[k][at[k]] - last[k]
                last[k] = dcs[k][at[k]]
                at[k] += 1
                size = abs(d).bit_length()
                bits.add(*dc_codes[size])
                bits.add(d if d >= 0 else d + (1 << size) - 1, size)
                place = 1
                while place < 64 and rng.random() < 0.7:
                    symbol = int(rng.choice([0x01, 0x11, 0xF0, 0x02]))
                    step = 16 if symbol == 0xF0 else (symbol >> 4) + 1
                    if place + step > 63:
                        break
                    bits.add(*ac_codes[symbol])
                    bits.add(int(rng.integers(0, 1 << (symbol & 15))) if symbol & 15 else 0, symbol & 15)
                    place += step
                bits.add(*ac_codes[0])
    return out + bits.flush() + b"\xff\xd9"


@pytest.mark.parametrize("sampling, restart", [([(1, 1)], 0), ([(1, 1)], 5), ([(1, 1), (1, 1), (1, 1)], 0), ([(2, 2), (1, 1), (1, 1)], 3), ([(2, 1), (1, 1), (1, 1)], 1)])
def test_any_baseline_image(sampling, restart):
    rng, width, height = np.random.default_rng(4), 100, 52
    h, v = (max(s[k] for s in sampling) for k in (0, 1))
    if len(sampling) == 1:
        across, down = 13, 7
        blocks = [across * down]
    else:
        across, down = -(-width // (8 * h)), -(-height // (8 * v))
        blocks = [across * down * s[0] * s[1] for s in sampling]
    dcs = [rng.integers(-250, 250, n).tolist() for n in blocks]
    ((image, got),) = M.thumbnails([jpeg(width, height, sampling, dcs, restart)])[0]
    flat = np.array(dcs[0])
    if len(sampling) > 1:
        flat = flat.reshape(down, across, sampling[0][1], sampling[0][0]).transpose(0, 2, 1, 3)
        flat = flat.reshape(down * sampling[0][1], across * sampling[0][0])
    else:
        flat = flat.reshape(down, across)
    want = np.clip(np.round(flat * 4 / 8 + 128), 0, 255)[:7, :13]
    assert (image.width, image.height) == (100, 52) and (got == want).all()


def test_damage_is_an_error():
    (f,) = M.encoded([M.padded(b"some text " * 40)])
    at = f.index(b"\xff\xc0")
    for bad in (b"", f[2:], f[:-2], f[:at], f[:at] + b"\xff\xc2" + f[at + 2 :], f[:-20] + f[-2:], f[: at + 20] + b"\xff\xd9"):
        with pytest.raises(M.JpegError):
            M.thumbnails([bad])


def test_tables(spark):
    rows = awkward()
    got = M.carried(documents(spark, rows, clashing=True)).collect()
    assert len(got) == len(rows)
    texts = {(i, len((t or "").encode())): t or "" for i, t, *_ in rows}
    seen = {}
    for r in got:
        raw = texts[r.doc_id, r.n_bytes].encode()
        p = raw + bytes(64 - len(raw) % 64 if len(raw) % 64 or not raw else 0)
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert seen.setdefault(raw, tuple(r)[1:]) == tuple(r)[1:]
        (f,) = M.encoded([p])
        assert r.media_bytes == len(f) and r.media_sha256 == hashlib.sha256(f).hexdigest()
    assert M.carried(documents(spark, [])).collect() == []


def test_hashes_see_every_image():
    beginning = bytes(range(64)) * M.ROWS
    one, two, again = (M.hashed(M.thumbnails(M.encoded([beginning + end * M.ROWS]))[0]) for end in (bytes(64), bytes(range(63, -1, -1)), bytes(64)))
    assert one == again and one != two
    assert one.startswith(f"{8 * 64}x{2 * 8 * M.ROWS}x2:")
