"""Media columns of baseline JPEG: a decoder for DC-only luminance thumbnails, and a lossless carrier for bytes.

The decoder parses the markers of a baseline JPEG (any number of components and sampling factors, restart intervals or
none), Huffman-decodes its scan, and keeps each luminance block's DC coefficient: a thumbnail of an eighth of the
width and height. All restart intervals of a batch of images are decoded side by side in numpy, symbol by symbol.

As a carrier, an image holds a byte in the DC coefficient of each block. The DC step is 8, so a flat block of value v has
the coefficient v - 128 exactly and nothing is lost; the thumbnail is the payload. A row of 64 blocks is a restart
interval, whence payloads are padded to a multiple of 64. Payloads that need more than ROWS rows go into several images,
one after the other.

Defined results: a null or empty payload is padded to one row. A decoder given anything but baseline JPEG raises
JpegError.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, text_of

#: Blocks of a row, and rows of an image at most (its height must stay under 65536).
ACROSS, ROWS = 64, 8191
#: Rows worked on together.
TOGETHER = 1 << 14

#: Numbers of codes by length, and the symbols, of the standard's table for luminance DC.
DC_LENGTHS = (0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0)
DC_SYMBOLS = (0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11)
#: The carrier's AC table has the end of a block alone, with the code 0.
AC_LENGTHS, AC_SYMBOLS = (1, *(0,) * 15), (0,)


class JpegError(ValueError):
    """Not a whole baseline JPEG."""


def codes(lengths: tuple[int, ...], symbols: tuple[int, ...]) -> list[tuple[int, int, int]]:
    """symbol, code, length of a canonical Huffman table."""
    out, code, k = [], 0, 0
    for bits, n in enumerate(lengths, 1):
        for _ in range(n):
            out.append((symbols[k], code, bits))
            code, k = code + 1, k + 1
        code <<= 1
    return out


class Table:
    """For each 16 bits: the symbol they begin with, and the length of its code (0: none)."""

    def __init__(self, lengths: tuple[int, ...], symbols: tuple[int, ...]):
        self.symbol, self.length = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        for s, code, bits in codes(lengths, symbols):
            a = code << (16 - bits)
            self.symbol[a : a + (1 << (16 - bits))], self.length[a : a + (1 << (16 - bits))] = s, bits


@dataclass
class Image:
    """What the markers say; ``scan`` is where the entropy-coded bytes are."""

    width: int = 0
    height: int = 0
    restart: int = 0
    #: id, horizontal and vertical sampling, quantisation table; then DC and AC tables once the scan has named them.
    components: list[list[int]] = field(default_factory=list)
    steps: dict[int, int] = field(default_factory=dict)
    tables: dict[tuple[int, int], tuple[tuple[int, ...], tuple[int, ...]]] = field(default_factory=dict)
    scan: tuple[int, int] = (0, 0)
    end: int = 0

    def key(self) -> tuple:
        """Images with equal keys can be decoded side by side."""
        return tuple((c[1], c[2], self.tables.get((0, c[4])), self.tables.get((1, c[5]))) for c in self.components)


def _segment(data: bytes, at: int) -> tuple[bytes, int]:
    n = int.from_bytes(data[at : at + 2], "big")
    if n < 2 or at + n > len(data):
        raise JpegError("a segment is cut off")
    return data[at + 2 : at + n], at + n


def parsed(data: bytes, at: int = 0) -> Image:
    """The markers of the image that begins at ``at``."""
    if data[at : at + 2] != b"\xff\xd8":
        raise JpegError("no start of image")
    image, at = Image(), at + 2
    while True:
        if at + 2 > len(data) or data[at] != 0xFF:
            raise JpegError("no marker")
        kind, at = data[at + 1], at + 2
        if kind == 0xFF:
            at -= 1
            continue
        if kind == 0xD9:
            raise JpegError("no scan")
        body, at = _segment(data, at)
        if kind == 0xDB:
            k = 0
            while k < len(body):
                wide = 1 + (body[k] >> 4)
                image.steps[body[k] & 15] = int.from_bytes(body[k + 1 : k + 1 + wide], "big")
                k += 1 + 64 * wide
        elif kind == 0xC0:
            if len(body) < 6 or body[0] != 8 or len(body) < 6 + 3 * body[5]:
                raise JpegError("not 8-bit samples")
            image.height, image.width = struct.unpack(">HH", body[1:5])
            image.components = [[body[k], body[k + 1] >> 4, body[k + 1] & 15, body[k + 2]] for k in range(6, 6 + 3 * body[5], 3)]
        elif kind == 0xC4:
            k = 0
            while k < len(body):
                lengths = tuple(body[k + 1 : k + 17])
                image.tables[body[k] >> 4, body[k] & 15] = lengths, tuple(body[k + 17 : k + 17 + sum(lengths)])
                k += 17 + sum(lengths)
        elif kind == 0xDD:
            image.restart = int.from_bytes(body[:2], "big")
        elif kind == 0xDA:
            if not image.width or not image.height or not image.components or body[0] != len(image.components):
                raise JpegError("not one scan of all components after a frame")
            named = {body[1 + 2 * k]: body[2 + 2 * k] for k in range(body[0])}
            for c in image.components:
                if c[0] not in named or not c[1] or not c[2] or c[3] not in image.steps:
                    raise JpegError("a component without tables")
                c += [named[c[0]] >> 4, named[c[0]] & 15]
                if (0, c[4]) not in image.tables or (1, c[5]) not in image.tables:
                    raise JpegError("a component without tables")
            break
        elif kind in (0xC1, 0xC2, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)):
            raise JpegError("not baseline")
    start = at
    while True:  # the scan ends at the first marker that is no restart
        at = data.find(b"\xff", at)
        if at < 0 or at + 1 >= len(data):
            raise JpegError("no end of image")
        if data[at + 1] == 0 or 0xD0 <= data[at + 1] <= 0xD7:
            at += 2
        elif data[at + 1] == 0xFF:
            at += 1
        else:
            break
    if data[at + 1] != 0xD9:
        raise JpegError("more than one scan")
    image.scan, image.end = (start, at), at + 2
    return image


def _shape(image: Image) -> tuple[int, int, int, int]:
    """MCUs across and down, luminance blocks across and down."""
    h, v = (max(c[k] for c in image.components) for k in (1, 2))
    c = image.components[0]
    if len(image.components) == 1:  # a scan of one component has no MCUs but its blocks
        across, down = -(-image.width // 8), -(-image.height // 8)
        return across, down, across, down
    across, down = -(-image.width // (8 * h)), -(-image.height // (8 * v))
    return across, down, across * c[1], down * c[2]


def _intervals(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entropy-coded bytes without stuffing and restart markers; where each interval begins; how long it is."""
    mark = np.flatnonzero(raw[:-1] == 0xFF) if len(raw) > 1 else np.zeros(0, np.int64)
    after = raw[mark + 1]
    keep = np.ones(len(raw), bool)
    keep[mark[after == 0] + 1] = False
    cut = mark[(after >= 0xD0) & (after <= 0xD7)]
    keep[cut] = keep[cut + 1] = False
    kept = np.cumsum(keep)
    starts = np.concatenate([[0], kept[cut]])
    return raw[keep], starts, np.diff(np.append(starts, kept[-1] if len(raw) else 0))


def thumbnails(files: list[bytes]) -> list[list[tuple[Image, np.ndarray]]]:
    """For each file its images, each with its luminance thumbnail (uint8, an eighth of the size)."""
    out: list[list[tuple[Image, np.ndarray]]] = []
    jobs: dict[tuple, list[tuple[int, int, Image, bytes]]] = {}
    for f, data in enumerate(files):
        found, at = [], 0
        while at < len(data):
            image = parsed(data, at)
            jobs.setdefault(image.key(), []).append((f, len(found), image, data[image.scan[0] : image.scan[1]]))
            found.append((image, np.zeros((0, 0), np.uint8)))
            at = image.end
        if not found:
            raise JpegError("no image")
        out.append(found)
    for key, own in jobs.items():
        for (f, k, image, _), dc in zip(own, _decoded(key, own), strict=True):
            _, _, across, down = _shape(image)
            level = dc * image.steps[image.components[0][3]] / 8 + 128
            out[f][k] = image, np.clip(np.round(level[:down, :across]), 0, 255).astype(np.uint8)[: -(-image.height // 8), : -(-image.width // 8)]
    return out


def _decoded(key: tuple, own: list[tuple[int, int, Image, bytes]]) -> list[np.ndarray]:
    """The luminance DC coefficients of images with equal tables, decoded interval by interval side by side."""
    parts, starts, lengths, mcus, owners = [], [], [], [], []
    at = 0
    for k, (_, _, image, scan) in enumerate(own):
        across, down, _, _ = _shape(image)
        raw, start, length = _intervals(np.frombuffer(scan, np.uint8))
        each = image.restart or across * down
        need = -(-across * down // each)
        if len(start) != need:
            raise JpegError("not as many restart intervals as the size asks for")
        parts.append(raw)
        starts.append(start + at)
        lengths.append(length)
        n = np.full(need, each)
        n[-1] = across * down - each * (need - 1)
        mcus.append(n)
        owners.append(np.full(need, k))
        at += len(raw)
    data = np.concatenate([*parts, np.zeros(8, np.uint8)]).astype(np.int64)
    # Any byte and the three after it as one number, so that 16 bits at any place are one look-up.
    quads = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]
    start, length, mcu, owner = (np.concatenate(x) for x in (starts, lengths, mcus, owners))
    single = len(key) == 1
    blocks = [c for c, (h, v, _, _) in enumerate(key) for _ in range(1 if single else h * v)]
    luma = sum(c == 0 for c in blocks)
    tables = [(Table(*dc), Table(*ac)) for _, _, dc, ac in key]
    pos, stop = start * 8, (start + length) * 8
    value = np.zeros((len(key), len(start)), np.int64)
    most = int(mcu.max())
    result = np.zeros((len(start), most, luma), np.int32)

    def symbols(lanes: np.ndarray, t: Table) -> np.ndarray:
        p = pos[lanes]
        peek = (quads[p >> 3] >> (16 - (p & 7))) & 0xFFFF
        n = t.length[peek]
        if not n.all():
            raise JpegError("no such code")
        pos[lanes] = p + n
        return t.symbol[peek]

    def bits(lanes: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The next n bits as a difference (16 at most)."""
        p = pos[lanes]
        x = (quads[p >> 3] >> (32 - (p & 7) - n)) & ((1 << n) - 1)
        pos[lanes] = p + n
        return np.where((n > 0) & (x < (1 << np.maximum(n - 1, 0))), x - (1 << n) + 1, x)

    for m in range(most):
        lanes = np.flatnonzero(mcu > m) if m >= int(mcu.min()) else np.arange(len(mcu))
        seen = 0
        for c in blocks:
            dc, ac = tables[c]
            size = symbols(lanes, dc)
            if (size > 11).any():
                raise JpegError("no such difference")
            value[c, lanes] += bits(lanes, size)
            if c == 0:
                result[lanes, m, seen] = value[0, lanes]
                seen += 1
            open_, k = lanes, np.ones(len(lanes), np.int64)
            while len(open_):
                s = symbols(open_, ac)
                k += np.where(s == 0xF0, 16, (s >> 4) + 1)
                pos[open_] += s & 15
                on = (s != 0) & (k < 64)
                open_, k = open_[on], k[on]
        if (pos > stop).any():
            raise JpegError("the scan is cut off")
    out = []
    for k, (_, _, image, _) in enumerate(own):
        across, down, wide, high = _shape(image)
        mine = owner == k
        flat = result[mine].reshape(-1, luma)
        if not (mcu[mine] == most).all():
            flat = flat[(np.arange(most) < mcu[mine][:, None]).ravel()]
        h, v = (1, 1) if single else key[0][:2]
        out.append(flat[: across * down].reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(high, wide))
    return out


def _words() -> tuple[np.ndarray, np.ndarray]:
    """For each difference + 255: the bits that say it and end the block, and how many they are."""
    dc = {s: (code, bits) for s, code, bits in codes(DC_LENGTHS, DC_SYMBOLS)}
    word, length = np.zeros(511, np.uint64), np.zeros(511, np.int64)
    for d in range(-255, 256):
        size = abs(d).bit_length()
        code, bits = dc[size]
        low = d if d >= 0 else d + (1 << size) - 1
        word[d + 255], length[d + 255] = ((code << size) | low) << 1, bits + size + 1
    return word, length


_WORD, _LENGTH = _words()


def _entropy(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stuffed bytes of all rows (n x 64), and where each row begins (one more entry than rows)."""
    n = len(rows)
    level = rows.astype(np.int64) - 128
    diff = level.copy()
    diff[:, 1:] -= level[:, :-1]
    diff += 255
    length = _LENGTH[diff]
    ends = np.cumsum(length, axis=1)
    size = (ends[:, -1] + 7) >> 3
    first = np.concatenate([[0], np.cumsum(size)])
    at = (first[:-1, None] * 8 + ends - length).ravel()
    length = length.ravel()
    # A word and its offset take at most 25 bits: four bytes, of which each is owned in part by several words.
    word = (_WORD[diff].ravel() << (32 - (at & 7) - length).astype(np.uint64)).astype(np.int64)
    byte = at >> 3
    raw = np.zeros(int(first[-1]) + 4, np.int64)
    for k in range(4):
        raw += np.bincount(byte + k, (word >> (24 - 8 * k)) & 0xFF, len(raw)).astype(np.int64)
    raw = raw[: int(first[-1])].astype(np.uint8)
    pad = (-ends[:, -1]) & 7
    raw[first[1:] - 1] |= ((1 << pad) - 1).astype(np.uint8)  # the rest of a row's last byte is ones
    full = np.flatnonzero(raw == 0xFF)
    stuffed = np.insert(raw, full + 1, 0)
    return stuffed, first + np.searchsorted(full, first)


def _head(rows: int) -> bytes:
    part = lambda kind, body: struct.pack(">BBH", 0xFF, kind, len(body) + 2) + body
    return (
        b"\xff\xd8"
        + part(0xDB, bytes([0]) + bytes([8]) + bytes([1] * 63))
        + part(0xC0, struct.pack(">BHHBBBB", 8, 8 * rows, 8 * ACROSS, 1, 1, 0x11, 0))
        + part(0xC4, bytes([0x00, *DC_LENGTHS, *DC_SYMBOLS]))
        + part(0xC4, bytes([0x10, *AC_LENGTHS, *AC_SYMBOLS]))
        + part(0xDD, struct.pack(">H", ACROSS))
        + part(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))
    )


def padded(payload: bytes) -> bytes:
    return payload + bytes(-len(payload) % ACROSS or (0 if payload else ACROSS))


def encoded(payloads: list[bytes]) -> list[bytes]:
    """Each padded payload as one or more images, one after the other."""
    rows = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, ACROSS)
    ends = np.cumsum([len(p) // ACROSS for p in payloads])
    data, starts = _entropy(rows)
    data = data.tobytes()
    out, row = [], 0
    for end in ends.tolist():
        parts = []
        while row < end:
            n = min(ROWS, end - row)
            parts.append(_head(n))
            for r in range(n):
                parts.append(data[starts[row + r] : starts[row + r + 1]])
                parts.append(b"\xff\xd9" if r == n - 1 else bytes([0xFF, 0xD0 + r % 8]))
            row += n
        out.append(b"".join(parts))
    return out


def decoded(files: list[bytes]) -> list[bytes]:
    """The payloads back, from the thumbnails."""
    return [b"".join(t.tobytes() for _, t in images) for images in thumbnails(files)]


def hashed(images: list[tuple[Image, np.ndarray]]) -> str:
    """Width and total height of a payload's images, their number, and an average and a difference hash of their thumbnails put
    one below the other."""
    width, height = images[0][0].width, sum(image.height for image, _ in images)
    t = np.concatenate([t for _, t in images])
    t = np.repeat(np.repeat(t, -(-8 // t.shape[0]), 0), -(-9 // t.shape[1]), 1)
    rows, cols = (np.linspace(0, n, k + 1).astype(int) for n, k in ((t.shape[0], 8), (t.shape[1], 9)))
    sums = np.add.reduceat(np.add.reduceat(t, rows[:-1], 0, dtype=np.int64), cols[:-1], 1)
    grid = sums / np.outer(np.diff(rows), np.diff(cols))
    bits = lambda b: np.packbits(b).tobytes().hex()
    return f"{width}x{height}x{len(images)}:a{bits(grid[:, :8] > grid[:, :8].mean())}:d{bits(grid[:, 1:] > grid[:, :-1])}"


_MEDIA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
_THUMBNAIL = "id long, width long, height long, images long, thumbnail_hash string, thumbnail binary"


def _names(schema: str) -> list[str]:
    return [c.split(" ")[0] for c in schema.split(", ")]


def _groups(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of payloads that take about TOGETHER rows; a longer one is a range of its own."""
    i = 0
    while i < len(sizes):
        j, n = i, 0
        while j < len(sizes) and (j == i or n + sizes[j] <= TOGETHER * ACROSS):
            n += sizes[j] + ACROSS
            j += 1
        yield i, j
        i = j


def _stored_one(text: bytes) -> Iterator[tuple[bytes, list[tuple[Image, np.ndarray]]]]:
    """A long payload image by image, each written and read back."""
    for at in range(0, len(text), ROWS * ACROSS):
        (file,) = encoded([padded(text[at : at + ROWS * ACROSS])])
        yield file, thumbnails([file])[0]


def _told(text: bytes, files: list[bytes], images: list[tuple[Image, np.ndarray]]) -> tuple:
    payload, media, n = hashlib.sha256(), hashlib.sha256(), 0
    for _, t in images:
        payload.update(t.tobytes())
        n += t.size
    for f in files:
        media.update(f)
    return len(text), n, payload.hexdigest(), zlib.crc32(images[-1][1][-1].tobytes()), sum(map(len, files)), media.hexdigest(), hashed(images)


def _carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [x or b"" for x in b.column(1).cast(pa.binary()).to_pylist()]
        for i, j in _groups([len(t) for t in texts]):
            if j - i == 1 and len(texts[i]) > TOGETHER * ACROSS:
                files, images = map(list, zip(*_stored_one(texts[i]), strict=True))
                rows = [_told(texts[i], files, [x for one in images for x in one])]
            else:
                files = encoded([padded(t) for t in texts[i:j]])
                rows = [_told(t, [f], images) for t, f, images in zip(texts[i:j], files, thumbnails(files), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), *map(pa.array, zip(*rows, strict=True))], _names(_MEDIA))


def carried(docs: DataFrame) -> DataFrame:
    """Every text as images and back: sizes and digests of payload and media, and the thumbnail's hashes.

    What ``stored`` and ``thumbnailed`` do, one after the other, without the images leaving the worker."""
    bound_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(_carried, _MEDIA)


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [x or b"" for x in b.column(1).cast(pa.binary()).to_pylist()]
        for i, j in _groups([len(t) for t in texts]):
            if j - i == 1 and len(texts[i]) > TOGETHER * ACROSS:
                files = [b"".join(f for f, _ in _stored_one(texts[i]))]
            else:
                files = encoded([padded(t) for t in texts[i:j]])
            yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(files, pa.binary())], ["doc_id", "media"])


def stored(docs: DataFrame) -> DataFrame:
    """doc_id, media: each text as baseline JPEG, several images one after the other if it is long."""
    bound_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(_stored, "doc_id long, media binary")


def _thumbnailed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        files = b.column(1).to_pylist()
        for i, j in _groups([len(f or b"") for f in files]):
            own = [f for f in files[i:j] if f is not None]
            found = iter(thumbnails(own))
            rows = []
            for f in files[i:j]:
                if f is None:
                    rows.append((None,) * 5)
                    continue
                images = next(found)
                rows.append((images[0][0].width, sum(x.height for x, _ in images), len(images), hashed(images), b"".join(t.tobytes() for _, t in images)))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], _names(_THUMBNAIL))


def thumbnailed(media: DataFrame, column: str = "media", key: str = "doc_id") -> DataFrame:
    """id, width, height, images, thumbnail_hash, thumbnail (DC luminance, row by row) of a column of baseline JPEG files.

    A file may hold several images one after the other; height is that of all. Null gives nulls; anything else raises JpegError."""
    bound_batches(media.sparkSession)
    return media.select(F.col(key).cast("long").alias("id"), F.col(column).cast("binary").alias("media")).mapInArrow(_thumbnailed, _THUMBNAIL)
