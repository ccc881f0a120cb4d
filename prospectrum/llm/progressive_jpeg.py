"""Progressive JPEG, 4:2:0, written and read with numpy.

The reader accumulates any Huffman-coded progressive (SOF2) 8-bit file: DC and AC scans, spectral selection,
successive approximation, restart intervals. Scans whose bits stand at known places (all DC refinements, AC
refinements below an end-of-band run, tables of a single code) are read as arrays, others symbol by symbol.

The writer stores bytes without loss as quantised coefficients, the format's unit: the byte at place p of a
fixed order is coefficient 256 + p, 64 to a block, quantisers 1. The first scans carry the top bit of DC
(which is always one) and the top three bits of AC, luma's in two bands; refinements add a bit each.
"""

from __future__ import annotations

import re
import struct

import numpy as np

#: Fixed value: place in the 8x8 block (row * 8 + column) of the k-th coefficient of a scan.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (s := i // 8 + i % 8, i // 8 if s % 2 else i % 8)))
TOP = 256
#: Fixed value: bytes that European prose uses most come first, so that the high bits of what is stored
#: are mostly zero and the files shrink in a compressed table. Stored sample: the byte's place.
COMMON = b" etaoinshrdlucmfwypvbgkjxqz.,\n\x00\xc3"
BYTE_AT = np.array([*COMMON, *(b for b in range(256) if b not in COMMON)], np.uint8)
PLACE_OF = np.argsort(BYTE_AT).astype(np.uint8)
BANDS = {1: ((1, 5), (6, 63)), 2: ((1, 63),), 3: ((1, 63),)}
AC_LOW = 6
MOST_UNITS = 4095  # of 16 samples, in either direction
END_OF_SCAN = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")
RESTART = re.compile(rb"\xff[\xd0-\xd7]")


def layout(blocks: int) -> tuple[int, int]:
    """Rows and columns of minimum coded units (six blocks each) for at least so many blocks."""
    units = max(1, -(-blocks // 6))
    rows = -(-units // MOST_UNITS)
    return rows, -(-units // rows)


def unit_order(rows: int, cols: int) -> np.ndarray:
    """Raster places of the luma blocks in the order of interleaved scans."""
    at = np.arange(4 * rows * cols).reshape(rows, 2, cols, 2)
    return at.transpose(0, 2, 1, 3).reshape(-1, 4)


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def table(kind: int, number: int, codes: dict[int, list[int]]) -> bytes:
    """A Huffman table; codes: length -> symbols."""
    return bytes([kind << 4 | number, *(len(codes.get(n, ())) for n in range(1, 17)), *(s for n in sorted(codes) for s in codes[n])])


def scan(components: list[int], dc: int, ac: int, first: int, last: int, high: int, low: int, data: bytes) -> bytes:
    head = bytes([len(components), *(x for c in components for x in (c, dc << 4 | ac)), first, last, high << 4 | low])
    return segment(0xDA, head) + data.replace(b"\xff", b"\xff\x00")


def packed(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of bytes, filled up with ones."""
    short = -bits.shape[-1] % 8
    if short:
        bits = np.concatenate([bits, np.ones((*bits.shape[:-1], short), np.uint8)], axis=-1)
    return np.packbits(bits, axis=-1)


def run_prefixes(blocks: int) -> list[tuple[int, list[int]]]:
    """End-of-band runs that cover the blocks: (blocks, code and extra bits). Run class n has the 4-bit code n."""
    out = []
    while blocks:
        r = min(blocks, 32767)
        n = r.bit_length() - 1
        out.append((r, [n >> 3 & 1, n >> 2 & 1, n >> 1 & 1, n & 1, *((r >> i) & 1 for i in range(n - 1, -1, -1))]))
        blocks -= r
    return out


def encode(payload: bytes) -> bytes:
    """A JPEG file that holds the payload, whose length is a positive multiple of 64."""
    data = PLACE_OF[np.frombuffer(payload, np.uint8)].reshape(-1, 64)
    rows, cols = layout(len(data))
    units = rows * cols
    full = np.zeros((6 * units, 64), np.uint8)
    full[: len(data)] = data
    parts = [full[: 4 * units], full[4 * units : 5 * units], full[5 * units :]]
    out = [b"\xff\xd8", segment(0xFE, b"payload %d" % len(payload)), segment(0xDB, bytes([0]) + bytes([1] * 64))]
    out.append(segment(0xC2, struct.pack(">BHHB", 8, 16 * rows, 16 * cols, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])))
    out.append(segment(0xC4, table(0, 0, {1: [0], 2: [1]}) + table(1, 0, {1: [0x03]}) + table(1, 1, {4: [n << 4 for n in range(15)]})))
    top = np.zeros(6 * units + 6, np.uint8)  # size 1 and its bit for the first block of a component, then size 0
    top[[0, 2, 6, 8, 9, 11]] = 1
    out.append(scan([1, 2, 3], 0, 0, 0, 0, 0, 8, packed(top).tobytes()))
    dc = np.concatenate([parts[0][unit_order(rows, cols), 0], parts[1][:, :1], parts[2][:, :1]], axis=1).ravel()
    for low, row in zip(range(7, -1, -1), packed(np.unpackbits(dc[:, None], axis=1).T), strict=True):
        out.append(scan([1, 2, 3], 0, 0, 0, 0, low + 1, low, row.tobytes()))
    for c, part in enumerate(parts, 1):
        for first, last in BANDS[c]:  # a zero for (run 0, size 3), then the three bits 1xx
            nibbles = np.ascontiguousarray(part[:, first : last + 1]).ravel() >> AC_LOW | 4
            if nibbles.size % 2:
                nibbles = np.append(nibbles, np.uint8(15))
            out.append(scan([c], 0, 0, first, last, 0, AC_LOW, (nibbles[::2] << 4 | nibbles[1::2]).tobytes()))
        planes = np.unpackbits(np.ascontiguousarray(part[:, 1:]).reshape(-1, 1), axis=1).T[8 - AC_LOW :]
        pieces, at = [], 0
        for blocks, prefix in run_prefixes(len(part)):
            pieces += [np.tile(np.array(prefix, np.uint8), (AC_LOW, 1)), planes[:, at : at + 63 * blocks]]
            at += 63 * blocks
        for low, row in zip(range(AC_LOW - 1, -1, -1), packed(np.concatenate(pieces, axis=1)), strict=True):
            out.append(scan([c], 0, 1, 1, 63, low + 1, low, row.tobytes()))
    return b"".join(out) + b"\xff\xd9"


class Frame:
    """Coefficient arrays of a file: for each component (blocks, 64), in scan order."""

    def __init__(self, height: int, width: int, components: list[tuple[int, int, int, int]]) -> None:
        self.height, self.width = height, width
        self.h = max(c[1] for c in components)
        self.v = max(c[2] for c in components)
        self.rows, self.cols = -(-height // (8 * self.v)), -(-width // (8 * self.h))
        self.of = {c[0]: c[1:] for c in components}
        self.grid = {i: (self.rows * v, self.cols * h) for i, h, v, _ in components}
        #: blocks that a scan of one component alone has
        self.own = {i: (-(-(-(-height * v // self.v)) // 8), -(-(-(-width * h // self.h)) // 8)) for i, h, v, _ in components}
        self.coefficients = {i: np.zeros((self.rows * v * self.cols * h, 64), np.int16) for i, h, v, _ in components}
        self.orders: dict[tuple[int, ...], Order] = {}
        self.quantisers: dict[int, np.ndarray] = {}
        self.comment = b""

    def places(self, ids: list[int]) -> Order:
        """The blocks of a scan in its order; kept, as many scans share it."""
        key = tuple(ids)
        if key in self.orders:
            return self.orders[key]
        if len(ids) == 1:
            (r, c), stride = self.own[ids[0]], self.grid[ids[0]][1]
            at = (np.arange(r)[:, None] * stride + np.arange(c)).ravel()
            order = Order(np.full(at.size, ids[0]), at)
        else:
            owner, parts = [], []
            for i in ids:
                h, v, _ = self.of[i]
                at = np.arange(self.grid[i][0] * self.grid[i][1]).reshape(self.rows, v, self.cols, h).transpose(0, 2, 1, 3).reshape(self.rows * self.cols, v * h)
                parts.append(at)
                owner += [i] * (v * h)
            at = np.concatenate(parts, axis=1)
            order = Order(np.tile(np.array(owner), len(at)), at.ravel())
        self.orders[key] = order
        return order


class Order:
    """Blocks of a scan: whose they are and their numbers; for each component its steps and blocks."""

    def __init__(self, owner: np.ndarray, blocks: np.ndarray) -> None:
        self.owner, self.blocks = owner, blocks
        self.each = {i: (at := np.flatnonzero(owner == i), blocks[at]) for i in dict.fromkeys(owner[:64].tolist())}

    def __len__(self) -> int:
        return len(self.blocks)

    def part(self, first: int, last: int) -> Order:
        return Order(self.owner[first:last], self.blocks[first:last])


def picked(blocks: np.ndarray) -> slice | np.ndarray:
    """Neighbouring blocks as a slice, so that they aren't copied."""
    n = len(blocks)
    return slice(int(blocks[0]), int(blocks[0]) + n) if n and blocks[-1] - blocks[0] == n - 1 else blocks


class Bits:
    def __init__(self, data: bytes) -> None:
        self.bits = np.unpackbits(np.frombuffer(data.replace(b"\xff\x00", b"\xff"), np.uint8))
        self.at = 0

    def take(self, n: int) -> int:
        v = 0
        for b in self.bits[self.at : self.at + n].tolist():
            v = v << 1 | b
        self.at += n
        return v

    def many(self, n: int) -> np.ndarray:
        got = self.bits[self.at : self.at + n]
        if len(got) < n:
            raise ValueError("the scan ends early")
        self.at += n
        return got

    def symbol(self, codes: dict[tuple[int, int], int]) -> int:
        code = 0
        for n in range(1, 17):
            if self.at >= len(self.bits):
                break
            code = code << 1 | int(self.bits[self.at])
            self.at += 1
            if (n, code) in codes:
                return codes[n, code]
        raise ValueError("no such code")


def extend(v: int, size: int) -> int:
    return v if not size or v >> (size - 1) else v - (1 << size) + 1


def read_tables(body: bytes, into: dict) -> None:
    at = 0
    while at < len(body):
        kind, sizes, at = body[at], body[at + 1 : at + 17], at + 17
        codes, code = {}, 0
        for n, k in enumerate(sizes, 1):
            for s in body[at : at + k]:
                codes[n, code] = s
                code += 1
            at += k
            code <<= 1
        into[kind >> 4, kind & 15] = codes


def dc_scan(f: Frame, order: Order, codes: dict[int, dict], high: int, low: int, bits: Bits) -> None:
    if high:
        got = bits.many(len(order)).astype(np.int16) << low
        for i, (steps, blocks) in order.each.items():
            f.coefficients[i][blocks, 0] |= got[steps]
        return
    last = dict.fromkeys(codes, 0)
    owner, blocks = order.owner.tolist(), order.blocks.tolist()
    zero = {next((k for k, s in c.items() if s == 0), None) for c in codes.values()}
    same = zero.pop() if len(zero) == 1 else None
    met: set[int] = set()
    step, steps = 0, len(owner)
    while step < steps:
        i = owner[step]
        size = bits.symbol(codes[i])
        last[i] += extend(bits.take(size), size)
        f.coefficients[i][blocks[step], 0] = last[i] << low
        step += 1
        met.add(i)
        if same and size == 0 and len(met) == len(codes) and step < steps:
            n, code = same  # a stretch of unchanged values is read at once
            rest = bits.bits[bits.at : bits.at + n * (steps - step)]
            flat = (rest[: len(rest) // n * n].reshape(-1, n) == [code >> k & 1 for k in range(n - 1, -1, -1)]).all(axis=1)
            k = len(flat) if flat.all() else int(flat.argmin())
            for j, (_, own) in order.part(step, step + k).each.items():
                f.coefficients[j][own, 0] = last[j] << low
            step, bits.at = step + k, bits.at + n * k


def ac_first(coef: np.ndarray, blocks: np.ndarray, codes: dict, first: int, last: int, low: int, bits: Bits) -> None:
    width = last - first + 1
    if len(codes) == 1:
        (((n, code), s),) = codes.items()
        if s >> 4 == 0 and s & 15:  # each coefficient takes as many bits
            size = s & 15
            got = bits.many(len(blocks) * width * (n + size)).reshape(-1, n + size)
            if (got[:, :n] != [code >> k & 1 for k in range(n - 1, -1, -1)]).any():
                raise ValueError("no such code")
            v = got[:, n].astype(np.int16)
            for k in range(n + 1, n + size):
                v = v << 1 | got[:, k]
            if not got[:, n].all():
                v = np.where(got[:, n] > 0, v, v - (1 << size) + 1)
            v <<= low
            coef[picked(blocks), first : last + 1] = v.reshape(-1, width)
            return
    run = 0
    for at in blocks.tolist():
        if run:
            run -= 1
            continue
        k = first
        while k <= last:
            s = bits.symbol(codes)
            r, size = s >> 4, s & 15
            if size:
                k += r
                coef[at, k] = extend(bits.take(size), size) * (1 << low)
                k += 1
            elif r == 15:
                k += 16
            else:
                run = (1 << r) - 1 + bits.take(r)
                break


def correct(coef: np.ndarray, blocks: np.ndarray, first: int, last: int, low: int, bits: Bits) -> None:
    """A correction bit for each coefficient of the band that is not zero."""
    if first > last or not len(blocks):
        return
    at = picked(blocks)
    band = coef[at, first : last + 1]
    if band.min() > 0:
        band |= np.left_shift(bits.many(band.size).reshape(band.shape), low, dtype=np.int16)
        if not isinstance(at, slice):
            coef[at, first : last + 1] = band
        return
    band, where = band.copy(), np.nonzero(band)
    band[where] += np.sign(band[where]) * (bits.many(len(where[0])).astype(np.int16) << low)
    coef[at, first : last + 1] = band


def ac_refine(coef: np.ndarray, blocks: np.ndarray, codes: dict, first: int, last: int, low: int, bits: Bits) -> None:
    step = 0
    while step < len(blocks):
        at, k = int(blocks[step]), first
        step += 1
        while k <= last:
            s = bits.symbol(codes)
            r, size = s >> 4, s & 15
            if not size and r < 15:
                more = (1 << r) - 1 + bits.take(r)
                if k > first:  # the rest of this block
                    correct(coef, blocks[step - 1 : step], k, last, low, bits)
                else:
                    more, step = more + 1, step - 1
                correct(coef, blocks[step : step + more], first, last, low, bits)
                step += more
                break
            new = (1 if bits.take(1) else -1) * (1 << low) if size else 0
            while k <= last:
                if coef[at, k]:
                    if bits.take(1):
                        coef[at, k] += (1 << low) if coef[at, k] > 0 else -(1 << low)
                elif r == 0:
                    coef[at, k] = new
                    k += 1
                    break
                else:
                    r -= 1
                k += 1


def planes_of(parts: list[bytes], prefix: int, n: int) -> np.ndarray | None:
    """Scans of one bit a place that follow each other, the highest bit first, as one number a place: n places after prefix
    bits. None where the scans' prefixes differ or one ends early."""
    plain = [p.replace(b"\xff\x00", b"\xff") for p in parts]
    if len(plain) > 8 or len({len(p) for p in plain}) > 1 or 8 * len(plain[0]) < prefix + n:
        return None
    bits = np.unpackbits(np.frombuffer(b"".join(plain), np.uint8).reshape(len(plain), -1), axis=1)
    if prefix and (bits[1:, :prefix] != bits[0, :prefix]).any():
        return None
    out = bits[0, prefix : prefix + n].copy()
    for row in bits[1:, prefix : prefix + n]:
        out <<= 1
        out |= row
    return out


def refine_many(frame: Frame, ids: list[int], ac: dict, first: int, last: int, parts: list[bytes], low: int) -> None:
    """Refinement scans of the same places, down to the bit low. All at once where each is one bit a place, else one by one."""
    order = frame.places(ids)
    if first == 0:
        got = planes_of(parts, 0, len(order))
        if got is not None:
            got = got.astype(np.int16) << low
            for i, (steps, blocks) in order.each.items():
                frame.coefficients[i][blocks, 0] |= got[steps]
            return
    elif len(parts) > 1 and len(order):
        coef, at, bits = frame.coefficients[ids[0]], picked(order.blocks), Bits(parts[0][:8])
        s = bits.symbol(ac)
        if not s & 15 and s >> 4 < 15 and (1 << (s >> 4)) + bits.take(s >> 4) == len(order):  # a run of bands over all blocks
            band = coef[at, first : last + 1]
            if band.min() > 0 and (got := planes_of(parts, bits.at, band.size)) is not None:
                coef[at, first : last + 1] = band | (got.astype(np.int16) << low).reshape(band.shape)
                return
    for k, part in enumerate(parts):
        own = low + len(parts) - 1 - k
        if first == 0:
            dc_scan(frame, order, {}, own + 1, own, Bits(part))
        else:
            ac_refine(frame.coefficients[ids[0]], order.blocks, ac, first, last, own, Bits(part))


def decode(data: bytes) -> Frame:
    """The coefficient arrays of a progressive file, all scans accumulated."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("no JPEG file")
    at, frame, tables, quantisers, interval, comment = 2, None, {}, {}, 0, b""
    held: list = []  # refinements read together: components, band, table, scans, lowest bit
    while True:
        marker = data[at + 1]
        if marker == 0xD9:
            break
        (n,) = struct.unpack_from(">H", data, at + 2)
        body, at = data[at + 4 : at + 2 + n], at + 2 + n
        if marker == 0xDB:
            k = 0
            while k < len(body):
                wide = body[k] >> 4
                quantisers[body[k] & 15] = np.frombuffer(body, ">u2" if wide else "u1", 64, k + 1).astype(np.int32)
                k += 129 if wide else 65
        elif marker == 0xC4:
            read_tables(body, tables)
        elif marker == 0xDD:
            (interval,) = struct.unpack(">H", body)
        elif marker == 0xFE:
            comment = body
        elif marker == 0xC2:
            _, height, width, k = struct.unpack_from(">BHHB", body)
            frame = Frame(height, width, [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(k)])
            frame.quantisers, frame.comment = quantisers, comment
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("not a Huffman-coded progressive file")
        elif marker == 0xDA:
            ids = [body[1 + 2 * i] for i in range(body[0])]
            first, last, both = body[1 + 2 * len(ids) :]
            end = END_OF_SCAN.search(data, at).start()
            high, low = both >> 4, both & 15
            ac = tables.get((1, body[2] & 15), {})
            if high and not interval:  # waits for the scans that refine the same places further
                if held and (held[:2] != [ids, (first, last)] or held[2] is not ac or held[4] != low + 1):
                    refine_many(frame, held[0], held[2], *held[1], held[3], held[4])
                    held = []
                held = [ids, (first, last), ac, [*(held[3] if held else ()), data[at:end]], low]
                at = end
                continue
            if held:
                refine_many(frame, held[0], held[2], *held[1], held[3], held[4])
                held = []
            dc = {i: tables.get((0, body[2 + 2 * k] >> 4), {}) for k, i in enumerate(ids)}
            places = frame.places(ids)
            unit = sum(frame.of[i][0] * frame.of[i][1] for i in ids) if len(ids) > 1 else 1
            parts = RESTART.split(data[at:end]) if interval else [data[at:end]]
            for k, part in enumerate(parts):
                own = places.part(k * interval * unit, (k + 1) * interval * unit) if interval else places
                bits = Bits(part)
                if first == 0:
                    dc_scan(frame, own, dc, high, low, bits)
                elif high:
                    ac_refine(frame.coefficients[ids[0]], own.blocks, ac, first, last, low, bits)
                else:
                    ac_first(frame.coefficients[ids[0]], own.blocks, ac, first, last, low, bits)
            at = end
    if held:
        refine_many(frame, held[0], held[2], *held[1], held[3], held[4])
    return frame


def payload_of(frame: Frame) -> bytes:
    """The bytes that encode() stored."""
    full = np.concatenate([frame.coefficients[i] for i in (1, 2, 3)])
    return BYTE_AT[(full - TOP).astype(np.uint8)].tobytes()[: int(frame.comment.split()[1])]


_K = np.arange(8)
COSINES = (np.cos((2 * _K[None, :] + 1) * _K[:, None] * np.pi / 16) * np.where(_K[:, None] == 0, np.sqrt(1 / 8), 0.5)).astype(np.float32)


def samples(frame: Frame, i: int) -> np.ndarray:
    """A component's plane of samples, by the inverse transform of all its blocks."""
    _, _, q = frame.of[i]
    rows, cols = frame.grid[i]
    block = np.empty((rows * cols, 64), np.float32)
    block[:, ZIGZAG] = frame.coefficients[i] * frame.quantisers[q]
    block = (block.reshape(-1, 8) @ COSINES).reshape(-1, 8, 8)
    block = np.matmul(COSINES.T, block)
    np.clip(np.rint(block + 128, out=block), 0, 255, out=block)
    return block.astype(np.uint8).reshape(rows, cols, 8, 8).transpose(0, 2, 1, 3).reshape(rows * 8, cols * 8)


def tensor(frame: Frame) -> np.ndarray:
    """Full-resolution RGB, (height, width, 3) unsigned bytes; chroma is repeated up to luma's size."""
    planes = []
    for i, (h, v, _) in frame.of.items():
        p = samples(frame, i)
        planes.append(p.repeat(frame.v // v, axis=0).repeat(frame.h // h, axis=1)[: frame.height, : frame.width])
    if len(planes) == 1:
        return np.repeat(planes[0][:, :, None], 3, axis=2)
    y, cb, cr = (p.astype(np.float32) for p in planes)
    cb -= 128
    cr -= 128
    out = np.empty((*y.shape, 3), np.uint8)
    # The weights of JFIF's colour transform.
    for k, x in enumerate((y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb)):
        out[:, :, k] = np.clip(np.rint(x), 0, 255)
    return out
