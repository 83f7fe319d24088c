import hashlib
import random
import struct
import zlib

import numpy as np
import pytest
import zstandard

from helpers import awkward, clashing, empty
from tickloom.llm import media, warc, webp

PAGES = "page_id long, url string, html string"


def brute(pages):
    groups = {}
    for i, _, h in pages:
        groups.setdefault(h or "", []).append(i)
    out = []
    for i, _, h in pages:
        top = max((x for x in groups[h or ""] if x is not None), default=None)
        away = top is not None and i != top
        data = (h or "").encode()
        out.append((i, len(data), warc.digest(data), "revisit" if away else "response", top if away else None))
    return sorted(out, key=repr)


def test_round_trip_equals_brute_force(spark):
    rng = random.Random(1)
    pages = [(i, f"http://x/{i}", f"<p>{rng.randint(0, 30)} é😀\r\n\r\n" * rng.randint(0, 5)) for i in range(200)]
    pages += [(900, None, None), (901, "u v\n", ""), (None, "http://n", "<p>lone</p>"), (None, "http://n", "same"), (902, "x", "same"), (903, "big", "<b>" * 60_000), (904, "a", "rep"), (904, "a", "rep")]
    df = clashing(spark.createDataFrame(pages, PAGES)).repartition(3)
    got = sorted((tuple(r) for r in warc.round_trip(df).collect()), key=repr)
    assert got == brute(pages)
    assert warc.round_trip(df.where("false")).count() == 0


def archive(records, samples=None):
    frame, made = warc.dictionary_frame(samples or records)
    z = zstandard.ZstdCompressor(dict_data=made, write_checksum=True)
    return frame + b"".join(z.compress(r) + warc.SEPARATOR for r in records)


def test_archive_is_a_dictionary_and_a_frame_per_record():
    records = [warc.record(i, "http://x", f"<html>page number {i} of many</html>".encode() * 20, None) for i in range(200)]
    data = archive(records)
    assert struct.unpack("<I", data[:4])[0] == warc.DICTIONARY_FRAME
    assert [r["payload"] for r in warc.read_archive(data)] == [warc.parse_record(r)["payload"] for r in records]
    raw = archive([records[0]], [b"x"])  # too little to train on
    assert len(list(warc.read_archive(raw))) == 1


@pytest.mark.parametrize("spoil", [
    lambda d: d[:-12], lambda d: d[:40], lambda d: d + b"junk", lambda d: b"\x00" + d,
    lambda d: d[:-30] + bytes([d[-30] ^ 255]) + d[-29:],
])
def test_broken_archives_are_refused(spoil):
    records = [warc.record(i, "http://x", f"<html>{i}</html>".encode() * 30, None) for i in range(60)]
    with pytest.raises(warc.WarcError):
        list(warc.read_archive(spoil(archive(records))))


@pytest.mark.parametrize("old,new", [(b"WARC/1.1", b"WARC/1.x"), (b"Content-Length: 1", b"Content-Length: 2"), (b"WARC-Date", b"WARC-Data"), (b"<p>", b"<q>"), (b"\r\n\r\n", b"\r\n")])
def test_broken_records_are_refused(old, new):
    good = warc.record(1, "u", b"<p>text</p>", None)
    assert warc.parse_record(good)["payload"] == b"<p>text</p>"
    with pytest.raises(warc.WarcError):
        warc.parse_record(good.replace(old, new))
    assert warc.parse_record(warc.record(2, "u", b"<p>", 1))["payload"] is None


class Writer:
    """Bits of a test stream, lowest first."""

    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [value >> i & 1 for i in range(n)]

    def word(self, code, n):  # a prefix code's word goes highest bit first
        self.bits += [code >> (n - 1 - i) & 1 for i in range(n)]

    def done(self):
        return np.packbits(np.array(self.bits, np.uint8), bitorder="little").tobytes()


def lengths_of(counts):
    """Code lengths of a Huffman code for symbols with counts, 15 bits at most."""
    used = [s for s, c in enumerate(counts) if c]
    if len(used) < 2:
        return {s: 1 for s in used or [0]}
    heap = sorted((c, [s]) for s, c in ((s, counts[s]) for s in used))
    size = dict.fromkeys(used, 0)
    while len(heap) > 1:
        (a, x), (b, y) = heap[0], heap[1]
        for s in x + y:
            size[s] += 1
        heap = sorted([*heap[2:], (a + b, x + y)], key=lambda t: (t[0], t[1]))
    return size if max(size.values()) <= 15 else lengths_of([0 if not c else 1 for c in counts])


def write_code(w, counts):
    """Writes a code and returns its words ``symbol -> (code, bits)``."""
    size = lengths_of(counts)
    if len(size) == 1:
        (s,) = size
        if s < 256:
            w.put(1, 1), w.put(0, 1), w.put(1, 1), w.put(s, 8)
            return {s: (0, 0)}
        size[0] = 1  # a lone symbol too large for the simple form gets a companion
    w.put(0, 1), w.put(15, 4)
    for s in webp.CODE_LENGTH_ORDER:
        w.put(4 if s < 16 else 0, 3)
    w.put(0, 1)
    for s in range(len(counts)):
        w.word(size.get(s, 0), 4)
    code, before, out = 0, 0, {}
    for s in sorted(size, key=lambda s: (size[s], s)):
        code <<= size[s] - before
        before = size[s]
        out[s] = (code, size[s])
        code += 1
    return out


def prefix(value):
    """Prefix symbol, extra bits and their number of a length or distance."""
    if value <= 4:
        return value - 1, 0, 0
    v = value - 1
    n = v.bit_length() - 1
    half = v >> (n - 1) & 1
    return 2 * n + half, v & ((1 << (n - 1)) - 1), n - 1


def write_image(w, pixels, width, main, cache=0, copies=False, groups=1):
    """Entropy-coded pixels with an optional colour cache, back-references and two code groups by block."""
    w.put(int(cache > 0), 1)
    if cache:
        w.put(cache, 4)
    height, block = len(pixels) // width, 2
    which = lambda at: 0
    if main:
        w.put(int(groups > 1), 1)
        if groups > 1:
            w.put(block - 2, 3)
            bw, bh = (width + 3) >> 2, (height + 3) >> 2
            plan = [((x + y) % groups) << 8 for y in range(bh) for x in range(bw)]
            write_image(w, plan, bw, False)
            which = lambda at: plan[((at // width) >> 2) * bw + ((at % width) >> 2)] >> 8
    ops, held, at, last = [], [0] * (1 << cache), 0, {}
    near = {max(1, x + y * width): k + 1 for k, (x, y) in reversed(list(enumerate(webp.NEAR)))}
    put = lambda p: held.__setitem__((webp.CACHE_FACTOR * p & 0xFFFFFFFF) >> (32 - cache), p) if cache else None
    while at < len(pixels):
        n, key = 0, tuple(pixels[at : at + 3])
        if copies and len(key) == 3 and key in last:
            away = at - last[key]
            while at + n < len(pixels) and n < 4000 and pixels[at + n] == pixels[at + n - away]:
                n += 1
        if copies and len(key) == 3:
            last[key] = at
        if n >= 3:
            ops.append((which(at), "copy", n, near.get(away, away + 120)))
            for p in pixels[at : at + n]:
                put(p)
            at += n
            continue
        p = pixels[at]
        slot = (webp.CACHE_FACTOR * p & 0xFFFFFFFF) >> (32 - cache) if cache else 0
        ops.append((which(at), "cache", slot, 0) if cache and held[slot] == p else (which(at), "pixel", p, 0))
        put(p)
        at += 1
    counts = [[[0] * n for n in (280 + ((1 << cache) if cache else 0), 256, 256, 256, 40)] for _ in range(groups)]
    for g, kind, a, b in ops:
        c = counts[g]
        if kind == "pixel":
            for k, shift in ((0, 8), (1, 16), (2, 0), (3, 24)):
                c[k][a >> shift & 255] += 1
        elif kind == "cache":
            c[0][280 + a] += 1
        else:
            c[0][256 + prefix(a)[0]] += 1
            c[4][prefix(b)[0]] += 1
    codes = [[write_code(w, c) for c in group] for group in counts]
    for g, kind, a, b in ops:
        c = codes[g]
        if kind == "pixel":
            for k, shift in ((0, 8), (1, 16), (2, 0), (3, 24)):
                w.word(*c[k][a >> shift & 255])
        elif kind == "cache":
            w.word(*c[0][280 + a])
        else:
            s, extra, n = prefix(a)
            w.word(*c[0][256 + s]), w.put(extra, n)
            s, extra, n = prefix(b)
            w.word(*c[4][s]), w.put(extra, n)


def subtract(a, b):
    return ((a | 0x00FF00FF) - (b & 0xFF00FF00)) & 0xFF00FF00 | ((a | 0xFF00FF00) - (b & 0x00FF00FF)) & 0x00FF00FF


def write_stream(pixels, transforms=(), seed=0, **how):
    """A file of ``pixels`` with the named transforms, block parameters drawn at random."""
    rng, (height, width) = np.random.default_rng(seed), pixels.shape
    w, now, own = Writer(), pixels.astype(np.uint32), width
    w.put(webp.SIGNATURE, 8), w.put(width - 1, 14), w.put(height - 1, 14), w.put(1, 1), w.put(0, 3)
    for kind in transforms:
        w.put(1, 1), w.put(kind, 2)
        bw, bh = (own + 3) >> 2, (height + 3) >> 2
        if kind == webp.PREDICTOR:
            w.put(0, 3)
            modes = rng.integers(0, 14, (bh, bw)).astype(np.uint32)
            write_image(w, (modes << 8 | 0xFF000000).ravel().tolist(), bw, False)
            flat = now.ravel().tolist()
            # a rightmost pixel's top right neighbour is the first of its own row, which is there by then
            now = np.array([subtract(p, webp.predicted(flat, i, own, int(modes[(i // own) >> 2, (i % own) >> 2]))) for i, p in enumerate(flat)], np.uint32).reshape(height, own)
        elif kind == webp.CROSS_COLOUR:
            w.put(0, 3)
            factors = rng.integers(0, 1 << 24, (bh, bw)).astype(np.uint32)
            write_image(w, (factors | np.uint32(0xFF000000)).ravel().tolist(), bw, False)
            f = webp.spread(factors, 2, now.shape)
            green, red = (now >> 8) & 255, (now >> 16) & 255
            blue = (now & 255).astype(np.int32) - webp.colour_delta((f >> 8) & 255, green) - webp.colour_delta((f >> 16) & 255, red)
            new_red = red.astype(np.int32) - webp.colour_delta(f & 255, green)
            now = (now & np.uint32(0xFF00FF00)) | ((new_red & 255).astype(np.uint32) << np.uint32(16)) | (blue & 255).astype(np.uint32)
        elif kind == webp.SUBTRACT_GREEN:
            green = (now >> 8) & 255
            now = (now & np.uint32(0xFF00FF00)) | ((((now >> 16) - green) & 255) << np.uint32(16)) | (((now & 255) - green) & 255)
        else:
            table, index = np.unique(now, return_inverse=True)
            index = index.reshape(now.shape)
            w.put(len(table) - 1, 8)
            steps = [int(table[0])] + [subtract(int(b), int(a)) for a, b in zip(table, table[1:], strict=False)]
            write_image(w, steps, len(table), False)
            packed = webp.packing(len(table))
            own = (width + (1 << packed) - 1) >> packed
            out = np.zeros((height, own), np.uint32)
            for x in range(width):
                out[:, x >> packed] |= index[:, x].astype(np.uint32) << np.uint32((x & ((1 << packed) - 1)) * (8 >> packed))
            now = out << np.uint32(8) | np.uint32(0xFF000000)
    w.put(0, 1)
    write_image(w, now.ravel().tolist(), own, True, **how)
    return webp.riff(w.done())


def picture(height, width, colours, seed=0):
    rng = np.random.default_rng(seed)
    table = rng.integers(0, 1 << 32, colours, dtype=np.uint64).astype(np.uint32)
    base = table[rng.integers(0, colours, (height, width))]
    base[height // 2 :] = base[: height - height // 2]
    return base


P, C, G, T = webp.PREDICTOR, webp.CROSS_COLOUR, webp.SUBTRACT_GREEN, webp.PALETTE


@pytest.mark.parametrize("transforms", [(), (P,), (C,), (G,), (P, C, G), (G, P), (C, P, G)])
@pytest.mark.parametrize("how", [{}, {"copies": True}, {"cache": 4}, {"copies": True, "cache": 7, "groups": 2}])
def test_decoder_inverts_every_feature(transforms, how):
    for k, (h, w) in enumerate(((1, 1), (7, 13), (20, 9))):
        image = picture(h, w, 300, k)
        assert (webp.decode(write_stream(image, transforms, k, **how)) == image).all()


@pytest.mark.parametrize("colours", [1, 2, 3, 4, 5, 16, 17, 200])
def test_palettes_of_every_packing(colours):
    image = picture(9, 14, colours, colours)
    assert (webp.decode(write_stream(image, (T,), copies=True)) == image).all()
    assert (webp.decode(write_stream(image, (T, P), copies=True)) == image).all()


def test_fast_and_general_paths_agree(monkeypatch):
    rgb = np.random.default_rng(1).integers(0, 60, (5, 64, 3)).astype(np.uint8)
    data = webp.encode(rgb)
    fast = webp.decode(data)
    monkeypatch.setattr(webp._Ahead, "run", lambda *a: None)
    assert (webp.decode(data) == fast).all()


@pytest.mark.parametrize("n", [1, 2, 3, 64, 65, 128, 129, 256])
def test_encoder_for_every_alphabet(n):
    rgb = np.resize(np.arange(n), (4, 64, 3)).astype(np.uint8)
    samples = webp.decode(webp.encode(rgb))
    assert (np.stack([samples >> 16 & 255, samples >> 8 & 255, samples & 255], -1) == rgb).all() and (samples >> 24 == 255).all()


def used_features(monkeypatch, data):
    """Pixels of a file, and the names of the features that decoding it went through."""
    used = set()

    def spy(holder, name, label):
        before = getattr(holder, name)
        monkeypatch.setattr(holder, name, lambda *a: (used.add(label), before(*a))[1])

    with monkeypatch.context() as monkeypatch:
        for name in ("predictor", "cross_colour", "subtract_green", "palette"):
            spy(webp, f"_undo_{name}", name)
        group = webp._read_group
        monkeypatch.setattr(webp, "_read_group", lambda bits, size: (used.add("cache") if size else None, group(bits, size))[1])
        pixels = webp.decode(data)
        bits, codes = webp.Bits(webp._riff(data)[0]), []
        read = webp._read_code
        webp._READ.clear()
        monkeypatch.setattr(webp, "_read_code", lambda *a: (codes.append(read(*a)), codes[-1])[1])
        webp.decode_stream(bits.data)
        if any(len({int(e) & 15 for e in c.table}) > 1 for c in codes):
            used.add("codes of several lengths")
        webp._READ.clear()
        run = webp._Ahead._look

        def look(self):
            run(self)
            used.update(["copies"] if any(a < 0 and c >= 2048 for a, c in zip(self.after, self.colour, strict=True)) else [])

        monkeypatch.setattr(webp._Ahead, "_look", look)
        webp.decode_stream(bits.data)
    return pixels, used


def test_encoder_uses_every_feature(monkeypatch):
    """The queries' own encoder writes, and the queries' decoder inverts, what the format offers."""
    rng = np.random.default_rng(3)
    y, x = np.mgrid[:30, :64]
    noise = rng.integers(0, 256, (30, 64))
    green = rng.integers(-80, 80, (60, 64)) & 255
    red = webp.colour_delta(np.uint32(48), green.astype(np.uint32))
    colours = rng.integers(0, 256, (300, 3))
    often = rng.choice(300, (120, 64), p=(w := 1 / np.arange(1, 301) ** 1.3) / w.sum())
    words = " ".join(rng.choice(["the", "river", "of", "stone", "ran", "north", "again", "and", "under"], 900))
    text = np.frombuffer(media.payload_of(words), np.uint8).reshape(-1, 64, 3)
    for rgb, wanted in (
        (np.stack([x * 2 + y, x + y * 3, x * 3 + 7 * y], -1) & 255, "predictor"), (np.stack([noise] * 3, -1), "subtract_green"), (np.stack([red, green, red + rng.integers(0, 2, (60, 64))], -1) & 255, "cross_colour"),
        (colours[rng.integers(0, 5, (30, 64))], "palette"), (colours[often], "cache"), (text, "copies"), (text, "codes of several lengths"),
    ):
        pixels, used = used_features(monkeypatch, webp.encode(rgb.astype(np.uint8)))
        assert wanted in used
        assert (np.stack([pixels >> 16 & 255, pixels >> 8 & 255, pixels & 255], -1) == rgb).all()


def test_codes_read_before_are_told_apart():
    images = [np.random.default_rng(k).integers(0, 30 + k, (4 + k, 64, 3)).astype(np.uint8) for k in range(100)]
    data = [webp.encode(i) for i in images]
    for _ in range(2):
        for image, d in zip(images, data, strict=True):
            samples = webp.decode(d)
            assert (np.stack([samples >> 16 & 255, samples >> 8 & 255, samples & 255], -1) == image).all()
            with pytest.raises((webp.WebpError, struct.error)):
                webp.decode(d[: len(d) // 2])


def test_broken_streams_are_refused():
    good = write_stream(picture(8, 8, 100), (P,), copies=True)
    for bad in (good[:30], good[:4] + b"\0\0\0\0" + good[8:], b"x" + good, good[:20] + b"\x30" + good[21:], b"", good[: len(good) // 2]):
        with pytest.raises((webp.WebpError, struct.error)):
            webp.decode(bad)


def test_media_columns(spark):
    df = clashing(awkward(spark))
    got = media.measure(media.encode(df)).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in awkward(spark).collect()}
    assert len(got) == 8
    for r in got:
        data = texts[r["doc_id"]].encode()
        payload = data + b" " * (max(192, -(-len(data) // 192) * 192) - len(data))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    same = [r for r in got if r["doc_id"] == 4]
    assert same[0] == same[1] and media.measure(media.encode(empty(spark))).count() == 0


def test_long_payloads_take_several_files():
    payload = media.payload_of("0123456789" * 90_000)
    data = media.write_image(payload)
    assert data.count(b"RIFF") == 2 and media.read_image(data).tobytes() == payload
