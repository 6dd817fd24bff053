"""What the compression bands and chunks reject, and what they keep."""

import random
import string

import pyarrow.parquet as pq
import zstandard

from seqset.llm import quality

KINDS = {"letters": string.ascii_lowercase, "hex": "0123456789abcdef", "base64": string.ascii_letters + string.digits + "+/"}


def junk(rng, kind, size):
    out = ""
    while len(out) < size:
        out += "".join(rng.choice(KINDS[kind]) for _ in range(rng.randrange(3, 11))) + " "
    return out[:size]


def prose():
    """Texts of the given documents that pass the base rules."""
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()
    compressor = zstandard.ZstdCompressor(level=quality.LEVEL)
    return [(t, m) for t in texts for m in [quality.measure(t, compressor)] if not m.base_failed]


def test_random_words_are_rejected_and_prose_is_kept():
    rng, compressor = random.Random(1), zstandard.ZstdCompressor(level=quality.LEVEL)
    for kind, least in (("base64", 160), ("letters", 900), ("hex", 2100)):
        for size in (160, 255, 400, 511, 600, 1000, 1500, 2100, 3000, 5000, 9000, 40_000):
            if size >= least:
                assert not any(quality.measure(junk(rng, kind, size), compressor).kept for _ in range(5)), (kind, size)
    found = prose()
    assert sum(m.kept for _, m in found) >= 0.98 * len(found) > 800


def test_chunks_cover_whole_texts():
    for size in (0, 1, 255, 256, 257, 700, 4095, 8191, 8192, 8193, 50_001):
        data = random.Random(size).randbytes(size)
        parts = quality.chunks(data)
        assert bool(parts) == (size >= 256)
        if parts:
            assert len({len(x) for x in parts}) == 1 and 128 <= len(parts[0]) <= 4096
            left = b"".join(parts[:-1])
            assert data.startswith(left) and data.endswith(parts[-1]) and len(left) + len(parts[-1]) >= size
    rng, compressor = random.Random(2), zstandard.ZstdCompressor(level=quality.LEVEL)
    long = next(t for t, m in prose() if m.kept and len(t.encode()) > 9000 and t.isascii())
    for clean, tail in ((4096, 4095), (8192, 4095), (1500, 700), (700, 300)):
        assert not quality.measure(long[:clean] + junk(rng, "base64", tail), compressor).kept, (clean, tail)
