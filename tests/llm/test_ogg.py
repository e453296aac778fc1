import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from onoma.llm import ogg


def slow_crc(data):
    crc = 0
    for b in data:
        crc ^= b << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


@given(st.binary(max_size=200))
def test_crc(data):
    assert ogg.ogg_crc(data) == slow_crc(data)


@settings(deadline=None)
@given(st.lists(st.integers(0, 70000).map(lambda n: bytes(range(256)) * (n // 256) + b"x" * (n % 256)), min_size=1, max_size=6))
def test_packets_come_back(packets):
    pages = ogg.paginate(7, [(p, n) for n, p in enumerate(packets)])
    other = ogg.paginate(9, [(b"head", 0), (b"z" * 300, 5)])
    got = ogg.demultiplex(ogg.multiplex([pages, other]))
    assert got[7].packets == packets and got[7].ended
    assert got[9].packets == [b"head", b"z" * 300]
    assert got[7].granules[-1] == len(packets) - 1


@pytest.mark.parametrize("size", [0, 1, 255, 254, 510, 255 * 255, 255 * 255 + 1, 200_000])
def test_long_packets_and_times(size):
    payload, n = ogg.payload_of("é" * size)
    media = ogg.store(payload, n)
    back, n_back, times = ogg.load(media)
    assert (back, n_back) == (payload, n) and len(payload) % 64 == 0 and payload
    assert times[-1] == len(payload) / ogg.RATE
    dated = [t for t in times if t is not None]
    assert dated == sorted(dated)


def test_damage_is_noticed():
    media = bytearray(ogg.store(*ogg.payload_of("hello world " * 900)))
    for at in (0, 5, 22, 30, 500, len(media) - 1):
        bad = bytearray(media)
        bad[at] ^= 1
        with pytest.raises(ogg.OggError):
            ogg.load(bytes(bad))
    with pytest.raises(ogg.OggError):
        ogg.load(bytes(media[:-3]))


def test_documents(spark):
    rows = [(1, "same"), (2, "same"), (None, None), (4, ""), (5, "long " * 30000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS media")
    out = {r["doc_id"]: r for r in ogg.describe_media(ogg.media_column(docs)).collect()}
    assert out[1][1:] == out[2][1:] and out[4][1:] == out[None][1:]
    for d, t in rows:
        payload, n = ogg.payload_of(t)
        assert (out[d]["n_bytes"], out[d]["payload_bytes"]) == (n, len(payload))
        assert out[d]["tail_crc32"] == zlib.crc32(payload[-64:])
    assert ogg.describe_media(ogg.media_column(docs.limit(0))).count() == 0
