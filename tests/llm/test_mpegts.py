import hashlib
import random
import zlib

import pytest

from inkweave.llm import mpegts as ts


@pytest.mark.parametrize("n", [0, 1, 575, 576, 577, 5000, 200_000])
def test_round_trip(n):
    raw = random.Random(n).randbytes(n)
    payload = ts.padded(raw)
    assert len(payload) % ts.UNIT == 0 and len(payload) > 0 and payload.startswith(raw) and set(payload[n:]) <= {255}
    media = ts.store(payload)
    assert len(media) % 188 == 0 and set(media[::188]) == {0x47}
    (s,) = ts.parse(media)
    units = len(payload) // ts.UNIT
    assert s.data == payload and s.sizes == [ts.UNIT] * units and s.continuity_errors == s.broken == 0
    assert s.pts == [k * ts.TICKS for k in range(units)] and s.access == [k % ts.ACCESS_EVERY == 0 for k in range(units)]


def test_damage_is_counted():
    payload = ts.padded(bytes(range(256)) * 40)
    media = ts.store(payload)
    packets = [media[i : i + 188] for i in range(0, len(media), 188)]
    (lost,) = ts.parse(b"".join(packets[:9] + packets[10:]))
    assert lost.continuity_errors == 1 and lost.broken == 1
    (twice,) = ts.parse(b"".join(packets[:9] + packets[8:]))
    assert twice.continuity_errors == 0 and twice.data == payload
    (shifted,) = ts.parse(b"junk" + media + b"\x47cut")
    assert shifted.data == payload
    null = bytes([0x47, 0x1F, 0xFF, 0x10]) + b"\xff" * 184
    (with_null,) = ts.parse(null.join(packets))
    assert with_null.data == payload and with_null.continuity_errors == 0
    bad = bytearray(packets[1])
    bad[20] ^= 1
    assert ts.parse(b"".join([packets[0], bytes(bad), *packets[2:]])) == []
    assert ts.parse(b"") == ts.parse(b"no stream") == ts.parse(b"\x47" * 500) == []


def test_two_programs_and_long_tables():
    def pes(pid, body, cc):
        data = b"\0\0\1\xe0\0\0\x80\0\0" + body
        out = b""
        for k, i in enumerate(range(0, len(data), 184)):
            part = data[i : i + 184]
            head = bytes([0x47, (0x40 if k == 0 else 0) | pid >> 8, pid & 255])
            if len(part) < 184:
                n = 183 - len(part)
                out += head + bytes([0x30 | (cc + k) & 15, n]) + (b"\0" + b"\xff" * (n - 1) if n else b"") + part
            else:
                out += head + bytes([0x10 | (cc + k) & 15]) + part
        return out

    pat = ts._section(0, 1, b"\0\0\xe0\x10" + b"\0\1\xe1\0" + b"\0\2\xe2\0")
    streams = b"".join(b"\x1b" + (0xE000 | 0x300 + k).to_bytes(2, "big") + b"\xf0\0" for k in range(60))
    pmts = ts._section(2, 1, b"\xe1\1\xf0\0" + b"\x1b\xe1\1\xf0\2ab"), ts._section(2, 2, b"\xe3\0\xf0\0" + streams)
    long = b"\0" + pmts[1]
    parts = [bytes([0x47, (0x40 if k == 0 else 0) | 2, 0, 0x10 | k]) + long[i : i + 184].ljust(184, b"\xff") for k, i in enumerate(range(0, len(long), 184))]
    media = ts._table_packet(0, pat) + ts._table_packet(0x100, pmts[0]) + b"".join(parts) + pes(0x101, b"video one" * 50, 0) + pes(0x301, b"second", 5)
    got = {(s.program, s.pid): s for s in ts.parse(media)}
    assert len(got) == 61
    assert got[1, 0x101].data == b"video one" * 50 and got[1, 0x101].pts == [None] and got[2, 0x301].data == b"second"


def test_rows(spark, tmp_path):
    texts = {1: "héllo 😀", 2: None, 3: "", 4: "x" * 300_000, 5: "y" * 576}
    rows = [(i, t) for i, t in texts.items()] + [(1, texts[1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as id", "2 as media")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = ts.op2_media_mpegts(spark, str(tmp_path)).collect()
    assert len(got) == 6
    for r in got:
        raw = (texts[r["doc_id"]] or "").encode()
        payload = ts.padded(raw)
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-32:])
        assert r["media_sha256"] == hashlib.sha256(ts.store(payload)).hexdigest() and r["media_bytes"] == len(ts.store(payload))
        units = len(payload) // 576
        assert r["access_points"] == ",".join(f"{ts.DATA_PID}:{k * ts.TICKS}" for k in range(0, units, ts.ACCESS_EVERY))
    assert ts.read_media(ts.store_texts(df.limit(0))).count() == 0


def test_access_points(spark):
    texts = ["a" * 576 * 20, "", None, "\u00e9" * 3000]
    docs = spark.createDataFrame([(i if i != 1 else None, t, "x", 1) for i, t in enumerate(texts)], "doc_id int, text string, media string, id int")
    stored = ts.store_texts(docs)
    got = sorted(((r["id"] if r["id"] is not None else -1), r["program"], r["pid"], r["unit"], r["pts"]) for r in ts.access_points(stored).collect())
    units = {0: 20, -1: 1, 2: 1, 3: 11}
    assert got == sorted((i, ts.PROGRAM, ts.DATA_PID, k, k * ts.TICKS) for i, n in units.items() for k in range(0, n, ts.ACCESS_EVERY))
    odd = spark.createDataFrame([(1, None), (2, b"no stream")], "id long, media binary")
    assert ts.access_points(odd).count() == ts.access_points(odd.limit(0)).count() == 0
