import hashlib
import zlib

import numpy as np

from readloom.llm import telephony as tel

from .cases import ROWS, docs


def mulaw(u):
    u = ~u & 0xFF
    t = (((u & 0x0F) << 3) + 0x84) << ((u & 0x70) >> 4)
    return 0x84 - t if u & 0x80 else t - 0x84


def alaw(a):
    a ^= 0x55
    t, seg = (a & 0xF) << 4, (a & 0x70) >> 4
    t = t + 8 if seg == 0 else (t + 0x108) << (seg - 1)
    return t if a & 0x80 else -t


def adpcm(block):
    sample = int.from_bytes(block[:2], "little", signed=True)
    index, out = min(block[2], 88), [sample]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(tel.STEPS[index])
            d = step >> 3
            d += step if code & 4 else 0
            d += step >> 1 if code & 2 else 0
            d += step >> 2 if code & 1 else 0
            sample = max(-32768, min(32767, sample - d if code & 8 else sample + d))
            index = max(0, min(88, index + int(tel.INDEX_STEP[code & 7])))
            out.append(sample)
    return out


def test_tables():
    assert tel.MULAW.tolist() == [mulaw(i) for i in range(256)]
    assert tel.ALAW.tolist() == [alaw(i) for i in range(256)]
    assert len(tel.STEPS) == 89 and (np.diff(tel.STEPS) > 0).all()


def test_adpcm():
    rng = np.random.default_rng(0)
    blocks = rng.integers(0, 256, (37, tel.BLOCK + 4)).astype(np.uint8)
    assert tel.decode_adpcm(blocks).tolist() == [adpcm(bytes(b)) for b in blocks]


def test_round_trip_and_formats():
    payload = bytes(range(192)) * 5
    for codec in tel.CODECS:
        media = tel.store(payload, codec)
        assert tel.payload_of(media) == payload and tel.parse_wave(media)[0] == codec
    a, b, c = tel.decode([tel.store(payload, x) for x in ("mulaw", "alaw", "adpcm")])
    assert a.tolist() == [mulaw(x) for x in payload] and b.tolist() == [alaw(x) for x in payload]
    assert c.tolist() == sum((adpcm(bytes(4) + payload[i : i + 192]) for i in range(0, len(payload), 192)), [])


def brute_resample(x):
    pad, out = [x[0]] * 2 + list(x) + [x[-1]] * 3, []
    for i in range(len(x)):
        v = sum(t * pad[i + k] for k, t in enumerate((3, -25, 150, 150, -25, 3)))
        out += [x[i], max(-32768, min(32767, (v + 128) >> 8))]
    return out


def test_resample_whole_and_in_pieces():
    rng = np.random.default_rng(1)
    for codec in tel.CODECS:
        media = tel.store(rng.integers(0, 256, 192 * 9).astype(np.uint8).tobytes(), codec)
        pcm = tel.decode([media])[0]
        assert tel.resample(pcm).tolist() == brute_resample(pcm.tolist())
        parts = list(tel.resampled(tel.pieces(media, 400)))
        assert len(parts) > 3 and np.concatenate(parts).tolist() == brute_resample(pcm.tolist())
        whole, pieced = tel.Features().add(tel.resample(pcm)), tel.Features()
        for p in parts:
            pieced.add(p)
        assert str(whole) == str(pieced)
    assert tel.resample(np.zeros(0, np.int16)).tolist() == []


def test_query(spark, tmp_path, monkeypatch):
    docs(spark).write.parquet(f"{tmp_path}/documents.parquet")
    got = tel.op3_telephony(spark, str(tmp_path)).collect()
    assert len(got) == len(ROWS)
    by_text = {}
    for r in got:
        texts = {t[1] for t in ROWS if t[0] == r.doc_id}
        digests = {}
        for t in texts:
            data = (t or "").encode()
            want = data + b" " * ((-len(data)) % 192 or (192 if not data else 0))
            digests[hashlib.sha256(want).hexdigest()] = (len(data), len(want), zlib.crc32(want[-16:]))
        assert digests[r.payload_sha256] == (r.n_bytes, r.payload_bytes, r.tail_crc32) and r.media_bytes > r.payload_bytes
        assert by_text.setdefault(r.payload_sha256, r[5:]) == r[5:]


def brute_feature(payload, codec):
    """Features of a payload by plain loops: decoded, resampled, measured."""
    if codec == "adpcm":
        pcm = sum((adpcm(bytes(4) + payload[i : i + 192]) for i in range(0, len(payload), 192)), [])
    else:
        pcm = [{"mulaw": mulaw, "alaw": alaw}[codec](x) for x in payload]
    x = brute_resample(pcm)
    crossings = sum((a < 0) != (b < 0) for a, b in zip(x, x[1:]))
    crc = zlib.crc32(b"".join(v.to_bytes(2, "little", signed=True) for v in x))
    return f"n={len(x)};peak={max(map(abs, x))};power={sum(v * v for v in x) // len(x)};crossings={crossings};crc={crc:08x}"


def test_whole_result(spark):
    """Every column of the query's rows against plain loops."""
    texts = [None, "", "a", "é" * 100, "x" * 192, "y" * 193, "the cat sat on the mat " * 40, "🙂 " * 300, *(f"text {i} " * (i + 1) for i in range(30))]
    rows = {r.doc_id: r for r in tel.described(tel.stored(docs(spark, [(i, t, "en", "s", 1) for i, t in enumerate(texts)]))).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        data = (t or "").encode()
        payload = data + b" " * (max(192, -(-len(data) // 192) * 192) - len(data))
        codec = list(tel.CODECS)[zlib.crc32(payload) % 3]
        media = tel.store(payload, codec)
        want = (i, len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), brute_feature(payload, codec))
        assert tuple(rows[i]) == want


def test_pcm_column(spark):
    media = tel.stored(docs(spark)).withColumn("pcm", tel.F.lit("clash"))
    rows = tel.pcm(media, ["doc_id", "pcm"]).collect()
    assert len(rows) == len(ROWS) and all(len(r.pcm) % 4 == 0 and len(r.pcm) >= 768 and r.row.pcm == "clash" for r in rows)
    nothing = spark.createDataFrame([(1, None)], "doc_id long, media binary")
    assert [r.pcm for r in tel.pcm(nothing, ["doc_id"]).collect()] == [None]


def test_empty(spark, tmp_path):
    docs(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    assert tel.op3_telephony(spark, str(tmp_path)).count() == 0
