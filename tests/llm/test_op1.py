import hashlib
import zlib

import numpy as np

from loomgraph.llm import telephony as t
from loomgraph.llm.queries import QUERIES
from tests.llm.helpers import ODD, odd_documents, rows, texts


def expected(text):
    body = (text or "").encode()
    full = body.ljust(max(64, -(-len(body) // 64) * 64), b"\0")
    return len(body), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:])


def test_digests_of_whole_table(spark, sf_dir):
    got = rows(QUERIES["op1_telephony"](spark, sf_dir))
    want = texts(sf_dir)
    assert got.keys() == want.keys()
    for i, text in want.items():
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == expected(text)
        assert r["media_bytes"] > r["payload_bytes"]


def test_odd_rows_and_equal_texts(spark):
    got = rows(t.text_media(odd_documents(spark)))
    for i, text in ODD:
        assert (got[i]["n_bytes"], got[i]["payload_bytes"], got[i]["payload_sha256"], got[i]["tail_crc32"]) == expected(text)
    for c in ("media_sha256", "feature", "pcm_sha256"):
        assert got[5][c] == got[6][c] and got[1][c] == got[2][c]


def test_empty_table(spark):
    assert t.text_media(odd_documents(spark).limit(0)).count() == 0


def test_foreign_and_null_media_decode_to_null(spark):
    df = spark.createDataFrame([(1, None), (2, bytearray(b"RIFFxxxxWAVE")), (3, bytearray(b"junk"))], "id int, media binary")
    assert all(r["payload"] is None and r["pcm"] is None for r in t.decode(df).collect())


def test_tables_follow_the_rule():
    assert t.TABLES[t.MULAW][0xFF] == 0 and t.TABLES[t.MULAW][0x00] == -32124 and t.TABLES[t.MULAW][0x80] == 32124
    assert t.TABLES[t.ALAW][0xD5] == 8 and t.TABLES[t.ALAW][0x55] == -8 and t.TABLES[t.ALAW][0xAA] == 32256


def adpcm_one(block):
    value, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
    out = [value]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(t.STEPS[index])
            change = step >> 3
            change += step if code & 4 else 0
            change += step >> 1 if code & 2 else 0
            change += step >> 2 if code & 1 else 0
            value = max(-32768, min(32767, value - change if code & 8 else value + change))
            index = max(0, min(88, index + int(t.CHANGES[code & 7])))
            out.append(value)
    return out


def test_adpcm_blocks_equal_scalar_decoder():
    raw = np.random.default_rng(3).integers(0, 256, (17, 64), dtype=np.uint8)
    assert t.decode_adpcm(raw).tolist() == [adpcm_one(bytes(b)) for b in raw]


def test_resampling_does_not_depend_on_neighbours():
    rng = np.random.default_rng(5)
    clips = [rng.integers(-30000, 30000, n).astype(np.int16) for n in (0, 1, 7, 500, 0, 33)]
    offsets = np.concatenate(([0], np.cumsum([len(c) for c in clips])))
    joint = t.doubled(np.concatenate(clips), offsets)
    for i, c in enumerate(clips):
        alone = t.doubled(c, np.array([0, len(c)]))
        assert joint[2 * offsets[i] : 2 * offsets[i + 1]].tolist() == alone.tolist() and alone[::2].tolist() == c.tolist()


def test_long_clips_in_pieces_equal_whole_ones(monkeypatch):
    rng = np.random.default_rng(2)
    monkeypatch.setattr(t, "PIECE", 640)
    for codec in (t.MULAW, t.ALAW, t.ADPCM):
        for blocks in (1, 10, 11, 37):
            body = rng.integers(0, 256, blocks * 64, dtype=np.uint8).tobytes()
            low, offsets = t._samples([(codec, body)])
            want = t.doubled(low, offsets)
            got, energy, peak, turns = t.decoded_clip(codec, body)
            wide = want.astype(np.int64)
            assert np.array_equal(got, want) and energy == (wide**2).sum() and peak == max(wide.max(), -wide.min()) and turns == ((want[1:] < 0) != (want[:-1] < 0)).sum()


def test_a_very_long_text(spark):
    text = "some words of a long text " * 60_000
    got = t.text_media(spark.createDataFrame([(k, text + "x" * k) for k in range(3)], "doc_id long, text string")).collect()
    for r in got:
        body = (text + "x" * r["doc_id"]).encode()
        body += b"\0" * (-len(body) % 64)
        assert r["payload_sha256"] == hashlib.sha256(body).hexdigest()
        codec = int(r["feature"].split(";")[0].split("=")[1])
        low, offsets = t._samples([(codec, body)])
        assert r["pcm_sha256"] == hashlib.sha256(t.doubled(low, offsets).tobytes()).hexdigest()
