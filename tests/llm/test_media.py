import gzip
import hashlib
import io
import random
import wave
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyfield.llm import media as m

GIF = b"GIF89a\x01\x00\x01\x00\x80\x00\x00\x00\x00\x00\xff\xff\xff,\x00\x00\x00\x00\x01\x00\x01\x00\x00\x02\x02D\x01\x00;"


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000))
def test_round_trip_of_every_format(data):
    payload = m.padded(data)
    assert len(payload) % 576 == 0 and payload and payload.startswith(data) and set(payload[len(data):]) <= {255}
    for kind, write in m.WRITERS.items():
        blob = b"junk BM RIFF \xff\xd8\xff" + (file := write(payload)) + b"tail"
        found = [f for f in m.sniff(blob) if f.end - f.start == len(file)]
        assert found and found[0].kind == kind and blob[found[0].start : found[0].end] == file
        assert m.read_payload(kind, file) == payload


def test_validators_refuse_damage():
    payload = m.padded(b"x" * 700)
    for kind, write in m.WRITERS.items():
        file = write(payload)
        assert not [f for f in m.sniff(file[:-3]) if f.kind == kind]
    png = bytearray(m.write_png(payload))
    png[60] ^= 1
    assert not m.sniff(bytes(png))


def test_other_formats():
    zipped = gzip.compress(b"BM" * 5000)
    au = b".snd" + b"".join(x.to_bytes(4, "big") for x in (24, 5, 2, 8000, 1)) + b"abcde"
    blob = b"..RIFF.." + GIF + b"--" + zipped + au + b"end"
    found = [(f.kind, blob[f.start : f.end]) for f in m.sniff(blob)]
    assert found == [("image/gif", GIF), ("application/gzip", zipped), ("audio/basic", au)]
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xda\x00\x02ab\xff\x00c\xff\xd9"
    assert [(f.kind, f.start, f.end) for f in m.sniff(b"q" + jpeg + b"q")] == [("image/jpeg", 1, 1 + len(jpeg))]


def test_rows(spark):
    draw = random.Random(2)
    texts = [None, "", "é" * 300, "BM RIFF GIF89a \x00", "x" * 576, "y" * 300_000] + ["".join(draw.choices("ab ñ", k=draw.randint(1, 2000))) for _ in range(20)]
    rows = [(i, t, b"z") for i, t in enumerate(texts)] + [(2, texts[2], None), (None, "", None)]
    got = m.text_media(spark.createDataFrame(rows, "doc_id long, text string, feature binary")).collect()
    assert len(got) == len(rows)
    by_text = {}
    for r, (i, t, _) in zip(sorted(got, key=lambda r: (r.doc_id is None, r.doc_id or 0, r.n_bytes)), sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))):
        data = (t or "").encode()
        payload = data + b"\xff" * (-len(data) % 576 if data else 576)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(data), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-32:])
        by_text.setdefault(t or "", set()).add(tuple(r)[1:])
    assert all(len(v) == 1 for v in by_text.values())
    assert {r.media_type for r in got} == set(m.WRITERS)
    assert any("corrected" in r.feature for r in got) and any("corrected" not in r.feature for r in got)


def test_carve(spark):
    blob, declared = m.store(m.padded(b"abc"))
    df = spark.createDataFrame([(1, blob, declared), (2, None, None), (3, b"none", "x"), (4, GIF + GIF, "image/gif")], "id int, blob binary, type string")
    got = sorted(tuple(r) for r in m.carve(df, "id", "blob", "type").select("id", "position", "kind").collect())
    assert [g[:2] for g in got] == [(1, 0), (4, 0), (4, 1)]
    with pytest.raises(ValueError):
        m.examine(b"nothing", "x")


def plain_media(text):
    """Type, stored file, its place and the declared type of a text, from the formats' definitions."""
    data = text.encode()
    payload = data + b"\xff" * (-len(data) % 576 if data else 576)
    check = zlib.crc32(payload)
    kinds = ["audio/wav", "image/bmp", "image/png"]
    kind, declared = kinds[check % 3], kinds[check // 3 % 3]
    height = len(payload) // 576
    if kind == "audio/wav":
        out = io.BytesIO()
        with wave.open(out, "wb") as w:
            w.setparams((1, 1, 8000, len(payload), "NONE", ""))
            w.writeframes(payload)
        file = out.getvalue()
    elif kind == "image/bmp":
        grey = b"".join(bytes([i, i, i, 0]) for i in range(256))
        little = lambda n, x: x.to_bytes(n, "little", signed=x < 0)
        head = b"BM" + little(4, 1078 + len(payload)) + bytes(4) + little(4, 1078)
        file = head + little(4, 40) + little(4, 576) + little(4, -height) + little(2, 1) + little(2, 8) + little(4, 0) + little(4, len(payload)) + bytes(8) + little(4, 256) + bytes(4) + grey + payload
    else:
        big = lambda x: x.to_bytes(4, "big")
        part = lambda k, d: big(len(d)) + k + d + big(zlib.crc32(k + d))
        rows = b"".join(b"\0" + payload[576 * i : 576 * (i + 1)] for i in range(height))
        file = b"\x89PNG\r\n\x1a\n" + part(b"IHDR", big(576) + big(height) + b"\x08\0\0\0\0") + part(b"IDAT", zlib.compress(rows, 1)) + part(b"IEND", b"")
    return kind, file, len(f"--part\r\nContent-Type: {declared}\r\n\r\n"), declared


def test_stored_form_and_feature_equal_a_plain_version(spark):
    draw = random.Random(6)
    texts = ["", "é" * 700, "x" * 575, "x" * 577] + ["".join(draw.choices("ab ñ.", k=draw.randint(1, 3000))) for _ in range(40)]
    df = spark.createDataFrame([(i, t, "a", "b") for i, t in enumerate(texts)], "doc_id long, text string, blob string, declared string")
    rows = {r.doc_id: r for r in m.text_media(df).collect()}
    for i, text in enumerate(texts):
        kind, file, place, declared = plain_media(text)
        r = rows[i]
        assert (r.media_bytes, r.media_sha256, r.media_type, r.declared_type) == (len(file), hashlib.sha256(file).hexdigest(), kind, declared)
        verdict = "declared" if kind == declared else f"corrected from {declared}"
        assert r.feature == f"{kind} at {place} length {len(file)} of 1, {verdict}"
    assert {r.media_type for r in rows.values()} == set(m.WRITERS)
    blobs = m.stored(df)
    carved = {r.doc_id: r for r in m.carve(blobs, "doc_id", "blob", "declared").collect()}
    assert all(bytes(carved[i].media) == plain_media(t)[1] and carved[i].type_ok == (carved[i].kind == rows[i].declared_type) for i, t in enumerate(texts))
    assert m.text_media(df.limit(0)).count() == 0
