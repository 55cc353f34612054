"""Embedding groups against all pairs; secrets against plain regular expressions and nested encodings."""

import base64
import gzip
import re
import urllib.parse
import zlib

import numpy as np
import pytest

from kineplate.llm import embedding_dedup as E
from kineplate.llm import secrets as S

from .conftest import documents


@pytest.mark.parametrize("kind", ["float", "double"])
def test_vectors_match_all_pairs(spark, monkeypatch, kind):
    monkeypatch.setattr(E, "LEAST_TILE", 40)
    rng = np.random.default_rng(0)
    centres = rng.standard_normal((12, 16))
    x = np.concatenate([centres[rng.integers(0, 12, 150)] + 0.22 * rng.standard_normal((150, 16)), np.repeat(centres[:1], 30, 0) * 1000, centres[1:2] * 1e-30])
    x = x.astype(np.float32).astype(float)
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    odd = [(500, None, 1), (501, [0.0] * 16, 1), (502, [float("nan")] * 16, 1), (503, [1.0, None], 1), (504, [float("inf")] + [0.0] * 15, 1), (505, [], 1), (506, [1.0, 2.0], 1), (507, [2.0, 4.0], 1)]
    got = {r.vec_id: r for r in E.near_embeddings(spark.createDataFrame(rows + odd, f"vec_id long, embedding array<{kind}>, n long"), 0.9).collect()}
    unit = x / np.abs(x).max(1, keepdims=True)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    label = np.arange(len(x))
    while (new := np.where(near, label, len(x)).min(1)).tolist() != label.tolist():
        label = new
    assert [got[i].n_links for i in range(len(x))] == (near.sum(1) - 1).tolist()
    assert [got[i].component_id for i in range(len(x))] == label.tolist()
    assert all(got[i].n_links == 0 and got[i].kept for i in range(500, 506)) and got[507].component_id == 506 and got[506].n_links == 1


@pytest.mark.parametrize("turn", [1, -1])
def test_one_id_with_two_vectors(spark, turn):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.01, 1.0]), (3, [1.0, 0.02]), (4, [1.0, 0.01]), (0, [0.0, -1.0])][::turn]
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in E.near_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == [(0, 0, 0, True), (1, 1, 1, True), (1, 2, 1, True), (2, 1, 1, False), (3, 2, 1, False), (4, 2, 1, False)]


def test_tiles_follow_the_table():
    assert [E.tiles_of(n, 256) for n in (1, 1000, 80_000, 10_000_000)] == [1, 2, 8, 306]


def test_no_vectors(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert E.near_embeddings(empty).count() == 0


ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base(text):
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 20]
    found += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 24]
    return sorted(found, key=lambda x: (x[1], S.KINDS.index(x[0])))


PLAIN = ["é password = abcdef", "passwd:short TOKEN='abc.def-1' api_key=\"x/y+zzz\"", "AKIA" + "B" * 16 + "c", "AKIA" + "B" * 15, "x" + "0af" * 9 + "g", "toKen=abcdefgh", "ſecret=abcdefgh", "token token=token=abcdef", "", "a" * 60, "secret: " + "deadbeef" * 3 + "\nnext"]


def test_base_spans(spark):
    rows = [(i, t) for i, t in enumerate(PLAIN)] + [(100, None), (101, " ".join(PLAIN) * 50)]
    got = {r.doc_id: r.spans for r in S.find_secrets(documents(spark, rows)).collect()}
    for i, t in rows:
        assert [(s.kind, s.start, s.end) for s in got[i] if s.layer == 0] == base(t or "")
    assert S.find_secrets(documents(spark, [])).count() == 0


def test_nested_layers(spark):
    inner = "token=abcdefghij"
    b64 = base64.b64encode(b"note: " + inner.encode() + b" end").decode()
    packed = base64.b64encode(gzip.compress(b"AKIA" + b"Z" * 20)).decode()
    thin = base64.b64encode(zlib.compress(b"x " + b"0123456789abcdef" * 2)).decode()
    texts = [f"é {b64} z", f"é {packed} z", f"{thin}", "é " + urllib.parse.quote(inner, safe=""), urllib.parse.quote(b64.replace("A", "A"), safe="") + "%20", "x " + "".join(f"\\u{ord(c):04x}" for c in inner), base64.b64encode(b64.encode()).decode(), "%2525%25" * 3, "passwor%64=abcdefgh"]
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in S.find_secrets(documents(spark, list(enumerate(texts)))).collect()}
    assert got[0][0][0] == "assign" and 2 < got[0][0][1] < got[0][0][2] <= 2 + len(b64)
    piece = texts[0][got[0][0][1] : got[0][0][2]]
    assert inner[:6].encode() in base64.b64decode(b64)[(got[0][0][1] - 2) // 4 * 3 :] and len(piece) >= len(inner)
    assert got[1] == [("access", 2, 2 + len(packed.rstrip("=")))] and got[2] == [("hex", 0, len(thin.rstrip("=")))]
    assert got[3][-1] == ("assign", 2, len(texts[3])) and got[5] == [("assign", 2, len(texts[5]))] and got[8] == [("assign", 0, len(texts[8]))]
    assert got[6] and got[6][0][0] == "assign" and got[7] == [] and got[4]


def test_bulk_and_single_scans_agree():
    import pyarrow as pa

    from kineplate.llm import text as T

    texts = [base64.b64encode(b"some secret: abcdefg 123").decode(), "plainlowercasewordsthatarelong", "AAAA" * 9, "é" * 10]
    body, offsets = T.as_bytes(pa.array(texts))
    starts, _ = S._runs(S._IS_BASE64[body], offsets, 16)
    assert len(starts) == 3 and S.promising(body, starts)[0]


def test_escapes_are_read_with_what_surrounds_them():
    for text in ("password: %68unter2secret", '"\\u0070assword": "hunter22"', "%FF%70assword = hunter22", "passwor%64 : \\x68unter22", "token: %2568unter22"):
        got = S.find(f"é x\n{text}")
        assert ("assign", 4 + text.find("%70") * ("%FF" in text) + text.startswith('"'), 4 + len(text) - text.endswith('"')) in [g[:3] for g in got], (text, got)


def test_layers_are_neither_dropped_nor_cut():
    inner = b"x token=abcdefghij y"

    def coded(data):
        return base64.b64encode(data).decode()

    noise = bytes(range(256)) * 20_000
    texts = [coded(b"\0caf\xc2\xa0\xff " + inner), coded(gzip.compress(gzip.compress(inner))), coded(gzip.compress(zlib.compress(inner))), coded(gzip.compress(b"first") + gzip.compress(inner)), coded(gzip.compress(noise + inner)), "ab/" + coded(inner), "\n".join(re.findall(".{1,15}", coded(b"some text first, then a " + inner)))]
    for k, text in enumerate(texts):
        assert "assign" in [g[0] for g in S.find(text)], k
    assert "assign" in [g[0] for g in S.find(coded(gzip.compress(b" " * (65 << 20) + inner)))]


def decoded_once(text):
    """Spans that one step of decoding shows, by loops: percent codes and escapes in the whole text, and base64 runs at each alignment."""
    found = set()
    for code in (r"%([0-9A-Fa-f]{2})", r"\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})"):
        out, places, at = "", [], 0
        while at < len(text):
            m = re.compile(code).match(text, at)
            out += chr(int(next(filter(None, m.groups())), 16)) if m else text[at]
            places.append((at, m.end() if m else at + 1))
            at = places[-1][1]
        found |= {(k, places[a][0], places[b - 1][1]) for k, a, b in base(out)}
    for m in re.finditer("[A-Za-z0-9+/_-]{16,}", text):
        for shift in range(4):
            run = m[0][shift:].replace("-", "+").replace("_", "/")
            run = run[: len(run) - (len(run) % 4 == 1)]
            data = base64.b64decode(run + "=" * (-len(run) % 4)).decode("latin-1")
            first = m.start() + shift
            found |= {(k, first + a * 4 // 3, min(first - (-b * 4 // 3), m.end())) for k, a, b in base(data)}
    return found | set(base(text))


def test_decoded_spans_match_loops():
    import random

    rng = random.Random(8)
    plain = ["token=abcdefg", "password: hunter22", "AKIA" + "Q" * 18, "0123456789abcdef" * 2, "nothing here", "api_key = 'xyzxyz1'"]
    for _ in range(150):
        parts = []
        for _ in range(rng.randint(1, 4)):
            secret = "pad " * rng.randint(0, 2) + rng.choice(plain) + " tail" * rng.randint(0, 2)
            coded = rng.choice([secret, "".join(f"%{ord(c):02X}" if rng.random() < 0.4 else c for c in secret), "".join(f"\\u{ord(c):04x}" if rng.random() < 0.3 else c for c in secret), "ab/-"[: rng.randint(0, 4)] + base64.b64encode(secret.encode()).decode()])
            parts.append(coded)
        text = rng.choice([" ", "\n", " é "]).join(parts)
        got = {s[:3] for s in S.find(text)}
        want = decoded_once(text)
        assert want <= got, (text, want - got)
        assert all(layer > 1 or (k, a, b) in want for k, a, b, layer in S.find(text) if "\n" not in text), text


def test_long_runs_take_time_in_proportion():
    import time

    began = time.perf_counter()
    for code in ("\\u0070assword=abcdefg", "%70assword=abcdefg"):
        text = "x" * 1_000_000 + code
        assert ("assign", 1_000_000, len(text)) in [s[:3] for s in S.find(text)]
    assert time.perf_counter() - began < 30


def test_damage_ends_data_after_what_precedes_it_and_no_failure_passes_for_it(monkeypatch):
    import random

    import zstandard

    rng = random.Random(5)

    def letters(n):
        return bytes(rng.choices(b"abcdefghijk mnop", k=n))

    def found(data):
        return "assign" in [g[0] for g in S.find(base64.b64encode(data).decode())]

    def zstd(data, **how):
        coder = zstandard.ZstdCompressor(compression_params=zstandard.ZstdCompressionParameters(chain_log=10, hash_log=10, strategy=1, **how)).compressobj()
        return coder.compress(data) + coder.flush()

    inner = letters(400) + b" token=" + bytes(rng.choices(b"abcdefghijk", k=60)) + b" y"
    for data in (gzip.compress(inner), zlib.compress(inner), zstd(inner, write_checksum=1)):
        assert found(data) and found(gzip.compress(data)) and found(data[:-1] + bytes([data[-1] ^ 1])) and found(data[:-1])
    blocks = bytearray(zstd(letters(1000) + inner + letters(300_000)))
    blocks[-3000] ^= 255
    assert found(bytes(blocks))
    # windows over zstd's usual limit, other members behind frames, many members, many levels
    assert found(zstd(inner, window_log=28)) and found(zstd(b"first") + gzip.compress(inner)) and found(zstd(b"first") + b"\x50\x2a\x4d\x18\x02\0\0\0ab" + zstd(inner))
    assert found(b"".join(gzip.compress(b"a%d" % k) for k in range(1000)) + gzip.compress(inner))
    deep = inner
    for _ in range(500):
        deep = gzip.compress(deep, mtime=0)
    assert found(deep)
    for kind, data in ((zlib, gzip.compress(inner)), (zstandard, zstd(inner))):
        for failure in (MemoryError, OSError):
            with monkeypatch.context() as m:
                m.setattr(kind, "decompressobj" if kind is zlib else "ZstdDecompressor", lambda *a, failure=failure, **b: (_ for _ in ()).throw(failure))
                with pytest.raises(failure):
                    found(data)


def test_members_and_frames_match_their_libraries():
    import random

    import zstandard

    rng = random.Random(6)
    for _ in range(60):
        parts, want = [], b""
        for _ in range(rng.randint(1, 6)):
            piece = bytes(rng.choices(b"abc", k=rng.choice([0, 1, 10, 1000, 70_000])))
            pack = rng.choice([gzip.compress, zlib.compress, zstandard.ZstdCompressor(write_checksum=rng.random() < 0.5, write_content_size=rng.random() < 0.5).compress])
            parts.append(pack(piece))
            want += piece
        tail = rng.choice([b"", b"plain tail", b"ab"])
        whole = b"".join(parts) + tail
        assert b"".join(S.inflate(whole, 1)) == want + tail == b"".join(S.inflate(gzip.compress(whole), 2))
