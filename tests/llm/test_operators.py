"""Each operator against a brute-force version, and on the awkward tables: nulls, empty and long texts, repeated rows, no
rows, extra columns."""

import gzip
import hashlib
import io
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers as tokenizers
import pytest
from pyspark.sql import functions as F

from recloom.llm import bpe, chat, components, decontam, draws, jaccard, linededup, media, quality, sharding, tokenfile, warc
from recloom.llm.queries import QUERIES, table
from recloom.llm.store import Scratch
from tests.session import TESTDATA

SMALL = f"{TESTDATA}/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, hash string, key string, range int"


def awkward(spark):
    long = " ".join(f"w{i % 977}x{i // 977}" for i in range(30_000))
    texts = [None, "", " ", "one", "two words", "the same text in a few words\nand a line", "the same text in a few words\nand a line", long, long + " end", "\x00 odd \x85   \t bytes é😀", "Ünïcode   Ä | b"]
    rows = [(i, t, None if i % 3 == 0 else "en", None if i % 4 == 0 else f"s{i % 3}", len(t or ""), "clash", None, i) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[5], rows[0], (None, "no id here at all", None, None, 1, None, None, None)], DOCS)


def none(spark):
    return spark.createDataFrame([], DOCS)


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def texts_of(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


# 1

def test_arc_versions_lengths_and_errors():
    url = "http://a b/\n"
    body = b"HTTP/1.1 200 OK\r\nX-Record-Key: 5\r\n\r\nURL 1 2 3 4\nhttp://x 0 0 0 3\n"
    for v in (1, 2):
        data = warc.arc_version_block(v, "f") + warc.arc_record(v, url, body, 0, "f") + warc.arc_record(v, None, b"", 0, "f")
        got = list(warc.parse_arc(data))
        assert [(r["version"], r["content"], r["error"]) for r in got[1:]] == [(v, body, None), (v, b"", None)]
        assert got[0]["kind"] == "warcinfo" and got[1]["url"] == "http://a%20b/%0A"
        assert list(warc.parse_arc(gzip.compress(data))) == list(warc.parse_arc(gzip.compress(data[:40]) + gzip.compress(data[40:]))) == got
        assert [r["error"] is None for r in warc.parse_arc(data[:-10])][-1:] == [True] or list(warc.parse_arc(data[:-10]))[-1]["error"]
    assert list(warc.parse_arc(data[: len(data) // 2]))[-1]["error"]
    assert list(warc.parse_arc(b"http://x 0 0 t 1\na"))[0]["error"] == "no version block"
    assert list(warc.parse_arc(b"")) == []
    mixed = warc.arc_version_block(2, "f") + warc.arc_record(1, "u", b"a", 0, "f")
    assert "fields" in list(warc.parse_arc(mixed))[1]["error"]
    for cut in (1, 9, 30):  # truncated and damaged gzip
        some = list(warc.parse_arc(gzip.compress(data)[:-cut]))
        assert some[-1]["error"] and all(r["error"] is None for r in some[:-1])
    assert list(warc.parse_arc(b"\x1f\x8b not gzip at all"))[0]["error"].startswith("gzip")
    assert warc.warc_date("19970102") == "1997-01-02T00:00:00Z"


def test_urls_with_spaces_and_carriage_returns():
    for v, fields in ((1, 5), (2, 10)):
        head = " ".join(["http://h/a b  c", "0.0.0.0", "20200101000000", "text/html", *["200", "-", "-", "0", "f"][: fields - 5], "3"]).encode()
        for part in (b"\n", b"\r\n", b"\n\n\r\n", b""):
            data = warc.arc_version_block(v, "f") + part + head + b"\nabc" + part + head + b"\r\nxyz" + part + b"http://short 3\nqqq" + part + head + b"\n123"
            got = list(warc.parse_arc(data))[1:]
            assert [r.get("content") for r in got] == [b"abc", b"xyz", None, b"123"] and "2 fields" in got[2]["error"]
            assert {r["url"] for r in got if not r["error"]} == {"http://h/a b  c"}
    (headers, block, error) = list(warc.parse_warc(warc.warc_record(got[0])))[0]
    assert headers["warc-target-uri"] == "http://h/a%20b%20%20c" and block == b"abc" and error is None


@pytest.mark.parametrize("raw, iso", [("20201399999999", "2020-01-01T00:00:00Z"), ("20200230101112", "2020-02-01T00:00:00Z"), ("20200229235959", "2020-02-29T23:59:59Z"), ("20200229236059", "2020-02-29T23:00:00Z"), ("0000", "1970-01-01T00:00:00Z"), ("", "1970-01-01T00:00:00Z"), ("x", "1970-01-01T00:00:00Z"), ("1997", "1997-01-01T00:00:00Z"), ("199701", "1997-01-01T00:00:00Z"), ("08991231", "0899-12-31T00:00:00Z"), ("٢٠٢٠", "1970-01-01T00:00:00Z"), ("2020010100000099", "2020-01-01T00:00:00Z")])
def test_dates_are_dates(raw, iso):
    assert warc.warc_date(raw) == iso


def test_odd_dates_are_kept():
    rec = {"content": b"x", "url": "u", "ip": "0.0.0.0", "mime": "text/plain"}
    for raw, kept in (("20200230101112", "20200230101112"), ("20200101000000", None), ("2020\r\nX: y", "2020%0D%0AX:%20y")):
        (headers, _, _) = list(warc.parse_warc(warc.warc_record(rec | {"date": raw})))[0]
        assert headers.get("x-archive-date") == kept and "x" not in headers


def test_what_is_lost_is_told(spark, tmp_path):
    """Damage found while converting comes back as rows, beside all that could be read."""
    good = warc.arc_version_block(1, "f") + warc.arc_record(1, "http://a", b"HTTP/1.1 200 OK\r\nX-Record-Key: 5\r\n\r\nx", 0, "f")
    archives = [(good + b"http://short 3\nqqq\n" + warc.arc_record(1, "http://b", b"y", 0, "f"), {}), (good[:-5], {}), (b"no archive", None), (b"", {}), (None, {})]
    got = warc.convert(spark, spark.createDataFrame(archives, "content binary, refs map<string,string>"), f"file://{tmp_path}/w").collect()
    assert sorted(r.uri for r in got if r.uri) == ["http://a", "http://b"] and sum(r.record_type == "warcinfo" for r in got) == 2
    assert sorted(r.error for r in got if r.error) == ["2 fields in a version 1 header", "header or declared length unreadable", "header or declared length unreadable"]
    assert all(not r.intact for r in got if r.error) and all(r.intact for r in got if not r.error)


def test_record_types_and_members():
    arc = warc.arc_version_block(1, "f.arc") + warc.arc_record(1, "http://a/", b"HTTP/1.1 200 OK\r\n\r\nx", 0, "f") + b"dns:a 0.0.0.0 20200101000000 text/dns 3\nabc\n"
    records = [warc.warc_record(r) for r in warc.parse_arc(arc)]
    kinds = ["warcinfo", "response", "resource"]
    for data in (b"".join(records), gzip.compress(b"".join(records)), b"".join(map(gzip.compress, records)), b"".join(gzip.compress(r) + b"\0" * 5 for r in records)):
        got = list(warc.parse_warc(data))
        assert [h["warc-type"] for h, _, _ in got] == kinds and [e for *_, e in got] == [None] * 3
        assert got[2][0]["content-type"] == "text/dns" and got[2][1] == b"abc" and got[0][0]["warc-filename"] == "f.arc"
    assert [bool(e) for *_, e in warc.parse_warc(data[:-40])] == [False, False, True]
    assert [bool(e) for *_, e in warc.parse_warc(b"".join(records)[:-40])] == [False, False, True]
    assert [e for *_, e in warc.parse_warc(b"")] == [] and list(warc.parse_warc(b"junk"))[0][2]


def test_archive_files(spark, tmp_path):
    """Files are cut by size, damaged ones end in an error row, and a folder without a manifest can be read."""
    big = [(f"k{i}", warc.warc_record({"content": b"HTTP/1.1 200 OK\r\n\r\n" + random.Random(i).randbytes(3000), "date": "20200101", "url": f"http://h/{i}", "ip": "0.0.0.0", "mime": "text/html"}), None) for i in range(20)]
    files = Scratch(spark, "t").save(warc.write_archives(spark.createDataFrame(big, warc.CONVERTED).repartition(2), f"file://{tmp_path}/w", file_bytes=10_000), "m")
    rows = files.collect()
    assert sum(r.records for r in rows) == 20 and len(rows) >= 5 and all(r.bytes < 14_000 for r in rows)
    assert warc.read_archives(warc.list_archives(spark, f"file://{tmp_path}/w")).filter("intact and error is null").count() == 20
    (tmp_path / "w" / "cut.warc.gz").write_bytes(gzip.compress(big[0][1]) + gzip.compress(big[1][1])[:-200])
    got = warc.read_archives(warc.list_archives(spark, f"file://{tmp_path}/w")).collect()
    assert sum(r.intact for r in got) == 21 and [r.error for r in got if r.error] == ["truncated gzip member"]
    bad = spark.createDataFrame([(bytearray(gzip.compress(warc.arc_version_block(1, "f"))[:-3]), {})], "content binary, refs map<string,string>")
    assert [r.error for r in warc.arc_to_warc(bad).collect()][-1]


def page_results(pages):
    best = {}
    for i, h in pages:
        p = (h or "").encode()
        if len(p) >= 1000 and i is not None:
            best[p] = max(best.get(p, i), i)
    out = []
    for i, h in pages:
        p = (h or "").encode()
        top = best.get(p)
        out.append((i, len(p), hashlib.sha1(p).hexdigest(), *(("revisit", top) if top is not None and top != i else ("response", None))))
    return sorted(out, key=str)


def test_pages_through_archives(spark, tmp_path):
    big, nasty = "x" * 1000, "WARC/1.0\r\nContent-Length: 5\r\n\r\n" * 50
    pages = [(1, big), (2, big), (3, "x" * 999), (4, "x" * 999), (5, None), (6, ""), (7, nasty), (8, nasty), (9, "é" * 600), (9, "é" * 600), (11, "\n\r\n" * 700)]
    df = spark.createDataFrame([(i, None if i == 4 else f"http://h/{i} x", h, "k", "z") for i, h in pages], "page_id long, url string, html string, key string, digest string")
    got = warc.convert_pages(spark, df, f"file://{tmp_path}/w").collect()
    assert all(r.intact for r in got)
    assert sorted(((int(r.key), r.payload_bytes, r.payload_digest, r.record_type, None if r.refers_to_key is None else int(r.refers_to_key)) for r in got), key=str) == page_results(pages)
    assert warc.convert_pages(spark, df.limit(0), f"file://{tmp_path}/e").count() == 0


def test_op1_on_pages(spark):
    pages = [(r.page_id, r.html) for r in table(spark, SMALL, "pages").collect()]
    got = QUERIES["op1_warc"](spark, SMALL).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == page_results(pages)


# 2

@pytest.mark.parametrize("shape", [(1, 64), (7, 64), (9, 5), (40, 33), (3, 1)])
def test_images_round_trip_and_resize(shape):
    a = np.random.default_rng(1).integers(0, 256, shape, np.uint8)
    for enc in (media.encode_pgm, media.encode_bmp):
        assert (media.decode(enc(a)) == a).all()
    h, w = shape
    small = media.area_resize(a, 4, 3)
    fine = np.kron(a.astype(float), np.ones((4, 3)))  # every target cell is a whole number of these
    assert np.allclose(small, fine.reshape(4, h, 3, w).mean((1, 3)))
    parts = list(media.tiles(a, 16))
    assert sum(t.size for *_, t in parts) == a.size
    assert all((np.load(io.BytesIO(media.npy_bytes(t))) == t).all() for *_, t in parts)


def test_netpbm_kinds():
    assert media.decode(b"P2\n# c\n2 1\n3\n0 3\n").tolist() == [[0, 255]]
    assert media.decode(b"P1 2 1 1 0").tolist() == [[0, 255]]
    assert media.decode(b"P4\n3 1\n\xa0").tolist() == [[0, 255, 0]]
    assert media.decode(b"P6 1 1 255\n\x01\x02\x03").tolist() == [[[1, 2, 3]]]
    assert media.decode(b"P5 1 1 65535\n\xff\xff").tolist() == [[255]]
    for plain in (b"P2 2 1 255 7 9", b"P3 1 1 255 1 2 3", b"P1 1 1 0", b"P4 1 1\n\x00", b"P5 1 1 7\n\x07"):
        assert media.decode(plain).dtype == np.uint8


BAD_IMAGES = [None, b"GIF8", b"P5 0 0 255\n", b"P5 9 9 255\nxx", b"BM", b"P2 1 1 255 99999999999999999999", b"P2 2 1 255 -5 3", b"P2 2 1 255 70000 3", b"P2 1 1 0 0"]
BAD_IMAGES += [b"P5 9999999999 9999999999 255\n", b"P5 99999999999 1 255\n", b"P4 4000000000 4000000000\n", b"P2 2 1 255 1", b"P5 1 1 7\n\x08", b"P2 1 1 70000 1", b"BM" + bytes(60), b"P6 1 1"]


def fits_hash(a, code):
    """Area means by loops over pixels that are cut into 8 x 9 cells; bits are looked at where neighbours differ clearly."""
    h, w = a.shape
    fine = np.kron(a.astype(float), np.ones((8, 9))).reshape(8, h, 9, w).mean((1, 3))
    bits = f"{int(code, 16):064b}"
    steps = [(bits[8 * y + x], fine[y, x + 1] - fine[y, x]) for y in range(8) for x in range(8)]
    return all(abs(d) < 0.002 or (b == "1") == (d > 0) for b, d in steps)


def test_op2_features_by_hand(spark):
    docs = {r.doc_id: r.text for r in table(spark, SMALL, "documents").collect()}
    rows = QUERIES["op2_media"](spark, SMALL).collect()
    assert len(rows) == len(docs) and len({r.feature for r in rows}) > 100
    for r in rows:
        raw = (docs[r.doc_id] or "").encode()
        a = np.frombuffer(raw + bytes(r.payload_bytes - len(raw)), np.uint8).reshape(-1, 64)
        assert len(r.tiles) == 4
        if len(a) < 60:
            assert fits_hash(a, r.feature)
            cells = np.kron(a.astype(float), np.ones((32, 1))).reshape(32, len(a), 32, 2).mean((1, 3))
            for t in r.tiles:
                tile = np.load(io.BytesIO(t.npy))
                assert fits_hash(tile, t.dhash) and np.abs(tile - cells[16 * t.tile_y : 16 * t.tile_y + 16, 16 * t.tile_x : 16 * t.tile_x + 16]).max() <= 0.51


def test_media_features(spark):
    docs = awkward(spark)
    stored = media.store_texts(docs)
    got = media.media_features(stored, ["doc_id", "n_bytes"]).collect()
    want = texts_of(docs)
    assert len(got) == docs.count()
    for r in got:
        raw = (want[r.doc_id] or "").encode()
        pad = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.error) == (len(raw), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-64:]), None)
    bad = spark.createDataFrame([(i, None if x is None else bytearray(x)) for i, x in enumerate(BAD_IMAGES)], "doc_id long, media binary")
    assert media.media_features(bad, ["doc_id"]).count() == len(BAD_IMAGES) and all(r.error and r.feature is None for r in media.media_features(bad, ["doc_id"]).collect())
    assert media.media_tiles(bad, "doc_id").count() == 0
    assert media.media_tiles(stored, "doc_id").count() > docs.count()
    assert media.media_features(media.store_texts(none(spark)), ["doc_id"]).count() == 0


# 3

def test_gam_learns_interactions():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    m = quality.fit(x[:3000], y[:3000])
    assert ((m.score(x[3000:]) >= 0.5) == y[3000:]).mean() > 0.9
    assert (0, 1) in [(f, g) for f, g, _ in m.pairs]


def naive_measures(text):
    if not text:
        return [0.0] * 12
    raw, words, lines = text.encode(), text.split(), text.split("\n")
    n, m = max(1, len(words)), max(1, len(lines))
    of = lambda which: sum(chr(c) in which for c in raw if c < 128)
    upper, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    again = sum(words[i] == words[i + 1] for i in range(len(words) - 1))
    shares = [of("|") / n, of("*%$#&@^~<>{}[]\\=+_") / n, of(upper) / len(raw), of(digits) / len(raw), sum(c > 127 for c in raw) / len(raw)]
    return [np.log(1 + len(raw)), *shares, again / n, len(set(words)) / n**0.9, len(set(lines)) / m, len(raw) / n, of(".") / n, n / m]


def test_quality_by_hand(spark):
    """Measures by plain counting, and scores by looking each measure and pair up in the model's tables."""
    texts = [*(r.text for r in table(spark, SMALL, "documents").collect()), None, "", " ", "|", "A1é.\n\nb b b", "x" * 70]
    x = quality.measures(texts)
    assert np.allclose(x, [naive_measures(t) for t in texts])
    model = quality.train(spark, table(spark, f"{TESTDATA}/sf0.01", "documents"), table(spark, f"{TESTDATA}/sf0.01", "labels"))
    assert model.pairs and all(len(t) == len(c) + 1 for t, c in zip(model.tables, model.cuts, strict=True))

    def look_up(row):
        at = lambda cuts, v: sum(v >= c for c in cuts)
        z = model.prior + sum(t[at(c, v)] for t, c, v in zip(model.tables, model.cuts, row, strict=True))
        z += sum(t[at(model.coarse[f], row[f]), at(model.coarse[g], row[g])] for f, g, t in model.pairs)
        return 1 / (1 + np.exp(-min(30, max(-30, z))))

    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = by_id(quality.scored(docs, model, ["doc_id"]))
    assert np.allclose([got[i].score for i in range(len(texts))], [look_up(r) for r in x])


def test_lowest_draws(spark):
    rows = [(i, (i * 7919 % 1009) / 1009) for i in range(1009)]
    df = spark.createDataFrame(rows, "id long, u double")
    for n, weight in ((10, 1009), (10, 3), (300, 1e9), (2000, 1009)):
        got = draws.lowest(df, "u", ["id"], n, 1009, weight)
        assert {r.id for r in got.collect()} == {i for i, _ in sorted(rows, key=lambda r: r[1])[:n]}


def test_quality_held_out(spark):
    d = f"{TESTDATA}/sf0.01"
    got = by_id(QUERIES["op3_quality"](spark, d))
    labels = {r.doc_id: r.quality for r in table(spark, d, "labels").collect()}
    assert len(got) == table(spark, d, "documents").count()
    held = [i for i in labels if got[i].held_out]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    good = np.mean([got[i].predicted == labels[i] for i in held])
    assert good >= 0.95 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())


def test_quality_awkward(spark):
    docs = awkward(spark)
    labels = spark.createDataFrame([(i, i % 2, 0, "t") for i in range(11)] + [(None, 1, 0, "t"), (3, None, 0, "t")], "doc_id long, quality int, toxic int, text string")
    out = quality.classify(spark, docs, labels, docs.columns)
    assert out.count() == docs.count() and out.filter("score is null or score < 0 or score > 1").count() == 0
    for no in (labels.limit(0), labels.filter("quality = 1")):
        assert {round(r.score, 6) for r in quality.classify(spark, docs, no, ["doc_id"]).collect()}.__len__() == 1
    assert quality.classify(spark, none(spark), labels, ["doc_id"]).count() == 0


def test_repeated_ids_train_once(spark):
    docs, labels = table(spark, SMALL, "documents"), table(spark, SMALL, "labels")
    scores = lambda d: by_id(quality.classify(spark, d, labels, ["doc_id"]))
    once, often = scores(docs), scores(docs.unionByName(docs).unionByName(docs.filter("doc_id % 2 = 0")))
    assert once == often


# 4

def chat_brute(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted(((r[1], r[2] or "", r[3] or "") for r in rows if r[0] == conv), key=lambda r: (r[0] is not None, r))
        flat = "".join(f"{role}\n{text}\n" for _, role, text in turns)
        loss = "".join(text for _, role, text in turns if role == "assistant")
        out[conv] = (len(turns), hashlib.sha256(flat.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def chat_digests(df):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in df.collect()}


def test_chat(spark):
    nasty = ["\\### Assistant: </turn> ok", "\\s\\h\\e", "####</turn></turn>\n", None, "", "😀é\\", "</turn", "###", "\n### assistant: hi</turn>\n", "a: b"]
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(nasty)]
    rows += [(2, 0, "user", "only"), (3, 0, "assistant", "x"), (3, 0, "assistant", "x"), (3, 1, None, "after"), (4, 0, "ro: le</turn>", "q"), (4, 1, "assistant", ""), (5, None, "assistant", "n"), (None, 0, "assistant", "z"), (6, 0, "assistant", "a"), (6, 0, "assistant", "b")]
    df = spark.createDataFrame([(*r, "e") for r in rows], "conv_id long, turn long, role string, text string, example string")
    ex = chat.expand(df)
    assert chat_digests(chat.read_back(ex)) == chat_brute(rows)
    one = [r for r in ex.collect() if r.conv_id == 1]
    assert [r.example for r in sorted(one, key=lambda r: r.example)] == list(range(5))  # five replies, the last turn being one
    for r in one:
        cut = r.formatted[r.loss_start : r.loss_start + r.loss_chars]
        assert r.formatted[: r.loss_start].endswith("### assistant: ") and r.formatted[r.loss_start + r.loss_chars :] == chat.END and chat.END not in cut
    assert chat.read_back(chat.expand(df.limit(0))).count() == 0


def test_rows_without_a_conversation_are_alone(spark):
    rows = [(None, 0, "assistant", f"text {i}") for i in range(40)] + [(None, 1, "user", "no reply"), (1, 0, "user", "q"), (1, 1, "assistant", "r")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    got = chat.read_back(chat.expand(df)).collect()
    assert sorted(r.n_turns for r in got if r.conv_id is None) == [1] * 41 and [r.n_turns for r in got if r.conv_id == 1] == [2]
    assert {r.loss_sha256 for r in got if r.conv_id is None} == {hashlib.sha256(t.encode()).hexdigest() for t in ["", *(f"text {i}" for i in range(40))]}


def test_op4(spark):
    rows = [tuple(r) for r in table(spark, SMALL, "conversations").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-7, i, r, "\\### Assistant: </turn> ok") for i, r in enumerate(("user", "assistant"))]
    assert chat_digests(QUERIES["op4_chat"](spark, SMALL)) == chat_brute(rows)


# 5

def shingles(text, k):
    w = [x for x in re.split("[\x20\x09-\x0d]+", (text or "").translate({i: i + 32 for i in range(65, 91)})) if x]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def link_brute(texts, k, percent):
    sets = {i: shingles(t, k) for i, t in texts.items()}
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)) and 100 * len(x & y) >= percent * len(x | y):
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def families(seed, n=260):
    """Near copies around the threshold, shared passages, documents made of passages alone, one-word texts."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(400)}"
    passages = [[word() for _ in range(30)] for _ in range(4)]
    out, base = {}, []
    for i in range(n):
        kind = rng.random()
        if kind < 0.45 and base:
            t = list(rng.choice(base))
            for _ in range(rng.choice((0, 1, 1, 2, 3, 5))):
                t[rng.randrange(len(t))] = word()
            if rng.random() < 0.3:
                t = t[: max(1, len(t) - rng.randrange(4))]
        elif kind < 0.6:
            t = sum(rng.sample(passages, rng.randrange(1, 4)), []) + [word() for _ in range(rng.randrange(3))]
        elif kind < 0.65:
            t = [word() for _ in range(rng.randrange(0, 5))]
        else:
            t = [word() for _ in range(rng.choice((12, 60, 120, 500)))] + (rng.choice(passages) if rng.random() < 0.5 else [])
            base.append(t)
        out[i * 3 + 1] = " ".join(t)
    return out


@pytest.mark.parametrize(("seed", "k", "percent", "frequent"), [(1, 4, 85, 32), (2, 5, 80, 2), (3, 4, 85, 3)])
def test_jaccard_loses_no_link(spark, seed, k, percent, frequent, monkeypatch):
    if seed == 3:
        monkeypatch.setattr(jaccard, "WHOLE", 40)  # more texts have a window, some run out of rare tokens in it
    if seed == 2:
        monkeypatch.setattr(jaccard, "BLOCK", 3)  # combinations cut into many parts
    texts = families(seed)
    got = jaccard.join_components(spark, spark.createDataFrame(list(texts.items()), "doc_id long, text string"), k, percent, frequent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == link_brute(texts, k, percent)


@pytest.mark.parametrize(("k", "percent", "shorts"), [(4, 85, 1), (5, 80, 1), (4, 85, 3)])
def test_jaccard_across_whole(spark, k, percent, shorts):
    """Near copies on both sides of WHOLE; the short ones are no token's hub among the long ones."""
    words = [f"w{i}" for i in range(jaccard.WHOLE + 8)]
    short = [" ".join([*words[: jaccard.WHOLE - 6 - i], f"s{i}"]) for i in range(shorts)]
    long = [" ".join([*words[: len(words) - i], *(f"x{i}y{j}" for j in range(i))]) for i in range(12 - shorts)]
    by_hash = [r.id for r in spark.range(12).orderBy(F.xxhash64("id")).collect()]
    middle = [i for i in by_hash[1:-1] if 0 < i < 11][:shorts]
    texts = dict(zip([*middle, *(i for i in range(12) if i not in middle)], [*short, *long], strict=True)) | {20: "other words that link with nothing"}
    want = link_brute(texts, k, percent)
    assert {want[i][1] for i in range(12)} == {0} and all(want[i][0] <= jaccard.WHOLE for i in middle) and max(n for n, _ in want.values()) > jaccard.WHOLE
    got = jaccard.join_components(spark, spark.createDataFrame(list(texts.items()), "doc_id long, text string"), k, percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == want


def revisions(seed, n, size, apart):
    """Long texts that share a template; each differs from it, in single words spread over it, by a share of ``apart``."""
    rng = random.Random(seed)
    base = [f"t{i}" for i in range(size)]
    out = {}
    for i in range(n):
        t = list(base)
        for at in rng.sample(range(size), int(rng.choice(apart) * size / 4)):  # a word is in up to 4 shingles
            t[at] = f"v{rng.randrange(3)}x{at}" if rng.random() < 0.5 else f"o{i}x{at}"
        out[i] = " ".join(t)
    return out


@pytest.mark.parametrize(("seed", "frequent"), [(11, 4), (12, 2), (13, 32)])
def test_jaccard_long_texts_of_one_template(spark, seed, frequent):
    texts = revisions(seed, 44, 900, (0.07, 0.08, 0.09, 0.1, 0.11))
    want = link_brute(texts, 4, 85)
    assert 3 < len({c for _, c in want.values()})  # some link, most don't
    got = jaccard.join_components(spark, spark.createDataFrame(list(texts.items()), "doc_id long, text string"), frequent=frequent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == want


def test_jaccard_index_is_linear_in_text_length(spark):
    for m in (300, 3000):
        t = [(100, h) for h in range(m)]
        row = spark.createDataFrame([(1, m, 1, t, m)], "node long, n long, comp long, t array<struct<df:long,h:long>>, u int")
        assert jaccard.combinations(row, 85, 32).count() < 0.4 * m


def test_jaccard_awkward(spark):
    docs = awkward(spark)
    want = link_brute({i: t for i, t in texts_of(docs).items() if i is not None}, 4, 85)
    got = jaccard.join_components(spark, docs).collect()
    assert len(got) == docs.count()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want
    assert jaccard.join_components(spark, none(spark)).count() == 0


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(140)] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, i) for i in range(5001, 5100)]
    up = {}
    for a, b in edges:
        up.setdefault(a, a), up.setdefault(b, b)

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    got = components.components(Scratch(spark, "t"), spark.createDataFrame(edges, "a long, b long"), "c")
    alone = {a for a, b in edges if a == b} - {x for a, b in edges if a != b for x in (a, b)}
    assert {r.node: r.component for r in got.collect()} == {i: find(i) for i in up if i not in alone}


# 6

def test_canonical_and_slots(spark):
    item = "Tom has 12 apples and gives 3 of them to Anna before he walks 5 km to town with Anna today"
    changed = item.replace("12", "40").replace("3 of", "7 of").replace("5", "9").replace("Anna", "Sue").replace("Tom", "Bob")
    mixed = item.replace("to Anna", "to Sue")  # one value stands for two
    rows = [(1, f"Before it. {item}. After it."), (2, f"xx yy zz. {changed}! More"), (3, f"words, {mixed}"), (4, " ".join(item.split()[:6])), (5, item.upper().lower()), (6, None), (7, ""), (1, f"Before it. {item}. After it.")]
    docs = spark.createDataFrame([(*r, "x", 3) for r in rows], "doc_id long, text string, item_id string, pos int")
    bench = spark.createDataFrame([(0, item), (1, None), (2, "short one"), (3, "1 2 3 4 5 6 7 8 9"), (4, "exactly five words stand here")], "item_id long, text string")
    for most in (1 << 20, 0):
        got = {(r.doc_id, r.item_id): r.same_slots for r in decontam.contaminated(spark, docs, bench, broadcast_bytes=most).collect()}
        assert got == {(1, 0): True, (2, 0): False, (5, 0): True}
    five = spark.createDataFrame([(9, "it is so that exactly five words stand here then")], "doc_id long, text string")
    assert [tuple(r)[:2] for r in decontam.contaminated(spark, five, bench).collect()] == [(9, 4)]
    assert decontam.contaminated(spark, docs.limit(0), bench).count() == 0 and decontam.contaminated(spark, docs, bench.limit(0)).count() == 0


def test_items_of_few_words(spark):
    items = ["Solve 3 x + 5 = 20", "Compute 12 * 15 / 3", "Convert 5 km to miles", "10 km in 2 h, 30 km in 6 h", "yes indeed", "1 2 3 4 5 6 7 8 9 10"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = [(i, f"some text\n{t}.\nand more") for i, t in enumerate(items)] + [(10, "he said yes indeed to it"), (11, "Solve 4 x + 5 = 20"), (12, "Compute 1 * 2 / 9"), (13, "-- YES, indeed!"), (None, items[0])]
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(spark, spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert got == {(i, i) for i in range(len(items))} | {(13, 4)}


def test_decontam_slots(spark):
    item = "A shop sells 12 red pens and 3 blue pens to every child who comes before 9 in the morning on a school day"
    docs = [(0, item.replace("12", "7").replace(" 3 ", " 7 ").replace("9", "8")), (1, item.replace("12", "15")), (2, "so " + item.lower())]
    twice = "Give 5 apples to each boy and 5 apples to each girl and keep 5 apples for the old man in the house"
    docs += [(3, twice.replace("5", "8")), (4, twice.replace("5", "8", 1).replace("5", "9")), (5, twice.replace("5", "6", 1))]
    bench = spark.createDataFrame([(0, item), (1, twice)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(spark, spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert got == {(0, 0), (1, 0), (2, 0), (3, 1), (5, 1)}  # 4: one value stands for three; 5: most of it is verbatim


def problems(seed, n, start=0):
    """Word problems of made-up words with numbers, names and units; another ``seed`` gives the same with other values, each
    value having one other in its place."""
    out, rng = [], random.Random(seed)
    for i in range(start, start + n):
        own, to = random.Random(i), {}
        words = ["".join(own.choice("aeiou") + own.choice("bcdfglmnprst") for _ in range(own.randrange(2, 4))) for _ in range(own.randrange(12, 40))]
        for at in own.sample(range(1, len(words)), len(words) // 6):
            kind = own.randrange(3)
            value = (own.randrange(2, 99), own.randrange(4), own.randrange(5))[kind]
            new = (str(rng.randrange(2, 999)), rng.choice(("km", "miles", "hours", "kg")), rng.choice(("Anna", "Bob", "Carla", "Dan", "Eve")))[kind]
            words[at] = to.setdefault((kind, value), new)
        out.append(" ".join(words) + "?")
    return out


def test_decontam_recall_of_new_values(spark):
    """Items with all numbers, names and units drawn anew, inside other text: at least 0.9 found, and nothing else."""
    n = 120
    items, anew, other = problems(1, n), problems(2, n), problems(3, n, start=n)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = [(i, f"Words before it. {t} words after it.") for i, t in enumerate(anew)] + [(1000 + i, t) for i, t in enumerate(other)]
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(spark, spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert len(got & {(i, i) for i in range(n)}) >= 0.9 * n and all(d == i for d, i in got)


def test_decontam_against_brute_force(spark):
    d = f"{TESTDATA}/sf0.01"
    docs, bench = texts_of(table(spark, d, "documents")), {r.item_id: r.text for r in table(spark, d, "benchmark").collect()}
    plain = lambda t: re.findall(r"\w+", t.lower())
    joined = {i: " " + " ".join(plain(t)) + " " for i, t in docs.items()}
    whole = {(i, k) for k, b in bench.items() for i, t in joined.items() if " " + " ".join(plain(b)) + " " in t}
    got = {(r.doc_id, r.item_id) for r in QUERIES["op6_decontam"](spark, d).collect()}
    assert whole and whole <= got
    for i, k in got - whole:  # the rest share long stretches
        words = plain(bench[k])
        assert any(" " + " ".join(words[j : j + 8]) + " " in joined[i] for j in range(len(words) - 7))
    assert decontam.contaminated(spark, awkward(spark), table(spark, d, "benchmark")).count() == 0


# 7, 8

ODD = ["", " ", "  ", "a  b", " a", "a ", "a\n b", "a \nb", "\x1cx \x1c y", "x\x85y z", "a b c  d", "ab​ c", "it's we'll  'tis", "\t\ttabs\n\n\nnew", "emoji 😀😀 x", "a" * 5000, "x " * 3000, "\x00 \x01 b", "नमस्ते दुनिया", "日本語 テキスト。", " \n \n a", "᠎ a   b ", "<unk> <s> ▁ a▁b", None, "one", "é" * 70 + " é"]


@pytest.fixture(scope="module")
def corpus(spark):
    return [r.text for r in table(spark, SMALL, "documents").collect()][:120]


def test_bpe_is_tiktoken(corpus):
    import tiktoken

    path = tokenizers.path("byte_bpe_50k.tiktoken")
    own = bpe.codec(path, tokenizers.PATTERN)
    enc = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks={p: i for i, p in enumerate(bpe.read_ranks(path))}, special_tokens={})
    texts = [*ODD, *corpus]
    ids = own.encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in ids] == [enc.encode_ordinary(t or "") for t in texts]
    assert [own.decode(x).decode() for x in ids] == [t or "" for t in texts]
    assert own.encode([]) == []


def test_bpe_tables(spark):
    docs = awkward(spark)
    got = bpe.round_trip(docs, tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN).collect()
    want = texts_of(docs)
    assert len(got) == docs.count() and all(r.decoded_sha256 == hashlib.sha256((want[r.doc_id] or "").encode()).hexdigest() for r in got)
    assert bpe.round_trip(none(spark), tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN).count() == 0


def test_op7_is_tiktoken(spark):
    import tiktoken

    path = tokenizers.path("byte_bpe_50k.tiktoken")
    enc = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks={p: i for i, p in enumerate(bpe.read_ranks(path))}, special_tokens={})
    want = {}
    for i, t in texts_of(table(spark, SMALL, "documents")).items():
        ids = enc.encode_ordinary(t or "")
        want[i] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op7_bpe"](spark, SMALL).collect()} == want


def test_chunk_cache_stays_right_when_it_is_full(corpus, monkeypatch):
    from recloom.llm import pretokens

    path = tokenizers.path("byte_bpe_50k.json")
    whole = list(tokenfile.LibraryEncoder(path).encode(corpus))
    monkeypatch.setattr(pretokens, "KEPT", 50)
    monkeypatch.setattr(pretokens, "SLICE", 300)
    assert list(tokenfile.LibraryEncoder(path).encode(corpus)) == whole


def test_library_ids(corpus):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokenizers.path("byte_bpe_50k.json"))
    texts = [t or "" for t in [*ODD, "a <|endoftext|> b", "<|endoftext|>", *corpus]]
    got = list(tokenfile.encoder(tokenizers.path("byte_bpe_50k.json")).encode(texts))
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [lib.encode(t, add_special_tokens=False).ids for t in texts]


def test_token_files(spark, tmp_path):
    from tokenizers import Tokenizer

    path = tokenizers.path("byte_bpe_50k.json")
    lib, docs = Tokenizer.from_file(path), awkward(spark)
    manifest = tokenfile.write_token_files(spark, docs, path, f"file://{tmp_path}/t")
    got = tokenfile.read_token_files(spark, manifest, f"file://{tmp_path}/t").collect()
    rows = sorted(((r.doc_id if r.doc_id is not None else -1, r.text or "") for r in docs.collect()))
    at, want = 0, []
    for i, t in rows:
        ids = [*lib.encode(t, add_special_tokens=False).ids, 2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.start, r.n_tokens, r.ids_crc32) for r in got) == sorted(want)
    flat = np.concatenate([np.memmap(tmp_path / f"t/{m[0]:05d}.bin", "<u2") for m in manifest])
    assert len(flat) == at
    assert tokenfile.read_token_files(spark, tokenfile.write_token_files(spark, none(spark), path, f"file://{tmp_path}/e"), f"file://{tmp_path}/e").count() == 0


# 9

def lines_brute(rows, sites, words):
    spread, keeper = {}, {}
    for i, t, s in rows:
        for x in set((t if t is not None else "").split("\n")) if t is not None else ():
            x = x.strip(" ")
            if len(x.split(" ")) >= words:
                spread.setdefault(x, set()).add(s or "")
                if i is not None:
                    keeper[x] = min(keeper.get(x, i), i)
    bad = {x for x, s in spread.items() if len(s) >= sites}
    out = []
    for i, t, _ in rows:
        if t is None:
            out.append((i, None, 0, 0))
            continue
        all_lines = t.split("\n")
        kept = [x for x in all_lines if i is None or x.strip(" ") not in bad or keeper.get(x.strip(" "), i) == i]
        out.append((i, "\n".join(kept), len(all_lines), len(all_lines) - len(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("sites", [2, 5, 8])
def test_line_dedup(spark, sites):
    rng = random.Random(sites)
    pool = [f"line number {i} here" for i in range(30)] + ["too short", ""]
    rows = [(i, "\n".join(rng.choice(("", " ")) + rng.choice(pool[: rng.choice((6, 32))]) for _ in range(rng.randrange(1, 9))), f"s{rng.randrange(rng.choice((3, 12)))}") for i in range(120)]
    rows += [(500, None, "s1"), (501, "", None), (502, pool[0], None), (3, rows[3][1], rows[3][2])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, source string, hash string, keeper int")
    got = linededup.dedup_lines(df, min_sites=sites)
    assert got.columns == [*df.columns, "n_lines", "n_removed"]
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in got.collect()), key=str) == lines_brute(rows, sites, 3)


def test_line_dedup_keeps_columns_of_any_name(spark):
    names = ["doc_id", "text", "source", "row", "kept", "bad", "salt", "site", "hash", "keeper", "n_lines", "n_removed"]
    df = spark.createDataFrame([(i, f"the shared line of all\nown {i}", f"s{i}", *range(9)) for i in range(9)], ", ".join(f"{n} {'string' if n in ('text', 'source') else 'long'}" for n in names))
    got = linededup.dedup_lines(df).collect()
    assert sum(r.n_removed for r in got) == 8 and all([r[c] for c in names[3:10]] == list(range(7)) for r in got)


def test_line_dedup_awkward(spark):
    docs = awkward(spark)
    got = linededup.dedup_lines(docs)
    assert got.count() == docs.count() and got.agg({"n_removed": "sum"}).first()[0] == 0
    assert linededup.dedup_lines(none(spark)).count() == 0


# 10

def check_shards(rows, want, most):
    sizes = {}
    for r in rows:
        assert r.size == len((want[r.doc_id] or "").encode()) + 1 and r.text_crc32 == zlib.crc32((want[r.doc_id] or "").encode()) and r.law == "bytes" and r.grown_shard is None
        sizes.setdefault(r.shard, [0, []])
        sizes[r.shard][0] += r.size
        sizes[r.shard][1].append(r.slot)
    assert all(sorted(slots) == list(range(len(slots))) for _, slots in sizes.values())
    mean = sum(s for s, _ in sizes.values()) / 8
    assert all(abs(sizes.get(k, [0])[0] - mean) <= most for k in range(8))


def test_shards(spark):
    d = f"{TESTDATA}/sf0.01"
    docs = table(spark, d, "documents")
    check_shards(QUERIES["op10_sharding"](spark, d).collect(), texts_of(docs), 40_000)  # the longest document


def test_shards_of_one_group(spark):
    rows = [(i, "the very same text" if i % 3 else f"text {i}") for i in range(4000)]
    out = sharding.shard(spark, spark.createDataFrame(rows, "doc_id long, text string"), sample=500, ranges=64).collect()
    check_shards(out, dict(rows), 1200)
    docs = awkward(spark)
    assert sharding.shard(spark, docs).count() == docs.count()
    assert sharding.shard(spark, none(spark)).count() == 0


def test_other_patterns_are_not_cut(tmp_path):
    """Patterns and files for which the cuts don't hold are applied to whole texts."""
    import json

    from recloom.llm import pretokens

    assert pretokens.PATTERN == tokenizers.PATTERN
    texts = ["two words and two more, again two words", "a b c. d e\nf g", "  spaces   all  over ", "", "x"]
    for pattern in (r"\p{L}+ \p{L}+|\S+|\s+", r"[^ ]+ [^ ]+|.|\n", r"(\p{L})+|\s|\S", r"\S+\n\S+|."):
        codec = bpe.Codec(tokenizers.path("byte_bpe_50k.tiktoken"), pattern)
        import regex

        for t, ids in zip(texts, codec.encode(texts), strict=True):
            parts = [m.group() for m in regex.finditer(pattern, t)]
            assert ids == b"".join(codec._piece(x) for x in parts) and codec.decode(ids) == "".join(parts).encode()
    whole = json.loads(open(tokenizers.path("byte_bpe_50k.json")).read())
    assert tokenfile.LibraryEncoder(tokenizers.path("byte_bpe_50k.json")).chunks is not None
    for change in ({"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}}):
        (tmp_path / "t.json").write_text(json.dumps(whole | change))
        own = tokenfile.LibraryEncoder(str(tmp_path / "t.json"))
        assert own.chunks is None
        for t, ids in zip(["Two Words And", "a b. c\nd", ""], own.encode(["Two Words And", "a b. c\nd", ""]), strict=True):
            assert ids == np.array(own.lib.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
