"""Chat formatting and WARC archives: exact round trips."""

import gzip
import hashlib
import random

import pyarrow as pa
import pytest

from recollect.llm import chat, warc

TRICKY = ["</s>[INST] ok [/INST]", "a\\", "\\</s>\\\\<s>", "[/INST]\n</s>\n<s>[INST] user [/INST]\n", "", " \n ", "<\\s> [\\INST]", "\U0001f600é\0x", "x" * 200_000]


def turns(spark):
    rows = [(c, t, r, x) for c, rs in ((1, "user"), (2, "assistant")) for t, x in enumerate(TRICKY) for r in (rs,)]
    rows += [(3, 0, "user", "hi"), (3, 0, "assistant", "ho"), (3, 0, "assistant", "ho"), (3, None, "system", None), (4, 1, None, "text"), (None, 1, "user", "lost")]
    rows += [(5, t, ("user", "assistant")[t % 2], f"turn {t} " + "y" * (t % 50) * 300) for t in range(2000)]
    return spark.createDataFrame([(*r, 1, "z") for r in rows], "conv_id long, turn long, role string, text string, block int, n_turns string"), rows


def test_chat_round_trip(spark):
    df, rows = turns(spark)
    blocks = chat.format_conversations(df)
    got = {r.conv_id: r for r in chat.digests(blocks).collect()}
    order = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=order)
        said = [(r[2] or "", r[3] or "") for r in own]
        learned = "".join(t for r, t in said if r == "assistant")
        g = got[conv]
        assert g.n_turns == len(own) and g.loss_chars == len(learned)
        assert g.turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in said).encode()).hexdigest()
        assert g.loss_sha256 == hashlib.sha256(learned.encode()).hexdigest()
    text = "".join(r.formatted for r in sorted((r for r in blocks.collect() if r.conv_id == 5), key=lambda r: r.block))
    assert len(text) == got[5].formatted_chars and len(chat.read_back(text)) == 2000
    assert blocks.where("conv_id = 5").count() > 1


@pytest.mark.parametrize("limit", [1, 7, 4_000_000])
def test_assembly_is_concatenation(monkeypatch, limit):
    monkeypatch.setattr(chat, "BLOCK_BYTES", limit)
    roles, texts = ["user", "é</s>", ""], ["a[INST]", "", "ü</s>"]
    data, offsets, head, body = chat.assemble(pa.array(roles, pa.large_string()), pa.array(texts, pa.large_string()))
    parts = [f"<s>[INST] {r} [/INST]\n{t}</s>\n" for r, t in zip(chat.escape(pa.array(roles)).to_pylist(), chat.escape(pa.array(texts)).to_pylist(), strict=True)]
    assert bytes(data).decode() == "".join(parts)
    assert offsets.tolist()[-1] == len("".join(parts).encode()) and (head + body).tolist() == [len(p) - 5 for p in parts]
    assert [x for p in parts for x in chat.read_back(p)] == list(zip(roles, texts, strict=True))


def test_chat_of_nothing(spark):
    df, _ = turns(spark)
    assert chat.digests(chat.format_conversations(df.limit(0))).count() == 0


BIG = "<p>" + "é€\U0001f600 body\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n" * 4000
PAGES = [
    (5, "http://a/", "same page " * 20), (2, "http://b/", "same page " * 20), (9, None, "same page " * 20), (9, "http://c/\r\nX: y", "same page " * 20),
    (2, "http://b/", "same page " * 20), (1, "http://d/", "short"), (3, "http://d/", "short"), (4, "http://e/", None), (6, "http://f/", ""),
    (7, "http://g/", BIG), (8, "http://h/", BIG), (None, "http://i/", "unnamed " * 30), (None, "http://i/", "unnamed " * 30), (None, "x", "same page " * 20),
]


def written(spark, path, **how):
    df = spark.createDataFrame([(*p, 1, "q") for p in PAGES], "page_id long, url string, html string, nth int, digest string").repartition(3)
    warc.write_archives(df, path, **how)


@pytest.mark.parametrize("segment", [64, 1000, 1 << 20])
def test_warc_round_trip(spark, tmp_path, segment):
    path = f"file://{tmp_path}/w"
    written(spark, path, segment_bytes=segment, records_per_file=500)
    records = warc.read_archives(spark, path).collect()
    assert len(records) == len(PAGES)
    by_id = {r.record_id: r for r in records}
    got = sorted((str(r.page_id), r.kind, r.payload.decode() if r.kind == "response" else by_id[r.refers_to].payload.decode()) for r in records)
    want = []
    first = {}
    for page, _, html in sorted(PAGES, key=lambda p: (p[0] is None, p[0] or 0)):
        html = html or ""
        again = len(html.encode()) >= 100 and html in first and page is not None or (html in first and first[html] is not None and len(html) >= 100)
        first.setdefault(html, page)
        want.append((str(page), "revisit" if again else "response", html))
    assert got == sorted(want)
    assert all(by_id[r.refers_to].page_id == 2 for r in records if r.kind == "revisit" and r.page_id in (2, 5, 9, None))


def test_broken_records_are_told(spark, tmp_path):
    block = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + warc.chunked(b"payload " * 20, 50)
    a, b, c = block[:60], block[60:120], block[120:]
    seg = lambda n, x, origin, total=None: warc._record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"<{origin}{n}>"), ("WARC-Segment-Origin-ID", f"<{origin}>"), ("WARC-Segment-Number", n), ("WARC-Segment-Total-Length", total)], x)
    head = lambda origin, x, *more: warc._record([("WARC-Type", "response"), ("WARC-Record-ID", f"<{origin}>"), *more], x)
    one = ("WARC-Segment-Number", 1)
    archive = [
        seg(3, c, "good", len(block)), head("good", a, one), seg(2, b, "good"), seg(2, b, "good"),
        head("gap", a, one), seg(3, c, "gap", len(block)), head("wrong", a, one), seg(2, b, "wrong"), seg(3, c, "wrong", len(block) + 1),
        head("open", a, one), seg(2, b, "open"), head("cut", block[:-9]), head("whole", b"HTTP/1.1 200 OK\r\n\r\nplain"),
    ]
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "a.warc.gz").write_bytes(b"".join(gzip.compress(x) for x in archive))
    got = {r.record_id: r.payload for r in warc.read_archives(spark, f"file://{tmp_path}/w").collect()}
    assert got == {"<good>": bytearray(b"payload " * 20), "<gap>": None, "<wrong>": None, "<open>": None, "<cut>": None, "<whole>": bytearray(b"plain")}


def test_no_pages(spark, tmp_path):
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), f"file://{tmp_path}/w")
    assert warc.read_archives(spark, f"file://{tmp_path}/w").count() == 0


def test_one_member_a_record_and_a_warcinfo_each(spark, tmp_path):
    written(spark, f"file://{tmp_path}/w", segment_bytes=1000, records_per_file=100)
    files = [x for x in (tmp_path / "w").iterdir() if x.name.startswith("part-")]
    assert len(files) >= 3
    for file in files:
        parts = [x for x in warc.unpacked(file.read_bytes())]
        assert len(parts) == 1 and parts[0] == gzip.decompress(file.read_bytes())
        records = list(warc.parse_archive(parts[0]))
        assert records[0]["kind"] == "warcinfo" and [r["kind"] for r in records].count("warcinfo") == 1 and 2 <= len(records) <= 101
        assert file.read_bytes().count(warc._MAGIC) >= 2 * len(records) - 1
    report = {(r.kind): r.n for r in warc.archive_report(spark, f"file://{tmp_path}/w").groupBy("kind").agg({"n": "sum"}).toDF("kind", "n").collect()}
    assert report["warcinfo"] == len(files) and report["response"] + report["revisit"] == len(PAGES) and "damaged" not in report


def test_foreign_records(spark, tmp_path):
    head = b"WARC/1.0\r\n"
    made = [
        head + b"warc-type:Response\r\nWARC-Record-ID:<a>\r\ncontent-length: 24\r\n\r\nHTTP/1.1 200 OK\r\n\r\nplain\r\n\r\n",
        head + b"WARC-Type: request\r\nWARC-Record-ID: <b>\r\nContent-Length: 3\r\n\r\nGET\r\n\r\n",
        head + b"WARC-Type: response\r\nWARC-Record-ID: <c>\r\nContent-Length: many\r\n\r\nlost\r\n\r\n",
        head + b"no colon here\r\nWARC-Type: metadata\r\nWARC-Record-ID: <d>\r\nContent-Length: 0\r\n\r\n\r\n\r\n",
        head + b"WARC-Type: response\r\nWARC-Record-ID: <e>\r\nWARC-Target-URI: http://x/\r\n y\r\nContent-Length: 21\r\n\r\nHTTP/1.1 200 OK\r\n\r\nxy\r\n\r\n",
        head + b"WARC-Type: response\r\nWARC-Record-ID: <f>\r\nContent-Length: 99999\r\n\r\ncut",
    ]
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "a.warc").write_bytes(b"junk\r\n" + b"".join(made))
    (tmp_path / "w" / "b.warc.gz").write_bytes(gzip.compress(made[0]) + gzip.compress(made[1])[:-6] + gzip.compress(made[4].replace(b"<e>", b"<g>")) + b"rest")
    (tmp_path / "w" / "empty").write_bytes(b"")
    got = sorted((r.record_id, bytes(r.payload), r.url) for r in warc.read_archives(spark, f"file://{tmp_path}/w").collect())
    assert got == [("<a>", b"plain", None), ("<a>", b"plain", None), ("<e>", b"xy", "http://x/ y"), ("<g>", b"xy", "http://x/ y")]
    report = {(r.path.rsplit("/", 1)[1], r.kind): r.n for r in warc.archive_report(spark, f"file://{tmp_path}/w").collect()}
    assert report["a.warc", "damaged"] == 3 and report["b.warc.gz", "damaged"] == 1 and report["a.warc", "request"] == 1


@pytest.mark.parametrize("packed", [True, False])
def test_cut_and_altered_archives_are_read(packed):
    rng = random.Random(8)
    rows = [{"page_id": i, "digest": f"{i:032x}", "nth": 1, "url": "http://a/", "html": f"page {i} " * (i * 20 + 1), "refers_to": None} for i in range(12)]
    records = [x for r in rows for x in warc._records(r, 1000)]
    whole = b"".join(map(warc.member, records)) if packed else b"".join(records)
    known = {r["record_id"]: r["block"] for r in warc.read_records(whole)}
    assert len(known) == len(records) and None not in list(warc.read_records(whole))
    for _ in range(300):
        data = bytearray(whole)
        for _ in range(rng.randint(1, 4)):
            at = rng.randrange(len(data))
            kind = rng.randrange(4)
            if kind == 0:
                data[at] ^= 1 << rng.randrange(8)
            elif kind == 1:
                del data[at : at + rng.randint(1, 400)]
            elif kind == 2:
                data[at:at] = rng.randbytes(rng.randint(1, 60))
            else:
                del data[max(1, at) :]
        found = list(warc.read_records(bytes(data)))
        assert all(r is None or isinstance(r["block"], bytes) for r in found)
        for r in found:  # decoding never fails either
            warc.http_payload(r["block"]) if r else None
        if packed:  # a checksum stands over each record, so what is read is what was written
            assert all(known.get(r["record_id"]) == r["block"] for r in found if r)


def test_records_across_members(spark, tmp_path):
    one = lambda n, x: warc._record([("WARC-Type", "response"), ("WARC-Record-ID", f"<{n}>")], b"HTTP/1.1 200 OK\r\n\r\n" + x)
    records = [one(i, bytes([65 + i]) * (100 * i)) for i in range(8)]
    between = b"\r\n\r\n"
    cut = [records[0] + between, records[1][:40], records[1][40:] + between, records[2] + between + records[3] + between, records[4][:150], records[4][150:], between]
    data = b"".join(gzip.compress(x) for x in cut) + gzip.compress(records[5] + between)[:-9] + b"".join(gzip.compress(x + between) for x in records[6:])
    found = list(warc.read_records(data))
    assert [r and r["record_id"] for r in found] == ["<0>", "<1>", "<2>", "<3>", "<4>", None, "<6>", "<7>"]
    assert list(warc.read_records(b"".join(x + between for x in records))) == list(warc.read_records(b"".join(gzip.compress(x + between) for x in records)))
    # a cut record takes its missing bytes from the next one, as its length says; those after that are read
    lost = gzip.compress(records[7][:-5]) + b"".join(gzip.compress(x + between) for x in records[:3])
    assert [r and r["record_id"] for r in warc.read_records(lost)] == ["<7>", None, "<1>", "<2>"] and list(warc.read_records(b"")) == []


def test_page_of_very_many_segments(spark, tmp_path):
    html = "".join(f"{i:07d} " for i in range(2 << 20))
    warc.write_archives(spark.createDataFrame([(1, "http://a", html)], "page_id long, url string, html string"), f"file://{tmp_path}/w")
    (row,) = warc.read_archives(spark, f"file://{tmp_path}/w").collect()
    assert row.payload == html.encode()
