import hashlib
import io
import struct
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from graphloom.llm import media, near_dup


def png(width=3, height=2):
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    rows = b"".join(b"\0" + bytes(3 * width) for _ in range(height))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def bmp(width=4, height=2):
    pixels = bytes(width * 3 * height)
    return b"BM" + struct.pack("<IIIIiiHHIIIIII", 54 + len(pixels), 0, 54, 40, width, height, 1, 24, 0, len(pixels), 0, 0, 0, 0) + pixels


def gif():
    return b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + bytes(6) + b"\x2c" + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02\x44\x01\0" + b"\x3b"


def jpeg():
    return b"\xff\xd8\xff\xe0" + struct.pack(">H", 16) + bytes(14) + b"\xff\xda" + struct.pack(">H", 8) + bytes(6) + b"\x11\xff\0\x22\xff\xd9"


def archive():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.txt", "hello")
    return out.getvalue()


def pdf():
    return b"%PDF-1.4\n1 0 obj\nendobj\nxref\nstartxref\n9\n%%EOF"


MADE = [("image/png", png()), ("image/bmp", bmp()), ("image/gif", gif()), ("image/jpeg", jpeg()), ("application/zip", archive()), ("application/pdf", pdf()), ("audio/wav", media.wav(b"abc"))]


@pytest.mark.parametrize(("kind", "value"), MADE)
def test_formats_are_confirmed_and_carved(kind, value):
    sniffer = media.Sniffer()
    assert sniffer.sniff(value)[:2] == (kind, len(value))
    kind_here, length, parts = sniffer.sniff(b"junk BM RIFF " + value + b" more GIF89a")
    assert (kind_here, length) == (media.UNKNOWN, 0)
    assert [(p.kind, p.start, p.length) for p in parts] == [(kind, 13, len(value))]


@pytest.mark.parametrize(("kind", "value"), MADE)
def test_cut_or_broken_values_are_unknown(kind, value):
    sniffer = media.Sniffer()
    for n in range(2, len(value)):
        assert sniffer.sniff(value[:n])[0] != kind, n
    assert sniffer.sniff(b"")[0] == sniffer.sniff(None)[0] == media.UNKNOWN


def commented():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("b.txt", "hello" * 9)
        z.comment = b"a note"
    return out.getvalue()


def test_whole_archives_and_last_revisions():
    sniffer = media.Sniffer()
    archive_, updated = commented(), pdf() + b"\n2 0 obj\nendobj\nxref\nstartxref\n62\n%%EOF"
    assert pdf().rindex(b"xref\nstart") and updated[62:66] == b"xref"
    assert sniffer.sniff(archive_)[:2] == ("application/zip", len(archive_))
    assert sniffer.sniff(archive_[:-1])[0] == media.UNKNOWN
    assert sniffer.sniff(updated)[:2] == ("application/pdf", len(updated))
    both = b"x" + pdf() + b" text %%EOF " + updated
    assert [(p.start, p.length) for p in sniffer.parts(both)] == [(1, len(pdf())), (1 + len(pdf()) + 12, len(updated))]


@pytest.mark.parametrize("unit", [b"%PDF-1", b"PK\x03\x04", b"PK\x03\x04PK\x05\x06" + bytes(18), b"%PDF-1.4 1 0 obj startxref 9 %%EOF ", b"\xff\xd8\xff\xda\0\x02", b"GIF89a" + bytes(7) + b"\x21\xf9", b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR", b"RIFF\xff\xff\0\0WAVE", b"BM"])
def test_time_is_linear(unit):
    """Values that repeat a magic: eight times the length takes nowhere near sixty-four times as long."""
    import time

    def seconds(n):
        value, sniffer = unit * (n // len(unit)), media.Sniffer()
        began = time.process_time()
        sniffer.parts(value)
        return time.process_time() - began

    assert seconds(1_600_000) < 24 * max(seconds(200_000), 0.02)


def test_declared_types_are_corrected(spark):
    rows = [(1, png() + b"tail" + gif(), "image/gif"), (2, None, None), (3, b"plain", "image/png"), (4, media.wav(bmp()), "audio/wav")]
    found = {r["id"]: r for r in media.sniff_media(spark.createDataFrame(rows, "id long, media binary, declared string"), "id", "media", "declared").collect()}
    assert (found[1]["detected"], found[1]["corrected"], found[1]["trailing"]) == ("image/png", True, 4 + len(gif()))
    assert [(p["kind"], p["sha256"]) for p in found[1]["parts"]] == [("image/gif", hashlib.sha256(gif()).hexdigest())]
    assert (found[2]["detected"], found[2]["length"], found[2]["parts"]) == (media.UNKNOWN, 0, [])
    assert found[3]["corrected"] and not found[4]["corrected"]
    assert [(p["kind"], p["start"]) for p in found[4]["parts"]] == [("image/bmp", 44)]


def test_texts_round_trip(docs):
    rows = media.media_digest(media.text_media(docs)).collect()
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    assert len(rows) == docs.count()
    for r in rows:
        raw = texts[r["doc_id"]]
        payload = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        stored = media.wav(payload)
        assert (r["media_bytes"], r["media_sha256"], r["detected"], r["corrected"]) == (len(stored), hashlib.sha256(stored).hexdigest(), "audio/wav", media.DECLARED[zlib.crc32(raw) % 4] != "audio/wav")
        assert r["embedded"] == len(r["parts"]) == 0


def test_digests_carve_what_is_embedded(spark):
    value = media.wav(b"some" + png() + b"noise" + gif())
    stored = spark.createDataFrame([(7, 5, "text/plain", value)], "doc_id long, n_bytes long, declared string, media binary")
    row = media.media_digest(stored).first()
    assert [(p["kind"], p["start"], p["sha256"]) for p in row["parts"]] == [("image/png", 48, hashlib.sha256(png()).hexdigest()), ("image/gif", 53 + len(png()), hashlib.sha256(gif()).hexdigest())]
    assert row["embedded"] == 2 and row["corrected"]


def test_no_texts(empty):
    assert media.media_digest(media.text_media(empty)).count() == 0


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    docs.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, i % 2, int(i in (13, 30, 33))) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def test_stages_keep_columns_and_run_agrees(spark, folder, docs):
    rows = spark.read.parquet(f"{folder}/documents.parquet")
    columns = rows.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, rows, folder)
        assert after.columns == columns, name
        after = after.cache()
        if name == "near_duplicates":
            assert after.filter("doc_id is null").count() == rows.filter("doc_id is null").count()
            again = near_dup.near_duplicates(after).filter("doc_id is not null and n_shingles > 0")
            assert again.count() == again.select("component_id").distinct().count()
        if name != "mixing":
            assert after.exceptAll(rows).count() == 0
        rows = after
    packed = corpus_pipeline.STAGES[-1][1](spark, rows, folder)
    again = corpus_pipeline.run(spark, folder)
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(str, packed.select(*key).collect())) == sorted(map(str, again.select(*key).collect()))


def test_near_duplicates_go_row_by_row(spark):
    """Of rows that share an id each goes by its own text; the choice does not hang on the order of rows, and columns may be named like the stage's own."""
    base = [f"w{i}" for i in range(60)]
    near = " ".join(base[:59] + ["x"])
    rows = [(1, " ".join(base), "b", 1), (1, "quite another text that nobody else has here", "a", 2), (2, near, "a", 3), (2, "and one more text that is alone in the world", "a", 4), (3, near, "c", 5), (None, near, "d", 6), (4, None, "e", 7), (5, " ".join(base), "f", 8), (6, "a b c d e f", "z", 9), (6, "A  B c d e f", "y", 10)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string, __digest int")
    expected = {1, 2, 4, 6, 7, 10}
    for parts in (1, 4):
        kept = corpus_pipeline.drop_near_duplicates(spark, table.repartition(parts), "")
        assert kept.columns == table.columns
        found = {r["__digest"] for r in kept.collect()}
        assert len(found & {9, 10}) == 1 and found - {9, 10} == expected - {10}


def test_stages_with_columns_of_their_names(spark, folder):
    rows = spark.read.parquet(f"{folder}/documents.parquet")
    names = ["__toxicity", "__toxic", "__language", "__posterior", "__bits", "__key", "__own", "__of", "__copies", "__times", "__rows", "__order", "order", "copies", "digest"]
    more = rows.select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after, plain = stage(spark, more, folder), stage(spark, rows, folder)
        assert after.columns == more.columns, name
        assert sorted(map(str, after.select("doc_id", "text").collect())) == sorted(map(str, plain.select("doc_id", "text").collect())), name


def test_languages_that_were_not_learnt(spark):
    texts = [(i, "the quick brown fox and the lazy dog went on " * 4, "en", "a") for i in range(30)] + [(100, "Быстрая лиса перепрыгнула через ленивую собаку " * 4, None, "a"), (101, "1234", "en", "a"), (102, None, "en", "a")]
    table = spark.createDataFrame(texts, "doc_id long, text string, lang string, source string")
    assert {r["doc_id"] for r in corpus_pipeline.keep_known_languages(spark, table, "").collect()} == set(range(30))


def test_stages_on_nothing(spark, folder, empty):
    rows = empty
    for _, stage in corpus_pipeline.STAGES:
        rows = stage(spark, rows, folder)
    assert rows.count() == 0


def test_mixing_repeats_rows(spark):
    rows = spark.createDataFrame([(1, "a b c", "x"), (1, "a b c", "x"), (2, "d e f g h i j k l m n o p q r s t u v w x y z", "y"), (None, "q", "x"), (None, "q", "x")], "doc_id long, text string, source string")
    mixed = corpus_pipeline.mix_sources(spark, rows, "")
    by_id = {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    copies = {}
    from graphloom.llm import mixing

    for r in mixing.mix(rows).groupBy("doc_id").agg(F.sum("copies").alias("n")).collect():
        copies[r["doc_id"]] = r["n"]
    assert by_id == {k: v for k, v in copies.items() if v}
