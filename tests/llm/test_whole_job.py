"""Inputs on which a cut in an operator would lose part of the job."""

import random
import zlib

from pyspark.sql import functions as F

import corpus_pipeline
from tarnlight.llm import language, line_dedup, media

JPEG = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xda\x00\x04cd\x12\xff\x00\x34\xff\xd9"
WORDS = [a + b for a in ("lo", "ra", "mi", "te", "su", "ko", "ne", "vi") for b in ("", "n", "ri", "sta", "lo")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def test_language_learns_from_whole_texts_whatever_the_copies(spark):
    rng = random.Random(11)
    header, copy = "one shared licence header " * 20, prose(rng, 300)
    rows = [(i, header + prose(rng, 300), "aa") for i in range(200)]  # heads are all alike
    rows += [(1000 + i, copy if i < 3800 else prose(rng, 300), "bb") for i in range(4000)]  # copies are most rows
    rows += [(9000, prose(rng, 6000), "cc")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language.fit(docs, F.lit(True))
    assert model.languages == ["aa", "bb", "cc"] and model.sizes.min() > 25_000


def test_line_dedup_drops_boilerplate_of_small_hosts(spark):
    rng = random.Random(12)
    rows = [(i, f"shared head\n{prose(rng, 12)}", f"s{i % 10}") for i in range(190)]  # 19 pages a host
    out = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()
    assert all(r["_dropped"] == 1 and r["text"] == rows[r["doc_id"]][1].split("\n")[1] for r in out)


def test_copies_of_a_page_keep_their_content(spark, tmp_path):
    rng = random.Random(13)
    copy = "\n".join(prose(rng, 12) for _ in range(4))
    rows = [(i, ("shared head\n" if i % 4 == 0 else "") + (copy if i % 3 == 0 else prose(rng, 30)), "aa", "s", 1) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    lines = corpus_pipeline.drop_boilerplate(spark, docs, str(tmp_path)).cache()
    assert all(r["text"] == rows[r["doc_id"]][1].removeprefix("shared head\n") for r in lines.collect())
    kept = [r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, lines, str(tmp_path)).collect()]
    assert sorted(kept) == sorted([0] + [i for i in range(120) if i % 3])


def test_languages_of_large_alphabets_are_told_apart():
    rng = random.Random(14)
    common, own = [chr(0x4E00 + k) for k in range(60)], {k: [chr(0x5000 + 0x400 * i + j) for j in range(300)] for i, k in enumerate("abc")}

    def text(k, n):
        return "".join(rng.choice(common) if rng.random() < 0.5 else rng.choice(own[k]) for _ in range(n))

    model = language.train({**{k: [text(k, 400) for _ in range(60)] for k in own}, "latin": [prose(rng, 4000)]})
    texts = [(k, text(k, 60)) for k in own for _ in range(20)] + [("latin", prose(rng, 20))]
    assert [p[0] for p in language.predict(model, [t for _, t in texts])] == [k for k, _ in texts]
    assert model.classes > 960


def test_characters_a_language_lacks_are_phrases():
    text = "abcabdabx"
    model = language.train({"l": [text], "m": ["qz"]})
    for s, n in (("abcabd", 1), ("abqab", 3), ("zz", 2), ("zabq", 3), ("一ab一", 3)):
        assert int(language.phrase_counts(model, [s])[0, 0]) == n, s


def test_media_inside_media_are_listed_and_carved(spark):
    pdf = b"%PDF-1.4\n1 0 obj\nstream\n" + JPEG + b"\nendstream\nendobj\nstartxref\n9\n%%EOF\n"
    sound = media.to_wav(media.payload_of(b"noise" + pdf))
    out = media.sniff(spark.createDataFrame([(1, pdf, None), (2, sound, None)], "id int, media binary, declared string"))
    jpeg = pdf.index(JPEG)
    found = {r["id"]: (r["_type"], [(m["type"], m["offset"]) for m in r["_embedded"]]) for r in out.collect()}
    assert found == {1: ("application/pdf", [("image/jpeg", jpeg)]), 2: ("audio/wav", [("application/pdf", 49), ("image/jpeg", 49 + jpeg)])}
    assert sorted(bytes(r["carved"]) for r in media.carve(out).collect()) == sorted([JPEG, JPEG, pdf])


def test_media_features_report_what_a_text_holds(spark):
    text = "see %PDF-1.4\n1 0 obj\nendobj\nstartxref\n9\n%%EOF"
    docs = spark.createDataFrame([(1, text), (2, "no medium")], "doc_id bigint, text string")
    found = {r["doc_id"]: r["feature"] for r in media.features(media.store_texts(docs)).collect()}
    assert found[1].endswith(f"embedded=1;holds=application/pdf@4+{len(text) - 4}#{zlib.crc32(text[4:].encode()):08x}") and found[2].endswith("embedded=0;holds=")
