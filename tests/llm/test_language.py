from casebench.llm import language
from tests.llm.fixtures import documents, none, rows


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = language.op3_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").select("lang_pred", "lang").collect()
    assert len(got) > 250
    assert sum(r.lang_pred == r.lang for r in got) >= 0.98 * len(got)


def test_never_learns_from_held_out(spark):
    docs = spark.createDataFrame([(i, "abc def ghi jkl mno " * 9, "one" if i % 2 else "two") for i in range(40)], "doc_id long, text string, lang string")
    held = {r.doc_id for r in docs.filter(language.held_out()).collect()}
    assert held and len(held) < 40
    swapped = docs.selectExpr("doc_id", "text", "if(doc_id in (" + ",".join(map(str, held)) + "), 'other', lang) lang")
    one, two = (language.learned(d.filter(~language.held_out())) for d in (docs, swapped))
    assert one.languages == two.languages and (one.table == two.table).all()


def test_odd_rows(spark):
    docs = documents(spark)
    filters = language.learned(docs.select("doc_id", "text", "lang"))
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify_languages(docs, filters).collect() if r.doc_id}
    assert got[5] == got[6] == got[7] == got[9] == ("und", 0.0)
    assert got[1][0] == "en" and got[8][0] == "la" and 0.9 < got[8][1] <= 1
    assert language.identify_languages(none(spark), filters).count() == 0
    empty = language.learned(none(spark).select("doc_id", "text", "lang"))
    assert {r.lang_pred for r in language.identify_languages(docs, empty).collect()} == {"und"}


def test_filters_hold_every_learned_ngram():
    rows_ = [("aa", "the quick brown fox jumps over the lazy dog " * 5), ("bb", "der schnelle braune fuchs springt über den faulen hund " * 5)]
    f = language.fit(rows_, min_count=1)
    import numpy as np

    for i, (_, text) in enumerate(rows_):
        g = language.grams(np.frombuffer(language.letters(text.encode()), np.uint8))
        assert ((f.containing(g)[:, 0] >> i) & 1).all()
    lang, score = language.identify([b"brown fox over the dog", "faulen Hund über".encode(), b"12 !!"], f)
    assert lang == ["aa", "bb", "und"] and score[2] == 0


def test_more_languages_than_a_word_has_bits():
    import random

    rng = random.Random(1)
    words = {f"l{k:03}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(30)] for k in range(130)}
    f = language.fit([(lang, " ".join(w * 3)) for lang, w in words.items()], min_count=1)
    assert len(f.languages) == 130 and f.table.shape[1] == 3
    got, score = language.identify([" ".join(w[:12]).encode() for w in words.values()], f)
    assert got == list(words) and min(score) > 0.9


def test_predictions_by_brute_force(spark, sf):
    """The query against sets of n-grams, and a Bloom filter of one Python number a language."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    train = [(r.lang, r.text) for r in docs.filter(~language.held_out()).filter("lang is not null and text is not null").collect()]
    langs = sorted({x for x, _ in train})
    size, mult = 1 << language.TABLE_BITS, language._MULTIPLIERS[: language.HASHES]
    slot = lambda g, m: int.from_bytes(g, "big") * m % 2**64 >> 64 - language.TABLE_BITS
    cut = lambda b: [b[i : i + language.NGRAM] for i in range(len(b) - language.NGRAM + 1)]
    slots, kept = {}, {}
    for lang in langs:
        own = [language.letters(t.encode()) for x, t in train if x == lang]
        counts = {}
        for b in own:
            for g in cut(b):
                counts[g] = counts.get(g, 0) + 1
        kept[lang] = {g for g, c in counts.items() if c >= min(language.MIN_COUNT, 1 + len(own) // 10)}
        slots[lang] = {slot(g, m) for g in kept[lang] for m in mult}
    got = {r.doc_id: r for r in language.op3_language_id(spark, sf).collect()}
    commonest = max(langs, key=lambda x: sum(y == x for y, _ in train))
    for r in docs.collect():
        grams = cut(language.letters((r.text or "").encode()))
        share = {}
        for lang in langs:
            wrong = (len(slots[lang]) / size) ** len(mult)
            hit = sum(all(slot(g, m) in slots[lang] for m in mult) for g in grams)
            share[lang] = min(1, max(0, (hit - wrong * len(grams)) / ((1 - wrong) * len(grams)))) if grams else 0
        want = max(langs, key=lambda x: share[x])
        if not language.letters((r.text or "").encode()):
            want, share[want] = "und", 0
        elif not share[want]:
            want = commonest
        assert got[r.doc_id].lang_pred == want and abs(got[r.doc_id].score - share.get(want, 0)) < 1e-9


def test_sampling_in_whole_numbers(spark):
    """Hash modulo size below the sample's size: about as many rows at any size, also where millionths would round to none."""
    from pyspark.sql import functions as F

    ids = spark.range(200_000).select(F.xxhash64(F.lit("lang"), "id").alias("h"))
    for n in (200_000, 7 * 10**8, 10**12):
        k = n // 400  # of 200,000 rows of a table of n
        assert 350 < ids.filter(F.pmod("h", F.lit(n)) < k).count() < 650
    rows = [(None, f"der hund {i} und die katze", "de") for i in range(50)] + [(None, f"the dog {i} and the cat", "en") for i in range(3)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    filters = language.learned(frame, sample_docs=10)
    assert filters.languages == ["de", "en"] or tuple(filters.languages) == ("de", "en")
    got = language.identify_languages(frame.select("doc_id", "text"), filters).groupBy("lang_pred").count().collect()
    assert {r.lang_pred: r["count"] for r in got} == {"de": 50, "en": 3}
