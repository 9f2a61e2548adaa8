import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from casebench.functions import lexicon, pii, scalars, text


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'array<string>' if isinstance(v, list) else 'long'}" for k, v in values.items()))
    return row.select(column.alias("x")).first().x


def test_folding(spark):
    s = "  L’Héritière  a  ÉTÉ "
    assert lexicon.folded(s) == "l'heritiere a ete"
    assert one(spark, lexicon.fold(F.col("s")), s=s) == one(spark, lexicon.fold_native(F.col("s")), s=s) == "l'heritiere a ete"
    assert lexicon.folded(None) == ""


@pytest.mark.parametrize(("s", "expected"), [("23 477,34 €", [23477]), ("23 477 euros et 23.477,10 eur", [23477]), ("1 000 000 euros", [1000000]), ("7 chiens", []), ("5,5 € 5 €", [5])])
def test_amounts(spark, s, expected):
    assert [int(x) for x in one(spark, lexicon.amounts(lexicon.fold(F.col("s"))), s=s)] == expected


def test_counts_markers_polarity(spark):
    assert [(r.n, r.noun) for r in one(spark, lexicon.party_counts(F.col("s")), s="3 heritiers et 2 petits-enfants, 3 heritiers")] == [(3, "heritiers"), (2, "petits-enfants")]
    assert one(spark, lexicon.obligation_markers(lexicon.fold(F.col("s"))), s="Il s’engage et devra") == ["s'engage", "devra"]
    assert one(spark, lexicon.forbidden_terms(lexicon.fold(F.col("s"))), s="un abus de confiance") == ["abus de confiance"]
    a, b = (one(spark, lexicon.polarity(F.col("s")), s=s) for s in ("a accepte", "a refuse"))
    assert a.axis == b.axis and (a.sign, b.sign) == (1, -1)
    assert one(spark, lexicon.polarity(F.col("s")), s="dort") is None


def test_pages_and_sentences(spark):
    s = "## Page 1\nUn.\n\n## Page 2\n \n## Page 3\nDeux. Trois"
    assert [(p.page, p.body) for p in one(spark, text.pages(F.col("s")), s=s)] == [(1, "Un."), (3, "Deux. Trois")]
    assert [(p.page, p.body) for p in one(spark, text.pages(F.col("s")), s="plain")] == [(1, "plain")]
    assert one(spark, text.sentences(F.col("s")), s="Un. Deux! trois? Élan") == ["Un.", "Deux! trois?", "Élan"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abc .\n", min_size=0, max_size=120), max_size=12).map("\n\n".join))
def test_chunks_lose_no_word(s):
    got = text.chunks_of(s, 60, 15)
    words = s.split()
    it = iter(" ".join(got).split())
    assert all(w in it for w in words)  # in order
    assert got == text.chunks_of(s, 60, 15)
    if len(s.strip()) <= 60:
        assert got == ([s.strip()] if s.strip() else [])


def test_chunk_sizes_and_overlap(spark):
    s = " ".join(f"word{i:03d}" for i in range(400))
    got = text.chunks_of(s)
    assert len(got) > 3 and all(len(c) <= text.TARGET + text.OVERLAP + 10 for c in got)
    for a, b in zip(got, got[1:], strict=False):
        head = b.split("\n\n")[0]
        assert a.endswith(head)
    assert one(spark, text.chunks(F.col("s")), s=s) == got
    spark.udtf.register("chunk_text", text.ChunkText)
    assert [r.chunk for r in spark.sql(f"SELECT * FROM chunk_text('{s}')").collect()] == got


def test_snippets_globs_templates(spark):
    body = "x" * 3000 + "the exact   quote here" + "y" * 3000
    near = lambda b, q: one(spark, text.around(F.col("s"), F.lit(q)), s=b)
    assert near(body, "the exact quote here") == "x" * 1000 + "the exact   quote here" + "y" * 1000 and near("a (b) c. \\E d", "(b) c. \\E d") == "a (b) c. \\E d"
    assert near(body, "absent") == near(body, "") == body[: text.WINDOW] and near("ab", "b") == "ab"
    assert spark.sql("SELECT string(null) s").select(text.around(F.col("s"), F.lit("a"))).first()[0] == ""
    assert one(spark, F.rlike(F.col("s"), text.glob_column(F.lit("a*.p?f"))), s="abc.pdf") and not one(spark, F.rlike(F.col("s"), text.glob_column(F.lit("a*.p?f"))), s="abcxpdf")
    assert one(spark, text.template(F.col("s"), who=F.lit("Ann")), s="{who} and {other}") == "Ann and {other}"
    assert one(spark, text.shortened(F.col("s"), 6), s="abcdefgh") == "abcde…"
    assert one(spark, text.chunk_id(F.lit("cc-"), F.col("s"), F.lit("X1234567890")), s="L. 12-3") == "cc-l12-3"
    assert one(spark, text.html_text(F.col("s")), s="<p>a &amp; b</p><br>c") == "a & b c"


def test_whole_words(spark):
    swap = text.whole_words({"Dupont": "A", "Jean Dupont": "B", "été": "C"})
    assert one(spark, swap(F.col("s")), s="M. JEAN  Dupônt, duponts, Dupont; l'Été") == "M. B, duponts, A; l'C"


MUST = [("écrire à a.b@c.fr vite", "écrire à [email] vite"), ("Tél. 40 54 44 44", "Tél. [telephone]"), ("06 12 34 56 78", "[telephone]"), ("RCS Beaumont 315 429 837", "[SIREN]"), ("ref 123 456 789.", "ref [réf.]."), ("AMF GP 07000033", "AMF [réf.]"), ("né à X (98730)", "né à X ([code postal])"), ("sous 12345678", "sous [réf.]"), ("12 rue des Lilas, Paris", "[adresse], Paris"), ("P<FRADUPONT<<JEAN", "[MRZ]"), ("dossier n° 45-25901", "dossier [réf.]")]
KEEP = ["195 572 380 €", "article 1240", "le 20260109 au soir", "ordonnance n° 45-25901", "Loi n° 2010-1615"]


@pytest.mark.parametrize(("s", "expected"), MUST)
def test_redacts(spark, s, expected):
    assert pii.redacted(s) == one(spark, pii.redact(F.col("s")), s=s) == expected
    assert pii.redacted(expected) == expected and pii.leaks(expected) == [] and pii.leaks(s)


@pytest.mark.parametrize("s", KEEP)
def test_keeps(spark, s):
    assert pii.redacted(s) == one(spark, pii.redact(F.col("s")), s=s) == s and pii.leaks(s) == []


def test_scalars(spark):
    assert one(spark, scalars.epoch_ms_date(F.col("n")), n=-5231606400000) == "1804-03-21" and one(spark, scalars.epoch_ms_date(F.col("n")), n=0) == ""
    assert one(spark, scalars.weaker(F.col("a"), F.col("b")), a="T2", b="T4") == "T4"
    assert one(spark, scalars.unfenced(F.col("s")), s="```json\n{}\n```") == "{}" and one(spark, scalars.unfenced(F.col("s")), s="a `b`") == "a `b`"
    assert one(spark, scalars.iso_date(F.col("s")).cast("string"), s="2026") is None
    assert scalars.complete_objects('[{"a": "}"}, {"b": {"c": 1}}, {"d": "cut') == ['{"a": "}"}', '{"b": {"c": 1}}']
    assert scalars.complete_objects('[{"a": 1,}, {"b": {"c": 2}}]') == ['{"b": {"c": 2}}'] and scalars.complete_objects('{"x": [{"a": 1}, {"b": "}') == ['{"a": 1}'] and scalars.complete_objects('{"a": {"b": 1},}') == ['{"b": 1}']
    assert scalars.leading_json('{"a": 1} and prose') == '{"a": 1}' and scalars.leading_json("prose") is None
    assert [scalars.letters(n) for n in (1, 26, 27, 703)] == ["a", "z", "aa", "aaa"]
    assert one(spark, scalars.fingerprint(F.col("s"), F.lit("m")), s=["b", "a", "b"]) == one(spark, scalars.fingerprint(F.col("s"), F.lit("m")), s=["a", "b"])
    with pytest.raises(Exception, match="unknown label"):
        one(spark, scalars.validated_label(F.col("s"), "label", ["x"]), s='{"label": "y"}')


def test_unknown_model_raises(spark):
    usage = spark.createDataFrame([("m", 1_000_000, 0), ("x", 1, 1)], "model string, prompt_tokens long, completion_tokens long")
    rates = spark.createDataFrame([("m", 2.0, 4.0)], "model string, rate_in double, rate_out double")
    assert scalars.costed(usage.filter("model = 'm'"), rates).first().cost_usd == 2.0
    with pytest.raises(Exception, match="no rate for model x"):
        scalars.costed(usage, rates).collect()


def test_fold_is_the_same_in_the_jvm_and_in_python(spark):
    from casebench.functions import lexicon

    odd = ["", "ÀÉÎ Ÿ ça\t\n d’ici `x ‘y ʼz", "Straße ẞ Œuvre Ærø", "½ ﬁn … nbsp x é", "\x1c a\x1fb\x7f", "漢字 🙂 İstanbul", "  «deux»  — 5 €  ", "a\u0085b c", "É" * 5000 + " x", "\x0b\x0c \r\n"]
    got = spark.createDataFrame([(i, s) for i, s in enumerate(odd)] + [(99, None)], "i int, s string").select("i", lexicon.fold(F.col("s")).alias("f"))
    assert {r.i: r.f for r in got.collect()} == {**{i: lexicon.folded(s) for i, s in enumerate(odd)}, 99: ""}
