import pytest

from casebench.llm import quality
from tests.llm.fixtures import documents, none, rows


def test_same_as_sql(spark, sf, duck):
    df = quality.op1_quality_rules(spark, sf)
    names = sorted(df.columns)
    want = sorted(tuple(r) for r in duck(sf).execute(f"SELECT {', '.join(names)} FROM ({quality.ORACLE})").fetchall())
    assert rows(df, *names) == want


def test_repeat_words_by_brute_force():
    cases = [b"", b"a b", b"a b c", b"a b c a b c", b"x x x x x", b"a b c d a b c e a b", b"one two three four one two three"]
    words = [c.split() for c in cases]

    def brute(w):
        g = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        return len({i + k for i, x in enumerate(g) if g.count(x) > 1 for k in range(3)})

    assert quality.repeat_words(words).tolist() == [brute(w) for w in words]


def test_odd_rows(spark):
    got = {r[0]: r for r in quality.quality_rules(documents(spark)).collect() if r[0] is not None}
    assert len(rows(quality.quality_rules(documents(spark)))) == 14
    assert got[5].n_words == 0 and got[5].base_failed and not got[5].kept
    assert got[6].word_chars == 0 and got[9].n_symbols == 6
    assert got[8].n_words == 24000 and got[8].n_repeat_words == 24000
    assert quality.quality_rules(none(spark)).count() == 0


def test_cascade_order_and_short_circuit():
    seen = {"cheap": 0, "dear": 0}

    def rule(name, bad):
        def rejects(text):
            seen[name] += 1
            return bad in text

        return quality.Rule(name, rejects)

    ticks = iter([0, 10, 10, 11])
    order = quality.ordered((rule("dear", b"x"), rule("cheap", b"x")), [b"x", b"y"], lambda: next(ticks))
    assert [r.name for r, _, _ in order] == ["cheap", "dear"]
    seen.update(cheap=0, dear=0)
    assert quality.cascade([r for r, _, _ in order], [b"x", b"y", b"xx"]) == ["cheap", None, "cheap"]
    assert seen == {"cheap": 3, "dear": 1}


@pytest.mark.parametrize(("text", "name"), [(b"SHOUTING ALL THE TIME ok", "shouts"), (b"### a $$$ b", "symbol_heavy"), (b"1234 5678 90 ab", "digit_heavy"), (b"a b c d", "odd_words"), (b"one two\none two\none two", "repeats_lines")])
def test_rules(text, name):
    assert [r.name for r in quality.RULES if r.rejects(text)] == [name]
