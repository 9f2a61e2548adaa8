import corpus_pipeline as cp
from tests.llm.fixtures import documents, none


def staged(spark, docs, tmp_path):
    out = [docs]
    for name, stage in cp.STAGES:
        stage(spark, out[-1], "").write.parquet(str(tmp_path / name))
        out.append(spark.read.parquet(str(tmp_path / name)))
    return out


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    given, lang, near, clean, mixed, packed = staged(spark, docs, tmp_path)
    for df in (lang, near, clean, mixed):
        assert df.columns == docs.columns
    assert lang.count() >= 0.98 * docs.count()
    texts = [r.text for r in near.collect()]
    assert len(texts) == len(set(texts)) and near.count() <= lang.select("text").distinct().count()
    assert near.select("doc_id").subtract(lang.select("doc_id")).isEmpty()
    assert clean.count() == near.count() and not any("token = \"" in (r.text or "") for r in clean.collect())
    assert mixed.select("doc_id").subtract(clean.select("doc_id")).isEmpty()
    assert max(r["count"] for r in mixed.groupBy("doc_id").count().collect()) <= 2
    assert packed.count() == mixed.count()
    assert cp.run(spark, sf).count() == packed.count()


def test_odd_rows(spark, tmp_path):
    given, lang, near, clean, mixed, packed = staged(spark, documents(spark), tmp_path)
    assert {r.doc_id for r in lang.collect()}.isdisjoint({5, 6, 7, 9}) and lang.count() == 10
    assert {r.doc_id for r in near.collect()} == {1, 3, 8, 10, 11, None} and near.count() == 6
    assert clean.count() == 6 and packed.count() == mixed.count() > 0
    assert clean.columns == documents(spark).columns


def test_empty(spark, tmp_path):
    assert [df.count() for df in staged(spark, none(spark), tmp_path)] == [0] * 6
