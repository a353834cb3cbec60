import corpus_pipeline
from graphloom.llm import bpe, decontam, exact, minhash, quality
from graphloom.llm.queries import tokenizer_path

from . import test_decontam, test_exact, test_minhash
from .helpers import ODD, clashing, documents, table

SF = "/root/testdata/sf0.001"


def ids(df):
    return sorted([r.doc_id for r in df.collect()], key=str)


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = dict(documents(spark))
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        rows = [(i, text[i]) for i in ids(docs)]
        out = stage(spark, docs, SF)
        if name == "quality":
            model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
            want = [r.doc_id for r in quality.score(docs, model).where("kept").collect()]
        elif name == "exact_dedup":
            want = [i for i, _, _, kept, _ in test_exact.brute(rows) if kept]
        elif name == "near_dedup":
            want = [i for i, _, _, kept in test_minhash.brute(rows) if kept]
        elif name == "decontamination":
            want = [i for i, hit in test_decontam.brute(rows, items) if not hit]
        else:
            want = [i for i, _ in rows]
        assert ids(out) == sorted(want, key=str), name
        if name != "bpe":
            assert out.columns == docs.columns
            assert len(want) < len(rows) or name != "exact_dedup"
        docs = out
    assert ids(corpus_pipeline.run(spark, SF)) == ids(docs)
    one = bpe.WordBpe(open(tokenizer_path(), encoding="utf-8").read())
    for r in docs.limit(20).collect():
        assert r.token_ids == one.ids(text[r.doc_id]) and r.n_tokens == len(r.token_ids)


def test_selections_keep_columns_and_odd_rows(spark):
    df = clashing(table(spark, ODD))
    bench = spark.createDataFrame([(1, "nothing of this is in there")], "item_id long, text string")
    kept = [(i, h) for i, _, _, stays, h in test_exact.brute(ODD) if stays]
    out = exact.select(df)
    assert out.columns == df.columns and ids(out) == sorted([i for i, _ in kept], key=str)
    assert minhash.select(df).columns == df.columns and decontam.clean(df, bench).count() == len(ODD)
    lost = {i for i, _, _, stays in test_minhash.brute(ODD) if not stays}
    assert ids(minhash.select(df)) == sorted([i for i, _ in ODD if i not in lost], key=str)
    encoded = bpe.encode(df, tokenizer_path()).collect()
    one = bpe.WordBpe(open(tokenizer_path(), encoding="utf-8").read())
    assert sorted([(r.doc_id, r.token_ids) for r in encoded], key=str) == sorted([(i, one.ids(t or "")) for i, t in ODD], key=str)
    empty = table(spark, [])
    assert exact.select(empty).count() == minhash.select(empty).count() == decontam.clean(empty, bench).count() == 0


def folder(spark, path, rows, items=(), labels=()):
    clashing(table(spark, rows)).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(items), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_run_on_odd_rows(spark, tmp_path):
    """Without labels all documents are kept; copies, near copies and passages go, whatever the ids."""
    sf = folder(spark, tmp_path / "odd", ODD, [(1, "one"), (None, "x"), (2, None)])
    out = corpus_pipeline.run(spark, sf)
    kept = [(i, t or "") for i, t in ODD]
    kept = [(i, t) for (i, t), (j, _, _, stays, _) in zip(sorted(kept, key=str), sorted(test_exact.brute(kept), key=str), strict=True) if stays and i == j]
    lost = {i for i, _, _, stays in test_minhash.brute(kept) if not stays}
    kept = [(i, t) for i, t in kept if i not in lost]
    kept = [x for x, (_, hit) in zip(sorted(kept, key=str), test_decontam.brute(sorted(kept, key=str), [(1, "one")]), strict=True) if not hit]
    assert ids(out) == sorted([i for i, _ in kept], key=str)


def test_run_on_empty_tables(spark, tmp_path):
    out = corpus_pipeline.run(spark, folder(spark, tmp_path / "empty", []))
    assert out.count() == 0 and "n_tokens" in out.columns
