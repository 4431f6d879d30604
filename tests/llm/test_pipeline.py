import corpus_pipeline
import public_tokenizers as P
import tiktoken
from driftlens.llm import bpe, decontam, neardup, toxicity
from driftlens.llm.common import table, written


def test_stages_take_effect_in_order(spark):
    d = "/root/testdata/sf0.001"
    docs = table(spark, d, "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    bad = {r.doc_id for r in toxicity.toxicity_scores(docs, toxicity.fit(docs, table(spark, d, "labels"))).where("predicted = 1").collect()}
    left = written(docs.where(~docs.doc_id.isin(*bad)) if bad else docs)
    kept = {r.doc_id for r in neardup.near_duplicates(left).where("kept").collect()}
    left = written(left.where(left.doc_id.isin(*kept)))
    leaks = {r.doc_id for r in decontam.contaminated(left, table(spark, d, "benchmark")).collect()}
    want = kept - leaks
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    rows = corpus_pipeline.run(spark, d).collect()
    assert {r.doc_id for r in rows} == want and len(rows) == len(want) < len(texts)
    for r in rows:
        assert r.token_ids == own.encode_ordinary(texts[r.doc_id]) and r.n_tokens == len(r.token_ids)


def test_stages_keep_columns(spark, odd, tmp_path):
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = odd
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == odd.columns
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 12
