"""The pipeline's stages: columns, what goes and what stays, odd tables."""

import tiktoken
import public_tokenizers

import corpus_pipeline as pipeline
from knownat.llm import queries
from tests_llm_odd import DOCS, ODD


#: Names that stages use inside.
CLASHING = ("_id", "_score", "_rate", "_row", "_toxic", "_text", "class_id", "lang_pred", "ambiguous", "rate")


def planted(spark, folder):
    """Clean, toxic, copied and letterless documents, with labels for some."""
    clean = [f"w{i} " + " ".join(f"word{(i * 31 + k * 7) % 997}" for k in range(60)) for i in range(60)]
    toxic = [t + " idiot moron idiot scum" for t in clean[:20]]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(clean + toxic)]
    rows += [(200, clean[30], "en", "s", 1), (201, clean[31] + " tail", "en", "s", 1), (202, "12 34 !!", "en", "s", 8), (203, None, None, "s", None), (204, "", "en", "s", 0)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, int(i >= 60)) for i in range(78)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def test_planted_cases(spark, tmp_path):
    folder = str(tmp_path)
    planted(spark, folder)
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in pipeline.STAGES[:-1]:
        new = pipeline.stored(stage(spark, docs, folder), name)
        assert new.columns == docs.columns
        kept[name] = {r["doc_id"] for r in new.collect()}
        docs = new
    assert kept["toxicity"] == set(range(60)) | set(range(200, 205))
    assert kept["language_id"] == set(range(60)) | {200, 201}
    assert kept["near_duplicates"] == set(range(60))
    assert kept["mixing"] <= kept["near_duplicates"] and len(kept["mixing"]) > 50
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=queries.ranks(), special_tokens={})
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in pipeline.run(spark, folder).collect():
        assert r["ids"] == encoding.encode_ordinary(texts[r["doc_id"]])


def test_odd_and_empty_tables(spark, tmp_path):
    odd = spark.createDataFrame(ODD, DOCS)
    labels = spark.createDataFrame([(1, 1, 0), (6, 0, 1), (None, None, None)], "doc_id bigint, quality int, toxic int")
    for number, (docs, marks) in enumerate([(odd, labels), (odd.limit(0), labels.limit(0)), (odd, labels.limit(0))]):
        folder = f"{tmp_path}/{number}"
        docs.write.parquet(f"{folder}/documents.parquet")
        marks.write.parquet(f"{folder}/labels.parquet")
        for name, stage in pipeline.STAGES:
            rows = stage(spark, docs.selectExpr("*", "1 AS score", "'x' AS ids", *[f"2 AS {c}" for c in CLASHING]), folder)
            assert rows.count() <= docs.count()
            assert name == "byte_bpe" or rows.columns == [*docs.columns, "score", "ids", *CLASHING]
