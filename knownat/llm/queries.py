"""The registered queries of the numbered operators and the SQL that states them where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from knownat.llm import ann, backoff_lm, bpe, fingerprints, hard_negatives, langid, mixing, near_vectors, order_minhash, runs, sharding, token_counts, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard_documents(table(spark, folder, "documents"), shards=8)


def remainder(by: int) -> Column:
    """The crc32 of doc_id as text, modulo `by`; a null doc_id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(by))


def ranks() -> dict[bytes, int]:
    return bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@query
def op2_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    # the texts and slices end here: decoding needs the ids alone
    encoded = bpe.encode(docs, ranks()).select("doc_id", "ids", F.size("slice_ids").cast("bigint").alias("n_slices"))
    return bpe.decode(encoded, ranks()).select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        "n_slices",
    )


@query
def op3_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    docs = token_counts.sample_edits(table(spark, folder, "documents").select("doc_id", "text"))
    counted = token_counts.count_edits(docs, ranks())
    return counted.select(
        "doc_id", "n_tokens", "edited_tokens", "encoded_bytes", "edited_bytes", F.sha2(F.col("edited_text").cast("binary"), 256).alias("edited_sha256")
    )


@query
def op8_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.compare_edits(table(spark, folder, "documents"))


@query
def op9_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang", (remainder(5) == 0).alias("held_out"))
    model = langid.fit(docs.where(~F.col("held_out")))
    return langid.identify(docs.select("doc_id", "text", "held_out"), model).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


@query
def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", (remainder(4) == 2).alias("held_out"))
    labels = table(spark, folder, "labels").select("doc_id", "toxic")
    model = toxicity.fit(docs.where(~F.col("held_out")).join(labels, "doc_id"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op4_order_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return order_minhash.near_classes(table(spark, folder, "documents").select("doc_id", "text"))


#: All pairs that share a shingle of five words, and the least doc_id that can be reached over links and equal texts.
ORACLES["op4_order_minhash"] = r"""
    WITH RECURSIVE w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[ \t\n\x0b\f\r]+'), lambda x: x <> '') AS ws FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
    s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) <= 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh FROM w),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
    c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
    e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE shared >= 0.8 * (x.n + y.n - shared)
          UNION SELECT x.doc_id, y.doc_id FROM w x JOIN w y ON x.text = y.text),
    r(a, b) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
    SELECT r.a AS doc_id, min(r.b) AS class_id, max(k.copies) AS copies FROM r JOIN (SELECT doc_id, count(*) OVER (PARTITION BY text) AS copies FROM w) k ON k.doc_id = r.a GROUP BY 1"""


@query
def op6_nearest(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding")
    return ann.nearest(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5)


@query
def op10_backoff_lm(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", (remainder(7) == 2).alias("held_out"))
    return backoff_lm.score(docs)


#: Target weights of the qualities that `labels` tells apart, in expected tokens.
QUALITY_TARGETS = {"1": 0.95, "0": 0.05}


@query
def op7_soft_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    labelled = table(spark, folder, "labels").select("doc_id", F.col("quality").alias("domain"))
    rates = mixing.mix(docs, labelled, QUALITY_TARGETS)
    return rates.select("doc_id", "tokens", *[F.col("p")[i].alias(f"p_quality_{name}") for i, name in enumerate(QUALITY_TARGETS)], "rate")


@query
def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding", label.alias("label"))
    return hard_negatives.mine(vectors, F.col("vec_id") % 100 == 0, positives=5, negatives=5, least=80, most=100, scale=256.0)


#: Rows with a label and finite components only.
_VECTORS = """v AS (SELECT vec_id, label, embedding FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)"""

ORACLES["op11_hard_negatives"] = f"""
    WITH {_VECTORS},
    w AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM v),
    s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_dot_product(a.e, b.e)::BIGINT AS score
          FROM w a JOIN w b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
    p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
    n AS (SELECT p.*, s.id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id) AS place
          FROM p JOIN s ON s.anchor_id = p.anchor_id WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
    SELECT anchor_id, positive_id, place::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE place <= 5"""


@query
def op12_near_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return near_vectors.near_vectors(table(spark, folder, "embeddings").select("vec_id", "embedding", "label"), least=0.93)


ORACLES["op12_near_vectors"] = f"""
    WITH RECURSIVE {_VECTORS},
    w AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM v WHERE len(list_filter(embedding, lambda x: x <> 0)) > 0),
    l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM w a JOIN w b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
    r(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
    c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
    n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
    SELECT c.a AS vec_id, coalesce(n_links, 0) AS n_links, component_id, c.a = component_id AS kept FROM c LEFT JOIN n ON n.a = c.a"""


def repeated(docs: DataFrame) -> DataFrame:
    """(doc_id, text): every tenth text, by the crc32 of doc_id as text, repeats some of its words from one word on."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    blank = F.regexp_replace("text", r"[\x20\x09-\x0D]+", " ")
    rows = docs.select("doc_id", "text", (h % 10).alias("pick"), F.floor(h / 10).alias("g"), F.when(h % 10 == 0, F.filter(F.split(blank, " "), lambda w: w != "")).alias("w"))
    rows = rows.withColumn("n", F.size("w")).withColumn("a", F.when(F.col("n") > 0, F.expr("g % n")))
    rows = rows.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    edited = F.expr("array_join(transform(sequence(0L, n - 1L), i -> w[int(if(i < a, i, a + (i - a) % p))]), ' ')")
    return rows.select("doc_id", F.when(F.col("n") > 0, edited).otherwise(F.col("text")).alias("text"))


@query
def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = runs.find_runs(repeated(table(spark, folder, "documents").select("doc_id", "text")))
    # greatest length / period without rounding: the lengths times each other's periods
    better = F.expr("""array_sort(runs, (x, y) -> case when x.length * y.period > y.length * x.period then -1 when x.length * y.period < y.length * x.period then 1
        when x.start < y.start then -1 when x.start > y.start then 1 when x.period < y.period then -1 when x.period > y.period then 1 else 0 end)""")
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit(""))
    rows = found.withColumn("best", F.get(better, F.lit(0)))
    return rows.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
