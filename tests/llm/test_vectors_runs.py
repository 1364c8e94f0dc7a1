"""Hard negatives, near vectors and periodic runs against brute force, on small tables with odd rows."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests_llm_odd import DOCS, ODD

from knownat.llm import hard_negatives, near_vectors, queries, runs, words

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "vec_id bigint, embedding array<double>, label int, score string, rank string"
NAN, INF = float("nan"), float("inf")
#: Nulls, repeated rows and keys, ties, zero, empty, huge and tiny vectors, other sizes.
VECTORS = [
    (100, [1.0, 0.5], 1), (100, [1.0, 0.5], 1), (100, [0.5, 1.0], 1), (101, [1.0, 0.5], 2), (102, [1.0, 0.5], 2), (103, [0.9, 0.5], 1),
    (104, None, 1), (105, [1.0, None], 1), (106, [NAN, 1.0], 1), (107, [INF, 1.0], 1), (108, [1.0, 0.5], None), (None, [1.0, 0.5], 1),
    (109, [0.0, 0.0], 1), (110, [], 1), (111, [], 2), (200, [1e200, 1e200], 1), (201, [1e200, 1.1e200], 1), (202, [1e-200, 1e-200], 1),
    (203, [1.0, 2.0, 3.0], 1), (204, [1.0, 2.0, 3.1], 2), (300, [-1.0, -0.5], 2), (301, [0.8, 0.45], 2), (302, [1.7e308, -1.7e308], 3),
]


@pytest.fixture(scope="module")
def odd_vectors(spark):
    return spark.createDataFrame([(*row, "mine", "mine") for row in VECTORS], SCHEMA)


def fine(vector):
    return vector is not None and all(x is not None and math.isfinite(x) for x in vector)


def held(score):
    return max(-(2**63 - 1), min(2**63 - 1, score))


def brute_negatives(rows, k=5):
    """Rows of (key, vector, label), with whole numbers of any size."""
    own = [(i, key, label, [int(max(-1.7976931348623157e308, min(1.7976931348623157e308, math.floor(256 * x) if abs(x) < 1e300 else 256 * x))) for x in v]) for i, (key, v, label) in enumerate(rows) if key is not None and label is not None and fine(v)]
    out = []
    for i, key, label, v in own:
        if key % 100:
            continue
        scored = [(-held(sum(a * b for a, b in zip(v, w))), other, j, l) for j, other, l, w in own if j != i and len(w) == len(v)]
        for s, positive, j, _ in sorted(x for x in scored if x[3] == label)[:k]:
            near = sorted(x for x in scored if x[3] != label and 80 * -s <= 100 * -x[0] <= 100 * -s)[:k]
            out += [(key, positive, n + 1, x[1], -s, -x[0]) for n, x in enumerate(near)]
    return sorted(out)


def plain(df):
    return sorted((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in df.collect())


def test_hard_negatives_of_odd_rows(odd_vectors):
    got = hard_negatives.mine(odd_vectors, F.col("vec_id") % 100 == 0)
    assert plain(got) == brute_negatives(VECTORS)
    assert plain(hard_negatives.mine(odd_vectors.limit(0), F.col("vec_id") % 100 == 0)) == []


def test_hard_negatives_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "ANCHORS", 8)
    source = np.random.default_rng(3)
    centres = source.standard_normal((12, 24))
    rows = [(i, (centres[i % 12] + source.standard_normal(24) * (0.2 + i % 3)).round(2).tolist(), int(source.integers(0, 4))) for i in range(900)]
    rows += rows[100:130]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").repartition(7)
    assert plain(hard_negatives.mine(df, F.col("vec_id") % 100 == 0)) == brute_negatives(rows)


def test_intervals_hold_and_rule_out():
    source = np.random.default_rng(5)
    ints = np.floor(256 * near_unit(source, 4000, 64))
    asked = ints[:50]
    low, high = hard_negatives.intervals(hard_negatives.encode(ints), hard_negatives.rounded(asked), 64)
    exact = asked @ ints.T
    assert (low <= exact).all() and (exact <= high).all()
    fifth = np.sort(exact, 1)[:, -6]
    assert (high >= fifth[:, None]).mean() < 0.25  # most are ruled out without their components


def near_unit(source, n, size):
    v = source.standard_normal((n, size))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def brute_near(rows, least=0.93):
    def usable(i):
        key, v, label = rows[i]
        return key is not None and label is not None and fine(v) and any(v)

    def scaled(v):
        top = max(abs(x) for x in v)
        return np.array(v) / 2.0 ** math.frexp(top)[1] if top > 1e-300 else np.array(v) * 1e300

    label, count = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if usable(i) and usable(j) and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = scaled(rows[i][1]), scaled(rows[j][1])
                if float((a * b).sum() / (math.sqrt((a * a).sum()) * math.sqrt((b * b).sum()))) >= least:
                    count[i], count[j] = count[i] + 1, count[j] + 1
                    x, y = sorted((find(i), find(j)))
                    label[y] = x
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    lowest = [min((k for k in groups[find(i)] if k is not None), default=None) for i in range(len(rows))]
    return sorted((repr(rows[i][0]), count[i], repr(lowest[i]), rows[i][0] == lowest[i]) for i in range(len(rows)))


def near_rows(df):
    return sorted((repr(r["vec_id"]), r["n_links"], repr(r["component_id"]), r["kept"]) for r in df.collect())


def test_near_vectors_of_odd_rows(odd_vectors):
    assert near_rows(near_vectors.near_vectors(odd_vectors)) == brute_near(VECTORS)
    assert near_vectors.near_vectors(odd_vectors.limit(0)).count() == 0


@pytest.mark.parametrize("bucket", [8192, 16])
def test_near_vectors_match_brute_force(spark, bucket):
    source = np.random.default_rng(4)
    centres = near_unit(source, 30, 16)
    rows = []
    for i in range(700):
        if i % 3 == 0:  # one group holds a third of the rows
            v = centres[0] + source.standard_normal(16) * 0.06
        else:
            v = centres[i % 30] + source.standard_normal(16) * (0.05 + 0.1 * (i % 4))
        rows.append((i, [float(x) for x in v], [None, 0, 0, 1][source.integers(0, 4)] if i % 3 else 0))
    rows += rows[:40] + rows[:3]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").repartition(5)
    assert near_rows(near_vectors.near_vectors(df, bucket=bucket)) == brute_near(rows)


def test_tables_follow_rows():
    for rows in (0, 1, 10**4, 10**6, 10**9):
        signs, tables = near_vectors.plan(rows)
        meet = (1 - math.acos(0.93) / math.pi) ** signs
        assert (1 - meet) ** tables <= near_vectors.MISS and rows / 2**signs <= near_vectors.BUCKET
    source = np.random.default_rng(8)
    a = near_unit(source, 20000, 64)
    b = source.standard_normal(a.shape)
    b -= (b * a).sum(1)[:, None] * a
    b = 0.93 * a + math.sqrt(1 - 0.93**2) * b / np.linalg.norm(b, axis=1)[:, None]
    signs, tables = near_vectors.plan(10**6)
    missed = ~(near_vectors.codes(a, signs, tables) == near_vectors.codes(b, signs, tables)).any(1)
    assert missed.mean() < 0.001


def brute_runs(found):
    """All maximal stretches with their smallest period, lag by lag."""
    n, out = len(found), {}
    for q in range(1, n // 3 + 1):
        i = q
        while i < n:
            if found[i] != found[i - q]:
                i += 1
                continue
            start = i
            while i < n and found[i] == found[i - q]:
                i += 1
            if i - start + q >= max(24, 3 * q):
                out.setdefault((start - q, i - start + q), q)  # the least period of a stretch comes first
    return sorted((s, length, q) for (s, length), q in out.items())


def hashed(found):
    import pyarrow as pa

    return words.hashes(words.split(pa.array([" ".join(found)])))


def test_runs_match_brute_force():
    source = random.Random(6)
    for case in range(1500):
        found = []
        while len(found) < source.choice([20, 60, 200, 400]):
            piece = [source.choice("abc"[: source.randrange(1, 4)]) for _ in range(source.choice([1, 2, 3, 8, 9, 16, 17, 33]))]
            inner = piece * source.choice([1, 1, 2, 3, 9]) + [source.choice("abcdefgh") for _ in range(source.choice([0, 0, 1, 5]))]
            found += inner * source.choice([1, 2, 3, 4, 5])
        assert [tuple(x) for x in runs.find(hashed(found)).tolist()] == brute_runs(found), found
    for period in (1, 7, 8, 15, 16, 17, 31, 32, 33, 64, 65, 100):  # exactly long enough, and one word short
        unit = [f"w{i}" for i in range(period)]
        length = max(24, 3 * period)
        for less in (0, 1):
            found = ["x", *(unit * 40)[: length - less], "y"]
            assert [tuple(x) for x in runs.find(hashed(found)).tolist()] == ([] if less else [(1, length, period)])
    assert runs.find(hashed(["a"] * 200000)).tolist() == [[0, 200000, 1]]


def edited_words(doc_id, text):
    found = [x for x in (text or "").encode().split()]
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    g, n = h // 10, len(found)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        found = [found[i] if i < a else found[a + (i - a) % p] for i in range(n)]
    return found


def expected(doc_id, text):
    found = edited_words(doc_id, text)
    all_runs = brute_runs(found)
    gone = {i for s, length, q in all_runs for i in range(s + q, s + length)}
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in all_runs)
    best = min(all_runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    return (
        doc_id, len(all_runs), *(best or (None, None, None)), best and 1000 * best[1] // best[2],
        hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(x for i, x in enumerate(found) if i not in gone)).hexdigest(),
    )


def test_periodic_runs_query(spark, tmp_path):
    rows = queries.op13_periodic_runs(spark, FOLDER).collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    short = {i for i, text in docs.items() if len((text or "").split()) < 1500}
    assert len(rows) == len(docs)
    assert sorted(tuple(r) for r in rows if r["doc_id"] in short) == sorted(expected(i, docs[i]) for i in short)
    long = (22, " a\x0bb " * 9000 + "end", "en", "s", 1)
    texts = [*ODD, long, *[(i, "one two three " * (i % 13) + "four " * i, "en", "s", 1) for i in range(60)]]
    spark.createDataFrame(texts, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_periodic_runs(spark, str(tmp_path)).collect()
    key = lambda r: (r[0] is None, r)
    assert sorted((tuple(r) for r in got if r["doc_id"] != 22 or r["n_runs"] == 0 or r["length"] < 9000), key=repr) == sorted((expected(i, t) for i, t, *_ in texts if len((t or "").split()) < 9000), key=repr)
    assert [r["length"] for r in got if r["length"] and r["length"] >= 9000] == [18000]


def test_find_runs_keeps_columns(spark):
    docs = spark.createDataFrame([(1, "a b " * 30, "mine"), (2, None, "mine"), (3, "", "mine"), (3, "", "mine")], "id int, text string, runs string")
    got = {r["id"]: r for r in runs.find_runs(docs.withColumn("extra", F.lit(7))).collect()}
    assert [tuple(x) for x in got[1]["runs"]] == [(0, 60, 2)] and got[1]["collapsed"] == "a b" and got[1]["extra"] == 7
    assert got[2]["runs"] == [] and got[2]["n_words"] == 0 and got[2]["collapsed"] == "" and got[2]["text"] is None
    assert runs.find_runs(docs.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_near_vectors"])
def test_vector_queries_match_brute_force(spark, name):
    rows = [(r["vec_id"], [float(x) for x in r["embedding"]], r["label"]) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()]
    if name == "op12_near_vectors":
        assert near_rows(queries.op12_near_vectors(spark, FOLDER)) == brute_near(rows)
    else:
        rows = [(i, v, (label + 1) % 10 if i % 7 == 0 else label) for i, v, label in rows]
        assert plain(queries.op11_hard_negatives(spark, FOLDER)) == brute_negatives(rows)
