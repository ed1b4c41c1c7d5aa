"""Each stage on its own input, and the whole, against brute force."""

import math
import re
from collections import Counter

import corpus_pipeline as P
from rasterlake.llm.common import BATCH
from tests.llm.test_dedup import brute_components
from tests.llm.test_scans import brute_mix, brute_tokens, xx


def rows(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_stages_one_after_the_other(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in P.STAGES[:-1]:
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{name}")
        made = spark.read.parquet(f"{tmp_path}/{name}")
        assert made.columns == columns
        kept[name] = (rows(docs), rows(made))
        docs = made
    before, after = kept["language_id"]
    lost = set(before) - set(after)
    assert set(after) <= set(before) and sum(bool(re.search(r"[^\W\d_]", t or "")) for _, t in lost) <= 0.01 * len(before)
    before, after = kept["near_copies"]
    assert sorted(i for i, _ in after) == sorted({c for _, _, c in brute_components([(i, t or "") for i, t in before], 5, 80)})
    items = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    before, after = kept["benchmark_leaks"]
    assert sorted(after) == sorted(r for r in before if not any(t in r[1] for t in items))
    before, after = kept["source_mix"]
    part = [(r["doc_id"], r["source"], r["text"]) for r in spark.read.parquet(f"{tmp_path}/benchmark_leaks").collect()]
    want = {i: math.floor(taken / max(1, size) + 0.5) for i, _, size, _, _, taken, _ in brute_mix(part, 1 << 20)}
    ids = [i for i, _ in after]
    assert {i: ids.count(i) for i in set(ids)} == {i: n for i, n in want.items() if n}
    got = sorted((tuple(r) for r in P.STAGES[-1][1](spark, docs, sf).collect()), key=lambda r: r[1])
    seen, order = Counter(), []
    for i, t in after:
        seen[i, t] += 1
        order.append((xx(i, xx(t), seen[i, t]), i, t))
    assert got == brute_tokens([(i, t) for _, i, t in sorted(order)], ordered=True)
    assert sorted((tuple(r) for r in P.run(spark, sf).collect()), key=lambda r: r[1]) == got


def test_stages_on_empty_and_odd_tables(spark, odd, none, tmp_path):
    sf = "/root/testdata/sf0.001"
    for k, docs in enumerate((none, odd)):
        for name, stage in P.STAGES:
            made = stage(spark, docs, sf)
            made.write.parquet(f"{tmp_path}/{k}-{name}")
            docs = spark.read.schema(made.schema).parquet(f"{tmp_path}/{k}-{name}")
        assert (docs.count() == 0) == (k == 0)


def test_near_copies_of_rows_without_an_id(spark):
    import random

    rng = random.Random(4)
    said = lambda n: ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n)]
    near = lambda w: " ".join([*w[:-1], said(1)[0]])
    a, b, c, d, e = (said(100) for _ in range(5))
    texts = [(1, " ".join(a)), (None, near(a)), (None, " ".join(b)), (None, near(b)), (None, near(b)), (None, " ".join(c)), (2, " ".join(d)), (3, near(d)), (3, " ".join(e)), (3, " ".join(e)), (None, None), (None, ""), (4, "")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    groups = {" ".join(w[:99]): k for k, w in enumerate((a, b, c, d, e))}
    left = rows(P.near_copies(spark, docs, None))
    got = sorted((groups[" ".join(t.split()[:99])], i or 0) for i, t in left if t)
    assert got == [(0, 1), (1, 0), (2, 0), (3, 2), (4, 3)]
    assert [r for r in left if not r[1]].count((4, "")) == 1 and len(left) == 8


def test_stages_have_small_batches(spark, none):
    """Executors keep what batches took from stage to stage."""
    before = spark.conf.get(BATCH)
    try:
        spark.conf.set(BATCH, str(64 << 20))
        P.source_mix(spark, none.select("doc_id", "text", "lang", "source", "n_chars"), "")
        assert int(spark.conf.get(BATCH)) <= 4 << 20
    finally:
        spark.conf.set(BATCH, before)
