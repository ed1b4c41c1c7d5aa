"""Rows that large groups make: in proportion to the group, not to its square."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rasterlake.llm import components, jaccard_join
from rasterlake.llm.jaccard_join import candidate_links, jaccard_components, nodes, verified_links
from rasterlake.llm.suffix_dedup import SuffixRepeats
from rasterlake.plans.tables import checkpointed


def near_copies(spark, n, parts):
    rng = random.Random(11)
    base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    rows = []
    for i in range(n):
        words = list(base)
        for k in rng.sample(range(300), 3):
            words[k] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)


def test_links_of_near_copies_are_few(spark):
    """A task's own near copies are a link each, and one of them stands for all in the other tasks."""
    docs = checkpointed(near_copies(spark, 240, 6))
    links = candidate_links(docs, 5, 80).distinct().collect()
    assert len(links) < 240 * 2
    part = {x: x for r in links for x in r}

    def root(x):
        while part[x] != x:
            x = part[x]
        return x

    for a, b in links:
        part[root(a)] = root(b)
    assert len(part) == 240 and len({root(x) for x in part}) == 1


def test_keys_in_passes(spark, monkeypatch):
    """Texts are read once for the slices' keys as long as these keep to the shingles' bytes; in more passes, links join the same sets."""
    docs = checkpointed(near_copies(spark, 60, 3))
    written, made = jaccard_join.written, []
    monkeypatch.setattr(jaccard_join, "written", lambda df, name: made.append(name) or written(df, name))
    once = jaccard_components(docs, 5, 80).collect()
    assert made.count("candidates") == 1
    made.clear()
    monkeypatch.setattr(jaccard_join, "LEAST_DISK", 0)
    assert sorted(jaccard_components(docs, 5, 80).collect()) == sorted(once)
    assert made.count("candidates") == 2


def test_large_clusters_are_cut(spark, monkeypatch):
    """Passages that were not common among all texts chain sets into one cluster; it is cut before its pairs are multiplied,
    and no link is lost."""
    rng = random.Random(17)
    text = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passages = [text(24) for _ in range(2)]
    sets = []
    for i in range(240):
        own = text(70)
        at = rng.randrange(70)
        sets.append(own[:at] + passages[i % 2] + own[at:])
        if i % 8 == 0:
            sets.append([*sets[-1][:-1], "other"])
    docs = checkpointed(spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(sets)], "doc_id long, text string").repartition(3))
    common, verified, largest = jaccard_join.common_shingles, jaccard_join.verified_links, []
    # as if all texts were so many that the passages are rare among them
    monkeypatch.setattr(jaccard_join, "common_shingles", lambda d, n, **k: common(d, n, **k) if k else common(d, n)[:0])
    monkeypatch.setattr(jaccard_join, "verified_links", lambda d, m, *a, **k: largest.append(m.groupBy("root").count().agg(F.max("count")).first()[0]) or verified(d, m, *a, **k))
    monkeypatch.setattr(jaccard_join, "LARGE", 32, raising=False)
    got = {r["doc_id"]: r["component_id"] for r in jaccard_components(docs, 5, 80).collect()}
    want = {i: i - 1 if x[-1] == "other" else i for i, x in enumerate(sets)}
    assert got == want
    assert largest[0] <= 32


def test_near_copies_are_not_common_if_varied(spark):
    """Edited copies of a text have different shingles here and there; those of a passage, everywhere."""
    rng = random.Random(19)
    text = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    passage = text(30)
    rows = [(i, f"{text(60)} {passage} {text(60)}") for i in range(20)]
    docs = near_copies(spark, 60, 1).union(spark.createDataFrame(rows, "doc_id long, text string")).coalesce(1)
    at = lambda t: set(next(jaccard_join.Shingler(5).sets(pa.array([t]))) >> jaccard_join.PREFIX)
    upper = lambda **k: set(jaccard_join.common_shingles(docs, 5, least=2, **k) >> jaccard_join.PREFIX)
    assert upper(varied=True) & at(passage) and upper(varied=True) <= at(passage) < upper() | at(passage)


def test_common_shingles(spark):
    """A passage in many surroundings is common by the upper 48 bits of its shingles; copies of a text are not."""
    rng = random.Random(13)
    text = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    passage, copy = text(12), text(60)
    docs = spark.createDataFrame([(i, f"{text(20)} {passage} {text(30)}") for i in range(40)] + [(100 + i, copy) for i in range(40)], "doc_id long, text string").coalesce(1)
    found = jaccard_join.common_shingles(docs, 3)
    upper = lambda t: {int(x) >> 16 << 16 for x in next(jaccard_join.Shingler(3).sequences(pa.array([t])))}
    assert {int(x) for x in found} == upper(passage)


def test_blocks_in_passes(spark):
    """However few bytes a pass may take, the links join the same sets."""
    docs = checkpointed(near_copies(spark, 60, 3))
    members = checkpointed(nodes(docs, 5, 80).select(F.col("doc_id").alias("owner"), "node", F.lit(1).cast("long").alias("root"), "class"))
    joined = []
    for disk in (1 << 40, 20000):
        links = verified_links(docs, members, 5, 80, least_block=16, disk=disk).collect()
        part = {r["node"]: {r["node"]} for r in members.collect()}
        for a, b in links:
            if part[a] is not part[b]:
                part[a] |= part[b]
                for x in part[b]:
                    part[x] = part[a]
        joined.append(sorted(sorted(x) for x in {id(x): x for x in part.values()}.values()))
    assert joined[0] == joined[1] and len(joined[0]) < 60


def test_a_pass_makes_rows_for_its_own_pairs(spark, monkeypatch):
    """All passes together make as many rows as one does: none makes the others' and throws them away."""
    docs = checkpointed(near_copies(spark, 60, 3))
    members = checkpointed(nodes(docs, 5, 80).select(F.col("doc_id").alias("owner"), "node", F.lit(1).cast("long").alias("root"), "class"))
    written, parts = jaccard_join.written, []
    monkeypatch.setattr(jaccard_join, "written", lambda df, name: (parts.append(df) if name == "verified" else None) or written(df, name))
    monkeypatch.setattr(jaccard_join, "discard", lambda df: None)

    def generated(plan):
        own = plan.metrics().apply("numOutputRows").value() if plan.nodeName() == "Generate" else 0
        return own + sum(generated(plan.children().apply(k)) for k in range(plan.children().size()))

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        made = []
        for disk in (1 << 40, 20000):
            parts.clear()
            links = verified_links(docs, members, 5, 80, least_block=16, disk=disk)
            for df in parts or [links]:
                df.collect()
            made.append(sum(generated(df._jdf.queryExecution().executedPlan()) for df in parts or [links]))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(parts) > 3 and made[0] == made[1] > 60


def test_components_of_near_copies(spark):
    assert {r["component_id"] for r in jaccard_components(near_copies(spark, 50, 3), 5, 80).collect()} == {0}


def test_a_place_meets_one_row_of_its_context(spark):
    """A passage of 300 bytes in other surroundings has 101 windows, which are dealt one by one; a place gets runs, not windows."""
    rng = random.Random(12)
    text = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    passage = text(300)
    docs = spark.createDataFrame([(i, text(400) + passage + text(400)) for i in range(12)], "doc_id long, text string")
    _, spans = SuffixRepeats(200, 64, crowd=1).spans(docs)
    for r in spans.collect():
        covered = {p for s in r["spans"] for p in range(s["first"], s["end"])}
        assert len(r["spans"]) <= 20 and {*range(400, 700)} <= covered


@pytest.mark.parametrize("held", [0, 1 << 20])
def test_few_links_take_no_rounds(spark, held, monkeypatch):
    """A long way, a crowd around its largest id, loops and repeated links: the same with and without rounds, which few links don't take."""
    rng = random.Random(13)
    ids = [rng.randrange(-(1 << 62), 1 << 62) for _ in range(400)]
    links = [*zip(ids[:150], ids[1:151]), *((max(ids), x) for x in ids[200:300]), *((x, x) for x in ids[150:310]), *((ids[300 + k], ids[301 + k]) for k in range(0, 80, 4) for _ in range(3))]
    parent = {x: x for x in ids}
    for _ in ids:
        for a, b in links:
            parent[a] = parent[b] = min(parent[a], parent[b])
    want = {x: parent[x] for a, b in links for x in (a, b) if a != b}
    tables = []
    monkeypatch.setattr(components, "written", lambda df, name, f=components.written: tables.append(name) or f(df, name))
    found = components.components(spark.createDataFrame(links, "a long, b long").repartition(7), **({} if held else {"held": 0})).collect()
    assert len(found) == len(want) and {r["node"]: r["root"] for r in found} == want
    assert len(tables) <= 2 if held else len(tables) > 5
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []
