"""Language ID, licence scans, decontamination, token files, sharding and mixing against brute force or held-out rows."""

import math
import re
import zlib
from collections import Counter, defaultdict
from difflib import SequenceMatcher

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from rasterlake.llm import queries as Q
from rasterlake.llm.decontaminate import Block, Canonical, decontaminate, find_leaks
from rasterlake.llm.language_id import Classifier, predict, train
from rasterlake.llm.license_scan import PHRASES, TEMPLATES, SuffixAutomaton, license_scan
from rasterlake.llm.mixing import mix, targets
from rasterlake.llm.sharding import descend, founded, grown, place, reweighted
from rasterlake.llm.token_files import Encoder, pack, read_token_files, token_files, unpack, vocabulary, write_token_files

SF = "/root/testdata/sf0.001"


def test_language_id_on_held_out_rows(spark):
    got = Q.op3_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(got) == 1000
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
    test = [r for r in got if r["held_out"] and r["lang"] and re.search(r"[^\W\d_]", r["text"] or "")]
    assert np.mean([r["lang"] == r["lang_pred"] for r in test]) > 0.95


def test_language_id_odd_rows(docs):
    dictionaries = train(docs.where("lang IS NOT NULL").select("text", "lang"))
    rows = predict(docs, dictionaries, ["doc_id"]).join(docs.select("doc_id", "text"), "doc_id").collect()
    for r in rows:
        if not re.search(r"[^\W\d_]", r["text"] or ""):
            assert (r["lang_pred"], r["score"], r["rejected"]) == ("und", 0.0, True)
        else:
            assert r["lang_pred"] in dictionaries
    assert predict(docs, {}, ["doc_id"]).where("lang_pred <> 'und'").count() == 0


SPEECH = {"en": "the and with that which from have this were their would about there been could other people through water little after where world every great house between again before under right might against still never".split(), "de": "der und die nicht mit sich auch werden haben einer über nach wurde zwischen durch unter schon wieder gegen immer jahre deutschen während heute leben wasser menschen welt groß haus noch niemals".split(), "fr": "les des une dans pour que qui avec sur pas plus par mais leur cette être comme tout deux aussi après même entre encore toujours jamais monde vie eau maison petite grande contre sous depuis".split()}


def spoken(lang, k, words=60):
    rng = np.random.default_rng([k, *lang.encode()])
    return " ".join(rng.choice(SPEECH[lang], words).tolist())


def right(spark, labelled, langs):
    """The share of new texts of langs that are told right and not as a tie, by what was learned from labelled."""
    dictionaries = train(spark.createDataFrame(labelled, "text string, lang string"))
    new = [(i * 100 + k, spoken(lang, 10_000 + k)) for i, lang in enumerate(langs) for k in range(20)]
    got = predict(spark.createDataFrame(new, "doc_id long, text string"), dictionaries, ["doc_id"], min_margin=0.0).collect()
    return np.mean([r["lang_pred"] == langs[r["doc_id"] // 100] and not r["rejected"] for r in got])


def test_short_labels_leave_other_languages_alone(spark):
    full = [(spoken(lang, k), lang) for lang in ("en", "de") for k in range(80)]
    digits = "word " + "7" * 900 + " word"
    assert right(spark, [*full, ("ok", "aa"), (digits, "ab")], ["en", "de"]) == 1
    # a rare label of a few hundred bytes is told, and takes no other's documents
    assert right(spark, [*full, (spoken("fr", 1), "fr")], ["en", "de", "fr"]) > 0.95
    assert sorted(train(spark.createDataFrame([*full, (digits, "ab")], "text string, lang string"))) == ["ab", "de", "en"]


def test_copies_do_not_thin_a_sample(spark):
    texts = [(spoken(lang, k), lang) for lang in ("en", "de") for k in range(150)]
    labelled = spark.createDataFrame(texts, "text string, lang string")
    copies = spark.createDataFrame([(spoken("de", 999), "de")], "text string, lang string").crossJoin(spark.range(100_000)).drop("id")
    with_copies, without = train(labelled.union(copies)), train(labelled)
    assert sorted(with_copies) == ["de", "en"] and with_copies["en"] == without["en"]
    assert all(len(d) > 64 * 250 for d in with_copies.values())


def test_every_label_is_learned(spark):
    rng = np.random.default_rng(8)
    speech = {f"l{i:02d}": ["".join(rng.choice(list("abcdefghijklmnoprstuvz"), rng.integers(3, 9))) for _ in range(40)] for i in range(70)}
    said = lambda lang, k: " ".join(np.random.default_rng([k, *lang.encode()]).choice(speech[lang], 40).tolist())
    labelled = [(said(lang, k), lang) for i, lang in enumerate(speech) for k in range(12 if i < 64 else 11)]
    dictionaries = train(spark.createDataFrame(labelled, "text string, lang string"))
    assert sorted(dictionaries) == sorted(speech)
    new = spark.createDataFrame([(i, said(lang, 99)) for i, lang in enumerate(speech)], "doc_id long, text string")
    got = predict(new, dictionaries, ["doc_id"], min_margin=0.0).collect()
    assert [r["lang_pred"] for r in sorted(got, key=lambda r: r["doc_id"])] == list(speech)
    texts = [said(lang, 99).encode() for lang in speech]
    assert Classifier(dictionaries, held=9).sizes(texts) == Classifier(dictionaries, held=99).sizes(texts)


def brute_licenses(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    hits = [(i, label) for phrase, label in PHRASES.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    at = [i for i, _ in hits]
    return len(w), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))


LICENSED = [
    "Licensed under CC BY-NC 4.0. cc-by cc,by CC BY cc by",
    "All rights reserved. all RIGHTS  reserved rights reserved All rights",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3",
    "x " * 50 + "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the software without restriction" + " y" * 20,
    "permission is hereby nothing else", "general general public license public license", None, "", "...",
]


def test_license_scan(spark, odd):
    rows = [(i, t) for i, t in enumerate(LICENSED)] + [(100 + i, r["text"]) for i, r in enumerate(odd.collect())]
    got = {r["doc_id"]: r for r in license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute_licenses(t), t
        assert 0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
    assert "cc-by-nc" in got[0]["labels"] and "mit" in got[3]["labels"] and "gpl-notice" in got[2]["labels"] and got[4]["labels"] == ""


def test_license_scan_of_single_words(spark):
    docs = spark.createDataFrame([(1, "this is gpl code"), (2, "gpl gpl code"), (3, "no such word")], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_base"], r["first_word"], r["last_word"], r["labels"]) for r in license_scan(docs, {"gpl": "g", "gpl code": "gc"}, {}).collect()}
    assert got == {1: (2, 2, 2, "g,gc"), 2: (3, 0, 1, "g,gc"), 3: (0, None, None, "")}


def changed_licences(rng):
    """Whole licence texts with words left out, changed and put in, and a wrapped file around them."""
    for label, texts in TEMPLATES.items():
        for text in texts:
            w = text.split()
            if len(w) >= 40:
                for _ in range(4):
                    out = []
                    for x in w:
                        how = rng.random()
                        out += [] if how < 0.02 else [x, "extra"] if how < 0.04 else ["CHANGED"] if how < 0.06 else [x.upper()]
                    yield label, "int main() { return 0; } " * 5 + " ".join(out) + " // the end" * 9


def test_license_texts_with_changes_are_covered(spark):
    rows = list(changed_licences(np.random.default_rng(6)))
    got = license_scan(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")).collect()
    assert np.mean([rows[r["doc_id"]][0] in r["labels"].split(",") for r in got]) >= 0.9
    other = spark.createDataFrame([(0, "use of this software is up to the reader and any person may copy the files " * 30), (1, "a copy of this list of conditions was in the binary form " * 5)], "doc_id long, text string")
    assert [r["labels"] for r in license_scan(other).collect()] == ["", ""]


def test_license_scan_of_a_long_text(spark):
    text = " ".join(TEMPLATES["mit"][0].split() * 400)
    r = license_scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    spans = [s for s in r["spans"] if s["label"] == "mit" and s["end"] - s["first"] > 100]
    assert len(spans) == 400 and all(s["cover"] == 1 for s in spans)


def test_license_scan_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in license_scan(docs).collect():
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute_licenses(texts[r["doc_id"]])


def test_matching_statistics():
    rng = np.random.default_rng(3)
    for _ in range(30):
        templates = [rng.integers(0, 3, rng.integers(1, 12)).tolist() for _ in range(3)]
        factors = {tuple(t[i:j]) for t in templates for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
        text = rng.integers(0, 3, 40).tolist()
        got = [n for _, n in SuffixAutomaton(templates).run(text)]
        assert got == [max((n for n in range(1, i + 2) if tuple(text[i + 1 - n : i + 1]) in factors), default=0) for i in range(len(text))]


def test_leaks(spark):
    item = "The train leaves Paris at 12 and travels 340 km before it reaches Lyon where 12 people board it"
    other = item.replace("12", "15").replace("340", "77").replace("Paris", "Oslo").replace("Lyon", "Bergen")
    broken = item.replace("at 12", "at 9").replace("where 12", "where 4").replace("340", "9").replace("Paris", "Rome").replace("Lyon", "Rome")
    bench = spark.createDataFrame([(1, item), (1, item), (2, None), (3, ""), (4, "three plain words"), (5, "two words")], "item_id long, text string")
    rows = [(1, "words before. " + item + " and after"), (2, "x y z " + other), (3, broken), (4, item[:40]), (5, "now three plain words here two words"), (6, None), (7, ""), (8, "a clean document of its own"), (9, (item + " ") * 3), (None, item), (1, "another row of the same id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, r["item_id"], r["kind"]) for r in find_leaks(docs, bench).collect())
    assert got == [(-1, 1, "exact"), (1, 1, "exact"), (2, 1, "reparameterised"), (5, 4, "exact"), (5, 5, "exact"), (9, 1, "exact")]
    assert sorted((r["doc_id"] or -1, r["item_id"], r["kind"]) for r in find_leaks(docs, bench, most_bits=1 << 12).collect()) == got
    assert sorted(r["doc_id"] for r in decontaminate(docs, bench).collect()) == [1, 3, 4, 6, 7, 8]
    assert find_leaks(docs, bench.limit(0)).count() == 0


def test_leaks_in_other_surroundings(spark):
    sum_ = "Maria has 12 apples in the old red basket. Maria gives 5 apples to her brother before lunch"
    other = "Tom Jones has 1,250 apples in the old red basket. Tom Jones gives 7.5 apples to her brother before lunch"
    items = [(1, "What is the capital of France?"), (2, sum_)]
    rows = [(1, "a quiz (What is the capital of France?)"), (2, "Question 5 What is the capital of France? Lyon"), (3, "- what is the capital of france"), (4, "AS GIVEN " + sum_.upper()), (5, "note that " + sum_), (6, "x y " + other), (7, "It is the capital of Spain"), (8, "This is the capital of France"), (9, "Maria has 12 apples")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"], r["item_id"], r["kind"]) for r in find_leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect())
    assert got == [(1, 1, "exact"), (2, 1, "exact"), (3, 1, "exact"), (4, 2, "exact"), (5, 2, "exact"), (6, 2, "reparameterised")]


NAMES = "Anna Bruno Clara Dmitri Elena Farid Greta Hugo Ines Jonas Karim Lena".split()
THINGS = "apples bricks coins drums eggs flags gears hats jars keys lamps mugs".split()
ACTS = "buys carries counts delivers draws earns finds gathers hides keeps loses moves".split()


def question(rng, template, numbers=None, names=None):
    """A word problem of a template, with numbers and names of its own or given ones."""
    form = np.random.default_rng(template)
    a, b = names or rng.choice(NAMES, 2, replace=False)
    number = lambda: ["%d" % rng.integers(2, 999), "%d,%03d" % (rng.integers(1, 99), rng.integers(0, 1000)), "%d.%d" % (rng.integers(1, 99), rng.integers(1, 9))][rng.integers(3)]
    x, y = numbers or (number(), number())
    one, two, thing = *form.choice(ACTS, 2, replace=False), form.choice(THINGS)
    place = " ".join(form.choice("old red small wide near far quiet empty narrow bright".split(), 3, replace=False))
    return f"{a} {one} {x} {thing} from the {place} {form.choice(['shop', 'house', 'market', 'barn'])} on {form.choice(['monday', 'friday', 'sunday'])} while {b} {two} {y} km away. How many {thing} does {a} have when {b} returns after {x} days?"


def test_leaks_with_other_parameters(spark):
    rng = np.random.default_rng(4)
    items = [(i, question(rng, i)) for i in range(40)]
    filler = lambda: " ".join(rng.choice("some words of a text that go on and on without end or aim".split(), 40))
    rows = [(i, f"{filler()}. {question(rng, i)} {filler()}") for i in range(40)]
    # other templates, of which some differ in a word or two only
    form = lambda k: plain(question(None, k, ("7", "8"), ("X", "Y")))
    alike = lambda i, j: sum(x != y for x, y in zip(form(i), form(j))) <= 0.1 * len(form(i))
    rows += [(100 + i, f"{filler()}. {question(rng, 1000 + i)} {filler()}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in find_leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    right = {(i, i) for i in range(40)}
    assert len(got & right) >= 0.9 * len(right)
    assert all(alike(i, d if d < 100 else 900 + d) for d, i in got - right) and len(got - right) < 5


def test_number_words_and_groups(spark):
    item = "the van drives 60 km to the coast and then 1000 metres along the beach before noon"
    rows = [(1, item.replace("60", "62.5")), (2, item.replace("1000", "2,500")), (3, item.replace("60", "twenty five")), (4, item.replace("the coast and then", "a lake but never"))]
    got = find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert sorted((r["doc_id"], r["kind"]) for r in got) == [(1, "reparameterised"), (2, "reparameterised"), (3, "reparameterised")]


def plain(text):
    return re.findall(r"[0-9a-z\u0080-\U0010ffff]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def test_leaks_of_documents(docs, spark):
    """Every verbatim item is found, and what is found shares an item's words: at least 0.7 of them, in order."""
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = {r["item_id"]: r["text"] for r in bench.collect()}
    texts = defaultdict(list)
    for d in docs.select("doc_id", "text").collect():
        texts[d["doc_id"]].append(d["text"] or "")
    want = {(d, i) for d, some in texts.items() for text in some for i, t in items.items() if t in text}
    rows = find_leaks(docs, bench).collect()
    assert want <= {(r["doc_id"], r["item_id"]) for r in rows}
    for r in rows:
        own = plain(items[r["item_id"]])
        shared = max(sum(m.size for m in SequenceMatcher(None, own, plain(t)[r["first_word"] : r["end_word"]], autojunk=False).get_matching_blocks()) for t in texts[r["doc_id"]])
        assert shared >= 0.7 * len(own)


def test_windows_bound_never_loses_a_leak(spark):
    """What the join asks of a pair is never more than what the alignment accepts: items with words changed and put in."""
    rng = np.random.default_rng(9)
    say = lambda n: " ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(n))
    canon, items, rows = Canonical(), [(i, say(int(rng.integers(1, 40)))) for i in range(60)], []
    for i, text in items:
        for k in range(6):
            w = text.split()
            for _ in range(k):
                at = int(rng.integers(0, len(w)))
                w[at : at + int(rng.integers(0, 2))] = [say(1)]
            rows.append((len(rows), f"{say(3)} {' '.join(w)} {say(3)}"))
    want = set()
    for d, text in rows:
        raw = np.frombuffer(text.encode(), np.uint8)
        for i, item in items:
            for x in Block(canon, [(i, item.encode())], 5).leaks(raw, np.array([0, len(raw)]), 0.8):
                want.add((d, x[1]))
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in find_leaks(docs, bench).collect()} == want and len(want) > 100


def test_code_of_token_files():
    rng = np.random.default_rng(2)
    for n in (0, 1, 3, 4, 5, 1000):
        ranks = (rng.integers(0, 1 << 32, n, dtype=np.uint64) >> rng.integers(0, 32, n, dtype=np.uint64)).astype(np.uint32)
        assert (unpack(*pack(ranks), n) == ranks).all()


def brute_tokens(rows, name="word_bpe_49k.json", end=2, ordered=False):
    from tokenizers import Tokenizer

    t, start, out = Tokenizer.from_file(vocabulary(name)), 0, []
    for i, text in rows if ordered else sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, end], "<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_token_files(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = [tuple(r) for r in token_files(docs, vocabulary("word_bpe_49k.json")).collect()]
    assert sorted(got, key=lambda r: r[1]) == brute_tokens(rows)


def test_tokens_of_another_tokenizer(spark, small):
    texts = ["a b  c　d", "Don't I'LL <|endoftext|>X", "\t\ttab\r\nline", "日本語 テスト 🙂🙂  🙂", None, "", " x."]
    docs = small.select("doc_id", "text").limit(60).union(spark.createDataFrame([(10**9 + i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = [tuple(r) for r in token_files(spark.createDataFrame(rows, "doc_id long, text string"), vocabulary("byte_bpe_50k.json"), 50256).collect()]
    assert sorted(got, key=lambda r: r[1]) == brute_tokens(rows, "byte_bpe_50k.json", 50256)
    assert Encoder(vocabulary("word_bpe_49k.json")).cut and not Encoder(vocabulary("byte_bpe_50k.json")).cut


def test_pieces_encode_as_whole_texts(spark):
    texts = ["a b c　d", "é ́x don't I'll <|endoftext|>x <|startoftext|> İΣΣ Σ.", "\t\ttab\r\nline\x0b\x0c\x85next z", "日本語 テスト 🙂🙂  🙂", "a" * 3000, "\x00\x01 b", " ", "\n\n", "1234 5,6 __x__ ǅ ﬁ"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [tuple(r) for r in token_files(docs, vocabulary("word_bpe_49k.json")).collect()]
    assert sorted(got, key=lambda r: r[1]) == brute_tokens(list(enumerate(texts)))


def test_token_blocks_and_forgetting(spark, small):
    path = vocabulary("word_bpe_49k.json")
    blocks, ranked = write_token_files(small, path, 2, block_ids=2000)
    assert blocks.count() > 8
    want = sorted(tuple(r) for r in token_files(small, path).collect())
    assert sorted(tuple(r) for r in read_token_files(blocks, ranked).collect()) == want
    forgetful, data = Encoder(path, most=10), np.frombuffer(b"one two three four five six seven eight nine ten eleven one two", np.uint8)
    a = forgetful.encode(data, np.array([0, len(data)]))
    b = Encoder(path).encode(data, np.array([0, len(data)]))
    assert (a[0] == b[0]).all() and forgetful.known == 11
    again = forgetful.encode(data, np.array([0, len(data)]))
    assert (a[0] == again[0]).all() and forgetful.known == 11


def test_sharding(docs):
    tree = founded(2, 4, 5)
    rows = place(docs, tree, grown(tree), parts=5).collect()
    texts = Counter((r["doc_id"], len((r["text"] or "").encode()) + 16, zlib.crc32((r["text"] or "").encode())) for r in docs.select("doc_id", "text").collect())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == texts
    slots, shards = defaultdict(list), defaultdict(set)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        shards[r["doc_id"]].add((r["shard"], r["grown_shard"]))
        assert r["grown_shard"] in (r["shard"], 40) and r["law"] == "key" and 0 <= r["shard"] < 40
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in shards.values())


def test_sharding_of_equal_rows(spark):
    rows = [(None, "same")] * 500 + [(None, f"other {k}") for k in range(50)] + [(7, None)] * 20
    tree = founded(2, 2, 2)
    got = place(spark.createDataFrame(rows, "doc_id long, text string"), tree, grown(tree), parts=3).collect()
    assert len(got) == len(rows) and len({(r["shard"], r["slot"]) for r in got}) == len(rows)
    assert len({r["shard"] for r in got if r["doc_id"] is None}) == 1


def drawn(key, tree):
    """The descent, by another implementation of the hash."""
    path, node = "", tree
    while node.children:
        draws = {}
        for c in node.children:
            # xxhash64 of a long and then of a string, as Spark chains them: the first hash seeds the second
            h = xxhash.xxh64_intdigest(f"{path}/{c.name}".encode(), xxhash.xxh64_intdigest(key.to_bytes(8, "little", signed=True), 42))
            draws[c] = -math.log(((h >> 11) + 0.5) / 2**53) / c.weight
        node = min(draws, key=draws.get)
        path = f"{path}/{node.name}"
    return node.name


def test_descent_by_independent_draws(spark):
    tree = reweighted(reweighted(grown(founded(3, 2, 4), 2.5), (1,), 3.0), (0, 1, 6), 0.25)
    for r in spark.range(-50, 400).select("id", descend(F.col("id"), tree).alias("s")).collect():
        assert r["s"] == drawn(r["id"], tree)


def test_tree_moves_only_what_it_must(spark):
    ids, base = spark.range(40000), founded(2, 4, 5)
    trees = {"n40": base, "n41": grown(base), "n42": grown(grown(base)), "shard": reweighted(base, (0, 1, 7), 2.0), "rack": reweighted(base, (1, 2), 10.0), "region": reweighted(base, (0,), 40.0), "gone": reweighted(base, (0, 1, 7), 0.0)}
    rows = ids.select("id", *[descend(F.col("id"), t).alias(n) for n, t in trees.items()]).collect()
    rack, region = (lambda s: s // 5), (lambda s: s // 20)
    for r in rows:
        s = r["n40"]
        assert r["n41"] in (s, 40) and r["n42"] in (r["n41"], 41)
        # a shard's weight moves rows within its rack, a rack's within its region, a region's between regions only
        assert r["shard"] == s or (r["shard"] == 7 and rack(s) == 1)
        assert r["rack"] == s or (rack(r["rack"]) == 6 and region(s) == 1)
        assert r["region"] == s or (region(r["region"]) == 0 and region(s) == 1)
        assert r["gone"] == s or (s == 7 and rack(r["gone"]) == 1)
    n = {t: Counter(r[t] for r in rows) for t in trees}
    assert len(n["n40"]) == 40 and all(abs(v - 1000) < 170 for v in n["n40"].values())
    assert abs(n["n41"][40] - 40000 / 41) < 170
    assert abs(n["shard"][7] - 5000 * 2 / 6) < 220
    assert abs(sum(v for s, v in n["rack"].items() if rack(s) == 6) - 20000 * 10 / 25) < 400
    assert abs(sum(v for s, v in n["region"].items() if region(s) == 0) - 40000 * 2 / 3) < 500


def xx(*values):
    """Spark's xxhash64 of longs and strings: each value's hash is seeded with the one before."""
    h = 42
    for v in values:
        if v is not None:
            h = xxhash.xxh64_intdigest(v.to_bytes(8, "little", signed=True) if isinstance(v, int) else v.encode(), h)
    return h - (1 << 64) if h >> 63 else h


def brute_mix(rows, max_slots):
    """The schedule word by word: every slot takes the next words of its source's repeated stream."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    names = sorted({s for _, s, _ in rows if s is not None}, key=lambda s: [ord(c) for c in s]) + [None] * any(s is None for _, s, _ in rows)
    sizes = {s: sum(size(t) for _, x, t in rows if x == s) for s in names}
    weight, total = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, sum(sizes.values())
    goal, capped = {}, set()
    while len(goal) < len(names):
        left, by = total - sum(3 * sizes[s] for s in capped), sum(weight[s] for s in names if s not in capped)
        over = {s for s in names if s not in capped and left * weight[s] / by > 3 * sizes[s]}
        if not over:
            goal = {s: 3.0 * sizes[s] if s in capped else left * weight[s] / by for s in names}
        capped |= over
        if len(capped) == len(names):
            goal = {s: 3.0 * sizes[s] for s in names}
    last = (1 << 63) - 1
    streams = {}
    for s in names:
        own = [(xx(last if i is None else i, xx(t), "mix"), last if i is None else i, k) for k, (i, x, t) in enumerate(rows) if x == s]
        streams[s] = [k for h, _, k in sorted(own, key=lambda r: ((r[0] & (1 << 64) - 1) >> 1, r[0], r[1])) for _ in range(size(rows[k][2]))]
    length = max(1, math.ceil(total / max_slots))
    upto, taken, at, first = np.cumsum([goal[s] for s in names]) / max(1, total), Counter(), Counter(), {}
    for slot in range(math.ceil(total / length)):
        point = slot * 0.6180339887498949 % 1
        s = names[min(int(np.sum(upto[:-1] <= point)), len(names) - 1)]
        for _ in range(length):
            if at[s] < 3 * sizes[s]:
                k = streams[s][at[s] % sizes[s]]
                taken[k] += 1
                first.setdefault(k, slot)
                at[s] += 1
    return Counter((i, s, size(t), sizes[s], round(goal[s], 6), taken[k], first.get(k)) for k, (i, s, t) in enumerate(rows))


@pytest.mark.parametrize("max_slots", [1 << 20, 700])
def test_mixing(docs, max_slots):
    rows = [(r["doc_id"], r["source"], r["text"]) for r in docs.select("doc_id", "source", "text").collect()]
    got = mix(docs.select("doc_id", "source", "text", F.lit(1).alias("taken")), max_slots=max_slots).collect()
    assert Counter((r["doc_id"], r["source"], r["size"], r["source_size"], round(r["target"], 6), r["taken"], r["first_slot"]) for r in got) == brute_mix(rows, max_slots)
    taken = defaultdict(int)
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"], r["target"]] += r["taken"]
    for (_, goal), n in taken.items():
        assert abs(n - goal) <= max(4, 0.002 * goal, 3 * sum(r["size"] for r in got) / max_slots)
    again = mix(docs.select("doc_id", "source", "text").repartition(7), max_slots=max_slots).collect()
    key = lambda r: (r["doc_id"] is None, r["doc_id"], r["size"], r["taken"], r["first_slot"] or -1)
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_targets():
    assert targets({"a": 100, "b": 100, None: 100}) == {"a": 187.5, "b": 75.0, None: 37.5}
    got = targets({"a": 10, "b": 100, "c": 100, "d": 100})
    assert got["a"] == 30 and math.isclose(sum(got.values()), 310) and got["d"] > got["b"] > got["c"]
    assert targets({"a": 0}) == {"a": 0.0}
    assert list(targets({"é": 1, "z": 1, "Z": 1, None: 1})) == ["Z", "z", "é", None]


def test_new_pieces_by_their_letters():
    """Pieces of letters take shorter ways to the same ids, whatever stands beside them in a batch."""
    enc = Encoder(vocabulary("word_bpe_49k.json"))
    texts = ["Straße", "İstanbul", "plain", "WORDS", "ΣΑΣ", "ﬁne", "日本語", "ǅ", "é" * 40, "don't", "12ab", "éx", "ºª", "ᄀ", "각", "x" * 500, "ñ…"]
    rows = [b" ".join(x.encode() for x in texts[k:] + texts[:k]) for k in range(len(texts))]
    data, offsets = np.frombuffer(b"".join(rows), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in rows])])
    ids, counts = enc.encode(data, offsets)
    want = [x.ids for x in enc.tokenizer.encode_batch([x.decode() for x in rows], add_special_tokens=False)]
    assert counts.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]
    for of_kind in (enc.ids_of_words, enc.ids_of):
        ids, counts = of_kind(["İ", "ab", "İx", "é"])
        assert counts.tolist() == [len(x.ids) for x in enc.tokenizer.encode_batch(["İ", "ab", "İx", "é"], add_special_tokens=False)]


def test_pieces_in_use_are_kept():
    """When room ends, pieces that later chunks had stay; single ones go, so that common words are encoded once."""
    enc, learned = Encoder(vocabulary("word_bpe_49k.json"), most=64), Counter()
    learn = enc.learn
    enc.learn = lambda hashes, texts: (learned.update(texts), learn(hashes, texts))[1]
    for k in range(40):
        data = np.frombuffer(" ".join(["some", "common", "words", *(f"q{k}x{i}" for i in range(10))]).encode(), np.uint8)
        enc.encode(data, np.array([0, len(data)]))
    assert max(learned.values()) == 1 and len(learned) == 403 and enc.known <= 64
