"""The operators on small tables with nulls, empty and long texts, ties, repeats, clashing columns and no rows."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from labelloom.llm import brown, components, fixity, langid, mixing, packing, pii, queries, rangejoin, sharding, simhash, topk
from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row int, size string, spans int, `_id` string, rest int"
EN = "the house of the river and the people that went to the hill with their dogs in summer"
DE = "der Fluss und die Häuser mit den Leuten die über den Hügel gingen ohne ihre Hunde"


def make_docs(spark, rows):
    return spark.createDataFrame([(i, t, g, s, len(t or ""), 1, "s", 2, "x", 3) for i, t, g, s in rows], SCHEMA)


def varied():
    rng = random.Random(1)
    words = (EN + " " + DE).split()
    rows = [(i, " ".join(rng.choice((EN if i % 2 else DE).split()) for _ in range(rng.randrange(1, 60))), "en" if i % 2 else "de", f"s{i % 4}") for i in range(120)]
    rows += [(200, None, "en", "s0"), (201, "", "de", None), (202, " 12 34 ", None, "s1"), (None, "no id here", "en", "s2"), (None, "no id here", "en", "s2")]
    rows += [(203, rows[3][1], "en", "s3"), (3, rows[3][1], "en", "s3"), (204, " ".join(rng.choice(words) for _ in range(9000)), "en", "s1")]
    rows += [(205, "<|endoftext|> in text", "en", "s1"), (206, "x" * 30000, "en", "s1"), (207, "日本語の文章", "en", "s1")]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return make_docs(spark, varied()).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return make_docs(spark, [])


def test_pack(docs, none):
    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = packing.pack(docs).collect()
    wanted = Counter()
    for doc_id, text, *_ in varied():
        ids = np.array(exact.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        cuts = [0, *range((len(ids) - 1) % 2048 + 1, len(ids), 2048), len(ids)]
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
            wanted[doc_id, piece, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == wanted
    ends = Counter()
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends[r.sequence_id]
        ends[r.sequence_id] += r.length
    assert max(ends.values()) <= 2048
    assert len(ends) <= -(-sum(r.length for r in rows) // 2048) + 1
    assert packing.pack(none).count() == 0


def test_shards(docs, none, tmp_path):
    rows = sharding.document_shards(docs, 7).collect()
    wanted = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in varied())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == wanted
    counts = Counter(r.shard for r in rows)
    assert set(counts) == set(range(7)) and max(counts.values()) - min(counts.values()) <= 1
    assert sorted((r.shard, r.slot) for r in rows) == [(s, k) for s in range(7) for k in range(counts[s])]
    order = [r.curve_index for r in sorted(rows, key=lambda r: (r.shard, r.slot))]
    assert order == sorted(order)
    assert sharding.document_shards(none, 7).count() == 0
    few = docs.where("doc_id < 50 AND doc_id <> 3").select("doc_id", "text", "source", "lang")
    path = str(tmp_path / "shards")
    sharding.write_shards(few, sharding.document_shards(few, 3), path)
    assert few.sparkSession.read.parquet(path).select("doc_id", "text").exceptAll(few.select("doc_id", "text")).count() == 0


def test_mix(docs, none):
    rows = mixing.taken_words(mixing.mix(docs, block=16, slots=8)).collect()
    assert Counter((r.doc_id, r["size"]) for r in rows) == Counter((i, len((t or "").encode().split())) for i, t, *_ in varied())
    by = {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r["size"]
        size, taken = by.get((r.source_size, r.target), (0, 0))
        by[r.source_size, r.target] = (size + r["size"], taken + r.taken)
    assert len(by) == 5
    for (source, target), (size, taken) in by.items():
        assert size == source and taken == round(target)
    again = mixing.taken_words(mixing.mix(docs.repartition(5), block=16, slots=8)).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.taken)
    assert sorted(again, key=key) == sorted(rows, key=key)
    assert mixing.taken_words(mixing.mix(none)).count() == 0


def test_mixed_documents(docs, none):
    out = mixing.mixed_documents(docs)
    assert out.dtypes == docs.dtypes
    got = Counter()
    for r in out.collect():
        assert r.n_chars == len(r.text)
        got[r.source] += len(r.text.encode().split())
    wanted = Counter()
    for r in mixing.taken_words(mixing.mix(docs)).join(docs.select("doc_id", "source").distinct(), "doc_id").collect():
        wanted[r.source] += r.taken
    assert abs(got["s0"] - wanted["s0"]) <= 1 and got["s1"] == wanted["s1"]
    assert mixing.mixed_documents(none).count() == 0


def test_language(docs, none):
    rows = {(r.doc_id, r.text): r for r in langid.fit_and_identify(docs).collect()}
    for i, t, lang, _ in varied():
        r = rows[i, t]
        if not any(c.isalpha() for c in t or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert r.lang_pred in ("de", "en") and 0 < r.score <= 1
            if i is not None and i < 120 and len(t.split()) > 8:
                assert r.lang_pred == lang
    assert langid.fit_and_identify(none).count() == 0
    unlearned = langid.identify(docs.select("doc_id", "text", F.lit(1).alias("score")), *langid.learn(none.select("text", "lang", F.lit(1).alias("pick"))))
    assert {(r.lang_pred, r.score) for r in unlearned.collect()} == {("und", 0.0)}


def flipped(fp, bits):
    return fp ^ sum(1 << b for b in bits)


def test_hamming_links_against_all_pairs(spark, monkeypatch):
    rng = random.Random(7)
    base = [rng.getrandbits(64) for _ in range(30)]
    prints = {0, *base}
    for b in base:
        for _ in range(6):
            prints.add(flipped(b, rng.sample(range(64), rng.randrange(1, 6))))
    hub = rng.getrandbits(64)
    prints |= {flipped(hub, (i, j)) for i in range(0, 64, 3) for j in range(i)}
    prints = sorted(prints)
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    wanted = brute.components(signed, [(signed[i], signed[j]) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3])
    table = spark.createDataFrame([(s,) for s in signed], "fp long")
    for block in (4096, 20):
        monkeypatch.setattr(simhash, "BLOCK", block)
        found = [(r.a, r.b) for r in simhash.hamming_links(table).collect()]
        assert brute.components(signed, found) == wanted
    for chosen in ([(list(range(32)), 1), (list(range(32, 64)), 1)], [(list(range(0, 20)), 2), (list(range(20, 64)), 0)]):
        monkeypatch.setattr(simhash, "plan_groups", lambda *_, chosen=chosen: chosen)
        found = [(r.a, r.b) for r in simhash.hamming_links(table).collect()]
        assert brute.components(signed, found) == wanted


def test_near_duplicates(docs, none):
    prints = {}
    for i, t, *_ in varied():
        prints.setdefault(simhash.fingerprint((t or "").encode().lower().split()), set()).add(i)
    nodes = sorted(prints)
    near = brute.components(nodes, [(a, b) for a in nodes for b in nodes if a < b and (a ^ b).bit_count() <= 3])
    smallest = {}
    for fp, ids in prints.items():
        smallest.setdefault(near[fp], set()).update(ids - {None})
    for r in simhash.near_duplicates(docs).collect():
        fp = r.fp % 2**64
        assert r.doc_id in prints[fp]
        assert r.component_id == min(smallest[near[fp]], default=None)
    kept = simhash.deduplicated(docs)
    assert kept.dtypes == docs.dtypes
    assert kept.count() == len(set(near.values()))
    assert simhash.near_duplicates(none).count() == 0 and simhash.deduplicated(none).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1100)] + [(5, 5), (None, 3)]
    rows = components.connect(spark.createDataFrame(chain, "a long, b long")).collect()
    labels = {}
    for r in rows:
        labels.setdefault(r.label, set()).add(r.node)
    assert sorted(map(len, labels.values())) == [100, 201]
    assert components.connect(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.fixture(scope="module")
def private():
    tricky = [
        "mail a.b@c.d_e@f.g now", "@a.b x@y x@y.z.", "1.2.3.4.5.6.7.8 and 300.1.1.1 and 007.0.00.255", "x" * 5000 + "@" + "y" * 5000,
        "4111 1111 1111 1111 and 4111-1111-1111-1111-1 and 4111 1111 1111 1112", "1 2 3 4  4111111111111111", "9" * 4000, "1-" * 4000,
        "+1 (988) 555-2485, +12, ++1 2345678, +1.2.3.4.5.6.7.8", "é\U0001f600 a@b.co\n+49 (30) 1234567 1.1.1.1@x.yz", "0" * 16, "+" * 3000, None, "",
    ]
    rng = random.Random(4)
    noise = ["".join(rng.choice("0123456789.+@ -a()") for _ in range(rng.randrange(80))) for _ in range(400)]
    return tricky + noise


def test_base_spans(spark, private):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(private)], "doc_id long, text string, base int")
    rows = {r.doc_id: r for r in pii.find(docs).select("doc_id", pii.written(F.col("base")).alias("b"), pii.written(F.col("spans")).alias("s")).collect()}
    for i, text in enumerate(private):
        assert rows[i].b == ",".join(brute.base_spans(text)), text
        assert set(rows[i].b.split(",")) <= set(rows[i].s.split(","))
    assert pii.find(docs.limit(0)).count() == 0


def test_patterns_are_bootstrapped(spark):
    seeds = [(i, f"text {i} please write to user{i}@mail{i}.example.com today", None) for i in range(12)]
    other = [(100, "text please write to jane(at)example7 today", None), (101, "version 2.0 of it", None), (101, "version 2.0 of it", None)]
    docs = spark.createDataFrame(seeds + other, "doc_id long, text string, spans string")
    rows = pii.find(docs).select("doc_id", pii.written(F.col("spans")).alias("s")).collect()
    found = {r.doc_id: r.s for r in rows}
    assert len(rows) == 15
    assert found[100] == "email:21:37" and other[0][1][21:37] == "jane(at)example7"
    assert found[101] == ""
    clean = {r.doc_id: r for r in pii.redact(docs).collect()}
    assert clean[100].text == "text please write to [EMAIL] today"
    assert clean[3].text == "text 3 please write to [EMAIL] today"
    assert pii.redact(docs).dtypes == docs.dtypes and pii.redact(docs).count() == 15


def test_matches_of_several_words_are_seeds_of_their_own(spark):
    rows = [(i, f"call me on +1 ({200 + i}) 555-010{i} before noon") for i in range(8)] + [(50, "call me on 020-7946-0018 before noon")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.s for r in pii.find(docs).select("doc_id", pii.written(F.col("spans")).alias("s")).collect()}
    assert found[50] == "phone:11:24" and found[0] == "phone:11:28"


def test_half_of_a_context_may_be_unseen(spark):
    rows = [(i, f"text please write to user{i}@mail{i}.example.com today") for i in range(30)]
    rows += [(100 + i, f"text please write to jane(at)example{i + 10} today") for i in range(30)]
    rows += [(200 + i, f"we call +1 ({200 + i}) 555-010{i % 10} before noon") for i in range(12)] + [(250 + i, f"we call 020-7946-00{i + 10} before noon") for i in range(12)]
    years = [1950 + i for i in range(8)]
    rows += [(300 + 10 * k + i, f"{a} {y} {b}") for i, y in enumerate(years) for k, (a, b) in enumerate([("in the year", "we met"), ("it was in", "that rain fell"), ("since about", "or so")])]
    rows += [(400 + i, f"text please write to {y} today") for i, y in enumerate(years[:3])]
    rows += [(500 + i, f"room for {i + 30} guests") for i in range(20)] + [(600, "room for a@b.example guests")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.s for r in pii.find(docs).select("doc_id", pii.written(F.col("spans")).alias("s")).collect()}
    assert all(found[100 + i] == "email:21:38" for i in range(30))
    assert all(found[250 + i] == "phone:8:21" for i in range(12))
    assert all(found[i] == "" for i in found if 300 <= i < 600)


def test_overlapping_spans_become_one_mark(spark):
    docs = spark.createDataFrame([(1, "card 4111 1111 1111 1111 or a@1.2.3.4!"), (2, None)], "doc_id long, text string")
    rows = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert rows == {1: "card [CARD] or [EMAIL]!", 2: None}


def test_fixity(spark, none):
    rows = [(i, f"http://x/{i}", "page " * (i % 5)) for i in range(9000)] + [(None, None, None), (5, "http://x/5", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert fixity.audit(pages, pages).count() == 0
    broken = pages.withColumn("html", F.when(F.col("page_id").isin(17, 4501), F.translate("html", "p", "q")).otherwise(F.col("html")))
    found = fixity.audit(pages, broken).collect()
    assert sorted(r.page_id for r in found) == [17, 4501] and all(r.expected != r.found for r in found)
    lost = fixity.audit(pages, pages.where("page_id IS NULL OR page_id <> 8990")).collect()
    assert 8990 in {r.page_id for r in lost} and min(r.page_id for r in lost) >= 8990
    empty = pages.limit(0)
    assert fixity.audit(empty, empty).count() == 0
    assert fixity.audit(pages.limit(20), empty).where("found IS NULL").count() == 20


def test_merkle_root_by_hand(spark):
    pages = spark.createDataFrame([(i, "u", "h") for i in range(18)], "page_id long, url string, html string")
    leaf = [r.hash for r in fixity.leaves(pages).orderBy("node").collect()]
    up = [hashlib.sha256("".join(leaf[i : i + 16]).encode()).hexdigest() for i in (0, 16)]
    root = fixity.tree(fixity.leaves(pages))[-1].collect()
    assert [r.hash for r in root] == [hashlib.sha256("".join(up).encode()).hexdigest()]


VECTORS = "vec_id long, embedding array<float>, label int, node int, dims string, copies int"


def vector_rows():
    rng = np.random.default_rng(9)
    rows, base = [], rng.normal(size=(40, 6))
    for i in range(300):
        v = base[i % 40] + rng.normal(size=6) * (0.25 if i % 3 else 0.02)
        rows.append((i, [float(x) for x in v.astype(np.float32)], i % 2))
    rows += [(1000 + i, rows[7][1], 1) for i in range(30)]
    rows += [(2000, None, 1), (2001, [0.0] * 6, 1), (2002, [float("nan")] * 6, 1), (2003, [1.0, None] + [1.0] * 4, 1), (2004, rows[0][1], None), (2005, [], 1), (2006, [float("inf")] + [0.0] * 5, 0)]
    rows += [(2007, [1.0, 2.0], 0), (2008, [2.0, 4.0], 0), (2009, [3e-30] * 6, 0), (2010, [1e30] * 6, 0), (2010, [1e30] * 6, 0)]
    return rows


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.createDataFrame([(*r, 1, "d", 2) for r in vector_rows()], VECTORS)


def good(v):
    return bool(v) and all(x is not None and np.isfinite(x) for x in v)


@pytest.mark.parametrize("block", [4096, 13])
def test_near_vectors(vectors, block, monkeypatch):
    monkeypatch.setattr(rangejoin, "BLOCK", block)
    rows = vector_rows()
    links = []
    for i, (_, u, a) in enumerate(rows):
        for j, (_, v, b) in enumerate(rows[:i]):
            if a == b and a is not None and good(u) and good(v) and len(u) == len(v) and any(u) and any(v):
                x, y = np.array(u), np.array(v)
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.93:
                    links.append((i, j))
    counts = Counter(n for link in links for n in link)
    reach = brute.components(list(range(len(rows))), links)
    smallest = {}
    for i, (vec_id, *_) in enumerate(rows):
        smallest[reach[i]] = min(vec_id, smallest.get(reach[i], vec_id))
    wanted = Counter((r[0], counts[i], smallest[reach[i]], r[0] == smallest[reach[i]]) for i, r in enumerate(rows))
    got = Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in rangejoin.near_vectors(vectors, 0.93).collect())
    assert got == wanted
    assert rangejoin.near_vectors(vectors.limit(0), 0.93).count() == 0


def test_top_inner_products_of_odd_vectors(vectors):
    table = topk.quantised(vectors)
    got = topk.top_inner_products(table, table.where("vec_id % 50 = 0"), 5, block=64, per_query_block=4).collect()
    assert {r.query_id for r in got} == {q for q, v, _ in vector_rows() if q % 50 == 0 and good(v)}
    assert topk.top_inner_products(table.limit(0), table.limit(0), 5).count() == 0


def test_top_inner_products_exactly(vectors):
    table = topk.quantised(vectors.where("vec_id < 2000"))
    exact = [(i, [int(np.floor(256 * x)) for x in v]) for i, v, _ in vector_rows() if i < 2000]
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_inner_products(table, table.where("vec_id % 50 = 0"), 5, block=64, per_query_block=4).collect())
    wanted = []
    for q, x in exact:
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in exact if i != q)[:5]
            wanted += [(q, k, i, -s) for k, (s, i) in enumerate(best, 1)]
    assert got == sorted(wanted)


def test_brown(docs, none):
    counts = Counter()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    for i, t, *_ in varied():
        if not held(i):
            counts.update([*(t or "").encode().lower().split(), b""])
    total, types = sum(counts.values()), len(counts)
    rows = brown.fit_and_score(docs).collect()
    base = Counter()
    for i, t, *_ in varied():
        tokens = [*(t or "").encode().lower().split(), b""]
        score = sum(np.log10((counts[w] + 0.5) / (total + 0.5 * (types + 1))) for w in tokens)
        base[i, len(tokens), sum(counts[w] > 0 for w in tokens), total, round(score, 6)] += 1
    assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows) == base
    own = [r for r in rows if r.doc_id is not None and r.doc_id < 120]
    assert sum(r.score for r in own) > sum(r.base_score for r in own)
    assert brown.fit_and_score(none).count() == 0


def test_brown_sums_to_one(docs):
    model, counts = brown.fit(docs)
    lexicon = model.lexicon
    sums = np.zeros(len(model.step))
    sums += 10 ** model.step[:, 0] * (model.end + 0.5)
    for r in counts.where(F.col("word") != F.lit(b"")).collect():
        unit = lexicon.units_of([bytes(r.word)], lexicon.index())[1][0]
        sums += 10 ** model.step[:, model.unit_class[unit]] * (r.n + 0.5)
    for c in set(model.unit_class[lexicon.first_ending :]):
        sums += 10 ** model.step[:, c] * 0.5
    assert sums == pytest.approx(np.ones(len(sums)))


def test_brown_score_is_that_of_its_classes(docs, monkeypatch):
    monkeypatch.setattr(brown, "DICTIONARY", 12)  # words beyond the dictionary too
    model, counts = brown.fit(docs.where(~brown.held_out()))
    lexicon, seen = model.lexicon, {bytes(r.word): r.n for r in counts.collect()}
    place = {w: i + 1 for i, w in enumerate(lexicon.words)}
    assert 0 < len(place) <= 12 < len(seen)
    kind = lambda w: 0 if w == b"" else int(model.unit_class[place.get(w) or lexicon.ending(w)])
    totals, classes = Counter(), len(model.step)
    for w, n in seen.items():
        totals[kind(w)] += n + 0.5
    for c in {int(c) for c in model.unit_class[lexicon.first_ending :]}:
        totals[c] += 0.5
    pairs = np.zeros((classes, classes))
    trained = [(t or "").encode().lower().split() for i, t, *_ in varied() if i is None or zlib.crc32(str(i).encode()) % 5 != 1]
    for tokens in trained:
        found = [0, *map(kind, tokens), 0]
        for a, b in zip(found, found[1:]):
            pairs[a, b] += 1
    share = (pairs.sum(axis=0) + 0.5) / (pairs.sum() + 0.5 * classes)
    wanted = Counter()
    for i, t, *_ in varied():
        tokens, before, score = [*(t or "").encode().lower().split(), b""], 0, 0.0
        for w in tokens:
            c = kind(w)
            follow = (pairs[before, c] + classes / 2 * share[c]) / (pairs[before].sum() + classes / 2)
            score += np.log10(follow * (seen.get(w, 0) + 0.5) / max(totals[c], 0.5))
            before = c
        wanted[i, round(score, 5)] += 1
    assert Counter((r.doc_id, round(r.score, 5)) for r in brown.score(docs, model, counts).collect()) == wanted


def test_pipeline_stages(spark, docs, none):
    for name, apply in corpus_pipeline.STAGES:
        out, empty = apply(spark, docs, ""), apply(spark, none, "")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.dtypes == docs.dtypes and empty.dtypes == docs.dtypes
        assert out.count() > 0 and empty.count() == 0
    kept = corpus_pipeline.STAGES[0][1](spark, docs, "")
    assert {r.doc_id for r in docs.select("doc_id").collect()} - {r.doc_id for r in kept.select("doc_id").collect()} == {200, 201, 202}


def test_language_stage_keeps_an_unlabelled_corpus(spark, docs):
    kept = corpus_pipeline.language(spark, docs.withColumn("lang", F.lit(None).cast("string")), "")
    wanted = Counter(i for i, t, *_ in varied() if any(c.isalpha() for c in t or ""))
    assert Counter(r.doc_id for r in kept.collect()) == wanted and kept.dtypes == docs.dtypes


def test_pipeline_keeps_one_document_of_each_group(spark):
    sf = "/root/testdata/sf0.001"
    rows = corpus_pipeline.run(spark, sf).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    prints = {}
    for i, t in docs.items():
        prints.setdefault(simhash.fingerprint(t.encode().lower().split()), []).append(i)
    nodes = sorted(prints)
    near = brute.components(nodes, [(a, b) for a in nodes for b in nodes if a < b and (a ^ b).bit_count() <= 3])
    kept = {min(i for fp in nodes if near[fp] == g for i in prints[fp]) for g in set(near.values())}
    assert {r.doc_id for r in rows} <= kept
    ends = Counter()
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends[r.sequence_id]
        ends[r.sequence_id] += r.length
    assert max(ends.values()) <= 2048


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_queries_cover_their_table(spark, name):
    sf = "/root/testdata/sf0.001"
    out = queries.QUERIES[name](spark, sf)
    key, source = ("vec_id", "embeddings") if "vec_id" in out.columns else ("doc_id", "documents")
    assert out.select(key).distinct().count() == spark.read.parquet(f"{sf}/{source}.parquet").count()
