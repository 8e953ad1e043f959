"""Driver-side and per-task parts of the operators, without Spark."""

import itertools
import math
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from labelloom.llm import brown, langid, mixing, packing, rangejoin, sharding, simhash, topk
from tests.llm.brute import components


def optimum(sizes, capacity):
    """Fewest bins by search, for a handful of items."""
    best = len(sizes)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for b in range(len(bins)):
            if bins[b] + sizes[i] <= capacity and bins[b] not in bins[:b]:
                go(i + 1, [*bins[:b], bins[b] + sizes[i], *bins[b + 1 :]])
        go(i + 1, [*bins, sizes[i]])

    go(0, [])
    return best


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_reduction_never_costs_a_sequence(items):
    items = sorted(items, reverse=True)
    fixed, rest = packing.reduce_instance(Counter(items), 20)
    used = Counter(rest)
    for times, content in fixed:
        assert sum(length * n for length, n in content) <= 20
        for length, n in content:
            used[length] += times * n
    assert used == Counter(items)
    left = list(Counter(rest).elements())
    assert sum(t for t, _ in fixed) + (optimum(sorted(left, reverse=True), 20) if left else 0) == optimum(items, 20)


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=20))
def test_plan_places_every_piece_without_gap(counts):
    plan = packing.plan_sequences(counts, 64)
    cells = []
    ends = np.append(plan["start"][1:], sum(counts.values()))
    for start, end, each, sequence, offset, length in zip(plan["start"], ends, plan["each"], plan["sequence"], plan["offset"], plan["length"]):
        cells += [(sequence + i // each, offset + i % each * length, length) for i in range(end - start)]
    assert Counter(c[2] for c in cells) == Counter(counts)
    for _, group in itertools.groupby(sorted(cells), key=lambda c: c[0]):
        at = 0
        for _, offset, length in group:
            assert offset == at
            at += length
        assert at <= 64


def test_best_fit_is_best_fit():
    assert sum(t for t, _ in packing.best_fit({6: 2, 4: 2, 3: 1}, 10)) == 3
    assert packing.best_fit({}, 10) == []


@pytest.mark.parametrize("run", [packing.RUN, 10**9])
@pytest.mark.parametrize("blank", [" ", "\n"])
def test_two_million_blanks_are_encoded(run, blank, monkeypatch):
    text = "some words" + blank * 2_000_000 + "a <"
    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    monkeypatch.setattr(packing, "RUN", run)  # beyond reach: what tiktoken panics on is encoded all the same
    assert list(packing.encoder("byte_bpe_50k")(text)) == exact.encode(text, add_special_tokens=False).ids


def test_hilbert_curve_visits_neighbours():
    for dims, bits in ((2, 3), (3, 2)):
        points = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
        index = sharding.hilbert_index(points, bits)
        assert sorted(index) == list(range(len(points)))
        walk = points[np.argsort(index)]
        assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_targets_share_the_excess():
    assert mixing.targets([]) == []
    assert mixing.targets([100, 100, 100]) == pytest.approx([200, 200 * 2 / 2.4, 50 + 100 / 3], abs=60)
    for sizes in ([5, 1000, 3, 0, 77], [0, 0], [10]):
        got = mixing.targets(sizes)
        assert sum(got) == pytest.approx(1.5 * sum(sizes))
        assert all(t <= 2 * s + 1e-9 for t, s in zip(got, sizes))


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000, 1025])
def test_feistel_is_a_permutation(n):
    mapped = mixing.feistel(np.arange(n), n, "k")
    assert sorted(mapped) == list(range(n))
    assert list(mixing.feistel(mapped, n, "k", inverse=True)) == list(range(n))
    large = mixing.feistel(np.array([5, n]), 10**12, "k")
    assert list(mixing.feistel(large, 10**12, "k", inverse=True)) == [5, n]


def test_slots_hold_the_target():
    for size, target in ((1000, 1999.6), (1000, 3), (10, 20), (256, 256), (5000, 7000), (0, 0), (300, 600)):
        slots, last = mixing.slots_needed(target, size, 256, "k")
        if slots:
            held = mixing.words_before(slots - 1, size, 256, "k") + last
            assert held == round(target) and slots <= 2 * -(-size // 256)
        else:
            assert round(target) == 0


def test_shard_draws_add_up():
    pool = np.array([5000, 0, 70, 1])
    shards = -(-int(pool.sum()) // 64)
    got = [mixing.shard_counts(k, shards, pool, 64, 1) for k in range(shards)]
    assert (sum(c for c, _ in got) == pool).all()
    assert all(c.sum() == 64 for c, _ in got[:-1])
    before = np.zeros(4, int)
    for counts, earlier in got:
        assert (earlier == before).all()
        before = before + counts
    large = mixing.split_draw(np.array([3 * 10**9, 10**9]), 2 * 10**9, np.random.default_rng(1))
    assert large.sum() == 2 * 10**9 and large[0] == pytest.approx(1.5e9, rel=1e-3)


def test_cut_words():
    assert mixing.cut_words(" a  b\tc d\n", [(0, 2), (3, 4)]) == "a  b\nd"
    assert mixing.merged([(0, 2), (2, 3), (5, 6)]) == [(0, 3), (5, 6)]


def test_fingerprint_by_hand():
    words = b"a b c d b c d b c d".split()
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(len(words) - 2)]
    wanted = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))
    assert simhash.fingerprint(words) == wanted
    assert simhash.fingerprint([]) == 0
    assert simhash.fingerprint([b"x", b"y"]) == xxhash.xxh64_intdigest(b"x y", 42)


def test_thresholds_follow_the_cost():
    total, chosen = simhash.share_thresholds([[0, 1, 5, 50, 500], [0, 100, 200, 300, 400]], 3)
    assert chosen == [2, 0] and total == 150
    assert sum(t + 1 for t in simhash.share_thresholds([[0, 1, 2, 3, 4]] * 4, 3)[1]) == 4


def test_forest_and_runs_connect_what_is_linked():
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(5)]
    prints = list({b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(4))) & (2**64 - 1) for b in base for _ in range(40)})
    own = np.array(prints, np.uint64)
    links = [(a, b) for a, b in itertools.combinations(prints, 2) if (a ^ b).bit_count() <= 3]
    wanted = components(prints, links)
    got = components(prints, [(prints[i], prints[j]) for i, j in simhash.forest(own, 3)])
    assert got == wanted
    run = np.arange(len(prints)) // 100
    found = [tuple(map(int, e)) for e in simhash.links_of_runs(run, own, 3)]
    same = [(a, b) for a, b in links if prints.index(a) // 100 == prints.index(b) // 100]
    assert components(prints, found) == components(prints, same)


def test_bipartite_forest():
    rng = np.random.default_rng(0)
    linked = rng.random((30, 40)) < 0.04
    names = [*range(30), *range(100, 140)]
    all_links = [(i, 100 + j) for i, j in zip(*np.nonzero(linked))]
    forest = [(i, 100 + j) for i, j in rangejoin.bipartite_forest(linked)]
    assert components(names, forest) == components(names, all_links)
    assert set(forest) <= set(all_links) and len(forest) < len(names)


def test_members_lose_no_link():
    rng = np.random.default_rng(1)
    u = rangejoin.unit(rng.normal(size=(400, 3)))
    pivots, radius = u[:6], 0.3
    d = rangejoin.pivot_distances(u, pivots)
    home = d.argmin(axis=1)
    reach = np.array([d[home == j, j].max(initial=-np.inf) for j in range(6)])
    inside = rangejoin.members(d, pivots, reach, radius)
    near = np.linalg.norm(u[:, None] - u[None], axis=2) <= radius
    for i, j in zip(*np.nonzero(near)):
        assert inside[j, home[i]]
    assert inside.sum() < inside.size


def test_threshold_algorithm_stops_early_and_is_exact():
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(2000, 3)) * 100).astype(np.int64)
    x[50:90] = x[50]
    ids = rng.permutation(2000)
    lists = topk.SortedLists(ids, x, 5)
    some = 0
    for q, own in [(x[i], ids[i]) for i in range(0, 100, 7)] + [(np.zeros(3, np.int64), 3)]:
        score = x @ q
        order = sorted((-int(s), int(i)) for s, i in zip(score, ids) if i != own)[:5]
        scores, found, scored = lists.best(q, own, 5)
        assert [(-int(s), int(i)) for s, i in zip(scores, found)] == order
        some += scored < len(lists.ids)
    assert some > 5
    huge = topk.SortedLists(np.arange(3), np.array([[2**31], [2**30], [-(2**31)]]), 2)
    assert list(huge.best(np.array([2**30]), 9, 2)[1]) == [0, 1]


def test_forward_sums_all_segmentations():
    pieces = langid.pieces_of(langid.VOCABULARY)
    rng = np.random.default_rng(0)
    probability = np.vstack([rng.random((pieces.size, 2)) / pieces.size, np.zeros((1, 2))])

    def plain(word, column):
        total = 0.0
        for cuts in itertools.product([False, True], repeat=len(word) - 1):
            parts, start = [], 0
            for i, cut in enumerate([*cuts, True], 1):
                if cut:
                    parts.append(word[start:i])
                    start = i
            p = 1.0
            for part in parts:
                number = int(pieces.find(np.array([pieces._hash(part)], np.uint64))[0])
                p *= probability[number, column] or (langid.UNKNOWN if len(part) == 1 else 0.0)
            total += p
        return total

    for word in ("the", "über", "日本", "a"):
        got = pieces.log_likelihood([word], probability)[0]
        assert got == pytest.approx([np.log(plain(langid.START + word, c)) for c in (0, 1)])
    assert langid.words_of("x" * 70 + " 12 É") == Counter({"x" * 32: 2, "x" * 6: 1, "é": 1})


def test_long_pieces_and_long_words_are_whole():
    pieces = langid.pieces_of(langid.VOCABULARY)
    assert pieces.find(np.array([pieces._hash("▁important"), pieces._hash("▁quelques")], np.uint64)).max() < pieces.size
    assert pieces.count(Counter({"important": 3})).sum() == 3 and pieces.longest > 8
    rng = np.random.default_rng(0)
    probability = np.vstack([rng.random((pieces.size, 2)) / pieces.size * [1, 1e-5], np.zeros((1, 2))])

    def plain(word, column):
        ends = [0.0]  # logarithms
        for i in range(1, len(word) + 1):
            terms = []
            for start in range(max(0, i - pieces.longest), i):
                number = int(pieces.find(np.array([pieces._hash(word[start:i])], np.uint64))[0])
                p = probability[number, column] or (langid.UNKNOWN if i - start == 1 else 0.0)
                terms += [ends[start] + np.log(p)] if p else []
            ends.append(np.logaddexp.reduce(terms))
        return ends[-1]

    for word in ("important", "quelques" * 40, "日本語" * 30, "x" * 500):
        assert pieces.log_likelihood([word, "a"], probability)[0] == pytest.approx([plain(langid.START + word, c) for c in (0, 1)])
    assert list(langid.words_of("x" * 70 + " é", None)) == ["x" * 70, "é"]


def test_exchange_gains_and_model_sums_to_one():
    rng = np.random.default_rng(5)
    pairs = np.zeros((40, 40))
    group = rng.integers(0, 2, 40)
    for _ in range(4000):
        a = rng.integers(1, 40)
        b = rng.choice(np.flatnonzero(group == 1 - group[a]))
        pairs[a, b] += 1
    pairs[:, 0] += 3
    pairs[0] += 3

    def likelihood(own):
        m = np.eye(own.max() + 1)[own]
        t = m.T @ pairs @ m
        return brown.xlogx(t).sum() - brown.xlogx(t.sum(0)).sum() - brown.xlogx(t.sum(1)).sum()

    start = np.array([0, *(1 + i % 3 for i in range(39))])
    own = brown.exchange(pairs, 4)
    assert own[0] == 0 and (own[1:] > 0).all()
    assert likelihood(own) > likelihood(start)
    none = brown.exchange(np.zeros((5, 5)), 3)
    assert none[0] == 0


def test_units_move_where_the_likelihood_gains_most():
    rng = np.random.default_rng(8)
    pairs = rng.poisson(0.3, (30, 30)).astype(float)
    np.fill_diagonal(pairs, 0)  # without pairs of a unit with itself the gains are exact
    own = np.array([0, *rng.integers(1, 5, 29)])
    member = np.eye(5)[own]
    table = member.T @ pairs @ member
    found = brown.best_classes(np.arange(30), (pairs @ member).astype(int), (pairs.T @ member).astype(int), own, table)

    def after(u, c):
        m = np.eye(5)[np.where(np.arange(30) == u, c, own)]
        return brown.likelihood(m.T @ pairs @ m)

    assert found[0] == 0
    for u in range(1, 30):
        tried = [after(u, c) for c in range(1, 5)]
        # A unit's neighbours in its own old class are counted there, so a near tie may go either way.
        assert tried[found[u] - 1] >= max(tried) - 2.0 and tried[found[u] - 1] >= after(u, own[u]) - 1e-6
    assert (found != own).any()


def test_sweeps_class_every_word_of_the_dictionary(spark, monkeypatch):
    monkeypatch.setattr(brown, "SINGLE", 8)
    monkeypatch.setattr(brown, "CLASSES", 5)
    rng = np.random.default_rng(4)
    kinds = [[f"{k}{i}end" for i in range(40)] for k in "abc"]  # endings tell nothing of the kind
    texts = []
    for _ in range(400):
        start = rng.integers(3)
        texts.append(" ".join(kinds[(start + j) % 3][min(39, int(rng.geometric(0.08)))] for j in range(30)))
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(5)
    counts = brown.word_counts(docs)
    lexicon = brown.Lexicon(*brown.frequent(counts, 1000))
    seeds = lexicon.seeds()
    assert lexicon.units == 1 + len(lexicon.words) + brown.ENDINGS and len(seeds) == lexicon.units
    assert len(set(seeds[: lexicon.first_ending])) < lexicon.first_ending  # most words start with their ending's class
    units = brown.unit_texts(docs, lexicon)
    start = brown.exchange(brown.class_pairs(units, seeds, int(seeds.max()) + 1), brown.CLASSES)[seeds]
    classes = int(start.max()) + 1
    first = brown.class_pairs(units, start, classes)
    own, table = brown.clustered(units, lexicon)
    assert brown.likelihood(table) > brown.likelihood(first)
    assert np.array_equal(table, brown.class_pairs(units, own, classes)) and own[0] == 0 and (own[1:] > 0).all()
    index = {w: i + 1 for i, w in enumerate(lexicon.words)}
    plain = np.zeros((classes, classes))
    for t in texts:
        found = [0, *(own[index[w.encode()]] for w in t.split()), 0]
        for a, b in zip(found, found[1:]):
            plain[a, b] += 1
    assert np.array_equal(plain, table)
    # The kinds follow one another in turn, so hardly any class has words of two kinds.
    mixed = {c for c in range(1, classes) if len({w[:1] for w, i in index.items() if own[i] == c}) > 1}
    assert sum(n for w, n in zip(lexicon.words, lexicon.counts) if own[index[w]] in mixed) < 0.1 * lexicon.counts.sum()


def test_draws_follow_the_hypergeometric_law():
    """Means and spreads of many draws, and every outcome of a small one, at sizes below and beyond what numpy draws."""
    rng = np.random.default_rng(5)
    for good, bad, take in ((5, 9, 6), (40, 60, 30), (3, 5000, 4000), (7000, 2, 3500), (3 * 10**10, 5 * 10**10, 4 * 10**10)):
        total, p = good + bad, good / (good + bad)
        got = np.array([mixing.good_draws(good, bad, take, rng) for _ in range(4000)], float)
        spread = (take * p * (1 - p) * (total - take) / (total - 1)) ** 0.5
        assert abs(got.mean() - take * p) < 5 * spread / 4000**0.5 and abs(got.std() / spread - 1) < 0.06
        assert got.min() >= max(0, take - bad) and got.max() <= min(good, take)
    counts = np.bincount([mixing.good_draws(12, 15, 13, rng) for _ in range(20_000)], minlength=13)
    law = np.array([math.comb(12, k) * math.comb(15, 13 - k) / math.comb(27, 13) for k in range(13)])
    assert ((counts - 20_000 * law) ** 2 / (20_000 * law + 1e-9))[law > 1e-3].sum() < 35
    assert [mixing.good_draws(*case, rng) for case in ((0, 20, 15), (20, 0, 15), (9, 9, 18), (9, 9, 0))] == [0, 15, 9, 0]


def test_unit_vectors_of_extreme_size():
    x = np.array([[3e200, 4e200], [3e-200, -4e-200], [0.0, 5.0]])
    assert np.allclose(rangejoin.unit(x), [[0.6, 0.8], [0.6, -0.8], [0.0, 1.0]], rtol=1e-15)


def test_labels_of_any_type_are_compared(spark):
    rows = [(1, "a", [1e200, 1e200]), (2, "a", [1.0, 1.0]), (3, "b", [1.0, 1.0]), (4, "a", [1.0, -1.0]), (5, None, [1.0, 1.0])]
    for kind, label in (("string", lambda x: x), ("long", lambda x: None if x is None else 2**40 + ord(x)), ("double", lambda x: None if x is None else ord(x) / 4)):
        vectors = spark.createDataFrame([(i, label(x), v) for i, x, v in rows], f"vec_id long, label {kind}, embedding array<double>")
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in rangejoin.near_vectors(vectors, 0.93).collect()}
        assert got == {1: (1, 1, True), 2: (1, 1, False), 3: (0, 3, True), 4: (0, 4, True), 5: (0, 5, True)}
