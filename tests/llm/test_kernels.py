import base64
import itertools
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from simdex.llm import gbdt, langid, mixing, pii, secrets, toxicity
from simdex.llm import textcore as tc
from simdex.llm.components import _local_forest
from simdex.llm.fmindex import FMIndex, WaveletMatrix, suffix_array
from simdex.llm.jaccard import JaccardConfig, minimum_matches

WORD = re.compile("[0-9A-Za-zªµºÀ-῿⁰-⿿〃-\U0010ffff]+")
UP = {ord(c): c.lower() for c in map(chr, [*range(65, 91), *range(0xC0, 0xD7), *range(0xD8, 0xDF)])}


def split(texts):
    out = [[] for _ in texts]
    for first, _, data, offs in tc.chunks(pa.array(texts, pa.string()), 16):
        w = tc.words(data, offs)
        for s, e, r in zip(w.start, w.end, w.row):
            out[first + r].append(w.folded[s:e].tobytes().decode())
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=30), st.text(alphabet="aZÉé×÷ß «»“…\n、。ªx9", max_size=30)), max_size=6))
def test_words_match_the_regular_expression(texts):
    assert split(texts) == [WORD.findall((t or "").translate(UP)) for t in texts]


def test_hashes_are_equal_for_equal_words_only():
    texts = ["The cat the CAT", "cat", "tac act", "x" * 50]
    w = [tc.words(d, o) for _, _, d, o in tc.chunks(pa.array(texts))][0]
    assert w.hash[0] == w.hash[2] and w.hash[1] == w.hash[3] == w.hash[4] == tc.word_hash("cat")
    assert len(set(w.hash.tolist())) == 5


def test_spans_longer_than_a_block_hash_alike(monkeypatch):
    text = " ".join(f"w{i}" for i in range(3000))
    data, offs = np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)])
    want = tc.words(data, offs).hash
    monkeypatch.setattr(tc, "_CHUNK_BYTES", 101)
    assert (tc.words(data, offs).hash == want).all()


def test_short_rows_are_one_gram():
    h = np.array([11, 12, 13, 11, 12], np.uint64)
    grams, bounds = tc.ngram_hashes(h, np.array([0, 3, 3, 5]), 3)
    assert bounds.tolist() == [0, 1, 1, 2] and grams[0] != grams[1]


@pytest.mark.parametrize("seed", range(12))
def test_fm_index_against_scan(seed):
    rng = np.random.default_rng(seed)
    seq = rng.integers(0, 4, int(rng.integers(1, 300)))
    if seed % 3 == 0:
        seq = np.where(rng.random(3 * len(seq)) < 0.02, 0, np.tile(seq, 3))
    index = FMIndex(seq, 5)
    seq = np.append(seq, 0) if seq[-1] else seq
    for n in (1, 2, 4, 8):
        pats = rng.integers(1, 5, (15, n))
        wide = np.zeros((15, 8), np.int64)
        wide[:, 8 - n :] = pats
        lo, hi = index.search(wide, np.full(15, n))
        for k in range(15):
            want = [i for i in range(len(seq) - n + 1) if (seq[i : i + n] == pats[k]).all()]
            assert sorted(index.locate(np.arange(lo[k], hi[k])).tolist()) == want


def test_suffix_array_orders_zeros_by_position():
    seq = np.array([2, 1, 0, 2, 1, 0, 1, 0])
    keys = {i: [(x, 0) if x else (0, i + k) for k, x in enumerate(seq[i : i + seq[i:].tolist().index(0) + 1])] for i in range(len(seq))}
    assert suffix_array(seq).tolist() == sorted(keys, key=keys.get)


def test_wavelet_rank_and_access():
    seq = np.random.default_rng(0).integers(0, 13, 500)
    wm = WaveletMatrix(seq, 4)
    at = np.arange(501)
    for c in range(13):
        assert (wm.rank(np.full(501, c), at) == np.concatenate([[0], np.cumsum(seq == c)])).all()
    assert (wm.access(np.arange(500)) == seq).all()


def test_subset_sum_is_the_best_sum():
    rng = np.random.default_rng(4)
    for _ in range(150):
        k = int(rng.integers(1, 5))
        lengths, counts, budget = rng.choice(np.arange(1, 15), k, replace=False), rng.integers(0, 4, k), int(rng.integers(0, 60))
        got = mixing.subset_sum(lengths, counts, budget)
        sums = (sum(a * b for a, b in zip(t, lengths)) for t in itertools.product(*[range(c + 1) for c in counts]))
        assert (got <= counts).all() and (got * lengths).sum() == max(s for s in sums if s <= budget)


def test_fit_budget_takes_all_or_nothing_at_the_edges():
    lengths, counts = np.array([3, 5]), np.array([2, 1])
    assert mixing.fit_budget(lengths, counts, 11).tolist() == [2, 1]
    assert mixing.fit_budget(lengths, counts, 0).tolist() == [0, 0]
    assert mixing.fit_budget(lengths, counts, 8).tolist() == [1, 1]


def test_marginals_against_enumeration():
    rng = np.random.default_rng(2)
    trans, init = rng.normal(size=(3, 3)), rng.normal(size=3)
    bounds = np.array([0, 4, 4, 5, 7])
    emit = rng.normal(size=(7, 3))
    got = langid.marginals(emit, bounds, trans, init)
    for b, e in zip(bounds[:-1], bounds[1:]):
        want = np.zeros((e - b, 3))
        for path in itertools.product(range(3), repeat=e - b):
            s = init[path[0]] if path else 0
            s += sum(emit[b + i, y] for i, y in enumerate(path)) + sum(trans[x, y] for x, y in zip(path, path[1:]))
            for i, y in enumerate(path):
                want[i, y] += np.exp(s)
        if e > b:
            assert np.allclose(got[b:e], want / want.sum(axis=1, keepdims=True))


def test_code_switched_words_are_labelled_held_out():
    rng = np.random.default_rng(0)
    syll = {"en": ["th", "ing", "er", "and", "st"], "fr": ["eau", "é", "oi", "que", "ment"], "de": ["sch", "ung", "ver", "ü", "keit"]}
    word = lambda lab: "".join(rng.choice(syll[lab], rng.integers(1, 4)))
    rows = [(lab, " ".join(word(lab) for _ in range(40))) for lab in syll for _ in range(20)]
    model = langid.train(rows, langid.LangConfig(sequences=300, epochs=40))
    gold, words = [], []
    for _ in range(20):
        for lab in rng.permutation(list(syll)):
            span = rng.integers(5, 12)
            gold += [model.labels.index(lab)] * span
            words += [word(lab) for _ in range(span)]
    text = " ".join(words).encode()
    _, post = langid.label_words(model, 16, np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    assert (post.argmax(axis=1) == gold).mean() > 0.93


def test_window_entropy_against_each_window():
    rng = np.random.default_rng(1)
    strings = [bytes(rng.integers(97, 97 + int(rng.integers(1, 20)), int(rng.integers(1, 60))).astype(np.uint8)) for _ in range(60)]
    data = np.frombuffer(b"".join(strings), np.uint8)
    end = np.cumsum([len(s) for s in strings])
    got = secrets.window_entropy(data, end - [len(s) for s in strings], end, 20)

    def bits(s):
        p = np.bincount(np.frombuffer(s, np.uint8)) / len(s)
        return -(p[p > 0] * np.log2(p[p > 0])).sum()

    for s, g in zip(strings, got):
        n = min(20, len(s))
        assert abs(g - max(bits(s[i : i + n]) for i in range(len(s) - n + 1))) < 1e-9


def _lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def test_automaton_against_edit_distance():
    rng = np.random.default_rng(3)
    auto = toxicity.build(toxicity.LEXICON)
    words = []
    for _ in range(800):
        t = list(rng.choice(toxicity.LEXICON))
        for _ in range(rng.integers(0, 4)):
            k, op, c = rng.integers(0, len(t) + 1), rng.integers(3), chr(97 + rng.integers(26))
            if op == 0:
                t.insert(k, c)
            elif k < len(t):
                t[k : k + 1] = [c] if op == 1 else []
        if len(t) >= 3:
            words.append("".join(t))
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    w = tc.words(data, np.array([0, len(data)]))
    term, edits = toxicity.match_words(auto, w.folded, w.start, w.end)
    for x, t, e in zip(words, term, edits):
        near = [(_lev(x[1:], y[1:]), i) for i, y in enumerate(auto.terms) if x[0] == y[0]]
        near = [p for p in near if p[0] <= toxicity.allowed_edits(auto.terms[p[1]])]
        assert (int(e), int(t)) == (min(near) if near else (0, -1)), x


def test_quotation_lowers_and_address_raises_the_score():
    texts = ["what an idi0t here", 'he said: "what an idiot here"', "you are an idiot", 'the word "idiot" is an insult', "idiom and crown", "an idiott walks"]
    scorer, got = toxicity.Scorer(toxicity.ToxicConfig()), {}
    for first, _, d, o in tc.chunks(pa.array(texts)):
        got |= {first + r[0]: r[1] for r in scorer.score(d, o)}
    t = toxicity.ToxicConfig().threshold
    assert got[2] > got[0] >= t > got[1] and t > got[3] and 4 not in got and got[5] >= t


def test_boosting_learns_and_calibrates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    model = gbdt.fit(x[:2000], y[:2000])
    a, b = gbdt.platt(model.raw(x[2000:]), y[2000:])
    p = 1 / (1 + np.exp(-(a * model.raw(x[2000:]) + b)))
    assert ((p > 0.5) == (y[2000:] > 0)).mean() > 0.95


def test_pii_held_out_precision_and_recall():
    cfg = pii.PiiConfig(samples=600)
    model = pii.train(cfg)
    x, y, kind = pii.labelled(cfg, 1234)
    chosen = model.probability(x) >= np.array([model.thresholds[pii.KINDS[k]] for k in kind])
    assert (chosen & (y > 0)).sum() / chosen.sum() > 0.95 and (chosen & (y > 0)).sum() / (y > 0).sum() > 0.95


def test_overlapping_spans_resolve_to_one():
    cfg = pii.PiiConfig()
    got = pii.select("call +1 (017) 555-7713 or mail ana.34@mail7.example.com from 43.21.141.162, card 4111111111111111", pii.train(cfg), cfg)
    assert [k for _, _, k, _ in got] == ["phone", "email", "ip", "card"]


def test_pruning_floor_follows_the_posterior():
    floor = minimum_matches(JaccardConfig())
    assert (np.diff(floor) > 0).all() and floor[-1] < 32


def test_local_forest_keeps_components():
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 60, 40), rng.integers(0, 60, 40)
    child, root = _local_forest(a, b)
    parent = {}

    def find(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        x, y = find(x), find(y)
        parent[max(x, y)] = min(x, y)
    got = dict(zip(child.tolist(), root.tolist()))
    assert all(got.get(x, x) == find(x) for x in set(a.tolist()) | set(b.tolist()))


def test_entropy_of_a_span_of_many_pieces():
    rng = np.random.default_rng(9)
    data = rng.integers(97, 101, 3000).astype(np.uint8)
    data[2047:2067] = np.arange(65, 85)
    got = secrets.window_entropy(data, np.array([0, 5, 40]), np.array([3000, 2066, 300]), 20)

    def bits(s):
        p = np.bincount(s) / len(s)
        return -(p[p > 0] * np.log2(p[p > 0])).sum()

    for (s, e), g in zip(((0, 3000), (5, 2066), (40, 300)), got):
        assert abs(g - max(bits(data[i : i + 20]) for i in range(s, e - 19))) < 1e-9


def test_a_very_long_run_is_scanned_in_a_moment():
    run = base64.b64encode(np.random.default_rng(0).bytes(750_000))
    began = time.process_time()
    found = secrets.scan_chunk(np.frombuffer(run, np.uint8), np.array([0, len(run)]), secrets.SecretConfig())
    assert found[0][1] < 64 and found[-1][2] > len(run) - 64 and time.process_time() - began < 6
