"""Cases in which an operator once did less than its whole job."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from simdex.llm import imatch, jaccard, mixing, pii, toxicity
from simdex.llm import textcore as tc


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def toxic(texts):
    """Score by text of those with a hit."""
    scorer = toxicity.Scorer(toxicity.ToxicConfig())
    return {texts[first + r[0]]: r[1] for first, _, d, o in tc.chunks(pa.array(texts)) for r in scorer.score(d, o)}


def test_wide_automaton_against_plain_edit_distance():
    rng = np.random.default_rng(8)
    auto = toxicity.build(toxicity.LEXICON, first=True)
    words = ["ytupid", "ediot", "diot", "xmoron", "tupid", "scuum"]
    for _ in range(600):
        t = list(rng.choice(toxicity.LEXICON))
        for _ in range(rng.integers(0, 4)):
            k, op, c = int(rng.integers(0, len(t) + 1)) * int(rng.integers(2)), rng.integers(3), chr(97 + rng.integers(26))
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
        near = [p for p in ((distance(x, y), i) for i, y in enumerate(auto.terms)) if p[0] <= toxicity.allowed_edits(auto.terms[p[1]])]
        assert (int(e), int(t)) == (min(near) if near else (0, -1)), x


def test_first_letter_edits_count_in_a_telling_context():
    least = toxicity.ToxicConfig().threshold
    for word in ("ytupid", "ediot", "diot", "xmoron"):
        got = toxic([f"you are {word}", f"that pathetic {word} again", f"the {word} stood there", f"you {'and so on ' * 3} {word}"])
        assert sorted(got) == sorted([f"you are {word}", f"that pathetic {word} again"]) and min(got.values()) >= least
    assert toxic(["you keep it closer", "your rash and your itch", "oron"]) == {}


def test_abusive_plurals_are_terms_and_context_decides_looser():
    abuse = ["you retards", "you imbeciles", "these lowlifes", "what a clow he is", "you looser"]
    got = toxic([*abuse, "a looser knot", "best regards", "rewards for you"])
    assert sorted(got) == sorted(abuse) and min(got.values()) >= toxicity.ToxicConfig().threshold


def quoted_by_scan(line, begin, end):
    """Straight, angle, high and low marks of one line, read from its start."""
    straight, angle, high, low = 0, False, False, False
    for c in line[:begin]:
        straight += c == '"'
        angle = c == "\u00ab" or angle and c != "\u00bb"
        if c == "\u201c":
            low, high = (False, high) if low else (low, True)
        low, high = low or c == "\u201e", high and c != "\u201d"
    rest = line[end:]
    return straight % 2 == 1 and '"' in rest or angle and "\u00bb" in rest or high and "\u201d" in rest or low and "\u201c" in rest


def test_quotation_is_judged_over_the_whole_line():
    long = "and so on it went for a good while " * 12
    texts = [f'he "{long}" went, what an idiot, and "so" on', f'he said "{long} what an idiot {long}" then', f'"a\nwhat an idiot" said', f"x \u201c{long} idiot {long}\u201d y", f"\u201e{long}\u201c idiot \u201ca\u201d"]
    got, t = toxic(texts), toxicity.ToxicConfig()
    assert [got[x] >= t.threshold for x in texts] == [True, False, True, False, True]


def test_quotation_against_a_scan():
    rng = np.random.default_rng(4)
    rows = ["".join(rng.choice(list('a  \n""\u00ab\u00bb\u201c\u201d\u201eé'), rng.integers(0, 40))) for _ in range(300)]
    data, offs = np.frombuffer("".join(rows).encode(), np.uint8), np.cumsum([0, *(len(r.encode()) for r in rows)])
    w = tc.words(data, offs)
    got = toxicity.are_quoted(data, offs, w.start, w.end)
    for s, e, r, q in zip(w.start, w.end, w.row, got):
        text = rows[r].encode()
        s, e = s - offs[r], e - offs[r]
        begin = text.rfind(b"\n", 0, s) + 1
        line = text[begin:].split(b"\n", 1)[0]
        at, to = len(line[: s - begin].decode()), len(line[: e - begin].decode())
        assert q == quoted_by_scan(line.decode(), at, to), (rows[r], s)


def test_scores_do_not_depend_on_the_number_of_candidates():
    calm = "and then nothing of note was said by anyone for a good long while there "
    text = f"{calm}card 4111111111111111 {calm}ssn 123-45-6789 {calm}call +1 (017) 555-7713 {calm}account DE89370400440532013000 {calm}"
    cfg = pii.PiiConfig()
    model, copies = pii.train(cfg), 40
    one, many = pii.select(text, model, cfg), pii.select(text * copies, model, cfg)
    assert len(pii.candidates(text * copies)) > 200 and len(one) >= 3
    assert many == [(b + k * len(text), e + k * len(text), kind, p) for k in range(copies) for b, e, kind, p in one]


def test_overlaps_against_each_pair():
    rng = np.random.default_rng(6)
    for n in (0, 1, 7, 199, 200, 400):
        spans = [(int(b), int(b + w), "card") for b, w in zip(rng.integers(0, 900, n), rng.integers(1, 30, n))]
        assert pii._overlaps(spans) == [sum(o[0] < s[1] and s[0] < o[1] for o in spans) - 1 for s in spans]


def test_exact_copies_of_short_texts_share_a_fingerprint(spark):
    rows = [(1, "Two words"), (2, "two words"), (3, "words two three"), (4, ""), (5, None), (6, "..."), (7, "!?"), (8, "rare vocabulary altogether elsewhere unseen"), (9, "rare vocabulary altogether elsewhere unseen")]
    rows += [(100 + i, f"common text number {i % 7} with enough terms {i % 5} to be known") for i in range(90)]
    docs, cfg = spark.createDataFrame(rows, "doc_id bigint, text string"), imatch.IMatchConfig(least=0.04, most=1.0)
    prints = imatch.fingerprints(docs, cfg, short=True)
    got = {r.doc_id: r for r in prints.collect()}
    assert got[1].sig_short == got[2].sig_short != got[3].sig_short and got[1].sig_short.startswith("short-")
    assert all(got[i].sig_short is None for i in (4, 5, 6, 7, 100)) and got[100].sig0 is not None
    groups = {}
    for r in imatch.duplicate_groups(prints).collect():
        groups.setdefault(r.signature, set()).add(r.doc_id)
    assert {1, 2} in groups.values() and {8, 9} in groups.values()
    assert "sig_short" not in imatch.fingerprints(docs, cfg).columns


def found_and_kept(similarity, size, pairs):
    """Shares of pairs of random sets that meet in a band and survive the pruning, and that survive it."""
    cfg, rng = jaccard.JaccardConfig(), np.random.default_rng(12)
    union = round(2 * size / (1 + similarity))
    common = round(similarity * union)
    own, sets = (union - common) // 2, []
    for _ in range(pairs):
        g = rng.integers(0, 1 << 63, common + 2 * own, dtype=np.uint64)
        sets += [g[: common + own], np.delete(g, np.s_[common : common + own])]
    sig, cut = jaccard.minhash(np.concatenate(sets), np.cumsum([0, *map(len, sets)]), cfg), cfg.bands * cfg.rows
    meet = (sig[:cut, ::2] == sig[:cut, 1::2]).reshape(cfg.bands, cfg.rows, -1).all(axis=1).any(axis=0)
    side = jaccard.compared_bytes(sig[cut:])
    hits = np.cumsum(side[::2] == side[1::2], axis=1)[:, cfg.step - 1 :: cfg.step]
    kept = (hits >= jaccard.minimum_matches(cfg)).all(axis=1)
    return (meet & kept).mean(), kept.mean()


def test_pruning_drops_dissimilar_pairs_and_keeps_recall():
    for size in (100, 400, 1000):
        assert found_and_kept(0.0, size, 200)[1] == 0
        assert found_and_kept(0.2, size, 300)[1] < 0.15
        assert found_and_kept(0.5, size, 1200)[0] > 0.9


def test_no_group_vanishes_where_an_id_has_two_texts(spark, tmp_path):
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in ("left", "right"))
    rows = [(5, a), (5, b), (5, b), (7, a), (3, b), (9, "alone in this table"), (5, "..."), (None, a)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = [tuple(r) for r in corpus_pipeline.deduplicate(spark, docs, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted([(5, a), (3, b), (9, rows[5][1]), (5, "..."), (None, a)], key=str)


def test_disguised_terms_are_found():
    abuse = ["what an i d i o t he is", "what an i.d.i.o.t he is", "a stu-pid thing", "stupiiiid stuff", "such an іdiоt", "mo_ron at work"]
    assert sorted(toxic([*abuse, "a i b c d e plan", "pre-id check", "well-off mo ron", "aaaargh"])) == sorted(abuse)


def labelled(n, seed):
    """Documents in an invented language: toxic ones hold two or three of its abuse words, any may hold one by chance."""
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(["ba", "ko", "ri", "mu", "té", "lo", "sa", "zi"], 3))
    bad = ["grovaxi", "plontér", "skrimul", "vrekato", "drunfle", "klaspor"]
    rows = []
    for i in range(n):
        text = [word() for _ in range(40)]
        toxic = int(i % 5 == 0)
        for b in rng.choice(bad, rng.integers(2, 4), replace=False) if toxic else rng.choice(bad, 1) if rng.random() < 0.02 else []:
            text.insert(int(rng.integers(len(text))), str(b))
        rows.append((i, " ".join(text), toxic))
    return rows


def test_terms_are_learned_from_labels_and_hold_on_other_documents(spark):
    rows = labelled(900, 1)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, t) for i, _, t in rows if i < 600] + [(None, 1), (7, None), (10**9, 1)], "doc_id bigint, toxic int").withColumn("text", F.lit("clash"))
    got = {r.doc_id: r for r in toxicity.find_toxic(docs, labels).collect()}
    other = [(i, t) for i, _, t in rows if i >= 600]
    caught = [i in got for i, t in other if t]
    wrong = [i in got for i, t in other if not t]
    assert np.mean(caught) > 0.95 and np.mean(wrong) < 0.03
    assert {t for r in got.values() for t in r.terms} <= {"grovaxi", "plontér", "skrimul", "vrekato", "drunfle", "klaspor"}
    assert {r.doc_id: r for r in toxicity.find_toxic(docs, labels.repartition(5)).collect()} == got
    flood = docs.unionByName(docs.where("doc_id = 3").crossJoin(spark.range(400).select(F.col("id").alias("n"))).select("doc_id", F.concat("text", F.lit(" grovaxi "), F.col("n").cast("string")).alias("text")))
    assert len(toxicity.learn(flood, labels).terms) >= 5  # texts of one id are one document


def test_quoted_learned_terms_prove_less(spark):
    learned = toxicity.Learned(["grovaxi", "skrimul"], np.sort(np.array([tc.word_hash(x) for x in ("grovaxi", "skrimul")], np.uint64)), np.array([[4.0, 4.0]]), np.zeros(0, np.uint64), np.array([1.0, 0.0, -5.0]), 0.5)
    scorer = toxicity.Scorer(toxicity.ToxicConfig(), learned)
    score = lambda text: next((r[1] for _, _, d, o in tc.chunks(pa.array([text])) for r in scorer.score(d, o)), 0.0)
    t = toxicity.ToxicConfig().threshold
    assert score("grovaxi and skrimul here") >= t > score('he said "grovaxi and skrimul" here')
    assert score("a grovaxi " * 9) < t and score("grovaxo and skrimul here") >= t > score("grovaxo " + "and so on " * 9 + "skrimulo")


def test_toxicity_without_usable_labels(spark):
    docs = spark.createDataFrame([(1, "you are an idiot"), (2, None), (3, ""), (None, "calm")], "doc_id bigint, text string")
    for rows in ([], [(1, 1)], [(2, 0), (3, 1)], [(9, 0), (8, 1)]):
        labels = spark.createDataFrame(rows, "doc_id bigint, toxic int")
        assert [r.doc_id for r in toxicity.find_toxic(docs, labels).collect()] == [1]
    empty = docs.limit(0)
    assert toxicity.find_toxic(empty, spark.createDataFrame([(1, 1), (2, 0)], "doc_id bigint, toxic int")).collect() == []


#: Written by hand, apart from the generator that the trees learn from: text, kind and span (None: nothing to find).
PII_BY_HAND = [
    ("reach 4111 1111 1111 1111 now", "card", "4111 1111 1111 1111"), ("She paid with her Visa, 4539 5787 6362 1486, on Friday.", "card", "4539 5787 6362 1486"), ("Amex: 378282246310005.", "card", "378282246310005"), ("5500-0000-0000-0004 expires soon", "card", "5500-0000-0000-0004"),
    ("Order 4111 1111 1111 1112 shipped", None, None), ("tracking 1234567890123456", None, None), ("ISBN 978-3-16-148410-0", None, None),
    ("Call me at 555-867-5309 tonight", "phone", "555-867-5309"), ("tel. 030 12345678", "phone", "030 12345678"), ("Tel: +49 30 901820", "phone", "+49 30 901820"), ("ring 020 7946 0958 after six", "phone", "020 7946 0958"), ("(212) 555-0187", "phone", "(212) 555-0187"),
    ("2023-04-05 at 10:30", None, None), ("pages 100-200", None, None), ("in 1999 2000 2001", None, None), ("room 12 345", None, None), ("it cost $1,234,567.89", None, None), ("a sum of 45 000 euros", None, None),
    ("connect to 192.168.1.24 please", "ip", "192.168.1.24"), ("blocked IP 8.8.8.8 again", "ip", "8.8.8.8"), ("version 10.2.3.4 of it", None, None), ("127.0.0.1 is local", None, None), ("999.12.400.1 is none", None, None),
    ("SSN 078-05-1120 on file", "ssn", "078-05-1120"), ("her number, 219-09-9999, leaked", "ssn", "219-09-9999"), ("part 123 45 6789", None, None),
    ("IBAN GB82 WEST 1234 5698 7654 32", "iban", "GB82 WEST 1234 5698 7654 32"), ("pay to DE89370400440532013000 by May", "iban", "DE89370400440532013000"), ("FR14 2004 1010 0505 0001 3M02 606", "iban", "FR14 2004 1010 0505 0001 3M02 606"), ("GB82 WEST 1234 5698 7654 33", None, None),
    ("mail bob@example.com please", "email", "bob@example.com"), ("contact: maria.lopez-garcia@correo.es.", "email", "maria.lopez-garcia@correo.es"), ("user@localhost", None, None), ("the handle is @someone", None, None),
]


def test_pii_of_texts_written_by_hand():
    cfg = pii.PiiConfig()
    model = pii.train(cfg)
    true = {(t, k, s) for t, k, s in PII_BY_HAND if k}
    found = {(t, k, t[b:e]) for t, _, _ in PII_BY_HAND for b, e, k, _ in pii.select(t, model, cfg)}
    assert len(found & true) / len(found) >= 0.95 and len(found & true) / len(true) >= 0.9


def test_pii_query_against_brute_force(spark):
    cfg = pii.PiiConfig()
    model = pii.train(cfg)
    texts = [" and then ".join(t for t, _, _ in PII_BY_HAND[k : k + 3]) for k in range(len(PII_BY_HAND))] + [None, "", "é " * 2000 + PII_BY_HAND[0][0], "+1 (017) 555-7713, +1 (017) 555-7713"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (None, texts[1])]
    want = []
    for i, t in rows:
        spans = list(dict.fromkeys((m.start(), m.end(), name.split(":")[0]) for name, rx in pii.GENERATORS.items() for m in rx.finditer(t or "")))
        scored = []
        for s in spans:
            others = sum(o is not s and o[0] < s[1] and s[0] < o[1] for o in spans)
            p = float(model.probability(np.array([pii.features(t, s, others, cfg.context)]))[0])
            if p >= model.thresholds[s[2]]:
                scored.append((-p, s[0], -s[1], s[2]))
        left = sorted(scored)
        while left:
            p, b, e, k = left.pop(0)
            want.append((i, b, -e, k, round(-p, 6)))
            left = [o for o in left if o[1] >= -e or -o[2] <= b]
    got = [tuple(r) for r in pii.find_pii(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and len(got) > 40


def test_budgets_of_any_size_are_fitted_alike():
    rng = np.random.default_rng(10)
    for budget_share in (0.001, 0.01, 0.1, 0.5, 0.9, 0.999):
        lengths = np.sort(rng.choice(np.arange(3, 9000), 700, replace=False))
        counts = rng.integers(1, 6, 700)
        total = int((lengths * counts).sum())
        take = mixing.fit_budget(lengths, counts, int(total * budget_share))
        assert (take >= 0).all() and (take <= counts).all()
        short = int(total * budget_share) - (take * lengths).sum()
        assert short == 0 if budget_share <= 0.9 else 0 <= short < 100  # hardly a document is left out
        if 0.05 < budget_share < 0.95:
            long = lengths > 4500
            share = [(take * lengths)[x].sum() / (counts * lengths)[x].sum() for x in (long, ~long)]
            assert abs(share[0] - share[1]) < 0.1
    even = mixing.fit_budget(np.array([4, 6, 10]), np.array([50, 50, 50]), 333)
    assert (even * [4, 6, 10]).sum() == 332


@pytest.mark.parametrize("bin", [2, 7, 1000])
def test_draw_against_a_sort(spark, bin):
    rows = [(i % 40 if i % 3 else None if i % 2 else 7, "ab"[i % 5 == 0], 5 + i % 3) for i in range(300)]
    counted = spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint")
    size = {(s, n): sum(r[1:] == (s, n) for r in rows) for _, s, n in rows}
    take = {k: v * (j + 1) // (len(size) + 1) for j, (k, v) in enumerate(sorted(size.items()))}
    cfg = mixing.MixConfig(bin=bin)
    quota = spark.createDataFrame([(s, n, size[s, n], t, -(-size[s, n] // bin)) for (s, n), t in take.items() if t], "source string, n_tokens bigint, n bigint, take bigint, bins bigint")
    hashed = {r.doc_id: r.h for r in counted.select("doc_id", F.xxhash64(F.col("doc_id").cast("string"), F.lit(cfg.seed)).alias("h")).distinct().collect()}
    want = []
    for (s, n), t in take.items():
        own = sorted((r for r in rows if r[1:] == (s, n)), key=lambda r: (hashed[r[0]], r[0] is not None, r[0] or 0))
        want += own[:t]
    got = [tuple(r) for r in mixing.draw(counted, quota, cfg).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
