"""Whole query results against slow versions written from the definitions."""

import itertools
import math
import re

import numpy as np
from pyspark.sql import functions as F

from simdex.llm import chat, langid, mixing, secrets, tokens, toxicity
from simdex.llm import textcore as tc

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def test_conversations_turn_by_turn(spark):
    rng = np.random.default_rng(5)
    bits = ["hello", "<|im_end|>", "<\\|x", " é ñ", "\n", "", "word " * 50, "<|endoftext|>", "\\", "日本"]
    rows = [(int(c), int(t), ["user", "assistant", "system", None][rng.integers(4)], "".join(rng.choice(bits, 3)) if rng.random() < 0.9 else None) for c in range(25) for t in rng.permutation(6)]
    rows += [(3, None, "assistant", "no number"), (4, 2, "assistant", "twice"), (4, 2, "assistant", "twice"), (None, 1, "user", "lost")]
    cfg, enc = chat.ChatConfig(), tokens.byte_bpe()
    want = {}
    for conv in sorted({r[0] for r in rows if r[0] is not None}):
        ids, mask = [], []
        order = sorted((r for r in rows if r[0] == conv), key=lambda r: tuple((x is not None, x or ("" if isinstance(x, str) else 0)) if x is not None else (False, 0) for x in r[1:]))
        for _, _, role, text in order:
            for part, own in (([cfg.start], 0), (enc.encode_ordinary(chat.escape(role or "unknown")), 0), (enc.encode_ordinary("\n"), 0), ([*enc.encode_ordinary(chat.escape(text or "")), cfg.end], int(role == "assistant")), (enc.encode_ordinary("\n"), 0)):
                ids += part
                mask += [own] * len(part)
        ids.append(cfg.stop)
        mask.append(0)
        want[conv] = (len(order), len(ids), sum(mask), ids, mask)
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(3)
    got = {r.conv_id: tuple(r)[1:] for r in chat.format_conversations(df).collect()}
    assert got == want


def bits_of(s):
    return -sum(s.count(c) / len(s) * math.log2(s.count(c) / len(s)) for c in set(s))


def secrets_of(text, cfg):
    found = []
    for cls in cfg.classes:
        for m in re.finditer(f"[{re.escape(cls.chars)}]+", text):
            s = m.group()
            mixed = re.search("[0-9]", s) and re.search("[a-zA-Z]", s) or cls.name == "upper" and s[:4] in ("AKIA", "ASIA")
            if len(s) < cls.least or not mixed:
                continue
            n = min(cfg.window, len(s))
            bits = max(bits_of(s[i : i + n]) for i in range(len(s) - n + 1))
            lead = text[max(0, m.start() - cfg.context) : m.start()]
            if bits < cls.bits or cls.name == "assigned" and not secrets.ASSIGNED.search(lead) or any(re.fullmatch(p, s) for p in cfg.allow) or any(re.search(p, lead) for p in cfg.allow_before):
                continue
            end = m.end()
            while cls.name == "base64" and end < min(m.end() + 2, len(text)) and text[end] == "=":
                end += 1
            found.append([m.start(), end, cls.name, bits])
    out = []
    for b, e, k, bits in sorted(found, key=lambda f: (f[0], -f[1])):
        if out and b < out[-1][1]:
            out[-1] = [out[-1][0], max(out[-1][1], e), out[-1][2], max(out[-1][3], bits)]
        else:
            out.append([b, e, k, bits])
    return out


def test_secrets_of_a_table(spark):
    rng = np.random.default_rng(6)
    draw = lambda chars, n: "".join(rng.choice(list(chars), n))
    hexa, b64 = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    parts = lambda: [
        draw(hexa, 40), draw(b64, 44) + "==", "commit " + draw(hexa, 40), "password=" + draw(hexa, 16), "AKIA" + draw("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16), "x" * 30 + "1", "your_api_key_" + draw(b64[:62], 20),
        draw(hexa, 8) + "-" + "-".join(draw(hexa, 4) for _ in range(3)) + "-" + draw(hexa, 12), "é ordinary words", "1234567890" * 4, draw("ab1", 40), "token: '" + draw(b64[:62], 12) + "'", draw(b64[:62] + "_-", 25),
    ]
    rows = [(i, " ".join(rng.choice(parts(), 4))) for i in range(120)] + [(500, "y " + draw(b64, 3000)), (501, ""), (502, None), (None, draw(hexa, 32)), (0, draw(hexa, 32)), (0, draw(hexa, 32))]
    cfg = secrets.SecretConfig()
    want = [(i, b, e, k, round(bits, 6)) for i, t in rows for b, e, k, bits in secrets_of(t or "", cfg)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = [tuple(r) for r in secrets.find_secrets(df).collect()]
    near = lambda x: sorted(((*r[:4], round(r[4], 4)) for r in x), key=str)
    assert near(got) == near(want) and len(got) > 100


def best_sums(lengths, counts, budget):
    """The sums that bounded counts reach."""
    sums = {0}
    for n, c in zip(lengths, counts):
        sums = {s + k * n for s in sums for k in range(c + 1) if s + k * n <= budget}
    return max(sums)


def test_mixture_of_a_table(spark):
    rng = np.random.default_rng(7)
    words = "the of and ring stone river window cloud".split()
    rows = [(int(i), " ".join(rng.choice(words, rng.integers(1, 40))), "en", "abc"[min(2, int(i) % 5)], 0) for i in range(260)]
    rows += [(int(i), "same text of a copy", "en", "c", 0) for i in range(300, 420)] + [(301, "same text of a copy", "en", "c", 0)] * 3 + [(None, "same text of a copy", "en", "c", 0)] * 5 + [(600, None, "en", "a", 0), (601, "", "en", "a", 0), (602, "x", "en", None, 0)]
    enc, cfg = tokens.byte_bpe(), mixing.MixConfig(fraction=0.4, bin=10)
    usable = [(i, s, len(enc.encode_ordinary(t))) for i, t, _, s, _ in rows if t and s]
    goal = int(sum(n for _, _, n in usable) * cfg.fraction) // 3
    df = spark.createDataFrame(rows, DOCS)
    hashed = {r.doc_id: r.h for r in df.select("doc_id", F.xxhash64(F.col("doc_id").cast("string"), F.lit(cfg.seed)).alias("h")).distinct().collect()}
    got = [tuple(r) for r in mixing.mix_sources(df.repartition(3), cfg).collect()]
    for s in "abc":
        own = [r for r in usable if r[1] == s]
        taken = [r for r in got if r[1] == s]
        assert sum(n for _, _, n in taken) == min(sum(n for _, _, n in own), best_sums(*np.unique([n for _, _, n in own], return_counts=True), goal))
        for n in {n for _, _, n in own}:
            ranked = sorted((r for r in own if r[2] == n), key=lambda r: (hashed[r[0]], r[0] is not None, r[0] or 0))
            chosen = [r for r in taken if r[2] == n]
            assert sorted(chosen, key=str) == sorted(ranked[: len(chosen)], key=str)


def test_languages_of_a_table(spark):
    syll = {"en": ["th", "ing", "er", "and", "st"], "fr": ["eau", "é", "oi", "que", "ment"], "de": ["sch", "ung", "ver", "ü", "keit"]}
    rng = np.random.default_rng(0)
    word = lambda lab: "".join(rng.choice(syll[lab], rng.integers(1, 4)))
    rows = [(i, " ".join(word(lab) for _ in range(30)), lab, "s", 0) for i, lab in enumerate(itertools.islice(itertools.cycle(syll), 60))]
    rows += [(100 + i, " ".join(word(lab) for lab in rng.choice(list(syll), 3) for _ in range(8)), None, "s", 0) for i in range(20)] + [(200, None, "en", "s", 0), (201, "", "de", "s", 0), (202, "?!", None, "s", 0), (None, word("en"), None, "s", 0)]
    df, cfg = spark.createDataFrame(rows, DOCS).repartition(3), langid.LangConfig(sequences=200, epochs=30)
    model = langid.fit(df, cfg)
    known = {int(h): w for h, w in zip(model.lexicon, model.lexicon_weights)}
    got = {r.doc_id: r for r in langid.identify_languages(df, cfg).collect()}
    for i, text, _, _, _ in rows:
        ws = re.findall(r"\w+", (text or "").lower())
        if not ws:
            assert (got[i].lang, got[i].n_words, got[i].kept) == (None, 0, False)
            continue
        emit = []
        for w in ws:
            raw = np.frombuffer(w.encode(), np.uint8)
            ids, _ = langid.word_features(raw, np.array([0]), np.array([len(raw)]), cfg.bits)
            emit.append(model.weights[ids].sum(axis=0) + known.get(tc.word_hash(w), 0))
        k = len(model.labels)
        fwd = [emit[0] + model.initial]
        for e in emit[1:]:
            fwd.append(e + np.array([np.logaddexp.reduce(fwd[-1] + model.transition[:, y]) for y in range(k)]))
        bwd = [np.zeros(k)]
        for e in emit[:0:-1]:
            bwd.insert(0, np.array([np.logaddexp.reduce(model.transition[y] + e + bwd[0]) for y in range(k)]))
        post = np.exp([f + b - np.logaddexp.reduce(f + b) for f, b in zip(fwd, bwd)])
        mean, top = post.mean(axis=0), post.argmax(axis=1)
        assert got[i].lang == model.labels[mean.argmax()] and abs(got[i].share - mean.max()) < 1e-4
        assert got[i].n_words == len(ws) and got[i].n_switches == int((top[1:] != top[:-1]).sum()) and got[i].kept == bool(mean.max() >= cfg.min_share)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def test_toxicity_of_a_table(spark):
    cfg, rng = toxicity.ToxicConfig(), np.random.default_rng(11)
    vocabulary = ["the", "you", "calm", "river", "idiot", "idoit", "morons", "stupid", "stupit", "loser", "closer", "scum", "said", "word", "worthless", "worthles", "degenerat", "pathetic", "and", "stone", "ediot", "looser", "your"]
    rows = [(i, " ".join(rng.choice(vocabulary, 14, p=[0.2 if w == "the" else 0.8 / 22 for w in vocabulary]))) for i in range(150)] + [(900, None), (901, ""), (0, "you idiot"), (None, "you idiot")]
    ordinary, second, address = set(cfg.ordinary), set(toxicity.SECOND_PERSON), set(toxicity.SECOND_PERSON) - toxicity.FAINT

    def nearest(w, first):
        best = [(distance(w, t), i) for i, t in enumerate(sorted(set(cfg.lexicon))) if first or w[0] == t[0]]
        if not first:
            best = [(distance(w[1:], t[1:]), i) for i, t in enumerate(sorted(set(cfg.lexicon))) if w[0] == t[0]]
        best = [(d, i) for d, i in best if d <= toxicity.allowed_edits(sorted(set(cfg.lexicon))[i])]
        return min(best) if best else None

    want = {}
    for i, text in rows:
        ws = (text or "").split()
        hits = {}
        for k, w in enumerate(ws):
            if len(w) < 3:
                continue
            sure = nearest(w, False)
            near = sure or nearest(w, True)
            if near and not (w in ordinary and near[0]):
                hits[k] = (near[0], sure is None or w in toxicity.EITHER)
        certain = {k for k, (_, weak) in hits.items() if not weak}
        around = lambda k: range(max(0, k - cfg.window), min(len(ws), k + cfg.window + 1))
        hits = {k: h for k, h in hits.items() if not h[1] or any(ws[j] in address or j in certain for j in around(k))}
        scores = []
        for k, (edits, _) in hits.items():
            s = cfg.own[edits] + cfg.neighbour * (sum(j in hits for j in around(k)) - 1) + cfg.second_person * any(ws[j] in second for j in around(k))
            scores.append(s * (cfg.mention if any(ws[j] in toxicity.MENTION for j in around(k)) else 1))
        if scores and round(max(scores), 6) >= cfg.threshold:
            want.setdefault(i, []).append((round(max(scores), 6), len(hits)))
    got = {}
    for r in toxicity.find_toxic(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect():
        got.setdefault(r.doc_id, []).append((r.score, r.n_hits))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()} and len(got) > 50
