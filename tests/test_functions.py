import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from simdex.functions import canon, codec, encode, lens
from simdex.functions import similarity as S
from simdex.operators import stage2

GOLDEN = {
    "": "00" * 48,
    "a": "0000000000000600000000000000000300060012000000000000000100020000a2000000000051000000120036000000",
    "ab": "000000000000085100001b06000000000000020001a200000000000200033600000000000000010000000c0000000000",
    "   ": "000012001b0002000000000012000002000000000000001200000000001e0000000000020000000000002a0000000000",
    "hello world": "c00f1c0ad8341254081501b4a2a80016271d08066d1b03b4000f0001134806391b5c096c51000000000036a400d80000",
    "café": "0000a7a2000606061b00150a0100035109000009510b360000001b000000000000360200005100000000000100000036",
    "the quick brown fox": "74836d24b63202533613531e59876cc7361c1e2d5a4641e154871c6f09135468b388a247000009a5a251a25151060263",
}


def literal(text: str) -> np.ndarray:
    """The encoding, a byte and a gram at a time."""
    raw = bytes((b & 127) + 32 * (65 <= (b & 127) <= 90) for b in text.encode())
    out = np.zeros(240, int)

    def add(chain, gram, seed, k):
        for i in range(k):
            h = encode.fnv1a_32(gram, (seed + i * encode.GOLDEN) & 0xFFFFFFFF)
            out[60 * chain + h % 60] += (h >> 16) % 2 + 1

    if raw:
        for chain, n, seed, k in encode.GRAMS:
            if len(raw) >= n:
                for i in range(len(raw) - n + 1):
                    add(chain, raw[i : i + n], seed, k)
            elif n > 2:
                add(chain, raw, seed, k)
        for w in [w for w in raw.translate(bytes(32 if c in b"\t\n\r" else c for c in range(256))).split(b" ") if w] or [raw]:
            add(3, w, encode.SEED_WORD, 3)
    return out % 3


@pytest.mark.parametrize("text", GOLDEN)
def test_golden_vectors(text):
    assert codec.pack5(encode.encode_text(text)).hex() == GOLDEN[text]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40), min_size=1, max_size=4))
def test_batches_match_the_literal_encoding(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    planes = encode.batch_planes(pa.array([*texts, None]))
    assert (encode.trits_of(planes)[:-1] == [literal(t) for t in texts]).all() and not planes[-1].any()


def flat(a, b):
    x, y = encode.encode_text(a).astype(float), encode.encode_text(b).astype(float)
    n = np.sqrt((x * x).sum() * (y * y).sum())
    return float(x @ y / n) if n else 0.0


RANGES = [
    ("cat bat dog fog run fun hat bat pen ten", 0.15, 0.55), ("cat cot dog dig run ran hat hot pen pin", 0.05, 0.45), ("cat car dog dot run rum hat had pen peg", 0.10, 0.55),
    ("cat gym dog few hat fly pen gym bad joy", 0.0, 0.2), ("cat cats cat catch run running hello helloworld test testing", 0.25, 0.75), ("a b x y z a", 0.0, 0.35),
    ("12345 54321", 0.0, 0.8), ("12345 12346 555-1234 5551234", 0.3, 0.95), ("12345 abcde", 0.0, 0.3),
]


@pytest.mark.parametrize("words,lo,hi", RANGES)
def test_similarity_ranges(words, lo, hi):
    w = words.split()
    for a, b in zip(w[::2], w[1::2]):
        assert lo <= flat(a, b) <= hi and abs(flat(a, b) - flat(b, a)) < 1e-12


def pair_frame(spark, pairs):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "id int, a string, b string")
    left = encode.add_planes(df, "a").alias("a")
    return left.join(encode.add_planes(df, "b").alias("b"), F.expr("a.id = b.id"))


def numpy_chain(x, y):
    n = np.sqrt((x * x).sum() * (y * y).sum())
    return x @ y / n if n else 0.0


def test_published_similarities(spark):
    want = {
        ("the cat sat", "the cat sits"): (0.800095, 0.868107, 0.749649, 0.707107, 0.792393, 0.765171, 47),
        ("hello world", "hello there"): (0.617907, 0.522457, 0.34963, 0.617213, 0.53251, 0.530421, 69),
        ("calculateTotal", "calculate_total"): (0.910854, 0.811594, 0.593442, 0.444444, 0.776927, 0.637436, 43),
        ("cat", "bat"): (0.549972, 0, 0, 0, 0.292238, 0.101847, 26),
    }
    exprs = [*(S.chain_cosine("a.", "b.", c) for c in range(4)), S.flat_cosine("a.", "b."), S.lens_cosine("a.", "b."), S.hamming("a.", "b.")]
    rows = pair_frame(spark, list(want)).select("a.id", *(F.expr(x) for x in exprs)).orderBy("id").collect()
    for r, w in zip(rows, want.values()):
        assert np.allclose(r[1:], w, atol=1e-6)


def test_expressions_against_numpy(spark):
    pairs = [("the cat", "the dog"), ("", "x"), ("", ""), ("same", "same"), ("naïve café", "cafe naive"), ("a b c d e", "e d c b a")]
    lw = np.array(lens.LENSES["legal"])
    idf = np.array(lens.STATIC_IDF)
    mask = tuple(int(m) for m in np.random.default_rng(0).integers(0, 1 << 60, 4))
    exprs = [S.lens_cosine("a.", "b.", "legal"), S.idf_cosine("a.", "b."), S.idf_lens_joint("a.", "b.", "legal"), S.idf_lens_chain("a.", "b.", "legal"), S.centered_cosine("a.", "b."), S.centered_cosine("a.", "b.", masks=mask), S.calibrated(S.flat_cosine("a.", "b."), "a.", "b."), S.lens_bound("a.", "b.", "legal")]
    rows = pair_frame(spark, pairs).select("a.id", *(F.expr(x).cast("double") for x in exprs)).orderBy("id").collect()

    def weighted(x, y, w):
        d = np.sqrt((w * x * x).sum()) * np.sqrt((w * y * y).sum())
        return min((w * x * y).sum() / d, 1.0) if d >= 1e-12 else 0.0

    for r, (a, b) in zip(rows, pairs):
        x, y = encode.encode_text(a).astype(float), encode.encode_text(b).astype(float)
        cos = np.array([numpy_chain(x[60 * c : 60 * c + 60], y[60 * c : 60 * c + 60]) for c in range(4)])
        chain = np.array([weighted(x[60 * c : 60 * c + 60], y[60 * c : 60 * c + 60], idf[60 * c : 60 * c + 60]) for c in range(4)])
        on = np.array([mask[i // 60] >> (i % 60) & 1 for i in range(240)], bool)
        fa, fb = (x > 0).mean(), (y > 0).mean()
        flat_ = numpy_chain(x, y)
        want = [cos @ lw / lw.sum(), weighted(x, y, idf), weighted(x, y, idf * np.repeat(lw, 60)), chain @ lw / lw.sum(), numpy_chain(x - 1, y - 1), numpy_chain((x - 1)[on], (y - 1)[on]), min(1.0, flat_ / np.sqrt(max(fa, 0.05) * max(fb, 0.05)))]
        assert np.allclose(r[1:8], want, atol=1e-9)
        assert r[8] >= want[0] - 1e-12


def test_blends_against_numpy(spark):
    gate = stage2.Model(stage2.random_projection(3), "diagonal")
    planes = stage2.gate_planes(gate)
    df = spark.createDataFrame([(0, "the cat sat"), (1, "the dog sat down")], "id int, text string")
    enc = encode.add_planes(df).drop("text")
    g = enc.select("id", *(c.alias(n) for n, c in planes.items()))
    buckets = tuple(i / 10 for i in range(10))
    exprs = [S.chain_blend("a.", "b.", "x.", "y.", (0.1, 0.2, 0.3, 0.4)), S.adaptive_blend("a.", "b.", "x.", "y.", buckets)]
    joined = enc.where("id = 0").alias("a").crossJoin(enc.where("id = 1").alias("b")).crossJoin(g.where("id = 0").alias("x")).crossJoin(g.where("id = 1").alias("y"))
    got = joined.select(*(F.expr(x) for x in exprs)).first()
    a, b = (encode.encode_text(t).astype(float) for t in ("the cat sat", "the dog sat down"))
    x, y = (gate.encode(v.astype(np.uint8))[0].astype(float) for v in (a, b))
    part = lambda u, v, c: numpy_chain(u[60 * c : 60 * c + 60] - 1, v[60 * c : 60 * c + 60] - 1)
    chain = np.mean([w * part(a, b, c) + (1 - w) * part(x, y, c) for c, w in enumerate((0.1, 0.2, 0.3, 0.4))])
    f = numpy_chain(a, b)
    al = buckets[min(9, int(f * 10))]
    assert np.allclose(got, [chain, al * f + (1 - al) * numpy_chain(x - 1, y - 1)])


CANON = [
    ("general", "  hello   world  ", "hello world"), ("support", "error on 2024-01-15 at server", "error on at server"), ("support", "req 550e8400-e29b-41d4-a716-446655440000 failed", "req failed"),
    ("support", "error code 12345 on port 8080", "error code <N> on port <N>"), ("code", "calculateTotalAmount", "calculate total amount"), ("code", "calculate_total_amount", "calculate total amount"),
    ("none", "  hello   world  ", "  hello   world  "), ("policy", "db timeout after 30 seconds", "db timeout after <N> seconds"), ("code", "HTMLParser", "htmlparser"), ("support", "at 12:30:59 t=1700000000 x1700000000 112024-01-15", "at t= x<N> <N>-<N>-<N>"),
    ("support", "2024-01-15T10:00:00+02:00 up", "up"),
]


@pytest.mark.parametrize("preset,text,want", CANON)
def test_canonical_forms(spark, preset, text, want):
    df = spark.createDataFrame([(text,), (None,)], "t string")
    got = [r[0] for r in df.select(canon.canon(F.col("t"), preset)).collect()]
    assert got == [want, None] and canon.preset_name(canon.PRESETS[preset]) == preset.upper()


def test_lens_parsing():
    assert lens.parse_lens("0.1, 0.2,0.3,0.4") == (0.1, 0.2, 0.3, 0.4)
    for bad in ("nope", "1,2,3", (1, 2, 3), (1, 1, 1, -1)):
        with pytest.raises(ValueError):
            lens.parse_lens(bad)
    assert len(lens.STATIC_IDF) == 240


def test_static_weights_follow_their_grams():
    hits = np.zeros(240, int)
    groups = ((1, encode.SEED_TRIPLE, "the and ing ion ent tio for ate tha ter hat ere ati her all ver his tion ons men ith ted ers pro ess sta com est not rea".split()), (3, encode.SEED_WORD, "the be to of and a in that have i it for not on with he as you do at this but his by from they we say her she".split()))
    for chain, seed, grams in groups:
        for g in grams:
            for k in range(3):
                hits[60 * chain + encode.fnv1a_32(g.encode(), (seed + k * encode.GOLDEN) & 0xFFFFFFFF) % 60] += 1
    for chain, base in ((1, 1.0), (3, 1.5)):
        part = slice(60 * chain, 60 * chain + 60)
        assert np.allclose(np.round(base / (1 + hits[part]), 4), lens.STATIC_IDF[part])


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=240, max_size=240))
def test_packing_round_trips(trits):
    t = np.array(trits, np.uint8)
    assert (codec.unpack5(codec.pack5(t)) == t).all() and (codec.unpack2(codec.pack2(t), 240) == t).all()
    assert (encode.trits_of(encode.planes_of(t[None]))[0] == t).all() and codec.valid2(codec.pack2(t), 240)
    assert not codec.valid2(b"\xff" * 60, 240) and not codec.valid2(b"", 1) and codec.pack_size(9) == 3


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet=st.characters(max_codepoint=127), max_size=20))
def test_positional_round_trip(text):
    back, cut = codec.positional_decode(codec.positional_encode(text.encode()))
    assert text.startswith(back) and (len(text) > 12 or (back == text and not cut))


def test_positional_structure():
    v = codec.positional_encode(b"Cat 7x").reshape(4, 12, 5)
    assert v[3, 0].tolist() == [0, 1, 1, 0, 1] and v[3, 1].tolist() == [0, 0, 0, 1, 0] and v[3, 4].tolist() == [1, 1, 2, 0, 2]
    assert codec.overflow_hash(b"abcdefghijkl") == 0 and codec.overflow_hash(b"abcdefghijklm") == encode.fnv1a_32(b"lm", 0, 255)
