import hashlib
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftgraph.llm import bpe, centroids, negatives, vectors

VECTORS = "vec_id long, embedding array<double>, label int"


def table(df):
    return [r.asDict() for r in df.collect()]


def whole(v):
    return [math.floor(x * 256) if abs(x) < 2**53 else int(x) * 256 for x in v]


# --- exact products


@pytest.mark.parametrize("size", [2.0**8, 2.0**24, 2.0**30, 2.0**70])
def test_products_are_exact_at_any_magnitude(size):
    rng = np.random.default_rng(3)
    a, b = np.floor(rng.normal(size=(7, 5)) * size), np.floor(rng.normal(size=(4, 5)) * size)
    ints = lambda m: [[int(x) for x in r] for r in m]
    assert [[int(x) for x in r] for r in vectors.dot(a, b)] == [[sum(x * y for x, y in zip(r, c, strict=True)) for c in ints(b)] for r in ints(a)]
    want = [[sum((x - y) ** 2 for x, y in zip(r, c, strict=True)) for c in ints(b)] for r in ints(a)]
    assert [[int(x) for x in r] for r in vectors.squared_distances(a, b)] == want
    at, low = centroids.nearest(np.vstack([a, b / size]), b)
    assert [(int(x), int(y)) for x, y in zip(at[:7], low[:7], strict=True)] == [(r.index(min(r)), min(r)) for r in want]


def test_integer_rows():
    got = vectors.integer_rows(pa.array([[0.5, -0.001], [], [3.0]], pa.list_(pa.float32())), 256)
    assert got.tolist() == [[128, -1], [0, 0], [768, 0]]
    assert vectors.integer_rows(pa.array([[1e306]], pa.list_(pa.float64())), 256).tolist() == [[int(1e306) * 256]]
    assert vectors.longs(np.array([1, 2**63, -(2**63)], object)).to_pylist() == [1, None, -(2**63)]


# --- 11 centroids


def plain_clusters(rows, k, rounds, width, seed="2:"):
    points = [(i, whole(v)) for i, v, *_ in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda p: (p[0] is None, hashlib.sha256(f"{seed}{p[0]}".encode()).hexdigest() if p[0] is not None else "", p[1])
    cents = [v for _, v in sorted(points, key=key)[:k]]

    def assigned():
        return [min((sum((x - y) ** 2 for x, y in zip(v, c, strict=True)), j) for j, c in enumerate(cents)) for _, v in points]

    for _ in range(rounds):
        at = assigned()
        for j in range(len(cents)):
            mine = [v for (_, v), (_, c) in zip(points, at, strict=True) if c == j]
            if mine:
                cents[j] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    at = assigned()
    fits = lambda n: n if -(2**63) <= n < 2**63 else None
    each = [sum(d for d, c in at if c == j) for j in range(len(cents))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return [(i, c, fits(d), fits(each[c]), fits(sum(each)), digest[c]) for (i, _), (d, c) in zip(points, at, strict=True)]


def odd_vectors(seed=5, n=80, width=3):
    rng = random.Random(seed)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(width)], rng.randrange(4)) for i in range(n)]
    rows += [(i, [0.25] * width, 1) for i in range(1000, 1030)]  # many equal vectors
    rows += [rows[3], rows[3], (None, [0.5] * width, 2), (None, None, 2), (7000, [0.1, None, 0.2], 1), (7001, [0.1, float("nan"), 0.2], 1), (7002, [float("-inf"), 0.0, 0.2], 1), (7003, [0.5] * width, None), (7004, [], 1), (7005, [0.1] * (width + 1), 1)]
    return rows


@pytest.mark.parametrize("huge", [[], [2.0**20], [2.0**26, -(2.0**27)], [1e30, -1e200]])
def test_clusters_equal_a_plain_version(spark, huge):
    rows = odd_vectors() + [(8000 + i, [h, 0.5, -h], 0) for i, h in enumerate(huge)]
    df = spark.createDataFrame(rows, VECTORS).repartition(5)
    found = centroids.fit(df, k=6, rounds=4, width=3)
    got = [tuple(r) for r in centroids.assign(df, found).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, str(r))
    assert sorted(got, key=key) == sorted(plain_clusters(rows, 6, 4, 3), key=key)
    assert sum(found.counts) == len(got)


def test_clusters_of_few_and_no_rows(spark):
    df = spark.createDataFrame([(1, [0.5, 0.5], 1), (2, [0.5, 0.5], 1)], VECTORS)
    found = centroids.fit(df, k=6, rounds=2, width=2)
    assert [r["cluster"] for r in table(centroids.assign(df, found))] == [0, 0] and found.counts == [2, 0]
    assert centroids.fit(df.limit(0), k=6, rounds=2, width=2) is None and centroids.fit(df, k=6, rounds=2, width=9) is None


def test_clusters_with_clashing_columns(spark):
    df = spark.createDataFrame([(1, [0.5], "x", 3)], "vec_id int, embedding array<float>, id string, v int")
    assert table(centroids.assign(df, centroids.fit(df, k=2, rounds=1, width=1)))[0]["vec_id"] == 1


# --- 12 BPE


@pytest.fixture(scope="module")
def model_path():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


TEXTS = [
    None, "", " ", "\n\n  \t", "hello world", "don't we'll I'M <|endoftext|>x<|endoftext|>", "naïve café 東京 ２３ ٣", "a" * 5000, "ab " * 2000, "՘࢏ \U000107bb x₏", "\u0085    \x1c\x1d x", "🙂🙃 é \x00\x01",
    " <|endoftext|> <|endoftext|", "x" * 47 + " " + "y" * 48 + " " + "z" * 49, "hello  world   again \r\n next", "hello world",
]


def test_encoding_equals_the_library(spark, model_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(model_path)
    rng = random.Random(4)
    alphabet = [*map(chr, range(32, 400)), *" " * 80, "\n", "漢", "字", "🙂"]
    texts = TEXTS + ["".join(rng.choices(alphabet, k=rng.randrange(1, 300))) for _ in range(200)]
    df = spark.createDataFrame([(i if i % 7 else None, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string").repartition(3)
    for words in (0, 5, 10_000):
        encoded = bpe.encode(df, model_path, keep=("doc_id", "text"), words=words)
        back = table(bpe.decode(encoded, model_path, keep=("doc_id", "ids")))
        assert sorted((r["doc_id"] is None, str(r["ids"])) for r in back) == sorted((i % 7 == 0, str(library.encode(t or "", add_special_tokens=False).ids)) for i, t in enumerate(texts))
        for r in back:
            assert r["text"] == library.decode(r["ids"], skip_special_tokens=False)
        for r in table(encoded):
            assert r["ids"] == library.encode(r["text"] or "", add_special_tokens=False).ids
    assert bpe.encode(df.limit(0), model_path).count() == 0


def test_plain_texts_are_cut_without_the_unicode_engine(model_path, monkeypatch):
    import regex

    split, full = bpe.Splitter(model_path, ""), regex.compile(bpe.PATTERN).findall
    characters = [chr(i) for i in range(128)]
    texts = [form.format(a, b) for a in characters for b in characters for form in ("{}{}", "x{}{} y", " {}'{}s 1  ")]
    texts += ["it's we'll  they've 'Tis 12 3a\n\n b\t", "d'été où l'on s'en va 1² 'll", "\u3000 a\u2028b  é's"]
    assert [split(t) for t in texts] == [full(t) for t in texts]
    monkeypatch.setattr(split, "words", None)
    assert split("plain text's 7 words") == ["plain", " text", "'s", " 7", " words"]


def test_splits_equal_the_library_at_every_code_point(model_path):
    from tokenizers import Tokenizer

    library, split = Tokenizer.from_file(model_path).pre_tokenizer, bpe.Splitter(model_path, bpe.differing(model_path))
    for low in range(0, 0x110000, 0x800):
        if not 0xD800 <= low < 0xE000:
            text = "".join(f"a{chr(c)} {chr(c)}1{chr(c)}!{chr(c)}{chr(c)}\n" for c in range(low, low + 0x800, 1 if low < 0x10000 else 7))
            assert split(text) == [text[a:b] for _, (a, b) in library.pre_tokenize_str(text)]


def test_decoding_odd_ids(spark, model_path):
    from tokenizers import Tokenizer

    library, model = Tokenizer.from_file(model_path), bpe.Model(model_path)
    lists = [None, [], [50256], [model.start[0xE6]], [model.start[0xE6], model.start[0x9D]], [model.start[0xC3], 50256, model.start[0xA9]], [model.start[0xC3]], [model.start[0xA9]], [60000, 5, 50257], [model.start[0xF0], model.start[0x9F], 7]]
    got = model.decoded(pa.array([*lists, [5, None, -3]], pa.list_(pa.int32()))).to_pylist()
    assert got == [library.decode(x or [], skip_special_tokens=False) for x in lists] + [library.decode([5])]
    # a character whose bytes lie in two texts is broken in both
    assert model.decoded(pa.array([[model.start[0xC3]], [model.start[0xA9]]], pa.list_(pa.int32()))).to_pylist() == ["�", "�"]
    assert model.decoded(pa.array([[1], [5, 6], None], pa.list_(pa.int32())).slice(1)).to_pylist() == [library.decode([5, 6]), ""]


def test_automaton_is_minimal_and_gives_places(tmp_path):
    rng = random.Random(8)
    words = sorted({bytes(rng.choices(b"abc", k=rng.randrange(1, 7))) for _ in range(300)} | {b"a" * 30, b"\xff\x00"})
    path = str(tmp_path / "lexicon")
    bpe.Lexicon.write(path, words, [[i] * (i % 3) for i in range(len(words))])
    lexicon = bpe.Lexicon(path)
    assert lexicon.places(words).tolist() == list(range(len(words)))
    known = set(words)
    other = [bytes(rng.choices(b"abcd", k=rng.randrange(0, 9))) for _ in range(500)] + [b"a" * 31]
    assert lexicon.places(other).tolist() == [words.index(w) if w in known else -1 for w in other]
    # right languages of all states differ: no state could be shared further
    rights = {}
    for w in words:
        for i in range(len(w) + 1):
            rights.setdefault(w[:i], set()).add(w[i:])
    assert len(lexicon.finals) == len({frozenset(r) for r in rights.values()})
    bpe.Lexicon.write(path, [], [])
    assert bpe.Lexicon(path).places([b"a", b""]).tolist() == [-1, -1]


def test_merges_together_equal_merges_alone(model_path, monkeypatch):
    rng, model = random.Random(6), bpe.Model(model_path)
    words = ["".join(rng.choices("etaoin shrdlu'ABéñ漢0123", k=rng.randrange(1, 20))).encode() for _ in range(2000)] + [b"", b"a"]
    assert [x.tolist() for x in model.merged_together(words)] == [model.merged(w) for w in words]
    # the cache of a worker stays bounded and forgets without changing results
    monkeypatch.setattr(bpe, "CACHE_WORDS", 50)
    some = [w for w in words if w][:300]
    encoder = object.__new__(bpe.Encoder)
    encoder.model, encoder.cache = model, {}
    for i in range(0, 300, 40):
        assert [x.tolist() for x in encoder._unseen(some[i : i + 40] + some[:10])] == [model.merged(w) for w in some[i : i + 40] + some[:10]]
        assert len(encoder.cache) <= 50


def test_other_models_are_refused(tmp_path, model_path):
    import json

    given = json.load(open(model_path))
    given["model"]["ignore_merges"] = True
    (tmp_path / "m.json").write_text(json.dumps(given))
    with pytest.raises(ValueError, match="ignore_merges"):
        bpe.Model(str(tmp_path / "m.json"))


# --- 13 hard negatives


def plain_negatives(rows, anchor, positives, negatives_, low=(30, 100), high=(90, 100)):
    points = [(i, whole(v), l) for i, v, l in rows if v is not None and l is not None and all(x is not None and math.isfinite(x) for x in v)]
    clamp = lambda n: max(-(2**63), min(2**63 - 1, n))
    order = lambda r: (-r[0], r[1] is None, r[1] or 0)
    out = []
    for a, (i, v, l) in enumerate(points):
        if i is None or not anchor(i):
            continue
        scored = [(clamp(sum(x * y for x, y in zip(v, w, strict=False))), j, m) for b, (j, w, m) in enumerate(points) if b != a]
        for s, j, _ in sorted((r for r in scored if r[2] == l), key=order)[:positives]:
            window = sorted((r for r in scored if r[2] != l and low[0] * s <= low[1] * r[0] and high[1] * r[0] <= high[0] * s), key=order)[:negatives_]
            out += [(i, j, k, n, s, t) for k, (t, n, _) in enumerate(window, 1)]
    return out


@pytest.mark.parametrize("bucket,group,block", [(1024, 256, 16384), (7, 3, 5)])
@pytest.mark.parametrize("huge", [[], [2.0**25, -3.0, 1e30]])
def test_negatives_equal_brute_force(spark, monkeypatch, bucket, group, block, huge):
    monkeypatch.setattr(negatives, "BUCKET", bucket)
    monkeypatch.setattr(negatives, "GROUP", group)
    monkeypatch.setattr(negatives, "ANCHOR_BLOCK", block)
    rng = random.Random(9)
    rows = odd_vectors(n=120) + [(2000 + i, [rng.uniform(-3, 3) * rng.random() for _ in range(3)], rng.randrange(3)) for i in range(60)]
    rows += [(9000 + i, [h, 0.5, 1.0], i % 2) for i, h in enumerate(huge)]
    df = spark.createDataFrame(rows, VECTORS).repartition(4)
    got = [tuple(r) for r in negatives.mine(df, F.col("id") % 10 == 0, positives=4, negatives=6).collect()]
    key = lambda r: str(r)
    want = plain_negatives(rows, lambda i: i % 10 == 0, 4, 6)
    assert len(want) > 300 and sorted(got, key=key) == sorted(want, key=key)


def test_negatives_without_anchors_or_rows(spark):
    df = spark.createDataFrame(odd_vectors(), VECTORS)
    assert negatives.mine(df, F.col("id") == -1).count() == 0
    assert negatives.mine(df.limit(0), F.col("id") == 1).count() == 0
    one = spark.createDataFrame([(0, [1.0], 1), (1, [0.5], 1), (2, [-0.5], 1), (3, [0.25], 2)], VECTORS)
    assert [tuple(r) for r in negatives.mine(one, F.col("id") == 0).collect()] == [(0, 1, 1, 3, 32768, 16384)]


def test_buckets_out_of_reach_are_skipped(monkeypatch):
    seen = []
    monkeypatch.setattr(negatives, "dot", lambda a, b: seen.append(len(b)) or a @ b.T)
    wants = negatives.Wants(np.array([[10.0, 0.0]]), np.array([1]), np.array([0]), np.array([0]), np.array([500]), np.array([10**6]), False, 2)
    search = negatives.Search(wants, np.array([0]))
    ids = np.arange(3)
    for x in (90.0, 80.0, 70.0, 40.0):
        rows = np.array([[x, 0.0]] * 3)
        search.offer(rows, float(negatives.norms(rows).max()), ids, ids, np.array([2, 2, 2]))
    assert seen == [3] and search.best[1].tolist() == [900, 900]  # the rest is below the second score kept; 40 is below the window too
