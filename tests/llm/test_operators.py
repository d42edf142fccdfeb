import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from weftgraph.llm import decontam, entries, exactdup, langid, mixing, neardup, quality, similar, tokens, toxicity, urlfilter, warc
from weftgraph.operators import joins

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def table(df):
    return [r.asDict() for r in df.collect()]


# --- 1 mixing


def test_water_filling():
    assert mixing.water_fill([10, 10], [1, 1], 20, 3) == [10, 10]
    t = mixing.water_fill([1, 100, 100], [1, 1, 2], 201, 3)
    assert t[0] == 3 and abs(t[1] - 66) < 1e-9 and abs(t[2] - 132) < 1e-9
    assert mixing.water_fill([1, 2], [1, 1], 100, 3) == [3, 6]
    assert mixing.water_fill([0, 5], [3, 1], 5, 3) == [0, 5]
    assert mixing.cyclic_weights(["b", None, "a", "c", "é"]) == [2, 2, 1, 3, 1]


def test_mix(docs, odd):
    got = table(mixing.mix(docs(odd)))
    assert len(got) == len(odd)
    sizes = Counter()
    for i, t, _, s in odd:
        sizes[s] += len(WORD.findall(t or ""))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = dict(zip(names, mixing.water_fill([sizes[s] for s in names], mixing.cyclic_weights(names), sum(sizes.values()), 3), strict=True))
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6 and r["taken"] <= 3 * r["size"]
    again = table(mixing.mix(docs(odd)))
    key = lambda r: str(r)
    assert sorted(got, key=key) == sorted(again, key=key)
    assert mixing.mix(docs([])).count() == 0


def test_mix_near_target(docs):
    rng = random.Random(2)
    rows = [(i, "w " * rng.randrange(1, 60), "en", rng.choice("aaaabc")) for i in range(600)]
    taken, target = Counter(), {}
    for r in table(mixing.mix(docs(rows))):
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - target[s]) <= 60 for s in target), (taken, target)
    exploded = Counter()
    for r in table(mixing.mixed_corpus(docs(rows))):
        exploded[r["source"]] += len(r["text"].split())
    assert exploded == taken


def test_mix_places_the_rest_in_buckets(docs, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 16)
    rows = [(i, "w " * (i % 7 + 1), "en", "a" if i % 3 else "b") for i in range(500)]
    taken, target = Counter(), {}
    for r in table(mixing.mix(docs(rows))):
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - target[s]) <= 8 for s in target)


# --- 2 language


def test_temperature_scales_overconfident_logits():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 3, 2000)
    logits = np.eye(3)[np.where(rng.random(2000) < 0.8, y, rng.integers(0, 3, 2000))] * 10
    assert langid.temperature(logits, y) > 2


def test_language_held_out(spark, small):
    got = entries.queries()["op2_langid"](spark, small).join(spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = [r for r in table(got) if r["held_out"]]
    assert held and sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.97
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in table(got))


BIG = 9007199254740993  # no double is this number


def test_ids_beside_nulls_stay(spark):
    df = spark.createDataFrame([(BIG, "the house and a word or two", BIG), (None, "plain text", None), (3, None, 1)], "doc_id long, text string, n_chars long")
    train = spark.createDataFrame([(i, "the house and a word", "en") for i in range(30)], "id long, text string, lang string")
    y = train.select("id", "text", (F.col("id") % 2).cast("int").alias("y"))
    for got in (langid.predict_languages(df, train, carry=("n_chars",)), quality.score_quality(df, y, carry=("n_chars",)), toxicity.score_toxicity(df, y, carry=("n_chars",))):
        assert sorted(((r["doc_id"], r["n_chars"]) for r in table(got)), key=str) == [(3, 1), (BIG, BIG), (None, None)]


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "some words here", 7, "l", 3, 5)], "doc_id long, text string, score int, letters string, predicted int, clean int")
    y = spark.createDataFrame([(i, "some words", i % 2) for i in range(8)], "id long, text string, y int")
    train = y.select("id", "text", F.lit("en").alias("lang"))
    assert table(langid.predict_languages(df, train, carry=("letters", "text")))[0]["letters"] == "l"
    for f, labels in ((langid.predict_languages, train), (quality.score_quality, y), (toxicity.score_toxicity, y)):
        with pytest.raises(ValueError, match="score"):
            f(df, labels, carry=("score",))
    left = toxicity.drop_toxic(df, y.limit(0))
    assert left.columns == df.columns and table(left) == table(df)
    with pytest.raises(ValueError, match="repetition"):
        mixing.mixed_corpus(df.withColumn("repetition", F.lit(1)), source_col="letters")


@pytest.mark.parametrize("n", [1, 5, 19])
def test_language_of_few_rows(spark, docs, n):
    train = spark.createDataFrame([(i, f"plain words number {i}", "en") for i in range(n)], "id long, text string, lang string")
    assert {r["lang_pred"] for r in table(langid.predict_languages(docs([(1, "other words", None, "a")]), train))} == {"en"}


def test_rare_language_is_learned(spark, docs):
    rows = [(i, f"the house and word {i} of them", "en") for i in range(6000)] + [(9000, "habari yako rafiki mzuri sana kabisa", "sw")]
    train = spark.createDataFrame(rows, "id long, text string, lang string")
    got = table(langid.predict_languages(docs([(1, "habari rafiki mzuri", None, "a"), (2, "the word of them", None, "a")]), train))
    assert {r["doc_id"]: r["lang_pred"] for r in got} == {1: "sw", 2: "en"}


def test_language_odd_rows(spark, docs, odd):
    train = spark.createDataFrame([(i, t, lang) for i in range(30) for t, lang in (("the house and a word or two", "en"), ("la plage est à côté", "fr"))], "id long, text string, lang string")
    got = table(langid.predict_languages(docs(odd), train))
    assert len(got) == len(odd)
    by = defaultdict(set)
    for r in got:
        by[r["doc_id"]].add((r["lang_pred"], r["score"] == 0))
    assert by[1] == by[2] == by[3] == {("und", True)} and by[4] == {("en", False)} and by[7] == {("fr", False)}
    assert {r["lang_pred"] for r in table(langid.predict_languages(docs(odd), train.limit(0)))} == {"und"}
    assert langid.predict_languages(docs([]), train).count() == 0


# --- 3 tokens


def processor():
    P = pytest.importorskip("public_tokenizers")
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    return path, sentencepiece.SentencePieceProcessor(model_file=path)


def test_tokens_equal_the_library(docs, odd):
    path, sp = processor()
    assert tokens.splits_are_safe(sp)
    extra = ["▁", "a▁b ", "<s> x</s>", "\n\n a\t\x00b", "ﬁ ½ é é", "　wide", "👩‍👩‍👧", "x" * 3000, "  lead", "trail  ", "a  b   c\r\n"]
    rows = odd + [(100 + i, t, "en", "a") for i, t in enumerate(extra)]
    texts = defaultdict(list)
    for i, t, *_ in rows:
        texts[i].append(t or "")
    for r in table(tokens.token_counts(docs(rows), path)):
        t = texts[r["doc_id"]][0]
        assert (r["n_tokens"], r["n_bytes"]) == (len(sp.encode(t)), len(t.encode())), t[:20]
    assert tokens.token_counts(docs([]), path).count() == 0


def test_other_models_are_refused():
    _, sp = processor()

    class Other:
        def __init__(self, **change):
            self.change = change

        def __getattr__(self, name):
            return self.change.get(name, getattr(sp, name))

    assert tokens.splits_are_safe(Other())
    assert not tokens.splits_are_safe(Other(normalize=lambda t: "▁" + t.lower().replace(" ", "▁")))
    assert not tokens.splits_are_safe(Other(normalize=lambda t: sp.normalize(" ".join(t.split()))))
    assert not tokens.splits_are_safe(Other(id_to_piece=lambda i: "a▁b" if i == 900 else sp.id_to_piece(i)))
    assert not tokens.splits_are_safe(Other(encode=lambda t: [1, 2, 3]))


def test_token_cache_is_bounded(monkeypatch):
    path, sp = processor()
    monkeypatch.setattr(tokens, "CACHE_SIZE", 10)
    lengths = tokens.Lengths(path, {"▁a": 1})
    words = [f"w{i}x" for i in range(100)]
    assert lengths.count(" ".join(words)) == len(sp.encode(" ".join(words))) and len(lengths) <= 11


# --- 4 urls


URLS = {
    1: (None, "", "", None), 2: ("no scheme/path", "", "", None), 3: ("http://A.Net/x", "a.net", "/x", "net/"), 4: ("http://net", "net", "", None), 5: ("x://m.example.net/en/1?q", "m.example.net", "/en/1", "example.net/en/"),
    6: ("http://example.com/de/a", "example.com", "/de/a", "example.com/de/"), 7: ("http://notexample.com/de/a", "notexample.com", "/de/a", None), 8: ("http://b.org/fr/", "b.org", "/fr/", "org/fr/"), 9: ("http://b.org/EN?x=1#y", "b.org", "/EN", None), 10: ("http://a\nb.org/p", "a\nb.org", "/p", None), 11: ("", "", "", None),
}


def test_url_rules(spark):
    df = spark.createDataFrame([(i, u[0], "x", "y") for i, u in URLS.items()], "page_id long, url string, host string, rule string")
    for r in table(urlfilter.judge(df)):
        assert (r["host"], r["path"], r["rule"]) == URLS[r["page_id"]][1:], r
        want = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}.get(r["rule"])
        assert r["verdict"] == want if want else r["verdict"] in ("allow", "block")
    assert urlfilter.judge(df.limit(0)).count() == 0
    assert {r["verdict"] for r in table(urlfilter.judge(df.where("page_id in (7, 9)")))} == {"allow"}


def test_url_trees_learn(spark):
    rows = [(f"http://{'casino-win-7777' if i % 2 else 'plain'}{i}.org/{'x/' * (i % 3)}p", i % 2) for i in range(400)]
    labelled = spark.createDataFrame(rows, "url string, blocked int")
    fresh = spark.createDataFrame([(i, f"http://{'casino-win-7777' if i % 2 else 'plain'}{i}q.org/p") for i in range(40)], "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in table(urlfilter.judge(fresh, labelled))}
    assert sum((got[i] == "block") == bool(i % 2) for i in got) >= 36


def test_entropy(spark):
    got = spark.createDataFrame([("aabb",), ("",), ("aaaa",), ("abcd",)], "t string").select("t", urlfilter.entropy(F.filter(F.array_sort(F.split("t", "")), lambda c: c != "")).alias("e"))
    assert {r["t"]: round(r["e"], 6) for r in got.collect()} == {"aabb": 1, "": 0, "aaaa": 0, "abcd": 2}


def test_trees_on_held_out_urls(spark):
    d = "/root/testdata/sf0.1"
    urls = spark.read.parquet(f"{d}/pages.parquet").select("page_id", "url")
    base = urls.withColumns({"host": urlfilter.host_of(F.col("url")), "path": urlfilter.path_of(F.col("url"))})
    ruled = base.withColumn("rule", urlfilter.rule_of(F.col("host"), F.col("path"))).where("rule is not null")
    ruled = ruled.withColumn("blocked", F.col("rule").isin("net/", "example.com/de/").cast("int")).withColumn("part", F.pmod(F.xxhash64("url"), F.lit(5)))
    got = urlfilter.judge(ruled.where("part = 0").select("page_id", "url"), ruled.where("part <> 0").select("url", "blocked"))
    both = table(got.join(ruled.select("page_id", "blocked"), "page_id"))
    assert len(both) > 50 and sum((r["score"] > 0.5) == r["blocked"] for r in both) / len(both) > 0.95


def test_suffix_statistics_leave_the_fold_out(spark):
    rows = [("com", i % 5, float(i % 5 == 0)) for i in range(100)] + [("rare", 0, 1.0)]
    got = {(r["suffix"], r["fold"]): r["suffix_blocked"] for r in table(urlfilter.part_statistics(spark.createDataFrame(rows, "suffix string, fold int, blocked double"), "suffix", 0.2))}
    assert set(got) == {("com", f) for f in range(-1, 5)}
    assert abs(got["com", -1] - 21 / 105) < 1e-9 and abs(got["com", 0] - 1 / 85) < 1e-9 and abs(got["com", 1] - 21 / 85) < 1e-9


# --- 5 quality


def test_url_sample_counts_copies_and_is_bounded(spark):
    rows = spark.range(3000).selectExpr("CASE WHEN id % 3 = 0 THEN 'http://hot.org/a' ELSE concat('http://h', id, '.org/a') END AS url", "'h' AS host", "'/a' AS path", "CAST(0 AS double) AS blocked")
    whole = {r["url"]: r["copies"] for r in urlfilter.url_sample(rows, 5000, 1).collect()}
    assert len(whole) == 2001 and whole["http://hot.org/a"] == 1000.0 and set(whole.values()) == {1.0, 1000.0}
    assert 100 < urlfilter.url_sample(rows, 200, 1).count() < 300


def test_statistics_in_pieces(monkeypatch):
    rng = random.Random(9)
    words = ["Ab", "cd.", "中文", "ИКС", "x1", "9", "été,", "$$"]
    text = "".join(rng.choice(words) + rng.choice(["\n", " ", " "]) for _ in range(3000))
    whole = quality.statistics(text)
    monkeypatch.setattr(quality, "PIECE", 500)
    pieces = list(quality.pieces(text))
    assert "".join(pieces) == text and max(map(len, pieces)) <= 500
    assert np.allclose([v for k, v in zip(quality.STATISTICS, quality.statistics(text), strict=True)], whole, rtol=0.02)
    same, mixed = quality.statistics("中" * 64), quality.statistics("".join(chr(0x4E00 + i) for i in range(64)))
    at = quality.STATISTICS.index("entropy")
    assert same[at] == 0 and abs(mixed[at] - 6) < 1e-9


def test_scores_equal_a_plain_traversal(spark, docs):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices(["good", "clean", "Words", "$$", "x"], k=rng.randrange(1, 60))), "en", "a") for i in range(60)]
    labels = [(i, t, int("$$" not in t or i % 7 == 0)) for i, t, *_ in rows]
    got = {r["doc_id"]: r["score"] for r in table(quality.score_quality(docs(rows), spark.createDataFrame(labels, "id long, text string, y int")))}
    order = sorted((quality.statistics(t), y) for _, t, y in labels)
    order.sort(key=lambda r: (r[1], r[0]))
    forest = quality.fit_forest(np.array([x for x, _ in order]), np.array([float(y) for _, y in order]))
    for i, t, *_ in rows:
        x, raw = quality.statistics(t), forest.base
        for f, cut, v in zip(forest.feature, forest.threshold, forest.value, strict=True):
            node = 0
            for _ in range(forest.depth):
                node = 2 * node + (2 if x[f[node]] > cut[node] else 1)
            raw += v[node - (2**forest.depth - 1)]
        assert abs(got[i] - 1 / (1 + np.exp(-raw))) < 1e-9


def test_forest_on_a_rule():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 2] > 0.5)).astype(float)
    f = quality.fit_forest(x[:1000], y[:1000])
    assert ((f.score(x[1000:]) >= 0.5) == y[1000:]).mean() > 0.93


def test_quality_odd_rows(spark, docs, odd):
    good = spark.createDataFrame([(i, "plain words in a line", i % 2) for i in range(40)], "id long, text string, y int")
    got = table(quality.score_quality(docs(odd), good))
    assert len(got) == len(odd) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert {r["score"] for r in table(quality.score_quality(docs(odd), good.limit(0)))} == {0.5}
    assert quality.score_quality(docs([]), good).count() == 0


def test_toxicity_scores_equal_a_plain_sum(spark, docs):
    y = spark.createDataFrame([(i, f"some {'idiot' if i % 2 else 'plain'} words {i}", i % 2) for i in range(40)], "id long, text string, y int")
    evidence, bias = toxicity.fitted(y)
    rows = [(1, "an idiot said plain words", "en", "a"), (2, "", "en", "a"), (3, None, "en", "a")]
    for r in table(toxicity.score_toxicity(docs(rows), y)):
        grams = [g for part in toxicity.subwords(rows[r["doc_id"] - 1][1] or "") for g in part.tolist()]
        odds = sum(float(evidence[g]) for g in grams) / (len(grams) + toxicity.PADDING) + bias
        assert abs(r["score"] - 1 / (1 + np.exp(-odds))) < 1e-6


@pytest.mark.parametrize("name, column, modulus, rest, recall, precision", [("op5_quality", "quality", 3, 1, 0.95, 0.95), ("op9_toxicity", "toxic", 5, 0, 0.9, 0.8)])
def test_held_out_rows(spark, name, column, modulus, rest, recall, precision):
    d = "/root/testdata/sf0.1"
    scored = entries.queries()[name](spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out")
    n = scored.groupBy(column, "predicted").count().collect()
    n = {(r[column], r["predicted"]): r["count"] for r in n}
    hit = n.get((1, 1), 0)
    assert hit / (hit + n.get((1, 0), 0)) >= recall and hit / (hit + n.get((0, 1), 0)) >= precision


@pytest.mark.parametrize("name, column, modulus, rest", [("op5_quality", "quality", 3, 1), ("op9_toxicity", "toxic", 5, 0)])
def test_classifiers_on_labels(spark, small, name, column, modulus, rest):
    scored = entries.queries()[name](spark, small)
    assert scored.count() == spark.read.parquet(f"{small}/documents.parquet").count()
    got = table(scored.join(spark.read.parquet(f"{small}/labels.parquet"), "doc_id"))
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % modulus == rest) for r in got)
    fitted = [r for r in got if not r["held_out"]]
    assert sum(r["predicted"] == r[column] for r in fitted) / len(fitted) > 0.9


# --- 6 exact


def plain_groups(rows):
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i))
    out = []
    for i, t, *_ in rows:
        norm = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        keep = min(groups[norm])[2]
        first = (i, t) not in [(r[0], r[1]) for r in rows[: len(out)]]  # of equal rows one is kept
        out.append((i, keep, len(groups[norm]), i == keep and first, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=str)


def test_exact_groups(docs, odd):
    rows = odd + [(20, "x y", "en", "a"), (21, "xy", "en", "a"), (22, "x  y", "en", "a"), (23, "x\x0b\x0cy ", "en", "a"), (24, "X Y", "en", "a")]
    got = sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in table(exactdup.exact_groups(docs(rows)))), key=str)
    assert got == plain_groups(rows)
    assert exactdup.exact_groups(docs([])).count() == 0


def test_exact_groups_of_text_ids_and_hot_groups(docs, monkeypatch):
    from weftgraph.operators import joins

    monkeypatch.setattr(joins, "HOT_ROWS", 3)
    rows = [(i, "same text" if i % 3 else f"text {i}", "en", "a") for i in range(30)]
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in table(exactdup.exact_groups(docs(rows).withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))))}
    assert got == {f"d{i}": ("d1", 20, i == 1) if i % 3 else (f"d{i}", 1, True) for i in range(30)}


def test_hash_collisions_are_told_apart(docs, monkeypatch):
    monkeypatch.setattr(exactdup.F, "md5", lambda c: F.lit("ab" * 16))
    rows = [(1, "one", "en", "a"), (2, "two", "en", "a"), (3, "o ne", "en", "a")]
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in table(exactdup.exact_groups(docs(rows)))}
    assert got == {1: (3, 2), 2: (2, 1), 3: (3, 2)}


# --- 7 decontamination


def plain_hits(rows, items):
    def shingles(t):
        w = [re.sub(r"[^\w]|_", "", x) for x in re.split(r"[\x20\x09-\x0D]+", (t or "").lower())]
        w = [x for x in w if x]
        return [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []

    out = {}
    for i, t, *_ in rows:
        d = shingles(t)
        for k, item in items:
            s = shingles(item)
            if not s or not d:
                continue
            size, want = min(len(s), len(d)), Counter(s)
            best = max(n / (len(s) + size - n) for n in (sum((Counter(d[a : a + size]) & want).values()) for a in range(len(d) - size + 1)))
            if best >= 0.8 - 1e-12:
                out[i, k] = max(best, out.get((i, k), 0))
    return out


def test_decontamination_equals_brute_force(spark, docs, odd):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(k, " ".join(rng.choices(vocabulary, k=n))) for k, n in enumerate([3, 5, 9, 14, 30, 30, 45, 60])] + [(90, None), (91, ""), (92, "rep rep rep rep rep rep rep rep")]
    rows = list(odd)
    for i in range(60):
        words = rng.choice(items[:8])[1].split()
        for _ in range(rng.randrange(4)):
            at, kind = rng.randrange(len(words)), rng.randrange(3)
            words[at : at + (kind != 0)] = [] if kind == 1 else ["zz"]
        if rng.random() < 0.2:
            words = words[: int(len(words) * 0.9)]
        text = " ".join(rng.choices(vocabulary, k=rng.randrange(40)) + words + rng.choices(vocabulary, k=rng.randrange(40)))
        rows.append((100 + i, text.upper() if i % 5 == 0 else text.replace(" ", ", ", 3), "en", "a"))
    rows.append((300, "rep " * 40, "en", "a"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in table(decontam.contaminated(docs(rows), bench))}
    want = plain_hits(rows, items)
    assert set(got) == set(want)
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)
    kept = {r["doc_id"] for r in table(decontam.decontaminate(docs(rows), bench))}
    assert kept == {r[0] for r in rows} - {k[0] for k in want}
    assert decontam.contaminated(docs([]), bench).count() == 0 and decontam.contaminated(docs(rows), bench.limit(0)).count() == 0


def test_decontamination_of_periodic_texts(spark, docs):
    rng = random.Random(11)
    word = lambda: " ".join
    periodic = lambda p, n: word()((rng.sample("xyzuv", p) * n)[:n])
    items = [(k, periodic(rng.randrange(2, 5), rng.randrange(13, 31))) for k in range(20)] + [(90, "x y x y x y x y x y x y x"), (91, " ".join(f"v{i}" for i in range(40)) + " v1 v2 v3 v4 v5 v6")]
    rows = [(i, periodic(rng.randrange(2, 5), rng.randrange(13, 31)), "en", "a") for i in range(150)]
    rows += [(500, "y x y x y x y x y x y x y", "en", "a"), (501, items[-1][1].replace("v0 ", "zz "), "en", "a")]
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in table(decontam.contaminated(docs(rows), spark.createDataFrame(items, "item_id long, text string")))}
    want = plain_hits(rows, items)
    assert set(got) == set(want) and (500, 90) in want and (501, 91) in want and len(want) > 40


# --- 8 WARC


def test_round_trip(spark):
    big = "é" * 700
    rows = [(1, "http://a", big), (2, "http://b", big), (3, None, big), (4, "http://c", "small"), (5, "http://d\r\nX: y", "small"), (6, "http://e", None), (7, "http://f", ""), (None, "http://g", big), (8, "u", "\r\n\r\nWARC/1.1\r\n\x1f\x8b\x08 inside" * 40)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    got = {r["page_id"]: r for r in table(warc.archive_round_trip(df))}
    assert len(got) == len(rows)
    for i, _, html in rows:
        data = (html or "").encode()
        assert (got[i]["payload_bytes"], got[i]["payload_digest"]) == (len(data), hashlib.sha1(data).hexdigest())
        assert (got[i]["record_type"], got[i]["refers_to"]) == (("revisit", 3) if i in (1, 2) else ("response", None))
    assert warc.archive_round_trip(df.limit(0)).count() == 0


@pytest.mark.parametrize("packed", [True, False])
def test_salvage(packed):
    parts = [warc.record_bytes(str(i), f"http://{i}", (f"<p>{i} " + "x" * 500).encode(), None) for i in range(6)]
    if packed:
        parts = [warc.gzip_member(p) for p in parts]
    damaged = bytearray(b"".join(parts))
    starts = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).tolist()
    damaged[starts[2] + len(parts[2]) // 2] ^= 0xFF
    data = bytes(damaged[: starts[4]]) + b"junk bytes" + bytes(damaged[starts[4] : starts[6] - 9])
    found = list(warc.salvage(data))
    # the last member lacks its trailer only: its record is inflated whole and passes its digest
    assert names(found) == ([0, 1, 3, 4, 5] if packed else [0, 1, 3, 4])
    gaps = [f[1:3] for f in found if f[0] == "gap"]
    assert gaps == [(starts[2], starts[3]), (starts[4], starts[4] + 10)] + ([] if packed else [(starts[5] + 10, len(data))])
    assert list(warc.salvage(b"")) == []


def names(found):
    return [int(re.search(r"page:(\d+)", f[3]["head"]["warc-record-id"])[1]) for f in found if f[0] == "record"]


def test_salvage_inside_a_member():
    rng = random.Random(1)
    parts = [warc.record_bytes(str(i), None, bytes(rng.choices(range(97, 123), k=2000)), None) for i in range(6)]
    ends = np.cumsum([len(p) for p in parts]).tolist()
    bad = bytearray(b"".join(parts))
    bad[ends[1] + 700] ^= 1  # a byte of record 2 before packing
    whole = warc.gzip_member(bytes(bad))
    found = list(warc.salvage(whole))
    assert names(found) == [0, 1, 3, 4, 5]
    assert [f for f in found if f[0] == "gap"] == [("gap", 0, len(whole), f"inflated bytes {ends[1]} to {ends[2]} of {ends[5]} hold no valid record")]
    good = warc.gzip_member(b"".join(parts))
    for cut in (20, 300, 3000):
        found = list(warc.salvage(good[:-cut]))
        inner = warc._inflate(good[:-cut], 0)[0]
        assert names(found) == [i for i in range(6) if ends[i] <= len(inner)] and len(names(found)) >= 3
        assert [f[1:3] for f in found if f[0] == "gap"] == [(0, len(good) - cut)] * (len(inner) < ends[5]), cut
    # damage in the packed bytes: what is inflated before it stays, and so does the next member
    broken = bytearray(good + warc.gzip_member(parts[0]))
    broken[len(good) // 2] ^= 0xFF
    found = list(warc.salvage(bytes(broken)))
    assert names(found)[:2] == [0, 1] and names(found)[-1] == 0 and all(f[3]["payload"] in parts[names([f])[0]] for f in found if f[0] == "record")
    assert any(f[0] == "gap" for f in found)


def foreign(kind, block, *lines):
    return b"\r\n".join([b"WARC/1.0", b"WARC-Type: " + kind, b"WARC-Record-ID: <urn:uuid:1>", *lines, b"Content-Length: %d" % len(block)]) + b"\r\n\r\n" + block + b"\r\n\r\n"


BODY = b"<p>body</p>"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Length: 11\r\n\r\n" + BODY
FOREIGN = [
    (b"response", HTTP, [b"WARC-Payload-Digest: sha256:" + hashlib.sha256(BODY).hexdigest().encode()], "sha256:" + hashlib.sha256(BODY).hexdigest()),
    (b"response", HTTP, [b"WARC-Block-Digest: md5:" + hashlib.md5(HTTP).hexdigest().encode()], None),
    (b"response", HTTP, [b"WARC-Payload-Digest: SHA-1:" + hashlib.sha1(BODY).hexdigest().upper().encode()], hashlib.sha1(BODY).hexdigest()),
    (b"response", b"20000101000000\nexample.org. A 1.2.3.4\n", [b"Content-Type: text/dns"], None),
    (b"response", HTTP, [b"WARC-Target-URI: http://a/", b"X-Note: one", b"\ttwo", b" three", b"Content-Type: application/http;", b" msgtype=response"], None),
    (b"revisit", HTTP[: -len(BODY)], [b"WARC-Payload-Digest: sha1:" + hashlib.sha1(BODY).hexdigest().encode(), b"WARC-Refers-To: <urn:uuid:0>"], hashlib.sha1(BODY).hexdigest()),
    (b"revisit", HTTP[: -len(BODY)], [b"WARC-Payload-Digest: sha256:" + base64.b32encode(hashlib.sha256(BODY).digest())], "sha256:" + hashlib.sha256(BODY).hexdigest()),
    (b"response", HTTP, [b"WARC-Payload-Digest: crc32:cafe", b"WARC-Block-Digest: sha1:not a digest"], "crc32:cafe"),
    (b"response", b"HTTP/1.1 200 OK\r\nContent-Length: 99999999999999999999999\r\n\r\nx", [], None),
    (b"warcinfo", b"software: x", [b"Content-Type: application/warc-fields", b"WARC-Payload-Digest:"], None),
]


def test_sound_foreign_records_are_kept(spark, tmp_path):
    parts = [foreign(k, b, *lines) for k, b, lines, _ in FOREIGN]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(warc.gzip_member, parts)))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(parts))
    got = table(warc.read_archives(spark, f"file://{tmp_path}").orderBy("file", "first_byte"))
    assert [r["kind"] for r in got] == ["record"] * 2 * len(parts)
    assert [r["payload_digest"] for r in got] == [d for *_, d in FOREIGN] * 2
    assert got[3]["payload"].startswith(b"20000101") and got[0]["payload"] == BODY and got[5]["payload_bytes"] == 11
    (folded, _), = [warc._parse(parts[4], 0)]
    assert folded["head"]["x-note"] == "one two three" and folded["payload"] == BODY


@pytest.mark.parametrize("label", [b"sha256:" + hashlib.sha256(HTTP).hexdigest().encode(), b"md5:" + base64.b64encode(hashlib.md5(HTTP).digest())])
def test_damaged_foreign_records_are_gaps(label):
    part = foreign(b"response", HTTP, b"WARC-Block-Digest: " + label)
    assert [f[0] for f in warc.salvage(part)] == ["record"]
    assert [f[0] for f in warc.salvage(part.replace(b"body", b"bodx"))] == ["gap"]


def test_archives_of_failed_attempts_and_odd_ids(spark, tmp_path):
    rows = [("null", "a"), (None, "b"), ("x>y\n z%41", "c"), ("7", "d")]
    df = spark.createDataFrame(rows, "id string, body string").select("id", F.lit(None).cast("string").alias("url"), F.col("body").cast("binary").alias("body"), F.lit(None).cast("string").alias("refers_to"))
    folder = f"file://{tmp_path}/w"
    manifest = warc.write_archives(df, folder)
    first = next((tmp_path / "w").glob("*.warc.gz"))
    (tmp_path / "w" / "part-000000-stale-0000.warc.gz").write_bytes(first.read_bytes())
    got = table(warc.read_listed(manifest, folder))
    assert sorted(((r["key"], r["payload"].decode()) for r in got), key=str) == sorted(rows, key=str)
    size = first.stat().st_size
    first.write_bytes(first.read_bytes() + b"junk")
    got = table(warc.quarantine(warc.read_archives(spark, folder)))
    assert [(r["first_byte"], r["last_byte"]) for r in got if r["file"].endswith(first.name)] == [(size, size + 4)], got


# --- 9 toxicity


def test_subwords_stay_in_words():
    assert sum(map(len, toxicity.subwords("ab cd"))) == 2 + 2  # <ab, ab>, <cd, cd> of order 3; <ab>, <cd> of order 4
    a = set(np.concatenate(list(toxicity.subwords("idiot"))).tolist())
    b = set(np.concatenate(list(toxicity.subwords("idiott"))).tolist())
    assert len(a & b) >= 5


def test_toxicity_catches_misspellings(spark, docs, odd):
    rng = random.Random(3)
    clean = [f"word{k}" for k in "abcdefghijklmnop"]
    line = lambda bad: " ".join(rng.choices(clean, k=25) + ([rng.choice(["idiot", "moron", "pathetic"])] if bad else []))
    labelled = spark.createDataFrame([(i, line(i % 4 == 0), int(i % 4 == 0)) for i in range(300)], "id long, text string, y int")
    rows = [(200, line(False) + " idiots", "en", "a"), (201, line(False) + " morron", "en", "a"), (202, line(False), "en", "a")]
    got = {r["doc_id"]: r for r in table(toxicity.score_toxicity(docs(rows), labelled))}
    assert [got[i]["predicted"] for i in (200, 201, 202)] == [1, 1, 0]
    odd_rows = table(toxicity.score_toxicity(docs(odd), labelled))
    assert len(odd_rows) == len(odd) and all(0 <= r["score"] <= 1 for r in odd_rows)
    assert {r["score"] for r in table(toxicity.score_toxicity(docs(odd), labelled.limit(0)))} == {0.0}
    assert toxicity.score_toxicity(docs([]), labelled).count() == 0


# --- 10 SimHash


def plain_print(t):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), seed=42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_trie_finds_all_pairs():
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fp = np.unique(np.concatenate([base] + [base ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) for _ in range(4)]))
    group = np.zeros(len(fp), np.int64)
    i, j = (np.concatenate(c) for c in zip(*neardup.trie_pairs(group, fp, 2), strict=True))
    want = {(a, b) for a in range(len(fp)) for b in range(a + 1, len(fp)) if int(fp[a] ^ fp[b]).bit_count() <= 2}
    assert {(min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist(), strict=True)} == want and len(i) == len(want)


@pytest.mark.parametrize("limit, front", [(100_000, 1_000_000), (100_000, 7), (40, 1_000_000), (3, 7)])
def test_links_of_heavy_groups(spark, monkeypatch, limit, front):
    monkeypatch.setattr(neardup, "GROUP_LIMIT", limit)
    monkeypatch.setattr(neardup, "NODE_PAIRS", front)
    monkeypatch.setattr(neardup, "CHUNK", 100)
    rng = random.Random(7)
    base = [rng.getrandbits(64) for _ in range(20)] + [rng.getrandbits(40) for _ in range(20)]
    fps = sorted({b ^ sum(1 << rng.randrange(64) for _ in range(k)) & (1 << 64) - 1 for b in base for k in (0, 1, 1, 2, 2)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = sorted((r["u"], r["v"]) for r in neardup.fingerprint_links(spark.createDataFrame([(f,) for f in signed], "fp long")).collect())
    want = sorted((min(signed[a], signed[b]), max(signed[a], signed[b])) for a in range(len(fps)) for b in range(a + 1, len(fps)) if (fps[a] ^ fps[b]).bit_count() <= 2)
    assert got == want


def test_near_duplicates(docs, odd, monkeypatch):
    base = " ".join(f"w{i}" for i in range(300))
    rows = odd + [(50, base, "en", "a"), (51, base.upper(), "en", "a"), (52, base + " tail", "en", "a")]
    prints = {}
    for i, t, *_ in rows:
        prints.setdefault(plain_print(t), []).append(i)
    keys = list(prints)
    group = {k: k for k in keys}
    for a in keys:
        for b in keys:
            if (a ^ b).bit_count() <= 2:
                old, new = group[b], group[a]
                group = {k: new if g == old else g for k, g in group.items()}
    least = {g: min((i for k in keys if group[k] == g for i in prints[k] if i is not None), default=None) for g in group.values()}
    got = sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in table(neardup.near_duplicates(docs(rows)))), key=str)
    assert got == sorted(((i, f"{plain_print(t):016x}", least[group[plain_print(t)]]) for i, t, *_ in rows), key=str)
    monkeypatch.setattr(joins, "HOT_ROWS", 1)  # every repeated fingerprint counts as frequent
    again = sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in table(neardup.near_duplicates(docs(rows)))), key=str)
    assert again == got
    assert neardup.near_duplicates(docs([])).count() == 0


def test_simhash_in_pieces(monkeypatch):
    text = " ".join(f"w{i * i % 997}" for i in range(2000))
    monkeypatch.setattr(neardup, "PIECE", 64)
    assert neardup.simhash(text) == plain_print(text)


# --- near copies of the pipeline


def plain_components(rows):
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, t, *_ in rows for w in [t.lower().split()]}
    group = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = {i: new if g == old else g for i, g in group.items()}
    return group


@pytest.mark.parametrize("limit, order", [(64, 10_000), (4, 10_000), (4, 0)])
def test_drop_near_equals_brute_force(docs, monkeypatch, limit, order):
    monkeypatch.setattr(similar, "GROUP_LIMIT", limit)
    monkeypatch.setattr(similar, "ORDER_ROWS", order)
    rng = random.Random(8)
    vocabulary = [f"W{i}" for i in range(200)]
    passage = rng.choices(vocabulary, k=40)
    bases = [rng.choices(vocabulary, k=rng.randrange(3, 120)) + (passage if i % 3 == 0 else []) for i in range(30)]
    texts = []
    for i in range(240):
        words = list(bases[min(rng.randrange(40), 29)])
        for _ in range(rng.randrange(5)):
            at, kind = rng.randrange(len(words)), rng.randrange(3)
            words[at : at + (kind != 0)] = [] if kind == 1 and len(words) > 1 else ["zz" + str(i % 3)]
        texts.append(" ".join(words))
    rows = [(i, t, "en", "a") for i, t in enumerate(texts)]
    want = plain_components(rows)
    got = {r["doc_id"]: r["component_id"] for r in table(similar.similar_components(docs(rows)))}
    assert got == want and 20 < len(set(want.values())) < 200
    assert {r["doc_id"] for r in table(neardup.drop_near(docs(rows)))} == set(want.values())
    assert similar.similar_components(docs([])).count() == 0


def test_drop_near_has_the_pipelines_similarity(docs):
    words = [f"w{i}" for i in range(200)]
    other = lambda k: " ".join("zz" if i % 40 == 20 and i < 40 * k else w for i, w in enumerate(words))
    rows = [(1, other(0), "en", "a"), (2, other(4), "en", "a"), (3, other(5), "en", "a")]  # 1 and 2: 176 of 216 shingles; 1 and 3: 171 of 221
    assert {r["doc_id"] for r in table(neardup.drop_near(docs(rows[:2])))} == {1}
    assert {r["doc_id"] for r in table(neardup.drop_near(docs([rows[0], rows[2]])))} == {1, 3}


def test_rows_go_by_id_and_text(spark, docs):
    item = " ".join(f"k{i}" for i in range(12))
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(None, "before " + item, "en", "a"), (5, item + " after", "en", "a"), (5, "a clean text", "en", "a"), (None, "another clean text", "en", "a")]
    assert {r["doc_id"] for r in table(decontam.contaminated(docs(rows), bench))} == {None, 5}
    left = lambda df: sorted(r["text"] for r in table(df))
    assert left(decontam.decontaminate(docs(rows), bench)) == ["a clean text", "another clean text"]
    copies = [(1, "one text", "en", "a"), (2, "one text", "en", "a"), (2, "two other words", "en", "a"), (None, "one text", "en", "a"), (1, "one text", "en", "a")]
    assert left(exactdup.drop_exact(docs(copies))) == left(neardup.drop_near(docs(copies))) == ["one text", "two other words"]


def test_equal_rows_and_reused_ids(docs):
    rows = [(1, "a longer", "en", "a"), (2, "same", "en", "a"), (1, "same", "en", "a"), (0, "same", "en", "a"), (0, "same", "en", "a"), (None, "other", "en", "a"), (None, "other", "en", "a")]
    for drop in (exactdup.drop_exact, neardup.drop_near):
        assert sorted(((r["doc_id"], r["text"]) for r in table(drop(docs(rows)))), key=str) == [(0, "same"), (1, "a longer"), (None, "other")], drop


def test_parity_rules_out_no_similar_pair():
    rng = np.random.default_rng(4)
    for n in (1, 3, 60, 700, 5000):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        for keep in (1.0, 0.9, 0.5, 0.0):
            b = np.unique(np.concatenate((a[: int(len(a) * keep)], rng.integers(0, 1 << 63, max(1, n // 9), dtype=np.uint64))))
            assert similar.differing(similar.parity(a), similar.parity(b)) <= len(np.setxor1d(a, b))


def test_mix_of_equal_rows(docs):
    rows = [(1, "a b c", "en", "x")] * 5 + [(2, "a", "en", "y")] * 3 + [(3, None, "en", "y"), (4, "q r s t", "en", "z"), (2, "a b c d", "en", "y"), (2, "a b c e", "en", "y")]
    decided, corpus = table(mixing.mix(docs(rows))), table(mixing.mixed_corpus(docs(rows)))
    assert len(decided) == len(rows) and all(r["taken"] == r["size"] * r["repeats"] <= 3 * r["size"] for r in decided)
    want = Counter()
    for r in decided:
        want[r["doc_id"], r["size"]] += r["repeats"]
    got = Counter((r["doc_id"], len((r["text"] or "").split())) for r in corpus)
    assert got == +want
    assert mixing.mixed_corpus(docs([])).count() == 0


def test_filling_a_gap():
    take = mixing.fill(np.array([50, 30, 7, 41, 3, 3]), np.array([1, 1, 1, 1, 1, 1]), 60.0)
    assert (take * np.array([50, 30, 7, 41, 3, 3])).sum() == 60 or 60 - (take * np.array([50, 30, 7, 41, 3, 3])).sum() < 3
    assert mixing.fill(np.array([4]), np.array([5]), 13.5).tolist() == [3] and mixing.fill(np.array([0, 9]), np.array([2, 2]), 5.0).tolist() == [0, 0]
