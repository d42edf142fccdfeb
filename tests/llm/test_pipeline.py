import random
import re
from collections import Counter

import duckdb
from test_operators import plain_components, plain_hits

import corpus_pipeline
from weftgraph.llm import entries, mixing


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, ids = docs.columns, {r["doc_id"] for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialise(stage(spark, docs, small), "test")
        now = [r["doc_id"] for r in docs.select("doc_id").collect()]
        assert docs.columns == columns and len(now) == len(set(now)) and set(now) <= ids, name
        ids = set(now)
    mixed = corpus_pipeline.mixing(spark, docs, small)
    assert mixed.columns == [*columns, "repetition"] and {r["doc_id"] for r in mixed.select("doc_id").collect()} <= ids


def test_sql(spark, small):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from read_parquet('{small}/{t}.parquet')")
    for name, sql in entries.oracle_sql().items():
        got, want = entries.queries()[name](spark, small).toPandas(), con.execute(sql).df()
        as_text = lambda f: sorted(map(str, f[sorted(f.columns)].astype(object).where(f.notna(), None).itertuples(index=False, name=None)))
        assert as_text(got) == as_text(want), name


def plain_key(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def plain_exact(rows):
    """Of rows of equal text the one with most code points, then smallest id; equal rows are one."""
    best = {}
    for r in set(rows):
        key = (-len(r[1] or ""), r[0] is None, r[0] or 0, str(r))
        k = plain_key(r[1])
        best[k] = min(best.get(k, (key, r)), (key, r), key=lambda x: x[0])
    return Counter(r for _, r in best.values())


def test_stages_on_odd_and_empty_tables(spark, small, odd):
    columns = ["doc_id", "text", "lang", "source", "n_chars", "score", "predicted", "letters", "id", "row", "size"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score int, predicted int, letters string, id string, row long, size long"
    rows = [(i, t, lang, s, None, 1, None, "l", "x", 7, 2**53 + 1) for i, t, lang, s in odd]
    rows += [(2**53 + 1, "unique text under a large id", "en", "a", 2**53 + 1, 3, 4, "m", "y", 8, None), (4, "another text under a used id", "en", "b", None, 1, 0, None, None, None, None)]
    for given in (rows, []):
        docs = spark.createDataFrame(given, schema)
        now = Counter(given)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, small)
            got = Counter(tuple(r) for r in out.collect())
            assert out.columns == columns and got <= now, name
            # nothing here is toxic, a near copy or an item: copies go at the exact stage, ties by row hash apart, and nothing else does
            if name == "exact_dedup":
                want = plain_exact(list(now.elements()))
                now, want = got, Counter((r[0], plain_key(r[1])) for r in want.elements())
                assert Counter((r[0], plain_key(r[1])) for r in got.elements()) == want
            elif name == "near_dedup":
                assert len(now - got) <= 2  # "a word or two", in its spellings
                now = got
            else:
                assert got == now, name
            docs = spark.createDataFrame(list(got.elements()), schema)
        mixed = corpus_pipeline.mixing(spark, docs, small)
        rows_out = mixed.collect()
        assert mixed.columns == [*columns, "repetition"] and {tuple(r)[:-1] for r in rows_out} <= set(now)
        for row, n in Counter(tuple(r)[:-1] for r in rows_out).items():
            assert sorted(r["repetition"] for r in rows_out if tuple(r)[:-1] == row) == list(range(1, n + 1)), row
        decided = {(r["doc_id"], r["size"]): r["repeats"] for r in mixing.mix(docs).collect()}
        for row in now:
            words = len(re.findall(r"[^\x20\x09-\x0D]+", row[1] or ""))
            assert sum(1 for r in rows_out if tuple(r)[:-1] == row) == decided[row[0], words]


def test_pipeline_equals_a_plain_one(spark, tmp_path):
    """The whole pipeline against plain versions of its stages; the toxic rows are plain to see."""
    rng = random.Random(21)
    vocabulary = [f"w{i}" for i in range(400)]
    text = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = [text(12) for _ in range(4)]
    rows, toxic = [], set()
    for i in range(300):
        t = text(rng.randrange(5, 80))
        if i % 10 == 0:
            t, _ = t + " idiot moron scum idiot", toxic.add(i)
        elif i % 10 == 1 and i > 20:
            t = rows[rng.choice([r for r in range(i) if r % 10 != 0])][1] + "  "
        elif i % 10 == 2 and i > 20:
            t = rows[rng.choice([r for r in range(i) if r % 10 not in (0, 2)])][1] + " w1"
        elif i % 10 == 3:
            t += " " + rng.choice(items) + " " + text(5)
        rows.append((i, t, "en", rng.choice("abc"), len(t)))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = [r for r in rows if r[0] not in toxic]
    kept = list(plain_exact(kept).elements())
    group = plain_components(kept)
    kept = [r for r in kept if group[r[0]] == r[0]]
    hit = {i for i, _ in plain_hits(kept, list(enumerate(items)))}
    kept = {r[0]: r for r in kept if r[0] not in hit}
    got = [tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert {r[0] for r in got} <= set(kept) and all(r[:5] == kept[r[0]] for r in got)
    sizes, taken = Counter(), Counter()
    for r in kept.values():
        sizes[r[3]] += len(r[1].split())
    for r in got:
        taken[r[3]] += len(r[1].split())
    names = sorted(sizes)
    target = mixing.water_fill([sizes[s] for s in names], mixing.cyclic_weights(names), sum(sizes.values()), 3)
    assert all(0 <= t - taken[s] < 20 for s, t in zip(names, target, strict=True)), (taken, target)
