import io
import random
import zipfile

from pyspark.sql import functions as F

from weftgraph.functions import providers
from weftgraph.functions import text as X
from weftgraph.functions import vectors as V
from weftgraph.sources import files


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(column).first()[0]


def test_chunk_counts(spark):
    text = lambda n: "".join(f"這是第{i}個句子。" for i in range(n))
    rows = [("e", ""), ("w", "  \n "), ("p", " no terminator "), ("n", None), ("a", text(5)), ("b", text(6)), ("c", text(11))]
    got = {}
    for r in X.chunks(spark.createDataFrame(rows, "d string, t string"), "d", "t").collect():
        got.setdefault(r["d"], []).append((r["chunk_id"], r["idx"], len(r["sentences"])))
    assert got == {"p": [("p_0001", 1, 1)], "a": [("a_0001", 1, 5)], "b": [("b_0001", 1, 5), ("b_0002", 2, 1)], "c": [("c_0001", 1, 5), ("c_0002", 2, 5), ("c_0003", 3, 1)]}


def test_triple_lines(spark):
    raw = "\n".join(["# c", "", "甲|組織|USES|用|乙|工具", "甲｜用｜丙", "甲|用|丙", "甲|BAD|odd|用|丁|怪", "甲|組織|用|戊|工具", "x" * 51 + "|用|乙", "甲|" + "v" * 21 + "|乙", "none|用|乙", "甲|動詞|乙", "a|b"])
    got = [tuple(r)[1:] for r in X.parse_lines(spark.createDataFrame([(1, raw)], "k int, raw string"), "raw", ("k",)).collect()]
    assert sorted(got) == sorted([("甲", "組織", "USES", "用", "乙", "工具"), ("甲", "概念", "RELATED_TO", "用", "丙", "概念"), ("甲", "其他", "RELATED_TO", "用", "丁", "其他"), ("甲", "組織", "RELATED_TO", "用", "戊", "工具")])


def test_names(spark):
    names = {"臺灣湯淺電池股份有限公司": "臺灣湯淺電池", " Ａｐｐｌｅ   Inc (x) ": "Apple Inc", "某店 (負責人)": "某店"}
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", X.normalise_name(F.col("n")).alias("c")).collect()
    assert {r["n"]: r["c"] for r in got} == names


def test_readability_and_confidence(spark):
    assert one(spark, X.readable(F.col("t")), t="plain 中文") is True
    assert one(spark, X.readable(F.col("t")), t="ÿýï" * 10) is False
    assert one(spark, X.readable(F.col("t")), t="") is False
    for text, want in {'a {"confidence": 0.85}': 0.765, "a": 0.45, 'a {"confidence": 1.5}': 1.0, '無法回答 {"confidence": 0.9}': 0.315}.items():
        assert abs(one(spark, X.calibrated(F.col("t"))["confidence"], t=text) - want) < 1e-9


def test_packing(spark):
    got = one(spark, X.pack(F.split("t", ",")), t=",".join(["a" * 300, "b" * 90, "c" * 20, "d" * 500]))
    assert [len(x) for x in got] == [392, 20, 500]


def test_vectors(spark):
    a = lambda *x: F.array(*[F.lit(float(v)) for v in x])
    assert one(spark, V.cosine(a(1, 0), a(1, 0)), t=1) == 1 and one(spark, V.cosine(a(1, 0), a(-1, 0)), t=1) == -1 and one(spark, V.cosine(a(0, 0), a(1, 0)), t=1) == 0
    lit = lambda *x: [F.lit(float(v)) for v in x]
    assert one(spark, V.alignment(*lit(1, 1, 0, 0)), t=1) == 0 and one(spark, V.magnitude(*lit(0.4, 0.6, 0.8, 0.2)), t=1) == 0.5
    assert [round(x, 6) for x in one(spark, V.fuse(a(1, 0), a(0, 1)), t=1)] == [0.85, 0.15]
    assert one(spark, V.fuse(a(1, 0), a(1, 2, 3)), t=1) == [1.0, 0.0]
    assert abs(one(spark, V.decay(F.expr("timestamp'2020-01-01'"), F.expr("timestamp'2020-04-10'")), t=1) - 0.60653) < 1e-4
    assert one(spark, V.decay(F.lit(None).cast("timestamp"), F.expr("timestamp'2020-04-10'")), t=1) == 1


def test_encodings_and_office_files():
    assert files.decode("中文".encode("big5")) == "中文" and files.decode("é中".encode()) == "é中"
    doc = io.BytesIO()
    with zipfile.ZipFile(doc, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>Hello</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>')
    assert files.parse("x.docx", doc.getvalue()) == ("Hello\na | b", None)
    assert files.parse("x.exe", b"1")[1] == "unknown suffix .exe" and files.parse("x.txt", b" \n")[1] == "blank text"


def test_directory(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("text a", "utf-8")
    (tmp_path / "b.zip").write_bytes(b"x")
    got = {r["file_type"]: (r["text"], r["error"]) for r in files.read_directory(spark, str(tmp_path)).collect()}
    assert got == {".txt": ("text a", None), ".zip": (None, "unknown suffix .zip")}
    assert files.read_registry(spark, str(tmp_path / "none.json")).count() == 0


def test_offline_providers():
    e = providers.embedding(dim=16)
    v = e.encode_batch(["same text", "same text", "other"])
    assert (v[0] == v[1]).all() and abs((v[0] ** 2).sum() - 1) < 1e-5
    assert providers.language().triples("Alpha uses beta") == ["Alpha|概念|USES|uses|beta|概念"]


def test_list_items_lose_numbers_bullets_and_quotes(spark):
    lines = ["1. one", "- \"two\"", " 3) 「三」 ", "• - four", "plain", "", None]
    rows = spark.createDataFrame(list(enumerate(lines)), "i int, s string").select("i", X.list_item(F.col("s")).alias("t")).orderBy("i").collect()
    assert [r["t"] for r in rows] == ["one", "two", "三", "four", "plain", "", None]


def test_embedding_hashes_every_trigram_once(monkeypatch):
    """The vectors are those of hashing each place; the hashes are as many as the different trigrams."""
    import hashlib

    import numpy as np

    from weftgraph.functions import providers

    def plain(texts, dim):
        out = np.zeros((len(texts), dim), np.float32)
        for row, text in enumerate(texts):
            for i in range(max(0, len(text) - 2)):
                h = int.from_bytes(hashlib.blake2b(text[i : i + 3].lower().encode(), digest_size=8).digest(), "little")
                out[row, (h >> 1) % dim] += 1 if h & 1 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm < 1e-9, 1, norm)

    texts = ["", "a", "ab", "abc", "İΣΣ ΑΣ", "\U0001f600\U0010ffff\U0001f601x", "知識圖譜知識", "the and the", "x" * 500] * 3
    monkeypatch.setattr(providers, "ROWS", 4)
    assert np.array_equal(providers.HashEmbedding(16).encode_batch(texts), plain(texts, 16))
    calls = []
    real = hashlib.blake2b
    monkeypatch.setattr(providers.hashlib, "blake2b", lambda *a, **k: calls.append(1) or real(*a, **k))
    monkeypatch.setattr(providers, "ROWS", 1024)
    assert providers.HashEmbedding(16).encode_batch(["x" * 500] * 50).shape == (50, 16) and len(calls) == 1
    assert providers.HashEmbedding(16).encode_batch([]).shape == (0, 16)


def test_strip_takes_every_white_space_from_both_ends_only(spark):
    rng = random.Random(9)
    signs = [" ", "\n", "\r", "\t", "　", " ", "\x85", "\xa0", "a", "。", "\U0001f600"]
    texts = ["", " ", "\n", " \r\n", "a", "a\n", "a \n\n", *("".join(rng.choices(signs, k=rng.randrange(9))) for _ in range(300))]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    plain = F.regexp_replace("t", r"(?U)^\s+|\s+$", "")
    assert df.where(~X.strip(F.col("t")).eqNullSafe(plain)).isEmpty()
    assert [r[0] for r in df.select(F.size(X.sentences(F.col("t"))) == 0).collect()] == [r[0] for r in df.select(F.length(F.coalesce(plain, F.lit(""))) == 0).collect()]


def test_a_line_is_parsed_once(spark):
    """No condition of a filter may hold the parsing, which then ran once for each of them."""
    df = spark.createDataFrame([(1, "a|uses|b\nc|d\n#x|y|z\ne｜概念｜USES｜uses｜f｜概念")], "k long, raw string")
    rows = X.parse_lines(df, "raw", ("k",))
    assert sorted((r["subject"], r["rel_type"], r["verb"], r["object"]) for r in rows.collect()) == [("a", "RELATED_TO", "uses", "b"), ("e", "USES", "uses", "f")]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter" in line and "split(" in line]
