"""Text expressions: chunking, cleaning, parsing and confidence."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from weftgraph.functions import constants as C


def strip(c: Column) -> Column:
    """Without white space at both ends (Spark's trim takes blanks only); what is between is found from both ends, not tried at every character."""
    return F.regexp_extract(c, r"(?Us)^\s*(.*\S)", 1)


def sentences(text: Column) -> Column:
    """Parts after 。！？!? and newline, stripped, of at least 5 characters; the whole text if there is none."""
    text = F.coalesce(text, F.lit(""))
    parts = F.filter(F.transform(F.split(text, r"(?<=[。！？!?\n])"), strip), lambda s: F.length(s) >= C.MIN_SENTENCE)
    # the parts as a variable of a lambda: named twice in a condition, they would be made twice
    some = F.transform(F.array(parts), lambda p: F.when(F.size(p) > 0, p).otherwise(F.array(strip(text))))
    return F.when(text.rlike(r"(?U)\S"), F.get(some, F.lit(0))).otherwise(F.array().cast("array<string>"))


def chunks(df: DataFrame, id_col: str, text_col: str, per: int = C.SENTENCES_PER_CHUNK) -> DataFrame:
    """(id, chunk_id, idx from 1, sentences, text) of groups of `per` sentences; no shuffle. Null and blank texts have no chunk.

    The groups are exploded with their empty case: a filter on the array's
    size would be computed below the split, which then ran once for each group.
    """
    split = df.select(F.col(id_col), sentences(F.col(text_col)).alias("all"))
    groups = F.transform(F.sequence(F.lit(0), F.floor((F.size("all") - 1) / per).cast("int")), lambda i: F.slice(F.col("all"), i * per + 1, F.lit(per)))
    groups = F.when(F.size("all") > 0, groups)
    out = split.select(F.col(id_col), groups.alias("groups")).select(F.col(id_col), F.posexplode_outer("groups").alias("pos", "sentences")).where("pos is not null")
    idx = F.col("pos") + 1
    return out.select(F.col(id_col), F.format_string("%s_%04d", F.col(id_col), idx).alias("chunk_id"), idx.alias("idx"), "sentences", F.array_join("sentences", "").alias("text"))


def sentence_offsets(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, pos, start, length) of every raw part: the start is the running sum of lengths in one array pass."""
    parts = df.select(F.col(id_col), F.split(F.col(text_col), r"(?<=[。！？!?\n])").alias("parts"))
    rows = parts.select(F.col(id_col), F.posexplode("parts").alias("pos", "part")).where("length(part) > 0")
    before = F.sum(F.length("part")).over(W.partitionBy(id_col).orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.length("part")
    return rows.select(F.col(id_col), "pos", before.alias("start"), F.length("part").alias("length"))


def nfkc(text: Column) -> Column:
    """Compatibility normal form; no built-in has it, so it is an Arrow UDF (made here: workers import this module)."""

    @F.pandas_udf("string")
    def form(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))

    return form(text)


def normalise_name(name: Column, compatibility: bool = True) -> Column:
    """Entity name: normal form, white space, trailing parentheses, company suffix, radicals."""
    c = strip(nfkc(name) if compatibility else name)
    c = F.regexp_replace(c, r"(?U)\s+", " ")
    c = strip(F.regexp_replace(c, r"\s*\(.*?\)\s*$", ""))
    c = strip(F.regexp_replace(c, C.COMPANY_SUFFIX, ""))
    return F.translate(c, "".join(C.RADICALS), "".join(C.RADICALS.values()))


def sanitise(text: Column) -> Column:
    """Without control characters, blanks at line ends, and more than one empty line in a row."""
    c = F.regexp_replace(text, r"(?![\n\r\t])\p{C}", "")
    c = F.regexp_replace(c, r"\r\n|\r", "\n")
    c = F.regexp_replace(c, r"(?m)[^\S\n]+$", "")
    return strip(F.regexp_replace(c, "\n{3,}", "\n\n"))


def readable(text: Column, most: float = 0.3) -> Column:
    """Whether under 30 % of the first 500 characters lie outside ASCII and CJK; false for empty texts."""
    head = F.substring(text, 1, 500)
    return F.coalesce((F.length(text) > 0) & (F.length(F.regexp_replace(head, C.READABLE, "")) / F.length(head) < most), F.lit(False))


def paragraphs(text: Column, target: int = 400) -> Column:
    """Parts between empty lines; parts between newlines if there are under 5 or they are long on average."""

    def cut(by):
        return F.filter(F.transform(F.split(text, by), strip), lambda p: F.length(p) > 0)

    wide, narrow = cut("\n\n"), cut("\n")
    mean = F.aggregate(wide, F.lit(0), lambda a, p: a + F.length(p)) / F.greatest(F.lit(1), F.size(wide))
    return F.when((F.size(wide) < 5) | (mean > target), narrow).otherwise(wide)


def pack(parts: Column, target: int = 400) -> Column:
    """Greedy packing of paragraphs: a new chunk begins when the next one would pass the target."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("buf"), F.lit(0).alias("n"), F.lit(False).alias("some"))

    def step(a, p):
        full = a["some"] & (a["n"] + F.length(p) > target)
        done = F.when(full, F.array_append(a["done"], a["buf"])).otherwise(a["done"])
        buf = F.when(full | ~a["some"], p).otherwise(F.concat(a["buf"], F.lit("\n\n"), p))
        n = F.when(full, F.length(p)).otherwise(a["n"] + F.length(p))
        return F.struct(done.alias("done"), buf.alias("buf"), n.alias("n"), F.lit(True).alias("some"))

    return F.aggregate(parts, start, step, lambda a: F.when(a["some"], F.array_append(a["done"], a["buf"])).otherwise(a["done"]))


def pipe_fields(line: Column) -> Column:
    """Fields of one triple line, ASCII or full-width bars, stripped; null for comments and blank lines."""
    clean = strip(line)
    fields = F.transform(F.split(F.regexp_replace(clean, "｜", "|"), r"\|"), strip)
    return F.when((F.length(clean) > 0) & ~clean.startswith("#"), fields)


def triple_of(fields: Column, types=tuple(C.TYPE_LABELS), rels=C.REL_TYPES) -> Column:
    """(subject, subject_type, rel_type, verb, object, object_type) from 6, 5 or 3 fields; null for other numbers.

    Six fields: subject, type, relation, verb, object, type. Five: without
    relation. Three: subject, verb, object. Unknown relations become
    RELATED_TO, unknown types 其他, missing types 概念.
    """
    n = F.size(fields)
    at = lambda i: F.get(fields, F.lit(i))
    kind = lambda c: F.when(c.isin(*types), c).otherwise(F.lit("其他"))
    rel = F.upper(at(2))

    def made(s, st, r, v, o, ot):
        return F.struct(s.alias("subject"), st.alias("subject_type"), r.alias("rel_type"), v.alias("verb"), o.alias("object"), ot.alias("object_type"))

    six = made(at(0), kind(at(1)), F.when(rel.isin(*rels), rel).otherwise(F.lit("RELATED_TO")), at(3), at(4), kind(at(5)))
    five = made(at(0), kind(at(1)), F.lit("RELATED_TO"), at(2), at(3), kind(at(4)))
    three = made(at(0), F.lit("概念"), F.lit("RELATED_TO"), at(1), at(2), F.lit("概念"))
    return F.when(n >= 6, six).when(n == 5, five).when(n == 3, three)


def valid_triple(s: Column, v: Column, o: Column, placeholders: bool = True) -> Column:
    """Non-empty, at most 50, 20 and 50 characters, and (for lines) no placeholder words."""
    ok = (F.length(s) > 0) & (F.length(v) > 0) & (F.length(o) > 0) & (F.length(s) <= 50) & (F.length(v) <= 20) & (F.length(o) <= 50)
    if placeholders:
        ok &= ~F.lower(s).isin(*C.NULL_ENTITIES) & ~F.lower(o).isin(*C.NULL_ENTITIES) & ~F.lower(v).isin(*C.NULL_VERBS)
    return F.coalesce(ok, F.lit(False))


def grounded(s: Column, o: Column, source: Column) -> Column:
    """Whether subject or object occurs in the source text, case folded."""
    low = F.lower(source)
    return low.contains(F.lower(s)) | low.contains(F.lower(o))


def parse_lines(df: DataFrame, text_col: str, keys: tuple[str, ...], rels: tuple[str, ...] = C.REL_TYPES) -> DataFrame:
    """Valid triples of the lines of each text, the first of each (subject, rel_type, object) per key.

    Lines are parsed before they are exploded: below the filters each of their conditions would parse the line again.
    """
    fields = F.transform(F.split(F.col(text_col), "\n"), pipe_fields)
    rows = df.select(*keys, F.posexplode(F.transform(fields, lambda f: triple_of(f, rels=rels))).alias("line", "t")).where("t is not null").select(*keys, "line", "t.*")
    rows = rows.where(valid_triple(F.col("subject"), F.col("verb"), F.col("object")))
    first = F.row_number().over(W.partitionBy(*keys, "subject", "rel_type", "object").orderBy("line"))
    return rows.withColumn("rn", first).where("rn = 1").drop("rn", "line")


def parse_json(df: DataFrame, text_col: str, keys: tuple[str, ...]) -> DataFrame:
    """Triples of a JSON array of objects with s, st, r, v, o, ot; items without s, v or o are skipped, placeholders are not."""
    parsed = F.from_json(F.col(text_col), "array<struct<s:string,st:string,r:string,v:string,o:string,ot:string>>")
    rows = df.select(*keys, F.posexplode(parsed).alias("line", "t")).select(*keys, "line", "t.*")
    rel = F.upper(strip(F.col("r")))
    kind = lambda c: F.when(F.col(c).isNull(), F.lit("概念")).when(F.col(c).isin(*C.TYPE_LABELS), F.col(c)).otherwise(F.lit("其他"))
    rows = rows.select(*keys, "line", strip(F.col("s")).alias("subject"), kind("st").alias("subject_type"), F.when(rel.isin(*C.REL_TYPES), rel).otherwise(F.lit("RELATED_TO")).alias("rel_type"), strip(F.col("v")).alias("verb"), strip(F.col("o")).alias("object"), kind("ot").alias("object_type"))
    rows = rows.where(valid_triple(F.col("subject"), F.col("verb"), F.col("object"), placeholders=False))
    first = F.row_number().over(W.partitionBy(*keys, "subject", "rel_type", "object").orderBy("line"))
    return rows.withColumn("rn", first).where("rn = 1").drop("rn", "line")


def list_item(line: Column) -> Column:
    """A line of a list without its number or bullet and without quotes around it; null stays null."""
    bare = F.regexp_replace(strip(line), r"^(?:\d+[.)、]\s*|[-*•·]\s*)+", "")
    return strip(F.regexp_replace(bare, r"^[\"'「」『』]+|[\"'「」『』]+$", ""))


def calibrated(text: Column, factor: float = 0.9) -> Column:
    """Struct (clean, confidence): the JSON tail's value, 0.5 without one, at most 0.35 if the answer has no information, times factor, in [0, 1]."""
    raw = F.regexp_extract(text, C.CONFIDENCE_TAIL, 1).try_cast("double")
    clean = F.when(raw.isNull(), text).otherwise(F.regexp_replace(F.regexp_replace(text, C.CONFIDENCE_TAIL, ""), r"\s+$", ""))
    conf = F.coalesce(raw, F.lit(0.5))
    conf = F.when(clean.rlike(C.NO_INFORMATION), F.least(conf, F.lit(0.35))).otherwise(conf) * factor
    return F.struct(clean.alias("clean"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), conf)).alias("confidence"))
