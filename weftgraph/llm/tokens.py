"""Exact token counts by a two-tier lookup of pre-token lengths on the map side."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import per_text

#: Documents (and code points of each) read to find frequent pre-tokens; results never depend on them, only the cost does.
SAMPLE_DOCS, SAMPLE_CHARS = 3000, 20_000
#: Entries of the broadcast table.
TABLE_SIZE = 60_000
#: Pre-tokens a worker remembers beyond the table, and the longest it remembers.
CACHE_SIZE, CACHE_CHARS = 300_000, 48

_MARK = "▁"
# No piece of the vocabulary holds a space mark after another character, nor a newline:
# merges never cross these borders, so the pieces' counts add up to the text's count.
_SPLIT = re.compile(f"\n|{_MARK}+[^{_MARK}\n]*|[^{_MARK}\n]+")


def pre_tokens(text: str) -> list[str]:
    """The independent parts of a text, spaces as marks, with the mark that the library puts in front."""
    return _SPLIT.findall(_MARK + text.replace(" ", _MARK)) if text else []


def splits_are_safe(processor) -> bool:
    """Whether this model counts a text as the sum of its pre-tokens.

    No piece, user-defined ones included, may cross a border; characters must
    be left as they are but for blanks becoming marks, none of which are
    merged or cut off; one mark must come in front; and the characters that
    `Lengths` puts before a part must be tokens of their own. Each is tried on
    the model itself.
    """
    crossing = re.compile(f"[^{_MARK}]{_MARK}|\n")
    if any(crossing.search(p) for p in map(processor.id_to_piece, range(processor.get_piece_size())) if p != "\n"):
        return False
    plain = "".join(map(chr, [*range(33, 0xD800), *range(0xE000, 0xFFFE), *range(0x1F300, 0x1F700)])).replace(_MARK, "") + "e\u0301 \u1100\u1161 \r\n \t  x  "
    if any(processor.normalize(plain[i : i + 4096]) != _MARK + plain[i : i + 4096].replace(" ", _MARK) for i in range(0, len(plain), 4096)):
        return False
    return [len(processor.encode(t)) for t in ("a", "\n", "a\n")] == [1, 2, 2]


class Lengths(dict):
    """Tokens of each pre-token: the broadcast tier first, then what this worker has encoded itself."""

    def __init__(self, model_path: str, table: dict[str, int]):
        import sentencepiece

        super().__init__(table)
        self.encode = sentencepiece.SentencePieceProcessor(model_file=model_path).encode
        self.table = table

    def __missing__(self, part: str) -> int:
        if part[0] == _MARK:  # "a" is one token and never merges with a mark
            n = len(self.encode("a" + part, num_threads=1)) - 1
        else:  # the mark in front and the newline are one token each
            n = len(self.encode("\n" + part, num_threads=1)) - 2
        if len(part) <= CACHE_CHARS:
            if len(self) >= len(self.table) + CACHE_SIZE:
                self.clear()
                self.update(self.table)
            self[part] = n
        return n

    def count(self, text: str | None) -> int:
        return sum(map(self.__getitem__, pre_tokens(text))) if text else 0


_worker: dict[tuple, Lengths] = {}


def _lengths(model_path: str, key: int, packed) -> Lengths:
    """The tables of this worker process, built once and kept between tasks."""
    got = _worker.get((model_path, key))
    if got is None:
        _worker.clear()
        parts, counts = packed
        words = parts.split("\x00\x00") if parts else []
        got = _worker[model_path, key] = Lengths(model_path, dict(zip(words, np.frombuffer(counts, np.uint16).tolist(), strict=True)))
    return got


def _frequent(df: DataFrame, text_col: str) -> list[str]:
    """Frequent pre-tokens of a bounded number of texts: as few partitions are read as hold them."""
    seen: Counter = Counter()
    for row in df.select(F.substring(F.col(f"`{text_col}`"), 1, SAMPLE_CHARS)).where(F.col(f"`{text_col}`").isNotNull()).take(SAMPLE_DOCS):
        seen.update(p for p in pre_tokens(row[0]) if len(p) <= CACHE_CHARS and "\x00" not in p)
    return [p for p, _ in seen.most_common(TABLE_SIZE)]


def token_counts(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Tokens of every whole text as sentencepiece gives them for a BPE model, without begin or end tokens.

    One pass without a shuffle: texts fall into pre-tokens that the model's
    merges never cross (tried on the model; one for which it does not hold is
    refused), the lengths of frequent ones come from a broadcast table of
    bounded size, others are encoded once per worker and kept in a bounded
    cache. Each executor must be able to open `model_path`.

    Null text counts as empty (0 bytes, 0 tokens). Very long texts are counted
    whole. Repeated rows and null ids are reported row by row; ids and carried
    columns are passed on unchanged, and one named like a result is an error;
    an empty table gives no rows.
    Returns id, carried columns, n_bytes, n_tokens.
    """
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_file=model_path)
    if not splits_are_safe(processor):
        raise ValueError(f"{model_path}: its counts are not the sums of pre-tokens")
    lengths = Lengths(model_path, {})
    words = _frequent(df, text_col)
    counts = np.array([min(lengths[w], 65535) for w in words], dtype=np.uint16)
    shared = df.sparkSession.sparkContext.broadcast(("\x00\x00".join(words), counts.tobytes()))
    key = hash((len(words), counts.tobytes(), shared.value[0]))

    def count():
        table = _lengths(model_path, key, shared.value)

        def work(texts):
            return [pa.array([len(t.encode("utf-8", "surrogatepass")) if t else 0 for t in texts], pa.int64()), pa.array([table.count(t) for t in texts], pa.int64())]

        return work

    return per_text(df, F.col(f"`{text_col}`"), [id_col, *carry], [("n_bytes", "long"), ("n_tokens", "long")], count)


def op3_tokens(spark, sf_dir: str, limit: int = 4096) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return token_counts(docs, public_tokenizers.path("piece_bpe_32k.model")).withColumn("over_limit", F.col("n_tokens") > limit)
