"""Byte-level BPE: a minimal transducer of frequent words in front of exact merges, and decoding."""

from __future__ import annotations

import atexit
import functools
import hashlib
import heapq
import json
import os
import re
import shutil
import tempfile
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.llm.common import discard, materialise, per_text, python_ready, text_slices

#: Words of the lexicon, their greatest length in bytes, unseen words that a worker remembers, and different words that a counting task holds.
LEXICON_WORDS, WORD_BYTES, CACHE_WORDS, COUNTED_WORDS = 65_536, 48, 100_000, 200_000
#: The byte-level splitting pattern: a fixed value of the format.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: It with letters first, which begin no other part: the same cuts, found with fewer trials.
LETTERS_FIRST = r" ?\p{L}+|'(?:s|t|re|ve|m|ll|d)| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for texts of ASCII alone, where the standard library's engine is several times as fast; letters first, as no other part begins like one.
ASCII_PATTERN = r" ?[A-Za-z]+|'(?:s|t|re|ve|m|ll|d)| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
#: Planes of Unicode with letters, digits or blanks; the others are private or unassigned and alike for every library.
PLANES = (0, 1, 2, 3, 14)


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Model:
    """A byte-level BPE model file: splitting, exact merges and decoding as the library does them, without truncation or padding."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            given = json.load(f)
        bpe, pre = given["model"], given["pre_tokenizer"]
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if bpe.get(k)]
        odd += [f"added token {a['content']}" for a in given["added_tokens"] if a["lstrip"] or a["rstrip"] or a["single_word"]]
        if odd or bpe["type"] != "BPE" or given["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or (given["decoder"] or {}).get("type") != "ByteLevel":
            raise ValueError(f"{path}: not a plain byte-level BPE model {odd}")
        self.path, chars = path, byte_characters()
        byte = {c: b for b, c in enumerate(chars)}
        vocab: dict[str, int] = bpe["vocab"]
        self.start = [vocab[c] for c in chars]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in bpe["merges"]]
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.added = {a["content"]: a["id"] for a in given["added_tokens"]}
        self.pieces = {i: bytes(byte[c] for c in t) for t, i in vocab.items()} | {i: t.encode() for t, i in self.added.items()}
        self._added = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None

    def parts(self, text: str) -> list[str]:
        """The text with added tokens as parts of their own (at odd places)."""
        return self._added.split(text) if self._added else [text]

    def merged(self, word: bytes) -> list[int]:
        """Ids of one word: always the pair of least rank, the leftmost first, until none is left; n log n for any length."""
        ids = [self.start[b] for b in word]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], i, m[1]) for i in range(n - 1) if (m := self.merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, new = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n:
                continue
            now = self.merges.get((ids[i], ids[j]))
            if now is None or now[1] != new:
                continue
            ids[i], ids[j] = new, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if m := self.merges.get((new, ids[k])):
                    heapq.heappush(heap, (m[0], i, m[1]))
            if (h := before[i]) >= 0 and (m := self.merges.get((ids[h], new))):
                heapq.heappush(heap, (m[0], h, m[1]))
        return [i for i in ids if i >= 0]

    @functools.cached_property
    def _pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sorted keys of the pairs that merge, their ranks, the new id of each rank)."""
        keys = np.array([a << 32 | b for a, b in self.merges], np.int64)
        ranks, new = (np.array(x, np.int64) for x in zip(*self.merges.values(), strict=True))
        by_rank = np.zeros(ranks.max() + 1, np.int64)
        by_rank[ranks] = new
        return keys[order := np.argsort(keys)], ranks[order], by_rank

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids; the number of ranks for a pair that doesn't merge."""
        keys, ranks, new = self._pairs
        at = np.minimum(np.searchsorted(keys, key := a << 32 | b), len(keys) - 1)
        return np.where(keys[at] == key, ranks[at], len(new))

    @functools.cached_property
    def _first(self) -> np.ndarray:
        """Rank of each pair of bytes."""
        start = np.array(self.start, np.int64)
        return self._ranks(start[:, None], start[None, :])

    def merged_together(self, words: list[bytes]) -> list[np.ndarray]:
        """`merged` of many words: those of one length step together, each merging its leftmost pair of least rank."""
        new, rank = self._pairs[2], self._ranks
        none, start = len(new), np.array(self.start, np.int64)
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(words)
        by_length = defaultdict(list)
        for i, w in enumerate(words):
            by_length[len(w)].append(i)
        for n, places in by_length.items():
            if not n:
                continue
            given, where = np.frombuffer(b"".join([words[i] for i in places]), np.uint8).reshape(-1, n), np.array(places)
            rows, left = start[given], self._first[given[:, :-1], given[:, 1:]]
            while len(rows):
                least = left.min(1, initial=none)
                for i in np.flatnonzero(least == none).tolist():
                    out[where[i]] = rows[i].astype(np.int32)
                go = least < none
                rows, left, where, least = rows[go], left[go], where[go], least[go]
                if not len(rows):
                    break
                every, at = np.arange(len(rows)), left.argmin(1)
                rows[every, at] = new[least]
                shift = np.arange(rows.shape[1] - 1)
                rows = np.take_along_axis(rows, shift + (shift > at[:, None]), 1)
                gap = np.arange(left.shape[1] - 1)
                left = np.take_along_axis(left, gap + (gap >= at[:, None]), 1)
                right = at < left.shape[1]
                left[every[right], at[right]] = rank(rows[every[right], at[right]], rows[every[right], at[right] + 1])
                before = at > 0
                left[every[before], at[before] - 1] = rank(rows[every[before], at[before] - 1], rows[every[before], at[before]])
        return out

    @functools.cached_property
    def _flat(self) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all tokens, offset of each id); one more id without bytes stands for all that no token has."""
        size = [len(self.pieces.get(i, b"")) for i in range(max(self.pieces) + 2)]
        return np.frombuffer(b"".join([self.pieces[i] for i in sorted(self.pieces)]), np.uint8), np.cumsum([0, *size])

    def decoded(self, lists: pa.ListArray) -> pa.Array:
        """The text of each list of ids, added tokens included; null lists, null ids and ids that no token has add nothing, broken UTF-8 becomes U+FFFD."""
        pieces, offsets = self._flat
        lists = lists.fill_null([]) if lists.null_count else lists
        ids = lists.flatten().cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False)
        ids = np.where((ids < 0) | (ids >= len(offsets) - 2), len(offsets) - 2, ids)
        each = np.diff(offsets)[ids]
        ends = np.cumsum(each)
        flat = pieces[np.repeat(offsets[ids] - (ends - each), each) + np.arange(ends[-1] if len(ends) else 0)]
        first = np.asarray(lists.offsets).astype(np.int64)
        bounds = np.append(0, ends)[first - first[0]]
        whole = flat.tobytes()
        cut = flat[bounds[bounds < len(flat)]]
        try:
            whole.decode()
            sound = not (cut & 0xC0 == 0x80).any()
        except UnicodeDecodeError:
            sound = False
        if sound:
            return pa.StringArray.from_buffers(len(lists), pa.py_buffer(bounds.astype(np.int32).tobytes()), pa.py_buffer(whole))
        return pa.array([whole[a:b].decode("utf-8", "replace") for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.string())


@functools.lru_cache(maxsize=4)
def differing(path: str) -> str:
    """A character class of the code points that the library's tables and the pattern's put in different classes ('' if none): releases of Unicode differ."""
    import regex
    from tokenizers import Tokenizer

    library, own, found = Tokenizer.from_file(path).pre_tokenizer, regex.compile(PATTERN), []
    for low in (p << 16 | o for p in PLANES for o in range(0, 1 << 16, 1 << 13)):
        points = [c for c in range(low, low + (1 << 13)) if not 0xD800 <= c < 0xE000]
        text = "".join(f"a{chr(c)}1{chr(c)}!{chr(c)}a\n" for c in points)
        theirs = np.array([at for _, (at, _) in library.pre_tokenize_str(text)], np.int64)
        ours = np.array([m.start() for m in own.finditer(text)], np.int64)
        found += [points[i] for i in np.unique(np.setxor1d(theirs, ours) // 8).tolist()]
    ranges: list[list[int]] = []
    for c in found:
        if ranges and ranges[-1][1] == c - 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return "[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges) + "]" if ranges else ""


class Splitter:
    """Pre-tokens of a text, as the library cuts them: by the pattern, or by the library itself where a text holds a code point of another class."""

    def __init__(self, path: str, odd: str):
        import regex

        self.path, self.words, self.plain = path, regex.compile(LETTERS_FIRST).findall, re.compile(ASCII_PATTERN).findall
        ranges = re.findall(r"\\U([0-9a-f]{8})-\\U([0-9a-f]{8})", odd)
        # a look-up per character is faster than a search for a class of many ranges
        self.even = frozenset(chr(c) for a, b in ranges for c in range(int(a, 16), int(b, 16) + 1)).isdisjoint

    @functools.cached_property
    def library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path).pre_tokenizer

    def __call__(self, text: str) -> list[str]:
        if text.isascii():
            return self.plain(text)
        if self.even(text):
            return self.words(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]


def automaton(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(arc keys, arc targets, arc outputs, final states) of the minimal acyclic transducer of distinct sorted words.

    States with the same continuations are one state, so suffixes are shared;
    it is built word by word, minimising what the next word cannot change any
    more. The outputs along a word's arcs add up to its place in the list. An
    arc's key is 256 * state + byte; keys are sorted and state 0 is the start.
    """
    known: dict[tuple, int] = {}
    arcs: list[tuple[tuple[int, int], ...]] = []
    finals: list[bool] = []

    def settled(final: bool, out: dict[int, int]) -> int:
        key = (final, *out.items())
        if key not in known:
            known[key] = len(arcs)
            arcs.append(tuple(out.items()))
            finals.append(final)
        return known[key]

    path: list[tuple[bool, dict[int, int]]] = [(False, {})]
    last = b""
    for word in [*words, None]:
        same = 0
        if word is not None:
            while same < min(len(last), len(word)) and last[same] == word[same]:
                same += 1
        for i in range(len(last), same, -1):
            final, out = path.pop()
            path[-1][1][last[i - 1]] = settled(final, out)
        if word is None:
            break
        for i in range(same, len(word)):
            path.append((i == len(word) - 1, {}))
        last = word
    root = settled(False, path[0][1])
    reach = [0] * len(arcs)  # words from each state on; targets come before their sources
    for s, out in enumerate(arcs):
        reach[s] = finals[s] + sum(reach[t] for _, t in out)
    number = {root: 0} | {s: s + 1 for s in range(root)}
    rows = []
    for s, out in enumerate(arcs):
        passed = int(finals[s])
        for byte, t in out:
            rows.append((number[s] << 8 | byte, number[t], passed))
            passed += reach[t]
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 3)
    ends = np.zeros(len(arcs), np.int64)
    ends[[number[s] for s, f in enumerate(finals) if f]] = 1
    return table[:, 0], table[:, 1], table[:, 2], ends


class Lexicon:
    """The transducer and the ids of its words in one memory-mapped file of 32-bit integers."""

    def __init__(self, path: str):
        flat = np.memmap(path, np.int32, "r")
        sizes, at, parts = flat[:7].tolist(), 7, []
        for n in sizes[:6]:
            parts.append(flat[at : at + n])
            at += n
        self.keys, self.targets, self.outputs, self.finals, self.offsets, self.ids = parts
        self.longest = sizes[6]

    @staticmethod
    def write(path: str, words: list[bytes], ids: list[list[int]]) -> None:
        parts = [*automaton(words), np.cumsum([0, *map(len, ids)]), np.array([i for w in ids for i in w], np.int64)]
        if max((int(p.max(initial=0)) for p in parts), default=0) >= 2**31:
            raise ValueError("the lexicon is too large for 32-bit integers")
        np.concatenate([np.array([*map(len, parts), max(map(len, words), default=0)]), *parts]).astype(np.int32).tofile(path)

    def places(self, words: list[bytes]) -> np.ndarray:
        """Place of each word in the lexicon, -1 if it is not there: all words walk their next arc at once."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.cumsum(lengths) - lengths
        flat = np.frombuffer(b"".join(words), np.uint8)
        state, place = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        on = np.flatnonzero((lengths > 0) & (lengths <= self.longest))
        seen = np.zeros(len(words), bool)
        for i in range(self.longest):
            if not len(on):
                break
            key = state[on] << 8 | flat[starts[on] + i]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            on, at = on[hit := self.keys[at] == key], at[hit]
            state[on] = self.targets[at]
            place[on] += self.outputs[at]
            ended = lengths[on] == i + 1
            seen[on[ended]] = self.finals[state[on[ended]]] > 0
            on = on[~ended]
        return np.where(seen, place, -1)


class Encoder:
    """Texts to ids in one worker: frequent words by the lexicon, others by merges that a bounded cache remembers."""

    def __init__(self, model: Model, lexicon: Lexicon, odd: str):
        self.model, self.lexicon, self.split = model, lexicon, Splitter(model.path, odd)
        self.cache: dict[bytes, np.ndarray] = {}

    def _unseen(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of words that the lexicon doesn't hold."""
        new = [w for w in words if w not in self.cache]
        short = [w for w in new if len(w) <= WORD_BYTES]
        found = dict(zip(short, self.model.merged_together(short), strict=True)) | {w: np.array(self.model.merged(w), np.int32) for w in new if len(w) > WORD_BYTES}
        out = [found[w] if w in found else self.cache[w] for w in words]
        if len(self.cache) + len(short) > CACHE_WORDS:
            self.cache.clear()
        self.cache.update((w, found[w]) for w in short[:CACHE_WORDS])
        return out

    def __call__(self, texts: list[str | None]) -> pa.Array:
        codes: defaultdict[str, int] = defaultdict(count().__next__)
        rows, sizes = [], []
        for text in texts:
            n = 0
            for odd, part in enumerate(self.model.parts(text) if text else ()):
                if odd % 2:
                    row = np.array([-1 - self.model.added[part]], np.int64)
                else:
                    words = self.split(part)
                    row = np.fromiter(map(codes.__getitem__, words), np.int64, len(words))
                rows.append(row)
                n += len(row)
            sizes.append(n)
        flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        words = [w.encode() for w in codes]
        place = self.lexicon.places(words)
        pool, low, size = [np.asarray(self.lexicon.ids)], np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        inside = place >= 0
        low[inside], size[inside] = self.lexicon.offsets[place[inside]], np.diff(self.lexicon.offsets)[place[inside]]
        end = len(self.lexicon.ids)
        missed = np.flatnonzero(~inside).tolist()
        for i, ids in zip(missed, self._unseen([words[i] for i in missed]), strict=True):
            pool.append(ids)
            low[i], size[i] = end, len(ids)
            end += len(ids)
        special = sorted(set(flat[flat < 0].tolist()))
        if special:  # added tokens are one id each
            pool.append(np.array([-1 - s for s in special], np.int32))
            low, size = np.append(low, end + np.arange(len(special))), np.append(size, np.ones(len(special), np.int64))
            for i, s in enumerate(special):
                flat[flat == s] = len(words) + i
        ids = np.concatenate(pool)
        each = size[flat]
        ends = np.cumsum(each)
        at = np.repeat(low[flat] - (ends - each), each) + np.arange(ends[-1] if len(ends) else 0)
        bounds = np.append(0, ends)[np.append(0, np.cumsum(np.array(sizes, np.int64)))]
        return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids[at], pa.int32()))


def frequent_words(df: DataFrame, path: str, text_col: str, words: int = LEXICON_WORDS) -> list[bytes]:
    """The most frequent pre-tokens of all texts, of at most WORD_BYTES bytes, sorted by bytes.

    Tasks count on their own and hand on sums, whenever COUNTED_WORDS
    different words are held, so a frequent word moves a few times a task and
    rare ones never fill a worker. Words are taken by classes of their count
    (16 to a doubling), most frequent first, as long as a class fits; so at
    most `words` rows reach the driver, and no task sorts.
    """
    odd = differing(path)
    python_ready(df.sparkSession)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, split, seen = Model(path), Splitter(path, odd), Counter()

        def sums() -> pa.RecordBatch:
            held = [(k, n) for w, n in seen.items() if len(k := w.encode()) <= WORD_BYTES]
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in held], pa.binary()), pa.array([n for _, n in held], pa.int64())], names=["word", "n"])

        for b in batches:
            for text in b.column(0).to_pylist():
                for part in model.parts(text)[::2]:
                    seen.update(split(part))
                if len(seen) >= COUNTED_WORDS:
                    yield sums()
        yield sums()

    texts = df.select(F.col(f"`{text_col}`").alias("t")).where("t is not null")
    counts = materialise(texts.mapInArrow(counted, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).withColumn("size", F.floor(F.log2("n") * 16).cast("int")), "word-counts")
    room, least = words, None
    for r in counts.groupBy("size").count().orderBy(F.desc("size")).collect():  # some hundred classes at most
        room -= r["count"]
        if room < 0:
            break
        least = r["size"]
    top = [] if least is None else counts.where(F.col("size") >= least).select("word").collect()
    discard(counts)
    return sorted(bytes(r["word"]) for r in top)


def ship_lexicon(spark, model: Model, words: list[bytes]) -> str:
    """Compile the lexicon and give every executor the file through Spark, which also serves executors that come later; returns its name."""
    folder = tempfile.mkdtemp(prefix="weftgraph-lexicon-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    name = f"lexicon-{hashlib.sha256(b'\\0'.join([model.path.encode(), *words])).hexdigest()[:16]}.bin"
    shipped = spark.sparkContext.__dict__.setdefault("_weftgraph_lexicons", set())
    if name not in shipped:
        Lexicon.write(os.path.join(folder, name), words, model.merged_together(words))
        spark.sparkContext.addFile(os.path.join(folder, name))
        shipped.add(name)
    return name


_worker: dict[tuple, Encoder] = {}


def _encoder(path: str, name: str, odd: str) -> Encoder:
    """The encoder of this worker process, made once and kept between tasks."""
    from pyspark import SparkFiles

    if (path, name) not in _worker:
        _worker.clear()
        _worker[path, name] = Encoder(Model(path), Lexicon(SparkFiles.get(name)), odd)
    return _worker[path, name]


def encode(df: DataFrame, path: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), words: int = LEXICON_WORDS) -> DataFrame:
    """Columns `keep` and `ids array<int>`: every whole text as the model's library encodes it without added begin or end tokens.

    Two passes over the texts: one counts words of all texts for the lexicon,
    on which results never depend, one encodes; no text is shuffled. Strings
    of added tokens in a text become their ids. Null and empty texts have no
    ids; a word of any length is merged whole, in n log n steps. Kept columns
    are passed on unchanged, repeated rows and null ids row by row. Executors
    must be able to open `path`.
    """
    model, odd = Model(path), differing(path)
    name = ship_lexicon(df.sparkSession, model, frequent_words(df, path, text_col, words))

    def work():
        encoder = _encoder(path, name, odd)
        return lambda texts: [encoder(texts)]

    return per_text(df, F.col(f"`{text_col}`"), list(keep), [("ids", "array<int>")], work)


def decode(df: DataFrame, path: str, ids_col: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns `keep` and `text`: the text of each list of ids, special tokens included; null lists are empty texts."""

    python_ready(df.sparkSession)
    given = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)], F.col(f"`{ids_col}`").alias("t"))
    n = len(keep)
    out = T.StructType([*given.schema.fields[:n], T.StructField("t", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(path)
        for b in batches:
            for part in text_slices(b, n):
                yield pa.RecordBatch.from_arrays([*part.columns[:n], model.decoded(part.column(n))], names=out.names)

    return given.mapInArrow(run, out).toDF(*keep, "text")


def op12_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    ids = encode(docs, path).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), "ids")
    return decode(ids, path, keep=("doc_id", "n_tokens", "ids_sha256")).select("doc_id", "n_tokens", "ids_sha256", F.sha2("text", 256).alias("decoded_sha256"))
