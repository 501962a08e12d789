"""Byte-level BPE encoding of a corpus by merge replay (problem 6).

1. Texts are cut into words by masks over code point classes. The distinct words of the corpus are counted, dealt to partitions, and
   replayed there together: an inverted index from token pair to word positions applies every merge in rank order and touches only
   the neighbours of merged positions. Texts aren't shuffled, only distinct words with their counts.
2. The ids of the ``SHARED_WORDS`` most frequent words are sent to the workers; the ids of a text are gathered by word number. Words
   beyond that number, or over ``WORD_BYTES``, are replayed in the same way where a batch has them.

Defined results: null and empty texts give an empty list; blank texts are encoded as they are; strings of special tokens are
ordinary text; columns besides the two named ones are ignored.
"""

from __future__ import annotations

import heapq
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldra.functions.buffers import code_points, raw_bytes, slices, string_column

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: Bytes of text whose masks are held at once.
SLICE_BYTES = 4 << 20
#: Words that a worker remembers before it starts anew.
CACHE_WORDS = 1_000_000
#: Words of the corpus whose ids are sent to all workers, and the longest of them: some 30 MB at most.
SHARED_WORDS, WORD_BYTES = 500_000, 48
#: Distinct words that a partition replays at once.
REPLAYED = 200_000
LETTER, NUMBER, SPACE = 1, 2, 3
#: Fixed values of the pattern that splits text before the merges.
SHORT_TAILS, LONG_TAILS = "stmd", ("re", "ve", "ll")

_state: dict = {}


def byte_letters() -> dict[int, str]:
    """Letter that stands for each byte in the vocabulary: printable Latin-1 itself, the others from U+0100 on in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def load_merges(path: str = TOKENIZER) -> dict[str, np.ndarray]:
    """Sorted pair keys with rank and merged id, and the id of each byte; of fixed size, about 1 MB."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab = model["vocab"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    left = np.array([vocab[a] for a, _ in pairs], np.int64)
    right = np.array([vocab[b] for _, b in pairs], np.int64)
    made = np.array([vocab[a + b] for a, b in pairs], np.int32)
    keys = left << 20 | right
    order = np.argsort(keys)
    letters = byte_letters()
    return {"keys": keys[order], "ranks": order.astype(np.int32), "left": left.astype(np.int32), "right": right.astype(np.int32), "made": made, "bytes": np.array([vocab[letters[b]] for b in range(256)], np.int32)}


def char_classes() -> np.ndarray:
    """Class of each code point: letter, number, white space or other."""
    if "classes" not in _state:
        import regex

        table = np.zeros(0x110000, np.uint8)
        every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
        for name, value in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\p{White_Space}", SPACE)):
            for run in regex.finditer(f"{name}+", every):
                table[ord(run[0][0]) : ord(run[0][-1]) + 1] = value
        _state["classes"] = table
    return _state["classes"]


def word_starts(chars: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Mask of the code points at which a word of the split pattern begins; ``rows`` are row offsets."""
    n = len(chars)
    kind = char_classes()[chars]
    first = np.zeros(n + 1, bool)
    first[rows] = True
    first = first[:n]
    before = np.empty(n, np.uint8)
    before[:1], before[1:] = 0, kind[:-1]
    blank = np.zeros(n, bool)
    blank[1:] = chars[:-1] == 32
    blank &= ~first
    space = kind == SPACE
    start = (kind != before) & ~(blank & ~space)
    # the last of several blanks before a word stands alone or joins that word
    last = np.zeros(n, bool)
    last[:-1] = space[:-1] & ~space[1:] & ~first[1:]
    start |= last & (before == SPACE)
    start |= first
    mark = np.flatnonzero((chars == 39) & (first | ((before != 0) & ~blank)))
    if len(mark):
        ends = rows[np.searchsorted(rows, mark, "right")]
        padded = np.append(chars, [0, 0, 0])
        one, two = padded[mark + 1], padded[mark + 2]
        tail = np.where(np.isin(one, [ord(c) for c in SHORT_TAILS]), 1, 0)
        for a, b in LONG_TAILS:
            tail[(one == ord(a)) & (two == ord(b))] = 2
        tail[mark + tail >= ends] = 0
        mark, tail, ends = mark[tail > 0], tail[tail > 0], ends[tail > 0]
        start[mark + 1] = False
        after = mark + 1 + tail
        start[after[after < ends]] = True
    return start


def replay(words: list[bytes], m: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words in sequence and the offsets of the words in them."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    n = int(offsets[-1])
    sym = m["bytes"][np.frombuffer(b"".join(words), np.uint8)].astype(np.int64)
    nxt, prv = np.arange(1, n + 1), np.arange(-1, n - 1)
    nxt[offsets[1:][sizes > 0] - 1] = -1
    prv[offsets[:-1][sizes > 0]] = -1
    alive = np.ones(n, bool)
    keys, ranks, left, right, made = (m[k] for k in ("keys", "ranks", "left", "right", "made"))

    def rank_of(at: np.ndarray) -> np.ndarray:
        key = sym[at] << 20 | sym[nxt[at]]
        i = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return np.where(keys[i] == key, ranks[i], -1)

    at = np.flatnonzero(nxt >= 0)
    r = rank_of(at)
    at, r = at[r >= 0], r[r >= 0]
    order = np.argsort(r, kind="stable")
    at, r = at[order], r[order]
    cuts = np.flatnonzero(np.append(True, r[1:] != r[:-1])) if len(r) else np.zeros(0, int)
    bounds = np.append(cuts, len(r)).tolist()
    index: dict[int, list[np.ndarray]] = {rank: [at[a:b]] for rank, a, b in zip(r[cuts].tolist(), bounds, bounds[1:])}
    queue = sorted(index)
    while queue:
        rank = heapq.heappop(queue)
        lists = index.pop(rank)
        p = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
        a, b, new = left[rank], right[rank], made[rank]
        p = p[alive[p] & (sym[p] == a) & (nxt[p] >= 0)]
        p = p[sym[nxt[p]] == b]
        if a == b and len(p) > 1:
            keep, taken = [], -1
            for i in np.sort(p).tolist():
                if i != taken:
                    keep.append(i)
                    taken = int(nxt[i])
            p = np.array(keep)
        if not len(p):
            continue
        gone = nxt[p]
        after = nxt[gone]
        sym[p] = new
        alive[gone] = False
        nxt[p] = after
        has = after >= 0
        prv[after[has]] = p[has]
        back = prv[p]
        touched = np.concatenate([p[has], back[back >= 0]])
        if not len(touched):
            continue
        found = rank_of(touched)
        good = found >= 0
        touched, found = touched[good], found[good]
        if not len(found):
            continue
        order = np.argsort(found, kind="stable")
        touched, found = touched[order], found[order]
        cuts = np.flatnonzero(np.append(True, found[1:] != found[:-1]))
        bounds = np.append(cuts, len(found)).tolist()
        for next_rank, s, e in zip(found[cuts].tolist(), bounds, bounds[1:]):
            if next_rank in index:
                index[next_rank].append(touched[s:e])
            else:
                index[next_rank] = [touched[s:e]]
                heapq.heappush(queue, next_rank)
    left_over = np.concatenate([[0], np.cumsum(alive)])
    return sym[alive].astype(np.int32), left_over[offsets]


class Encoder:
    """Encodes Arrow string columns; remembers the words it has met."""

    def __init__(self, merges: dict[str, np.ndarray], shared: pa.Table | None = None):
        """``shared``: words (word, ids) whose ids are known from the start."""
        self.merges, self.shared = merges, shared
        self.forget()

    def forget(self) -> None:
        self.number: dict[bytes, int] = {}
        self.values, self.offsets = np.zeros(0, np.int32), np.zeros(1, np.int64)
        if self.shared is not None and self.shared.num_rows:
            words, ids = (self.shared[c].combine_chunks() for c in ("word", "ids"))
            self.number = {w: i for i, w in enumerate(words.to_pylist())}
            self.values = ids.flatten().to_numpy().astype(np.int32)
            self.offsets = np.append(0, np.cumsum(ids.value_lengths().to_numpy())).astype(np.int64)

    def learn(self, words: list[bytes]) -> None:
        values, offsets = replay(words, self.merges)
        self.number.update(zip(words, range(len(self.number), len(self.number) + len(words))))
        self.offsets = np.concatenate([self.offsets, offsets[1:] + len(self.values)])
        self.values = np.concatenate([self.values, values])

    def words(self, column: pa.LargeStringArray) -> tuple[np.ndarray, list[bytes], np.ndarray]:
        """Number of each word occurrence among the distinct words, those words, and the rows' offsets in the occurrences."""
        chars, rows, byte_at, data = code_points(column)
        if not len(chars):
            return np.zeros(0, np.int64), [], np.zeros(len(rows), np.int64)
        starts = np.flatnonzero(word_starts(chars, rows))
        cuts = np.append(byte_at[starts], len(data)).astype(np.int64)
        every = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(cuts), pa.py_buffer(data)])
        coded = every.dictionary_encode()
        return coded.indices.to_numpy(), coded.dictionary.to_pylist(), np.searchsorted(starts, rows)

    def encode(self, column) -> pa.LargeListArray:
        """List of ids of each row."""
        column = string_column(column)
        if len(self.number) > CACHE_WORDS + (self.shared.num_rows if self.shared is not None else 0):
            self.forget()
        _, at = raw_bytes(column)
        parts = [self.words(column.slice(a, b - a)) for a, b in slices(np.diff(at), SLICE_BYTES)]
        new = {w: None for _, words, _ in parts for w in words if w not in self.number}
        if new:
            self.learn(list(new))
        known = pa.LargeListArray.from_arrays(pa.array(self.offsets, pa.int64()), pa.array(self.values, pa.int32()))
        out = []
        for codes, words, rows in parts:
            number = np.fromiter((self.number[w] for w in words), np.int64, len(words))
            taken = known.take(pa.array(number[codes], pa.int64()))
            ends = np.frombuffer(taken.buffers()[1], np.int64)[taken.offset : taken.offset + len(taken) + 1] if len(taken) else np.zeros(1, np.int64)
            out.append(pa.LargeListArray.from_arrays(pa.array(ends[rows] - ends[0], pa.int64()), taken.flatten() if len(taken) else pa.array([], pa.int32())))
        return pa.concat_arrays(out) if out else pa.array([], pa.large_list(pa.int32()))


def corpus_words(df: DataFrame, text_col: str, merges) -> DataFrame:
    """Distinct words of a text column with their number and ids: ``(word BINARY, n, ids ARRAY<INT>)``; those over ``WORD_BYTES`` are left out."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Encoder(merges.value)
        seen: dict[bytes, int] = {}

        def counted() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            column = string_column(batch.column(0))
            for a, b in slices(np.diff(raw_bytes(column)[1]), SLICE_BYTES):
                codes, words, _ = own.words(column.slice(a, b - a))
                for w, n in zip(words, np.bincount(codes, minlength=len(words)).tolist()):
                    if len(w) <= WORD_BYTES:
                        seen[w] = seen.get(w, 0) + n
            if len(seen) > CACHE_WORDS:
                yield counted()
                seen.clear()
        yield counted()

    def replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in gathered(batches, REPLAYED):
            values, offsets = replay(table["word"].to_pylist(), merges.value)
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))
            yield pa.RecordBatch.from_arrays([table["word"].combine_chunks(), table["n"].combine_chunks(), ids], ["word", "n", "ids"])

    return df.select(text_col).mapInArrow(cut, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n")).mapInArrow(replayed, "word binary, n bigint, ids array<int>")


def gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Batches put together to tables of ``rows`` or more, and a rest."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def learned(spark: SparkSession, df: DataFrame, text_col: str, tokenizer: str):
    """What workers need to encode the texts of ``df``: the merges and the ids of the most frequent words, broadcast."""
    merges = spark.sparkContext.broadcast(load_merges(tokenizer))
    top = corpus_words(df, text_col, merges).orderBy(F.desc("n"), "word").limit(SHARED_WORDS).select("word", "ids").toArrow()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, top.schema) as out:
        out.write_table(top)
    return spark.sparkContext.broadcast((uuid.uuid4().hex, merges.value, sink.getvalue().to_pybytes()))


def encoder(shared: tuple[str, dict[str, np.ndarray], bytes]) -> Encoder:
    """The encoder of this worker for one broadcast; kept between tasks."""
    name, merges, words = shared
    if _state.get("name") != name:
        _state["name"], _state["encoder"] = name, Encoder(merges, pa.ipc.open_stream(words).read_all())
    return _state["encoder"]


def encode_texts(spark: SparkSession, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """``(id_col, ids ARRAY<INT>)``: the ids of every text."""
    shared = learned(spark, df, text_col, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(shared.value)
        for batch in batches:
            ids = own.encode(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids.cast(pa.list_(pa.int32()))], ["id", "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def token_counts(spark: SparkSession, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """``(id_col, n_tokens BIGINT)``; 0 for null and empty texts."""
    shared = learned(spark, df, text_col, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), own.encode(batch.column(1)).value_lengths()], ["id", "n_tokens"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"id {kind}, n_tokens bigint").withColumnRenamed("id", id_col)
