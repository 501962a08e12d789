"""Records that share most of their content (problem 2), exact under the Jaccard similarity of word shingle sets.

1. A record becomes its set of hashed shingles; equal sets form a class, of which the lowest id goes on.
2. Segment popcounts: the hash space is cut into ``FINE`` segments and a set is mapped to its number of hashes in each. The
   Manhattan distance of two such maps is never above the number of hashes that only one of the sets has, and that is at most
   (1 - t) / (1 + t) of both sizes where the similarity is t or more. Their sum, the size, is the grid on which sets are joined by
   range; the distance over ``SEGMENTS`` joint segments, then over all, rules pairs out before any text is compared.
3. With t = 0.6 and some 50 shingles a text the grid alone leaves near every pair, so it is laid out per shared shingle: sets of
   similarity t share one of their n - ceil(t n) + 1 first shingles in any common order. Here rare shingles come first, by the
   counts of one of ``SAMPLE_SHARE`` records, made on the executors (the order decides the cost, never the result). Shingles in
   very many sets are cut into blocks and the blocks joined pairwise, so no group goes to one task.
4. The pairs left are verified on their texts.

Three forms of the result, of which the last two are whole for classes of any size:

``similar_pairs``    pairs of records. Classes over ``members`` records are not multiplied out: beside its lowest ids such a class
                     keeps the lowest id of a second group, and each further record is linked to the first kept of the class (and
                     of each similar class) that has another group. ``members=None`` multiplies every class out.
``similar_links``    one row per record: its class and the number of its similar records in other groups, counted exactly.
``similar_classes``  pairs of classes, each named by its lowest id; with the classes of ``similar_links`` all pairs follow.

Defined results: null ids, null groups and texts of too few words are in no pair and no class; ids are taken to be unique, a
repeated id counts as a further record of its class; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veldra.functions.buffers import ranges
from veldra.llm.shingles import mix, shingle_sets
from veldra.runtime import broadcast_checked, materialize, release

FINE, SEGMENTS = 128, 32
KEY_BYTES = 5  # of a shingle's hash; equal keys of other shingles only cost a comparison
MEMBERS = 32
SAMPLE_LEAST, SAMPLE_SHARE = 20_000, 15  # the sample is one of SAMPLE_SHARE records, and at least SAMPLE_LEAST
COMMON = 500_000  # shingles of the sample whose count is kept: the only thing sent to the driver and back, 16 bytes each
BLOCK = 40_000  # sets with one shingle that are joined at once
PART_KEYS = 400_000  # records of a part, the unit that is joined in memory; there are as many parts as that takes
MOST_TASKS = 8192  # tasks the parts are dealt to, one part after another
HELD = 1_000_000  # records held before they are packed, so that packets stay large however many parts there are
CHUNK = 400_000
NEEDED = 500_000  # ids of a pair, up to which they are sent to the texts; beyond it the texts are shuffled to them


def _starts(owner: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else np.zeros(0, np.int64)


def prefix_length(n: np.ndarray, t: float) -> np.ndarray:
    return n - np.ceil(t * n - 1e-9).astype(np.int64) + 1


def _profile(texts: list[str | None], words: int, t: float, common: tuple[np.ndarray, np.ndarray]) -> tuple:
    """Of each text with shingles: its place, digest, size, segment counts (4 bits each), first shingles in the common order."""
    owner, s = shingle_sets(texts, words)
    first = _starts(owner)
    places, n = owner[first], np.diff(np.append(first, len(owner)))
    if not len(first):
        return places, *(np.zeros(0, np.uint64),) * 2, n, np.zeros((0, FINE // 2), np.uint8), s, n
    h1, h2 = np.add.reduceat(mix(s, 0xD6E8FEB86659FD93), first), np.add.reduceat(mix(s, 0xA0761D6478BD642F), first)
    number = np.repeat(np.arange(len(first)), n)
    seg = np.minimum(np.bincount(number * FINE + (s >> np.uint64(57)).astype(np.int64), minlength=len(first) * FINE), 15).astype(np.uint8).reshape(-1, FINE)
    known, times = common
    seen = np.zeros(len(s), np.int64)
    if len(known):
        i = np.minimum(np.searchsorted(known, s), len(known) - 1)
        seen = np.where(known[i] == s, times[i], 0)
    order = np.lexsort((s, seen, number))
    rank = np.arange(len(s)) - np.repeat(first, n)
    take = rank < np.repeat(prefix_length(n, t), n)
    return places, h1, h2, n, seg[:, 0::2] | (seg[:, 1::2] << 4), s[order][take], prefix_length(n, t)


def _binaries(values: np.ndarray, lengths: np.ndarray) -> pa.LargeBinaryArray:
    cuts = np.append(0, np.cumsum(lengths)).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(values).view(np.uint8))])


def _sets(df: DataFrame, words: int, t: float, shared, full: bool) -> DataFrame:
    """``df``: id, grp, text. One row per record with shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 4000):
                part = batch.slice(a, 4000)
                places, h1, h2, n, seg, pre, lengths = _profile(part.column(2).to_pylist(), words, t, shared.value)
                at = pa.array(places)
                columns = [part.column(0).take(at), part.column(1).take(at), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64))]
                if full:
                    columns += [pa.array(n, pa.int32()), _binaries(seg.ravel(), np.full(len(n), FINE // 2)).cast(pa.binary()), _binaries(pre.view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES], lengths * KEY_BYTES).cast(pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "grp", "h1", "h2", "n", "seg", "pre"][: len(columns)])

    return df.mapInArrow(run, "id bigint, grp string, h1 bigint, h2 bigint" + ", n int, seg binary, pre binary" * full)


def sample_size(total: int) -> int:
    return min(max(total // SAMPLE_SHARE, SAMPLE_LEAST), max(total, 1))


def _sample_counts(df: DataFrame, total: int, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that occur in more than one record of the sample, with their counts; the ``COMMON`` most frequent, counted on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [shingle_sets(batch.column(0).to_pylist()[a : a + 4000], words)[1] for batch in batches for a in range(0, batch.num_rows, 4000)]
        s, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *held]), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64)), pa.array(n)], ["s", "n"])

    part = int(np.ceil(min(1.0, sample_size(total) / max(total, 1)) * 1_000_003))
    texts = df.filter(F.pmod(F.xxhash64("id"), F.lit(1_000_003)) < part).select("text")
    counts = texts.mapInArrow(run, "s bigint, n bigint").groupBy("s").agg(F.sum("n").alias("n")).filter("n > 1")
    top = counts.orderBy(F.desc("n"), "s").limit(COMMON).toArrow()
    s, times = top["s"].to_numpy().view(np.uint64), top["n"].to_numpy()
    order = np.argsort(s)
    return s[order], times[order]


#: A set under one of its first shingles. 32 bits of the key are kept beside the part, so false meetings stay as rare at any size.
RECORD = np.dtype([("key", "u4"), ("id", "i8"), ("n", "u4"), ("pos", "u4"), ("block", "u2"), ("twin", "u2"), ("seg", "u1", (SEGMENTS // 2,))])


def _counts(packed: np.ndarray) -> np.ndarray:
    """Unpacked segment counts of rows of bytes."""
    out = np.empty((len(packed), packed.shape[1] * 2), np.int8)
    out[:, 0::2], out[:, 1::2] = packed & 15, packed >> 4
    return out


def _pack(r: np.ndarray) -> bytes:
    """Compressed records in order of id, the steps from id to id, byte by byte of the fields, so that equal bytes stand together."""
    r = r[np.argsort(r["id"], kind="stable")]
    r["id"][1:] -= r["id"][:-1].copy()
    planes = np.ascontiguousarray(r).view(np.uint8).reshape(len(r), RECORD.itemsize).T
    return len(r).to_bytes(8, "little") + pa.compress(np.ascontiguousarray(planes).tobytes(), "zstd", asbytes=True)


def _unpack(blob: bytes) -> np.ndarray:
    n = int.from_bytes(blob[:8], "little")
    planes = np.frombuffer(pa.decompress(blob[8:], n * RECORD.itemsize, "zstd", asbytes=True), np.uint8)
    r = planes.reshape(RECORD.itemsize, n).T.copy().view(RECORD).ravel()
    r["id"] = np.cumsum(r["id"])
    return r


def _candidates(r: np.ndarray, t: float) -> np.ndarray:
    """Pairs of ids (lower, higher) of records with one key that the size range, the places in the order and the segments leave."""
    r = r[np.lexsort((r["n"], r["key"]))]
    first = _starts(r["key"])
    size = np.diff(np.append(first, len(r)))
    live = np.repeat(size > 1, size)
    r = r[live]
    if not len(r):
        return np.zeros((0, 2), np.int64)
    first = _starts(r["key"])
    group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(r))))
    n, pos = r["n"].astype(np.int64), r["pos"].astype(np.int64)
    rest = n - pos
    wide = np.int64(1) << 32
    low = np.searchsorted(group * wide + n, group * wide + np.ceil(t * n - 1e-9).astype(np.int64))
    count = np.arange(len(r)) - low
    seg = _counts(r["seg"])
    ids, block, twin = r["id"], r["block"], r["twin"]
    ends = np.cumsum(count)
    out, a = [np.zeros((0, 2), np.int64)], 0
    while a < len(r):
        b = max(int(np.searchsorted(ends, (ends[a - 1] if a else 0) + CHUNK, "right")), a + 1)
        j = np.repeat(np.arange(a, b), count[a:b])
        i = ranges(low[a:b], count[a:b])
        both = n[i] + n[j]
        need = np.ceil(t / (1 + t) * both - 1e-9)
        ok = (np.minimum(rest[i], rest[j]) >= need) & ((block[i] != block[j]) | (twin[i] == block[i]))
        i, j, both, need = i[ok], j[ok], both[ok], need[ok]
        far = np.abs(seg[i] - seg[j]).sum(1, dtype=np.int64)
        ok = far <= both - 2 * need
        i, j = i[ok], j[ok]
        out.append(np.stack([np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])], 1))
        a = b
    found = np.concatenate(out)
    return np.unique(found, axis=0) if len(found) else found


def _near(pairs: DataFrame, sets: DataFrame, t: float) -> DataFrame:
    """Pairs (a, b) that the distance over all segments leaves; ``sets``: id, n, seg."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.num_rows
            x, y = (_counts(np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(m, FINE // 2)) for i in (4, 5))
            both = batch.column(2).to_numpy().astype(np.int64) + batch.column(3).to_numpy()
            ok = np.abs(x - y).sum(1, dtype=np.int64) <= both - 2 * np.ceil(t / (1 + t) * both - 1e-9)
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(ok))

    left, right = (sets.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("seg").alias(f"seg_{c}")) for c in "ab")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "n_a", "n_b", "seg_a", "seg_b").mapInArrow(run, "a bigint, b bigint")


def _verified(pairs: DataFrame, texts: DataFrame, words: int, t: float) -> DataFrame:
    """Pairs (a, b) whose texts have the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4000):
                part = batch.slice(at, 4000)
                oa, sa = shingle_sets(part.column(2).to_pylist(), words)
                ob, sb = shingle_sets(part.column(3).to_pylist(), words)
                o, s = np.concatenate([oa, ob]), np.concatenate([sa, sb])
                order = np.lexsort((s, o))
                o, s = o[order], s[order]
                twice = np.flatnonzero((o[1:] == o[:-1]) & (s[1:] == s[:-1]))
                m = part.num_rows
                both, na, nb = np.bincount(o[twice], minlength=m), np.bincount(oa, minlength=m), np.bincount(ob, minlength=m)
                good = (both > 0) & (both >= t * (na + nb - both) - 1e-9)
                yield pa.RecordBatch.from_arrays(part.columns[:2], ["a", "b"]).filter(pa.array(good))

    left = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a bigint, b bigint")


def _class_pairs(spark: SparkSession, df: DataFrame, sets: DataFrame, lows: DataFrame, words: int, t: float, total: int, shared) -> DataFrame:
    """Similar classes ``(a, b)``, a < b, by their lowest ids ``lows`` (id)."""
    # copies leave by their ids, so that the sets themselves need no shuffle while copies are few
    copies = materialize(sets.select("id").join(lows, "id", "left_anti"), "copies")
    reps = sets.join(broadcast_checked(copies, NEEDED), "id", "left_anti").select("id", "n", "seg", "pre")
    parts = max(8, round(total * 20 / PART_KEYS))
    grown = total / sample_size(total)

    def keyed(batch: pa.RecordBatch, known: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Parts and records of the first shingles of a batch of sets."""
        pre = batch.column(3)
        cuts = np.frombuffer(pre.buffers()[1], np.int32)[pre.offset : pre.offset + len(pre) + 1]
        many = np.diff(cuts) // KEY_BYTES
        wide = np.zeros((int(many.sum()), 8), np.uint8)
        wide[:, :KEY_BYTES] = np.frombuffer(pre.buffers()[2], np.uint8)[cuts[0] : cuts[-1]].reshape(-1, KEY_BYTES)
        s = wide.view(np.uint64).ravel()
        fine = _counts(np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(-1, FINE // 2))
        joint = np.minimum(fine.reshape(-1, SEGMENTS, FINE // SEGMENTS).sum(2, dtype=np.int16), 15).astype(np.uint8)
        seg = joint[:, 0::2] | (joint[:, 1::2] << 4)
        r = np.zeros(len(s), RECORD)
        row = np.repeat(np.arange(len(many)), many)
        key = s.copy()
        r["id"], r["n"] = batch.column(0).to_numpy()[row], batch.column(1).to_numpy()[row]
        r["pos"] = np.arange(len(s)) - np.repeat(np.cumsum(many) - many, many)
        r["seg"] = seg[row]
        if len(known):
            i = np.minimum(np.searchsorted(known, s), len(known) - 1)
            blocks = np.where(known[i] == s, np.ceil(times[i] * grown / BLOCK), 1).astype(np.int64)
            hot = blocks > 1
            if hot.any():
                h, w = r[hot], blocks[hot]
                own = (mix(h["id"].astype(np.uint64)) % w.astype(np.uint64)).astype(np.int64)
                copied, again = np.repeat(h, w), np.repeat(key[hot], w)
                b, c = np.repeat(own, w), ranges(np.zeros(len(w), np.int64), w)
                copied["block"], copied["twin"] = b, c
                pair = (np.minimum(b, c) << 16 | np.maximum(b, c)).astype(np.uint64)
                r, key = np.concatenate([r[~hot], copied]), np.concatenate([key[~hot], mix(again + mix(pair + np.uint64(7)))])
        key = mix(key)
        r["key"] = key & np.uint64(0xFFFFFFFF)
        return ((key >> np.uint64(32)) % np.uint64(parts)).astype(np.int64), r

    def packets(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        part, r = np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])
        order = np.argsort(part, kind="stable")
        part, r = part[order], r[order]
        first = _starts(part)
        ends = [*first[1:].tolist(), len(r)]
        blobs = [_pack(r[a:b]) for a, b in zip(first.tolist(), ends)]
        return pa.RecordBatch.from_arrays([pa.array(part[first], pa.int32()), pa.array(blobs, pa.binary())], ["part", "records"])

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, times = shared.value
        known = known & np.uint64((1 << 8 * KEY_BYTES) - 1)
        order = np.argsort(known)
        known, times = known[order], times[order]
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(keyed(batch, known, times))
                size += len(held[-1][0])
            if size >= HELD:
                yield packets(held)
                held, size = [], 0
        if size:
            yield packets(held)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def close() -> Iterator[pa.RecordBatch]:
            if held:
                pairs = _candidates(np.concatenate([_unpack(x) for x in held]), t)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        for batch in batches:
            for part, records in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if part != now:
                    yield from close()
                    now, held = part, []
                held.append(records)
        yield from close()

    spread = reps.mapInArrow(keys, "part int, records binary").repartitionById(min(parts, MOST_TASKS), "part").sortWithinPartitions("part")
    candidates = materialize(_near(spread.mapInArrow(join, "a bigint, b bigint").distinct(), reps.select("id", "n", "seg"), t), "candidates")
    needed = candidates.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    pairs = materialize(_verified(candidates, df.select("id", "text").join(broadcast_checked(needed, NEEDED), "id", "left_semi"), words, t), "pairs")
    release(copies, candidates)
    return pairs


def _begun(spark: SparkSession, df: DataFrame, id_col: str, group_col: str, text_col: str, words: int, t: float) -> tuple:
    """Usable rows (id, grp, text), their number, the shared counts of shingles, the sets of the rows."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(group_col).cast("string").alias("grp"), F.col(text_col).alias("text")).filter("id is not null and grp is not null and text is not null")
    total = rows.count()
    shared = spark.sparkContext.broadcast(_sample_counts(rows, total, words))  # at most COMMON
    return rows, total, shared, materialize(_sets(rows, words, t, shared, True), "sets")


def similar_pairs(spark: SparkSession, df: DataFrame, id_col: str = "row_id", group_col: str = "doc_id", text_col: str = "text", words: int = 5, t: float = 0.8, members: int | None = MEMBERS) -> DataFrame:
    """``(row_a, row_b)``, row_a < row_b: similar records of different groups."""
    rows, total, shared, sets = _begun(spark, df, id_col, group_col, text_col, words, t)
    order = Window.partitionBy("h1", "h2").orderBy("id")
    firsts = sets.select("id", "grp", "h1", "h2").withColumn("rn", F.row_number().over(order))
    firsts = materialize(firsts if members is None else firsts.filter(F.col("rn") <= members + 1), "firsts")
    pairs = _class_pairs(spark, rows, sets, firsts.filter("rn = 1").select("id"), words, t, total, shared)
    classes = firsts.groupBy("h1", "h2").agg(F.sort_array(F.collect_list(F.struct("id", "grp"))).alias("members"))
    classes = classes.select("h1", "h2", F.col("members")[0]["id"].alias("id"), "members")
    full = classes.filter("false") if members is None else classes.filter(F.size("members") > members)
    if members is not None and full.limit(1).count():
        kept = full.select("h1", "h2", F.col("id").alias("rep"), F.col("members")[members]["id"].alias("last"), F.array_distinct("members.grp").alias("groups"))
        narrow = sets.select("id", "grp", "h1", "h2").join(broadcast_checked(kept), ["h1", "h2"]).filter(F.col("id") > F.col("last"))
        narrow = materialize(narrow.select("id", "grp", "rep", F.when(F.size("groups") == 1, F.col("groups")[0]).alias("only")), "beyond")
        # kept members of one group alone would leave the further records of that group without a partner
        second = narrow.filter("grp <> only").groupBy("rep").agg(F.min(F.struct("id", "grp")).alias("second"))
        second = broadcast_checked(materialize(second, "second"))
        listed = F.when(F.col("second").isNull(), F.col("members")).otherwise(F.concat("members", F.array("second")))
        classes = classes.join(second.withColumnRenamed("rep", "id"), "id", "left").select("id", listed.alias("members"))
        beyond = narrow.join(second, "rep", "left").filter("second is null or id <> second.id").select("id", "grp", "rep")
    else:
        classes = classes.select("id", "members")
        beyond = classes.filter("false").select("id", F.lit("").alias("grp"), F.col("id").alias("rep"))
    several = classes.filter(F.size("members") > 1)
    inner = several.select(F.explode("members").alias("x"), "members").select("x", F.explode("members").alias("y")).filter("x.id < y.id and x.grp <> y.grp")
    ends = classes.join(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "id", "left_semi")
    ends = materialize(ends, "ends")
    sides = pairs.join(ends.select(F.col("id").alias("a"), F.col("members").alias("xs")), "a").join(ends.select(F.col("id").alias("b"), F.col("members").alias("ys")), "b")
    outer = sides.select(F.explode("xs").alias("x"), "ys").select("x", F.explode("ys").alias("y")).filter("x.grp <> y.grp")
    # further records of full classes: one link to their class and to each class similar to it
    links = pairs.select(F.col("a").alias("rep"), F.col("b").alias("other")).unionAll(pairs.select(F.col("b"), F.col("a"))).unionAll(several.select("id", "id"))
    far = beyond.join(links, "rep").join(classes.select(F.col("id").alias("other"), "members"), "other")
    far = far.select(F.struct("id", "grp").alias("x"), F.expr("get(filter(members, m -> m.grp <> grp), 0)").alias("y")).filter("y is not null")
    every = inner.unionAll(outer).unionAll(far)
    return every.select(F.least("x.id", "y.id").alias("row_a"), F.greatest("x.id", "y.id").alias("row_b"))


def _grouped(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Numbers of records by class and group ``(h1, h2, grp, n, low)``; classes ``(h1, h2, rep, total, groups)``. A hot class is counted before the shuffle."""
    groups = materialize(sets.groupBy("h1", "h2", "grp").agg(F.count("*").alias("n"), F.min("id").alias("low")), "groups")
    return groups, groups.groupBy("h1", "h2").agg(F.min("low").alias("rep"), F.sum("n").alias("total"), F.count("*").alias("groups"))


def similar_classes(spark: SparkSession, df: DataFrame, id_col: str = "row_id", group_col: str = "doc_id", text_col: str = "text", words: int = 5, t: float = 0.8) -> DataFrame:
    """``(class_a, class_b)``, class_a < class_b: similar classes of records with equal shingles, each named by its lowest id, of any group."""
    rows, total, shared, sets = _begun(spark, df, id_col, group_col, text_col, words, t)
    lows = materialize(_grouped(sets)[1].select(F.col("rep").alias("id")), "lows")
    return _class_pairs(spark, rows, sets, lows, words, t, total, shared).select(F.col("a").alias("class_a"), F.col("b").alias("class_b"))


def similar_links(spark: SparkSession, df: DataFrame, id_col: str = "row_id", group_col: str = "doc_id", text_col: str = "text", words: int = 5, t: float = 0.8) -> DataFrame:
    """``(id_col, class_id, links)`` of each record with shingles: the lowest id of its class, and how many records of other groups are similar to it.

    The number is summed over classes: all records of the own and the similar classes, less those of the record's own group. Of two
    similar classes the one of fewer groups is sent to the other, so a class that holds a third of all rows isn't multiplied.
    """
    rows, total, shared, sets = _begun(spark, df, id_col, group_col, text_col, words, t)
    groups, classes = _grouped(sets)
    classes = materialize(classes, "classes")
    pairs = _class_pairs(spark, rows, sets, classes.select(F.col("rep").alias("id")), words, t, total, shared)
    named = materialize(groups.join(classes, ["h1", "h2"]).select("h1", "h2", "rep", "grp", "n", "total"), "named")
    side = lambda c: classes.select(F.col("rep").alias(c), F.col("total").alias(f"total_{c}"), F.col("groups").alias(f"groups_{c}"))
    wide = materialize(pairs.join(side("a"), "a").join(side("b"), "b"), "wide")
    near = wide.select(F.col("a").alias("rep"), F.col("total_b").alias("n")).unionAll(wide.select("b", "total_a")).groupBy("rep").agg(F.sum("n").alias("near"))
    fewer = F.col("groups_a") <= F.col("groups_b")
    sent = wide.select(F.when(fewer, F.col("a")).otherwise(F.col("b")).alias("rep"), F.when(fewer, F.col("b")).otherwise(F.col("a")).alias("other"))
    sent = sent.join(named.select("rep", "grp", "n"), "rep")
    met = sent.join(named.select(F.col("rep").alias("other"), "grp", F.col("n").alias("m")), ["other", "grp"])
    own = met.select("rep", "grp", F.col("m").alias("n")).unionAll(met.select("other", "grp", "n")).groupBy("rep", "grp").agg(F.sum("n").alias("own"))
    linked = named.join(near, "rep", "left").join(own, ["rep", "grp"], "left")
    linked = linked.select("h1", "h2", "grp", "rep", (F.col("total") - F.col("n") + F.coalesce("near", F.lit(0)) - F.coalesce("own", F.lit(0))).alias("links"))
    out = sets.select("id", "grp", "h1", "h2").join(linked, ["h1", "h2", "grp"])
    return out.select(F.col("id").alias(id_col), F.col("rep").alias("class_id"), "links")
