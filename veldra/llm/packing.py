"""Filling containers of fixed capacity with texts (problem 7).

Sizes are whole numbers up to the capacity, so the whole instance is a histogram of at most ``capacity`` counts, however many
texts there are. The plan is made on that histogram: the Martello-Toth reduction fixes containers that provably dominate every
alternative, best fit in falling size places the rest, and equal containers are handled as one pattern with a multiplicity.
The plan then gives each text its container by its size and its rank among the texts of that size. Ranks are counted within
(size, salt), with a salt for each ``SALT_ROWS`` texts of a size, so a size that a third of all rows share is spread over as many
groups as that takes. Texts are never shuffled.

Defined results: a text over the capacity is cut into pieces of the capacity and a rest; every other text is one piece; null and
empty texts are one piece without tokens in one of the containers (container 0 if there is none); ids may repeat.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veldra.llm.bpe import TOKENIZER, token_counts
from veldra.runtime import materialize

CAPACITY = 2048
SALT_ROWS = 100_000

Pattern = tuple[tuple[tuple[int, int], ...], int]


def largest_pair(sizes: np.ndarray, room: int) -> int:
    """Largest sum of two of the sorted ``sizes`` (one may be taken twice) within ``room``; 0 if there is none."""
    at = np.searchsorted(sizes, room - sizes, "right") - 1
    ok = at >= 0
    return int((sizes[ok] + sizes[at[ok]]).max(initial=0))


def reduce_instance(counts: np.ndarray, capacity: int) -> list[Pattern]:
    """Fix containers by dominance, until no rule holds any more, and take their items out of ``counts``."""
    fixed: list[Pattern] = []

    def fix(times: int, *sizes: int) -> None:
        items: dict[int, int] = {}
        for s in sizes:
            items[s] = items.get(s, 0) + 1
        for s, k in items.items():
            counts[s] -= k * times
        fixed.append((tuple(sorted(items.items(), reverse=True)), times))

    done = -1
    while done < len(fixed):  # what is fixed takes items away, by which more may be dominated
        done = len(fixed)
        for s in range(capacity, 0, -1):
            while counts[s] > 0:
                room = capacity - s
                counts[s] -= 1  # the others
                others = np.flatnonzero(counts[: room + 1])
                least: list[int] = []
                for x in np.flatnonzero(counts)[:3].tolist():
                    least += [x] * int(min(counts[x], 3 - len(least)))
                counts[s] += 1
                if not len(others):
                    # alone: nothing else fits
                    fix(int(counts[s]) if s > room else 1, s)
                    continue
                best = int(others[-1])
                times = int(counts[s] // 2) if best == s else int(min(counts[s], counts[best]))
                if best == room or len(least) < 2 or least[0] + least[1] > room:
                    # the rest filled exactly, or one more item at most: the largest that fits dominates
                    fix(times, s, best)
                    continue
                if len(least) < 3 or sum(least) > room:
                    # two more at most: one item as large as any pair dominates
                    if best >= largest_pair(others, room):
                        fix(times, s, best)
                        continue
                break
    return fixed


def best_fit(counts: np.ndarray, capacity: int) -> list[Pattern]:
    """Best fit in falling size; containers with the same content are one pattern."""
    by_room: dict[int, list[list]] = {}

    def put(room: int, items: tuple, times: int) -> None:
        if times:
            by_room.setdefault(room, []).append([items, times])

    for s in range(capacity, 0, -1):
        n = int(counts[s])
        for room in sorted(r for r in by_room if r >= s):
            if not n:
                break
            k = room // s
            groups = by_room.pop(room)
            while groups:
                items, times = groups.pop()
                use = min(times, n // k)
                put(room - k * s, (*items, (s, k)), use)
                n, times = n - use * k, times - use
                if times and 0 < n < k:
                    put(room - n * s, (*items, (s, n)), 1)
                    n, times = 0, times - 1
                if times:
                    put(room, items, times)
                    for rest in groups:
                        put(room, *rest)
                    break
        k = capacity // s
        put(capacity - k * s, ((s, k),), n // k)
        if n % k:
            put(capacity - n % k * s, ((s, n % k),), 1)
    return [(items, times) for room in sorted(by_room) for items, times in by_room[room]]


def plan_containers(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[Pattern], int]:
    """Patterns for items of ``histogram`` (size to number), and how many of them the reduction fixed."""
    counts = np.zeros(capacity + 1, np.int64)
    for s, n in histogram.items():
        counts[s] = n
    counts[0] = 0
    fixed = reduce_instance(counts, capacity)
    return fixed + best_fit(counts, capacity), len(fixed)


def intervals(patterns: list[Pattern]) -> tuple[np.ndarray, np.ndarray, int]:
    """Sorted keys (size, first rank), the container of that rank (the next rank has the next), the number of containers."""
    used: dict[int, int] = {}
    keys, base, at = [], [], 0
    for items, times in patterns:
        for s, k in items:
            for _ in range(k):
                keys.append(s << 44 | used.get(s, 0))
                base.append(at)
                used[s] = used.get(s, 0) + times
        at += times
    order = np.argsort(np.array(keys, np.int64), kind="stable")
    return np.array(keys, np.int64)[order], np.array(base, np.int64)[order], at


def pack_sizes(sizes: DataFrame, id_col: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """Containers for ``sizes`` (id, n_tokens): ``(id, piece_no, token_start, token_end, container_id)``."""
    sizes = sizes.select(F.col(id_col).alias("id"), F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n"))
    pieces = F.explode(F.sequence(F.lit(0), F.greatest(F.expr(f"cast((n - 1) div {capacity} as int)"), F.lit(0))))
    items = sizes.select("id", "n", pieces.alias("piece_no")).select(
        "id", "piece_no", (F.col("piece_no") * capacity).cast("int").alias("token_start"), F.least("n", (F.col("piece_no") + 1) * capacity).cast("int").alias("token_end")
    )
    items = items.withColumn("size", F.col("token_end") - F.col("token_start"))
    histogram = {r["size"]: r["n"] for r in items.groupBy("size").agg(F.count("*").alias("n")).collect()}  # capacity + 1 rows at most
    salts = pa.table({"size": pa.array(list(histogram), pa.int32()), "salts": pa.array([-(-n // SALT_ROWS) for n in histogram.values()], pa.int64())})
    items = items.join(F.broadcast(sizes.sparkSession.createDataFrame(salts)), "size").withColumn("salt", F.pmod(F.xxhash64("id", "piece_no"), F.col("salts"))).drop("salts")
    cells = items.groupBy("size", "salt").count()
    patterns, _ = plan_containers(histogram, capacity)
    keys, base, total = intervals(patterns)
    before = F.sum("count").over(Window.partitionBy("size").orderBy("salt")) - F.col("count")
    ranked = items.withColumn("within", F.row_number().over(Window.partitionBy("size", "salt").orderBy("id", "piece_no")) - 1)
    ranked = ranked.join(cells.select("size", "salt", before.alias("before")), ["size", "salt"]).select("id", "piece_no", "token_start", "token_end", "size", (F.col("before") + F.col("within")).alias("rank"))
    shared = sizes.sparkSession.sparkContext.broadcast((keys, base))  # bounded by the capacity, not by the rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, at = shared.value
        for batch in batches:
            size, rank = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (4, 5))
            key = size << 44 | rank
            if len(first):
                i = np.maximum(np.searchsorted(first, key, "right") - 1, 0)
                container = at[i] + key - first[i]
            else:
                container = np.zeros(len(key), np.int64)
            container = np.where(size > 0, container, rank % max(total, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(container)], ["id", "piece_no", "token_start", "token_end", "container_id"])

    kind = sizes.schema["id"].dataType.simpleString()
    return ranked.mapInArrow(run, f"id {kind}, piece_no int, token_start int, token_end int, container_id bigint").withColumnRenamed("id", id_col)


def pack_texts(spark: SparkSession, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, tokenizer: str = TOKENIZER) -> DataFrame:
    """Containers for the texts of ``df``, sized in tokens; the counts are written once, as the plan needs them before the rows."""
    return pack_sizes(materialize(token_counts(spark, df, id_col, text_col, tokenizer), "sizes"), id_col, capacity)
