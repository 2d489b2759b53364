"""Problem 7: filling containers of fixed capacity with texts, sized in tokens.

Best-two-fit. Texts are counted in tokens of a public tokenizer; one larger than a container is
divided into full containers and a rest, all others stay whole. The narrow rows (key, piece, size)
are spread by a digest of key and piece over shards whose number follows their count, so that a
shard has a bounded number of rows however many texts there are, and the packing doesn't depend on
how the table is partitioned. Within a shard a
container is filled greedily with the largest piece that still fits; then, as long as it pays, its
smallest piece gives way to the two unpacked pieces that fit the widened gap most tightly. Sizes
are held as bit sets, so a step looks at no list of pieces. A shard leaves at most a handful of
containers half full.

Defined results: null and empty texts take no room and come out with a null container; equal
texts are packed each, rows delivered twice too; ties in size go in order of key and piece; texts of any length are counted
whole.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lindero.session import cut_lineage

CAPACITY = 2048
#: A vocabulary in the tiktoken format; the path must be readable on all executors (a shared folder, or one that addFile ships).
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# How the tokenizer parts a text before it merges bytes.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Rows of a shard, on average.
SHARD = 20_000


@lru_cache(4)
def _encoding(path: str, pattern: str):  # noqa: ANN202
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER, pattern: str = PATTERN) -> DataFrame:
    """(key, n_tokens): 0 for null and empty texts."""
    kind = documents.schema[key].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(tokenizer, pattern)
        for batch in batches:
            sizes = [len(encoding.encode_ordinary(t)) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=[key, "n_tokens"])

    return documents.select(key, text).mapInArrow(count, f"`{key}` {kind}, n_tokens long")


def divided(counts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """`counts` with a row for each piece: piece_no from 1, first_token, n_tokens (at most `capacity`)."""
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("n_tokens") - 1, F.lit(0)), F.lit(capacity).cast("long"))
    rows = counts.select("*", F.posexplode(starts).alias("_piece", "first_token"))
    size = F.least(F.lit(capacity).cast("long"), F.col("n_tokens") - F.col("first_token"))
    return rows.withColumn("n_tokens", size).withColumn("piece_no", F.col("_piece") + 1).drop("_piece")


def best_two_fit(sizes: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """The container of each piece; sizes must lie in 1..capacity."""
    by_size: dict[int, list[int]] = {}
    for place in range(len(sizes) - 1, -1, -1):
        by_size.setdefault(int(sizes[place]), []).append(place)
    have = mirror = 0
    for size in by_size:
        have |= 1 << size
        mirror |= 1 << (capacity - size)
    out = np.full(len(sizes), -1, np.int64)

    def take(size: int) -> int:
        nonlocal have, mirror
        place = by_size[size].pop()
        if not by_size[size]:
            have &= ~(1 << size)
            mirror &= ~(1 << (capacity - size))
        return place

    def give(size: int, place: int) -> None:
        nonlocal have, mirror
        by_size[size].append(place)
        have |= 1 << size
        mirror |= 1 << (capacity - size)

    def pair(least: int, most: int) -> tuple[int, int] | None:
        """Two unpacked sizes with the largest sum in least..most."""
        for total in range(most, least - 1, -1):
            both = have & (mirror >> (capacity - total)) & ((1 << total) - 1)
            while both:
                large = both.bit_length() - 1
                if 2 * large < total:
                    break
                if 2 * large > total or len(by_size[large]) > 1:
                    return large, total - large
                both &= ~(1 << large)
        return None

    container = 0
    while have:
        room, held = capacity, []
        while (have & ((1 << (room + 1)) - 1)).bit_length() > 1:
            size = (have & ((1 << (room + 1)) - 1)).bit_length() - 1
            held.append((size, take(size)))
            room -= size
        while room and have:
            smallest = min(held)
            found = pair(smallest[0] + 1, smallest[0] + room)
            if not found:
                break
            held.remove(smallest)
            held += [(size, take(size)) for size in found]
            give(*smallest)
            room += smallest[0] - sum(found)
        for _, place in held:
            out[place] = container
        container += 1
    return out


def pack(counts: DataFrame, key: str = "doc_id", capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """(container_id, key, piece_no, first_token, n_tokens) from (key, n_tokens)."""
    rows = cut_lineage(divided(counts.select(key, "n_tokens"), capacity).groupBy(key, "piece_no", "first_token", "n_tokens").agg(F.count("*").alias("_copies")))
    total = rows.agg(F.sum("_copies")).collect()[0][0] or 0
    shards = max(1, -(-total // shard))
    rows = rows.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "_copies"))).drop("_copies")
    spread = rows.withColumn("_shard", F.pmod(F.xxhash64(key, "piece_no", "_copy"), F.lit(shards)))
    kind = counts.schema[key].dataType.simpleString()

    def fill(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values([key, "piece_no"], kind="stable", ignore_index=True)
        number = best_two_fit(part["n_tokens"].to_numpy(), capacity)
        part["container_id"] = (np.int64(part["_shard"].iloc[0]) << 32) + number
        return part[["container_id", key, "piece_no", "first_token", "n_tokens"]]

    schema = f"container_id long, `{key}` {kind}, piece_no int, first_token long, n_tokens long"
    full = spread.filter("n_tokens > 0").groupBy("_shard").applyInPandas(fill, schema)
    empty = rows.filter("n_tokens <= 0").select(F.lit(None).cast("long").alias("container_id"), key, F.col("piece_no").cast("int"), "first_token", F.lit(0).cast("long").alias("n_tokens"))
    return full.unionByName(empty)


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, tokens, share of the room that is used, containers that are full."""
    each = packed.filter("container_id is not null").groupBy("container_id").agg(F.sum("n_tokens").alias("tokens"))
    return each.agg(
        F.count("*").alias("containers"),
        F.sum("tokens").alias("tokens"),
        F.round(F.sum("tokens") / (F.count("*") * capacity), 6).alias("used_share"),
        F.count(F.when(F.col("tokens") == capacity, 1)).alias("full_containers"),
    )
