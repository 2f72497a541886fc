"""SimHash near-dedup by tiled exact comparison of fingerprints.

All pairs are decided by tiles: rows in the order of their population counts, compared with exclusive-or and bit counts, where
tile pairs whose population counts differ beyond the radius are never met. Tiles over all fingerprints would grow with the
square of the input, so they are laid within groups that share some blocks of bits: with the 64 bits cut into m blocks,
fingerprints that differ in 4 bits share m - 4 whole blocks, so tiles within each choice of m - 4 blocks lose no link. Groups
of few rows are one tile each and are compared many at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import cut, id_text
from .components import components

#: Rows of a tile; a group of more than GROUP rows is cut into cells of tile pairs that tasks share.
TILE, GROUP = 1024, 8192
#: Groups of no more rows are stacked, and cells of a stack that are compared at once.
STACK, CELLS = 32, 1 << 20
#: The bits of each byte.
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
_XX = xxhash.xxh64_intdigest


def bit_majority(hashes: np.ndarray) -> int:
    """The 64 bits that are set in over half of the hashes; of none, zero."""
    planes = hashes.astype(">u8").view(np.uint8).reshape(-1, 8).T
    ones = np.concatenate([np.bincount(plane, minlength=256) @ _BITS for plane in planes])
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprint(text: bytes, shingle: int = 4, seed: int = 42) -> int:
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate((len(w) + 1 for w in words), initial=0))
    k = min(shingle, len(words))
    return bit_majority(np.array([_XX(joined[a : b - 1], seed) for a, b in zip(ends, ends[k:])], np.uint64))


def fingerprints(docs: DataFrame, shingle: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp): lower-cased A-Z, words ``[^\\x20\\x09-\\x0D]+``, shingles with repeats, XXH64."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = np.array([fingerprint(t.encode(), shingle, seed) for t in batch["text"].to_pylist()], np.uint64)
            yield pa.record_batch({"doc_id": batch["doc_id"], "fp": pa.array(marks.view(np.int64))})

    return id_text(docs).mapInArrow(run, "doc_id long, fp long")


def _forest(fp: np.ndarray, radius: int) -> np.ndarray:
    """For distinct fingerprints, the place of one that stands for all that links reach."""
    order = np.argsort(np.bitwise_count(fp), kind="stable")
    f = fp[order]
    pop = np.bitwise_count(f).astype(int)
    parent = np.arange(len(f))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def roots() -> np.ndarray:
        p = parent
        while (q := p[p]) is not p and (q != p).any():
            p = q
        return p

    for i in range(0, len(f), TILE):
        a = f[i : i + TILE]
        for j in range(i, len(f), TILE):
            if pop[j] - pop[i + len(a) - 1] > radius:
                break
            b = f[j : j + TILE]
            near = np.bitwise_count(a[:, None] ^ b[None, :]) <= radius
            while True:
                root = roots()
                apart = near & (root[i : i + len(a), None] != root[None, j : j + len(b)])
                rows = np.flatnonzero(apart.any(1))
                if not len(rows):
                    break
                for x, y in zip(rows.tolist(), apart[rows].argmax(1).tolist()):
                    x, y = find(i + x), find(j + y)
                    parent[max(x, y)] = min(x, y)
    out = np.empty(len(f), np.int64)
    out[order] = order[roots()]
    return out


def links(groups: pa.Table, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect, within each group (choice, key, cell), what fingerprints within the radius connect."""
    key = [groups[c].to_numpy() for c in ("choice", "key", "cell")]
    fp = groups["fp"].to_numpy().view(np.uint64)
    order = np.lexsort((fp, np.bitwise_count(fp), *key))
    key, fp = [k[order] for k in key], fp[order]
    new = np.ones(len(fp), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in key])
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(fp)))
    left, right = [], []
    side = 2
    while side <= STACK:
        chosen = np.flatnonzero((size > side // 2) & (size <= side) & (size > 1))
        upper = np.triu(np.ones((side, side), bool), 1)
        for i in range(0, len(chosen), max(1, CELLS // side**2)):
            own = chosen[i : i + max(1, CELLS // side**2)]
            inside = np.arange(side) < size[own, None]
            tile = fp[np.minimum(at[own, None] + np.arange(side), len(fp) - 1)]
            near = (np.bitwise_count(tile[:, :, None] ^ tile[:, None, :]) <= radius) & inside[:, :, None] & inside[:, None, :] & upper
            g, x, y = np.nonzero(near)
            left.append(tile[g, x])
            right.append(tile[g, y])
        side *= 2
    for g in np.flatnonzero(size > STACK):
        own = fp[at[g] : at[g] + size[g]]
        root = own[_forest(own, radius)]
        left.append(own[own != root])
        right.append(root[own != root])
    return tuple(np.concatenate([np.zeros(0, np.uint64), *x]).view(np.int64) for x in (left, right))


def near_links(fps: DataFrame, radius: int = 4) -> DataFrame:
    """(u, v) links that connect distinct fingerprints ``fp`` wherever differences of ``radius`` bits or fewer connect them."""
    blocks = radius + 1
    rows = fps.count()
    while blocks < 2 * radius and 2 ** (64 * (blocks - radius) / blocks) < 4 * rows:
        blocks += 1
    edge = [round(64 * i / blocks) for i in range(blocks + 1)]
    masks = [sum(((1 << (edge[b + 1] - edge[b])) - 1) << edge[b] for b in chosen) for chosen in combinations(range(blocks), blocks - radius)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keyed = fps.select("fp", F.explode(F.array(*(F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(signed)))).alias("k")).select("fp", "k.choice", "k.key")
    sizes = cut(keyed.groupBy("choice", "key").count().where("count > 1"))  # written, so that Spark can split a hot key in the join
    keyed = keyed.join(sizes, ["choice", "key"])
    # cells of a large group: pairs of tiles (population count, part) whose counts differ by the radius at most
    tiles = f"cast(ceil(count / {GROUP}d) as int)"
    own, pop = f"cast(pmod(xxhash64(fp), {tiles}) as int)", "bit_count(fp)"
    code = "(({0} * 65536L + {1}) * 65 + {2}) * 65536L + {3}"
    cells = f"""if(count <= {GROUP}, array(-1L), flatten(transform(sequence(0, {tiles} - 1), t -> transform(sequence(-{radius}, {radius}), d ->
        case when d > 0 then {code.format(pop, own, f'({pop} + d)', 't')} when d < 0 then {code.format(f'({pop} + d)', 't', pop, own)}
        else {code.format(pop, f'least({own}, t)', pop, f'greatest({own}, t)')} end))))"""
    celled = keyed.withColumn("cell", F.explode(F.expr(cells))).select("choice", "key", "cell", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # rows of the last group, which the next batch may go on with
        for batch in batches:
            rows = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            key = [rows[c].to_numpy() for c in ("choice", "key", "cell")]
            same = np.logical_and.reduce([k == k[-1] for k in key]) if rows.num_rows else np.zeros(0, bool)
            whole = int(rows.num_rows - np.argmin(same[::-1])) if not same.all() else 0
            held = rows.slice(whole)
            if whole:
                u, v = links(rows.slice(0, whole), radius)
                yield pa.record_batch({"u": u, "v": v})
        if held is not None and held.num_rows:
            u, v = links(held, radius)
            yield pa.record_batch({"u": u, "v": v})

    return celled.repartition("choice", "key", "cell").sortWithinPartitions("choice", "key", "cell").mapInArrow(run, "u long, v long")


def simhash_dedup(docs: DataFrame, shingle: int = 4, seed: int = 42, radius: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id that links of ``radius`` differing bits or fewer reach.

    Null and empty texts have fingerprint zero, which is linked like any other; a text of any length is read whole. Each row
    with an id is returned, as often as it is given; rows that share an id have a fingerprint each.
    """
    marks = cut(fingerprints(docs, shingle, seed))
    firsts = cut(marks.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = cut(components(near_links(firsts.select("fp"), radius)))
    named = firsts.join(roots.withColumnRenamed("u", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = cut(named.groupBy("root").agg(F.min("first").alias("component_id")))  # written, so that Spark knows its size
    class_of = named.join(least, "root").select("fp", "component_id")
    return marks.join(class_of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
