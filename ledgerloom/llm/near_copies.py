"""Near copies: SimHash links and MinHash bands propose pairs, the exact similarity of five-word shingles decides.

At a similarity of 0.8 fingerprints of 64 bits differ by about ten bits, give or take three, so no radius that can be
searched finds such pairs by itself. Candidates are therefore the links of the SimHash operator's search and the groups of 24
MinHash bands of 4 rows, which miss a pair of similarity s with probability (1 - s^4)^24, 3e-6 at 0.8. Each is verified by the
Jaccard similarity of the whole shingle sets before components are made, so neither adds a link.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import cut, id_text
from .components import components
from .simhash import bit_majority, near_links

BANDS, ROWS = 24, 4
#: Groups of more rows than this are met through leaders first, then in cells of tile pairs.
SMALL = 16
#: Rows of a tile, and shingles that a row carries into a cell: the smallest hashes of a larger set stand for it.
TILE, SKETCH = 512, 1024
CHUNK = 4096
_r = np.random.default_rng(11)
_FLIP = _r.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)
_TIMES = _r.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_XX = xxhash.xxh64_intdigest


def shingle_hashes(text: bytes, shingle: int = 5) -> tuple[int, np.ndarray]:
    """A hash of the words, and the hashes of their shingles, repeats included; a shorter text is one shingle."""
    words = text.lower().split()
    joined = b" ".join(words)
    ends = list(accumulate((len(w) + 1 for w in words), initial=0))
    k = min(shingle, len(words)) or 1
    return _XX(joined, 1), np.array([_XX(joined[a : b - 1], 42) for a, b in zip(ends, ends[k:])], np.uint64)


def band_keys(marks: np.ndarray) -> np.ndarray:
    if not len(marks):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for i in range(0, len(marks), CHUNK):
        np.minimum(least, ((marks[i : i + CHUNK, None] ^ _FLIP) * _TIMES).min(0), out=least)
    return np.array([_XX(x.tobytes(), b) for b, x in enumerate(least.reshape(BANDS, ROWS))], np.uint64).view(np.int64)


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many hashes each two of the sets share."""
    out = np.zeros((len(sets), len(sets)), np.float32)
    values, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, code, n = np.unique(values, return_inverse=True, return_counts=True)
    rank = np.cumsum(n > 1) - 1  # a hash of one set is shared with none
    row, code = row[n[code] > 1], rank[code[n[code] > 1]]
    order = np.argsort(code, kind="stable")
    row, code = row[order], code[order]
    for lo in range(0, int(code[-1]) + 1 if len(code) else 0, CHUNK):
        i, j = np.searchsorted(code, [lo, lo + CHUNK])
        block = np.zeros((len(sets), CHUNK), np.float32)
        block[row[i:j], code[i:j] - lo] = 1
        out += block @ block.T
    return out


def cell_links(same: np.ndarray, root: np.ndarray, n: np.ndarray, sets: list[np.ndarray], least: float, near: np.ndarray | None = None) -> tuple[list[tuple[int, int, bool]], int]:
    """Links (u, v, whether sure) that join rows of different roots, and how many pairs were met.

    Pairs of whole sets are decided here. Where a sketch stands for a set, pairs within five standard errors of
    ``least`` are left to be verified. near: the pairs that may be links at all.
    """
    shared = shared_counts(sets)
    size = np.array([len(s) for s in sets])
    apart = np.triu(root[:, None] != root[None, :], 1) & (np.minimum(n[:, None], n[None, :]) >= least * np.maximum(n[:, None], n[None, :]))
    apart = apart if near is None else apart & near
    whole = n == size
    sure = whole[:, None] & whole[None, :]
    linked = apart & sure & (shared >= least * (size[:, None] + size[None, :] - shared))
    out, parent = [], {}

    def find(i: int) -> int:
        while parent.get(i, i) != i:
            i = parent[i]
        return i

    rows, cols = np.nonzero(linked)
    _, first = np.unique(np.stack([root[rows], root[cols]]), axis=1, return_index=True)
    for k in first.tolist():
        a, b = find(int(root[rows[k]])), find(int(root[cols[k]]))
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.append((int(same[rows[k]]), int(same[cols[k]]), True))
    close = least - 5 * (least * (1 - least) / SKETCH) ** 0.5
    for i, j in zip(*np.nonzero(apart & ~sure & (shared >= close * close * SKETCH / 2))):
        most = min(sets[k][-1] for k in (i, j) if not whole[k])
        total = sum(int(np.searchsorted(sets[k], most, "right")) for k in (i, j)) - shared[i, j]
        if shared[i, j] >= close * total and find(int(root[i])) != find(int(root[j])):
            out.append((int(same[i]), int(same[j]), False))
    return out, int(apart.sum())


def near_copies(docs: DataFrame, shingle: int = 5, least: float = 0.8, radius: int = 4) -> DataFrame:
    """doc_id and component_id, the smallest doc_id that links of texts with similarity ``least`` or more reach.

    Texts of the same lower-cased words are linked, null and empty ones too; each row with an id is returned, as often as it is
    given. A text of any length is one row of hashes.
    """
    docs = id_text(docs)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [shingle_hashes(t.encode(), shingle) for t in batch["text"].to_pylist()]
            sets = [np.unique(x) for _, x in own]
            yield pa.record_batch({
                "doc_id": batch["doc_id"], "same": pa.array(np.array([h for h, _ in own], np.uint64).view(np.int64)), "n": pa.array([len(x) for x in sets], pa.int32()),
                "fp": pa.array(np.array([bit_majority(x) for _, x in own], np.uint64).view(np.int64)), "keys": pa.array([band_keys(x) for x in sets], pa.list_(pa.int64())),
            })

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [shingle_hashes(t.encode(), shingle) for t in batch["text"].to_pylist()]
            same = np.array([h for h, _ in own], np.uint64).view(np.int64)
            yield pa.record_batch({"same": pa.array(same), "marks": pa.array([np.sort(np.unique(x)).view(np.int64) for _, x in own], pa.list_(pa.int64()))})

    marks = cut(docs.mapInArrow(mark, "doc_id long, same long, n int, fp long, keys array<long>"))
    firsts = cut(marks.groupBy("same").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("keys").alias("keys")))
    stands = cut(firsts.groupBy("fp").agg(F.min_by(F.struct("same", "n"), "same").alias("lead"), F.count("*").alias("count")))
    keyed = firsts.select("same", "n", "copies", F.explode("keys").alias("key"))
    # a leader is the text of the most copies
    sizes = cut(keyed.groupBy("key").agg(F.count("*").alias("count"), F.max_by(F.struct("same", "n"), F.struct("copies", F.xxhash64("same", "key"))).alias("lead")).where("count > 1"))
    keyed = cut(keyed.join(sizes, "key").select("key", "same", "n", "count", "lead"))

    fits = f"least(n, m) >= {least} * greatest(n, m)"
    pair = lambda df: df.where(f"u <> v and {fits}").selectExpr("least(u, v) u", "greatest(u, v) v").distinct()

    few, many = keyed.where(f"count <= {SMALL}"), keyed.where(f"count > {SMALL}")
    met = few.selectExpr("key", "same u", "n").join(few.selectExpr("key", "same v", "n m"), "key").where("u < v").select("u", "v", "n", "m")
    led = many.selectExpr("same u", "lead.same v", "n", "lead.n m")
    alike = firsts.join(stands.where("count > 1"), "fp").selectExpr("same u", "lead.same v", "n", "lead.n m")
    bits = near_links(stands.select("fp"), radius).distinct()
    bits = bits.join(stands.selectExpr("fp u", "lead a"), "u").join(stands.selectExpr("fp v", "lead b"), "v").selectExpr("a.same u", "b.same v", "a.n n", "b.n m")
    tried = cut(pair(met.unionByName(led).unionByName(alike).unionByName(bits)))
    wanted = keyed.select("same").union(tried.select("u")).union(tried.select("v")).distinct()
    found = cut(docs.join(wanted.join(firsts, "same").select(F.col("first").alias("doc_id")), "doc_id", "left_semi").mapInArrow(sets, "same long, marks array<long>").dropDuplicates(["same"]))

    def verify(pairs: DataFrame) -> DataFrame:
        both = pairs.join(found.selectExpr("same u", "marks a"), "u").join(found.selectExpr("same v", "marks b"), "v").withColumn("shared", F.size(F.array_intersect("a", "b")))
        return both.where(f"shared >= {least} * (size(a) + size(b) - shared)").select("u", "v")

    links = cut(verify(tried))
    if not many.isEmpty():  # what leaders did not connect: tiles of each group meet in cells, rows of different components are compared
        own = cut(many.select("key", "same", "n", "count").join(components(links), F.col("same") == F.col("u"), "left").select("key", "same", "n", "count", F.coalesce("root", "same").alias("root")))
        open_keys = cut(own.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a < b").select("key"))
        sketch = found.selectExpr("same", f"slice(marks, 1, {SKETCH}) marks")  # marks are sorted as unsigned hashes
        tiles, tile = f"cast(ceil(count / {TILE}d) as int)", "cast(pmod(xxhash64(same, key), {0}) as int)"
        cells = f"transform(sequence(0, {tiles} - 1), t -> struct(least(t, {tile.format(tiles)}) i, greatest(t, {tile.format(tiles)}) j))"
        celled = own.join(open_keys, "key", "left_semi").join(sketch, "same").withColumn("cell", F.explode(F.expr(cells))).select("key", "cell.i", "cell.j", "same", "n", "root", "marks")

        def meet(group: pa.Table) -> pa.Table:
            column = lambda c: group[c].to_numpy()
            held = [np.array(x, np.int64).view(np.uint64) for x in group["marks"].to_pylist()]
            rows, _ = cell_links(column("same"), column("root"), column("n"), held, least)
            return pa.table({c: pa.array([x[k] for x in rows], kind) for k, (c, kind) in enumerate((("u", pa.int64()), ("v", pa.int64()), ("sure", pa.bool_())))})

        more = cut(celled.groupBy("key", "i", "j").applyInArrow(meet, "u long, v long, sure boolean"))
        unsure = more.where("not sure").selectExpr("least(u, v) u", "greatest(u, v) v").distinct().join(tried, ["u", "v"], "left_anti")
        links = links.unionByName(more.where("sure").select("u", "v")).unionByName(cut(verify(unsure)))

    roots = cut(components(links)).withColumnRenamed("u", "same")
    named = firsts.join(roots, "same", "left").select("same", "first", F.coalesce("root", "same").alias("root"))
    least_id = cut(named.groupBy("root").agg(F.min("first").alias("component_id")))
    return marks.select("doc_id", "same").join(named.join(least_id, "root").select("same", "component_id"), "same").select("doc_id", "component_id")
