"""MinHash near-dedup by an inverted join of signature coordinates; whole shingle sets confirm each link.

A signature has 64 coordinates, each the least of the shingles' hashes under a permutation of its own. Documents are posted under
each coordinate-value pair. Two texts of similarity 0.85 collide in fewer than 38 of them with probability 1.5e-7, so pairs with 38
collisions or more are kept and confirmed. Postings are merged by prefixes, the rarest first: a value that no other document
has cannot collide, so a document with fewer than 38 others is out, and of two documents that collide 38 times each has a
common value among its 38th-last and rarer ones. The 37 longest lists of a document are thereby skipped, and probed only for the
pairs that the short ones propose.

A long list is met through the document whose values collide most, the centre of a group of near copies; what that leaves in
different components meets in cells of tile pairs that tasks share, as in the pipeline's stage.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import cut, id_text
from .components import components
from .near_copies import CHUNK, SKETCH, SMALL, TILE, cell_links, shingle_hashes

COORDINATES, MATCH = 64, 38
_r = np.random.default_rng(13)
_FLIP = _r.integers(0, 2**63, COORDINATES, dtype=np.uint64)
_TIMES = _r.integers(0, 2**63, COORDINATES, dtype=np.uint64) | np.uint64(1)


def signature(hashes: np.ndarray) -> np.ndarray:
    """The least 32 bits of each coordinate's permuted hashes."""
    least = np.full(COORDINATES, 2**64 - 1, np.uint64)
    for i in range(0, len(hashes), CHUNK):
        np.minimum(least, ((hashes[i : i + CHUNK, None] ^ _FLIP) * _TIMES).min(0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _rows(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), COORDINATES)


def collisions(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many coordinates each row of a equals each row of b."""
    out = np.zeros((len(a), len(b)), np.uint8)
    for x, y in zip(a.T, b.T):
        out += x[:, None] == y[None, :]
    return out


def _words(text: str) -> tuple[bytes, bytes]:
    """A hash of the lower-cased words, and the text."""
    data = text.encode()
    return hashlib.blake2b(b" ".join(data.lower().split()), digest_size=16).digest(), data


def minhash_dedup(docs: DataFrame, shingle: int = 5, least: float = 0.85, match: int = MATCH) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id that links reach) and kept for each row with an id.

    Texts are linked when their sets of distinct word shingles have a Jaccard similarity of ``least`` or more; fewer words than a
    shingle are one shingle. Null and empty texts, and texts without words, have no shingles and are linked with nothing, not even
    with each other. A text of any length is one row of hashes. Rows that share an id have a component each; copies are one
    text until the end. Columns besides doc_id and text play no part; an empty table gives an empty table. match: collisions
    that a pair must have to be confirmed, for 64 coordinates.
    """
    docs = id_text(docs)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = []
            for text in batch["text"].to_pylist():
                same, data = _words(text)
                found = np.unique(shingle_hashes(data, shingle)[1]) if data.split(None, 1) else np.zeros(0, np.uint64)
                own.append((same, len(found), signature(found)))
            yield pa.record_batch({"doc_id": batch["doc_id"], "same": pa.array([x[0] for x in own], pa.binary()), "n": pa.array([x[1] for x in own], pa.int64()), "sig": pa.array([x[2] for x in own], pa.list_(pa.int32()))})

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [_words(t) for t in batch["text"].to_pylist()]
            yield pa.record_batch({"same": pa.array([x for x, _ in own], pa.binary()), "marks": pa.array([np.unique(shingle_hashes(d, shingle)[1]).view(np.int64) for _, d in own], pa.list_(pa.int64()))})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = (_rows(batch["a"]) == _rows(batch["b"])).sum(1) >= match
            yield pa.RecordBatch.from_arrays([batch[c].filter(pa.array(near)) for c in ("u", "v")], ["u", "v"])

    marks = cut(docs.mapInArrow(mark, "doc_id long, same binary, n long, sig array<int>"))
    # ids of texts are fixed by writing them: two texts may share a doc_id
    firsts = marks.where("n > 0").groupBy("same").agg(F.min("doc_id").alias("first"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    firsts = cut(firsts.withColumn("id", F.monotonically_increasing_id()))
    posts = firsts.select("id", "n", F.posexplode("sig")).selectExpr("id", "n", "shiftleft(cast(pos as long), 32) | (cast(col as long) & 4294967295L) key")
    often = cut(posts.groupBy("key").agg(F.count("*").alias("often")).where("often > 1"))
    held = posts.join(often, "key").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("often", "key"))).alias("posts")).where(f"size(posts) >= {match}")
    held = cut(held.selectExpr("id", "n", "aggregate(posts, 0L, (s, p) -> s + p.often) met", f"transform(slice(posts, 1, size(posts) - {match - 1}), p -> p.key) keys"))
    keyed = held.select("id", "n", "met", F.explode("keys").alias("key"))
    sizes = cut(keyed.groupBy("key").agg(F.count("*").alias("count"), F.max_by(F.struct("id", "n"), F.struct("met", -F.col("id"))).alias("lead")).where("count > 1"))
    keyed = cut(keyed.join(sizes, "key").select("key", "id", "n", "count", "lead"))

    fits = f"least(n, m) >= {least} * greatest(n, m)"
    few, many = keyed.where(f"count <= {SMALL}"), keyed.where(f"count > {SMALL}")
    met = few.selectExpr("key", "id u", "n").join(few.selectExpr("key", "id v", "n m"), "key").where("u < v").select("u", "v", "n", "m")
    led = many.selectExpr("id u", "lead.id v", "n", "lead.n m")
    pairs = met.unionByName(led).where(f"u <> v and {fits}").selectExpr("least(u, v) u", "greatest(u, v) v").distinct()
    sigs = firsts.join(held.select("id"), "id", "left_semi").select("id", "sig")
    tried = cut(pairs.join(sigs.selectExpr("id u", "sig a"), "u").join(sigs.selectExpr("id v", "sig b"), "v").mapInArrow(count, "u long, v long"))

    wanted = many.select("id").union(tried.select("u")).union(tried.select("v")).distinct()
    named = firsts.join(wanted, "id", "left_semi").select("id", "same", F.col("first").alias("doc_id"))
    found = docs.join(named.select("doc_id").distinct(), "doc_id", "left_semi").mapInArrow(sets, "same binary, marks array<long>").join(named.select("id", "same"), "same")
    found = cut(found.select("id", "marks").dropDuplicates(["id"]))

    def confirm(pairs: DataFrame) -> DataFrame:
        both = pairs.join(found.selectExpr("id u", "marks a"), "u").join(found.selectExpr("id v", "marks b"), "v").withColumn("shared", F.size(F.array_intersect("a", "b")))
        return both.where(f"100 * shared >= {round(100 * least)} * (size(a) + size(b) - shared)").select("u", "v")

    links = cut(confirm(tried))
    if not many.isEmpty():
        own = cut(many.select("key", "id", "n", "count").join(components(links), F.col("id") == F.col("u"), "left").select("key", "id", "n", "count", F.coalesce("root", "id").alias("root")))
        open_keys = cut(own.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a < b").select("key"))
        held_sets = found.join(sigs, "id").selectExpr("id", "sig", f"slice(marks, 1, {SKETCH}) marks")  # marks are sorted as unsigned hashes
        tiles, tile = f"cast(ceil(count / {TILE}d) as int)", "cast(pmod(xxhash64(id, key), {0}) as int)"
        cells = f"transform(sequence(0, {tiles} - 1), t -> struct(least(t, {tile.format(tiles)}) i, greatest(t, {tile.format(tiles)}) j))"
        celled = own.join(open_keys, "key", "left_semi").join(held_sets, "id").withColumn("cell", F.explode(F.expr(cells))).select("key", "cell.i", "cell.j", "id", "n", "root", "sig", "marks")

        def meet(group: pa.Table) -> pa.Table:
            column = lambda c: group[c].to_numpy()
            sig = _rows(group["sig"].combine_chunks())
            near = collisions(sig, sig) >= match
            root, rows = column("root"), []
            live = np.flatnonzero((near & (root[:, None] != root[None, :])).any(1))
            if len(live):
                marked = group["marks"].take(pa.array(live)).to_pylist()
                rows, _ = cell_links(column("id")[live], root[live], column("n")[live], [np.array(x, np.int64).view(np.uint64) for x in marked], least, near[np.ix_(live, live)])
            return pa.table({c: pa.array([x[k] for x in rows], kind) for k, (c, kind) in enumerate((("u", pa.int64()), ("v", pa.int64()), ("sure", pa.bool_())))})

        more = cut(celled.groupBy("key", "i", "j").applyInArrow(meet, "u long, v long, sure boolean"))
        unsure = more.where("not sure").selectExpr("least(u, v) u", "greatest(u, v) v").distinct().join(tried, ["u", "v"], "left_anti")
        links = links.unionByName(more.where("sure").select("u", "v")).unionByName(cut(confirm(unsure)))

    roots = cut(components(links))
    rooted = firsts.join(roots, F.col("id") == F.col("u"), "left").select("same", "first", F.coalesce("root", "id").alias("root"))
    smallest = cut(rooted.groupBy("root").agg(F.min("first").alias("component_id")))
    placed = cut(rooted.join(smallest, "root").select("same", "component_id"))
    return marks.join(placed, "same", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), (F.col("doc_id") == F.coalesce("component_id", "doc_id")).alias("kept"))
