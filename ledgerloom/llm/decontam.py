"""Benchmark decontamination by the q-gram lemma.

A passage of m characters that a document holds with at most k edits loses at most k q of its q-grams, so of R q-grams that are
looked for R - k q are left, all on diagonals within k of one another. Shared q-grams are counted in bands of diagonals that
overlap by half, so one band holds them all; bands below the bound are dropped, the rest are verified by a banded alignment of
the whole passage. The order of the filter follows how many passages share a q-gram: a passage is looked for by q-grams that
few others have, of the largest q for which the bound holds with those alone, so passages with a common opening do not meet
wherever it stands. A passage for which no q gives a bound has all its q-grams looked for. Documents and passages are
compared in lower case with runs of white space as one space; sizes and places are in characters of that.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import id_text, mix, runs
from .repeats import levels, span_hash

SCHEMA = "doc_id long, hits array<struct<item_id:long,edits:int,start:int,end:int>>"
_HITS = pa.list_(pa.struct([("item_id", pa.int64()), ("edits", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
CHUNK = 1 << 20
BITS = 20
#: A q-gram of more passages than this is common; passages with common q-grams only are searched in groups of GROUP.
COMMON, GROUP = 64, 256
#: Places of q-grams that are expanded at once.
EXPAND = 1 << 22
#: Candidates aligned at once.
BATCH = 512
_KEYS = mix(np.arange(1, 0x110001, dtype=np.uint64))


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


@dataclass
class Grams:
    """The sorted hashes of q-grams, with the passage and the place of each, and how many of a passage's must be met."""

    q: int
    key: np.ndarray
    item: np.ndarray
    place: np.ndarray
    bound: np.ndarray
    some: np.ndarray
    reach: int

    @staticmethod
    def of(q: int, key: np.ndarray, item: np.ndarray, place: np.ndarray, bound: np.ndarray, reach: int) -> Grams:
        """reach: the longest place that one of the passages can take."""
        order = np.argsort(key, kind="stable")
        some = np.zeros(1 << BITS, bool)
        some[(key & np.uint64((1 << BITS) - 1)).astype(np.int64)] = True
        return Grams(q, key[order], item[order], place[order], bound, some, reach)


def _common(key: np.ndarray, item: np.ndarray, most: int) -> np.ndarray:
    """Whether more than ``most`` items have the key."""
    order = np.lexsort((item, key))
    k, i = key[order], item[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    group = np.cumsum(new) - 1
    fresh = new.copy()
    fresh[1:] |= i[1:] != i[:-1]
    out = np.empty(len(k), bool)
    out[order] = np.bincount(group, fresh)[group] > most if len(k) else False
    return out


@dataclass
class Passages:
    """A block of different passages with the ids of each, and the q-grams by which they are looked for."""

    ids: list[list[int | None]]
    texts: list[str]
    codes: np.ndarray
    at: np.ndarray
    budget: np.ndarray
    grams: list[Grams]

    @staticmethod
    def of(ids: list[int | None], texts: list[str], q: int, rate: float) -> Passages:
        ids_of: dict[str, set[int | None]] = {}
        for i, x in zip(ids, texts):
            if t := normal(x):
                ids_of.setdefault(t, set()).add(i)
        kept = sorted(ids_of)
        codes = codes_of("".join(kept))
        size = np.array([len(t) for t in kept], np.int64)
        at = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        budget = np.minimum((size * rate + 1e-9).astype(np.int64), np.maximum(size - 1, 0))
        hashes = levels(_KEYS[codes], q)

        def places(width: int, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            each = np.maximum(size[chosen] + 1 - width, 0)
            item = np.repeat(chosen, each)
            place = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
            return span_hash(hashes, at[item] + place, width), item, place

        # passages are looked for with others of about their length, as the longest decides how much text is met at once
        reach = size + 2 * budget
        long = np.maximum(0, (np.ceil(np.log2(size + 1)).astype(np.int64) - 7) // 4)
        left, grams = np.arange(len(kept)), []
        for width in range(q, 0, -1):
            if not len(left):
                break
            key, item, place = places(width, left)
            rare = ~_common(key, item, COMMON)
            bound = np.bincount(item[rare], minlength=len(kept)) - budget * width
            own = bound[left] > 0
            for c in np.unique(long[left[own]]).tolist():
                use = rare & (bound[item] > 0) & (long[item] == c)
                grams.append(Grams.of(width, key[use], item[use], place[use], bound, int(reach[left[own & (long[left] == c)]].max())))
            left = left[~own]
        width_of = np.minimum(q, size // (budget + 1))  # the longest q-grams of which one is left after as many edits
        for width, c in sorted(set(zip(width_of[left].tolist(), long[left].tolist()))):
            same = left[(width_of[left] == width) & (long[left] == c)]
            for i in range(0, len(same), GROUP):
                grams.append(Grams.of(width, *places(width, same[i : i + GROUP]), size + 1 - width - budget * width, int(reach[same[i : i + GROUP]].max())))
        return Passages([sorted(ids_of[t], key=lambda i: (i is not None, i or 0)) for t in kept], kept, codes, at, budget, grams)


def bands(near: np.ndarray, lo: np.ndarray, n: np.ndarray, row: np.ndarray, at: np.ndarray, p: Passages, g: Grams) -> np.ndarray:
    """Rows (text, passage, first diagonal, last diagonal, least edits) of the bands that meet the bound.

    Least edits: each edit loses at most q of the q-grams that a band lacks.
    """
    entry = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
    place, row = np.repeat(near - at[row], n), np.repeat(row, n)
    item, own = g.item[entry], g.place[entry]
    diagonal = place - own
    width = 2 * (2 * p.budget[item] + 1)
    base = diagonal + (1 << 30)
    band = np.concatenate([2 * (base // width), 2 * ((base + width // 2) // width) + 1])
    row, item, diagonal, own = (np.tile(x, 2) for x in (row, item, diagonal, own))
    order = np.lexsort((own, band, item, row))
    row, item, band, diagonal, own = (x[order] for x in (row, item, band, diagonal, own))
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (band[1:] != band[:-1])
    first = np.flatnonzero(new)
    fresh = new.copy()  # a q-gram of the passage counts once in a band
    fresh[1:] |= own[1:] != own[:-1]
    count, bound = np.add.reduceat(fresh.astype(np.int64), first), g.bound[item[first]]
    met, fewest = count >= bound, np.maximum(0, -((count - bound - p.budget[item[first]] * g.q) // g.q))
    least, most = np.minimum.reduceat(diagonal, first), np.maximum.reduceat(diagonal, first)
    return np.stack([row[first], item[first], least, most, fewest])[:, met]


def candidates(key: np.ndarray, at: np.ndarray, p: Passages, g: Grams) -> Iterator[np.ndarray]:
    """``bands`` of a piece of text, a part at a time; key: hashes of all places, at: text offsets.

    Parts overlap by the longest place that a passage can take, so each such place lies within one part.
    """
    near = np.flatnonzero(g.some[(key & np.uint64((1 << BITS) - 1)).astype(np.int64)])
    lo, hi = np.searchsorted(g.key, key[near], "left"), np.searchsorted(g.key, key[near], "right")
    row = np.searchsorted(at, near, "right") - 1
    keep = (hi > lo) & (near + g.q <= at[row + 1])
    near, lo, n, row = near[keep], lo[keep], (hi - lo)[keep], row[keep]
    if not len(near):
        return
    reach = g.reach
    total = np.concatenate([[0], np.cumsum(n)])
    i = 0
    while i < len(near):
        j = max(i + 1, int(np.searchsorted(total, total[i] + EXPAND, "right")) - 1)
        j = max(j, int(np.searchsorted(near, near[i] + 2 * reach, "left")))
        yield bands(near[i:j], lo[i:j], n[i:j], row[i:j], at, p, g)
        if j >= len(near):
            return
        i = max(i + 1, int(np.searchsorted(near, near[j - 1] - reach, "left")))


def align(text: np.ndarray, begin: np.ndarray, end: np.ndarray, item: np.ndarray, least: np.ndarray, most: np.ndarray, p: Passages) -> np.ndarray:
    """Rows (edits, start, end) of the best place of each passage between its diagonals; edits above the budget are -1.

    begin, end: where each candidate's text lies in ``text``; starts and ends count from its beginning.
    """
    out = np.full((3, len(item)), -1, np.int64)
    many = 1 << 20
    left = np.arange(len(item))
    size, budget = np.diff(p.at)[item], p.budget[item]
    low = least - budget
    width = int((most + budget - low).max()) + 1
    across = np.arange(width)
    length = end - begin
    at = low[:, None] + across  # place in the text
    beyond = (at < 0) | (at > length[:, None]) | (across > (most + budget - low)[:, None])
    cost, start = np.where(beyond, many, 0), at.copy()
    for i in range(int(size.max())):
        at = low[left, None] + i + across
        held = (at >= 0) & (at < length[left, None]) & (across <= (most + budget - low)[left, None])
        letter = text[np.clip(begin[left, None] + at, 0, max(0, len(text) - 1))] if len(text) else np.zeros(at.shape, np.uint32)
        new = np.where(held, cost + (letter != p.codes[p.at[item[left]] + i][:, None]), many)
        begun = start
        drop = np.full_like(cost, many)
        drop[:, :-1] = cost[:, 1:] + 1  # a character of the passage that the text lacks
        better = drop < new
        new, begun = np.where(better, drop, new), np.where(better, np.pad(start[:, 1:], ((0, 0), (0, 1))), begun)
        # characters of the text between two of the passage: running least of cost - column
        slope = new - across
        running = np.minimum.accumulate(slope, axis=1)
        from_ = np.maximum.accumulate(np.where(slope == running, across, 0), axis=1)
        cost = np.where((at + 1 >= 0) & (at + 1 <= length[left, None]), running + across, many)
        start = np.take_along_axis(begun, from_, 1)
        best = cost.min(1)
        done = size[left] == i + 1
        for k in np.flatnonzero(done & (best <= budget[left])).tolist():
            w = int(cost[k].argmin())
            out[:, left[k]] = cost[k, w], start[k, w], low[left[k]] + i + 1 + w
        stay = ~done & (best <= budget[left])
        if not stay.all():
            left, cost, start = left[stay], cost[stay], start[stay]
            if not len(left):
                break
    return out


def settle(found: np.ndarray, texts: list[str], piece: np.ndarray, at: np.ndarray, p: Passages, best: dict[tuple[int, int], tuple[int, int, int]], tried: dict[int, tuple[int, int, int]]) -> None:
    """Enters the best place of each (text, passage) of the candidates into ``best``.

    A pair's candidates are aligned one after another, those of the fewest possible edits first, until the rest can be no
    better; a passage is aligned once with equal stretches of text, whichever text they stand in. tried: edits, start and end
    of such alignments, from the beginning of the stretch.
    """
    waiting: dict[tuple[int, int], list[tuple[int, int, int, int]]] = {}
    for row, item, least, most, fewest in zip(*found.tolist()):
        waiting.setdefault((row, item), []).append((fewest, least - int(p.budget[item]), most, least))
    for own in waiting.values():
        own.sort(reverse=True)

    def enter(pair: tuple[int, int], edits: int, start: int, end: int) -> None:
        if edits >= 0:
            best[pair] = min((edits, start, end), best.get(pair, (edits, start, end)))

    while waiting:
        batch: dict[int, tuple[tuple[int, int], int, int]] = {}
        for pair in list(waiting):
            (row, item), own = pair, waiting[pair]
            text, passage, edits = texts[row], p.texts[item], int(p.budget[item])
            while own:
                fewest, low, most, least = own[-1]
                known = best.get(pair)
                if known is not None and (fewest, max(0, low)) >= known[:2]:
                    own.pop()
                    continue
                if fewest == 0 and (exact := text.find(passage, max(0, low), most + len(passage) + edits)) >= 0:
                    enter(pair, 0, exact, exact + len(passage))
                    own.pop()
                    continue
                if not edits:
                    own.pop()
                    continue
                key = hash((item, most - low, min(low, 0), text[max(0, low) : most + edits + len(passage)]))
                if key in tried:
                    e, start, end = tried[key]
                    enter(pair, e, low + start, low + end)
                    own.pop()
                elif key in batch:
                    break
                else:
                    batch[key] = (pair, least, most)
                    break
            if not own:
                del waiting[pair]
        order = sorted(batch.items(), key=lambda x: len(p.texts[x[1][0][1]]))
        for b in range(0, len(order), BATCH):
            part = order[b : b + BATCH]
            row, item = np.array([pair for _, (pair, _, _) in part]).T
            least, most = np.array([x[1:] for _, x in part]).T
            for (key, _), n, low, e, start, end in zip(part, item.tolist(), (least - p.budget[item]).tolist(), *align(piece, at[row], at[row + 1], item, least, most, p).tolist()):
                tried[key] = (e, start - low, end - low)


def find_hits(texts: pa.Array, p: Passages) -> list[list[dict]]:
    """For each text the best place of each item's passages that it holds."""
    whole = [normal(t or "") for t in texts.to_pylist()]
    out: list[list[dict]] = [[] for _ in whole]
    if not p.ids:
        return out
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in whole])]).astype(np.int64)
    for i, j in runs(offsets, CHUNK):
        piece, at = codes_of("".join(whole[i:j])), offsets[i : j + 1] - offsets[i]
        hashes = levels(_KEYS[piece], max(g.q for g in p.grams))
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        tried: dict[int, tuple[int, int, int]] = {}
        for g in p.grams:
            if len(piece) < g.q:
                continue
            key = span_hash(hashes, np.arange(len(piece) - g.q + 1), g.q)
            for found in candidates(key, at, p, g):
                settle(found, whole[i:j], piece, at, p, best, tried)
        of_id: dict[tuple[int, int | None], tuple[int, int, int]] = {}
        for (row, item), found in best.items():
            for item_id in p.ids[item]:
                of_id[row, item_id] = min(found, of_id.get((row, item_id), found))
        for (row, item_id), (edits, start, end) in sorted(of_id.items(), key=lambda x: (x[0][0], x[0][1] is not None, x[0][1] or 0)):
            out[i + row].append({"item_id": item_id, "edits": edits, "start": start, "end": end})
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, q: int = 10, rate: float = 0.08, block: int = 20_000, block_bytes: int = 16 << 20) -> DataFrame:
    """doc_id and hits (item_id, edits, and start and end in characters of the normal text) for each row with an id.

    A passage is held if some place of the document equals it up to ``rate`` edits a character, rounded down; one too short for
    an edit must be there as it is. Null and empty passages are not looked for, null and empty texts hold none, rows that
    share an id are reported each, a text of any length is searched whole. Of rows of the benchmark that share an item_id,
    or have none, each text is looked for and the best hit is given; repeated rows are merged before they are sent. The benchmark is sent to the tasks in blocks of about
    ``block`` rows and ``block_bytes``, each block meeting all documents.
    """
    spark = docs.sparkSession
    docs = id_text(docs)
    items = benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    rows, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-rows // block), -(-size // block_bytes))

    def search(p: Passages) -> DataFrame:
        shared = spark.sparkContext.broadcast(p)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.record_batch({"doc_id": batch["doc_id"], "hits": pa.array(find_hits(batch["text"], shared.value), _HITS)})

        return docs.mapInArrow(run, SCHEMA)

    found = None
    for k in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k) if blocks > 1 else items
        rows = own.collect()  # about ``block`` rows, about ``block_bytes``
        part = search(Passages.of([r.item_id for r in rows], [r.text for r in rows], q, rate))
        found = part if found is None else found.unionByName(part)
    if blocks == 1:
        return found
    merged = found.groupBy("doc_id").agg(F.array_sort(F.flatten(F.collect_list("hits"))).alias("hits"))
    return merged.withColumn("hits", F.expr("filter(hits, (h, i) -> i = 0 or not h.item_id <=> hits[i - 1].item_id)"))


def digests(found: DataFrame) -> DataFrame:
    return found.selectExpr(
        "doc_id", "size(hits) > 0 contaminated", "cast(size(hits) as long) n_items",
        "array_join(transform(hits, h -> concat_ws(':', h.item_id, h.edits, h.start, h.end)), ',') items",
    )
