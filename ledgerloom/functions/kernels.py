"""The few vectorised helpers: text that must be read in order, packing, and cosine top-k."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

MAX_CHUNK = 600
_HEADING = re.compile(r"^(#{2,3})[ \t]+(\S.*)(?:\n|\Z)", re.M)
_CLAUSE_NO = re.compile(r"第[一二三四五六七八九十百千\d]+条")
_SENTENCE = re.compile(r"[^。！？；!?;]*[。！？；!?;]|[^。！？；!?;]+$")


#: Characters of text whose results a task holds at once.
PIECE = 1 << 20


def pieces(batches: Iterator[pd.Series], most: int = PIECE) -> Iterator[pd.Series]:
    """Texts in their order, about ``most`` characters at a time, so what is made of them is not held for a whole batch; a longer text is alone.

    Neither a batch nor a piece is held while the next is read.
    """
    for texts in batches:
        held = texts.to_list()[::-1]
        del texts
        while held:
            piece = [held.pop()]
            size = len(piece[0] or "")
            while held and size + len(held[-1] or "") <= most:
                size += len(held[-1] or "")
                piece.append(held.pop())
            piece = pd.Series(piece, dtype=object)
            yield piece
            del piece


def front_matter(text: str) -> tuple[dict[str, str], str]:
    """Pairs of the 属性 / 内容 table at the top, and the text after it; without such a table the whole text is body."""
    lines = text.strip().split("\n")
    head = next((i for i, s in enumerate(lines) if s.strip().startswith("|") and "属性" in s and "内容" in s), None)
    if head is None:
        return {}, text.strip()
    end = head
    meta = {}
    while end < len(lines) and lines[end].strip().startswith("|"):
        cells = [c.strip() for c in lines[end].strip().split("|")[1:-1]]
        if end > head and len(cells) > 1 and all(cells[:2]) and not cells[0].startswith("---"):
            meta[cells[0]] = cells[1]
        end += 1
    return meta, "\n".join(lines[end:]).strip()


def clean_body(text: str) -> str:
    """Right-trimmed lines, no blank or rule lines at the ends, at most one blank line between others. Blank is what Unicode calls so."""
    lines = [line.rstrip() for line in text.split("\n")]
    kept = [i for i, line in enumerate(lines) if line.lstrip() not in ("", "---")]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines[kept[0] : kept[-1] + 1])).strip() if kept else ""


def sentences(text: str) -> list[str]:
    """Sentences with their end marks, line ends kept; neighbouring table rows are one unit."""
    units: list[str] = []
    for block in re.findall(r"(?:^[ \t]*\|.*(?:\n|\Z))+|^.*(?:\n|\Z)", text, re.M):
        if block.lstrip(" \t").startswith("|"):
            units.append(block.rstrip("\n"))
            continue
        line, tail = block.rstrip("\n"), block[len(block.rstrip("\n")) :]
        parts = [s for s in _SENTENCE.findall(line) if s.strip()]
        if parts:
            parts[-1] += tail[:1]
            units += parts
    return units


def pack(units: list[str], limit: int, glue: str) -> list[str]:
    """Greedy runs of units joined by ``glue`` up to ``limit`` characters; a longer unit stays whole."""
    out: list[str] = []
    for u in units:
        if out and len(out[-1]) + len(glue) + len(u) <= limit:
            out[-1] += glue + u
        else:
            out.append(u)
    return out


def pack_paragraphs(text: str, limit: int) -> list[str]:
    """Paragraphs packed up to the limit; one beyond it is packed by sentences on its own."""
    out: list[str] = []
    run: list[str] = []
    for p in (p for p in re.split(r"\n\s*\n", text) if p.strip()):
        if len(p) > limit:
            out += pack(run, limit, "\n\n") + pack(sentences(p), limit, "")
            run = []
        else:
            run.append(p)
    return out + pack(run, limit, "\n\n")


def headings(text: str) -> list[dict]:
    """Chapters with their preamble and clauses. Text before the first heading belongs to the first chapter; without headings there are none."""
    parts = _HEADING.split(text)
    chapters: list[dict] = []
    lead = parts[0]
    for mark, title, body in zip(parts[1::3], parts[2::3], parts[3::3]):
        if mark == "##":
            chapters.append({"title": title.strip(), "preamble": lead + body, "clauses": []})
            lead = ""
        else:
            if not chapters:
                chapters.append({"title": "", "preamble": lead, "clauses": []})
                lead = ""
            chapters[-1]["clauses"].append((title.strip(), clean_body(body)))
    for c in chapters:
        c["preamble"] = clean_body(c["preamble"])
    return [c for c in chapters if c["title"] or c["preamble"] or c["clauses"]]


def chunks(text: str, limit: int = MAX_CHUNK) -> list[dict]:
    out: list[dict] = []
    used: set[str] = set()

    def add(body: str, chapter: str, section: str, key: str) -> None:
        unique, n = key, 2
        while unique in used:
            unique, n = f"{key}#{n}", n + 1
        used.add(unique)
        no = _CLAUSE_NO.match(section)
        out.append({"chunk_index": len(out), "chunk_key": unique, "chapter": chapter, "section": section, "clause_no": no[0] if no else "", "parent_key": f"chapter:{chapter or 'root'}", "content": body})

    for c in headings(text):
        title = c["title"]
        prefix = f"## {title}\n\n" if title else ""
        if c["preamble"] and c["clauses"]:
            add(prefix + c["preamble"], title, "", f"preamble:{title or 'root'}")
        elif c["preamble"]:
            parts = pack_paragraphs(c["preamble"], limit - len(prefix))
            for i, p in enumerate(parts):
                add(prefix + p, title, "", f"chapter:{title or 'root'}" + (f"#p{i}" if len(parts) > 1 else ""))
        for section, body in c["clauses"]:
            add(f"{prefix}### {section}\n\n{body}".rstrip(), title, section, f"clause:{section}")
    return out


#: Scores held at once in a task, scores that a task makes in all, about, and bytes of query vectors sent to it at once.
CELLS, TASK_SCORES, QUERY_BYTES = 1 << 20, 1 << 27, 64 << 20


def unit_rows(column: pd.Series) -> np.ndarray:
    m = np.array(column.tolist(), float)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-30)


def has_vector(column: str = "embedding") -> Column:
    """Rows without a vector, or with an empty one or nulls in it, take no part in a search."""
    return F.col(column).isNotNull() & (F.size(column) > 0) & ~F.exists(column, lambda x: x.isNull())


def first_k(line: np.ndarray, key: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k entries of largest key for each line, ties by id, in that order."""
    order = np.lexsort((ids, -key, line))
    own = line[order]
    return order[np.arange(len(own)) - np.searchsorted(own, own) < k]


def nine_places(score: np.ndarray) -> np.ndarray:
    return np.round(score, 9)


def best_of(score: np.ndarray, ids: np.ndarray, k: int, rounded: Callable[[np.ndarray], np.ndarray] = nine_places) -> tuple[np.ndarray, np.ndarray]:
    """(line, place) of the k best finite scores of each line, by what ``rounded`` makes of them, ties by id."""
    key = rounded(score)
    if k < len(ids):  # all that are as good as the k-th, then the first k of them by id
        least = np.partition(key, len(ids) - k, axis=1)[:, len(ids) - k, None]
        line, place = np.nonzero((key >= least) & np.isfinite(score))
    else:
        line, place = np.nonzero(np.isfinite(score))
    chosen = first_k(line, key[line, place], ids[place], k)
    return line[chosen], place[chosen]


class RunningBest:
    """The k best hits of each query among all rows met so far."""

    def __init__(self, k: int, queries: int, rounded: Callable[[np.ndarray], np.ndarray] = nine_places):
        self.k, self.most, self.rounded = k, max(1 << 16, 4 * k * queries), rounded
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        self.held.append((query, ids, score))
        self.size += len(query)
        if self.size > self.most:
            self.held = [self.all()]
            self.size = len(self.held[0][0])

    def all(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        query, ids, score = (np.concatenate(x) for x in zip(*self.held)) if self.held else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        chosen = first_k(query, self.rounded(score), ids, self.k)
        return query[chosen], ids[chosen], score[chosen]


def ranked_hits(hits: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("similarity", 9)), "id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k)


def cosine_hits(rows: DataFrame, queries: DataFrame, k: int, block: int = 20_000, rounded: Callable[[np.ndarray], np.ndarray] = nine_places) -> DataFrame:
    """(query_id, id, similarity): of each task's rows the k of largest cosine for each query, by ``rounded`` and then by id; not yet ranked.

    rows (id, embedding), queries (query_id, embedding), and both may carry a ``pool``, which must then be equal; a query may
    stand in several pools. Queries are sent to the tasks in blocks of at most ``block`` rows and 64 MB, and rows are dealt over
    as many tasks as their pairs deserve. A task meets a pool's rows and queries only, and keeps the best k of all its rows, so
    what is shuffled grows with the tasks, not with the rows. Rows and queries without a vector take no part.
    """
    pooled = "pool" in rows.columns
    extra = ["pool"] if pooled else []
    rows, queries = rows.where(has_vector()).select("id", "embedding", *extra), queries.where(has_vector()).select("query_id", "embedding", *extra)
    n, size = queries.agg(F.count("*"), F.coalesce(F.max(F.size("embedding")), F.lit(1))).first()
    blocks = max(1, -(-n // min(block, max(1, QUERY_BYTES // (8 * size)))))
    tasks = -(-rows.count() * -(-n // blocks) // TASK_SCORES)
    rows = rows.repartition(tasks) if tasks > 1 else rows
    out = None
    for b in range(blocks):
        asked = (queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b) if blocks > 1 else queries).collect()
        ids = np.array([r.query_id for r in asked], np.int64)
        q = unit_rows(pd.Series([r.embedding for r in asked])) if asked else np.zeros((0, 1))
        places: dict[str | None, list[int]] = {}
        for i, r in enumerate(asked):
            places.setdefault(r.pool if pooled else None, []).append(i)
        shared = rows.sparkSession.sparkContext.broadcast((ids, q, {p: np.array(x) for p, x in places.items()}))

        def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, q, places = shared.value
            kept = RunningBest(k, len(ids), rounded)
            for rows in batches:
                for pool, at in rows.groupby("pool").indices.items() if pooled else [(None, np.arange(len(rows)))]:
                    asking = places.get(pool, ())
                    if not len(at) or not len(asking):
                        continue
                    m, own = unit_rows(rows["embedding"].iloc[at]).T, rows["id"].to_numpy()[at]
                    each = max(1, CELLS // len(at))
                    for i in range(0, len(asking), each):
                        score = q[asking[i : i + each]] @ m
                        line, place = best_of(score, own, k, rounded)
                        kept.add(asking[i + line], own[place], score[line, place])
            line, found, score = kept.all()
            yield pd.DataFrame({"query_id": ids[line], "id": found, "similarity": score})

        part = rows.mapInPandas(best, "query_id long, id long, similarity double")
        out = part if out is None else out.unionByName(part)
    return out


def cosine_top_k(rows: DataFrame, queries: DataFrame, k: int, block: int = 20_000) -> DataFrame:
    """(query_id, id, similarity, rank): the k rows of largest cosine for each query, ties by id; every row is met (see ``cosine_hits``)."""
    return ranked_hits(cosine_hits(rows, queries, k, block), k)
