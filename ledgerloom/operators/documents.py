"""Policy documents: front matter, chunks, audits, and the incrementally kept index."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import kernels, scratch

UNTITLED = "未知文档"
CHUNKER_VERSION = "clause-1"
CHUNK_SCHEMA = "chunk_index int, chunk_key string, chapter string, section string, clause_no string, parent_key string, content string"


def parse_front_matter(text: Column) -> Column:
    """struct(meta, body) of a document's text."""

    @F.pandas_udf("meta map<string,string>, body string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in kernels.pieces(batches):
            yield pd.DataFrame([kernels.front_matter(t or "") for t in texts], columns=["meta", "body"])

    return run(text)


def extract_title(text: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(F.regexp_extract(F.trim(text), r"\A#\s+(.+)", 1)), F.lit("")), F.lit(UNTITLED))


def parse_effective_date(c: Column) -> Column:
    """A date of either form; an invalid or missing one is null, which means always in force."""
    cn, iso = r"(\d{4})\s*年\s*(\d{1,2})\s*月\s*(\d{1,2})\s*日", r"(\d{4})-(\d{1,2})-(\d{1,2})"
    day = lambda p: F.try_to_date(F.concat_ws("-", *(F.lpad(F.regexp_extract(c, p, i), 4 if i == 1 else 2, "0") for i in (1, 2, 3))), "yyyy-MM-dd")
    return F.when(c.rlike(cn), day(cn)).when(c.rlike(iso), day(iso))


def load_documents(files: DataFrame) -> DataFrame:
    """(file_name, text) to title, body, metadata with file name and data type, and effective date."""
    parsed = files.select("file_name", extract_title(F.col("text")).alias("title"), parse_front_matter("text").alias("p"))
    kind = F.coalesce(F.col("p.meta")["关联数据"], F.col("p.meta")["数据关联"], F.lit(""))
    meta = F.map_concat(F.map_filter("p.meta", lambda k, v: ~k.isin("file_name", "data_type")), F.create_map(F.lit("file_name"), F.col("file_name"), F.lit("data_type"), kind))
    return parsed.select("file_name", "title", F.col("p.body").alias("body"), meta.alias("metadata"), parse_effective_date(F.col("p.meta")["生效日期"]).alias("effective_date"))


def split_headings(text: Column) -> Column:
    """Chapters (title, preamble, clauses) of a body."""

    @F.pandas_udf("array<struct<title:string,preamble:string,clauses:array<struct<heading:string,body:string>>>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in kernels.pieces(batches):
            yield texts.map(lambda t: [{**c, "clauses": [{"heading": h, "body": b} for h, b in c["clauses"]]} for c in kernels.headings(t or "")])

    return run(text)


def clean_body(text: Column) -> Column:
    """Right-trimmed lines, no blank or rule lines at the ends, at most one blank line between others; null stays null."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else kernels.clean_body(t))

    return run(text)


def clause_no(heading: Column) -> Column:
    return F.regexp_extract(heading, r"^(第[一二三四五六七八九十百千\d]+条)", 1)


def split_sentences(text: Column) -> Column:
    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: kernels.sentences(t or ""))

    return run(text)


def pack_paragraphs(limit: int) -> Callable[[Column], Column]:
    @F.pandas_udf("array<string>")
    def run(text: pd.Series) -> pd.Series:
        return text.map(lambda t: kernels.pack_paragraphs(t or "", limit))

    return run


def chunk_documents(docs: DataFrame, limit: int = kernels.MAX_CHUNK, whole_doc_fallback: bool = False) -> DataFrame:
    """Clause-level chunks with keys that are unique in their document; a document is one row, so nothing is shuffled.

    A document without headings has no chunks, or one with ``whole_doc_fallback``.
    """

    @F.pandas_udf(f"array<struct<{', '.join(':'.join(c.split()) for c in CHUNK_SCHEMA.split(', '))}>>")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for text in kernels.pieces(batches):
            yield text.map(lambda t: kernels.chunks(t or "", limit) or (kernels.chunks(f"## ​\n{t}", limit) if whole_doc_fallback and t else []))

    return docs.select("file_name", F.col("title").alias("doc_title"), "effective_date", F.explode(cut("body")).alias("c")).select("file_name", "doc_title", "effective_date", "c.*")


def unique_keys(chunks: DataFrame, key_base: str = "key_base", order: str = "chunk_index") -> DataFrame:
    """Repeats of a key in a file get #2, #3 ...; a numbered key that was there by itself moves on to the next number."""
    nth = F.row_number().over(Window.partitionBy("file_name", key_base).orderBy(order))
    numbered = chunks.withColumn("chunk_key", F.when(nth == 1, F.col(key_base)).otherwise(F.concat(F.col(key_base), F.lit("#"), nth)))
    again = F.row_number().over(Window.partitionBy("file_name", "chunk_key").orderBy(F.col("chunk_key") != F.col(key_base), order))
    return numbered.withColumn("chunk_key", F.when(again > 1, F.concat("chunk_key", F.lit("#"), again)).otherwise(F.col("chunk_key")))


def chunk_length_report(chunks: DataFrame, limit: int = kernels.MAX_CHUNK) -> DataFrame:
    n = F.length("content")
    return chunks.groupBy("file_name").agg(F.count("*").alias("chunks"), F.min(n).alias("shortest"), F.max(n).alias("longest"), F.count_if(n > limit).alias("over"))


def audit_chunks(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """(check, violations) of the invariants that chunking promises."""
    chunks = scratch.cut(chunks.select("file_name", "chunk_key", "section", "clause_no", "content"))  # six checks read them
    clauses = scratch.cut(docs.select("file_name", F.explode(split_headings("body")).alias("c")).select("file_name", F.explode("c.clauses").alias("k")).select("file_name", "k.*"))
    own = chunks.where("section <> ''")
    checks = {
        "key_missing": chunks.where("chunk_key is null or chunk_key = ''"),
        "key_repeated": chunks.groupBy("file_name", "chunk_key").count().where("count > 1"),
        "two_chapters": chunks.where(F.size(F.regexp_extract_all("content", F.lit(r"(?m)^(## )"))) > 1),
        "clause_number_lost": own.where(F.col("section").rlike(r"^第[一二三四五六七八九十百千\d]+条") & (F.col("clause_no") == "")),
        "clause_without_chunk": clauses.join(own.select("file_name", F.col("section").alias("heading")), ["file_name", "heading"], "left_anti"),
        "clause_count_differs": clauses.groupBy("file_name").agg(F.count("*").alias("a")).join(own.groupBy("file_name").agg(F.count("*").alias("b")), "file_name", "full").where("not a <=> b"),
        "body_lost": clauses.where("body <> ''").join(own.select("file_name", F.col("section").alias("heading"), "content"), ["file_name", "heading"]).groupBy("file_name", "heading", "body").agg(F.bool_or(F.contains("content", "body")).alias("kept")).where("not kept"),
    }
    out = None
    for name, bad in checks.items():
        row = bad.agg(F.lit(name).alias("check"), F.count("*").alias("violations"))
        out = row if out is None else out.unionByName(row)
    return out


def doc_checksum(version: str = CHUNKER_VERSION) -> Column:
    """md5 of body, metadata in key order, and the chunker's version."""
    return F.md5(F.concat_ws("\u0001", "body", F.to_json(F.map_from_entries(F.array_sort(F.map_entries("metadata")))), F.lit(version)))


def chunk_checksum() -> Column:
    return F.md5("content")


def index_diff(current: DataFrame, state: DataFrame, force: bool = False) -> DataFrame:
    """(file_name, content_hash, change): added, updated, removed or unchanged; ``force`` updates all that stay."""
    both = current.select("file_name", "content_hash").join(state.select("file_name", F.col("content_hash").alias("old")), "file_name", "full")
    change = F.when(F.col("old").isNull(), "added").when(F.col("content_hash").isNull(), "removed").when((F.col("old") != F.col("content_hash")) | F.lit(force), "updated").otherwise("unchanged")
    return both.select("file_name", "content_hash", change.alias("change"))


def needs_reindex(diff: DataFrame) -> bool:
    return not diff.where("change <> 'unchanged'").isEmpty()


def plan_reuse(new: DataFrame, old: DataFrame, now: Column) -> DataFrame:
    """Chunks whose text is as before keep vector and times; others have no vector yet and a new updated_at."""
    was = old.select("file_name", "chunk_key", F.col("content_hash").alias("_h"), F.col("embedding").alias("_e"), F.col("created_at").alias("_c"), F.col("updated_at").alias("_u"))
    same = F.col("_h") == F.col("content_hash")
    return new.join(was, ["file_name", "chunk_key"], "left").withColumns({
        "embedding": F.when(same, F.col("_e")), "created_at": F.coalesce("_c", now), "updated_at": F.when(same, F.col("_u")).otherwise(now), "reused": F.coalesce(same, F.lit(False)),
    }).drop("_h", "_e", "_c", "_u")


def embed(df: DataFrame, fn: Callable[[list[str]], list[list[float]]], text_col: str = "content", prefix: str = "", batch: int = 256) -> DataFrame:
    """Unit vectors of ``fn``, called on up to ``batch`` texts at a time; a query prefix is for queries only."""
    import numpy as np

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            asked = [prefix + (t or "") for t in texts]
            rows = [v for i in range(0, len(asked), batch) for v in fn(asked[i : i + batch])]
            yield pd.Series([(np.asarray(v, float) / max(np.linalg.norm(v), 1e-12)).astype("float32").tolist() for v in rows])

    return df.withColumn("embedding", run(text_col))


def apply_index(old: DataFrame, rebuilt: DataFrame, diff: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The new chunks (unchanged ones and the rebuilt) and the new state; write both as a new version, then swap."""
    stays = diff.where("change = 'unchanged'").select("file_name")
    chunks = old.join(stays, "file_name", "left_semi").unionByName(rebuilt.select(old.columns))
    return chunks, diff.where("change <> 'removed'").select("file_name", "content_hash")


def live(chunks: DataFrame, as_of: Column) -> DataFrame:
    return chunks.where(F.col("effective_date").isNull() | (F.col("effective_date") <= as_of))


def corpus(chunks: DataFrame) -> DataFrame:
    return chunks.orderBy("id")


def document_stats(chunks: DataFrame) -> DataFrame:
    return chunks.rollup("doc_title").agg(F.grouping("doc_title").alias("g"), F.count("*").alias("chunks")).select(F.when(F.col("g") == 1, "全部").otherwise(F.col("doc_title")).alias("doc_title"), "chunks")


def pack_pages(pages: DataFrame, limit: int = 6000) -> DataFrame:
    """Pages of a document in order, joined by a blank line up to the limit; a longer page stays alone.

    The texts of one document meet in one task.
    """

    @F.pandas_udf("array<string>")
    def run(lists: pd.Series) -> pd.Series:
        return lists.map(lambda rows: kernels.pack([r["text"] for r in rows], limit, "\n\n"))

    texts = pages.where("trim(text) <> ''").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_no", "text"))).alias("p"))
    return texts.select("doc_id", F.posexplode(run("p")).alias("batch_no", "text"))


def merge_table_parts(parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows under the headers of a document's first part, in order, and the parts whose headers differ."""
    first = parts.groupBy("doc_id").agg(F.min_by("headers", "part_no").alias("_first"))
    joined = parts.join(first, "doc_id")
    good = joined.where(F.col("headers") == F.col("_first")).select("doc_id", "part_no", "headers", F.posexplode("rows").alias("row_no", "r"))
    return good.select("doc_id", "part_no", "row_no", F.map_from_arrays("headers", "r").alias("row")), joined.where(F.col("headers") != F.col("_first")).drop("_first")


def adapter(documents: DataFrame) -> DataFrame:
    """Test documents as policy files: a title, a front-matter table, a chapter every ten lines and a clause every five."""
    date = "case doc_id % 4 when 0 then concat('20', 10 + doc_id % 20, '年', 1 + doc_id % 12, '月', 1 + doc_id % 28, '日') when 1 then concat('2024-02-', 25 + doc_id % 7) when 2 then '另行通知' else '' end"
    head = f"concat('# 文件 ', doc_id % 50, '\\n\\n| 属性 | 内容 |\\n|---|---|\\n| 文档编号 | HR-', doc_id, ' |\\n| 生效日期 | ', {date}, ' |\\n| 关联数据 | ', lang, ' |\\n\\n')"
    body = "array_join(transform(filter(split(text, '\\n'), l -> not l like '#%'), (l, i) -> case when i % 10 = 0 then concat('## 第', i, '章\\n', l) when i % 5 = 0 then concat('### 第', i % 20, '条\\n', l) else l end), '\\n')"
    return documents.selectExpr("concat('doc_', doc_id, '.md') file_name", f"concat({head}, {body}) text", "doc_id")
