"""Queries of documents, retrieval and rules, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scratch import cut, scratch
from ..operators import documents as docs, retrieval, rules, snapshots, vector_index
from .adapters import table

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return keep


def _files(s, d):
    return docs.adapter(table(s, d, "documents"))


def _loaded(s, d):
    return docs.load_documents(_files(s, d))


def _chunks(s, d):
    return docs.chunk_documents(_loaded(s, d))


_DATE = "case doc_id % 4 when 0 then make_date(2010 + doc_id % 20, 1 + doc_id % 12, 1 + doc_id % 28) when 1 then case when 25 + doc_id % 7 <= 29 then make_date(2024, 2, 25 + doc_id % 7) end end"
query("front_matter", "select concat('doc_', doc_id, '.md') file_name, concat('HR-', doc_id) doc_no, case doc_id % 4 when 0 then 3 when 1 then 3 when 2 then 3 else 2 end n from documents")(
    lambda s, d: _files(s, d).select("file_name", docs.parse_front_matter("text").alias("p")).selectExpr("file_name", "p.meta['文档编号'] doc_no", "size(p.meta) n")
)
query("extract_title", "select concat('文件 ', doc_id % 50) title, count(*) n from documents group by 1")(lambda s, d: _files(s, d).select(docs.extract_title(F.col("text")).alias("title")).groupBy("title").agg(F.count("*").alias("n")))
query("effective_date", f"select concat('doc_', doc_id, '.md') file_name, {_DATE} effective_date, lang data_type from documents")(lambda s, d: _loaded(s, d).selectExpr("file_name", "effective_date", "metadata['data_type'] data_type"))
query("split_headings")(lambda s, d: _loaded(s, d).select("file_name", F.posexplode(docs.split_headings("body")).alias("n", "c")).selectExpr("file_name", "n", "c.title title", "size(c.clauses) clauses"))
query("chapter_counts", r"""with b as (select doc_id, list_filter(string_split(text, chr(10)), lambda l: not starts_with(l, '#')) l from documents), c as (select doc_id, (len(l) + 9) // 10 chapters, (len(l) + 4) // 10 clauses from b)
 select concat('doc_', doc_id, '.md') file_name, case when chapters > 0 then chapters end::bigint chapters, clauses::bigint clauses from c where chapters > 0""")(
    lambda s, d: _loaded(s, d).select("file_name", F.explode(docs.split_headings("body")).alias("c")).groupBy("file_name").agg(F.count("*").alias("chapters"), F.sum(F.size("c.clauses")).cast("long").alias("clauses"))
)
query("clean_body")(lambda s, d: table(s, d, "documents").select("doc_id", docs.clean_body(F.concat(F.lit("\n---\n\n"), "text", F.lit("  \n\n\n\nend\n---\n"))).alias("body")))
query("clause_no", "select doc_id, case when doc_id % 4 <> 3 then concat('第', doc_id % 30, '条') else '' end clause_no from documents")(lambda s, d: table(s, d, "documents").select("doc_id", docs.clause_no(F.expr("concat(if(doc_id % 4 = 3, '见', ''), '第', doc_id % 30, '条 ', text)")).alias("clause_no")))
query("split_sentences")(lambda s, d: table(s, d, "documents").select("doc_id", F.size(docs.split_sentences("text")).alias("n")))
query("pack_paragraphs")(lambda s, d: table(s, d, "documents").select("doc_id", docs.pack_paragraphs(600)("text").alias("p")).selectExpr("doc_id", "size(p) n", "array_max(transform(p, x -> length(x))) longest"))
query("chunk_documents")(lambda s, d: _chunks(s, d))
query("clause_chunks", r"""with l as (select doc_id, unnest(generate_series(1, len(list_filter(string_split(text, chr(10)), lambda l: not starts_with(l, '#'))))) - 1 i from documents)
 select concat('doc_', doc_id, '.md') file_name, concat('第', i % 20, '条') section, count(*) n from l where i % 10 = 5 group by 1, 2""")(lambda s, d: _chunks(s, d).where("section <> ''").groupBy("file_name", "section").agg(F.count("*").alias("n")))
query("unique_keys", "select doc_id, case when rn = 1 then concat('k', doc_id % 7) else concat('k', doc_id % 7, '#', rn) end chunk_key from (select *, row_number() over (partition by source, doc_id % 7 order by doc_id) rn from documents)")(
    lambda s, d: docs.unique_keys(table(s, d, "documents").selectExpr("doc_id", "source file_name", "concat('k', doc_id % 7) key_base", "doc_id chunk_index")).select("doc_id", "chunk_key")
)
query("chunk_length_report", "select source file_name, count(*) chunks, min(length(text)) shortest, max(length(text)) longest, count(*) filter (length(text) > 600) \"over\" from documents group by 1")(lambda s, d: docs.chunk_length_report(table(s, d, "documents").selectExpr("source file_name", "text content")))
query("chunk_audit_clean", "select k.k \"check\", 0::bigint violations from (values ('key_missing'), ('key_repeated'), ('two_chapters'), ('clause_number_lost'), ('clause_without_chunk'), ('clause_count_differs'), ('body_lost')) k(k), (select count(*) n from documents) c where c.n > 0")(lambda s, d: docs.audit_chunks(_loaded(s, d), _chunks(s, d)))


@query("chunk_audit", """with n as (select doc_id % 8 k from documents) select 'key_missing' "check", count(*) filter (k = 1) violations from n union all select 'key_repeated', count(*) filter (k = 2) from n union all select 'two_chapters', count(*) filter (k = 3) from n
 union all select 'clause_number_lost', count(*) filter (k = 4) from n union all select 'clause_without_chunk', count(*) filter (k = 5) from n union all select 'clause_count_differs', count(*) filter (k in (2, 5)) from n union all select 'body_lost', count(*) filter (k = 6) from n""")
def _broken(s, d):
    """One clause for each document; its chunk breaks the rule that the document's number names."""
    t = table(s, d, "documents").selectExpr("concat('f', doc_id) file_name", "concat('body ', md5(text)) t", "doc_id % 8 k")
    own = t.where("k <> 5").withColumn("copy", F.explode(F.expr("if(k = 2, array(1, 2), array(1))")))
    chunks = own.selectExpr("file_name", "if(k = 1, '', concat('clause:', 7)) chunk_key", "'第7条 规定' section", "if(k = 4, '', '第7条') clause_no",
                            "concat('## 总则\n\n### 第7条 规定\n\n', if(k = 6, 'other', t), if(k = 3, '\n## 附则\n', '')) content")
    return docs.audit_chunks(t.selectExpr("file_name", "concat('## 总则\n### 第7条 规定\n', t) body"), chunks)


_HASH = "md5(concat(text, chr(1), '{\"lang\":\"', lang, '\",\"source\":\"', source, '\"}', chr(1), 'clause-1'))"
query("doc_checksum", f"select doc_id, {_HASH} h, md5(text) c from documents")(
    lambda s, d: table(s, d, "documents").selectExpr("doc_id", "text body", "text content", "map('source', source, 'lang', lang) metadata").select("doc_id", docs.doc_checksum().alias("h"), docs.chunk_checksum().alias("c"))
)


def _diff(s, d):
    t = table(s, d, "documents")
    return docs.index_diff(t.where("doc_id % 5 <> 0").selectExpr("cast(doc_id as string) file_name", "md5(text) content_hash"), t.where("doc_id % 7 <> 0").selectExpr("cast(doc_id as string) file_name", "if(doc_id % 3 = 0, 'old', md5(text)) content_hash"))


query("index_diff", "select cast(doc_id as varchar) file_name, case when doc_id % 7 = 0 then 'added' when doc_id % 5 = 0 then 'removed' when doc_id % 3 = 0 then 'updated' else 'unchanged' end change from documents where doc_id % 5 <> 0 or doc_id % 7 <> 0")(lambda s, d: _diff(s, d).select("file_name", "change"))


def _old_chunks(s, d):
    return table(s, d, "embeddings").selectExpr("cast(vec_id % 50 as string) file_name", "cast(vec_id as string) chunk_key", "if(vec_id % 3 = 0, 'old', md5(cast(vec_id as string))) content_hash", "embedding", "timestamp '2024-01-01' created_at", "timestamp '2024-01-01' updated_at")


query("vector_reuse", "select cast(vec_id as varchar) chunk_key, vec_id % 3 <> 0 reused, vec_id % 3 <> 0 has_vector, timestamp '2024-01-01' created_at, case when vec_id % 3 <> 0 then timestamp '2024-01-01' else timestamp '2024-06-01' end updated_at from embeddings")(
    lambda s, d: docs.plan_reuse(table(s, d, "embeddings").selectExpr("cast(vec_id % 50 as string) file_name", "cast(vec_id as string) chunk_key", "md5(cast(vec_id as string)) content_hash"), _old_chunks(s, d), F.lit("2024-06-01").cast("timestamp")).select("chunk_key", "reused", F.col("embedding").isNotNull().alias("has_vector"), "created_at", "updated_at")
)
# a vector of unit length from which the counts that made it are read back
query("embed", "select doc_id, length(text) - length(replace(text, 'e', '')) n_e, length(text) - length(replace(text, ' ', '')) n_space, true unit from documents")(
    lambda s, d: docs.embed(table(s, d, "documents"), lambda texts: [[1.0 + len(t), t.count("e"), t.count(" ")] for t in texts], "text").select(
        "doc_id", *(F.expr(f"cast(round(cast(embedding[{i}] as double) / embedding[0] * (1 + length(text))) as long)").alias(c) for i, c in ((1, "n_e"), (2, "n_space"))), F.expr("abs(aggregate(embedding, 0d, (a, x) -> a + x * x) - 1) < 1e-5").alias("unit")
    )
)


@query("apply_index", "select cast(doc_id as varchar) file_name, case when doc_id % 7 <> 0 and doc_id % 3 <> 0 then 'kept' else 'rebuilt' end how from documents where doc_id % 5 <> 0")
def _apply(s, d):
    diff, t = _diff(s, d), table(s, d, "documents")
    old = t.where("doc_id % 7 <> 0").selectExpr("cast(doc_id as string) file_name", "'kept' how")
    rebuilt = diff.where("change in ('added', 'updated')").selectExpr("file_name", "'rebuilt' how")
    return docs.apply_index(old, rebuilt, diff)[0]


@query("snapshot_refresh", "select cast(vec_id as varchar) chunk_key, 'v' || case when vec_id % 3 = 0 then case when vec_id % 7 = 0 then 3 else 2 end else case when vec_id % 7 = 0 then 3 else 1 end end made, vec_id % 7 <> 0 reused from embeddings")
def _refresh(s, d):
    """Two refreshes of a stored index: the vectors of chunks whose text stays are taken from the version before."""
    root = scratch(s)
    texts = lambda n: table(s, d, "embeddings").selectExpr("cast(vec_id % 50 as string) file_name", "cast(vec_id as string) chunk_key", f"md5(concat(vec_id, if({n} >= 2 and vec_id % 3 = 0, 'b', 'a'), if({n} >= 3 and vec_id % 7 = 0, 'c', ''))) content_hash")
    made, at = lambda n: F.array(F.lit(float(n))), lambda n: F.lit(f"2024-01-0{n}").cast("timestamp")
    first = texts(1).withColumns({"embedding": made(1), "created_at": at(1), "updated_at": at(1)})
    snapshots.swap(s, root, snapshots.write_version(first, root, ["file_name", "chunk_key"], 8))
    for n in (2, 3):
        planned = docs.plan_reuse(texts(n), snapshots.read_version(s, root), at(n))
        snapshots.swap(s, root, snapshots.write_version(planned.withColumn("embedding", F.coalesce("embedding", made(n))), root, ["file_name", "chunk_key"], 8))
    return snapshots.read_version(s, root).selectExpr("chunk_key", "concat('v', cast(embedding[0] as int)) made", "reused")


query("live_filter", f"select concat('doc_', doc_id, '.md') file_name from documents where coalesce({_DATE}, date '1900-01-01') <= date '2020-06-30'")(lambda s, d: docs.live(_loaded(s, d), F.lit("2020-06-30").cast("date")).select("file_name"))
query("document_stats", "select source doc_title, count(*) chunks from documents group by 1 union all select '全部', count(*) from documents")(lambda s, d: docs.document_stats(table(s, d, "documents").withColumnRenamed("source", "doc_title")))
query("corpus", "select doc_id id, source from documents")(lambda s, d: docs.corpus(table(s, d, "documents").selectExpr("doc_id id", "source")))
query("pack_pages")(lambda s, d: docs.pack_pages(table(s, d, "conversations").selectExpr("conv_id doc_id", "cast(turn as int) page_no", "text"), 2000).selectExpr("doc_id", "batch_no", "length(text) n", "md5(text) h"))
query("pack_pages_total", "select conv_id doc_id, sum(length(text)) + 2 * (count(*) - 1) n from conversations where trim(text) <> '' group by 1")(
    lambda s, d: docs.pack_pages(table(s, d, "conversations").selectExpr("conv_id doc_id", "cast(turn as int) page_no", "text"), 2000).groupBy("doc_id").agg((F.sum(F.length("text")) + 2 * (F.count("*") - 1)).alias("n"))
)
query("merge_table_parts", "select l_orderkey doc_id, l_linenumber part_no, l_partkey p, l_quantity q from (select *, count(*) over (partition by l_orderkey, l_linenumber) c, min(l_linenumber) over (partition by l_orderkey) m from lineitem) where l_returnflag <> '-'")(
    lambda s, d: docs.merge_table_parts(table(s, d, "lineitem").selectExpr("l_orderkey doc_id", "l_linenumber part_no", "array('p', 'q') headers", "array(array(cast(l_partkey as string), cast(l_quantity as string))) rows"))[0].selectExpr("doc_id", "part_no", "cast(row['p'] as long) p", "cast(row['q'] as double) q")
)

# retrieval: benchmark passages ask all documents; every twentieth vector asks all vectors
_TOK = "list_transform(regexp_extract_all(text, '[a-zA-Z0-9]+'), lambda t: lower(t))"
_BM = f"""toks as (select doc_id id, {_TOK} t from documents), len as (select id, len(t) length from toks), tot as (select count(*) n, avg(length) average from len),
 post as (select token, id, count(*) tf from (select id, unnest(t) token from toks) group by 1, 2), w0 as (select token, ln(n - count(*) + 0.5::double) - ln(count(*) + 0.5::double) raw from post, tot group by token, n),
 w as (select token, case when raw < 0 then (select avg(raw) * 0.25 from w0) else raw end idf from w0), asked as (select query_id, token, count(*) times from (select item_id query_id, unnest({_TOK}) token from benchmark) group by 1, 2),
 sc as (select query_id, post.id, round(sum(times * idf * tf * 2.5::double / (tf + 1.5::double * (0.25::double + 0.75::double * length / average))), 6) score from asked join w using (token) join post using (token) join len on len.id = post.id, tot group by 1, 2),
 bm as (select *, row_number() over (partition by query_id order by score desc, id) rank from sc qualify rank <= 20)"""


def _corpus(s, d):
    return table(s, d, "documents").selectExpr("doc_id id", "text content")


def _asked(s, d):
    return table(s, d, "benchmark").selectExpr("item_id query_id", "text")


query("tokenize", f"select doc_id, len(t) n, md5(array_to_string(t, ' ')) h from (select doc_id, {_TOK} t from documents)")(lambda s, d: table(s, d, "documents").select("doc_id", retrieval.tokenize(F.col("text")).alias("t")).selectExpr("doc_id", "size(t) n", "md5(array_join(t, ' ')) h"))
query("bm25_weights", f"with {_BM} select token, round(idf, 6) idf from w")(lambda s, d: retrieval.bm25_index(_corpus(s, d)).weights.select("token", F.round("idf", 6).alias("idf")))
query("bm25_top20", f"with {_BM} select query_id, id, round(score, 3) score, rank from bm")(lambda s, d: retrieval.bm25_search(retrieval.bm25_index(_corpus(s, d)), _asked(s, d), _corpus(s, d)).withColumn("score", F.round("score", 3)))
_DOT = "list_dot_product(q.embedding::double[], e.embedding::double[]) / sqrt(list_dot_product(q.embedding::double[], q.embedding::double[]) * list_dot_product(e.embedding::double[], e.embedding::double[]))"
_VEC = f"""sim as (select q.vec_id query_id, e.vec_id id, {_DOT} s from embeddings q, embeddings e where q.vec_id % 20 = 0), vec as (select query_id, id, round(0.5 + s / 2, 4) score, row_number() over (partition by query_id order by round(s, 9) desc, id) rank from sim qualify rank <= 20)"""


def _vectors(s, d):
    return table(s, d, "embeddings").selectExpr("vec_id id", "embedding")


def _vec_asked(s, d):
    return table(s, d, "embeddings").where("vec_id % 20 = 0").selectExpr("vec_id query_id", "embedding")


query("vector_top20", f"with {_VEC} select * from vec")(lambda s, d: retrieval.vector_search(_vectors(s, d), _vec_asked(s, d)))
query("rrf_top5", f"""with {_BM}, {_VEC}, u as (select query_id, id, max(a) a, max(b) b from (select query_id, id, rank a, null b from bm union all select query_id, id, null, row_number() over (partition by query_id order by rank) from vec where id in (select doc_id from documents)) group by 1, 2)
 select query_id, id, round(raw, 4) score, row_number() over (partition by query_id order by round(raw, 12) desc, a nulls last, b nulls last, id) rank from (select *, coalesce(1.0::double / (60 + a), 0) + coalesce(1.0::double / (60 + b), 0) raw from u) qualify rank <= 5""")(
    lambda s, d: retrieval.rrf(retrieval.bm25_search(retrieval.bm25_index(_corpus(s, d)), _asked(s, d), _corpus(s, d)), retrieval.vector_search(_vectors(s, d), _vec_asked(s, d)), _corpus(s, d))
)
_RRF = """u as (select query_id, id, max(a) a, max(b) b from (select query_id, id, rank a, null b from bm union all select query_id, id, null, row_number() over (partition by query_id order by rank) from vec where id in (select doc_id from documents)) group by 1, 2)
 select query_id, id, round(raw, 4) score, row_number() over (partition by query_id order by round(raw, 12) desc, a nulls last, b nulls last, id) rank from (select *, coalesce(1.0::double / (60 + a), 0) + coalesce(1.0::double / (60 + b), 0) raw from u) qualify rank <= 5"""
# all documents and all passages; those whose number no vector has are found by their words alone
query("hybrid_retrieve", f"with {_BM}, {_VEC.replace('embeddings q, embeddings e where q.vec_id % 20 = 0', 'embeddings q, embeddings e where q.vec_id in (select item_id from benchmark) and e.vec_id in (select doc_id from documents)')}, {_RRF}")(
    lambda s, d: retrieval.hybrid_retrieve(_corpus(s, d), _asked(s, d).join(_vectors(s, d).withColumnRenamed("id", "query_id"), "query_id", "left"), vectors=_vectors(s, d).join(_corpus(s, d).select("id"), "id", "left_semi"))
)
# every list probed is the exact answer; with the lists that were measured to suffice, nine in ten true neighbours are found
query("vector_index_all_lists", f"with {_VEC} select * from vec")(
    lambda s, d: vector_index.search_index(index := vector_index.build_index(_vectors(s, d)), _vec_asked(s, d), 20, probes=len(index.sizes)).select("query_id", "id", F.round(0.5 + F.col("similarity") / 2, 4).alias("score"), "rank")
)


@query("vector_index_recall", "select count(*) queries, true enough from embeddings where vec_id % 20 = 0")
def _recall(s, d):
    hits, truth = (f(_vec_asked(s, d)) for f in (lambda q: vector_index.search_index(vector_index.build_index(_vectors(s, d)), q, 20), lambda q: retrieval.cosine_top_k(_vectors(s, d), q, 20)))
    found = truth.join(hits.select("query_id", "id", F.lit(True).alias("hit")), ["query_id", "id"], "left")
    return found.agg(F.countDistinct("query_id").alias("queries"), (F.avg(F.when(F.col("hit"), 1.0).otherwise(0.0)) >= 0.9).alias("enough"))



def _chunk_table(s, d):
    """Whole documents as chunks; those of a source among a hundred neighbours are a chapter."""
    return table(s, d, "documents").selectExpr("source file_name", "doc_id id", "concat('chapter:', doc_id div 100) parent_key", "cast(doc_id as int) chunk_index", "concat('第', doc_id div 100, '章') chapter", "if(doc_id % 10 = 0, '', concat('第', doc_id % 10, '条')) section", "concat('## 第', doc_id div 100, '章\\n\\n', text) content", "source doc_title")


def _hits(s, d):
    return cut(retrieval.bm25_search(retrieval.bm25_index(_corpus(s, d)), _asked(s, d), _corpus(s, d), 5))  # found once, small


_CH = "ch as (select source file_name, doc_id id, concat('chapter:', doc_id // 100) parent_key, doc_id chunk_index, case when doc_id % 10 = 0 then '' else concat('第', doc_id % 10, '条') end section from documents)"
query("parent_chunks", f"with {_BM}, {_CH}, k as (select distinct file_name, parent_key from bm join ch using (id) where rank <= 5) select file_name, parent_key, id from ch where (file_name, parent_key) in (select (file_name, parent_key) from k)")(
    lambda s, d: retrieval.parent_chunks(_hits(s, d).join(_chunk_table(s, d), "id"), _chunk_table(s, d)).select("file_name", "parent_key", "id")
)
query("build_context")(lambda s, d: retrieval.build_context(_hits(s, d), _chunk_table(s, d)))
query("audit_context_clean", "select item_id query_id, 0::bigint lost from benchmark")(lambda s, d: retrieval.audit_context(retrieval.build_context(hits := _hits(s, d), _chunk_table(s, d)), hits, _chunk_table(s, d)).drop("length"))


@query("audit_context", """select doc_id query_id, case doc_id % 5 when 1 then 1 when 2 then 1 when 3 then 1 when 4 then 2 else 0 end::bigint lost, case doc_id % 5 when 0 then 78 when 1 then 72 when 2 then 77 when 3 then 84 else 1 end::bigint length from documents""")
def _damaged(s, d):
    """Two hits for each document; by its number the context lost a mark, lost text, repeats a mark or lost all."""
    t = table(s, d, "documents").selectExpr("doc_id", "md5(text) a", "md5(concat(text, 'b')) b")
    chunks = t.selectExpr("2 * doc_id id", "a content").union(t.selectExpr("2 * doc_id + 1", "b"))
    hits = t.selectExpr("doc_id query_id", "2 * doc_id id", "1 rank").union(t.selectExpr("doc_id", "2 * doc_id + 1", "2"))
    whole = "concat('[来源1] ', a, '\n\n[来源2] ', b)"
    contexts = t.selectExpr("doc_id query_id", f"case doc_id % 5 when 0 then {whole} when 1 then concat('[来源1] ', a, '\n\n', b) when 2 then concat('[来源1] ', substr(a, 2), '\n\n[来源2] ', b) when 3 then concat({whole}, ' [来源1]') else '-' end context")
    return retrieval.audit_context(contexts, hits, chunks)


query("extract_sources", f"with {_BM} select query_id, rank, round(score, 3) score, source doc_title from bm join documents on id = doc_id where rank <= 5")(lambda s, d: retrieval.extract_sources(_hits(s, d), _chunk_table(s, d)).select("query_id", "rank", F.round("score", 3).alias("score"), "doc_title"))
query("calibrate_floor", f"""with best as (select q.vec_id, q.vec_id % 40 = 0 is_on, max(round(0.5 + {_DOT} / 2, 4)) score from (select vec_id, list_reverse(embedding) embedding from embeddings where vec_id % 20 = 0) q, embeddings e group by 1, 2), f as (select unnest([0.6, 0.65, 0.7])::double floor)
 select floor, count(*) filter (is_on and score < floor) lost, count(*) filter (not is_on and score < floor) blocked, min(score) filter (is_on) min_on, max(score) filter (not is_on) max_off, round(min(score) filter (is_on) - max(score) filter (not is_on), 4) gap from best, f group by floor""")(
    lambda s, d: retrieval.calibrate_floor(*(_vec_asked(s, d).withColumn("embedding", F.reverse("embedding")).where(f"query_id % 40 {sign} 0") for sign in ("=", "<>")), _vectors(s, d), [0.6, 0.65, 0.7]).drop("median_on", "median_off")
)

# rules: vectors are rules; for every twentieth a new one comes, whose vector is its reverse
_R = ["vec_id id", "concat('rule ', vec_id % 97, '。') content", "embedding", "if(vec_id % 3 = 0, 'department', 'global') scope", "if(vec_id % 3 = 0, concat('D', vec_id % 4), null) department", "if(vec_id % 5 = 0, 'candidate', 'active') status", "concat('s', vec_id % 11) session_id",
      "if(vec_id % 6 = 0, null, date_add(date '2024-01-01', cast(vec_id % 300 as int))) effective_from", "if(vec_id % 7 = 0, date_add(date '2024-06-01', cast(vec_id % 100 as int)), null) effective_until", "timestamp '2024-01-01' created_at", "timestamp '2024-01-01' updated_at", "timestampadd(day, cast(vec_id % 200 as int), timestamp '2024-01-01') last_accessed"]
_RSQL = """ru as (select vec_id id, concat('rule ', vec_id % 97, '。') content, embedding, case when vec_id % 3 = 0 then 'department' else 'global' end scope, case when vec_id % 3 = 0 then concat('D', vec_id % 4) end department, case when vec_id % 5 = 0 then 'candidate' else 'active' end status, concat('s', vec_id % 11) session_id,
 case when vec_id % 6 <> 0 then date '2024-01-01' + (vec_id % 300)::int end effective_from, case when vec_id % 7 = 0 then date '2024-06-01' + (vec_id % 100)::int end effective_until, timestamp '2024-01-01' + to_days((vec_id % 200)::int) last_accessed from embeddings),
 fo as (select * from ru where (effective_from is null or effective_from <= date '2024-06-30') and (effective_until is null or effective_until >= date '2024-06-30'))"""


def _rules(s, d):
    return table(s, d, "embeddings").selectExpr(*_R)


def _day():
    return F.lit("2024-06-30").cast("date")


def _arriving(s, d):
    return _rules(s, d).where("id % 20 = 0").withColumns({"id": F.col("id") + 10_000_000, "embedding": F.reverse("embedding")})


def _nearest(s, d):
    return rules.nearest_rule(_arriving(s, d), _rules(s, d), _day())


def _decided(s, d):
    near = _nearest(s, d).withColumn("score", F.col("score") + 0.2)
    return rules.decide_rule(near, _rules(s, d), near.selectExpr("id", "if(id % 40 = 0, 'update', 'different') verdict"))


_NEW = "nw as (select id + 10000000 id, content, list_reverse(embedding) embedding, scope, department from ru where id % 20 = 0)"
_NEAR = f"""{_RSQL}, {_NEW}, ne as (select q.id, q.content, q.scope, q.department, e.id old_id, e.content old_content, round(0.5 + ({_DOT}) / 2, 6) score, row_number() over (partition by q.id order by round({_DOT}, 9) desc, e.id) rn from nw q join fo e on q.scope = e.scope and q.department is not distinct from e.department qualify rn = 1)"""
_DEC = f"""{_NEAR}, de as (select *, case when score + 0.2 >= 0.9 and content = old_content then 'touch' when score + 0.2 >= 0.95 then 'supersede' when score + 0.2 >= 0.9 and id % 40 = 0 then 'supersede' else 'new' end decision from ne)"""
query("rule_hints", "select conv_id, turn, turn % 3 = 0 hint from conversations")(lambda s, d: table(s, d, "conversations").select("conv_id", "turn", rules.has_rule_hint(F.expr("concat(text, if(turn % 3 = 0, ' 记住这个', ''))")).alias("hint")))
_LINES = "concat('- 通用|', translate(text, '\\n|', '  '), '\\n', case turn % 4 when 0 then '部门:销售部| 按签约额算' when 1 then '会话|本次只统计' when 2 then '部门:|x' else '无' end, '\\n* plain ', turn, '\\n\\n部门:财务|') text"
query("parse_rule_lines", """select conv_id, turn, 'global' as scope, null department, md5(trim(translate(text, chr(10) || '|', '  '))) content, 0 line_no from conversations where trim(translate(text, chr(10) || '|', '  ')) <> ''
 union all select conv_id, turn, 'department', '销售部', md5('按签约额算'), 1 from conversations where turn % 4 = 0 union all select conv_id, turn, 'global', null, md5('x'), 1 from conversations where turn % 4 = 2 union all select conv_id, turn, 'global', null, md5(concat('plain ', turn)), 2 from conversations""")(
    lambda s, d: rules.parse_rule_lines(table(s, d, "conversations").selectExpr("conv_id", "turn", _LINES)).select("conv_id", "turn", "scope", "department", F.md5("content").alias("content"), "line_no")
)
query("admit_rules", "select item_id, case when item_id % 3 = 1 then 'D' end department from benchmark where item_id % 5 <> 0 and item_id % 3 <> 2")(
    lambda s, d: rules.admit_rules(table(s, d, "benchmark").selectExpr("item_id", "if(item_id % 5 = 0, '  ', text) content", "case item_id % 3 when 0 then 'global' else 'department' end scope", "if(item_id % 3 = 1, ' D ', ' ') department")).select("item_id", "department")
)
query("already_documented", f"with {_RSQL}, {_NEW}, n as (select q.id, 0.5 + {_DOT} / 2 score, row_number() over (partition by q.id order by round({_DOT}, 9) desc, e.id) rn from (select * from nw where scope = 'global') q, ru e qualify rn <= 3) select distinct id from n where score >= 0.72")(
    lambda s, d: rules.already_documented(_arriving(s, d), _vectors(s, d))
)
query("skip_documented", "select vec_id id from embeddings where vec_id % 20 <> 1")(lambda s, d: rules.skip_documented(_rules(s, d), _rules(s, d).where("id % 20 = 1").select("id")).select("id"))
query("nearest_rule", f"with {_NEAR} select id, old_id, score from ne")(lambda s, d: _nearest(s, d).where("old_id is not null").select("id", "old_id", "score"))
query("decide_rule", f"with {_DEC} select id, old_id, decision from de")(lambda s, d: _decided(s, d).where("old_id is not null").select("id", "old_id", "decision"))
query("supersede_rules", f"""with {_DEC}, d2 as (select *, case when decision = 'supersede' and row_number() over (partition by old_id, decision order by id desc) > 1 then 'new' else decision end d from de)
 select id, status, effective_until, scope from (select ru.id, ru.status, case when ru.id in (select old_id from d2 where d = 'supersede') then date '2024-06-29' else ru.effective_until end effective_until, ru.scope from ru)
 union all select d2.id, case when d = 'supersede' then o.status else 'candidate' end, null, d2.scope from d2 left join ru o on o.id = old_id where d in ('supersede', 'new')""")(
    lambda s, d: rules.apply_rules(_rules(s, d), _decided(s, d).where("old_id is not null"), F.lit("2024-06-30 10:00:00").cast("timestamp")).select("id", "status", "effective_until", "scope")
)
query("demote_over_quota", f"with {_RSQL} select id, case when scope = 'department' and status = 'active' and row_number() over (partition by department, scope = 'department' and status = 'active' order by last_accessed desc, id desc) > 5 then 'candidate' else status end status from ru")(lambda s, d: rules.demote_over_quota(_rules(s, d), 5).select("id", "status"))
query("purge_candidates", f"with {_RSQL} select id from ru where status <> 'candidate' union all (select id from ru where status = 'candidate' and last_accessed >= date '2024-06-30' - 90 order by last_accessed desc, id desc limit 20)")(lambda s, d: rules.purge_candidates(_rules(s, d), _day(), quota=20).select("id"))
query("in_force", f"with {_RSQL} select id from fo")(lambda s, d: rules.in_force(_rules(s, d), _day()).select("id"))
query("in_force_at", f"with {_RSQL}, q as (select vec_id query_id, date '2023-12-01' + (vec_id * 7 % 420)::int d from embeddings) select query_id, count(*) n, sum(id)::bigint ids from q join ru on (effective_from is null or effective_from <= d) and (effective_until is null or effective_until >= d) group by 1")(
    lambda s, d: rules.in_force_totals(_rules(s, d), table(s, d, "embeddings").selectExpr("vec_id query_id", "date_add(date '2023-12-01', cast(vec_id * 7 % 420 as int)) as_of")).groupBy("query_id").agg(F.sum("n").alias("n"), F.sum("total").alias("ids"))
)


def _questions(s, d):
    return table(s, d, "embeddings").where("vec_id % 20 = 0").selectExpr("vec_id query_id", "embedding", "concat('what of D', vec_id % 3, '?') text", "concat('s', vec_id % 13) session_id")


_VIS = f"""{_RSQL}, qu as (select vec_id query_id, embedding, concat('what of D', vec_id % 3, '?') text, concat('s', vec_id % 13) session_id from embeddings where vec_id % 20 = 0),
 vi as (select query_id, r.id, qu.embedding qe, r.embedding re from qu join RULES r on (r.status = 'active' and r.scope = 'global') or (r.status = 'active' and r.scope = 'department' and contains(qu.text, r.department)) or (r.status = 'candidate' and r.session_id = qu.session_id))"""
query("visible_rules", f"with {_VIS.replace('RULES', 'ru')} select query_id, count(*) n from vi group by 1")(lambda s, d: rules.visible_counts(_rules(s, d), _questions(s, d)))
_REC = f"""{_VIS.replace('RULES', 'fo')}, re as (select query_id, id, round(0.5 + list_dot_product(qe::double[], re::double[]) / sqrt(list_dot_product(qe::double[], qe::double[]) * list_dot_product(re::double[], re::double[])) / 2, 6) score from vi),
 rr as (select *, row_number() over (partition by query_id order by score desc, id) rank from re where score >= 0.6 qualify rank <= 3)"""


def _recalled(s, d):
    return rules.recall_rules(_questions(s, d), _rules(s, d), _day(), floor=0.6)


query("recall_rules", f"with {_REC} select * from rr")(_recalled)
query("touch_recalled", f"with {_REC} select id, case when id in (select id from rr) then timestamp '2024-07-01' else last_accessed end last_accessed from ru")(lambda s, d: rules.touch_recalled(_rules(s, d), _recalled(s, d), F.lit("2024-07-01").cast("timestamp")).select("id", "last_accessed"))
query("rule_lines", f"with {_REC} select query_id, string_agg(concat('- ', content, coalesce('（' || department || '口径）', '')), chr(10) order by rank) lines from rr join ru using (id) group by 1")(lambda s, d: rules.rule_lines(_recalled(s, d), _rules(s, d)))
query("list_rules", f"with {_RSQL} select id from ru where status = 'candidate' and scope = 'global' order by last_accessed desc, id limit 100")(lambda s, d: rules.list_rules(_rules(s, d), "candidate", "global").select("id"))
query("approve_rules", f"with {_RSQL} select id, case when id % 10 = 0 then 'active' else status end status, case when id % 10 <> 0 then session_id end session_id from ru")(lambda s, d: rules.approve_rules(_rules(s, d), _rules(s, d).where("id % 10 = 0").select("id")).select("id", "status", "session_id"))
query("reject_rules", "select vec_id id from embeddings where vec_id % 10 <> 0")(lambda s, d: rules.reject_rules(_rules(s, d), _rules(s, d).where("id % 10 = 0").select("id")).select("id"))
