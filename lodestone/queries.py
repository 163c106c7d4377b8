"""The registered queries of the retrieval engine, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions.language import STOP_WORDS, coerced, detect_language
from lodestone.functions.outline import sections
from lodestone.functions.vectors import inner, is_finite, is_normalized, stub_embedding
from lodestone.operators import candidates as C
from lodestone.operators import evaluation as E
from lodestone.operators import ingest as I
from lodestone.operators import state as S
from lodestone.operators import views as V
from lodestone.operators.chunking import batches, chunk_document, kept_counted, pack_counted
from lodestone.operators.keyword import browse, title_search
from lodestone.operators.keyword import keyword_bm25 as bm25
from lodestone.operators.keyword import keyword_tf as tf_rank
from lodestone.operators.knn import OVER_FETCH, knn_batch, merge_subqueries
from lodestone.operators.typography import is_scanned
from lodestone.sources.objects import parse_enrichment, split_key
from lodestone.sources.tables import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL where there is one."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ranked(order: str, by: str = "") -> str:
    return f"row_number() OVER ({'PARTITION BY ' + by if by else ''} ORDER BY {order})"


INNER = "round(list_inner_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9)"


# -- Vector search ----------------------------------------------------------------------------------------------------


BATCH_SQL = f"""SELECT q_id, vec_id, score, rank FROM (
  SELECT q.vec_id AS q_id, e.vec_id, {INNER} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY {INNER} DESC, e.vec_id) AS rank
  FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q) WHERE rank <= 10"""


def _batch(spark, sf_dir, k: int = 10, where: str = "true") -> DataFrame:
    corpus = table(spark, sf_dir, "embeddings")
    return knn_batch(corpus.where("vec_id % 50 = 0").select(F.col("vec_id").alias("q_id"), "embedding"), corpus.where(where), k)


@query(BATCH_SQL.replace("rank <= 10", "rank <= 50"))
def knn_topk(spark, sf_dir):
    """The over-fetched nearest of every 50th vector."""
    return _batch(spark, sf_dir, OVER_FETCH)


@query(BATCH_SQL.replace("FROM embeddings e,", "FROM (SELECT * FROM embeddings WHERE label = 3) e,"))
def knn_filtered(spark, sf_dir):
    """The filter is under the limit and reaches the scan."""
    return _batch(spark, sf_dir, 10, "label = 3")


@query(BATCH_SQL)
def knn_batch_topk(spark, sf_dir):
    """J1 over a batch: every 50th vector as a question, ten best each."""
    return _batch(spark, sf_dir)


@query(f"""WITH hits AS (SELECT q.vec_id // 150 AS q_id, e.vec_id, {INNER} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY {INNER} DESC, e.vec_id) AS r
  FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q),
best AS (SELECT q_id, vec_id, max(score) AS score FROM hits WHERE r <= 50 GROUP BY q_id, vec_id)
SELECT q_id, vec_id, score, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, vec_id) AS rank FROM best""")
def subquery_merge(spark, sf_dir):
    """Three sub-queries to a question, each child once at its best."""
    return merge_subqueries(_batch(spark, sf_dir, 50).withColumn("q_id", F.expr("q_id DIV 150")))


LISTS = f"""hits AS (SELECT q.vec_id // 100 AS q_id, q.vec_id AS source, e.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY {INNER} DESC, e.vec_id) AS rank
  FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q QUALIFY rank <= 50)"""


def _lists(spark, sf_dir) -> DataFrame:
    """Two ranked lists to a question: every 50th vector as a source."""
    return _batch(spark, sf_dir, 50).withColumnRenamed("q_id", "source").withColumn("q_id", F.expr("source DIV 100"))


@query(f"""WITH {LISTS}, summed AS (SELECT q_id, vec_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM hits GROUP BY q_id, vec_id)
SELECT q_id, vec_id, score, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, vec_id) AS rank FROM summed QUALIFY rank <= 10""")
def rrf_fusion(spark, sf_dir):
    """Two ranked lists of each question fused, the ten best."""
    return C.fuse(_lists(spark, sf_dir), ["q_id"], "vec_id", top=10).select("q_id", "vec_id", "score", "rank")


@query(f"""WITH b AS ({BATCH_SQL.replace("rank <= 10", "rank <= 50")}),
firsts AS (SELECT q_id, vec_id // 4 AS parent_id, vec_id, rank, row_number() OVER (PARTITION BY q_id, vec_id // 4 ORDER BY rank) AS f FROM b)
SELECT q_id, parent_id, vec_id, row_number() OVER (PARTITION BY q_id ORDER BY rank) AS rank FROM firsts WHERE f = 1""")
def parent_collapse(spark, sf_dir):
    """The best child of each parent, ranked anew."""
    hits = _batch(spark, sf_dir, 50).withColumn("parent_id", F.floor(F.col("vec_id") / 4).cast("long"))
    return C.collapse_to_parents(hits).select("q_id", "parent_id", "vec_id", "rank")


@query("""SELECT label, count(*) AS n, count(*) FILTER (len(embedding) <> 64) AS wrong_width, count(*) FILTER (list_count(list_filter(embedding, lambda x: isnan(x) OR isinf(x))) > 0) AS not_finite,
  count(*) FILTER (abs(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) - 1) < 0.0001) AS normalized FROM embeddings GROUP BY label""")
def vector_quality(spark, sf_dir):
    """M3, M4: width, finiteness and length of the vectors."""
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.size(e) != 64).alias("wrong_width"), F.count_if(~is_finite(e)).alias("not_finite"), F.count_if(is_normalized(e)).alias("normalized"))


@query("""WITH bytes AS (SELECT doc_id, list_transform(range(0, 64), lambda i: ((strpos('0123456789abcdef', substr(sha256(text), ((i % 32) * 2 + 1)::INT, 1)) - 1) * 16 + strpos('0123456789abcdef', substr(sha256(text), ((i % 32) * 2 + 2)::INT, 1)) - 1 - 128) / 128.0::DOUBLE) AS v FROM documents)
SELECT doc_id, round(v[1] / sqrt(list_inner_product(v, v)), 9) AS first, round(v[64] / sqrt(list_inner_product(v, v)), 9) AS last, round(list_inner_product(v, v) / list_inner_product(v, v), 6) AS norm FROM bytes""")
def stub_embeddings(spark, sf_dir):
    """M5, M2: the deterministic embedding of every document."""
    v = F.col("v")
    rows = table(spark, sf_dir, "documents").select("doc_id", stub_embedding(F.col("text"), 64).alias("v"))
    return rows.select("doc_id", F.round(F.get(v, F.lit(0)), 9).alias("first"), F.round(F.get(v, F.lit(63)), 9).alias("last"), F.round(inner(v, v), 6).alias("norm"))


# -- Chunks -----------------------------------------------------------------------------------------------------------

PIECES = """
words AS (SELECT {key}, list_filter(regexp_split_to_array({text}, '\\s+'), lambda w: w <> '') AS w FROM {source}),
counted AS (SELECT {key}, w, len(w) AS n, CASE WHEN ceil(len(w) / {most}) > 1 AND len(w) - (ceil(len(w) / {most}) - 1) * {most} < {least} THEN ceil(len(w) / {most}) - 1 ELSE ceil(len(w) / {most}) END::BIGINT AS k FROM words),
pieces AS (SELECT {key}, i, CASE WHEN i = k - 1 THEN w[(i * {most} + 1):n] ELSE w[(i * {most} + 1):((i + 1) * {most})] END AS p FROM (SELECT *, unnest(range(0, k)) AS i FROM counted))
"""


def pieces_sql(source: str, text: str, key: str, least: int, most: int) -> str:
    return PIECES.format(source=source, text=text, key=key, least=least, most=most)


CHUNKS_SQL = f"""{pieces_sql("documents", "text", "doc_id", 100, 200)},
chunks AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS chunk_index, len(p)::BIGINT AS token_count, array_to_string(p, ' ') AS content FROM pieces WHERE len(p) >= 20)"""


def _chunks(spark, sf_dir) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    pieces = docs.select("doc_id", F.posexplode(kept_counted(pack_counted(F.col("text"), 100, 200))).alias("chunk_index", "piece"))
    return pieces.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.col("piece.token_count").cast("long").alias("token_count"), "piece.content")


@query(f"WITH {CHUNKS_SQL} SELECT doc_id, chunk_index, token_count, content FROM chunks")
def chunk_pack(spark, sf_dir):
    """Child-sized pieces of every document."""
    return _chunks(spark, sf_dir)


NESTED_SQL = f"""WITH {pieces_sql("documents", "text", "doc_id", 500, 1000)},
parents AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS parent_index, array_to_string(p, ' ') AS body FROM pieces WHERE len(p) >= 20)"""


@query(f"""{NESTED_SQL}, {pieces_sql("parents", "body", "doc_id, parent_index", 100, 200).replace("words AS", "words2 AS").replace("FROM words)", "FROM words2)").replace("counted AS", "counted2 AS").replace("FROM counted)", "FROM counted2)").replace("pieces AS", "pieces2 AS")}
SELECT doc_id::VARCHAR AS document_id, parent_index, row_number() OVER (PARTITION BY doc_id ORDER BY parent_index, i) - 1 AS chunk_index, len(p)::BIGINT AS token_count, array_to_string(p, ' ') AS content FROM pieces2 WHERE len(p) >= 20""")
def chunk_parent_child(spark, sf_dir):
    """F3 twice, J3, W6: children inside parents."""
    docs = spread(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("document_id"), "text"))
    return chunk_document(docs)


@query(f"WITH {CHUNKS_SQL} SELECT lang, count(*) AS chunks, sum(token_count)::BIGINT AS tokens, max(token_count) AS longest, round(avg(token_count), 6) AS mean FROM chunks JOIN documents USING (doc_id) GROUP BY lang")
def chunk_stats(spark, sf_dir):
    """Sums over chunks, computed beside the document's columns without a join."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("lang", F.explode(kept_counted(pack_counted(F.col("text"), 100, 200))).alias("piece")).select("lang", F.col("piece.token_count").cast("long").alias("n"))
    return rows.groupBy("lang").agg(F.count("*").alias("chunks"), F.sum("n").alias("tokens"), F.max("n").alias("longest"), F.round(F.avg("n"), 6).alias("mean"))


@query("SELECT doc_id, regexp_replace(regexp_replace(text, '\\n{3,}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS markdown FROM documents")
def sanitize_text(spark, sf_dir):
    """F2."""
    return table(spark, sf_dir, "documents").select("doc_id", T.sanitize(F.col("text")).alias("markdown"))


@query("SELECT doc_id, regexp_replace(concat_ws(chr(10) || chr(10), nullif(concat_ws(' > ', nullif(source, ''), nullif(lang, '')), ''), text), '^\\s+|\\s+$', '', 'g') AS contextualized FROM documents")
def contextualize_text(spark, sf_dir):
    """source and language stand for title and heading."""
    none = F.lit(None).cast("string")
    return table(spark, sf_dir, "documents").select("doc_id", T.contextualize(F.col("source"), F.col("lang"), none, F.col("text")).alias("contextualized"))


@query("SELECT doc_id, left(text, 280) AS quote FROM documents")
def quote_280(spark, sf_dir):
    """F23."""
    return table(spark, sf_dir, "documents").select("doc_id", T.quote(F.lit(""), F.col("text")).alias("quote"))


@query(f"WITH {CHUNKS_SQL} SELECT doc_id, (chunk_index // 20)::BIGINT AS batch, count(*) AS n, sum(token_count)::BIGINT AS tokens FROM chunks GROUP BY ALL")
def provider_batches(spark, sf_dir):
    """Calls of at most 20 chunks and their tokens."""
    return batches(_chunks(spark, sf_dir), "doc_id", "chunk_index", 20).groupBy("doc_id", "batch").agg(F.count("*").alias("n"), F.sum("token_count").alias("tokens"))


# -- Tables of documents ----------------------------------------------------------------------------------------------


@query("SELECT sha256(text) AS sha256, min(doc_id) AS doc_id FROM documents GROUP BY ALL")
def doc_dedup(spark, sf_dir):
    """Each text once, the smallest id of it."""
    docs = table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("sha256"), "doc_id")
    return docs.groupBy("sha256").agg(F.min("doc_id").alias("doc_id"))


@query("SELECT sha256, doc_id FROM (SELECT sha256(text) AS sha256, doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM documents WHERE doc_id % 2 = 1) WHERE r = 1 AND sha256 NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 0)")
def insert_if_new(spark, sf_dir):
    """K4: odd ids arrive where the even ones are held."""
    docs = table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("sha256"), "doc_id")
    return I.insert_if_new(docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1"), "sha256", ["doc_id"])


@query("SELECT doc_id, 0 AS quality FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, quality FROM labels")
def upsert_merge(spark, sf_dir):
    """K3: labels over a default for every document."""
    base = table(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("quality"))
    return I.upsert(base, table(spark, sf_dir, "labels").select("doc_id", "quality"), ["doc_id"])


@query(f"""WITH {CHUNKS_SQL}, old AS (SELECT doc_id, chunk_index, 'old' AS version FROM chunks), new AS (SELECT doc_id, chunk_index, 'new' AS version FROM chunks WHERE doc_id % 3 = 0 AND chunk_index < 2)
SELECT * FROM old WHERE doc_id NOT IN (SELECT doc_id FROM new) UNION ALL SELECT * FROM new""")
def replace_leftovers(spark, sf_dir):
    """A rerun with fewer chunks leaves none of the old behind."""
    chunks = _chunks(spark, sf_dir).select("doc_id", "chunk_index")
    new = chunks.where("doc_id % 3 = 0 AND chunk_index < 2").withColumn("version", F.lit("new"))
    return I.replace_documents(chunks.withColumn("version", F.lit("old")), new, "doc_id")


@query(f"WITH {CHUNKS_SQL} SELECT doc_id, chunk_index FROM chunks WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def delete_cascade(spark, sf_dir):
    """Chunks of deleted documents go with them."""
    gone = table(spark, sf_dir, "labels").where("toxic = 1")
    return I.delete_documents([_chunks(spark, sf_dir).select("doc_id", "chunk_index")], gone, "doc_id")[0]


@query("SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_pending(spark, sf_dir):
    """What has no result yet."""
    return I.pending(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), table(spark, sf_dir, "labels"), ["doc_id"])


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def stale_stages(spark, sf_dir):
    """Documents whose output is missing or made from another input."""
    docs = table(spark, sf_dir, "documents").select("doc_id", I.fingerprint("text").alias("input_fp"))
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    made = docs.join(labels, "doc_id").select("doc_id", F.when(F.col("quality") == 1, F.col("input_fp")).otherwise(F.lit("older")).alias("input_fp"))
    return I.stale(docs, made, "doc_id")


@query("""SELECT source, lang FROM (SELECT source, lang, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, min(doc_id)) AS r FROM documents WHERE lang <> '' GROUP BY source, lang) WHERE r = 1""")
def dominant_language(spark, sf_dir):
    """A2."""
    return I.dominant(table(spark, sf_dir, "documents"), "source", "lang", "doc_id")


@query("SELECT event_id, CASE WHEN event_type IN ('click', 'view', 'purchase') THEN event_type ELSE 'OTHER' END AS category FROM events")
def category_coerce(spark, sf_dir):
    """P16."""
    return table(spark, sf_dir, "events").select("event_id", coerced(F.col("event_type"), ("click", "view", "purchase"), "OTHER").alias("category"))


@query("SELECT doc_id, source, (SELECT count(*) FROM documents WHERE lang = 'en') AS total FROM documents WHERE lang = 'en' ORDER BY n_chars DESC, doc_id LIMIT 20 OFFSET 40")
def docs_page(spark, sf_dir):
    """One page of a listing, with the count of all."""
    page = I.list_documents(table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars"), 20, 40, F.col("lang") == "en", (F.desc("n_chars"), "doc_id"))
    return page.select("doc_id", "source", "total")


@query("SELECT d.doc_id, coalesce(l.quality, -1) AS quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def left_overlay(spark, sf_dir):
    """J10, J15, U2, P8."""
    base = table(spark, sf_dir, "documents").select("doc_id", F.lit(-1).alias("quality"))
    return I.overlay(base, table(spark, sf_dir, "labels"), ["doc_id"], ["quality"])


@query("""SELECT page_id, CASE WHEN NOT regexp_full_match(sha, '[0-9a-f]{64}') THEN 'VALIDATION_ERROR' WHEN page_id % 5 = 1 THEN 'HASH_MISMATCH' WHEN page_id % 5 = 2 THEN 'DOCUMENT_NOT_FOUND' WHEN page_id % 5 = 3 THEN 'PDF_TOO_LARGE' END AS error_code
FROM (SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 'no digest' ELSE sha256(html) END AS sha FROM pages)""")
def register_guards(spark, sf_dir):
    """P14, P15, P17."""
    sha = F.when(F.col("page_id") % 7 == 0, "no digest").otherwise(F.sha2("html", 256))
    kind = F.col("page_id") % 5
    pages = table(spark, sf_dir, "pages").select("page_id", sha.alias("sha256"), F.col("url").alias("filename"))
    payloads = pages.withColumn("object_key", F.when(kind == 1, F.concat(F.lit("raw/x"), F.col("page_id").cast("string"))).otherwise(F.concat(F.lit("raw/"), "sha256", F.lit(".pdf")))).withColumn("size_bytes", F.when(kind == 3, 99_999_999_999).otherwise(1000))
    objects = payloads.where(~((F.col("page_id") % 5) == 2)).select("object_key")
    return I.register_guards(payloads, objects).select("page_id", "error_code")


@query("SELECT page_id, split_part(replace(url, '://', '/'), '/', 1) AS bucket, substr(replace(url, '://', '/'), strpos(replace(url, '://', '/'), '/') + 1) AS rest FROM pages")
def key_routing(spark, sf_dir):
    """The bucket of a key and the rest of it."""
    key = split_key(F.replace(F.col("url"), F.lit("://"), F.lit("/")), ("http", "https"))
    return table(spark, sf_dir, "pages").select("page_id", key["bucket"].alias("bucket"), key["rest"].alias("rest"))


# -- Context and citations --------------------------------------------------------------------------------------------

CANDIDATES_SQL = f"""WITH {LISTS}, cands AS (SELECT h.source AS q_id, h.vec_id // 2 AS parent_id, h.rank, length(d.text)::BIGINT AS cost FROM hits h JOIN documents d ON d.doc_id = h.vec_id),
fresh AS (SELECT * FROM cands QUALIFY row_number() OVER (PARTITION BY q_id, parent_id ORDER BY rank) = 1)"""


def _candidates(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), F.length("text").cast("long").alias("cost"))
    hits = _lists(spark, sf_dir).select(F.col("source").alias("q_id"), "vec_id", "rank")
    return hits.join(docs, "vec_id").select("q_id", F.floor(F.col("vec_id") / 2).cast("long").alias("parent_id"), "rank", "cost")


@query(f"""{CANDIDATES_SQL}, laid AS (SELECT q_id, parent_id, row_number() OVER w AS ordinal, (sum(cost) OVER w)::BIGINT AS used FROM fresh WINDOW w AS (PARTITION BY q_id ORDER BY rank ROWS UNBOUNDED PRECEDING))
SELECT * FROM laid WHERE used <= 8000""")
def context_budget(spark, sf_dir):
    """Passages until the first that does not fit."""
    return C.build_context(_candidates(spark, sf_dir), ["q_id"], "parent_id").select("q_id", "parent_id", "ordinal", "used")


@query(f"""{CANDIDATES_SQL}, l1 AS (SELECT q_id, parent_id, row_number() OVER w AS ordinal, (sum(cost) OVER w)::BIGINT AS used FROM fresh WINDOW w AS (PARTITION BY q_id ORDER BY rank ROWS UNBOUNDED PRECEDING)),
p1 AS (SELECT * FROM l1 WHERE used <= 4000), held AS (SELECT q_id, max(used) AS u, max(ordinal) AS o FROM p1 GROUP BY q_id),
l2 AS (SELECT f.q_id, f.parent_id, row_number() OVER w + coalesce(max(o) OVER (PARTITION BY f.q_id), 0) AS ordinal, (sum(cost) OVER w)::BIGINT + coalesce(max(u) OVER (PARTITION BY f.q_id), 0) AS used
  FROM fresh f LEFT JOIN held h ON h.q_id = f.q_id WHERE (f.q_id, f.parent_id) NOT IN (SELECT (q_id, parent_id) FROM p1) WINDOW w AS (PARTITION BY f.q_id ORDER BY rank ROWS UNBOUNDED PRECEDING))
SELECT * FROM p1 UNION ALL SELECT * FROM l2 WHERE used <= 12000""")
def context_accumulate(spark, sf_dir):
    """A second pass adds to the first; what is held costs nothing."""
    candidates = _candidates(spark, sf_dir)
    columns = ["q_id", "parent_id", "ordinal", "used"]
    first = C.build_context(candidates, ["q_id"], "parent_id", 4000).select(columns)
    more = C.build_context(candidates, ["q_id"], "parent_id", 12000, first).select(columns)
    return C.accumulate(first, more)


ANSWERS_SQL = """answers AS (SELECT conv_id, turn, text || ' [' || (turn % 3 + 1) || '] and [' || (turn % 2 + 1) || ', ' || (turn + 2) || '] [' || (turn % 3 + 1) || ']' AS answer FROM conversations),
groups AS (SELECT conv_id, turn, unnest(regexp_extract_all(answer, '\\[(\\d+(?:\\s*,\\s*\\d+)*)\\]', 1)) AS g, generate_subscripts(regexp_extract_all(answer, '\\[(\\d+(?:\\s*,\\s*\\d+)*)\\]', 1), 1) AS gi FROM answers),
numbers AS (SELECT conv_id, turn, gi, unnest(regexp_split_to_array(g, '\\s*,\\s*'))::BIGINT AS ordinal, generate_subscripts(regexp_split_to_array(g, '\\s*,\\s*'), 1) AS ni FROM groups),
cited AS (SELECT conv_id, turn, ordinal, row_number() OVER (PARTITION BY conv_id, turn ORDER BY min((gi, ni))) - 1 AS position FROM numbers GROUP BY conv_id, turn, ordinal)"""


def _answers(spark, sf_dir) -> DataFrame:
    t = F.col("turn")
    n = lambda m: (t % m + 1).cast("string")
    marks = F.concat(F.lit(" ["), n(3), F.lit("] and ["), n(2), F.lit(", "), (t + 2).cast("string"), F.lit("] ["), n(3), F.lit("]"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat("text", marks).alias("answer"))


@query(f"WITH {ANSWERS_SQL} SELECT conv_id, turn, position, ordinal FROM cited")
def citation_parse(spark, sf_dir):
    """Markers in order of first use, once each."""
    return C.cited(_answers(spark, sf_dir), ["conv_id", "turn"]).withColumn("position", F.col("position").cast("long"))


@query(f"WITH {ANSWERS_SQL} SELECT c.conv_id, c.turn, c.ordinal, left(p.text, 280) AS quote FROM cited c JOIN (SELECT conv_id, turn + 1 AS ordinal, text FROM conversations) p ON p.conv_id = c.conv_id AND p.ordinal = c.ordinal")
def citation_map(spark, sf_dir):
    """Citations of passages that were given; a conversation's turns stand for its passages."""
    passages = table(spark, sf_dir, "conversations").select("conv_id", (F.col("turn") + 1).alias("ordinal"), "text", F.lit("").alias("matched"))
    known, _ = C.map_citations(_answers(spark, sf_dir), passages, ["conv_id"])
    return known.select("conv_id", "turn", "ordinal", "quote")


@query(f"WITH {ANSWERS_SQL} SELECT c.conv_id, c.turn, c.ordinal FROM cited c ANTI JOIN (SELECT conv_id, turn + 1 AS ordinal FROM conversations) p ON p.conv_id = c.conv_id AND p.ordinal = c.ordinal")
def citation_phantoms(spark, sf_dir):
    """Citations of nothing."""
    passages = table(spark, sf_dir, "conversations").select("conv_id", (F.col("turn") + 1).alias("ordinal"), "text", F.lit("").alias("matched"))
    return C.map_citations(_answers(spark, sf_dir).select("conv_id", "turn", "answer"), passages, ["conv_id"])[1].select("conv_id", "turn", "ordinal")


# -- Keyword search and fusion ----------------------------------------------------------------------------------------

TERMS = "list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"
INDEX_SQL = f"""split AS (SELECT doc_id, {TERMS.format("text")} AS t FROM documents),
postings AS (SELECT term, doc_id, doc_length, count(*) AS tf FROM (SELECT doc_id, len(t) AS doc_length, unnest(t) AS term FROM split) GROUP BY ALL),
asked AS (SELECT DISTINCT item_id AS q_id, unnest({TERMS.format("text")}) AS term FROM benchmark)"""
TOP10 = "SELECT q_id, doc_id, score, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, doc_id) AS rank FROM scored QUALIFY rank <= 10"
BM25_SQL = f"""{INDEX_SQL}, corpus AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM split), df AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
scored AS (SELECT q_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * doc_length / mean))), 6) AS score FROM postings JOIN asked USING (term) JOIN df USING (term), corpus GROUP BY q_id, doc_id)"""


def _asked(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("q_id"), "text")


@query(f"WITH {INDEX_SQL}, scored AS (SELECT q_id, doc_id, round(sum(tf / doc_length), 6) AS score FROM postings JOIN asked USING (term) GROUP BY q_id, doc_id) {TOP10}")
def keyword_tf(spark, sf_dir):
    """Term frequency; benchmark items as questions."""
    return tf_rank(table(spark, sf_dir, "documents"), _asked(spark, sf_dir)).select("q_id", "doc_id", "score", "rank")


@query(f"WITH {BM25_SQL} {TOP10}")
def keyword_bm25(spark, sf_dir):
    """BM25."""
    return bm25(table(spark, sf_dir, "documents"), _asked(spark, sf_dir)).select("q_id", "doc_id", "score", "rank")


@query(f"""WITH {BM25_SQL}, words AS ({TOP10}),
vectors AS (SELECT q.vec_id AS q_id, e.vec_id AS doc_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY {INNER} DESC, e.vec_id) AS rank FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id IN (SELECT item_id FROM benchmark)) q QUALIFY rank <= 10),
both_lists AS (SELECT q_id, doc_id, rank FROM words UNION ALL SELECT q_id, doc_id, rank FROM vectors), summed AS (SELECT q_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM both_lists GROUP BY q_id, doc_id)
SELECT q_id, doc_id, score, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, doc_id) AS rank FROM summed QUALIFY rank <= 10""")
def hybrid_rrf(spark, sf_dir):
    """D1 and J1 fused by D2: keywords and vectors of the same question."""
    asked, corpus = _asked(spark, sf_dir), table(spark, sf_dir, "embeddings")
    by_words = bm25(table(spark, sf_dir, "documents"), asked).select("q_id", "doc_id", "rank")
    questions = corpus.join(asked, F.col("vec_id") == F.col("q_id")).select("q_id", "embedding")
    by_vector = knn_batch(questions, corpus, 10).select("q_id", F.col("vec_id").alias("doc_id"), "rank")
    return C.fuse(by_words.unionByName(by_vector), ["q_id"], "doc_id", top=10).select("q_id", "doc_id", "score", "rank")


# -- Evaluation -------------------------------------------------------------------------------------------------------

SCORES_SQL = f"""hits AS (SELECT q.vec_id AS q_id, q.label AS kind, e.label = q.label AS match, row_number() OVER (PARTITION BY q.vec_id ORDER BY {INNER} DESC, e.vec_id) AS rank
  FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q WHERE e.vec_id <> q.vec_id QUALIFY rank <= 20),
scores AS (SELECT q_id, kind, max(CASE WHEN rank <= 10 AND match THEN 1.0 ELSE 0.0 END)::DOUBLE AS recall, coalesce(1.0::DOUBLE / min(rank) FILTER (match), 0.0) AS rr FROM hits GROUP BY ALL)"""


def _scores(spark, sf_dir) -> DataFrame:
    """Every 50th vector as a question; what has its label is right."""
    corpus = table(spark, sf_dir, "embeddings")
    asked = corpus.where("vec_id % 50 = 0")
    hits = knn_batch(asked.select(F.col("vec_id").alias("q_id"), "embedding"), corpus, 21).where("vec_id <> q_id")
    again = F.row_number().over(Window.partitionBy("q_id").orderBy("rank"))
    hits = hits.withColumn("rank", again.cast("long")).where("rank <= 20")
    gold = asked.select(F.col("vec_id").alias("q_id"), F.col("label").alias("kind"))
    labelled = hits.join(corpus.select("vec_id", "label"), "vec_id").join(gold, "q_id").withColumn("match", F.col("label") == F.col("kind"))
    return E.per_question(labelled, 10, ["q_id", "kind"])


@query(f"WITH {SCORES_SQL} SELECT q_id, recall, round(rr, 9) AS rr FROM scores")
def recall_mrr(spark, sf_dir):
    """A6, A7, M7."""
    return _scores(spark, sf_dir).select("q_id", "recall", F.round("rr", 9).alias("rr"))


@query(f"WITH {SCORES_SQL} SELECT coalesce(kind::VARCHAR, 'all') AS kind, count(*) AS n, round(avg(recall), 9) AS recall, round(avg(rr), 9) AS mrr FROM scores GROUP BY GROUPING SETS ((kind), ())")
def eval_by_kind(spark, sf_dir):
    """A3, A4: by kind and over all in one pass."""
    return E.summary(_scores(spark, sf_dir)).withColumn("kind", F.coalesce(F.col("kind").cast("string"), F.lit("all")))


@query(f"WITH {SCORES_SQL}, a AS (SELECT q_id, CASE WHEN rr = 1 THEN 1.0 ELSE 0.0 END AS r FROM scores) SELECT count(*) FILTER (s.recall > a.r) AS won, count(*) FILTER (a.r > s.recall) AS lost, count(*) FILTER (s.recall > a.r) - count(*) FILTER (a.r > s.recall) AS net FROM scores s JOIN a USING (q_id)")
def eval_flips(spark, sf_dir):
    """Recall at 1 against recall at 10."""
    scores = _scores(spark, sf_dir)
    return E.flips(scores.withColumn("recall", F.when(F.col("rr") == 1, 1.0).otherwise(0.0)), scores)


@query(f"""WITH {CHUNKS_SQL}, labels2 AS (SELECT doc_id, trim(regexp_replace(lower(substr(text, (doc_id % 40)::INT * 50 % greatest(length(text) - 59, 1)::INT + 1, 60)), '\\s+', ' ', 'g')) AS q FROM documents WHERE length(text) > 0)
SELECT doc_id FROM labels2 WHERE NOT EXISTS (SELECT 1 FROM chunks c WHERE c.doc_id = labels2.doc_id AND contains(trim(regexp_replace(lower(c.content), '\\s+', ' ', 'g')), labels2.q))""")
def label_reachability(spark, sf_dir):
    """A quote from each document that has text; those that lie across a chunk's edge."""
    docs = table(spark, sf_dir, "documents")
    start = (F.col("doc_id") % 40).cast("int") * 50 % F.greatest(F.length("text") - 59, F.lit(1)) + 1
    labels = docs.where(F.length("text") > 0).select("doc_id", F.substring(F.col("text"), start, F.lit(60)).alias("quote"))
    return E.unreachable(labels, _chunks(spark, sf_dir), ["doc_id"]).select("doc_id")


@query("""SELECT conv_id, max(turn) FILTER (role = 'user') AS turn, arg_max(text, turn) FILTER (role = 'user') AS question, greatest(count(*) FILTER (role = 'user') - 1, 0) AS earlier FROM conversations GROUP BY conv_id""")
def history_fold(spark, sf_dir):
    """The question of a conversation is its last user turn; the ones before are its history."""
    user = F.col("role") == "user"
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.max(F.when(user, F.col("turn"))).alias("turn"), F.max_by("text", F.when(user, F.col("turn"))).alias("question"), F.greatest(F.count_if(user) - 1, F.lit(0)).alias("earlier"))


# -- State ------------------------------------------------------------------------------------------------------------

OUTCOME = "CASE event_type WHEN 'error' THEN 'transient' WHEN 'purchase' THEN 'permanent' WHEN 'scroll' THEN 'deferred' ELSE CASE event_id % 7 WHEN 0 THEN 'transient' ELSE 'ok' END END"
STAGE = "['PARSING','STRUCTURING','ENRICHING','EMBEDDING','PERSISTING'][event_id % 5 + 1]"


def _stage_events(spark, sf_dir) -> DataFrame:
    """Events as a stage log: users as documents."""
    kind, n = F.col("event_type"), F.col("event_id")
    outcome = F.when(kind == "error", "transient").when(kind == "purchase", "permanent").when(kind == "scroll", "deferred").when(n % 7 == 0, "transient").otherwise("ok")
    stage = F.element_at(F.array(*map(F.lit, S.STAGES)), (n % 5 + 1).cast("int"))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("document_id"), n.alias("seq"), stage.alias("stage"), outcome.alias("outcome"), F.concat(F.lit("event "), n.cast("string")).alias("error"))


@query(f"""WITH ev AS (SELECT user_id AS document_id, event_id AS seq, {STAGE} AS stage, {OUTCOME} AS outcome FROM events),
counted AS (SELECT *, count(*) FILTER (outcome = 'transient') OVER (PARTITION BY document_id ORDER BY seq) AS a FROM ev),
marked AS (SELECT *, outcome = 'permanent' OR (outcome = 'transient' AND a >= 3) AS dead FROM counted),
ended AS (SELECT document_id, min(seq) FILTER (dead) AS last FROM marked GROUP BY document_id),
live AS (SELECT m.* FROM marked m JOIN ended USING (document_id) WHERE (last IS NULL OR seq <= last) AND outcome <> 'deferred')
SELECT document_id, CASE WHEN arg_max(dead, seq) THEN 'DEAD_LETTER' WHEN arg_max(outcome, seq) <> 'ok' THEN 'RETRYING' WHEN arg_max(stage, seq) = 'PERSISTING' THEN 'COMPLETED' ELSE arg_max(stage, seq) END AS status,
  arg_max(stage, seq) FILTER (outcome = 'ok') AS stage, count(*) FILTER (outcome = 'transient') AS attempts, arg_max(stage, seq) FILTER (outcome <> 'ok') AS failed_stage,
  arg_max('event ' || seq, seq) FILTER (outcome <> 'ok') AS last_error FROM live GROUP BY document_id""")
def state_fold(spark, sf_dir):
    """T6, K8."""
    return S.fold_stages(_stage_events(spark, sf_dir))


@query("""SELECT user_id, since, until, gap_s FROM (SELECT user_id, lag(ts) OVER w AS since, ts AS until, (epoch(date_trunc('second', ts)) - epoch(date_trunc('second', lag(ts) OVER w)))::BIGINT AS gap_s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE gap_s > 600""")
def progress_stalled(spark, sf_dir):
    """Silences of more than ten minutes."""
    return S.stalled(table(spark, sf_dir, "events"), "user_id", "ts")


@query()
def token_bucket(spark, sf_dir):
    """Requests of each user against a bucket of 10 that refills one a minute."""
    events = table(spark, sf_dir, "events")
    at = F.unix_millis(F.col("ts").cast("timestamp"))
    return S.token_bucket(events.select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("seq"), at.alias("at_ms"), (F.col("event_id") % 12).cast("int").alias("tokens"), F.lit(10).alias("capacity"), F.lit(1 / 60).alias("refill_per_sec")))


@query("""WITH e AS (SELECT user_id AS key, event_id AS seq, epoch(date_trunc('second', ts))::BIGINT AS at_s, event_id % 3 = 0 AS ok FROM events), i AS (SELECT *, count(*) FILTER (ok) OVER (PARTITION BY key ORDER BY seq) AS g FROM e)
SELECT key, min(at_s) AS began, max(at_s) AS last, count(*) AS failures, max(at_s) - min(at_s) > 1800 AS failed FROM i WHERE NOT ok GROUP BY key, g""")
def outage_clock(spark, sf_dir):
    """The first failure starts an outage, a success ends it."""
    events = table(spark, sf_dir, "events")
    return S.outages(events.select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("at_s"), (F.col("event_id") % 3 == 0).alias("ok")))


@query("SELECT user_id AS q_id, (sum(event_id % 100))::BIGINT AS total_ms, '[' || string_agg('{\"node\":\"' || event_type || '\",\"ms\":' || (event_id % 100) || '}', ',' ORDER BY event_id) || ']' AS nodes FROM events GROUP BY user_id")
def trace_nodes(spark, sf_dir):
    """The nodes of each question's trace, in order."""
    events = table(spark, sf_dir, "events")
    return S.traces(events.select(F.col("user_id").alias("q_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("node"), (F.col("event_id") % 100).alias("ms")))


@query("SELECT event_type AS strategy, count(*) AS n, round(avg(value), 6) AS mean_value, avg(CASE WHEN event_id % 5 < 2 THEN 1.0 ELSE 0.0 END)::DOUBLE AS refined FROM events GROUP BY event_type")
def trace_health(spark, sf_dir):
    """Distribution of strategies and their means."""
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("strategy")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_value"), F.avg(F.when(F.col("event_id") % 5 < 2, 1.0).otherwise(0.0)).alias("refined"))


@query("SELECT n, least(pow(2, n), 300)::BIGINT AS seconds FROM (SELECT DISTINCT (event_id % 12)::INTEGER AS n FROM events)")
def retry_backoff(spark, sf_dir):
    """M8."""
    n = table(spark, sf_dir, "events").select((F.col("event_id") % 12).cast("int").alias("n")).distinct()
    return n.select("n", S.backoff_seconds(F.col("n")).alias("seconds"))


# -- Beyond SQL: held against fixtures in the tests -------------------------------------------------------------------


@query()
def page_outline(spark, sf_dir):
    """Heading paths of pages whose HTML headings are written as markdown."""
    heading = F.regexp_replace(F.col("html"), r"(?is)<h([1-6])[^>]*>(.*?)</h\1>", "\n# $2\n")
    text = F.regexp_replace(F.regexp_replace(heading, r"(?is)<(script|style).*?</\1>", " "), r"<[^>]+>", " ")
    docs = table(spark, sf_dir, "pages").select(F.col("page_id").alias("document_id"), F.array(T.sanitize(text)).alias("pages"))
    return sections(docs, F.col("pages")).withColumn("page", F.col("page").cast("long")).withColumn("section", F.col("section").cast("long"))


_STOPS = ", ".join(f"('{code}', {list(stops)})" for code, stops in STOP_WORDS.items())
_WORD_CHARS = r"\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}"


@query(rf"""WITH t AS (SELECT doc_id, list_transform(regexp_split_to_array(lower(text), '[\s\p{{Z}}]+'), lambda w: regexp_replace(w, '^[^{_WORD_CHARS}]+|[^{_WORD_CHARS}]+$', '', 'g')) AS words FROM documents),
n AS (SELECT doc_id, code, coalesce(len(list_filter(words, lambda w: list_contains(stops, w))), 0) AS n FROM t, (VALUES {_STOPS}) s(code, stops)),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, code) AS r FROM n)
SELECT doc_id, CASE WHEN n > 0 AND code <> 'vi' THEN code ELSE 'other' END AS language FROM best WHERE r = 1""")
def language_ident(spark, sf_dir):
    """language by function words, all four languages of the table allowed."""
    return table(spark, sf_dir, "documents").select("doc_id", detect_language(F.col("text"), ("de", "en", "es", "fr")).alias("language"))


# -- What callers see, and what the inventory has beside ---------------------------------------------------------------


@query("SELECT conv_id, turn, length(text) BETWEEN 1 AND 2000 AND regexp_replace(text, '^\\s+|\\s+$', '', 'g') <> '' AS valid FROM conversations")
def request_validation(spark, sf_dir):
    """P13."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", V.valid_question(F.col("text")).alias("valid"))


@query("""WITH last AS (SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1)
SELECT c.c_custkey::VARCHAR AS document_id, c.c_name AS name, c.c_mktsegment AS status, CASE WHEN c.c_mktsegment <> 'COMPLETED' AND l.event_id IS NOT NULL THEN least(1.0::DOUBLE, (l.event_id % 100) / 50.0::DOUBLE) END AS ratio FROM customer c LEFT JOIN last l ON l.user_id = c.c_custkey""")
def status_view(spark, sf_dir):
    """Customers stand for documents, their last event for progress."""
    docs = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("document_id"), F.lit(" ").alias("title"), F.col("c_name").alias("filename"), F.col("c_mktsegment").alias("status"))
    last = table(spark, sf_dir, "events").groupBy(F.col("user_id").cast("string").alias("document_id")).agg(F.max_by("event_type", "event_id").alias("stage"), (F.max("event_id") % 100).alias("done"))
    shown = V.status_view(docs, last.withColumns({"total": F.lit(50), "at": F.lit(0.0)}), 0.0)
    return shown.select("document_id", "name", "status", F.col("progress.ratio").alias("ratio"))


@query(f"WITH {LISTS} SELECT source::VARCHAR AS source, count(*) AS candidates, q_id FROM hits GROUP BY source, q_id")
def per_source_counts(spark, sf_dir):
    """A8."""
    return C.per_source(_lists(spark, sf_dir)).withColumn("source", F.col("source").cast("string"))


@query(f"WITH {LISTS}, scored AS (SELECT h.source AS q_id, h.vec_id, h.rank, CASE WHEN h.vec_id % 3 = 0 THEN NULL ELSE length(d.text) END AS s FROM hits h JOIN documents d ON d.doc_id = h.vec_id) SELECT q_id, vec_id, row_number() OVER (PARTITION BY q_id ORDER BY s DESC NULLS LAST, rank) AS rank FROM scored QUALIFY rank() OVER (PARTITION BY q_id ORDER BY s DESC NULLS LAST, rank) <= 10")
def rerank_keep(spark, sf_dir):
    """By an injected score; what it can't score keeps its order."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), F.length("text").alias("n"))
    rows = _lists(spark, sf_dir).select(F.col("source").alias("q_id"), "vec_id", "rank").join(docs, "vec_id")
    return C.rerank(rows, F.when(F.col("vec_id") % 3 != 0, F.col("n")), ["q_id"], "vec_id").select("q_id", "vec_id", "rank")


@query("SELECT conv_id, turn FROM conversations WHERE role || ' > ' || turn LIKE 'user > %' OR role || ' > ' || turn = 'user'")
def heading_browse(spark, sf_dir):
    """Everything under a heading."""
    rows = table(spark, sf_dir, "conversations").withColumn("heading_path", F.concat("role", F.lit(" > "), F.col("turn").cast("string")))
    return browse(rows, "user").select("conv_id", "turn")


@query("""SELECT page_id::VARCHAR AS document_id, len(list_intersect(['example', 'page', '1'], list_distinct(list_filter(regexp_split_to_array(lower(url), '[^\\p{L}\\p{N}]+'), lambda t: t <> ''))))::BIGINT AS score FROM pages WHERE score > 0 ORDER BY score DESC, document_id LIMIT 10""")
def title_match(spark, sf_dir):
    """Full-text match of title and file name."""
    docs = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("document_id"), F.lit(None).cast("string").alias("title"), F.col("url").alias("filename"))
    return title_search(docs, "Example page 1").select("document_id", "score")


@query("SELECT doc_id, embedding[1]::DOUBLE AS first, quality FROM (SELECT vec_id AS doc_id, embedding FROM embeddings) JOIN labels USING (doc_id)")
def keyed_vectors(spark, sf_dir):
    """Vectors beside their rows by key; a row without its other half fails the query."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.get("embedding", F.lit(0)).cast("double").alias("first"))
    return I.positional_join(vectors.join(labels, "doc_id", "left_semi"), labels.join(vectors, "doc_id", "left_semi"), ["doc_id"])


@query("""SELECT event_id, event_id % 1000 AS id, 'c' || event_id AS context, event_type AS category FROM events WHERE event_id % 4 <> 0""")
def enrichment_parse(spark, sf_dir):
    """Tolerant parsing of replies: ids as text are read, items without a number and broken replies are dropped."""
    n, kind = F.col("event_id"), F.col("event_type")
    item = F.to_json(F.struct((n % 1000).cast("string").alias("id"), F.concat(F.lit("c"), n.cast("string")).alias("context"), kind.alias("category")))
    reply = F.when(n % 8 == 0, F.lit("{broken")).when(n % 4 == 0, F.lit('{"chunks":[{"id":"none"}]}')).otherwise(F.concat(F.lit('{"chunks":['), item, F.lit("]}")))
    parsed = table(spark, sf_dir, "events").select("event_id", F.explode(parse_enrichment(reply)).alias("c"))
    return parsed.select("event_id", F.col("c.id").cast("long").alias("id"), "c.context", "c.category")


@query(f"WITH {SCORES_SQL} SELECT round(avg(rr), 9) AS accuracy, round(avg(1 + q_id % 3), 9) AS mean_iterations FROM (SELECT q_id, CASE WHEN rr = 1 THEN 1.0 ELSE 0.0 END AS rr FROM scores)")
def citation_accuracy(spark, sf_dir):
    """A5: a question's first hit stands for its citation."""
    scores = _scores(spark, sf_dir)
    cited = scores.where("rr = 1").select("q_id", F.lit("d").alias("document_id"), F.lit(1).alias("page_number"))
    gold = scores.select("q_id", F.lit("d").alias("document_id"), F.lit(1).alias("page_number"))
    return E.citation_accuracy(cited, gold, scores.select("q_id", (1 + F.col("q_id") % 3).alias("iterations")))


@query("SELECT conv_id, '[' || (turn + 1) || '] (' || role || ' | page ' || turn || ') ' || text AS line, turn FROM conversations")
def prompt_lines(spark, sf_dir):
    """F22."""
    t = F.col("turn")
    return table(spark, sf_dir, "conversations").select("conv_id", C.prompt_line(t + 1, F.col("role"), F.lit(""), t, F.col("text")).alias("line"), "turn")


@query("SELECT page_id, (length(html) / 3.0::DOUBLE) < 100 AS scanned FROM pages")
def scanned_pages(spark, sf_dir):
    """Every page as a document of three."""
    return table(spark, sf_dir, "pages").select("page_id", is_scanned(F.length("html"), F.lit(3)).alias("scanned"))


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def pricing_summary(spark, sf_dir):
    """A generic aggregation; the reference has none like it."""
    rows = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))
