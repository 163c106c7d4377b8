"""Registered queries of the plans and tables that keep state: the stage chain, the positional index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions.language import STOP_WORDS, detect_language
from lodestone.functions.language_model import LanguageModel
from lodestone.functions.tokens import bpe_counter, placed_packer, token_packer
from lodestone.operators.chunking import CHILD, DROP_BELOW, kept_counted
from lodestone.operators.feedback import feedback_terms, rewritten, score_spread
from lodestone.operators.keyword import Corpus, keyword_bm25, terms
from lodestone.operators.knn import knn_batch
from lodestone.operators.rectangles import rectangles
from lodestone.operators.text_index import TextIndex
from lodestone.operators.vector_index import MAX_CELLS, VectorIndex, recall
from lodestone.plans.chain import Chain, Stage
from lodestone.queries import BATCH_SQL, BM25_SQL, CHUNKS_SQL, TOP10, _asked, _chunks, pieces_sql, query, table
from lodestone.sources.scratch import fresh, written
from lodestone.sources.tables import spread

# -- The stage chain --------------------------------------------------------------------------------------------------


@query(f"""WITH {CHUNKS_SQL}, made AS (SELECT doc_id, chunk_index, length(content)::BIGINT AS size, CASE WHEN chunk_index < 2 THEN 1 ELSE 2 END AS run FROM chunks),
sums AS (SELECT doc_id, count(*) AS n, sum(size)::BIGINT AS total FROM made GROUP BY doc_id)
SELECT doc_id::VARCHAR AS document_id, chunk_index, size, run, n, total FROM made JOIN sums USING (doc_id)""")
def chain_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain whose second stage answers two chunks a document at first, and the rest, no chunk twice, when it is run again."""
    most = {"chunks": 2}

    def answer(t: dict[str, DataFrame]) -> DataFrame:
        return t["chunks"].where(F.col("chunk_index") < most["chunks"]).select("document_id", "chunk_index", F.length("content").cast("long").alias("size"))

    def chunks(t: dict[str, DataFrame]) -> DataFrame:
        return _chunks(spark, sf_dir).withColumn("document_id", F.col("doc_id").cast("string")).join(t["documents"].select("document_id"), "document_id", "left_semi")

    def sums(t: dict[str, DataFrame]) -> DataFrame:
        return t["answers"].groupBy("document_id").agg(F.count("*").alias("n"), F.sum("size").alias("total"))

    chain = Chain(spark, fresh(spark, "chain"), [
        Stage("chunks", chunks, "document_id string, chunk_index long, content string"),
        Stage("answers", answer, "document_id string, chunk_index long, size long", ("chunks",), ("chunk_index",)),
        Stage("sums", sums, "document_id string, n long, total long", ("answers",)),
    ])
    documents = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("document_id"), F.sha2("text", 256).alias("content_fp"))
    chain.advance(documents)
    most["chunks"] = 1 << 30
    chain.advance(documents)
    made = chain.rows("answers").select("document_id", "chunk_index", "size", "run")
    return made.join(chain.rows("sums").select("document_id", "n", "total"), "document_id")


# -- The positional index ---------------------------------------------------------------------------------------------

WORDS_SQL = r"""split AS (SELECT doc_id, lang, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda t: t <> '') AS w FROM documents)"""
COVER_SQL = """words AS (SELECT doc_id, unnest(w) AS term, unnest(range(len(w))) AS pos FROM split),
asked AS (SELECT DISTINCT doc_id AS q_id, unnest([w[4], w[5], w[8]]) AS term FROM split WHERE doc_id % 50 = 0 AND len(w) >= 8),
occ AS (SELECT q_id, doc_id, term, pos, row_number() OVER (PARTITION BY q_id, doc_id ORDER BY pos) AS nth FROM words JOIN asked USING (term)),
whole AS (SELECT q_id, doc_id FROM occ GROUP BY q_id, doc_id HAVING count(DISTINCT term) = (SELECT count(*) FROM asked a WHERE a.q_id = occ.q_id)),
lasts AS (SELECT o.q_id, o.doc_id, o.pos, o.nth, x.term, max(x.pos) AS p, max(x.nth) AS p_nth FROM occ o JOIN whole USING (q_id, doc_id) JOIN occ x ON x.q_id = o.q_id AND x.doc_id = o.doc_id AND x.pos <= o.pos GROUP BY ALL),
ends AS (SELECT q_id, doc_id, pos, nth, min(p) AS p, min(p_nth) AS p_nth FROM lasts GROUP BY q_id, doc_id, pos, nth HAVING count(*) = (SELECT count(*) FROM asked a WHERE a.q_id = lasts.q_id)),
covers AS (SELECT q_id, doc_id, p, p_nth, min(pos) AS pos, min(nth) AS nth FROM ends GROUP BY q_id, doc_id, p, p_nth),
scored AS (SELECT q_id, doc_id, round(sum(0.1::DOUBLE / (1 + (pos - p) - (nth - p_nth))), 6) AS score FROM covers GROUP BY q_id, doc_id)
SELECT q_id, doc_id, score, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, doc_id) AS rank FROM scored QUALIFY rank <= 50"""


def _quoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three words of every 50th document as a question: two that stand together, and one further on."""
    w = terms(F.col("text"))
    rows = table(spark, sf_dir, "documents").where("doc_id % 50 = 0").select(F.col("doc_id").alias("q_id"), w.alias("w")).where(F.size("w") >= 8)
    return rows.select("q_id", F.concat_ws(" ", F.get("w", F.lit(3)), F.get("w", F.lit(4)), F.get("w", F.lit(7))).alias("text"))


@query(f"WITH {WORDS_SQL}, {COVER_SQL}")
def keyword_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All terms, by cover density, from an index of plain words."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.lit(None).cast("string").alias("language"))
    return TextIndex.build(docs, fresh(spark, "text-index")).search(_quoted(spark, sf_dir)).select("q_id", "doc_id", "score", "rank")


@query()
def keyword_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same under each document's own configuration: English ones by stems, others by words. The stems have no SQL; tests hold them and the search against brute force."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("lang").alias("language"))
    return TextIndex.build(docs, fresh(spark, "text-index")).search(_quoted(spark, sf_dir)).select("q_id", "doc_id", "score", "rank")


# -- The vector index -------------------------------------------------------------------------------------------------

RECALL = 0.95


def _every_50th(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    corpus = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return corpus, corpus.where("vec_id % 50 = 0").select(F.col("vec_id").alias("q_id"), "embedding")


@query(BATCH_SQL)
def knn_index_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J1 from the index, all cells probed: the exact way."""
    corpus, questions = _every_50th(spark, sf_dir)
    index = VectorIndex.build(corpus, fresh(spark, "vector-index"))
    return index.search(questions, 10, MAX_CELLS).select("q_id", "vec_id", "score", "rank")


@query()
def knn_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J1 from the index, as many cells as the wanted recall takes; which neighbours are missed has no SQL. ``hits`` of ``wanted`` are found."""
    corpus, questions = _every_50th(spark, sf_dir)
    index = VectorIndex.build(corpus, fresh(spark, "vector-index"))
    found = index.search(questions, 10, index.probes_for(questions, RECALL))
    return found.join(recall(found, knn_batch(questions, corpus, 10)), "q_id").select("q_id", "vec_id", "score", "rank", "hits", "wanted")


# -- Tokens -----------------------------------------------------------------------------------------------------------

#: A file of the installed public tokenizers; a parameter of the functions.
TOKENIZER = "byte_bpe_50k.json"


@query()
def chunk_pack_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Child-sized pieces of every document, in BPE tokens. A tokenizer has no SQL; tests hold the pieces against packing word by word."""
    import public_tokenizers

    packing = token_packer(bpe_counter(public_tokenizers.path(TOKENIZER)))
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    rows = docs.select("doc_id", F.posexplode(kept_counted(packing(F.col("text"), *CHILD))).alias("chunk_index", "piece"))
    return rows.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.col("piece.token_count").cast("long").alias("token_count"), "piece.content")


# -- Language ---------------------------------------------------------------------------------------------------------


@query()
def language_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the language of every document by a trigram model that learned from four fifths of them, beside that by function words. A model has no SQL; tests hold its accuracy on the last fifth."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = LanguageModel.learn(docs.where(~held_out))
    return spread(docs).select("doc_id", "lang", held_out.alias("held_out"), model.detect(F.col("text")).alias("by_trigrams"), detect_language(F.col("text"), tuple(STOP_WORDS)).alias("by_words"))


# -- Rectangles -------------------------------------------------------------------------------------------------------


@query(f"""WITH {pieces_sql("documents", "text", "doc_id", 100, 200)},
split AS (SELECT doc_id, text, regexp_extract_all(text, '\\S+') AS w, regexp_extract_all(text, '\\s+') AS g, CASE WHEN regexp_matches(text, '^\\s') THEN 1 ELSE 0 END AS first FROM documents),
each AS (SELECT doc_id, first, g, unnest(w) AS word, unnest(range(len(w))) AS i FROM split),
placed AS (SELECT doc_id, i, (coalesce(sum(length(word)) OVER before, 0) + sum(CASE WHEN i + first > 0 THEN length(g[i + first]) ELSE 0 END) OVER upto)::BIGINT AS start, length(word) AS n FROM each WINDOW before AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), upto AS (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING)),
numbered AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS chunk_index, (i * 200)::BIGINT AS first_word, (i * 200 + len(p) - 1)::BIGINT AS last_word FROM pieces WHERE len(p) >= 20),
chunks AS (SELECT c.doc_id, c.chunk_index, a.start, z.start + z.n AS stop FROM numbered c JOIN placed a ON a.doc_id = c.doc_id AND a.i = c.first_word JOIN placed z ON z.doc_id = c.doc_id AND z.i = c.last_word),
lines AS (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS k FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
spans AS (SELECT doc_id, k, length(line) AS n, (coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS start FROM lines)
SELECT doc_id::VARCHAR AS document_id, chunk_index, (k // 40)::INT AS page, (k // 10)::INT AS block, 0 AS x0, min(k % 40 * 12)::INT AS y0, max(6 * s.n)::INT AS x1, max(k % 40 * 12 + 10)::INT AS y1, count(*) AS spans
FROM chunks c JOIN spans s USING (doc_id) WHERE c.start < s.start + s.n AND s.start < c.stop GROUP BY ALL""")
def chunk_rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every chunk, where each line of a document is a span of a page of 40 lines and blocks of 10."""
    docs = spread(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("document_id"), "text"))
    pieces = F.filter(placed_packer()(F.col("text"), *CHILD), lambda p: p["token_count"] >= DROP_BELOW)
    chunks = docs.select("document_id", F.posexplode(pieces).alias("chunk_index", "piece")).select("document_id", F.col("chunk_index").cast("long").alias("chunk_index"), "piece.start", "piece.end")
    lines = F.transform(F.split("text", "\n", -1), lambda x, k: F.struct(F.length(x).alias("n"), k.alias("k")))
    upto = Window.partitionBy("document_id").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    placed = docs.select("document_id", F.inline(lines)).withColumn("start", F.coalesce(F.sum(F.col("n") + 1).over(upto), F.lit(0)))
    row = F.pmod("k", F.lit(40))
    spans = placed.select("document_id", F.floor(F.col("k") / 40).cast("int").alias("page"), F.floor(F.col("k") / 10).cast("int").alias("block"), "start", (F.col("start") + F.col("n")).alias("end"), F.lit(0).alias("x0"), (row * 12).alias("y0"), (F.col("n") * 6).alias("x1"), (row * 12 + 10).alias("y1"))
    return rectangles(chunks, spans)


# -- Feedback ---------------------------------------------------------------------------------------------------------

FEEDBACK_SQL = f"""{BM25_SQL}, hits AS ({TOP10}), first AS (SELECT q_id, doc_id, score / sum(score) OVER (PARTITION BY q_id) AS share FROM hits WHERE rank <= 5),
mass AS (SELECT q_id, term, sum(share * tf / doc_length) AS mass FROM first JOIN postings USING (doc_id) GROUP BY q_id, term),
weighed AS (SELECT m.q_id, m.term, round(mass * ln(1 + n / df), 6) AS weight FROM mass m JOIN df USING (term), corpus WHERE (m.q_id, m.term) NOT IN (SELECT (q_id, term) FROM asked))"""


def _first_search(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, int]:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    index = TextIndex.build(docs.withColumn("language", F.lit(None).cast("string")), fresh(spark, "text-index"))
    frequencies = index.vocabulary().groupBy("term").agg(F.sum("df").alias("df"))
    questions = _asked(spark, sf_dir)
    hits, _ = written(keyword_bm25(docs, questions), "first-hits")
    return docs, questions, hits, frequencies, docs.count()


@query(f"WITH {FEEDBACK_SQL} SELECT q_id, term, weight, row_number() OVER (PARTITION BY q_id ORDER BY weight DESC, term) AS nth FROM weighed QUALIFY nth <= 10")
def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D5, rewrite: what the first documents of each benchmark question add to it."""
    docs, questions, hits, frequencies, total = _first_search(spark, sf_dir)
    return feedback_terms(hits, docs, questions, frequencies, total).select("q_id", "term", "weight", "nth")


@query(f"WITH {BM25_SQL}, hits AS ({TOP10}) SELECT q_id, round(coalesce(stddev_pop(score) / abs(nullif(avg(score), 0)), 0), 6) AS spread, round(coalesce(stddev_pop(score) / abs(nullif(avg(score), 0)), 0), 6) >= 0.15 AS sufficient FROM hits GROUP BY q_id")
def score_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D5, gate: whether the scores of a question's hits differ enough to go on with them."""
    return score_spread(keyword_bm25(table(spark, sf_dir, "documents").select("doc_id", "text"), _asked(spark, sf_dir)))


@query()
def feedback_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every 50th document three words are asked; its place among the first ten by BM25, before and after feedback, null where it is not among them. SQL has the parts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    corpus = Corpus.of(docs)
    questions, _ = written(_quoted(spark, sf_dir), "questions")
    hits, _ = written(keyword_bm25(corpus, questions), "first-hits")
    asked, _ = written(rewritten(questions, feedback_terms(hits, docs, questions, corpus.frequencies, corpus.total)), "asked-again")
    again = keyword_bm25(corpus, asked)
    place = lambda rows, name: rows.where("q_id = doc_id").select("q_id", F.col("rank").alias(name))
    return questions.select("q_id").join(place(hits, "before"), "q_id", "left").join(place(again, "after"), "q_id", "left")
