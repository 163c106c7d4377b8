"""Registered queries of single operators: what callers see, guards, typography, text and evaluation helpers."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions.outline import ENUMERATED, line_of, without_markup
from lodestone.functions.titles import title
from lodestone.functions.vectors import normalized, rounded
from lodestone.operators import evaluation as E
from lodestone.operators import state as S
from lodestone.operators import typography as Y
from lodestone.operators import views as V
from lodestone.operators.chunking import estimated_tokens
from lodestone.plans import read_path as R
from lodestone.plans import write_path as W
from lodestone.queries import CHUNKS_SQL, _chunks, query, table


def _named(spark, sf_dir):
    """Orders as documents: finished ones have a time of completion."""
    done = F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("document_id"), done.alias("completed_at"), F.when(F.col("o_orderstatus") == "F", "COMPLETED").when(F.col("o_orderstatus") == "O", "QUEUED").otherwise("RETRYING").alias("status"))


@query("SELECT o_orderkey AS document_id FROM orders WHERE o_orderstatus = 'F'")
def finished_documents(spark, sf_dir):
    """Ids of finished documents."""
    return V.finished_ids(_named(spark, sf_dir))


@query("SELECT o_orderkey AS document_id, o_orderstatus = 'F' AS may_reopen FROM orders")
def reopen_guard(spark, sf_dir):
    """A document is taken up again only when it is at rest."""
    return _named(spark, sf_dir).select("document_id", S.may_reopen(F.col("status")).alias("may_reopen"))


@query("SELECT l_orderkey AS document_id, l_linenumber FROM lineitem SEMI JOIN (SELECT * FROM orders WHERE o_orderstatus = 'F') ON l_orderkey = o_orderkey")
def rows_of_live_documents(spark, sf_dir):
    """What belongs to a document that was deleted meanwhile is left out."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_id"), "l_linenumber")
    return V.live_only(rows, V.finished_ids(_named(spark, sf_dir)))


@query("""SELECT user_id AS q_id, event_id AS ordinal, CASE WHEN event_id % 2 = 0 THEN 'document' ELSE 'web' END AS kind,
  CASE WHEN event_id % 2 = 0 THEN 'd' || event_id END AS document_id, CASE WHEN event_id % 2 = 0 THEN 'f' END AS filename, CASE WHEN event_id % 2 = 0 THEN event_id % 9 END AS page_number,
  CASE WHEN event_id % 2 = 0 THEN event_type END AS quote, CASE WHEN event_id % 2 = 1 THEN 'u' || event_id END AS url, CASE WHEN event_id % 2 = 1 THEN event_type END AS title FROM events""")
def citation_rows(spark, sf_dir):
    """P10: citations of documents and of the web as rows of one shape."""
    events = table(spark, sf_dir, "events")
    document = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("d"), F.col("event_id").cast("string")))
    cited = events.select(F.col("user_id").alias("q_id"), F.col("event_id").alias("ordinal"), document.alias("document_id"), F.lit("f").alias("filename"), (F.col("event_id") % 9).alias("page_number"), F.col("event_type").alias("quote"), F.concat(F.lit("u"), F.col("event_id").cast("string")).alias("url"), F.col("event_type").alias("title"))
    return V.flatten_citations(cited)


@query("SELECT label::BIGINT AS q_id, 'vector' AS source, vec_id % 7 AS rank, round(embedding[1]::DOUBLE, 4) AS score, vec_id AS child_id FROM embeddings")
def candidate_views(spark, sf_dir):
    """Candidates as a trace shows them."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("q_id"), F.lit("vector").alias("source"), (F.col("vec_id") % 7).alias("rank"), F.col("embedding")[0].cast("double").alias("score"), F.col("vec_id").alias("child_id"))
    return V.candidate_view(rows).select("q_id", "candidate.*")


@query(f"""WITH {CHUNKS_SQL}, per_document AS (SELECT d.doc_id, count(c.doc_id) AS n FROM documents d LEFT JOIN chunks c USING (doc_id) GROUP BY d.doc_id)
SELECT doc_id AS document_id, CASE WHEN n = 0 THEN 'NO_EXTRACTABLE_TEXT' ELSE 'TOO_MANY_CHUNKS' END AS error_code FROM per_document WHERE n = 0 OR n > 10""")
def refused_documents(spark, sf_dir):
    """Documents without text, and those of more than ten chunks."""
    children = _chunks(spark, sf_dir).withColumnRenamed("doc_id", "document_id")
    return W.refused(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id")), children, most=10)


@query("SELECT doc_id FROM documents WHERE lang = 'fr'")
def language_filter(spark, sf_dir):
    """Candidates of one language."""
    return table(spark, sf_dir, "documents").withColumnRenamed("lang", "language").where(R.in_language("fr")).select("doc_id")


def _spans(spark, sf_dir):
    """A customer's orders as lines of a page, set in a size by their priority."""
    lines, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    return lines.select(F.col("o_custkey").alias("document_id"), F.lit(1).alias("page"), key.alias("line"), F.lit(0).alias("block"), F.repeat(F.lit("x"), (key % 50 + 1).cast("int")).alias("text"), F.left("o_orderpriority", F.lit(1)).cast("double").alias("size"), (F.col("o_orderstatus") == "F").alias("bold"))


SPANS_SQL = "spans AS (SELECT o_custkey AS document_id, o_orderkey AS line, repeat('x', o_orderkey % 50 + 1) AS text, left(o_orderpriority, 1)::DOUBLE AS size, o_orderstatus = 'F' AS bold FROM orders)"


@query(f"""WITH {SPANS_SQL}, weighed AS (SELECT document_id, size, sum(length(text)) AS chars, min(line) AS first FROM spans GROUP BY ALL)
SELECT document_id, size AS body_size FROM weighed QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY chars DESC, first) = 1""")
def body_sizes(spark, sf_dir):
    """A10: the size most characters of a document are set in."""
    return Y.body_size(_spans(spark, sf_dir))


@query(f"""WITH {SPANS_SQL}, marked AS (SELECT *, CASE WHEN lag(size) OVER w = size AND lag(bold) OVER w = bold THEN 0 ELSE 1 END AS new FROM spans WINDOW w AS (PARTITION BY document_id ORDER BY line)),
numbered AS (SELECT *, sum(new) OVER (PARTITION BY document_id ORDER BY line) AS grp FROM marked)
SELECT document_id, grp::BIGINT AS grp, size, bold, string_agg(text, ' ' ORDER BY line) AS text FROM numbered GROUP BY document_id, grp, size, bold""")
def style_runs(spark, sf_dir):
    """Neighbouring lines in one style as one."""
    return Y.style_groups(_spans(spark, sf_dir)).select("document_id", F.col("group").cast("long").alias("grp"), "size", "bold", F.array_join("lines", " ").alias("text"))


@query("SELECT o_orderkey AS document_id, 'ENRICHING' AS stage, count(l_orderkey) FILTER (l_returnflag = 'R') AS done, count(l_orderkey) AS total FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def stage_counts(spark, sf_dir):
    """How much of a stage is done."""
    chunks = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "document_id")
    return S.stage_counts(chunks, chunks.where("l_returnflag = 'R'"), "ENRICHING")


@query("""WITH last AS (SELECT user_id AS document_id, event_type AS stage, event_id % 10 AS done, 8 AS total, event_id::DOUBLE AS "at" FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1)
SELECT document_id, stage, least(done, total) AS done, total::BIGINT AS total, "at" FROM last
UNION ALL SELECT n_nationkey, 'PARSING', 1, 1, 0.0 FROM nation WHERE n_nationkey NOT IN (SELECT document_id FROM last)""")
def progress_reports(spark, sf_dir):
    """The last report of each document counts."""
    held = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("document_id"), F.lit("PARSING").alias("stage"), F.lit(1).cast("long").alias("done"), F.lit(1).cast("long").alias("total"), F.lit(0.0).alias("at"))
    new = table(spark, sf_dir, "events").select(F.col("user_id").alias("document_id"), F.col("event_type").alias("stage"), (F.col("event_id") % 10).alias("done"), F.lit(8).cast("long").alias("total"), F.col("event_id").cast("double").alias("at"))
    return S.report_progress(held, new)


@query("SELECT n_nationkey::BIGINT AS document_id FROM nation WHERE n_nationkey NOT IN (SELECT user_id FROM events)")
def progress_cleared(spark, sf_dir):
    """What has ended is no longer shown."""
    held = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("document_id"))
    return S.clear_progress(held, table(spark, sf_dir, "events").select(F.col("user_id").alias("document_id")))


@query("SELECT l_orderkey, sum(CASE WHEN l_quantity > 40 THEN 150 ELSE l_quantity END)::BIGINT AS tokens FROM lineitem GROUP BY l_orderkey")
def token_estimate(spark, sf_dir):
    """Chunks of unknown size count 150 tokens."""
    known = F.when(F.col("l_quantity") <= 40, F.col("l_quantity").cast("int"))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(estimated_tokens(known).alias("tokens"))


@query("SELECT page_id, url_encode(url || ' a+b') AS encoded FROM pages")
def encoded_urls(spark, sf_dir):
    """percent-encoding."""
    return table(spark, sf_dir, "pages").select("page_id", T.url_encode(F.concat("url", F.lit(" a+b"))).alias("encoded"))


@query("SELECT doc_id, CASE WHEN n_chars < 1024 THEN n_chars || ' B' WHEN n_chars < 1048576 THEN format('{:.1f} KB', n_chars / 1024) ELSE format('{:.1f} MB', n_chars / 1048576) END AS shown FROM documents")
def shown_sizes(spark, sf_dir):
    """bytes as people read them."""
    return table(spark, sf_dir, "documents").select("doc_id", T.format_bytes(F.col("n_chars")).alias("shown"))


@query(r"""SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace('## **' || text || '** <br> _x_', '^#{1,6}\s*', ''), '<[^>]+>', ' ', 'g'), '^[ *_\t]+|[ *_\t]+$', '', 'g') AS plain FROM conversations""")
def plain_lines(spark, sf_dir):
    """F16: a line of markdown as text."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.plain_line(F.concat(F.lit("## **"), "text", F.lit("** <br> _x_"))).alias("plain"))


@query("SELECT p_partkey, upper(left(p_type, 1)) || lower(substr(p_type, 2)) AS shown FROM part")
def sentence_cases(spark, sf_dir):
    """sentence case."""
    return table(spark, sf_dir, "part").select("p_partkey", T.sentence_case(F.col("p_type")).alias("shown"))


@query(r"""SELECT p_partkey, trim(regexp_replace(p_name || ' ' || p_brand, '[\s*]+', ' ', 'g')) AS cleaned, 3 AS level, false AS bold FROM part""")
def heading_marks(spark, sf_dir):
    """what a heading says, its level, and whether it is set in bold only."""
    marked = F.concat(F.lit("### **"), "p_name", F.lit("** *"), "p_brand", F.lit("*  "))
    line = line_of(marked)
    return table(spark, sf_dir, "part").select("p_partkey", without_markup(marked).alias("cleaned"), line["level"].alias("level"), line["bold"].alias("bold"))


@query("""SELECT l_orderkey, l_linenumber, 'article' AS kind, l_linenumber::VARCHAR AS number, '.' AS after, 'Article ' || l_linenumber || '. ' || l_returnflag AS title, false AS bare FROM lineitem""")
def numbered_headings(spark, sf_dir):
    """kind, number and title of a numbered heading."""
    line = line_of(F.concat(F.lit("# Article "), F.col("l_linenumber").cast("string"), F.lit(". "), "l_returnflag"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *(line[c].alias(c) for c in ("kind", "number", "after", "title", "bare")))


@query("SELECT conv_id, turn, turn::VARCHAR AS item, ')' AS mark FROM conversations")
def list_items(spark, sf_dir):
    """F8: items of numbered lists."""
    text = F.concat(F.col("turn").cast("string"), F.lit(") "), "text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.regexp_extract(text, ENUMERATED, 1).alias("item"), F.regexp_extract(text, ENUMERATED, 2).alias("mark"))


@query("SELECT vec_id, list_transform(embedding, lambda x: round(x::DOUBLE * 3 / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]) * 9), 6)) AS unit FROM embeddings")
def question_vectors(spark, sf_dir):
    """M6: a question's vector brought to length one."""
    scaled = F.transform("embedding", lambda x: x.cast("double") * 3)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform(normalized(scaled), lambda x: rounded(x, 6)).alias("unit"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name WHEN p_partkey % 3 = 1 THEN 'H ' || p_brand ELSE left(p_type, 200) END AS title FROM part")
def title_choice(spark, sf_dir):
    """metadata that is a title, else a level-one heading, else the first line."""
    kind = F.col("p_partkey") % 3
    metadata = F.when(kind == 0, F.col("p_name")).when(kind == 1, "scan0001").otherwise("(anonymous)")
    page = F.when(kind == 1, F.concat(F.lit("text\n# H "), "p_brand")).otherwise(F.concat(F.lit("\n  ## "), "p_type", F.lit("\nmore")))
    rows = table(spark, sf_dir, "part").select("p_partkey", metadata.alias("metadata"), F.array(page).alias("pages"), F.lit("file.pdf").alias("filename"))
    return rows.select("p_partkey", title("metadata", "pages", "filename").alias("title"))


@query("""SELECT l_orderkey AS q_id, o_orderpriority AS kind, l_linenumber::BIGINT AS rank, coalesce(p_brand = 'Brand#' || (10 + o_orderkey % 50) AND l_suppkey % 3 = 1, false) AS match
FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey""")
def gold_matches(spark, sf_dir):
    """Hits by document to the file their question asks for."""
    hits = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("q_id"), F.col("l_linenumber").cast("long").alias("rank"), F.col("l_partkey").alias("document_id"), (F.col("l_suppkey") % 3).alias("page_number"))
    gold = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("q_id"), F.col("o_orderpriority").alias("kind"), F.concat(F.lit("Brand#"), (10 + F.col("o_orderkey") % 50).cast("string")).alias("gold_sha256"), F.lit(1).alias("gold_page"))
    return E.matched(hits, gold, table(spark, sf_dir, "part").select(F.col("p_partkey").alias("document_id"), F.col("p_brand").alias("sha256")))
