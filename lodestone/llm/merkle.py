"""Merkle manifest of a dataset: exact ranks by digit histograms, and a trie of ranks that is reduced by prefixes.

Rows are ranked within their group by an order-preserving key in hex digits. Histograms count the rows of each prefix,
some digits longer at a time until no prefix has more rows than a task should sort; sums over the digits of one prefix give
where the rows of each longer one begin. Nothing is sorted as a whole.

The digits of a rank to the base of the fanout key the nodes of the trie. Nodes that share all but their last digits are
one block, which a task reduces through as many levels; a block's root is the node of the shorter prefix. So there
is a round for each ``BLOCK_NODES``-th part of the nodes, not for each level. Down again, each block gets the siblings on its
path to the root, and each row its own.
"""

from __future__ import annotations

import hashlib
import os.path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.shared import discard, materialize

FANOUT = 2
#: Hex digits by which a prefix grows: a sum over prefixes has no more than 16 ** DIGITS rows. Rows of a prefix that a task sorts. Nodes of a block.
DIGITS, BUCKET_ROWS, BLOCK_NODES = 3, 16_384, 4_096
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<at: int, others: array<string>>>"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# -- Ranks ------------------------------------------------------------------------------------------------------------


def id_digits(doc_id: Column) -> Column:
    """A long as 17 hex digits that sort as it does, null first."""
    return F.when(doc_id.isNull(), F.lit("0" * 17)).otherwise(F.concat(F.lit("1"), F.lpad(F.hex(doc_id.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")))


def field(value: Column) -> Column:
    """A value as it is hashed: its UTF-8 bytes after their count and a colon, a dash for null. Different values differ here."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def ranked(rows: DataFrame, group: str, key: str, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``rows`` with ``rank``, their place from 0 in their group by ``key``, a string of hex digits, and ``n``, the group's rows.

    Prefixes grow until none has more than ``bucket_rows`` rows of a group, or keys end: equal keys are ranked by one
    task, so a caller ends them with digits that part rows. Groups and keys are not null. ``rows`` is read several times
    and has to be a written table.
    """
    low, high, longest = rows.agg(F.min(key), F.max(key), F.coalesce(F.max(F.length(key)), F.lit(0))).first()
    start = len(os.path.commonprefix([low or "", high or ""]))  # what all keys share tells nothing
    prefix = lambda name, k: F.substring(name, 1, k)
    most = lambda k: rows.groupBy(group, prefix(key, k)).count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    lengths = [start + DIGITS]
    while lengths[-1] < longest and most(lengths[-1]) > bucket_rows:
        lengths.append(lengths[-1] + DIGITS)
    finest = materialize(rows.groupBy(group, prefix(key, lengths[-1]).alias("prefix")).agg(F.count("*").alias("rows")), "prefix-histogram")
    histograms = {lengths[-1]: finest}
    for k, longer in zip(lengths[-2::-1], lengths[:0:-1], strict=True):
        histograms[k] = histograms[longer].groupBy(group, prefix("prefix", k).alias("prefix")).agg(F.sum("rows").alias("rows"))
    counts = histograms[lengths[0]].groupBy(group).agg(F.sum("rows").alias("n"))
    bases = counts.select(group, "n", F.lit((low or "")[:start]).alias("above"), F.lit(0).cast("long").alias("base"))
    before = F.coalesce(F.sum("rows").over(Window.partitionBy(group, "above").orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    for shorter, k in zip([start, *lengths], lengths, strict=False):
        sums = histograms[k].withColumn("above", prefix("prefix", shorter)).withColumn("before", before)
        bases = sums.join(bases, [group, "above"]).select(group, "n", F.col("prefix").alias("above"), (F.col("base") + F.col("before")).alias("base"))
    bases = materialize(bases, "prefix-bases")
    place = F.row_number().over(Window.partitionBy(group, "above").orderBy(key))
    placed = rows.withColumn("above", prefix(key, lengths[-1])).withColumn("place", place).join(bases, [group, "above"])
    out = materialize(placed.withColumn("rank", F.col("base") + F.col("place") - 1).drop("above", "place", "base", key), "ranked")
    discard(finest, bases)
    return out


# -- The trie ---------------------------------------------------------------------------------------------------------


def depth_of(fanout: int, block_nodes: int = BLOCK_NODES) -> int:
    """Levels of a block: as many as keep it within ``block_nodes`` nodes, one at least."""
    depth = 1
    while fanout ** (depth + 1) <= block_nodes:
        depth += 1
    return depth


def levels(digests: list[str], n: int, fanout: int, depth: int) -> list[list[str]]:
    """A block's nodes, level by level; ``n`` nodes of the group are in its first level, and one node goes up no further."""
    out = [digests]
    while len(out) <= depth and n > 1:
        out.append([digest("".join(out[-1][at : at + fanout])) for at in range(0, len(out[-1]), fanout)])
        n = -(-n // fanout)
    return out


def siblings(block: list[list[str]], at: int, fanout: int) -> list[dict]:
    """For each level of a block, the place of the node at ``at`` or above it in its run, and the others of the run."""
    out = []
    for level in block[:-1]:
        first = at - at % fanout
        run = level[first : first + fanout]
        out.append({"at": at - first, "others": run[: at - first] + run[at - first + 1 :]})
        at //= fanout
    return out


def folded(leaf: str, path: list[dict]) -> str:
    for step in path:
        run = list(step["others"])
        run.insert(step["at"], leaf)
        leaf = digest("".join(run))
    return leaf


def proof(path: list[dict]) -> str:
    """The hash of all siblings, level by level, left to right."""
    return digest("".join(d for step in path for d in step["others"]))


NODES = "grp string, rank long, n long, node string"
PATHS = f"grp string, rank long, path {PATH}"
PATH_TYPE = pa.list_(pa.struct([("at", pa.int32()), ("others", pa.list_(pa.string()))]))


def climb(leaves: DataFrame, fanout: int, depth: int) -> list[DataFrame]:
    """Tables of nodes ``NODES``: the given ones, then the roots of their blocks, and so on to one root a group."""
    span = fanout**depth

    def reduce(key: tuple, block: pa.Table) -> pa.Table:
        block = block.sort_by("rank")
        n = block["n"][0].as_py()
        top = levels(block["node"].to_pylist(), n, fanout, depth)
        return pa.table({"grp": pa.array([key[0].as_py()], pa.string()), "rank": pa.array([key[1].as_py()], pa.int64()), "n": pa.array([-(-n // span)], pa.int64()), "node": pa.array([top[-1][0]], pa.string())})

    tables = [leaves]
    while True:
        blocks = tables[-1].select("grp", "rank", "n", "node").groupBy("grp", F.floor(F.col("rank") / span).alias("block"))
        tables.append(materialize(blocks.applyInArrow(reduce, NODES), "trie-nodes"))
        if (tables[-1].agg(F.max("n")).first()[0] or 0) <= 1:
            return tables


def _blocks(nodes: DataFrame, above: DataFrame, span: int):
    """Each block of ``nodes`` beside the row of its root in ``above``."""
    return nodes.groupBy("grp", F.floor(F.col("rank") / span).alias("block")).cogroup(above.groupBy("grp", "rank"))


def descend(tables: list[DataFrame], paths: DataFrame, fanout: int, depth: int, upto: int) -> DataFrame:
    """``PATHS`` of the nodes in ``tables[upto]``, from ``paths``, those of the groups' roots."""

    def extend(nodes: pa.Table, above: pa.Table) -> pa.Table:
        nodes = nodes.sort_by("rank")
        block = levels(nodes["node"].to_pylist(), nodes["n"][0].as_py(), fanout, depth)
        rest = above["path"][0].as_py()
        each = [siblings(block, at, fanout) + rest for at in range(nodes.num_rows)]
        return pa.table({"grp": nodes["grp"].cast(pa.string()), "rank": nodes["rank"], "path": pa.array(each, PATH_TYPE)})

    for nodes in tables[len(tables) - 2 : upto - 1 if upto else None : -1]:
        paths = materialize(_blocks(nodes.select("grp", "rank", "n", "node"), paths, fanout**depth).applyInArrow(extend, PATHS), "trie-paths")
    return paths


# -- The manifest -----------------------------------------------------------------------------------------------------

RESULT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _leaves(docs: DataFrame) -> DataFrame:
    types = {"doc_id": "long", "n_chars": "long"}
    typed = docs.select(*(F.col(c).cast(types.get(c, "string")).alias(c) for c in FIELDS))
    leaf = lambda n_chars: F.sha2(F.concat(*(field(n_chars if c == "n_chars" else F.col(c)) for c in FIELDS)), 256)
    wrong = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, leaf(F.col("n_chars").cast("decimal(20,0)") + 1))
    row = F.lpad(F.hex(F.xxhash64(F.monotonically_increasing_id())), 16, "0")  # parts rows that are equal in all; written once, so that it stays
    out = typed.select(field(F.col("lang")).alias("grp"), "lang", "doc_id", leaf(F.col("n_chars")).alias("node"), wrong.alias("tampered"), row.alias("row"))
    return out.select("grp", "lang", "doc_id", "node", "tampered", F.concat(id_digits(F.col("doc_id")), "node", "row").alias("key"))


def merkle_manifest(docs: DataFrame, fanout: int = FANOUT, bucket_rows: int = BUCKET_ROWS, block_nodes: int = BLOCK_NODES) -> DataFrame:
    """Leaf, subroot, root and proof of each of ``docs(doc_id, source, lang, n_chars, text)``: ``RESULT``.

    Leaves ascend by doc_id in their lang, nulls first, equal ids by leaf; each row is a leaf, repeated rows too. A null
    is hashed as a dash, unlike an empty text; null langs are one group, which comes first. Rows that are tampered with
    are those whose id's crc32 7 divides; a null id is none of them, and a null n_chars stays. An empty table gives no
    rows; other columns are ignored.
    """
    spark = docs.sparkSession
    depth = depth_of(fanout, block_nodes)
    rows = materialize(_leaves(docs), "leaves")
    leaves = ranked(rows, "grp", "key", bucket_rows)
    tables = climb(leaves, fanout, depth)
    langs = rows.groupBy("grp").agg(F.first("lang").alias("lang"))
    named = F.when(F.col("lang").isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.hex(F.encode("lang", "UTF-8"))))
    subroots = materialize(tables[-1].join(langs, "grp").select(F.lit("").alias("grp"), F.col("grp").alias("lang_grp"), "node", named.alias("key")), "subroots")
    order = ranked(subroots, "grp", "key", bucket_rows)
    above = climb(order, fanout, depth)
    root = above[-1].first()
    if root is None:
        return spark.createDataFrame([], RESULT)
    root = root["node"]
    top = spark.createDataFrame([("", 0, [])], PATHS)
    of_langs = descend(above, top, fanout, depth, 0).join(order.select("rank", "lang_grp", F.col("node").alias("subroot")), "rank")
    of_langs = materialize(of_langs.select(F.col("lang_grp").alias("grp"), F.lit(0).cast("long").alias("rank"), "path", "subroot"), "lang-paths")
    paths = descend(tables, of_langs.select("grp", "rank", "path"), fanout, depth, 1).join(of_langs.select("grp", "subroot"), "grp")

    def verify(nodes: pa.Table, over: pa.Table) -> pa.Table:
        nodes = nodes.sort_by("rank")
        block = levels(nodes["node"].to_pylist(), nodes["n"][0].as_py(), fanout, depth)
        rest, subroot, n = over["path"][0].as_py(), over["subroot"][0].as_py(), nodes.num_rows
        each = [siblings(block, at, fanout) + rest for at in range(n)]
        back = [folded(wrong or leaf, path) for leaf, wrong, path in zip(block[0], nodes["tampered"].to_pylist(), each, strict=True)]
        return pa.table({"doc_id": nodes["doc_id"], "leaf": pa.array(block[0], pa.string()), "subroot": pa.array([subroot] * n, pa.string()), "root": pa.array([root] * n, pa.string()), "proof_sha256": pa.array(list(map(proof, each)), pa.string()), "folded_root": pa.array(back, pa.string()), "verified": pa.array([b == root for b in back], pa.bool_())})

    return _blocks(leaves.select("grp", "rank", "n", "doc_id", "node", "tampered"), paths, fanout**depth).applyInArrow(verify, RESULT)


def _oracle() -> str:
    """Level by level; a row's path is one sibling, or none, for each level. The crc32 goes bit by bit over the id's digits."""
    f = lambda c: f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}, '-')"
    hashed = lambda n: f"sha256({' || '.join(f(n if c == 'n_chars' else c) for c in FIELDS)})"
    bit = "CASE WHEN i % 8 = 0 THEN xor(c, ascii(substr(doc_id::VARCHAR, (i // 8 + 1)::INT, 1))) ELSE c END"
    crc = f"xor(list_reduce(list_concat([4294967295::BIGINT], range(8 * length(doc_id::VARCHAR))), lambda c, i: xor(({bit}) >> 1, (({bit}) & 1) * 3988292384)), 4294967295)"
    return f"""WITH RECURSIVE l AS MATERIALIZED (SELECT doc_id, lang, {hashed("n_chars")} AS leaf, CASE WHEN {crc} % 7 = 0 THEN {hashed("(n_chars + 1)")} END AS tampered, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS r, count(*) OVER (PARTITION BY lang) AS n FROM documents),
up AS (SELECT lang, 0::BIGINT AS lvl, r AS idx, leaf AS h, n FROM l UNION ALL SELECT lang, lvl + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), (max(n) + 1) // 2 FROM up WHERE n > 1 GROUP BY lang, lvl, idx // 2),
sub AS MATERIALIZED (SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS r, count(*) OVER () AS n FROM up WHERE n = 1),
top AS (SELECT 0::BIGINT AS lvl, r AS idx, subroot AS h, n FROM sub UNION ALL SELECT lvl + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), (max(n) + 1) // 2 FROM top WHERE n > 1 GROUP BY lvl, idx // 2),
steps AS (SELECT l.doc_id, v.lvl, l.r >> v.lvl AS own, s.idx, s.h FROM l JOIN (SELECT DISTINCT lang, lvl FROM up WHERE n > 1) v ON v.lang IS NOT DISTINCT FROM l.lang LEFT JOIN up s ON s.lang IS NOT DISTINCT FROM l.lang AND s.lvl = v.lvl AND s.idx = xor(l.r >> v.lvl, 1)
  UNION ALL SELECT l.doc_id, 1000 + v.lvl, b.r >> v.lvl, s.idx, s.h FROM l JOIN sub b ON b.lang IS NOT DISTINCT FROM l.lang CROSS JOIN (SELECT DISTINCT lvl FROM top WHERE n > 1) v LEFT JOIN top s ON s.lvl = v.lvl AND s.idx = xor(b.r >> v.lvl, 1)),
numbered AS MATERIALIZED (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY lvl) AS k, CASE WHEN idx < own THEN h ELSE '' END AS before, CASE WHEN idx > own THEN h ELSE '' END AS after, lvl FROM steps),
fold AS (SELECT doc_id, 0::BIGINT AS k, coalesce(tampered, leaf) AS cur FROM l UNION ALL SELECT f.doc_id, f.k + 1, sha256(s.before || f.cur || s.after) FROM fold f JOIN numbered s ON s.doc_id = f.doc_id AND s.k = f.k + 1),
proofs AS (SELECT doc_id, sha256(string_agg(before || after, '' ORDER BY k)) AS proof FROM numbered GROUP BY doc_id)
SELECT l.doc_id, l.leaf, b.subroot, t.h AS root, coalesce(p.proof, sha256('')) AS proof_sha256, e.cur AS folded_root, e.cur = t.h AS verified
FROM l JOIN sub b ON b.lang IS NOT DISTINCT FROM l.lang JOIN (SELECT h FROM top WHERE n = 1) t ON true LEFT JOIN proofs p ON p.doc_id = l.doc_id JOIN (SELECT doc_id, arg_max(cur, k) AS cur FROM fold GROUP BY doc_id) e ON e.doc_id = l.doc_id"""


ORACLE = _oracle()
