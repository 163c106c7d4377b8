"""Centroid clusters, WARC archives and Merkle manifests against brute force and SQL."""

from __future__ import annotations

import gzip
import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest

from lodestone.llm import centroids, merkle, warc
from lodestone.llm.queries import ORACLE_SQL, QUERIES
from lodestone.llm.shared import fresh_path

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_centroid_clustering", "op12_warc", "op13_merkle_manifest"])
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = QUERIES[name](spark, SF)
    want = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(str, (tuple(r[c] for c in names) for r in got.collect()))) == sorted(map(str, want.fetchall()))


# -- Clusters ---------------------------------------------------------------------------------------------------------


def brute_clusters(rows, k, rounds, dim):
    kept = []
    for vec_id, v in rows:
        if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v):
            q = [int(np.floor(np.float64(x) * 1024)) for x in v]
            if all(abs(x) < 2**63 for x in q):
                kept.append((vec_id, q))
    named = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", np.array(r[1], "<i2").tobytes() if max(map(abs, r[1])) < 1 << 15 else np.array(r[1], "<i8").tobytes()))
    c = [q for _, q in named[:k]]
    near = lambda q: min((sum((a - b) ** 2 for a, b in zip(q, m, strict=True)), i) for i, m in enumerate(c))
    for _ in range(rounds):
        mine = [near(q)[1] for _, q in kept]
        c = [[sum(col) // len(col) for col in zip(*own, strict=True)] if (own := [q for (_, q), m in zip(kept, mine, strict=True) if m == i]) else c[i] for i in range(len(c))]
    return sorted((str(vec_id), near(q)[1], near(q)[0] if near(q)[0] < 2**63 else None) for vec_id, q in kept)


ODD = [(None, [0.5] * 4), (7, [float("nan"), 1.0, 1.0, 1.0]), (8, None), (9, [1.0] * 3), (10, [1.0, None, 1.0, 1.0]), (11, [float("inf")] * 4), (12, [1e300] * 4), (13, [-0.0001] * 4)]


@pytest.mark.parametrize("case", ["copies", "few", "large"])
def test_clusters_are_brute_force(spark, case):
    rng = random.Random(case)
    rows = [(i, [rng.choice([-1.0, -0.3, 0.0, 0.2, 0.7]) + rng.random() / 50 for _ in range(4)]) for i in range({"few": 3}.get(case, 80))]
    if case == "copies":
        rows += [(100 + i % 40, [0.25, 0.25, -0.5, 1.0]) for i in range(300)]
    if case == "large":
        rows += [(200, [1e5, 3.0, 0.0, -2e5]), (201, [2.5e9, -4.0e9, 1.0, 0.0]), (202, [4e15, -4e15, 4e15, 0.0])]
    rows += ODD
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, cluster string").repartition(5)
    got = centroids.centroid_clusters(table, clusters=5, rounds=4, dim=4)
    assert sorted((str(r.vec_id), r.cluster, r.distance) for r in got.collect()) == brute_clusters(rows, 5, 4, 4)


def test_inertia_and_no_vectors(spark):
    table = spark.createDataFrame([(i, [float(i % 3), 0.0]) for i in range(30)], "vec_id long, embedding array<float>")
    got = centroids.centroid_clusters(table, clusters=2, rounds=3, dim=2).collect()
    assert {r.inertia for r in got} == {sum(r.distance for r in got)}
    assert all(r.cluster_inertia == sum(s.distance for s in got if s.cluster == r.cluster) for r in got)
    assert centroids.centroid_clusters(table.limit(0), dim=2).collect() == []
    assert centroids.centroid_clusters(table, dim=3).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_a_hot_group_is_joined_whole(spark):
    from lodestone.llm import copies

    rows = spark.range(3000).selectExpr("if(id < 1000, 'hot', concat('k', id % 600)) AS code", "id")
    groups = rows.groupBy("code").count().withColumnRenamed("count", "n")
    assert copies.join_groups(rows, groups, "code", "n", 3000).count() == 3000


# -- WARC -------------------------------------------------------------------------------------------------------------

PAGES = "page_id long, url string, html string, size int"
LONG = "<p>" + "lorem ipsum é " * 90


def some_pages():
    rng = random.Random(3)
    rows = [(i, f"http://x/{i}", LONG + str(rng.randint(0, 40)), 1) for i in range(150)]
    rows += [(i, f"http://y/{i}", rng.choice(["", "short", "a" * 999, "a" * 1000]), 1) for i in range(150, 200)]
    rows += [(None, None, LONG, 1), (None, "u\r\nX: y", LONG, 1), (None, None, None, 1), (200, None, None, 1), (5, "http://x/5", LONG + "same id", 1)]
    return rows + [(201, "twice", LONG + "twice", 1)] * 3 + [(None, None, "b" * 2000, 1)] * 4 + [(202, "t", "tiny", 1)] * 2


def brute_pages(rows):
    out, groups = [], {}
    order = lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")
    for r in rows:
        groups.setdefault((r[2] or "").encode(), []).append(r)
    for payload, same in groups.items():
        same = sorted(same, key=order, reverse=True)
        for k, r in enumerate(same):
            again = len(payload) >= 1000 and k > 0
            out.append((r[0], r[1] and r[1].replace("\r", "%0D").replace("\n", "%0A"), len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if again else "response", same[0][0] if again else None))
    return sorted(map(str, out))


@pytest.mark.parametrize(("range_bytes", "roll_bytes"), [(1 << 30, 1 << 30), (30_000, 400)])
def test_archives_hold_every_page(spark, range_bytes, roll_bytes):
    rows = some_pages()
    table = spark.createDataFrame(rows, PAGES)
    found, bytes_of = [], []
    for parts in (1, 7):
        manifest = warc.write_warc(table.repartition(parts), fresh_path(spark, "warc-test"), range_bytes, roll_bytes)
        read = warc.read_warc(manifest).collect()
        found.append(sorted(str((r.page_id, r.url, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in read))
        bytes_of.append(sorted((r.path.rpartition("/")[2], r.records, r.bytes, r.sha256) for r in manifest.collect()))
        assert len({r.record_id for r in read}) == len(rows)
    assert found == [brute_pages(rows)] * 2
    assert bytes_of[0] == bytes_of[1]  # however the rows come, the files are the same
    assert (len(bytes_of[0]) > 10) == (range_bytes < 1 << 30)


def test_records_are_gzip_members_by_the_standard(spark, tmp_path):
    manifest = warc.write_warc(spark.createDataFrame(some_pages(), PAGES), f"file://{tmp_path}/w")
    (row,) = manifest.collect()
    raw = (tmp_path / "w" / "pages-00000-00000.warc.gz").read_bytes()
    assert hashlib.sha256(raw).hexdigest() == row.sha256
    assert gzip.decompress(raw).count(b"WARC/1.1\r\nWARC-Type: ") == row.records == len(some_pages())
    read = {r.record_id: r for r in warc.read_warc(manifest).collect()}
    for r in read.values():
        text = gzip.decompress(raw[r.offset :][: len(raw)]).split(b"\r\n\r\nWARC/1.1")[0].decode()
        assert f"WARC-Record-ID: <{r.record_id}>" in text
        if r.record_type == "revisit":
            named = text.split("WARC-Refers-To: <")[1].split(">")[0]
            assert (read[named].record_type, read[named].payload_digest) == ("response", r.payload_digest)
    assert [p.name for p in (tmp_path / "w" / "_temporary").iterdir()] == []


def test_commits_are_repeatable_and_losses_are_seen(spark, tmp_path):
    from lodestone.llm.shared import materialize

    uri = f"file://{tmp_path}/w"
    manifest = warc.write_warc(spark.createDataFrame(some_pages(), PAGES), uri, 20_000)
    before = warc.read_warc(manifest).count()
    again = warc.commit(materialize(manifest, "again"), uri)
    assert warc.read_warc(again).count() == before
    file = sorted((tmp_path / "w").glob("*.warc.gz"))[0]
    whole = file.read_bytes()
    file.write_bytes(whole[:-9])
    with pytest.raises(Exception, match="ends within the record|incomplete|bytes"):
        warc.read_warc(again).collect()
    file.unlink()
    with pytest.raises(Exception, match="is gone"):
        warc.commit(materialize(again, "lost"), uri)


def test_no_pages_and_wrong_digests(spark):
    assert warc.warc_archive(spark.createDataFrame([], PAGES)).collect() == []
    raw = warc.record(1, "u", b"payload", hashlib.sha1(b"payload").hexdigest(), 0, None)
    assert warc.parsed(raw)[:4] == (1, 7, hashlib.sha1(b"payload").hexdigest(), "response")
    with pytest.raises(ValueError, match="another block"):
        warc.parsed(raw.replace(b"payload\r\n", b"Payload\r\n"))


def test_a_page_id_of_many_rows_is_parted(spark):
    rows = [(None, f"u{i}", LONG + str(i), 1) for i in range(300)]
    manifest = warc.write_warc(spark.createDataFrame(rows, PAGES), fresh_path(spark, "warc-hot"), range_bytes=50_000).collect()
    assert max(r.records for r in manifest) < 100
    assert sum(r.records for r in manifest) == 300


# -- Merkle -----------------------------------------------------------------------------------------------------------

DOCS = "doc_id long, text string, lang string, source string, n_chars long, rank string"


def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def brute_tree(nodes, fanout):
    """The root, and for each node its path as runs of (place, others)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, path in enumerate(paths):
            first = at[k] - at[k] % fanout
            run = nodes[first : first + fanout]
            path.append((at[k] - first, run[: at[k] - first] + run[at[k] - first + 1 :]))
            at[k] //= fanout
        nodes = [H("".join(nodes[i : i + fanout])) for i in range(0, len(nodes), fanout)]
    return nodes[0], paths


def brute_manifest(docs, fanout):
    leaf = lambda d, more=0: H(field(d[0]) + field(d[3]) + field(d[2]) + field(d[4] if d[4] is None else d[4] + more) + field(d[1]))
    langs = {}
    for d in docs:
        langs.setdefault(d[2], []).append(d)
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in order:
        langs[lang].sort(key=lambda d: (d[0] is not None, d[0] or 0, leaf(d)))
        trees[lang] = brute_tree([leaf(d) for d in langs[lang]], fanout)
    root, tops = brute_tree([trees[lang][0] for lang in order], fanout)
    out = []
    for lang, top in zip(order, tops, strict=True):
        for d, path in zip(langs[lang], trees[lang][1], strict=True):
            wrong = d[0] is not None and zlib.crc32(str(d[0]).encode()) % 7 == 0
            cur = leaf(d, 1 if wrong else 0)
            for at, others in path + top:
                cur = H("".join([*others[:at], cur, *others[at:]]))
            out.append((d[0], leaf(d), trees[lang][0], root, H("".join(x for _, o in path + top for x in o)), cur, cur == root))
    return sorted(map(str, out))


@pytest.mark.parametrize(("fanout", "bucket_rows", "block_nodes"), [(2, 4, 8), (3, 1000, 9), (2, 16_384, 4_096)])
def test_manifest_is_brute_force(spark, fanout, bucket_rows, block_nodes):
    rng = random.Random(fanout + bucket_rows)
    docs = [(i * rng.choice([1, 1, 1 << 40]) - 50, f"text é {rng.randint(0, 9)}", rng.choice(["en", "de", None, "", "zz\U0001f600"]), rng.choice(["web", None]), rng.choice([3, None, 99]), "r") for i in range(140)]
    docs += [(None, None, "en", None, None, "r")] * 9 + [(None, f"n{i}", "en", None, i, "r") for i in range(30)] + [(7, "same", "fr", "s", 1, "r")] * 25
    docs += [(-(1 << 63), "least", "en", "s", (1 << 63) - 1, "r"), ((1 << 63) - 1, "most", "only", "s", 1, "r"), (14, "", "de", "", 0, "r")]
    got = merkle.merkle_manifest(spark.createDataFrame(docs, DOCS).repartition(6), fanout, bucket_rows, block_nodes)
    assert sorted(str(tuple(r)) for r in got.collect()) == brute_manifest(docs, fanout)


def test_manifests_of_nothing_and_of_one(spark):
    assert merkle.merkle_manifest(spark.createDataFrame([], DOCS)).collect() == []
    one = [(3, "t", "en", "s", 1, "r")]
    assert [str(tuple(r)) for r in merkle.merkle_manifest(spark.createDataFrame(one, DOCS)).collect()] == brute_manifest(one, 2)
