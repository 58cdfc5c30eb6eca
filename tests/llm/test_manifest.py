"""The Merkle manifest against a plain tree, on awkward rows and many ids."""

import hashlib
import random
import zlib

from pyspark.sql import functions as F

from cyclelens.llm import merkle
from tests.llm.cases import documents


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(nodes):
    """Root and each leaf's path (side, sibling), by the plain definition."""
    paths, held, of = [[] for _ in nodes], list(nodes), [[i] for i in range(len(nodes))]
    while len(held) > 1:
        up, up_of = [], []
        for i in range(0, len(held), 2):
            run = held[i : i + 2]
            for k in range(len(run)):
                for leaf in of[i + k]:
                    paths[leaf].append([(j - k, d) for j, d in enumerate(run) if j != k])
            up.append(sha(*run))
            up_of.append([leaf for o in of[i : i + 2] for leaf in o])
        held, of = up, up_of
    return held[0], paths


def fold(d, path):
    for level in path:
        d = sha(*[x for s, x in level if s < 0], d, *[x for s, x in level if s > 0])
    return d


def expected(rows):
    """rows: (group, id, leaf, claimed)."""
    order = lambda g: (g is not None, (g or "").encode())
    groups = sorted({r[0] for r in rows}, key=order)
    inner, subroots = {}, []
    for g in groups:
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        root, paths = tree([r[2] for r in mine])
        inner[g] = list(zip(mine, paths, strict=True))
        subroots.append(root)
    root, above = tree(subroots)
    out = []
    for g, sub, up in zip(groups, subroots, above, strict=True):
        for (_, id_, leaf, claimed), path in inner[g]:
            whole = path + up
            got = fold(claimed, whole)
            out.append((id_, leaf, sub, root, sha(*[x for level in whole for _, x in level]), got, got == root))
    return sorted(out, key=str)


def got(spark, rows):
    df = spark.createDataFrame(rows, "group_key string, id long, leaf string, claimed string")
    return sorted((tuple(r) for r in merkle.manifest(df).collect()), key=str)


def made(spec):
    """Equal ids have equal or different leaves; some leaves are claimed wrongly."""
    return [(g, i, sha("leaf", str(i), str(v)), sha("other" if zlib.crc32(str((g, i, v)).encode()) % 5 == 0 else "leaf", str(i), str(v))) for g, i, v in spec]


def test_many_ids_and_groups(spark):
    rng = random.Random(3)
    wide = [(g, rng.randrange(-(2**63), 2**63), 0) for g in ("a", "é", "z") for _ in range(700)]
    dense = [("dense", i, 0) for i in range(-40, 2100)]
    far = [("ends", i, 0) for i in (-(2**63), -1, 0, 63, 64, 2**16 - 1, 2**16, 2**32, 2**48, 2**63 - 1)]
    rows = made([*wide, *dense, *far, ("one", 5, 0), (None, 7, 0), ("", 8, 0)])
    assert got(spark, rows) == expected(rows)


def test_repeated_and_null_ids(spark):
    rows = made([("a", 5, 1), ("a", 5, 2), ("a", 5, 2), ("a", 6, 0), ("a", 7, 0), ("a", None, 1), ("a", None, 1), ("a", None, 2), ("b", None, 0), ("c", 64, 0), ("c", 65, 0), ("c", 65, 0), ("c", 70, 0)])
    rows += made([("hot", 9, v % 3) for v in range(1500)] + [("hot", 10, 0), ("hot", 8, 0)])
    assert got(spark, rows) == expected(rows)


def test_one_leaf_and_none(spark):
    rows = made([("a", 1, 0)])
    assert got(spark, rows) == expected(rows) == [(1, rows[0][2], rows[0][2], rows[0][2], sha(), rows[0][3], rows[0][2] == rows[0][3])]
    assert got(spark, []) == []


def test_words_of_a_bitmap(spark):
    ids = spark.createDataFrame([(0, i, 1) for i in (0, 1, 63, 64, 200, 2**40)], "group_no long, id long, times long")
    words = {r.word: (r.bits, r.base) for r in merkle.directory(ids).collect()}
    assert words == {0: (-(2**63) + 3, 0), 1: (1, 3), 3: (1 << 8, 4), 2**34: (1, 5)}


def test_awkward_documents(spark, tmp_path):
    docs = documents(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = merkle.op11_manifest(spark, str(tmp_path)).collect()
    assert len(out) == docs.count() and len({r.root for r in out}) == 1
    by_leaf = {}
    for r in docs.collect():
        values = [r.doc_id, r.source, r.lang, r.n_chars, r.text]
        text = "".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)
        by_leaf[sha(text)] = r.n_chars is not None and r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0
    assert {r.leaf for r in out} == set(by_leaf)
    assert all(r.verified != by_leaf[r.leaf] for r in out)
    assert docs.where(F.col("doc_id") < 0).isEmpty()
