"""Blocks of a bucket meet only where they hold different components: no pair of components is missed, few rows are exchanged."""

from itertools import combinations

from pyspark.sql import functions as F

from cyclelens.llm import near_dedup


def exchanged(spark, buckets):
    """Rows of `_blocks` for buckets given as lists of (node, label)."""
    members = [(b, 0, n, min(x for x, _ in nodes)) for b, nodes in enumerate(buckets) for n, _ in nodes]
    members = spark.createDataFrame(members, "bucket long, band int, node long, pivot long")
    labels = spark.createDataFrame([(n, l) for nodes in buckets for n, l in nodes], "of long, label long").distinct()
    return near_dedup._blocks(members, labels, labels.select("of", F.lit(1).alias("n_shingles")))


def test_every_pair_of_components_meets_once(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    buckets = [
        [(n, 0 if n < 10 else 10 if n < 21 else n) for n in range(30)],  # two large components, and nodes by themselves
        [(n, n % 2 * 101 + 100) for n in range(100, 130)],  # large ones only
        [(n, n) for n in range(200, 215)],  # small ones only
        [(n, 300) for n in range(300, 320)],  # one component: nothing to search
        [(400, 400), (401, 401)],  # its pair has been compared with the pivot
        [(500, 500)],
    ]
    met: dict[tuple, int] = {}
    groups: dict[tuple, list] = {}
    for r in exchanged(spark, buckets).collect():
        groups.setdefault((r.bucket, r.left, r.right), []).append(r)
    for (bucket, left, right), rows in groups.items():
        for a in (r for r in rows if r.block == left):
            for b in (r for r in rows if r.block == right):
                if a.label != b.label and (left != right or a.node < b.node):
                    key = bucket, min(a.node, b.node), max(a.node, b.node)
                    met[key] = met.get(key, 0) + 1
    expected = {(k, a, b) for k in (0, 1, 2) for (a, x), (b, y) in combinations(buckets[k], 2) if x != y}
    assert set(met) == expected and set(met.values()) == {1}
    assert {b for b, _, _ in groups} == {0, 1, 2}


def test_one_outlier_in_a_hot_bucket(spark):
    """20,000 nodes that are joined and one that is not: each is sent about once and not once for every 1,024 nodes."""
    n = 20_000
    rows = exchanged(spark, [[(k, 0) for k in range(n)] + [(n, n)]])
    sent = rows.count()
    blocks = -(-n // near_dedup.BLOCK)
    assert sent <= n + blocks + 1
    assert rows.groupBy("left", "right").count().agg(F.max("count")).first()[0] < 2 * near_dedup.BLOCK
