"""Exact and near-duplicate groups against brute force."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cyclelens.llm import exact_dedup, near_dedup
from cyclelens.llm.components import components
from tests.llm.cases import awkward, documents, words


def exact_brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub("[\x20\x09-\x0d]+", " ", t or ""), []).append(i)
    out = []
    for i, t in rows:
        text = re.sub("[\x20\x09-\x0d]+", " ", t or "")
        ids = [x for x in groups[text] if x is not None]
        keep = min(ids, default=None)
        out.append((i, keep, len(groups[text]), i == keep, hashlib.sha256(text.encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("bits", [64, 3])
def test_exact_groups(spark, bits):
    """With 3 bits chunks share identifiers all the time, and the verification has to tell them apart."""
    rng = random.Random(1)
    rows = awkward() + [(100 + i, words(rng, 300)) for i in range(20)]
    rows += [(200 + i, rows[-1 - i % 3][1]) for i in range(30)]
    got = exact_dedup.exact_duplicates(documents(spark, rows), hash_bits=bits)
    assert Counter(map(tuple, got.collect())) == exact_brute(rows)


def test_chunks_make_up_the_text(spark):
    rows = [(i, t) for i, t in enumerate([words(random.Random(3), 20_000), "y" * 10_000, "", " a ", "漢" * 5000])]
    chunked = exact_dedup._chunks(documents(spark, rows), "doc_id", "text")
    joined = chunked.select("doc_id", F.sha2(F.array_join("chunks", ""), 256).alias("again"), "text_sha256", F.size("chunks").alias("n"))
    for r in joined.collect():
        assert r.again == r.text_sha256
    # An insertion moves the chunks around it only.
    one, two = (words(random.Random(4), 5000) for _ in range(2))
    pair = exact_dedup._chunks(documents(spark, [(1, one), (2, "some more " + two)]), "doc_id", "text").collect()
    assert len(set(pair[0].chunks) & set(pair[1].chunks)) > 0.9 * len(pair[0].chunks)


def test_exact_of_nothing(spark):
    assert exact_dedup.exact_duplicates(documents(spark, [])).count() == 0


def test_exact_stage_keeps_columns(spark):
    docs = documents(spark)
    kept = exact_dedup.deduplicated(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([1, 3, 4, 6, 7, 8, 9, 10, 11, 12, None, None])


def shingles(text):
    found = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower())
    return {tuple(found)} if 0 < len(found) < 5 else {tuple(found[k : k + 5]) for k in range(len(found) - 4)}


def near_brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    ids = [i for i, _ in sets if i is not None]
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= 75 * len(a | b):
                low, high = sorted((find(i), find(j)))
                root[high] = low
    return Counter((i, len(s), None if i is None else find(i), i is None or find(i) == i) for i, s in sets)


def near_rows():
    """Copies around one text, most of them less like each other than like it, and chains of small steps."""
    rng = random.Random(7)
    rows, base = awkward(), words(rng, 120).split()
    for i in range(60):
        copy = list(base)
        for _ in range(rng.randint(0, 4)):
            copy[rng.randrange(len(copy))] = "w" + str(rng.random())
        rows.append((1000 + i, " ".join(copy)))
    step = words(rng, 100).split()
    for i in range(12):
        step = [*step[3:], *words(rng, 3).split()]
        rows.append((2000 + i, " ".join(step)))
    return rows


def test_near_groups(spark, monkeypatch):
    rows = near_rows()
    assert Counter(map(tuple, near_dedup.near_duplicates(documents(spark, rows)).collect())) == near_brute(rows)


def test_near_groups_of_open_blocks(spark, monkeypatch):
    """The same groups when every block has too many survivors, and is searched again with its whole sets."""
    monkeypatch.setattr(near_dedup, "_across", open_blocks)
    rows = near_rows()
    assert Counter(map(tuple, near_dedup.near_duplicates(documents(spark, rows)).collect())) == near_brute(rows)


def open_blocks(batches):
    """Gives no survivor and leaves all blocks open."""
    import pyarrow as pa

    for rows in near_dedup._contiguous(batches, ["bucket", "left", "right"]):
        bucket = rows.column("bucket")[0].as_py()
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (None, None, bucket)], names=["a", "b", "open"])


def test_a_block_gives_its_likeliest_or_its_links(monkeypatch):
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(near_dedup, "AT_ONCE", 0)
    texts = [t for i, t in near_rows() if i and 1000 <= i < 1060]
    sets = [near_dedup._set_of(pa.array([t])) for t in texts]
    n = len(texts)
    rows = pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(n, 5)), pa.array(np.zeros(n, np.int32)), pa.array(np.arange(n)), pa.array(np.full(n, -1)), pa.array(np.arange(n)),
            pa.array(np.zeros(n, np.int32)), pa.array(np.zeros(n, np.int32)), pa.array(np.zeros(n, np.int32)),
            pa.array([near_dedup.signature(s).tobytes() for s in sets], pa.binary()), pa.array([len(s) for s in sets]),
            pa.array([s.tobytes() for s in sets], pa.binary()),
        ],
        names=["bucket", "band", "node", "pivot", "label", "block", "left", "right", "signature", "n_shingles", "shingles"],
    )
    few = pa.Table.from_batches(near_dedup._across(iter([rows]))).to_pylist()
    assert [r["open"] for r in few if r["open"] is not None] == [5] and len(few) - 1 <= 2 * n
    links = {(a, b) for a in range(n) for b in range(a + 1, n) if 100 * len(np.intersect1d(sets[a], sets[b])) >= 75 * len(np.union1d(sets[a], sets[b]))}
    given = {(r["a"], r["b"]) for r in pa.Table.from_batches(near_dedup._linked(iter([rows]))).to_pylist()}
    assert given <= links and len(given) < n

    def groups(pairs):
        root = list(range(n))
        for a, b in pairs:
            low, high = sorted((root[a], root[b]))
            root = [low if r == high else r for r in root]
        return root

    assert groups(given) == groups(links)


def test_signatures_estimate_similarity():
    import numpy as np

    rng = np.random.default_rng(2)
    pool = rng.integers(0, 2**64, 4000, dtype=np.uint64)
    for shared in (0.2, 0.5, 0.8):
        a, b = pool[:2000], np.concatenate([pool[: int(2000 * shared)], pool[2000 : 2000 + int(2000 * (1 - shared))]])
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((near_dedup.signature(a) == near_dedup.signature(b)).mean() - true) < 0.15


def test_pruning_keeps_links():
    """The chance that a pair at the threshold is ever given up stays near the chosen miss probability."""
    import numpy as np

    rng = np.random.default_rng(3)
    n, t = 20_000, near_dedup.PERCENT / 100
    x = np.zeros((n, near_dedup.HASHES), np.uint32)
    y = (rng.random(x.shape) >= t).astype(np.uint32)
    assert len(near_dedup.surviving(x, y)[0]) >= n - 20
    far = (rng.random(x.shape) >= 0.3).astype(np.uint32)
    assert len(near_dedup.surviving(x, far)[0]) < n / 1000


def test_near_of_nothing(spark):
    assert near_dedup.near_duplicates(documents(spark, [])).count() == 0
    assert near_dedup.near_duplicates(documents(spark, [(1, ""), (2, None)])).where("kept").count() == 2


def test_components_of_chains_and_stars(spark):
    rng = random.Random(11)
    chain = [(i, i + 1) for i in range(100)]
    star = [(500, 501 + i) for i in range(200)]
    pairs = chain + star + [(900, 900), (902, 901)]
    rng.shuffle(pairs)
    found = components(spark.createDataFrame(pairs, "a long, b long")).collect()
    groups = {}
    for r in found:
        groups.setdefault(r.root, set()).add(r.node)
    assert sorted(map(len, groups.values())) == [2, 101, 201]
