"""Tool calls, top-k search, archives and the pipeline."""

import base64
import hashlib
import json
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cyclelens.llm import chat, topk, warc
from tests.llm.cases import awkward, documents


def call_rows(spark):
    calls = [
        (1, "a", 0, "find", '{"q": "x", "n": 1.0}', 9),
        (1, "a", 5, "find", "{}", 9),  # repeats an id: the first stands
        (1, "b", 1, "find", '{"n":2,"q":{"$ref":"c"}}', 9),  # uses a later call's result
        (1, "c", 3, "find", '{"z":1,"q":7}', 9),
        (1, "d", 4, "none", "[1]", 9),
        (2, "e", 0, "find", '{"q":{"$ref":"f"}}', 9),
        (2, "f", 1, "find", '{"q":{"$ref":"e"}}', 9),  # a cycle
        (2, "g", 2, "find", '{"q":{"$ref":"e"}}', 9),
        (None, "h", None, None, None, 9),
        (3, None, 1, "find", "{bad", 9),
        (3, "i", 2, "late", "{}", 9),
        (3, "j", 2, "find", '{"q":{"$ref":"nowhere"}}', 9),
    ]
    results = [(1, "a", 9, "r1"), (1, "a", 8, "r0"), (1, "c", 4, "rc"), (2, "e", 1, None), (7, "nobody", 1, 'say "hi"\n'), (7, None, 2, "x")]
    schemas = [("find", "q", "string", True), ("find", "n", "integer", False), ("late", "when", "any", False)]
    return (
        spark.createDataFrame(calls, "conv_id long, call_id string, turn long, tool string, arguments string, level int"),
        spark.createDataFrame(results, "conv_id long, call_id string, turn long, content string"),
        spark.createDataFrame(schemas, "tool string, param string, type string, required boolean"),
    )


def test_calls_are_linked_checked_and_ordered(spark):
    rows = chat.formatted(*call_rows(spark)).collect()
    calls = {r.call_id: r for r in rows if r.kind == "call" and r.call_id}
    results = {r.call_id: r for r in rows if r.kind == "result"}
    assert json.loads(calls["a"].json)["arguments"] == {"n": 1, "q": "x"}
    assert calls["a"].json.startswith('{"arguments":{"n":1,"q":"x"},"call_id":"a"')
    assert calls["a"].errors == "" and calls["a"].status == "linked" and json.loads(results["a"].json)["content"] == "r0"
    assert calls["c"].errors == "type:q,unknown:z"
    assert calls["d"].errors == "not an object" and calls["d"].status == "unanswered"
    assert calls["b"].level == 2 and calls["c"].level == 0 and results["c"].level == 1
    assert calls["c"].position < results["c"].position < calls["b"].position
    assert {calls[x].status for x in "efg"} == {"cyclic"} and {calls[x].level for x in "efg"} == {-1}
    assert calls["h"].errors == "no such tool" and calls["i"].errors == "" and calls["j"].level == 0
    (nameless,) = [r for r in rows if r.kind == "call" and r.call_id is None]
    assert nameless.status == "unnamed" and nameless.errors == "not JSON" and json.loads(nameless.json)["arguments"] == "{bad"
    assert results["nobody"].status == results[None].status == "orphan" and json.loads(results["nobody"].json)["content"] == 'say "hi"\n'
    positions = {}
    for r in rows:
        positions.setdefault(r.conv_id, []).append(r.position)
    assert all(sorted(p) == list(range(len(p))) for p in positions.values())
    assert all(list(json.loads(r.json)) == sorted(json.loads(r.json)) for r in rows)


def test_levels_of_chains_and_meetings(spark):
    """A long chain, calls that refer to its ends and middle, and a tail behind them; turns run against the order here and there."""
    refs = {f"c{i}": [f"c{i - 1}"] if i else [] for i in range(40)}
    refs |= {"m": ["c39", "c10", "r"], "r": [], "t": ["m"], "u": ["t", "c5"], "x": ["y"], "y": ["x"], "z": ["x", "r"]}
    turns = {c: (7 * k) % 50 for k, c in enumerate(refs)}
    rows = [(c, turns[c], "{" + ",".join(f'"p{k}":{{"$ref":"{r}"}}' for k, r in enumerate(of)) + "}") for c, of in refs.items()]
    got = {r.call_id: (r.level, r.time) for r in chat.levels(spark.createDataFrame(rows, "call_id string, turn long, arguments string")).collect()}

    def expected(c):
        parts = [expected(r) for r in refs[c]]
        return max((p[0] + 2 for p in parts), default=0), max([turns[c], *(p[1] for p in parts)])

    assert got == {c: (-1, turns[c]) if c in "xyz" else expected(c) for c in refs}


def test_no_calls(spark):
    calls, results, schemas = call_rows(spark)
    assert chat.formatted(calls.limit(0), results.limit(0), schemas.limit(0)).count() == 0
    assert {r.status for r in chat.formatted(calls.limit(0), results, schemas).collect()} == {"orphan"}


def test_awkward_conversations(spark):
    rows = [(1, 0, "user", None), (1, 0, "user", None), (1, 1, "assistant", ""), (None, 0, "user", "x"), (2, None, "user", "x"), (3, 5, None, "y"), (4, 0, "assistant", "z" * 100_000)]
    conversations = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    calls, results, messages = chat.as_items(conversations.withColumn("row", F.lit(1)).withColumn("prompt", F.lit("p")))
    schemas = spark.createDataFrame(chat.SCHEMAS, "tool string, param string, type string, required boolean")
    got = chat.formatted(calls, results, schemas, messages).collect()
    assert sorted(((r.conv_id, r.position, r.kind, r.status, r.errors) for r in got), key=str) == [
        (1, 0, "result", "orphan", ""), (1, 1, "call", "unanswered", "missing:prompt"), (2, 0, "result", "orphan", ""), (3, 0, "message", "plain", ""),
        (4, 0, "call", "unanswered", ""), (None, 0, "result", "orphan", ""),
    ]


@pytest.mark.parametrize("block", [40, 100_000])
def test_top_k_is_exact(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "VECTORS", block)
    monkeypatch.setattr(topk, "QUERIES", 7)
    rng = np.random.default_rng(1)
    rows = [(int(i), [float(x) for x in rng.normal(size=6).round(1)]) for i in range(400)] + [(1000 + i, [0.5] * 6) for i in range(200)]
    rows += [(2000, None), (2050, [1.0, None]), (2100, [float("nan")]), (2150, []), (None, [1.0]), (3, [9.0] * 6), (2200, [-1.0, 2.0]), (3, [9.0] * 6)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<double>, score int")
    vectors = topk.integers(df, "vec_id", "embedding")
    got = sorted(map(tuple, topk.top_k(vectors, vectors.where("vec_id % 50 = 0")).collect()))
    kept: dict = {}
    for i, x in rows:
        if i is not None and x is not None and all(c is not None and np.isfinite(c) for c in x):
            kept[i] = min(kept.get(i, x), x)
    kept = {i: [int(np.floor(256 * c)) for c in x] for i, x in kept.items()}
    expected = []
    for q in (i for i in kept if i % 50 == 0):
        best = sorted((-sum(a * b for a, b in zip(kept[q], kept[c], strict=False)), c) for c in kept if c != q)[:5]
        expected += [(q, n + 1, c, -s) for n, (s, c) in enumerate(best)]
    assert got == sorted(expected)


def test_threshold_stops_early():
    """On lists with a clear winner, only the first rows are scored."""
    rng = np.random.default_rng(5)
    v = np.abs(rng.normal(size=(20_000, 3)) * 10).astype(np.int64)
    v[:5] += 10_000
    lists = topk.Lists(np.arange(20_000), v)
    scored = 0
    real = lists.floats

    class Counting:
        def __getitem__(self, rows):
            nonlocal scored
            scored += len(rows) if isinstance(rows, np.ndarray) else 0
            return real[rows]

    lists.floats = Counting()
    ids, _ = lists.top(-1, np.array([3, 2, 1]), 5)
    assert sorted(ids) == [0, 1, 2, 3, 4] and scored < 2000


def test_top_k_of_nothing(spark):
    none = topk.integers(spark.createDataFrame([], "vec_id long, embedding array<float>"), "vec_id", "embedding")
    assert topk.top_k(none, none).count() == 0
    one = topk.integers(spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<double>"), "vec_id", "embedding")
    assert topk.top_k(one, one).count() == 0


PAGES = [
    (1, "http://a/é x\r\n", "<p>one</p>"), (2, None, "<p>one</p>"), (3, "http://c", None), (4, "http://d", ""), (5, "http://e", "big " * 100_000),
    (None, "http://n", "<p>one</p>"), (None, None, "alone"), (6, "http://f", "WARC/1.1\r\n\r\nfake"), (6, "http://f", "WARC/1.1\r\n\r\nfake"),
]


def pages(spark, rows=PAGES):
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload string")


def test_archives_read_back(spark, monkeypatch):
    got = warc.records(warc.archived(pages(spark))).collect()
    groups: dict = {}
    for i, _, h in PAGES:
        groups.setdefault(h or "", []).append(i)
    expected = Counter()
    for i, _, h in PAGES:
        data = (h or "").encode()
        top = max((x for x in groups[h or ""] if x is not None), default=None)
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        expected[i, len(data), digest, "response" if i == top else "revisit", None if i == top else top] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == expected
    assert {bytes(r.payload).decode() for r in got if r.payload is not None} == set(groups)
    assert warc.records(warc.archived(pages(spark, []))).count() == 0


def test_small_payloads_are_all_responses(spark):
    got = warc.records(warc.archived(pages(spark), least=11)).where("payload_bytes < 11").collect()
    assert len(got) == 6 and {r.record_type for r in got} == {"response"}


def test_records_by_identifier(spark):
    rows = [(i, f"http://x/{i}", f"page {i} " * 300) for i in range(400)]
    archive = warc.archived(pages(spark, rows))
    wanted = [warc.record_id(i) for i in (3, 77, 399)]
    found = warc.fetched(archive, spark.createDataFrame([(w,) for w in [*wanted, "urn:uuid:none"]], "id string")).collect()
    assert {r.record_id: bytes(r.payload).decode() for r in found} == {warc.record_id(i): rows[i][2] for i in (3, 77, 399)}


def test_frames_are_independent():
    import zstandard

    writer, rng = warc.BundleWriter(), random.Random(1)
    data = [bytes(rng.getrandbits(8) for _ in range(50_000)) for _ in range(20)]
    for k, d in enumerate(data):
        writer.add(str(k), d)
    bundle, index = writer.close()
    table = warc.seek_table(bundle)
    assert len(table) == 4
    for name, frame, offset, size in index:
        at, packed, full = table[frame]
        assert zstandard.ZstdDecompressor().decompress(bundle[at : at + packed], max_output_size=full)[offset : offset + size] == data[int(name)]
    # A plain decoder reads the bundle as one stream, the seek table being a skippable frame.
    assert zstandard.ZstdDecompressor().stream_reader(bundle, read_across_frames=True).read() == b"".join(data)


def test_pipeline(spark):
    import corpus_pipeline

    docs = documents(spark)
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[1:4]:
        docs = stage(spark, docs, "")
        assert docs.columns == columns, name
    # Equal texts and near copies went, the smallest id of each stayed; rows without an id are never dropped.
    assert Counter(r.doc_id for r in docs.collect()) == Counter([1, 3, 4, 7, 9, 11, 12, None, None])
    packed = corpus_pipeline.pack(spark, docs, "").collect()
    assert {r.doc_id for r in packed} == {1, 3, 4, 7, 9, 11, 12, None}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "near dedup", "secret scan", "packing"]


def test_awkward_covers_repeats():
    assert Counter(awkward())[awkward()[5]] == 2


def test_lengths_bound_what_is_not_met():
    """Where dimensions differ in spread, fewer than half of the rows are scored, with the result of a full scan."""
    rng = np.random.default_rng(11)
    v = (rng.normal(size=(8_000, 16)) * 256 * 0.6 ** np.arange(16)).astype(np.int64)
    lists, scored = topk.Lists(np.arange(8_000), v), 0
    real = lists.floats

    class Counting:
        def __getitem__(self, rows):
            nonlocal scored
            scored += len(rows) if isinstance(rows, np.ndarray) else 0
            return real[rows]

    lists.floats = Counting()
    for query in v[:40]:
        ids, scores = lists.top(-1, query, 5)
        every = v @ query
        best = np.lexsort((np.arange(len(v)), -every))[:5]
        assert ids.tolist() == best.tolist() and scores.tolist() == every[best].tolist()
    assert scored < 0.5 * 40 * len(v), scored / 40 / len(v)


def test_bound_by_length_holds():
    rng = np.random.default_rng(12)
    for _ in range(300):
        rows = rng.normal(size=(50, 5)) * rng.uniform(0.1, 9, 5)
        query = rng.normal(size=5) * rng.integers(0, 2, 5)
        edge = np.where(query >= 0, rows.max(axis=0), rows.min(axis=0))
        assert topk._most(edge, query, (rows * rows).sum(axis=1).max()) >= (rows @ query).max()
