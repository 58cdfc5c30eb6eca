"""Figures that were only held against labels, computed a second time in plain Python; long texts; awkward column names."""

import math
import random
import re

import numpy as np
import pyarrow as pa

from cyclelens.llm import exact_dedup, language, near_dedup, secrets, words
from tests.llm.cases import documents


def token_runs(text):
    return [m.encode() for m in re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+|[^0-9A-Za-z\x80-\U0010ffff\x20\x09-\x0d]+", text)]


def hashes(texts, **more):
    return words.token_hashes(*words.utf8(pa.array(texts, pa.string())), **more)


def test_runs_across_parts_are_one():
    """Every size of part gives the runs that plain Python finds, each with the hash it has by itself."""
    rng = random.Random(3)
    texts = ["", "a", "ab!!", "!! c", " ", "x" * 70, "-" * 33, "é" * 20 + "1,2", "".join(rng.choice("ab ,é\n") for _ in range(300)), None, "end"]
    alone = {}
    expected = []
    for k, text in enumerate(texts):
        for run in token_runs(text or ""):
            if run not in alone:
                alone[run] = hashes([run.decode()])[0][0]
            expected.append((k, alone[run]))
    assert len(set(alone.values())) == len(alone)
    for size in (1, 2, 3, 7, 16, 64, 1 << 20):
        h, of = hashes(texts, slice_bytes=size)
        assert list(zip(of.tolist(), h.tolist(), strict=True)) == [(k, int(v)) for k, v in expected], size


def test_a_run_across_the_real_cut():
    text = "a" * (2 * words.SLICE - 3) + "bcdefg" + " h" + "i" * (2 * words.SLICE) + "!"
    h, of = hashes(["first", text])
    assert len(h) == 4 and of.tolist() == [0, 1, 1, 1] and h[3] == hashes(["!"])[0][0]


def test_mixture_by_plain_expectation_maximisation():
    rng = np.random.default_rng(4)
    p = rng.random((3, 40))
    p /= p.sum(axis=1, keepdims=True)
    n = rng.poisson(p[0] * 500 + p[1] * 200).astype(float)
    share = [1 / 3] * 3
    for _ in range(language.ROUNDS):
        new = [sum(n[g] * share[k] * p[k][g] / sum(share[j] * p[j][g] for j in range(3)) for g in range(40)) / sum(n) for k in range(3)]
        moved = max(abs(a - b) for a, b in zip(new, share, strict=True))
        share = new
        if moved < language.STILL:
            break
    got, value = language.mixture(p, n)
    assert np.allclose(got, share, atol=1e-9)
    assert math.isclose(value, sum(n[g] * math.log(sum(share[k] * p[k][g] for k in range(3))) for g in range(40)), rel_tol=1e-9)


def test_stages_leave_any_column_alone(spark):
    """Columns that bear the stages' own names, or a dot, come back as they went in; an id repeats."""
    text = "the quick brown fox jumps over the lazy dog and token=abcdefgh12345 ends"
    rows = [(1, text), (1, "another text of some words"), (2, text)]
    docs = documents(spark, rows)
    names = ["__row", "__text", "__spans", "__of_id", "__of_hash", "__rules", "a.b", "of_id", "text_hash"]
    for k, name in enumerate(names):
        docs = docs.withColumn(name, docs.doc_id * 10 + k)
    for stage in (exact_dedup.deduplicated, near_dedup.one_of_each, secrets.redacted):
        out = stage(docs)
        assert out.columns == docs.columns
        for r in out.collect():
            assert [r[n] for n in names] == [r.doc_id * 10 + k for k in range(len(names))]
    assert {(r.doc_id, "[REDACTED]" in r.text) for r in secrets.redacted(docs).collect()} == {(1, True), (1, False), (2, True)}
