"""run() over a small folder against all five stages in plain Python; the quality model's weights computed a second time."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from cyclelens.llm import quality, secrets, words

RNG = random.Random(8)
VOCABULARY = sorted({"".join(RNG.choice("aeinorstldcu") for _ in range(RNG.randint(2, 8))) for _ in range(300)})


def prose(n):
    return " ".join(RNG.choice(VOCABULARY) for _ in range(n))


def corpus():
    docs = {i: prose(600) for i in range(1, 41)}
    labels = [(i, 1, 0) for i in range(1, 41)] + [(70, 0, 0)]
    docs |= {41: docs[3].replace(" ", " \n\t", 5), 42: docs[3] + "", 43: docs[9] + " tail", 44: docs[9].replace(" ", "  ") + " tail\n"}
    changed = docs[12].split()
    changed[100], changed[300] = "new", "other"
    docs |= {45: " ".join(changed), 46: prose(300) + " password = 'abcdef123456' and AKIA" + "Q7" * 10 + " then " + "0123456789abcdef" * 2 + " end"}
    docs |= {47: prose(80), 48: docs[46] + " token:abcdefgh", 70: " ".join(f"zq{k}x" for k in range(12)), 71: prose(4), 72: prose(5000)}
    return docs, labels


def runs(text):
    return [m.encode() for m in re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+|[^0-9A-Za-z\x80-\U0010ffff\x20\x09-\x0d]+", text)]


def weights(docs, good):
    """Each document's features and log weight by dictionaries and sums."""
    known: dict[bytes, int] = {}

    def of(run):
        if run not in known:
            known[run] = int(words.token_hashes(*words.utf8(pa.array([run.decode()])))[0][0])
        return known[run]

    def pair(a, b):
        if a == b:
            return 0
        return int(words.mixed(np.array([(a * 0x9E3779B97F4A7C15 + b) % 2**64], dtype=np.uint64))[0]) >> 48

    bags = {}
    for i, text in docs.items():
        h = [of(r) for r in runs(text)]
        bags[i] = Counter([x >> 48 for x in h] + [pair(a, b) for a, b in zip(h, h[1:])])
    raw, target = Counter(), Counter()
    for i, bag in bags.items():
        raw.update(bag)
        if i in good:
            target.update(bag)
    n, m, size = sum(raw.values()), sum(target.values()), 1 << 16

    def ratio(bucket):
        p = (raw[bucket] + 1) / (n + size)
        return math.log((target[bucket] + size * p) / (m + size)) - math.log(p)

    return {i: (sum(bag.values()), sum(k * ratio(b) for b, k in bag.items())) for i, bag in bags.items()}


def masked(text):
    """The union of all matches that are long enough, each run of them as one mask."""
    spans = []
    for rule in secrets.RULES:
        flags, pattern = (re.I, rule.pattern.removeprefix("(?i)")) if rule.pattern.startswith("(?i)") else (0, rule.pattern)
        spans += [m.span() for m in re.finditer(pattern, text, flags) if len(m[rule.group]) >= rule.least]
    out, at = "", 0
    for a, b in sorted(spans):
        if a >= at:
            out += text[at:a] + secrets.MASK
        at = max(at, b)
    return out + text[at:]


def test_run_equals_the_stages_in_plain_python(spark, tmp_path):
    docs, labels = corpus()
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in docs.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    # Quality: no document is likelier as raw text by the odds, so what the mean rejects goes and all else stays.
    plain = weights(docs, {i for i, q, _ in labels if q})
    got = quality.resampled(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet")).collect()
    assert {r.doc_id: r.n_features for r in got} == {i: n for i, (n, _) in plain.items()}
    assert all(math.isclose(r.log_weight, plain[r.doc_id][1], rel_tol=1e-9, abs_tol=1e-6) for r in got)
    assert min(w for _, w in plain.values()) > -math.log(quality.ODDS)
    left = {i: t for i, t in docs.items() if plain[i][1] >= plain[i][0] * quality.LEAST_MEAN}
    assert set(docs) - set(left) == {70}
    # Exact copies.
    groups = defaultdict(list)
    for i, t in left.items():
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t)].append(i)
    left = {min(g): left[min(g)] for g in groups.values()}
    # Near copies.
    sets = {}
    for i, t in left.items():
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t.lower()) if x]
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))}
    label = {i: i for i in left}
    for a, b in combinations(sorted(left), 2):
        if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            old, new = max(label[a], label[b]), min(label[a], label[b])
            label = {i: new if x == old else x for i, x in label.items()}
    left = {i: masked(t) for i, t in left.items() if label[i] == i}
    assert 46 in left and secrets.MASK in left[46] and not {41, 42, 43, 44, 45, 48} & set(left)
    # Packing: every id in one piece, pieces gapless in sequences of at most 4,096.
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokenizer.no_truncation(), tokenizer.no_padding()
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {p.doc_id for p in pieces} == set(left)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append((p.offset, p.length))
    for i, parts in by_doc.items():
        ids = [*tokenizer.encode(left[i], add_special_tokens=False).ids, 2]
        at = 0
        for p in sorted(parts, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], dtype="<u4").tobytes())
            at += p.length
        assert at == len(ids)
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
