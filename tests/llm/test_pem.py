"""Private keys are masked with their whole body."""

import random
import string

from cyclelens.llm import secrets
from tests.llm.cases import documents

RNG = random.Random(4)
BODY = ["".join(RNG.choice(string.ascii_letters + string.digits + "+/") for _ in range(64)) for _ in range(5)] + ["q0Zk9A=="]


def key(body, kind="RSA ", end=True, line="\n"):
    return line.join([f"-----BEGIN {kind}PRIVATE KEY-----", *body, *([f"-----END {kind}PRIVATE KEY-----"] if end else [])])


def test_keys_are_masked_whole(spark):
    headed = ["Proc-Type: 4,ENCRYPTED", "DEK-Info: AES-128-CBC,0A1B", "", *BODY]
    texts = [
        (f"a\n{key(BODY)}\nb c", "a\n[REDACTED]\nb c"),
        (f"{key(headed)} b", "[REDACTED] b"),
        (f"{key(headed, end=False)}\nThen prose.", "[REDACTED]\nThen prose."),
        (f"{key(BODY, '', False)}", "[REDACTED]"),
        (f"{key(BODY[:2], '', False)}\nThen prose, and more.", "[REDACTED]\nThen prose, and more."),
        (f'{{"k": "{key(BODY, line=chr(92) + "n")}"}}', '{"k": "[REDACTED]"}'),
        (f"{key(BODY, end=False)}\n{key(BODY, 'EC ')}\nx", "[REDACTED]\n[REDACTED]\nx"),
        (f"{key(BODY)}\r\n{key(BODY, line=chr(13) + chr(10))}\r\nx", "[REDACTED]\r\n[REDACTED]\r\nx"),
        ("-----BEGIN PRIVATE KEY----- is how a key begins", "[REDACTED] is how a key begins"),
        (f"{key(BODY * 20_000)} end", "[REDACTED] end"),
        (f"{key(['- ' * 200_000])} end", "[REDACTED] end"),
        ("-----BEGIN PUBLIC KEY-----\n" + BODY[0], "-----BEGIN PUBLIC KEY-----\n" + BODY[0]),
    ]
    got = {r.doc_id: r.text for r in secrets.redacted(documents(spark, [(k, t) for k, (t, _) in enumerate(texts)])).collect()}
    assert [got[k] for k in range(len(texts))] == [want for _, want in texts]
    spans = secrets.secrets(documents(spark, [(1, texts[0][0])])).first().spans
    assert f"pem:2:{2 + len(key(BODY))}" in spans.split(",")
