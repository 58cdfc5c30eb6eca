"""Redaction beside plain Python: overlapping and adjacent secrets, wide characters, byte order marks, and very many secrets."""

import time

from cyclelens.llm import secrets
from tests.llm.cases import documents

HEX = "0123456789abcdef" * 2


def plainly(text, spans):
    """Secrets cut out by the spans that the scan lists."""
    out, at = "", 0
    for start, end in sorted((int(s.split(":")[1]), int(s.split(":")[2])) for s in spans.split(",")):
        if start >= at:
            out += text[at:start] + secrets.MASK
        at = max(at, end)
    return out + text[at:]


def test_redaction_cuts_what_the_scan_lists(spark):
    texts = [
        f"é😀 {HEX} 😀",
        f"﻿{HEX}﻿{HEX}",
        f"password={HEX} AKIA{'A' * 20}{HEX}",
        f"{HEX}x{HEX}token: abcdefgh",
        "".join(f"𝒳{k} {HEX} " for k in range(1_300)),
        "nothing here",
        "",
        None,
    ]
    docs = documents(spark, list(enumerate(texts)))
    spans = {r.doc_id: r.spans for r in secrets.secrets(docs).collect()}
    got = {r.doc_id: r.text for r in secrets.redacted(docs).collect()}
    assert got == {k: plainly(t, spans[k]) if spans[k] else t for k, t in enumerate(texts)}
    assert got[4].count(secrets.MASK) == 1_300


def test_time_follows_the_number_of_secrets(spark):
    def seconds(n):
        docs = documents(spark, [(1, " ".join([HEX] * n))])
        begun = time.time()
        assert secrets.redacted(docs).collect()[0].text == " ".join([secrets.MASK] * n)
        return time.time() - begun

    seconds(100)
    assert seconds(32_000) < 4 * seconds(4_000) + 4
