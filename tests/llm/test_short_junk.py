"""A junk text that is too short to gather the odds is rejected by its mean."""

import random

from cyclelens.llm import quality
from tests.llm.cases import documents, words


def test_short_junk_is_rejected(spark):
    rng = random.Random(9)
    good = [words(rng, 1500) for _ in range(40)]
    junk = [" ".join(rng.choice(["ZXQ", "VVKJ", "QQW", "JXZ"]) for _ in range(400)) for _ in range(40)]
    short = "ZXQ VVKJ"
    clean = " ".join(good[3].split()[:2])
    docs = documents(spark, [*enumerate(good), *((100 + i, t) for i, t in enumerate(junk)), (500, short), (501, clean), (502, ""), (503, None)])
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.resampled(docs, labels).collect()}
    assert got[500].log_weight > -10.3 and not got[500].kept
    assert all(got[i].kept for i in [*range(40), 501, 502, 503]) and not any(got[100 + i].kept for i in range(40))
