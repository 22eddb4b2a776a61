"""The whole-document mix is cut at the total budget."""

import random
from collections import defaultdict

from cartolith.llm.mixing import mix, shuffle_key
from cartolith.llm.shared import written
from pyspark.sql import functions as F


def test_whole_documents_fill_the_budget(spark):
    rng = random.Random(3)
    docs = [(i, f"s{i % 31:02}", rng.randrange(50, 500)) for i in range(310)] + [(310 + i, None, 70 + i) for i in range(4)]
    rows = spark.createDataFrame(docs, "doc_id long, source string, size long").withColumn("shuffle", shuffle_key(F.col("doc_id")))
    out = mix(written(rows, "t"), cut="document").collect()
    assert len(out) == len(docs) and all(r.taken in (0, r["size"], 2 * r["size"]) for r in out)
    budget = sum({r.source: r.target for r in out}.values())
    queues = defaultdict(list)
    for r in sorted(out, key=lambda r: r.before):
        queues[r.source].append(r)
    line = [
        ((r.source_size * epoch + r.before + r["size"]) / r.target, str(r.source), epoch, r.doc_id, r["size"])
        for own in queues.values() for epoch in range(2) for r in own
    ]
    want, total = defaultdict(int), 0
    for *_, doc_id, size in sorted(line):
        if total + size / 2 > budget:
            break
        want[doc_id] += size
        total += size
    assert {r.doc_id: r.taken for r in out if r.taken} == want
    assert abs(sum(r.taken for r in out) - budget) <= max(size for *_, size in docs) / 2
