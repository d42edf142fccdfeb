"""The pipeline's near stage gets its first links from SimHash fingerprints."""

from __future__ import annotations

import random

from weftgraph.llm import neardup, similar


def test_near_stage_links_by_fingerprints_first(spark, monkeypatch):
    rng = random.Random(8)
    text = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    base, far = text(300), text(40)
    bits = lambda a, b: (neardup.simhash(a, 5) ^ neardup.simhash(b, 5)).bit_count()
    close = next(t for i in range(500) if 1 <= bits(" ".join(base), t := " ".join([*base, f"more{i}"])) <= similar.FINGERPRINT_BITS)
    rows = [(1, " ".join(base)), (2, close), (3, " ".join(text(300))), (4, " ".join(far)), (5, " ".join([*far, "a", "b", "c"]))]
    seen = []
    links = neardup.fingerprint_links

    def spied(nodes, budget):
        found = links(nodes, budget)
        seen.extend(map(tuple, found.collect()))
        return found

    monkeypatch.setattr(neardup, "fingerprint_links", spied)
    left = {r["doc_id"] for r in neardup.drop_near(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    fp = {i: neardup.simhash(t, 5) for i, t in rows}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    one, two = signed(fp[1]), signed(fp[2])
    assert (min(one, two), max(one, two)) in {(min(p), max(p)) for p in seen}
    assert left == {1, 3, 4}  # 4 and 5 are near copies as well, however far apart their fingerprints are
