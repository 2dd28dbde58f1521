"""The choice of supporting passages against taking them one by one over plain lists."""

import random

from pyspark.sql import functions as F

from tessera.functions import urls as U
from tessera.operators import support as P


def brute(rows, needs_primary, most, primary_phase):
    """rows: (item, supports, url, root, primary, score, source, seq)."""
    best = sorted(rows, key=lambda r: (-r[5], -r[6], r[7]))
    taken, urls, hosts = [], set(), set()

    def add(r):
        if r[2] not in urls:
            urls.add(r[2])
            if r[3]:
                hosts.add(r[3])
            taken.append(r)

    for r in [r for r in best if r[1]]:
        add(r)
        if len(taken) >= most:
            return [r[0] for r in taken]
    if primary_phase and needs_primary and not any(r[4] for r in taken):
        for r in [r for r in best if r[4]][:1]:
            add(r)
            if len(taken) >= most:
                return [r[0] for r in taken]
    for r in best:
        if r[3] not in hosts:
            add(r)
            if len(taken) >= most or len(hosts) >= 2:
                break
    return [r[0] for r in taken]


def test_against_taking_one_by_one(spark):
    r = random.Random(4)
    rows = []
    for claim in range(60):
        for k in range(r.randint(0, 40)):
            host = r.choice(["a.gov", "b.com", "c.org", "d.edu", "", "e.net"][: 1 + claim % 6])
            rows.append((claim, f"p{k}", r.random() < 0.2, f"Title {k % 3}", f"spark joins {k % 4} text", f"https://{host}/{k % 7}", host, r.choice(["official", "unknown", "vendor", "academic"]), r.choice([0.1, 0.8, None]), r.randint(0, 3) / 3, r.randint(0, 3) / 3, k))
    passages = spark.createDataFrame(rows, "claim_id long, item string, supports boolean, title string, text string, url string, host string, kind string, primary_score double, utility double, source_score double, seq long")
    claims = spark.createDataFrame([(k, ["spark", "joins", str(k % 4)], [], None, ["fact", "product_specs"][k % 2], ["official"] if k % 3 else None, k % 4 > 0) for k in range(61)], "claim_id long, tokens array<string>, entities array<string>, scope string, shape string, preferred array<string>, needs_primary boolean")
    for weights, most, primary_phase in ((P.SELECTION, 4, True), (P.ANSWER, 3, False)):
        scored = passages.join(claims, "claim_id").select("*", P.support_score(weights).alias("score"), U.registered_root(F.col("host")).alias("root"), P.is_primary(F.col("primary_score"), F.col("kind"), F.col("shape")).alias("primary")).collect()
        got = {}
        for x in P.select(passages, claims, most, weights, primary_phase).orderBy("claim_id", "place").collect():
            got.setdefault(x.claim_id, []).append(x.item)
        for claim in range(61):
            own = [(x.item, x.supports, x.url, x.root or "", x.primary, x.score, x.source_score, x.seq) for x in scored if x.claim_id == claim]
            assert got.get(claim, []) == brute(own, claim % 4 > 0, most, primary_phase), claim
