import hashlib
import random
from collections import Counter, defaultdict

from sievelight.llm.mixing import mix


def brute(rows, weights, block, period):
    groups = defaultdict(list)
    for doc, source in rows:
        groups[source].append(doc)
    least = min(weights.values()) if weights else 1.0
    weights = {s: weights.get(s, least) for s in groups}
    total, room = sum(weights.values()), period - len(weights)
    share = {s: w / total * room for s, w in weights.items()}
    quota = {s: int(x) + 1 for s, x in share.items()}
    left = period - sum(quota.values())
    for s in sorted(share, key=lambda s: (-(share[s] - int(share[s])), s is not None, s or ""))[:left]:
        quota[s] += 1
    names = sorted(groups, key=lambda s: "n" if s is None else "s" + s)
    done, plan = Counter(), {}
    for t in range(period):
        ready = [(-(-(done[s] + 1) * period // quota[s]), i) for i, s in enumerate(names) if done[s] < quota[s] and done[s] * period // quota[s] <= t]
        if ready:
            s = names[min(ready)[1]]
            assert min(ready)[0] > t
            plan[s, done[s]] = t
            done[s] += 1
    assert sum(done.values()) == period
    out = []
    digest = lambda d: "" if d is None else hashlib.md5(str(d).encode()).hexdigest()
    for s, docs in groups.items():
        for k, d in enumerate(sorted(docs, key=lambda d: (digest(d), d or 0))):
            b, place, q = k // block, k % block, quota[s]
            base = b // q * period
            slot = base + plan[s, b % q]
            out.append((d, s, b, place, slot, base + b % q * period // q, base - (-(b % q + 1) * period // q), slot * block + place))
    return sorted(out, key=str), quota


def test_matches_brute_force_and_keeps_shares(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["a"] * 10 + ["b", "b", "c", None, ""])) for i in range(3000)] + [(None, "a"), (5, "b"), (5, "b")]
    weights = {"a": 0.5, "b": 0.3, "c": 0.15, None: 0.03}
    w = spark.createDataFrame(list(weights.items()), "source string, weight double")
    df = spark.createDataFrame(rows, "doc_id long, source string").selectExpr("*", "1 as SOURCE").repartition(5)
    got = sorted(map(tuple, mix(df, w, block=4, period=100, buckets=8).collect()), key=str)
    want, quota = brute(rows, weights, 4, 100)
    assert got == want
    slots = sorted({(r[4], r[1]) for r in got}, key=str)
    used = Counter()
    last = min(max(s for s, n in slots if n == name) for name in quota)
    for t, name in sorted(slots, key=lambda x: x[0]):
        used[name] += 1
        if t < last:
            assert all(abs(used[n] - (t + 1) * quota[n] / 100) < 1 for n in quota)
    assert len({r[7] for r in got}) == len(rows)


def test_empty_and_single(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a")], "doc_id long, source string")
    assert sorted(r.mix_pos for r in mix(df, block=1).collect()) == [0, 1]
    assert mix(df.limit(0)).count() == 0


def test_more_sources_than_slots(spark):
    rows = [(i, f"s{i % 1500}") for i in range(1800)] + [(5000 + i, "hot") for i in range(600)]
    got = mix(spark.createDataFrame(rows, "doc_id long, source string")).collect()
    assert sorted((r.doc_id, r.source) for r in got) == sorted(rows)
    assert len({r.mix_pos for r in got}) == len(rows)
    assert all(r.release <= r.slot < r.deadline for r in got)
