from collections import Counter, defaultdict

from paperloom.llm import mixing as m

DOCS = "doc_id long, source string, text string"
TARGETS = "plan string, source string, target_share double, max_repeats int, total_ratio double"


def test_tree_gives_every_shard_disjoint_ranges():
    for counts, shards in (([100, 7, 0, 33], 9), ([5], 3), ([1, 1], 8), ([1000, 1], 1)):
        tree = m.SplittingTree(counts, shards, 3)
        sizes = Counter()
        for s, n in enumerate(counts):
            owners = [tree.shard(s, r) for r in range(n)]
            assert owners == sorted(owners) and all(0 <= x < shards for x in owners)
            sizes.update(owners)
        assert max(sizes.values()) - min(sizes[k] for k in range(shards)) <= 4
        assert tree.shard(0, 0) == m.SplittingTree(counts, shards, 3).shard(0, 0)


def test_split_is_hypergeometric_in_the_mean():
    left = [m.SplittingTree([300, 100], 2, seed)._split(0, 2, m.SplittingTree([300, 100], 2, seed).root)[0] for seed in range(200)]
    assert all(x.sum() == 200 for x in left) and abs(sum(x[0] for x in left) / 200 - 150) < 2


def docs(spark):
    rows = [(i, "big", "word " * (i % 9 + 1)) for i in range(300)] + [(1000 + i, "small", "tiny text") for i in range(6)] + [(2000, None, "no source at all"), (2001, "empty", ""), (2002, "empty", None)]
    return spark.createDataFrame(rows, DOCS)


def targets(spark):
    return spark.createDataFrame([("p", "big", 0.5, 1, 0.5), ("p", "small", 0.02, 3, 0.5), ("p", "absent", 0.2, 5, 0.5), ("p", "empty", 0.1, 5, 0.5), ("q", "small", 1.0, 2, 0.5), ("q", "small", 1.0, 2, 0.5), ("r", "big", 0.0, 0, 1.0)], TARGETS)


def test_mix(spark):
    d = docs(spark)
    mix, quota = m.mix_sources(d, targets(spark), block_tokens=40, shard_blocks=4)
    rows = mix.collect()
    assert len({(r.plan, r.doc_id, r["pass"]) for r in rows}) == len(rows)
    places = defaultdict(list)
    for r in rows:
        places[r.plan, r.shard].append(r.position)
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in places.values()) and len(places) > 3
    tokens = {r.doc_id: (r.source, r.n_tokens) for r in m.count_tokens(d, ["doc_id", "source"]).collect()}
    size, total = Counter(), sum(n for _, n in tokens.values())
    for s, n in tokens.values():
        size[s] += n
    report = {(r.plan, r.source): r for r in m.mix_report(mix, quota).collect()}
    for t in targets(spark).distinct().collect():
        r = report[t.plan, t.source]
        want = t.target_share * t.total_ratio * total
        enough = size.get(t.source, 0) * t.max_repeats >= want
        assert r.reached == enough
        assert r.passes <= t.max_repeats
        if enough:
            assert want <= r.mixed_tokens < want + 12
        else:
            assert r.mixed_tokens == size.get(t.source, 0) * t.max_repeats
    again = m.mix_sources(d.repartition(7), targets(spark), block_tokens=40, shard_blocks=4)[0]
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in rows}


def test_empty(spark):
    mix, quota = m.mix_sources(docs(spark).limit(0), targets(spark))
    assert mix.count() == 0 and m.mix_report(mix, quota).count() == 6
    mix, quota = m.mix_sources(docs(spark), targets(spark).limit(0))
    assert mix.count() == 0 and m.mix_report(mix, quota).count() == 0
