"""graph_traverse against a walk over all relations in plain Python."""

from __future__ import annotations

from tessera import registry


def test_traversal_follows_all_relations(spark, sf_dir):
    first: dict[int, dict[int, int]] = {}
    for line in spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_partkey", "l_linenumber", "l_suppkey").collect():
        targets = first.setdefault(line.l_partkey, {})
        target = line.l_suppkey * 7 % 2000
        targets[target] = min(line.l_linenumber, targets.get(target, line.l_linenumber))
    want = []

    def walk(seed, node, depth, visited):
        for _, target in sorted((idx, t) for t, idx in first.get(node, {}).items()):
            if target not in visited:
                visited.add(target)
                want.append((seed, target, node, depth + 1))
                if depth + 1 < 2:
                    walk(seed, target, depth + 1, visited)

    for seed in first:
        if seed % 100 == 0:
            walk(seed, seed, 0, {seed})
    got = registry.QUERIES["graph_traverse"](spark, sf_dir).collect()
    assert sorted((r.query_id, r.node, r.via, r.depth) for r in got) == sorted(want)
