import hashlib
import random

import pytest

from kindred.operators import cluster as cl
from kindred.operators import evaluate as ev
from kindred.operators import linkage
from kindred.plans import pipeline


def edges(seed, n=60, ties=False, side=15):
    rng = random.Random(seed)
    pairs = {(rng.randrange(side), rng.randrange(side)) for _ in range(n)}
    return [(a, b, rng.choice([0.2, 0.4, 0.6]) if ties else rng.random()) for a, b in sorted(pairs)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "l_id long, r_id long, sim double").coalesce(1)


def tie(a, b):
    return int(hashlib.md5(f"{a}:{b}".encode()).hexdigest()[:15], 16)


def greedy(rows):
    ls, rs, out = set(), set(), set()
    for a, b, s in sorted(rows, key=lambda e: (-e[2], tie(e[0], e[1]), e[0], e[1])):
        if a not in ls and b not in rs:
            ls.add(a), rs.add(b), out.add((a, b))
    return out


def union_find(rows):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b, _ in rows:
        x, y = find(f"l{a}"), find(f"r{b}")
        if x != y:
            parent[max(x, y)] = min(x, y)
    groups = {}
    for x in parent:
        groups.setdefault(find(x), set()).add(x)
    return {frozenset(g) for g in groups.values()}


def groups(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["cluster_id"], set()).add(r["side"] + r["id"])
    assert all(min(g) == c for c, g in out.items())
    return {frozenset(g) for g in out.values()}


def pairs(df):
    return {(r["l_id"], r["r_id"]) for r in df.collect()}


@pytest.mark.parametrize("seed,ties", [(1, False), (2, True)])
def test_unique_mapping_is_the_greedy_matching(spark, seed, ties):
    rows = edges(seed, ties=ties)
    assert pairs(cl.unique_mapping(frame(spark, rows))) == greedy(rows)


def test_unique_mapping_of_a_chain_and_of_equal_weights(spark):
    chain = [(i // 2, (i + 1) // 2, 1 - i / 100) for i in range(12)]
    assert pairs(cl.unique_mapping(frame(spark, chain))) == greedy(chain)
    tied = [(a, b, 0.5) for a in range(4) for b in range(4)]
    assert pairs(cl.unique_mapping(frame(spark, tied))) == greedy(tied)


SHAPES = {
    "path": [(i // 2, (i + 1) // 2, 0.5) for i in range(1000)],
    "all with all": [(a, b, 0.5) for a in range(32) for b in range(32)],
    "star": [(0, b, 0.5) for b in range(1000)],
    "copies": [(a, b, 0.5) for a in range(40) for b in range(a // 10 * 10, a // 10 * 10 + 25)],
}


@pytest.mark.parametrize("matcher", [cl.unique_mapping, cl.kiraly])
def test_equal_weights_take_few_rounds(spark, monkeypatch, matcher):
    """Four shapes of a thousand equal edges, side by side."""
    labels = []
    real = cl.cut_lineage
    monkeypatch.setattr(cl, "cut_lineage", lambda df, label="step": labels.append(label) or real(df, label))
    df = spark.createDataFrame([(g, *e) for g, rows in SHAPES.items() for e in rows], "g string, l_id long, r_id long, sim double").coalesce(1)
    found = matcher(df, ["g"]).collect()
    assert labels.count("mutual") <= 30 and labels.count("offers") <= 30
    for g, rows in SHAPES.items():
        got = {(r["l_id"], r["r_id"]) for r in found if r["g"] == g}
        if matcher is cl.unique_mapping:
            assert got == greedy(rows)
        else:
            assert len({a for a, _ in got}) == len({b for _, b in got}) == len(got) >= len(greedy(rows))


def test_stable_matching_promotes_those_left_over(spark):
    # whichever edge of record 0 the tie key prefers, both left records end up matched
    both = [(a, *e) for a, b in ((0, 1), (1, 0)) for e in ((0, a, 0.5), (0, b, 0.5), (1, a, 0.5))]
    got = cl.kiraly(spark.createDataFrame(both, "g int, l_id long, r_id long, sim double").coalesce(1), ["g"]).collect()
    assert {(r["g"], r["l_id"]) for r in got} == {(g, x) for g in (0, 1) for x in (0, 1)}


def test_groups_are_matched_side_by_side(spark):
    a, b = edges(3), edges(4)
    df = spark.createDataFrame([(1, *e) for e in a] + [(2, *e) for e in b], "g int, l_id long, r_id long, sim double")
    got = {(r["g"], r["l_id"], r["r_id"]) for r in cl.unique_mapping(df, ["g"]).collect()}
    assert got == {(1, *p) for p in greedy(a)} | {(2, *p) for p in greedy(b)}


def test_stable_matching_without_ties_is_unique(spark):
    rows = edges(5)
    assert pairs(cl.kiraly(frame(spark, rows))) == greedy(rows)


@pytest.mark.parametrize("seed", [6, 7])
def test_stable_matching_with_ties(spark, seed):
    rows = edges(seed, ties=True)
    got = pairs(cl.kiraly(frame(spark, rows)))
    assert len({a for a, _ in got}) == len({b for _, b in got}) == len(got)
    weight = {(a, b): s for a, b, s in rows}
    have_l = {a: weight[a, b] for a, b in got}
    have_r = {b: weight[a, b] for a, b in got}
    assert not [e for e, s in weight.items() if s > have_l.get(e[0], -1) and s > have_r.get(e[1], -1)]  # no blocking pair
    # size: at least two thirds of a maximum matching
    match = {}

    def augment(a, seen):
        for (x, b) in weight:
            if x == a and b not in seen:
                seen.add(b)
                if b not in match or augment(match[b], seen):
                    match[b] = a
                    return True
        return False
    best = sum(augment(a, set()) for a in {a for a, _ in weight})
    assert 3 * len(got) >= 2 * best


def test_best_match(spark):
    rows = edges(8)
    per_r = {}
    for a, b, s in sorted(rows, key=lambda e: (-e[2], e[0])):
        per_r.setdefault(b, (a, s))
    per_l = {}
    for b, (a, s) in sorted(per_r.items(), key=lambda e: (-e[1][1], e[0])):
        per_l.setdefault(a, b)
    assert pairs(cl.best_match(frame(spark, rows))) == set(per_l.items())


@pytest.mark.parametrize("seed", [9, 10])
def test_components(spark, seed):
    rows = edges(seed, n=25, side=20)
    assert groups(cl.components(frame(spark, rows))) == union_find(rows)


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i // 2, (i + 1) // 2, 0.5) for i in range(60)] + [(100, 200 + i, 0.5) for i in range(30)]
    assert groups(cl.components(frame(spark, chain))) == union_find(chain)


def test_forest_keeps_components_at_every_threshold(spark):
    rows = edges(11, n=80, ties=True)
    forest = [(r["l_id"], r["r_id"], r["sim"]) for r in cl.spanning_forest(frame(spark, rows)).collect()]
    nodes = len({a for a, _, _ in rows}) + len({b for _, b, _ in rows})
    assert len(forest) == nodes - len(union_find(rows))
    for t in (0.2, 0.4, 0.6):
        assert union_find([e for e in forest if e[2] >= t]) == union_find([e for e in rows if e[2] >= t])


def test_empty_graph(spark):
    none = frame(spark, [])
    for f in (cl.unique_mapping, cl.kiraly, cl.best_match, cl.components, cl.spanning_forest):
        assert f(none).count() == 0


def test_complete_adds_singletons(spark):
    e1 = spark.createDataFrame([(i,) for i in range(3)], "id long")
    done = cl.complete(cl.components(frame(spark, [(0, 1, 0.9)])), e1, e1)
    assert groups(done) == {frozenset({"l0", "r1"}), *(frozenset({x}) for x in ("l1", "l2", "r0", "r2"))}


def test_partition_scores_equal_pair_scores_for_a_matching(spark):
    rows = edges(12)
    gt = frame(spark, [(i, i, 1.0) for i in range(15)]).select("l_id", "r_id")
    m = cl.unique_mapping(frame(spark, rows))
    a = ev.evaluate(m, gt).first().asDict()
    b = ev.evaluate_partition(cl.as_partition(m), gt).first().asDict()
    assert a == b


def test_threshold_curve_equals_separate_runs(spark):
    rows = edges(13)
    gt = frame(spark, [(i, i, 1.0) for i in range(15)]).select("l_id", "r_id")
    curve = {r["threshold"]: r["f1"] for r in ev.threshold_curve(
        cl.unique_mapping(frame(spark, rows)), gt, [0.2, 0.5, 0.8]).collect()}
    for t, f1 in curve.items():
        assert ev.evaluate(cl.unique_mapping(cl.prune(frame(spark, rows), t)), gt).first()["f1"] == f1


def ranked(seed, n=150, side=30, digits=None):
    rng = random.Random(seed)
    sims = {(rng.randrange(side), rng.randrange(side)): rng.random() for _ in range(n)}
    rows, place = [], {}
    for (a, b), s in sorted(sims.items(), key=lambda e: (-e[1], e[0])):
        place[a] = place.get(a, 0) + 1
        rows.append((a, b, round(s, digits) if digits else s, place[a]))
    return rows


def counts_of(rows, known):
    parts = union_find([(a, b, 0) for a, b, *_ in rows])
    of = {x: i for i, p in enumerate(parts) for x in p}
    pairs = sum(sum(x[0] == "l" for x in p) * sum(x[0] == "r" for x in p) for p in parts)
    return pairs, sum(f"l{a}" in of and of.get(f"l{a}") == of.get(f"r{b}") for a, b in known)


@pytest.mark.parametrize("seed,digits,ks", [(22, 1, [1, 2, 4, 5, 7]), (23, None, [2])])
def test_component_curve_equals_separate_runs(spark, seed, digits, ks):
    rows, known = ranked(seed, digits=digits), [(i, (i * 7) % 30) for i in range(30)]
    cuts = [0.1, 0.3, 0.5, 0.7, 0.95]
    ed = spark.createDataFrame(rows, "l_id long, r_id long, sim double, rank int")
    gt = spark.createDataFrame(known, "l_id long, r_id long")
    got = {(r["k"], r["threshold"]): (r["predicted"], r["tp"]) for r in linkage.component_curve(ed, gt, ks, cuts).collect()}
    want = {(k, t): counts_of([e for e in rows if e[3] <= k and e[2] >= t], known) for k in ks for t in cuts}
    assert got == {x: c for x, c in want.items() if c[0]}


def test_forests_by_rank_have_the_components_of_their_graphs(spark):
    rows = ranked(24, digits=1)
    ed = spark.createDataFrame(rows, "l_id long, r_id long, sim double, rank int")
    ks = list(range(1, 12))
    got = {}
    for r in linkage.forests_by_rank(ed, ks).collect():
        got.setdefault(r["k"], []).append((r["l_id"], r["r_id"], r["sim"]))
    for k in ks:
        graph = [e[:3] for e in rows if e[3] <= k]
        assert len(got[k]) == len({a for a, *_ in graph}) + len({b for _, b, _ in graph}) - len(union_find(graph))
        for t in (0.2, 0.5, 0.8):
            assert union_find([e for e in got[k] if e[2] >= t]) == union_find([e for e in graph if e[2] >= t])


def test_merges_of_a_star_and_a_chain(spark):
    star = [(0, b, [0.1, 0.5, 0.7][b % 3], 1) for b in range(40)]
    chain = [(100 + i // 2, 100 + (i + 1) // 2, [0.7, 0.5][i % 2], 1) for i in range(60)]
    ed = spark.createDataFrame(star + chain, "l_id long, r_id long, sim double, rank int")
    gt = spark.createDataFrame([(0, 3), (0, 4), (100, 130), (5, 5)], "l_id long, r_id long")
    got = {r["threshold"]: (r["predicted"], r["tp"]) for r in linkage.component_curve(ed, gt, [1], [0.1, 0.5, 0.7]).collect()}
    for t in (0.1, 0.5, 0.7):
        assert got[t] == counts_of([e for e in star + chain if e[2] >= t], [(0, 3), (0, 4), (100, 130), (5, 5)])


def test_grid_equals_runs_of_its_own(spark):
    """Every clustering, k and threshold against a run of that configuration alone, on tied edges."""
    rows = ranked(25, n=90, side=15, digits=1)
    ed = spark.createDataFrame(rows, "l_id long, r_id long, sim double, rank int")
    gt = spark.createDataFrame([(i, i) for i in range(15)], "l_id long, r_id long")
    names, ks, cuts = ["BestMatchClustering", "UniqueMappingClustering", pipeline.COMPONENTS], [2], [0.35, 0.999]
    grid = {(r["clustering"], r["k"], r["threshold"]): r for r in pipeline.run_grid(ed, gt, ks, names, cuts).collect()}
    assert len(grid) == len(names) * len(ks) * len(cuts)
    for (name, k, t), r in grid.items():
        own = pipeline.score(ed.where(f"rank <= {k}"), gt, name, t).first()
        own = (own["precision"], own["recall"], own["f1"]) if own else (0.0, 0.0, 0.0)
        assert (r["precision"], r["recall"], r["f1"]) == own
