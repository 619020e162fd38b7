"""Predictors and graph loops against plain Python on random data."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from orebody.operators import graph, recommend, similarity, user_blocks
from orebody.plans import core
from tests.conftest import tuples


@pytest.fixture(scope="module")
def ratings():
    rng = random.Random(5)
    data = {}
    for u in range(25):
        for i in rng.sample(range(12), rng.randint(1, 8)):
            data[f"u{u:02}", f"i{i:02}"] = float(rng.randint(1, 5))
        data[f"u{u:02}", "hub"] = float(rng.randint(1, 5))
    return data


def pearson(pairs):
    n = len(pairs)
    if n < 2:
        return 0.0
    mx, my = sum(x for x, _ in pairs) / n, sum(y for _, y in pairs) / n
    xx, yy = sum((x - mx) ** 2 for x, _ in pairs), sum((y - my) ** 2 for _, y in pairs)
    return sum((x - mx) * (y - my) for x, y in pairs) / (xx * yy) ** 0.5 if xx > 1e-12 and yy > 1e-12 else 0.0


def frame(rows, data):
    return rows([(u, i, r) for (u, i), r in data.items()], "user string, item string, rating double")


def test_user_based(rows, ratings):
    keys = [("u00", "i03"), ("u01", "hub"), ("u02", "i11"), ("new", "i03"), ("u03", "gone")]
    by_user = defaultdict(dict)
    for (u, i), r in ratings.items():
        by_user[u][i] = r
    mean = {u: sum(d.values()) / len(d) for u, d in by_user.items()}
    want = {}
    for u, i in keys:
        top = below = 0.0
        for v in by_user:
            if i in by_user[v] and u in by_user:
                w = pearson([(by_user[u][k], by_user[v][k]) for k in by_user[u].keys() & by_user[v].keys()])
                top, below = top + (by_user[v][i] - mean[v]) * w, below + abs(w)
        want[u, i] = min(5.0, max(1.0, mean[u] + (top / below if below else 0))) if u in by_user else 3.0
    got = recommend.user_based(frame(rows, ratings), rows([*keys, *keys[:1]], "user string, item string"))
    assert {(r.user, r.item): pytest.approx(r.prediction, abs=1e-6) for r in got.collect()} == want


def test_top_item_based(rows, ratings):
    by_item = defaultdict(dict)
    for (u, i), r in ratings.items():
        by_item[i][u] = r
    users = defaultdict(dict)
    for (u, i), r in ratings.items():
        users[u][i] = r
    keys = [(u, i) for u in ("u00", "u07", "new") for i in (*sorted(by_item)[:6], "gone")]
    want = {}
    for u, i in keys:
        if u not in users:
            want[u, i] = 3.0
            continue
        mean = sum(users[u].values()) / len(users[u])
        if i not in by_item:
            want[u, i] = mean
            continue
        w = {j: round(pearson([(by_item[i][k], by_item[j][k]) for k in by_item[i].keys() & by_item[j].keys()]), 9) for j in by_item if j != i}
        best = sorted(w, key=lambda j: (-w[j], j))[:5]
        below = sum(abs(w[j]) for j in best)
        want[u, i] = sum(w[j] * users[u].get(j, mean) for j in best) / below if below else 3.0
    got = recommend.top_item_based(frame(rows, ratings), rows(keys, "user string, item string"))
    assert {(r.user, r.item): pytest.approx(r.prediction, abs=1e-6) for r in got.collect()} == want


def test_item_based_and_als(rows, ratings):
    df = frame(rows, ratings)
    keys = rows([("u00", "i03"), ("new", "i03"), ("u01", "gone")], "user string, item string")
    similar = rows([("i03", "hub"), ("i03", "i04")], "id_1 string, id_2 string")
    got = {(r.user, r.item): r.prediction for r in recommend.item_based(df, keys, similar).collect()}
    assert got["new", "i03"] == got["u01", "gone"] == 3.0
    assert all(1 <= p <= 5 for p in got.values())
    als = {(r.user, r.item): r.prediction for r in recommend.als(df, keys).collect()}
    assert als["new", "i03"] == als["u01", "gone"] == 3.0 and 1 <= als["u00", "i03"] <= 5


def test_regression_beats_the_mean(rows):
    rng = random.Random(2)
    data = [(x := rng.random(), y := rng.random(), min(5.0, max(1.0, 1 + 3 * x * y + rng.gauss(0, 0.1)))) for _ in range(300)]
    df = rows(data, "x double, y double, r double")
    p = recommend.regression(df, df, ["x", "y"], "r").select(F.avg(F.pow(F.col("prediction") - F.col("r"), 2)), F.var_pop("r")).first()
    assert p[0] < 0.1 * p[1]


def test_similar_pairs_exact_and_lsh(rows):
    rng = random.Random(9)
    sets = {}
    for s in range(60):
        base = set(rng.sample(range(80), rng.randint(1, 10)))
        sets[f"s{s}a"] = base
        sets[f"s{s}b"] = {x for x in base if rng.random() < 0.8} | {rng.randrange(80)}
    df = rows([(s, t) for s, ts in sets.items() for t in ts], "s string, t int")
    names = sorted(sets)
    want = {(a, b) for k, a in enumerate(names) for b in names[k + 1 :] if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.5}
    got = {(r.id_1, r.id_2) for r in similarity.similar_pairs(df, record="s", token="t").collect()}
    assert got == want
    found = {(r.id_1, r.id_2) for r in similarity.lsh_similar_pairs(df, record="s", token="t").collect()}
    assert found <= want and len(found) >= 0.95 * len(want)


def sets_frame(rows):
    rng = random.Random(4)
    sets = {}
    for s in range(40):
        base = set(rng.sample(range(400), rng.randint(3, 12)))
        sets[f"s{s}a"] = base
        sets[f"s{s}b"] = {x for x in base if rng.random() < 0.75} | {rng.randrange(400)}
    return sets, rows([(s, t) for s, ts in sets.items() for t in ts], "s string, t int")


def test_lsh_pairs_do_not_list_all_candidates(rows, monkeypatch):
    sets, df = sets_frame(rows)
    listed = {(r.id_1, r.id_2) for r in similarity.lsh_candidates(similarity.minhash_signatures(df, record="s", token="t")).collect()}
    want = {(a, b) for a, b in listed if 2 * len(sets[a] & sets[b]) >= len(sets[a] | sets[b])}
    assert len(listed) > 3 * len(want) > 0
    monkeypatch.setattr(similarity, "lsh_candidates", lambda *a: pytest.fail("candidates are a fixed share of all pairs"))
    assert {(r.id_1, r.id_2) for r in similarity.lsh_similar_pairs(df, record="s", token="t").collect()} == want


def test_only_pairs_that_may_be_similar_are_counted_by_token(rows, monkeypatch):
    rng = random.Random(6)
    sets = {f"s{s}": set(rng.sample(range(120), 24)) for s in range(60)}
    sets |= {f"{s}b": (ts - set(rng.sample(sorted(ts), 5))) | {200} for s, ts in list(sets.items())[:10]}
    df, names, counted = rows([(s, t) for s, ts in sets.items() for t in ts], "s string, t int"), sorted(sets), []
    want = {(a, b) for k, a in enumerate(names) for b in names[k + 1 :] if 2 * len(sets[a] & sets[b]) >= len(sets[a] | sets[b])}
    real = similarity._verified
    monkeypatch.setattr(similarity, "_verified", lambda pairs, rows: counted.append(pairs.count()) or real(pairs, rows))
    assert {(r.id_1, r.id_2) for r in similarity.similar_pairs(df, record="s", token="t").collect()} == want
    assert len(want) == 10 and counted[0] <= 12  # hundreds share one of their first tokens
    monkeypatch.setattr(similarity, "MARKS", 16)  # most marks fall together; still none is lost
    assert {(r.id_1, r.id_2) for r in similarity.similar_pairs(df, record="s", token="t").collect()} == want
    cosine = {(a, b) for k, a in enumerate(names) for b in names[k + 1 :] if len(sets[a] & sets[b]) >= 0.6 * (len(sets[a]) * len(sets[b])) ** 0.5}
    assert {(r.id_1, r.id_2) for r in similarity.similar_pairs(df, record="s", token="t", threshold=0.6, measure="cosine").collect()} == cosine


def test_signatures_of_some_records_do_not_number_every_token(spark, rows, monkeypatch):
    _, df = sets_frame(rows)
    df = df.union(rows([("s1a", None), (None, 3), ("s1a", 5), ("s1a", 5)], "s string, t int"))
    every = {r.s: (r.n, r.sig) for r in similarity.minhash_signatures(df, record="s", token="t").collect()}
    monkeypatch.setattr(similarity, "dense_index", lambda *a: pytest.fail("every token gets a number and is joined"))
    only = rows([("s1a",), ("s7b",), ("s9a",), ("gone",)], "s string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # the numbers go on from batch to batch
    try:
        got = {r.s: (r.n, r.sig) for r in similarity.minhash_signatures(df, record="s", token="t", only=only).collect()}
        assert got == {s: every[s] for s in ("s1a", "s7b", "s9a")}
        assert similarity.minhash_signatures(df, record="s", token="t", only=only.where("s = 'gone'")).count() == 0
        assert similarity.minhash_signatures(df.where("s = 'gone'"), record="s", token="t", only=only).count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_precision_and_recall_find_similar_pairs_once(spark, rows, tmp_path, monkeypatch):
    sets, df = sets_frame(rows)
    df.selectExpr("s AS business_id", "cast(t AS string) AS user_id", "1.0D AS stars").write.parquet(str(tmp_path / "yelp_train.parquet"))
    calls, real = [], similarity.similar_pairs
    monkeypatch.setattr(similarity, "similar_pairs", lambda *a, **k: calls.append(k) or real(*a, **k))
    got = core.pair_precision_recall(spark, str(tmp_path)).first()
    names = sorted(sets)
    true = sum(2 * len(sets[a] & sets[b]) >= len(sets[a] | sets[b]) for k, a in enumerate(names) for b in names[k + 1 :])
    found = core.lsh_jaccard(spark, str(tmp_path)).count()
    assert (got.n_true, got.n_found, got.precision, got.recall) == (true, found, 1.0, round(found / true, 6))
    assert len(calls) == 2  # one for each query


def test_item_based_keeps_ratings_of_similar_items_only(rows, ratings, monkeypatch):
    kept = []
    monkeypatch.setattr(recommend, "cut", lambda df: kept.append(df) or df)
    keys = rows([("u00", "i03"), ("u01", "i04"), ("u02", "hub"), ("new", "i03")], "user string, item string")
    got = recommend.item_based(frame(rows, ratings), keys, rows([("i03", "i04", 0.5)], "id_1 string, id_2 string, similarity double"))
    assert got.count() == 4
    read = [df.select("item").distinct().collect() for df in kept if "rating" in df.columns]
    assert read and all({r.item for r in items} == {"i03", "i04"} for items in read)


def test_user_based_by_blocks_writes_no_pairs(rows, ratings, monkeypatch):
    df = frame(rows, ratings)
    w = {(r.a, r.b): r.w for r in recommend.pearson_pairs(df, of="user", over="item").collect()}
    own = defaultdict(list)
    for (u, _), r in ratings.items():
        own[u].append(r)
    mean = {u: sum(r) / len(r) for u, r in own.items()}
    keys = [(f"u{u:02}", i) for u in range(0, 25, 2) for i in ("hub", "i03", "i07", "gone")] + [("new", "hub")]
    want = {}
    for u, i in keys:
        met = [(w.get((u, b), 0.0), ratings[b, i] - mean[b]) for b in mean if (b, i) in ratings]
        below = sum(abs(v) for v, _ in met)
        want[u, i] = mean.get(u, 3.0) + (sum(v * d for v, d in met) / below if below else 0.0)
    monkeypatch.setattr(recommend, "pearson_pairs", lambda *a, **k: pytest.fail("a row a pair of users"))
    for sizes in ({}, {"block": 15, "room": 4}):
        monkeypatch.setattr(recommend, "neighbour_sums", lambda r, k, s=sizes: user_blocks.neighbour_sums(r, k, **s))
        got = {(r.user, r.item): r.prediction for r in recommend.user_based(df, rows(keys, "user string, item string"), clamped=False).collect()}
        assert got == pytest.approx(want, abs=1e-7)


@pytest.fixture(scope="module")
def network():
    rng = random.Random(11)
    found = {tuple(sorted((f"n{a}", f"n{b}"))) for a, b in ((rng.randrange(24), rng.randrange(24)) for _ in range(34)) if a != b}
    return sorted(found | {("z1", "z2"), ("z2", "z3")})


def brandes(edges):
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    total = {e: 0.0 for e in edges}
    for s in near:
        dist, sigma, order = {s: 0}, Counter({s: 1}), [s]
        for v in order:
            for w in sorted(near[v]):
                if w not in dist:
                    dist[w] = dist[v] + 1
                    order.append(w)
                if dist[w] == dist[v] + 1:
                    sigma[w] += sigma[v]
        delta = Counter()
        for w in reversed(order):
            for v in near[w]:
                if dist[v] == dist[w] - 1:
                    c = sigma[v] / sigma[w] * (1 + delta[w])
                    total[tuple(sorted((v, w)))] += c / 2
                    delta[v] += c
    return total


def parts_of(nodes, edges):
    home = {v: v for v in nodes}
    for _ in nodes:
        for a, b in edges:
            home[a] = home[b] = min(home[a], home[b])
    return home


def test_betweenness_components_labels(rows, network):
    df = rows(network, "src string, dst string")
    got = {(r.src, r.dst): r.betweenness for r in graph.betweenness(df).collect()}
    assert got == {e: pytest.approx(x, abs=1e-9) for e, x in brandes(network).items()}
    nodes = sorted({v for e in network for v in e})
    assert tuples(graph.components(df)) == sorted(parts_of(nodes, network).items())
    label = {v: v for v in nodes}
    near = defaultdict(list)
    for a, b in network:
        near[a].append(b)
        near[b].append(a)
    for _ in range(5):
        label = {v: min(Counter(label[w] for w in near[v]).items(), key=lambda x: (-x[1], x[0]))[0] for v in nodes}
    assert tuples(graph.label_propagation(df)) == sorted(label.items())


def test_girvan_newman(rows, network):
    nodes, left, rounds = sorted({v for e in network for v in e}), list(network), []
    m, degree = len(network), Counter(v for e in network for v in e)

    def q(home):
        size = Counter()
        for v in nodes:
            size[home[v]] += degree[v]
        return sum(home[a] == home[b] for a, b in network) / m - sum((d / (2 * m)) ** 2 for d in size.values())

    best, split = -9.0, None
    while left:
        home = parts_of(nodes, left)
        if round(q(home), 9) > best:
            best, split = round(q(home), 9), home
        b = brandes(left)
        high = max(round(x, 9) for x in b.values())
        gone = {e for e in left if round(b[e], 9) == high}
        rounds.append(gone)
        left = [e for e in left if e not in gone]
    removed, found = graph.girvan_newman(rows(network, "src string, dst string"))
    order = defaultdict(set)
    for r in removed.collect():
        order[r["round"]].add((r.src, r.dst))
    assert set().union(*order.values()) == set(network)
    assert order[1] == rounds[0]
    home = {r.id: r.community for r in found.collect()}
    assert round(q(home), 9) == best
    with pytest.raises(ValueError):
        graph.girvan_newman(rows(network, "src string, dst string"), most_edges=3)


def test_girvan_newman_beyond_one_task(rows):
    edges = [("a", "b"), ("a", "c"), ("b", "c"), ("c", "d"), ("d", "e"), ("d", "f"), ("e", "f"), ("p", "q"), ("q", "r"), ("r", "s"), ("x", "y")]
    df = rows(edges, "src string, dst string")
    want = [tuples(x) for x in graph.girvan_newman(df)]
    # two components spread over the executors, one in a task
    assert [tuples(x) for x in graph.girvan_newman(df, task_edges=2)] == want
    assert len(want[0]) == len(edges)


def test_itemsets_equal_fpgrowth(rows):
    from pyspark.ml.fpm import FPGrowth

    from orebody.operators.itemsets import frequent_itemsets

    rng = random.Random(31)
    data = [(b, i) for b in range(120) for i in {min(int(rng.paretovariate(0.8)), 25) for _ in range(rng.randint(1, 9))}]
    df = rows(data, "basket int, item int")
    baskets = df.groupBy("basket").agg(F.collect_set("item").alias("items"))
    want = {(tuple(sorted(r["items"])), r.freq) for r in FPGrowth(itemsCol="items", minSupport=(8 - 0.5) / 120).fit(baskets).freqItemsets.collect()}
    for parts in (1, 7):
        got = frequent_itemsets(df.repartition(parts), 8).collect()
        assert {(tuple(r.itemset), r.support) for r in got} == want
    assert max(r.k for r in got) >= 3
