"""Similar sets, items met together, and addresses, against brute force."""

import random
from collections import Counter
from itertools import combinations, permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

import orebody.llm.cooccur as cooccur
from orebody.llm.address_parse import parse_address, postcode_of, town_of
from orebody.llm.addresses import assignment_cost, edits, location_pairs, same_locations
from orebody.llm.chosen_path import pair_recall, similar_classes, similar_pairs, sketch_cutoff, tree_recall, trees_for
from orebody.llm.cooccur import BlockRow, cooccurring_pairs, products


def jaccard_pairs(sets, threshold, least):
    names = sorted(s for s in sets if len(sets[s]) >= least)
    return {(a, b) for a, b in combinations(names, 2) if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}


@pytest.fixture(scope="module")
def sets():
    rng = random.Random(21)
    out = {}
    for s in range(120):
        base = {f"u{int(rng.paretovariate(0.7)) % 300}" for _ in range(rng.randint(1, 30))} | {"everyone"}
        out[f"s{s}a"] = base
        out[f"s{s}b"] = {x for x in base if rng.random() < 0.85} | {f"u{rng.randrange(300)}"}
        if s % 10 == 0:
            out[f"s{s}c"] = out[f"s{s}d"] = set(base)
    return out


def table_of(rows, sets):
    data = [(s, t, 1) for s, ts in sets.items() for t in ts]
    return rows([*data, *data[:50], (None, "u1", 1), ("s1a", None, 1)], "business_id string, user_id string, class_id int")


@pytest.mark.parametrize(("threshold", "least", "leaf", "depth"), [(0.5, 5, 128, 5), (0.5, 5, 4, 3), (0.7, 1, 4, 1), (0.9, 2, 8, 2)])
def test_chosen_path_finds_all(rows, sets, threshold, least, leaf, depth):
    got = similar_pairs(table_of(rows, sets), record="business_id", token="user_id", threshold=threshold, min_size=least, leaf=leaf, depth=depth, trees=16)
    found = {(r.record_1, r.record_2) for r in got.collect()}
    want = jaccard_pairs(sets, threshold, least)
    assert found <= want
    assert len(found) >= 0.99 * len(want)


def test_copies_are_one_class(rows):
    sets = {f"copy{k}": {"a", "b", "c"} for k in range(300)} | {"near": {"a", "b", "c", "d"}, "far": {"x", "y", "z"}}
    members, classes = similar_classes(table_of(rows, sets), record="business_id", token="user_id", threshold=0.5)
    pairs = classes.collect()
    assert [(r.class_1, r.class_2, r.n_both) for r in pairs] == [("copy0", "near", 3)]
    assert members.where("class_id = 'copy0'").count() == 300


def test_hot_record_is_salted(rows, sets, monkeypatch):
    import orebody.llm.chosen_path as chosen_path

    monkeypatch.setattr(chosen_path, "hot_buckets", lambda *a, **k: list(range(4096)))
    got = similar_pairs(table_of(rows, sets), record="business_id", token="user_id", threshold=0.5, min_size=5)
    assert {(r.record_1, r.record_2) for r in got.collect()} == jaccard_pairs(sets, 0.5, 5)


def test_deep_nodes_get_more_trees(rows):
    """Leaves of one record send every pair to the last level, where 12 trees find about 95 of 100 pairs at the threshold."""
    sets = {f"{side}{k}": {f"c{k}_{i}" for i in range(4)} | {f"{side}{k}_{i}" for i in range(2)} for k in range(600) for side in "ab"}
    got = similar_pairs(table_of(rows, sets).where("user_id != 'u1'"), record="business_id", token="user_id", threshold=0.5, min_size=5, leaf=1)
    found = {(r.record_1, r.record_2) for r in got.collect()}
    assert found <= {(f"a{k}", f"b{k}") for k in range(600)}
    assert len(found) >= 598


def test_trees_for_recall():
    for depth in range(1, 6):
        n = trees_for(0.5, 0.9995, depth)
        assert pair_recall(0.5, 0.5, n, depth) >= 0.9995 > pair_recall(0.5, 0.5, n - 1, depth)
        assert pair_recall(0.5, 0.5, 12, depth) < tree_recall(0.5, 0.5, 12, depth)


def test_chosen_path_edges(rows):
    empty = rows([], "business_id string, user_id string")
    assert similar_pairs(empty, record="business_id", token="user_id").count() == 0
    assert tree_recall(0.5, 0.5, 12, 1) > 0.9999 and tree_recall(0.5, 0.5, 12, 2) > 0.999
    assert 0 < sketch_cutoff(0.5) < 34
    with pytest.raises(ValueError):
        similar_pairs(empty, record="business_id", token="user_id", threshold=0)


def lift_pairs(baskets, least, ratio):
    one, two = Counter(), Counter()
    for b in baskets.values():
        one.update(b)
        two.update(combinations(sorted(b), 2))
    n = len(baskets)
    return {(a, b, c, one[a], one[b], n) for (a, b), c in two.items() if c >= least and c * n >= ratio * one[a] * one[b]}


@pytest.mark.parametrize(("block", "blocks", "few", "most", "cells"), [(2048, None, 1 << 20, 1 << 22, 1 << 20), (8, 3, 1 << 20, 1 << 22, 1 << 20), (8, 5, 0, 50, 1 << 20), (2048, 6, 1 << 20, 1 << 22, 40)])
def test_cooccurrence(rows, monkeypatch, block, blocks, few, most, cells):
    monkeypatch.setattr(cooccur, "BROADCAST_BYTES", few)
    monkeypatch.setattr(cooccur, "ROW_CELLS", cells)
    rng = random.Random(6)
    baskets = {}
    for u in range(400):
        group = rng.randrange(20)
        baskets[f"u{u}"] = {f"i{group}_{rng.randrange(6)}" for _ in range(rng.randint(1, 5))} | ({"hot"} if rng.random() < 0.6 else set())
    for u in range(12):  # more large baskets than are held back
        baskets[f"big{u}"] = {f"i{g}_{k}" for g in range(u % 3, 20, 3) for k in range(6)}
    data = [(u, i, 1) for u, b in baskets.items() for i in b]
    df = rows([*data, *data[:80], (None, "x", 1), ("u1", None, 1)], "user_id string, business_id string, n int")
    for least, ratio in ((8, 5.0), (3, 1.5)):
        got = cooccurring_pairs(df, basket="user_id", item="business_id", min_both=least, min_ratio=ratio, block=block, blocks=blocks, most=most)
        assert {(r.item_1, r.item_2, r.n_both, r.n_1, r.n_2, r.n_baskets) for r in got.collect()} == lift_pairs(baskets, least, ratio)
    assert cooccurring_pairs(df.where("false"), basket="user_id", item="business_id").count() == 0


@pytest.mark.parametrize(("blocks", "room", "most"), [(1, 1 << 22, 1 << 22), (4, 64, 1 << 22), (7, 64, 30)])
def test_blocked_gram(blocks, room, most):
    """Sums of block products are A'A, each pair once, at any size of blocks and pieces."""
    rng = np.random.default_rng(2)
    a = (rng.random((50, 20)) < 0.2).astype(int)
    total = np.zeros((20, 20), int)
    for p in range(blocks):
        takes = [q for q in range(20) if p == q % blocks or (p + q % blocks) % 2 == (q % blocks < p)]
        sums, found = BlockRow(most), []
        own, other = ([[i for i in np.flatnonzero(r) if i in some] for r in a] for some in (range(p, 20, blocks), takes))
        flat = [np.array([i for r in x for i in r], np.int64) for x in (own, other)]
        for x, y in products(flat[0], np.array([len(r) for r in own]), flat[1], np.array([len(r) for r in other]), room):
            i, j = flat[0][x], flat[1][y]
            keep = (i % blocks != j % blocks) | (i < j)
            found += sums.add((np.minimum(i, j)[keep] << 32) | np.maximum(i, j)[keep])
        for codes, counts in [*found, *sums.rest(1)]:
            np.add.at(total, (codes >> 32, codes & 0xFFFFFFFF), counts)
    assert (total == np.triu(a.T @ a, 1)).all()


ADDRESSES = [
    ("a", "#165-2376 Nojewe Ln", "TEBIZAS FALLS", "20258-7763"), ("b", "2376 Nojewe Lane, Unit 4, Tebizas Falls, QD 20258", None, None), ("c", "Sulasim Mall, Nojewe Ln, No 2376", "Tebizas Flals", "20258"),
    ("d", "2376 Nojwee Ln.", "Tebizas Falls", "202 58"), ("e", "2376 Nojewe", "Tebizas Falls", None), ("f", "2376 Nojewe St", "Tebizas Falls", "20258"), ("g", "2376 W Nojewe Ln", "Tebizas Falls", "20258"),
    ("h", "2377 Nojewe Ln", "Tebizas Falls", "20258"), ("i", "2376 Nojewe Ln", "Hanewund", "20036"), ("j", None, "Tebizas Falls", "20258"), ("k", "  ", "Tebizas Falls", "20258"), ("l", "79 E St. Velda Dr.", "North Saxofin", "20599"),
    ("m", "79 SAINT VELDA DRIVE EAST STE. 3", "N. Saxofin, XH", "20599"), ("n", "4 Twenty-First Avenue", "Kupimuv", "T8V 4N2"), ("o", "4, 21st Ave #9", "KUPIMUV", "t8v-4n2"), ("p", "4 22nd Ave", "Kupimuv", "t8v4n2"),
    ("q", "2376 Nojewe Ln", "Tebizas Falls", "20258"), ("r", "2376 nojewe ln", "tebizas falls ", "20258"), (None, "2376 Nojewe Ln", "Tebizas Falls", "20258"),
]


def test_same_locations(rows):
    more = [(f"x{k}", f"{k} Nojewe Ln", "Tebizas Falls", "20258") for k in range(8)] + [(f"y{k}", f"{k} Saint Velda Dr E", "North Saxofin", "20599") for k in range(8)]
    df = rows([*ADDRESSES, *ADDRESSES[:3], *more], "business_id string, address string, city string, postal_code string")
    df = df.withColumn("location", F.lit("here")).withColumn("number", F.lit(1)).withColumn("town", F.lit("x"))
    located = same_locations(df, key="business_id", address="address", city="city", postcode="postal_code")
    got = {tuple(r) for r in location_pairs(located, key="business_id").collect()}
    same = [set("abcdqr"), set("lm"), set("no")]
    want = {p for s in same for p in combinations(sorted(s), 2)}
    # without its type, e fits both Nojewe Ln and Nojewe St: it stays alone
    assert got == want
    alone = rows([r for r in ADDRESSES if r[0] not in ("f", "g")] + more, "business_id string, address string, city string, postal_code string")
    again = location_pairs(same_locations(alone, key="business_id", address="address", city="city", postcode="postal_code"), key="business_id")
    assert ("a", "e") in {tuple(r) for r in again.collect()}
    assert same_locations(df.where("false"), key="business_id", address="address", city="city", postcode="postal_code").count() == 0


def test_words_of_a_street_in_another_order(rows):
    spellings = [("a", "5 Old Mill Rd"), ("b", "5 Mill Old Rd"), ("c", "5 Oldmill Road"), ("d", "5 Mlil Old Rd"), ("e", "5 Mill Rd"), ("f", "5 Old Mill Bridge Rd")]
    others = [(f"{name}{k}", f"{k} {name} Rd") for name, times in (("Old Mill", 9), ("Mill Old", 4), ("Oldmill", 4), ("Mill", 4), ("Old Mill Bridge", 4)) for k in range(10, 10 + times)]
    df = rows([(k, x, "Tebizas Falls", "20258") for k, x in spellings + others], "business_id string, address string, city string, postal_code string")
    located = dict(map(tuple, same_locations(df, key="business_id", address="address", city="city", postcode="postal_code").collect()))
    assert located["a"] == located["b"] == located["c"] == located["d"]
    # a word left out makes another street
    assert len({located["a"], located["e"], located["f"]}) == 3
    assert assignment_cost(["old", "mill"], ["oldmill"]) == 0 and assignment_cost(["old", "2th"], ["old2th"]) > 1


def test_assignment_equals_brute_force():
    rng = random.Random(4)
    for _ in range(300):
        a, b = (["".join(rng.choices("ab", k=rng.randint(1, 3))) for _ in range(rng.randint(1, 5))] for _ in range(2))
        short, long = sorted((a, b), key=len)
        ways = [sum(edits(x, y) for x, y in zip(short, way)) + sum(map(len, long)) - sum(map(len, way)) for way in permutations(long, len(short))]
        joined = [edits("".join(a), "".join(b))] if len(a) != len(b) else []
        assert assignment_cost(a, b) == min(ways + joined)


def test_copies_of_a_table_change_nothing(rows):
    base = [(f"x{k}", f"{k} Nojewe Ln", "Tebizas Falls", "20258") for k in range(9)] + [("s", "4 Nojwee Ln", "Tebizas Falls", "20258"), ("t", "4 Nojete Ln", "Tebizas Falls", "20258"), ("u", "5 nojete ln", "Tebizas Falls", "20258"), ("v", "6 Nojete Lane", "Tebizas Falls", "20258")]
    names = "business_id string, address string, city string, postal_code string"
    found = []
    for times in (1, 6):
        df = rows([(f"{k}_{c}", *x) for k, *x in base for c in range(times)], names)
        located = dict(map(tuple, same_locations(df, key="business_id", address="address", city="city", postcode="postal_code").collect()))
        found.append({k: located[f"{k}_0"] for k, *_ in base})
    assert found[0] == found[1]
    assert found[0]["s"] == found[0]["x4"] != found[0]["t"]


def test_town_from_a_neighbouring_postcode(rows):
    df = rows([(f"x{k}", f"{k} Nojewe Ln", "Tebizas Falls", "20258") for k in range(6)] + [("a", "3 Nojewe Ln", None, "20251"), ("b", "3 Nojewe Ln", " ", "99999"), ("c", "3 Nojewe Ln", None, None)], "business_id string, address string, city string, postal_code string")
    located = dict(map(tuple, same_locations(df, key="business_id", address="address", city="city", postcode="postal_code").collect()))
    assert located["a"] == located["x3"] and "b" not in located and "c" not in located


def test_a_hot_location_is_split(rows, monkeypatch):
    import orebody.llm.addresses as addresses

    monkeypatch.setattr(addresses, "hot_buckets", lambda *a, **k: list(range(4096)))
    pairs = location_pairs(rows([(f"k{k}", "here") for k in range(30)] + [("z", "there")], "k string, location string"), key="k")
    assert {tuple(r) for r in pairs.collect()} == set(combinations(sorted(f"k{k}" for k in range(30)), 2))


@pytest.mark.parametrize(
    ("address", "want"),
    [
        ("Sulasim Mall, 68 S. Foundry St, Fl 8", ("68", "foundry", "st", "s")), ("ST VELDA HWY, NO 24 SUITE 116", ("24", "saint velda", "hwy", None)), ("3023 No. Wibaart", ("3023", "wibaart", None, "n")),
        ("Rumojo Pky 492, unit 238", ("492", "rumojo", "pkwy", None)), ("20, LEJOCATH SQ", ("20", "lejocath", "sq", None)), ("Suite 280\t7305 Pidopoen Square", ("7305", "pidopoen", "sq", None)),
        ("KAPEYI ARCADE, 58 FEHUJAL, Hirazem Junction, ZT Y6W-3R2", ("58", "fehujal", None, None)), ("4 Sibipa Pkwy W.", ("4", "sibipa", "pkwy", "w")), ("734 Twelfth Av. Suite 142", ("734", "12th", "ave", None)),
        ("S. Filipurt 728", ("728", "filipurt", None, "s")), ("Gigajart 2849, Lusepath Junction XK", ("2849", "gigajart", None, None)), ("Tower 5, 12 Main St", ("12", "main", "st", None)), ("Main Street", (None, "main", "st", None)), (",,", (None, None, None, None)), ("#", (None, None, None, None)), ("x" * 5000, (None, None, None, None)),
    ],
)
def test_parse(address, want):
    p = parse_address(address, None, None)
    assert (p.number, p.street, p.kind, p.direction) == want


def test_parts():
    assert town_of("N. Saxofin, XH") == town_of("NORTH SAXOFIN ") == "northsaxofin"
    assert town_of("Pipüner Hts") == "pipunerheights" and town_of(" ") is None
    assert postcode_of("20258-7763") == "20258" and postcode_of("h5z 0x2") == "h5z0x2" and postcode_of("12") is None
    assert edits("leajvand", "lejavand") == 1 and edits("", "ab") == 2
    words = "old mill upper canal saint velda north gate bridge end".split()
    assert assignment_cost(words, words[::-1]) == 0 and assignment_cost(words, [*words[:0:-1], "odl"]) == 1
    assert assignment_cost(["old", "mill"], ["mill", "old"]) == 0 and assignment_cost(["2th"], ["5th"]) == 99
