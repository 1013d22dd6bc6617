"""Detectors with own definitions against brute force: set overlap, running maxima, circular hours, journeys, profiles."""

import datetime as dt
import math
import random
from collections import Counter, defaultdict
from itertools import combinations

import pytest

from leadspark.functions import setjoin
from leadspark.functions.checks import ParameterError
from leadspark.functions.ordered import with_highest_before
from leadspark.operators import networks, profiles, sequences
from leadspark.plans import registry

# ---------------------------------------------------------------- sets


def random_edges(seed, members=90):
    rng = random.Random(seed)
    edges = set()
    for member in range(members):
        # A third of all members hold entity 0, two thirds one of five common ones.
        edges |= {(member, 0)} if member % 3 == 0 else {(member, rng.randint(1, 5))}
        edges |= {(member, rng.randint(1, 30)) for _ in range(rng.randint(0, 8))}
    largest = max(range(members), key=lambda member: sum(m == member for m, _ in edges))
    base = [e for m, e in edges if m == largest]
    edges |= {(1000 + k, e) for k in range(20) for e in base}  # copies
    edges |= {(2000, e) for e in [*base, 77]} | {(2001, e) for e in base[1:]}
    return edges


def classes(edges):
    held = defaultdict(set)
    for member, entity in edges:
        held[member].add(entity)
    groups = defaultdict(list)
    for member, entities in held.items():
        groups[frozenset(entities)].append(member)
    return {min(members): (entities, len(members)) for entities, members in groups.items()}


def pairs(edges, fits):
    sets = classes(edges)
    found = set()
    for a, (one, copies) in sets.items():
        if copies > 1 and fits(len(one), len(one), len(one)):
            found.add((a, a, copies, copies, len(one), len(one), len(one)))
        for b, (other, others) in sets.items():
            if a < b and fits(len(one & other), len(one), len(other)):
                found.add((a, b, copies, others, len(one), len(other), len(one & other)))
    return found


NAMES = ("member_id", "other_id", "members", "others", "member_entities", "other_entities", "common_entities")


def edge_frame(spark, edges):
    rows = [*edges, *list(edges)[:30], (None, 3), (5, None)]
    return spark.createDataFrame(rows, "member long, entity long").selectExpr("*", "1 AS size", "2 AS place", "3 AS sets")


@pytest.mark.parametrize("hot", [1000, 2])
def test_overlap_and_cloning_equal_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(setjoin, "HOT_ENTITY", hot)
    edges = random_edges(hot)
    frame = edge_frame(spark, edges)
    for least in (2, 4):
        got = {tuple(row[n] for n in NAMES) for row in networks.cross_commit_overlap(frame, minimum_common=least).collect()}
        assert got == pairs(edges, lambda common, a, b: common >= least)
        assert any(row[2] == 21 for row in got)
    for percent in (51, 80, 100):
        found = networks.portfolio_cloning(frame, minimum_similarity=percent / 100).collect()
        assert {tuple(row[n] for n in NAMES) for row in found} == pairs(edges, lambda c, a, b: 100 * c >= percent * (a + b - c))
        assert all(row.similarity >= percent / 100 - 1e-12 for row in found)


def test_an_entity_of_everybody_pairs_nobody(spark):
    edges = [(m, 0) for m in range(3000)] + [(m, 1) for m in range(3000)] + [(m, 10 + m) for m in range(3000)]
    frame = spark.createDataFrame(edges, "member long, entity long")
    placed = setjoin.by_rarity(setjoin.distinct_sets(frame)[1])
    prefix = placed.where("place <= size - 3 + 1")
    assert prefix.where("entity < 2").count() == 0
    assert networks.cross_commit_overlap(frame, minimum_common=3).count() == 0


def test_an_entity_of_many_small_sets_leads_to_pairs_with_a_second_only(spark):
    edges = [(m, e) for m in range(400) for e in (0, 1 + m % 7, 10 + m % 11, 30 + m % 13, 50 + m % 17)]
    placed = setjoin.by_rarity(setjoin.distinct_sets(spark.createDataFrame(edges, "member long, entity long"))[1])
    tokens = setjoin._tokens(placed, lambda size: size - 3 + 1)
    assert tokens.where("second IS NULL").count() == 0
    # Places 1 to 3 of five, each with the later ones up to 4.
    assert tokens.count() == 400 * 6


def test_two_entities_that_many_sets_show_lead_to_pairs_with_a_third_only(spark):
    sets = [{0, 1, *rest} for size in (2, 3) for rest in combinations(range(10, 20), size)]
    sets += [{10 + n % 10, 100 + 2 * n, 101 + 2 * n} for n in range(2500)]
    edges = [(m, e) for m, entities in enumerate(sets) for e in entities]
    frame = spark.createDataFrame(edges, "member long, entity long")
    made = []
    candidates = setjoin._candidates
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(setjoin, "_candidates", lambda *given: made.append(candidates(*given)) or made[-1])
        found = networks.portfolio_cloning(frame, minimum_similarity=0.7).collect()
    # 45 sets of four in 120 of five; all of them show 0 and 1, each small one is in eight large ones.
    assert {(row.member_id, row.other_id) for row in found} == {
        (a, b) for a in range(45) for b in range(45, 165) if sets[a] < sets[b]
    }
    assert len(found) == 360
    assert made[0].count() < 45 * 120 / 2


def test_sets_that_fit_no_other_set_look_for_none(spark):
    edges = [(m, e) for m in range(50) for e in (0, 1 + m)] + [(m, e) for m in range(50, 60) for e in (0, 1, m, m + 1)]
    frame = spark.createDataFrame(edges, "member long, entity long")
    placed = []
    with pytest.MonkeyPatch.context() as patch:
        number = setjoin.by_rarity
        patch.setattr(setjoin, "by_rarity", lambda held: placed.append(number(held)) or placed[-1])
        assert networks.portfolio_cloning(frame, minimum_similarity=0.7).count() == 0
    # Two of three are less than 0.7: sets of two entities have no partner.
    assert {row.member for row in placed[0].collect()} == set(range(50, 60))


def test_members_in_parts_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(setjoin, "ONE_PART", 3)
    edges = random_edges(5)
    placed = defaultdict(list)
    for row in setjoin.by_rarity(setjoin.distinct_sets(edge_frame(spark, edges))[1]).collect():
        placed[row.member].append((row.place, row.sets))
    assert any(len(held) > 3 for held in placed.values())
    for held in placed.values():
        held.sort()
        assert [p for p, _ in held] == list(range(1, len(held) + 1))
        assert [s for _, s in held] == sorted(s for _, s in held)
    found = networks.portfolio_cloning(edge_frame(spark, edges), minimum_similarity=0.6).collect()
    assert {tuple(row[n] for n in NAMES) for row in found} == pairs(edges, lambda c, a, b: 10 * c >= 6 * (a + b - c))


def test_places_number_the_entities_from_the_rarest(spark):
    edges = random_edges(9)
    kept = {m for m in classes(edges)}
    counts = Counter(e for m, e in edges if m in kept)
    placed = defaultdict(list)
    for row in setjoin.by_rarity(setjoin.distinct_sets(edge_frame(spark, edges))[1]).collect():
        assert row.sets == counts[row.entity]
        placed[row.member].append((row.place, row.sets))
    assert set(placed) == kept
    for held in placed.values():
        held.sort()
        assert [p for p, _ in held] == list(range(1, len(held) + 1))
        assert [s for _, s in held] == sorted(s for _, s in held)


def test_networks_edge_cases(spark):
    empty = spark.createDataFrame([], "member string, entity string")
    assert networks.cross_commit_overlap(empty).count() == 0
    assert networks.portfolio_cloning(empty).count() == 0
    for bad in (1, True, 2.5):
        with pytest.raises(ParameterError):
            networks.cross_commit_overlap(empty, minimum_common=bad)
    with pytest.raises(ParameterError):
        networks.portfolio_cloning(empty, minimum_similarity=0.5)


def chains(edges):
    """(root, hops, chain) by entity: breadth first from the smallest entity of each component."""
    users = defaultdict(set)
    for entity, kind, identifier in edges:
        users[kind, identifier].add(entity)
    beside = defaultdict(set)
    for key, entities in users.items():
        for entity in entities if len(entities) > 1 else ():
            beside[entity] |= {(key, other) for other in entities if other != entity}
    found = {}
    for root in sorted(beside):
        if root in found:
            continue
        found[root] = (root, 0, str(root))
        level = [root]
        while level:
            offers = defaultdict(list)
            for entity in level:
                for (kind, identifier), other in beside[entity]:
                    if other not in found:
                        offers[other].append(f"{found[entity][2]} [{kind} {identifier}] {other}")
            hops = found[level[0]][1] + 1
            for other, texts in offers.items():
                found[other] = (root, hops, min(texts))
            level = list(offers)
    return found


def test_shared_identifiers_equal_breadth_first_search(spark):
    rng = random.Random(8)
    edges = {(i, "phone", str(rng.randint(0, 60))) for i in range(90)} | {(i, "office", "Main") for i in range(0, 90, 3)}
    edges |= {(200 + i, "line", str(i // 2)) for i in range(14)} | {(200 + i, "rope", str((i + 1) // 2)) for i in range(14)}
    edges |= {(300, "phone", "only"), (301, "line", "60")}
    rows = [*edges, *list(edges)[:20], (None, "phone", "1"), (5, None, "1"), (5, "phone", None)]
    frame = spark.createDataFrame(rows, "entity long, kind string, identifier string").selectExpr("*", "1 AS root", "2 AS best")
    want = chains(edges)
    got = networks.shared_identifiers(frame).collect()
    assert {row.entity: (row.cluster_id, row.hops, row.chain) for row in got} == want
    assert max(hops for _, hops, _ in want.values()) > 10
    sizes = Counter(root for root, _, _ in want.values())
    assert all(row.entities == sizes[row.cluster_id] for row in got)
    only = networks.shared_identifiers(frame, kinds=["line"], minimum_entities=3).collect()
    assert only == []
    wide = networks.shared_infrastructure(frame, minimum_entities=3).collect()
    users = defaultdict(set)
    for entity, kind, identifier in edges:
        users[kind, identifier].add(entity)
    used = {key: entities for key, entities in users.items() if len(entities) >= 3}
    others = {entity: sum(entity in e for e in used.values()) - 1 for e in used.values() for entity in e}
    assert {(r.kind, r.identifier): (r.entities, r.first_entity, r.last_entity, r.co_identifiers) for r in wide} == {
        key: (len(e), min(e), max(e), max(others[x] for x in e)) for key, e in used.items()
    }
    assert networks.shared_identifiers(frame.limit(0)).count() == networks.shared_infrastructure(frame.limit(0)).count() == 0


# ---------------------------------------------------------------- sequences

DAY = dt.datetime(2024, 3, 1)


@pytest.mark.parametrize("partitions", [1, 7])
def test_running_maximum_over_ranges(spark, partitions):
    rng = random.Random(partitions)
    rows = [("hot" if i % 2 else rng.choice(["a", "b", None]), i // 2, rng.randint(0, 1000), i) for i in range(300)]
    frame = spark.createDataFrame(rows, "k string, s long, v long, i long").repartition(5)
    got = {r.i: r.high for r in with_highest_before(frame, ["k"], ["s", "i"], frame["v"], "high", partitions=partitions).collect()}
    assert len(got) == len(rows)
    for k, s, _, i in rows:
        before = [v for k2, s2, v, i2 in rows if k2 == k and (s2, i2) < (s, i)]
        assert got[i] == max(before, default=None)


def test_backdated_records_equal_brute_force(spark):
    rng = random.Random(2)
    rows = []
    for i in range(200):
        entity = "hot" if i % 3 else rng.choice(["a", None])
        rows.append((i, entity, rng.randint(0, 60), DAY + dt.timedelta(days=rng.randint(0, 40), hours=rng.randint(0, 23))))
    rows += [(900, "a", None, DAY), (901, "a", 5, None), (None, "solo", 1, DAY)]
    frame = spark.createDataFrame(rows, "id long, entity string, sequence long, observed_at timestamp")
    for least in (0, 3):
        got = {(r.candidate_id, r.latest_before, r.latest_id, r.days_back) for r in sequences.backdated_records(frame, minimum_days=least, partitions=6).collect()}
        want = set()
        for id_, entity, number, at in rows:
            before = [(t, i) for i, e, s, t in rows if e == entity and None not in (s, t, number, at) and s < number]
            if before and max(before)[0] > at and ((max(before)[0].date() - at.date()).days) >= least:
                want.add((f"row-{id_}", *max(before), (max(before)[0].date() - at.date()).days))
        assert got == want
    plan = sequences.backdated_records(frame)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    assert sequences.backdated_records(frame.limit(0)).count() == 0


def activity(entity, start, hours, n=30):
    return [(entity, start + dt.timedelta(days=i % 28, hours=hours[i % len(hours)])) for i in range(n)]


def test_activity_shifts_cross_midnight(spark):
    march, april = DAY, dt.datetime(2024, 4, 1)
    rows = activity("near", march, [23.5]) + activity("near", april, [0.5])  # one hour, not 23
    rows += activity("moved", march, [23, 1]) + activity("moved", april, [4, 6])  # from 0 to 5
    rows += activity("back", march, [1]) + activity("back", april, [20])  # five hours back
    rows += activity("spread", march, [0, 12]) + activity("spread", april, [5])  # no direction
    rows += activity("few", march, [3], 5) + activity("few", april, [9])
    rows += activity("gap", march, [3]) + activity("gap", dt.datetime(2024, 6, 1), [9]) + [(None, march), ("x", None)]
    frame = spark.createDataFrame(rows, "entity string, observed_at timestamp")
    got = {r.entity: (round(r.previous_hour, 6) % 24, round(r.mean_hour, 6), round(r.shift_hours, 6)) for r in sequences.timezone_activity_shifts(frame).collect()}
    assert got == {"moved": (0, 5, 5), "back": (1, 20, -5), "gap": (3, 9, 6)}
    close = sequences.timezone_activity_shifts(frame, minimum_shift_hours=1.0).collect()
    assert {(r.entity, round(r.shift_hours, 6)) for r in close} >= {("near", 1.0)}
    assert sequences.timezone_activity_shifts(frame.limit(0)).count() == 0
    with pytest.raises(ParameterError):
        sequences.timezone_activity_shifts(frame, period="day")


def test_activity_shifts_of_exactly_the_minimum_follow_the_arithmetic_on_hours(spark):
    """The last digit decides at a shift of three hours, so steps are those of the reference SQL."""

    def mean_hour(hours):
        angles = [2 * math.pi * h / 24 for h in hours]
        y, x = (sum(map(f, angles)) / len(hours) for f in (math.sin, math.cos))
        return (24 if math.atan2(y, x) < 0 else 0) + math.atan2(y, x) * 12 / math.pi

    rows, want = [], set()
    for first in range(24):
        before, after, entity = [first] * 2, [(first + 3) % 24] * 2, str(first)
        rows += [(entity, dt.datetime(2024, 1, 2, h)) for h in before] + [(entity, dt.datetime(2024, 1, 9, h)) for h in after]
        shift = mean_hour(after) - mean_hour(before)
        if abs(shift + 24 if shift <= -12 else shift) >= 3:
            want.add(entity)
    frame = spark.createDataFrame(rows, "entity string, observed_at timestamp")
    found = sequences.timezone_activity_shifts(frame, period="week", minimum_events=2).collect()
    assert {row.entity for row in found} == want


def kilometres(a, b):
    (la, lo), (lb, lp) = a, b
    la, lo, lb, lp = map(math.radians, (la, lo, lb, lp))
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((lp - lo) / 2) ** 2
    return 2 * 6371.0 * math.asin(math.sqrt(h))


def test_location_conflicts_show_every_impossible_journey(spark):
    rng = random.Random(4)
    places = {"oslo": (59.9, 10.7), "rome": (41.9, 12.5), "suva": (-18.1, 178.4), "apia": (-13.8, -171.8)}
    first, second = [], []
    for entity in [*(f"e{i}" for i in range(12)), *["hot"] * 10]:
        at = DAY
        for _ in range(rng.randint(1, 6)):
            at += dt.timedelta(hours=rng.choice([0, 1, 4, 30]))
            rng.choice([first, second]).append((entity, at, *places[rng.choice(list(places))]))
    broken = [("e0", DAY, 91.0, 0.0), ("e1", None, 1.0, 1.0), (None, DAY, 1.0, 1.0), ("e2", DAY, None, 1.0)]
    schema = "entity string, observed_at timestamp, latitude double, longitude double"
    frames = [spark.createDataFrame(rows, schema) for rows in (first + broken, second)]
    got = sequences.location_conflicts(*frames).collect()
    held = defaultdict(set)
    for entity, at, la, lo in first + second:
        held[entity].add((at, la, lo))
    impossible = set()
    for entity, fixes in held.items():
        for t, *p in fixes:
            for u, *q in fixes:
                km, hours = kilometres(p, q), (u - t).total_seconds() / 3600
                if t <= u and km >= 50 and (hours == 0 or km / hours > 900):
                    impossible.add(entity)
    assert {row.entity for row in got} == impossible
    for row in got:
        assert row.hours == pytest.approx((row.observed_at - row.previous_at).total_seconds() / 3600)
        assert row.speed_kmh is None if row.hours == 0 else row.speed_kmh > 900
    assert kilometres(places["suva"], places["apia"]) < 1300  # across the date line
    assert sequences.location_conflicts(frames[0].limit(0), frames[1].limit(0)).count() == 0


# ---------------------------------------------------------------- profiles


def test_conflicting_profiles_equal_brute_force(spark):
    rng = random.Random(6)
    rows = [(rng.choice([1, 1, 1, 2, 3, None]), rng.choice(["Oslo", " oslo ", "ROME", "", None]), rng.choice([10, 20, None])) for _ in range(120)]
    rows += [(7, "One", 1), (7, "one ", 1), (8, "b", 2), (8, "a", 2)]
    frame = spark.createDataFrame(rows, "id long, town string, code int").withColumnRenamed("code", "a b")
    want = {}
    for name, column in (("town", 1), ("a b", 2)):
        held = defaultdict(Counter)
        for row in rows:
            value = " ".join(str(row[column]).lower().split()) if row[column] is not None else ""
            if row[0] is not None and value:
                held[row[0]][value] += 1
        for id_, counts in held.items():
            if len(counts) > 1:
                best = min(counts, key=lambda v: (-counts[v], v))
                want[id_, name] = (len(counts), best, counts[best], sum(counts.values()) - counts[best])
    got = profiles.conflicting_profiles(frame).collect()
    assert {(r.entity_id, r.attribute): (r.distinct_values, r.majority_value, r.support, r.contradicting) for r in got} == want
    assert {(r.entity_id, r.attribute) for r in profiles.conflicting_profiles(frame, attributes=["town"]).collect()} == {k for k in want if k[1] == "town"}
    assert profiles.conflicting_profiles(frame.limit(0)).count() == 0
    for bad in (["id"], [], ["nope"], ["town", "town"]):
        with pytest.raises(ParameterError):
            profiles.conflicting_profiles(frame, attributes=bad)


# ---------------------------------------------------------------- registry


def test_drafts_run_by_id_but_are_not_offered(spark):
    assert not {draft.id for draft in registry.DRAFTS} & set(registry.detectors())
    edges = spark.createDataFrame([(m, e) for m in (1, 2) for e in "abc"] + [(3, "a")], "who long, what string")
    request = {"id": "network.cross_commit_overlap", "fields": {"member": "who", "entity": "what"}}
    found = registry.run_detectors(edges, [request]).collect()
    assert [(row.detector_id, row.candidate_id, row.category) for row in found] == [("network.cross_commit_overlap", "overlap-1-1", "network")]
    for draft in registry.DRAFTS:
        with pytest.raises(registry.RequestError):
            registry.register_detector(draft.id, "SELECT 1", roles=["id"])
