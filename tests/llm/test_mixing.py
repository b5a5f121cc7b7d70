import itertools

import pytest

from auditloom.llm.mixing import Flow, Target, _patterns, _placed, distinct_texts, mix_shares, mixture, plan_mix, read_targets, repetitions

DOCS = "doc_id long, text string, source string, members string, tokens long"
TARGETS = "source string, target_weight double, max_repeats int, extra string"


def frames(spark, docs, targets):
    return spark.createDataFrame([(*d, "clash", 1) for d in docs], DOCS), spark.createDataFrame([(*t, "x") for t in targets], TARGETS)


def test_flow_costs_least():
    f = Flow(4)
    arcs = [f.add(0, 2, 5, 1), f.add(0, 3, 5, 3), f.add(2, 1, 4), f.add(3, 1, 9)]
    assert f.run(0, 1) == 9
    assert [f.left[e ^ 1] for e in arcs] == [4, 5, 4, 5]


@pytest.mark.parametrize("patterns", [[(("a",), 10), (("a", "b"), 20), (("b",), 3)], [(("a", "b", "c"), 12), (("c",), 1)], [(("a",), 7), (("b",), 5), (("b", "c"), 6), (("a", "c"), 4)]])
def test_largest_mix_against_subsets(patterns):
    targets = [Target("a", 0.5, 1), Target("b", 0.3, 3), Target("c", 0.2, 2)]
    quotas, draws = plan_mix(patterns, targets)
    held = sorted({s for m, _ in patterns for s in m})
    weight = {t.source: t.weight for t in targets if t.source in held}
    cap = {t.source: t.repeats for t in targets}
    room = lambda own: sum(n * min(cap[s] for s in m) for m, n in patterns if set(m) & set(own))
    bound = min(room(own) * sum(weight.values()) / sum(weight[s] for s in own) for k in range(1, len(held) + 1) for own in itertools.combinations(held, k))
    assert bound - len(held) - 1 <= sum(quotas.values()) <= bound + len(held)
    for s in held:
        assert sum(d.routed.get(s, 0) for d in draws) == quotas[s]
    for d in draws:
        assert sum(d.routed.values()) <= d.tokens * d.cap


def test_repeats_cost_more_than_fresh_tokens():
    quotas, draws = plan_mix([(("a",), 10), (("a", "b"), 10)], [Target("a", 0.5, 4), Target("b", 0.5, 4)], total=20)
    assert {d.members: sum(d.routed.values()) for d in draws} == {("a",): 10, ("a", "b"): 10}


def test_caps_and_defined_cases(spark):
    docs = [(i, f"text number {i} of a", "A ") for i in range(30)] + [(100 + i, f"text number {i} of b", "b") for i in range(4)] + [(200, "text number 0 of a", "b"), (201, None, "a"), (202, "", "a"), (203, "zzz", None), (204, "no target", "c")]
    d, t = frames(spark, docs, [("a", 0.5, 1), (" B", 0.4, 3), ("ghost", 0.1, 2)])
    got = mixture(d, t).collect()
    assert len({(r.doc_id, r.copy_no) for r in got}) == len(got)
    per = {i: sum(r.doc_id == i for r in got) for i in {r.doc_id for r in got}}
    assert all(n <= (1 if i < 100 else 3) for i, n in per.items()) and not {200, 201, 202, 203, 204} & set(per)
    assert got == mixture(d, t).collect()
    shares = {r.source: r for r in mix_shares(d, t).collect()}
    assert shares["ghost"].effective_share == 0 and abs(shares["b"].effective_share - 4 / 9) < 1e-9
    assert shares["ghost"].tokens_drawn == 0 and abs(shares["a"].actual_share - 5 / 9) < 0.15 and abs(sum(s.actual_share for s in shares.values()) - 1) < 1e-9


def test_empty(spark):
    d, t = frames(spark, [], [("a", 1.0, 1)])
    assert mixture(d, t).count() == 0
    d, t = frames(spark, [(1, "x", "a")], [])
    assert mixture(d, t).count() == 0 and mix_shares(d, t).count() == 0


def test_places_are_prefix_sums(spark):
    d, t = frames(spark, [(i, f"text {i}", "a" if i % 3 else "b") for i in range(200)], [("a", 0.5, 1), ("b", 0.5, 1)])
    rows = _placed(distinct_texts(d, read_targets(t)), 7, bucket_rows=10).collect()
    for members in (["a"], ["b"]):
        at = 0
        for r in sorted((r for r in rows if r.members == members), key=lambda r: (r.order_ & (2**64 - 1), r.h1, r.h2)):
            assert r.start == at
            at += r.n_tokens


def test_large_caps_need_few_arcs_and_rows(spark):
    assert repetitions(16) == [(i, 1) for i in range(16)]
    costs = [c for c, _ in repetitions(10**6)]
    assert costs == sorted(costs) and sum(n for _, n in repetitions(10**6)) == 10**6
    d, t = frames(spark, [(i, f"text number {i} of a", "a") for i in range(400)] + [(1000, "one of b", "b")], [("a", 0.5, 1), ("b", 0.5, 10**9)])
    shares = {r.source: r for r in mix_shares(d, t).collect()}
    assert shares["a"].n_drawn == 400 and abs(shares["b"].actual_share - 0.5) < 0.01 and shares["b"].most_copies == shares["b"].n_drawn > 400


def test_shares_meet_caps_and_quotas(spark, sf):
    docs, targets = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "mix_targets"))
    longest = max(r.n_tokens for r in mixture(docs, targets).collect())
    for r in mix_shares(docs, targets).collect():
        assert r.most_copies <= r.max_repeats and abs(r.tokens_drawn - r.quota) <= 8 * longest


def test_too_many_patterns_are_refused(spark):
    d, t = frames(spark, [(1, "x", "a"), (2, "y", "b")], [("a", 0.5, 1), ("b", 0.5, 1)])
    with pytest.raises(ValueError, match="combinations"):
        _patterns(distinct_texts(d, read_targets(t)), most=1)
