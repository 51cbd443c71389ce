import pytest

from loglattice.functions.signals import Question
from loglattice.operators import candidates as c
from loglattice.operators.selection import NeedsMore, Packet, select_packets

ASKED = Question(("disk", "lost"), (("uuid", "123e4567-e89b-12d3-a456-426614174000"),))
ROWS = [
    (1, "a", "disk disk fine", ["k1"]), (2, "a", "panic: disk lost", ["k1", None]), (3, "a", None, None), (4, "b", "no error here", ["k2"]),
    (5, "b", "restart 123e4567-e89b-12d3-a456-426614174000", ["k1", "k1"]), (6, "b", "", []),
]


@pytest.fixture(scope="module")
def blocks(spark):
    return spark.createDataFrame(ROWS, "block_id long, lane string, text string, keys array<string>")


def held(lane):
    return {(r["block_id"], r["facet_id"]): r["affinity"] for r in lane.affinities.collect()}


def weights(lane):
    return {r["facet_id"]: (r["kind"], r["weight"]) for r in lane.facets.collect()}


def test_lexical(blocks):
    lane = c.lexical(blocks, ASKED)
    got, w = held(lane), weights(lane)
    assert w["term:disk"] == ("query_term", 1_000_000 * 5 // 7) and w["identifier:uuid:123e4567-e89b-12d3-a456-426614174000"][1] == 1_000_000
    assert got[(5, "identifier:uuid:123e4567-e89b-12d3-a456-426614174000")] == 1_000_000
    # tf / (tf + 0.3 + 0.9 * length / mean length): 3 + 3 + 0 + 3 + 2 + 0 tokens in 6 blocks
    assert got[(1, "term:disk")] == 10 * 11 * 2 * 1_000_000 // (10 * 11 * 2 + 3 * 11 + 9 * 3 * 6)
    assert got[(1, "term:disk")] > got[(2, "term:disk")] and (1, "term:lost") not in got
    assert [tuple(r) for r in lane.mandatory.collect()] == [(5, "identifier:uuid:123e4567-e89b-12d3-a456-426614174000")]
    with pytest.raises(NeedsMore):
        c.lexical(blocks, ASKED, c.Bounds(identifier_blocks=0))
    with pytest.raises(NeedsMore):
        c.lexical(blocks, ASKED, c.Bounds(mandatory_blocks=0))


def test_coverage(blocks):
    lane = c.coverage(blocks)
    got, w = held(lane), weights(lane)
    assert {(2, "failure:panic"), (2, "first_failure:a"), (1, "before_failure:a"), (5, "onset:restart"), (5, "first_onset:b"), (4, "before_onset:b"), (1, "lane_head:a"), (6, "lane_tail:b"), (1, "retrieval_head"), (6, "retrieval_tail")} <= set(got)
    assert not [f for _, f in got if f == "failure:error"]  # "no error" is none
    assert w["lane_head:a"] == ("source_coverage_stratum", 250_000) and w["stratum:0/6"] == ("time_coverage_stratum", 250_000) and w["first_onset:b"] == ("onset_role", 1_000_000)
    assert sum(f.startswith("stratum:") for f in w) == 6


def test_provider(blocks):
    lane = c.provider(blocks)
    assert weights(lane) == {"relation:k1": ("provider_attested_graph_relation", 500_000)}
    assert set(held(lane)) == {(1, "relation:k1"), (2, "relation:k1"), (5, "relation:k1")}
    with pytest.raises(NeedsMore):
        c.provider(blocks, bounds=c.Bounds(key_blocks=2))


def test_merged_lanes_feed_the_selection(spark, blocks):
    both = c.merged([c.lexical(blocks, ASKED), c.coverage(blocks), c.provider(blocks)])
    w, kinds = {f: x[1] for f, x in weights(both).items()}, {f: x[0] for f, x in weights(both).items()}
    must = {r[0] for r in both.mandatory.collect()}
    packets = [Packet(i, 10, {f: a for (b, f), a in held(both).items() if b == i}, i in must) for i in range(1, 7)]
    chosen = select_packets(packets, w, 30, frozenset(f for f, k in kinds.items() if k in c.TOP_TWO))
    assert 5 in chosen and 2 in chosen and len(chosen) == 3
    clash = c.Lane(spark.createDataFrame([("term:disk", "other", 1)], c.FACETS), spark.createDataFrame([], c.AFFINITIES))
    with pytest.raises(c.FacetCollision):
        c.merged([both, clash])
    stray = c.Lane(spark.createDataFrame([], c.FACETS), spark.createDataFrame([(1, "nowhere", 5)], c.AFFINITIES))
    with pytest.raises(c.FacetCollision):
        c.merged([both, stray])
    more = c.Lane(spark.createDataFrame([], c.FACETS), spark.createDataFrame([(2, "term:disk", 999_999)], c.AFFINITIES))
    assert held(c.merged([both, more]))[(2, "term:disk")] == 999_999


def test_no_blocks(blocks):
    none = blocks.limit(0)
    both = c.merged([c.lexical(none, ASKED), c.coverage(none), c.provider(none)])
    assert both.affinities.count() == 0 and both.facets.count() == 3  # the question's own
    assert c.lexical(blocks, Question((), ())).affinities.count() == 0
