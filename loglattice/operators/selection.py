"""Bounded choices at the end of a search: packing, tournaments, quotas, budgeted selection.

Most of these are sequential by nature and work on a candidate pool the search
has bounded already (a few hundred cards, or ``MOST_PACKETS`` packets); a
larger pool is refused, never cut. ``select_rows`` and ``quota_hybrid_paged``
take pools of any size: each step asks the whole table for the next best.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window, functions as F

from loglattice.session import cut

SCALE = 1_000_000
MOST_PACKETS = 4096
PRIORITY_PART = 100_000_000  # a packet of the highest priority (SCALE) counts a hundredth more
PAGE, PER_PAGE, FINAL = 64, 8, 12
COVERAGE_PART = 8


class NeedsMore(ValueError):
    """A bound was passed; nothing partial is returned."""


# --- packing ---


PACKING_PAGE = 512


def skip_packing_by(rows: DataFrame, key: str, order: Sequence[tuple[str, bool]], id: str, cost: str, budget: int, page: int = PACKING_PAGE, most: int = 1 << 31) -> DataFrame:
    """Per key the ids taken in an order (column, descending), at most ``most``, leaving out each that no longer fits; keys of any size.

    Keys are read by pages in the order, all keys at once: each round takes the
    next ``page`` rows that come after the last one seen and cost no more than is
    left, and ends when there are none. What costs more than is left never fits
    later, so leaving it out changes nothing. ``order`` must be total within a
    key; costs aren't negative. Rows with a null key, id or cost take no part.
    """
    place = F.struct(*[(-F.col(c) if down else F.col(c)).alias(f"p{i}") for i, (c, down) in enumerate(order)])
    clean = rows.where(F.col(key).isNotNull() & F.col(id).isNotNull() & F.col(cost).isNotNull())
    all_rows = clean.select(F.col(key).alias("k"), F.col(id).cast("long").alias("id"), F.col(cost).cast("long").alias("cost"), place.alias("place"))
    taken: DataFrame | None = None
    state: DataFrame | None = None
    while True:
        if state is None:
            here = all_rows.withColumns({"left": F.lit(budget).cast("long"), "room": F.lit(most).cast("long")}).where((F.col("cost") <= budget) & F.lit(most > 0))
        else:
            here = all_rows.join(state, "k").where((F.col("place") > F.col("after")) & (F.col("cost") <= F.col("left")) & (F.col("room") > 0)).drop("after")
        first = here.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("place"))).where(F.col("n") <= page)
        heads = first.groupBy("k").agg(F.first("left").alias("left"), F.first("room").alias("room"), F.max("place").alias("after"), F.array_sort(F.collect_list(F.struct("n", "id", "cost"))).alias("l"))
        start = F.struct(F.col("left").alias("left"), F.array().cast("array<bigint>").alias("ids"))

        def take(acc: Column, x: Column) -> Column:
            fits = (x["cost"] <= acc["left"]) & (F.size(acc["ids"]) < F.col("room"))
            return F.struct(F.when(fits, acc["left"] - x["cost"]).otherwise(acc["left"]).alias("left"), F.when(fits, F.concat(acc["ids"], F.array(x["id"]))).otherwise(acc["ids"]).alias("ids"))

        step = cut(heads.select("k", "after", "room", F.aggregate("l", start, take).alias("r")))
        ids = step.select(F.col("k").alias(key), F.explode("r.ids").alias(id))
        taken = ids if taken is None else taken.unionByName(ids)
        if step.limit(1).count() == 0:
            return taken
        state = step.select("k", "after", F.col("r.left").alias("left"), (F.col("room") - F.size("r.ids")).alias("room"))


def pack(order: Sequence[tuple[int, int]], budget: int) -> tuple[list[int], bool]:
    """(id, cost) in order -> ids that fit, and whether any was left out."""
    taken, skipped = [], False
    for i, cost in order:
        if cost <= budget:
            taken.append(i)
            budget -= cost
        else:
            skipped = True
    return taken, skipped


# --- tournament ---

Selector = Callable[[list[dict], int], list[int]]


def first_ids(cards: list[dict], most: int) -> list[int]:
    """The baseline selector: the first cards as they come."""
    return [c["group_id"] for c in cards[:most]]


def gravest(cards: list[dict], most: int) -> list[int]:
    rank = {"critical": 0, "error": 1, "warning": 2, "change": 3}
    return [c["group_id"] for c in sorted(cards, key=lambda c: rank.get(c["role"], 4))[:most]]


def _checked(picks: list[int], offered: list[dict], most: int) -> list[int]:
    known = {c["group_id"] for c in offered}
    if len(picks) > most or len(set(picks)) < len(picks) or not known.issuperset(picks):
        raise ValueError("a selector must give distinct ids of the cards it was offered, at most as many as asked")
    return picks


def tournament(cards: Sequence[dict], select: Selector = first_ids, carried: Sequence[Sequence[int]] = ()) -> tuple[list[int], int]:
    """Pages of 64 give 8 winners each until one page is left, which gives the final 12.

    ``carried`` lists of ids go ahead of the winners in every round, while
    still in the pool. Gives the final ids and the number of cards pruned.
    """
    pool, pruned = list(cards), 0
    while len(pool) > PAGE:
        by_id = {c["group_id"]: c for c in pool}
        ahead = [i for ids in carried for i in ids if i in by_id]
        winners = [i for at in range(0, len(pool), PAGE) for i in _checked(select(pool[at : at + PAGE], PER_PAGE), pool[at : at + PAGE], PER_PAGE)]
        kept = list(dict.fromkeys(ahead + winners))
        if len(kept) >= len(pool):
            raise NeedsMore("a round must shrink the pool")
        pruned += len(pool) - len(kept)
        pool = [by_id[i] for i in kept]
    return _checked(select(pool, FINAL), pool, FINAL), pruned


# --- quotas ---


def quota_hybrid(lanes: Sequence[tuple[Sequence[int], int]], costs: dict[int, int], budget: int) -> list[int]:
    """Lanes (ordered ids, bytes reserved): each spends its own bytes, then what is left goes round by position, lane after lane.

    An id another lane has taken costs nothing more. Gives ids in source order.
    """
    taken: set[int] = set()
    left = budget
    tried: set[int] = set()
    for ids, own in lanes:
        own = min(own, left)
        for i in ids:
            if i not in taken and costs[i] <= own:
                taken.add(i)
                own -= costs[i]
                left -= costs[i]
    for at in range(max((len(ids) for ids, _ in lanes), default=0)):
        for ids, _ in lanes:
            if at < len(ids) and (i := ids[at]) not in taken and i not in tried:
                tried.add(i)
                if costs[i] <= left:
                    taken.add(i)
                    left -= costs[i]
    return sorted(taken)


Page = Callable[[object, int], list[tuple[object, int, int]]]


def _skip_pages(page: Page, after: object, budget: int, known: set[int]) -> dict[int, int]:
    """Ids (with costs) taken in order, leaving out known ones and those that don't fit.

    ``page(after, left)`` gives the next (place, id, cost) with a cost of at
    most ``left`` in order, some of them or none at the end. What costs more than is
    left never fits later, so passing over it changes nothing.
    """
    taken: dict[int, int] = {}
    while rows := page(after, budget):
        for after, i, cost in rows:
            if i not in known and i not in taken and cost <= budget:
                taken[i] = cost
                budget -= cost
    return taken


def quota_hybrid_paged(page: Page, head: Sequence[tuple[object, int, int]], own: int, lanes: Sequence[tuple[Sequence[int], int]], costs: dict[int, int], budget: int) -> dict[int, int]:
    """As quota_hybrid with a first lane of any length, read by pages; gives ids with costs in source order.

    ``head`` is the beginning of that lane, of whatever cost, at least as long as
    every other lane or the whole of it: there positions matter.
    """
    if head and len(head) < max((len(ids) for ids, _ in lanes), default=0) and page(head[-1][0], budget):
        raise ValueError("the head of the first lane must be as long as the other lanes")
    costs = dict(costs) | {i: cost for _, i, cost in head}
    began = [i for _, i, _ in head]
    first: dict[int, int] = {}
    left = min(own, budget)
    for i in began:
        if i not in first and costs[i] <= left:
            first[i] = costs[i]
            left -= costs[i]
    end = head[-1][0] if head else None
    more = _skip_pages(page, end, left, set(first)) if head else {}
    costs |= more
    chosen = quota_hybrid([([*began, *more], own), *lanes], costs, budget)
    out = {i: costs[i] for i in chosen}
    if head:
        out |= _skip_pages(page, end, budget - sum(out.values()), set(out))
    return dict(sorted(out.items()))


# --- budgeted selection ---


@dataclass
class Packet:
    """id, cost, affinities by facet; mandatory ones are taken first; coverage-only ones share an eighth of what is left."""

    id: int
    cost: int
    affinities: dict[str, int] = field(default_factory=dict)
    mandatory: bool = False
    coverage_only: bool = False


class _Cover:
    def __init__(self, weights: dict[str, int], two: frozenset[str]):
        self.weights, self.two = weights, two
        self.best: dict[str, tuple[int, int]] = {}

    def gain(self, p: Packet) -> int:
        total = 0
        for f, a in p.affinities.items():
            x, y = self.best.get(f, (0, 0))
            total += self.weights[f] * max(a - (y if f in self.two else x), 0)  # it takes the place of the least that counts
        return total

    def add(self, p: Packet) -> None:
        for f, a in p.affinities.items():
            x, y = self.best.get(f, (0, 0))
            if f in self.two:
                self.best[f] = tuple(sorted((x, y, a), reverse=True)[:2])
            else:
                self.best[f] = (max(a, x), 0)

    def total(self) -> int:
        return sum(self.weights[f] * (x + y) for f, (x, y) in self.best.items())


def select_packets(packets: Sequence[Packet], weights: dict[str, int], budget: int, two: frozenset[str] = frozenset(), priorities: dict[int, int] | None = None) -> list[int]:
    """Greedy by gain per cost, compared with the best single packet; ids in canonical (id) order.

    A facet is covered by its best affinity, or the best two for those in
    ``two``. Optional packets may have a priority from outside (1 to SCALE),
    which adds at most a hundredth to their gain where packets are compared;
    plans are compared without it. Ties: greater gain, lower cost, lower id.
    Mandatory packets over the budget are an error.
    """
    if len(packets) > MOST_PACKETS:
        raise NeedsMore(f"more than {MOST_PACKETS} packets")
    priorities = priorities or {}
    optional = {p.id for p in packets if not p.mandatory}
    if not optional.issuperset(priorities) or not all(0 < x <= SCALE for x in priorities.values()):
        raise ValueError("priorities are for optional packets, from 1 to SCALE")
    base = [p for p in packets if p.mandatory]
    left = budget - sum(p.cost for p in base)
    if left < 0:
        raise NeedsMore("mandatory packets pass the budget")

    def start() -> _Cover:
        cover = _Cover(weights, two)
        for p in base:
            cover.add(p)
        return cover

    def plan_gain(ids: list[Packet]) -> int:
        cover = start()
        before = cover.total()
        for p in ids:
            cover.add(p)
        return cover.total() - before

    def assisted(p: Packet, gain: int) -> int:
        return gain + gain * priorities.get(p.id, 0) // PRIORITY_PART

    def by_ratio(p: Packet, gain: int) -> tuple:
        """Greatest first; the ratio is exact."""
        counts = assisted(p, gain)
        return Fraction(counts, max(p.cost, 1)), counts, gain, -p.cost, -p.id

    cover, room, spare, greedy = start(), left, left // COVERAGE_PART, []
    rest = [p for p in packets if not p.mandatory]
    while True:
        fit = [p for p in rest if p.cost <= room and not (p.coverage_only and p.cost > spare)]
        scored = [(g, p) for p in fit if (g := cover.gain(p)) > 0]
        if not scored:
            break
        _, chosen = max(scored, key=lambda x: by_ratio(x[1], x[0]))
        cover.add(chosen)
        room -= chosen.cost
        if chosen.coverage_only:
            spare -= chosen.cost
        rest.remove(chosen)
        greedy.append(chosen)
    plans = [greedy]
    alone = start()
    singles = [(g, p) for p in packets if not p.mandatory and p.cost <= (left // COVERAGE_PART if p.coverage_only else left) and (g := alone.gain(p)) > 0]
    if singles:
        plans.append([max(singles, key=lambda x: (assisted(x[1], x[0]), x[0], -x[1].cost, -x[1].id))[1]])
    best_plan = min(plans, key=lambda ids: (-plan_gain(ids), sum(p.cost for p in ids), sorted(p.id for p in ids)))
    return sorted(p.id for p in [*base, *best_plan])


def select_rows(packets: DataFrame, weights: Sequence[int], budget: int) -> dict[int, int]:
    """As select_packets for a table of any size, without mandatory or coverage-only packets: chosen ids with their costs.

    packets: id, cost, affinities (array of longs, one for each weight; 0 where
    it has none); read once for each packet chosen, so pass it cut. Each round
    is a distributed top-1. Gains per cost are compared exactly: as the quotient,
    then the remainder's share in steps finer than two costs within the budget
    can differ by.
    """
    fits = packets.where(F.col("cost").between(0, budget))
    per = F.greatest(F.col("cost"), F.lit(1)).cast("long")
    step = budget * budget + 1
    best = [0] * len(weights)

    def gains() -> Column:
        parts = [F.greatest(F.col("affinities")[i] - F.lit(b).cast("long"), F.lit(0).cast("long")) * F.lit(w).cast("long") for i, (w, b) in enumerate(zip(weights, best))]
        return sum(parts, F.lit(0).cast("long"))

    def top(rows: DataFrame, *order: Column) -> dict | None:
        found = rows.withColumn("gain", gains()).where("gain > 0").orderBy(*order, F.desc("gain"), F.asc("cost"), F.asc("id")).limit(1).collect()
        return found[0].asDict() if found else None

    single = top(fits)
    room, chosen, total = budget, {}, 0
    ratio = F.call_function("div", F.col("gain"), per), F.call_function("div", (F.col("gain") % per) * F.lit(step).cast("long"), per)
    while row := top(fits.where((F.col("cost") <= room) & ~F.col("id").isin(list(chosen))), *[x.desc() for x in ratio]):
        chosen[row["id"]] = row["cost"]
        room -= row["cost"]
        total += row["gain"]
        best = [max(b, a) for b, a in zip(best, row["affinities"])]
    if single is None:
        return {}
    plans = [(-total, budget - room, sorted(chosen)), (-single["gain"], single["cost"], [single["id"]])]
    return {i: chosen.get(i, single["cost"]) for i in min(plans)[2]}


def collected(pool: DataFrame, most: int) -> list[dict]:
    """A bounded pool on the driver; one that passes its bound is refused."""
    rows = pool.limit(most + 1).collect()
    if len(rows) > most:
        raise NeedsMore(f"more than {most} candidates")
    return [r.asDict() for r in rows]


def pack_in_order(packets: Sequence[Packet], order: Sequence[int], budget: int) -> list[int]:
    """Mandatory packets, then the rest in an order from outside, each if it still fits; the order must name every packet once."""
    by_id = {p.id: p for p in packets}
    if sorted(order) != sorted(by_id):
        raise ValueError("the order must be a permutation of the packets")
    left = budget - sum(p.cost for p in packets if p.mandatory)
    if left < 0:
        raise NeedsMore("mandatory packets pass the budget")
    taken, _ = pack([(i, by_id[i].cost) for i in order if not by_id[i].mandatory], left)
    return sorted([p.id for p in packets if p.mandatory] + taken)


def normalized_gain(packets: Sequence[Packet], weights: dict[str, int], chosen: Sequence[int], two: frozenset[str] = frozenset()) -> float:
    """Coverage the chosen packets add to the mandatory ones, as a part of what all packets would add."""

    def covered(ids: set[int]) -> int:
        cover = _Cover(weights, two)
        for p in packets:
            if p.mandatory or p.id in ids:
                cover.add(p)
        return cover.total()

    base, most = covered(set()), covered({p.id for p in packets})
    return (covered(set(chosen)) - base) / (most - base) if most > base else 0.0


def without_lane(packets: Sequence[Packet], prefix: str) -> list[Packet]:
    """The packets as they'd be without one lane's facets, for ablations; packets left without any facet go."""
    out = []
    for p in packets:
        kept = {f: a for f, a in p.affinities.items() if not f.startswith(prefix)}
        if kept or p.mandatory:
            out.append(Packet(p.id, p.cost, kept, p.mandatory, p.coverage_only))
    return out


def grep_head_tail(ranked: Sequence[int], n: int, costs: dict[int, int], budget: int, head: int = 20, tail: int = 200) -> list[int]:
    """Query hits first, then the tail, then the head, each whole or not at all; ids are positions 0 .. n-1, given in source order."""
    wanted = dict.fromkeys([*ranked, *range(max(0, n - tail), n), *range(min(head, n))])
    taken, _ = pack([(i, costs[i]) for i in wanted], budget)
    return sorted(taken)
