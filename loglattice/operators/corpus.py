"""Template groups, the term index, the service graph, and the searches over them.

Tables: *records* (native_id, ts_ms, raw), *members* (records with service,
role, fingerprint, peer), *groups* (cards with group_id, service, role,
fingerprint, repeat_count, first/last time and id), *terms* (group_id, term),
*edges* (source_service, target_service, evidence_count, first/last).

Searches end in a total order and fetch one row more than asked for; every
result row carries ``truncated``, true if there was one. Group ids number the
groups by (first time, first id, service, role, fingerprint), which equals
arrival order where records arrive in time order.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from loglattice.functions import records as fn
from loglattice.operators.prefix import dense_ids
from loglattice.session import cut

SEVERE = ("critical", "error", "warning")
CARD = ["group_id", "service", "role", "repeat_count", "first_timestamp_millis", "last_timestamp_millis", "first_native_id", "last_native_id"]
INDEX_TERMS, QUERY_TERMS = 64, 32
ANCHOR_PARTS = (4, 2, 6, 1, 3, 5, 7, 8)  # ninths of the time span, in the order they're visited


def role_rank(role: str | Column = "role") -> Column:
    c = F.col(role) if isinstance(role, str) else role
    return F.when(c == "critical", 0).when(c == "error", 1).when(c == "warning", 2).when(c == "change", 3).otherwise(4)


def severe(groups: DataFrame) -> DataFrame:
    return groups.where(F.col("role").isin(*SEVERE))


def bounded(ranked: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """First rows of an order with ``rank`` from 1 and ``truncated``; works on limit + 1 rows after a distributed top-k."""
    few = ranked.orderBy(*order).limit(limit + 1)
    numbered = few.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))
    total = F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))
    return numbered.withColumn("truncated", total > limit).where(F.col("rank") <= limit)


# --- building ---


def template_groups(members: DataFrame) -> DataFrame:
    """Repeats of a template per (service, role, fingerprint), whatever order they arrived in."""
    at = F.struct(F.col("ts_ms"), F.col("native_id"))
    grouped = members.groupBy("service", "role", "fingerprint").agg(F.count(F.lit(1)).alias("repeat_count"), F.min(at).alias("first"), F.max(at).alias("last"))
    flat = grouped.select(
        "service", "role", "fingerprint", "repeat_count",
        F.col("first.ts_ms").alias("first_timestamp_millis"), F.col("first.native_id").alias("first_native_id"),
        F.col("last.ts_ms").alias("last_timestamp_millis"), F.col("last.native_id").alias("last_native_id"),
    )
    return dense_ids(flat, "group_id", ["first_timestamp_millis", "first_native_id", "service", "role", "fingerprint"])


def group_terms(groups: DataFrame) -> DataFrame:
    text = F.concat_ws(" ", "service", "role", "fingerprint")
    return groups.select("group_id", F.explode(fn.search_terms(text, INDEX_TERMS)).alias("term"))


def edge_evidence(members: DataFrame) -> DataFrame:
    """Records that name a peer other than their own, known, service."""
    return members.where("peer is not null and service <> 'unknown' and service <> peer").select("native_id", "ts_ms", F.col("service").alias("source_service"), F.col("peer").alias("target_service"))


def service_edges(evidence: DataFrame) -> DataFrame:
    at = F.struct(F.col("ts_ms"), F.col("native_id"))
    edges = evidence.groupBy("source_service", "target_service").agg(F.count(F.lit(1)).alias("evidence_count"), F.min(at).alias("first"), F.max(at).alias("last"))
    return edges.select(
        "source_service", "target_service", "evidence_count",
        F.col("first.ts_ms").alias("first_timestamp_millis"), F.col("first.native_id").alias("first_native_id"),
        F.col("last.ts_ms").alias("last_timestamp_millis"), F.col("last.native_id").alias("last_native_id"),
    )


def severe_service_summary(groups: DataFrame) -> DataFrame:
    """Per service with severe groups: how many, and the ids of the oldest and newest by last time."""
    at = F.struct("last_timestamp_millis", "group_id")
    return severe(groups).groupBy("service").agg(F.count(F.lit(1)).alias("group_count"), F.min(at)["group_id"].alias("oldest_group_id"), F.max(at)["group_id"].alias("newest_group_id"))


# --- searching ---


def lexical_candidates(groups: DataFrame, terms: DataFrame, task: str, limit: int = 256) -> DataFrame:
    """Groups by the number of task terms they hold; no rows for a task without terms."""
    wanted = fn.search_terms_of(task, QUERY_TERMS)
    hits = terms.where(F.col("term").isin(wanted)).groupBy("group_id").agg(F.count(F.lit(1)).alias("matches"))
    cards = hits.join(groups.select(*CARD), "group_id")
    order = [F.desc("matches"), role_rank().asc(), F.desc("last_timestamp_millis"), F.desc("group_id")]
    return bounded(cards, order, limit).select("rank", *CARD, "matches", "truncated")


def task_match_strength(terms: DataFrame, task: str) -> DataFrame:
    """One row: number of task terms, and the most of them any group holds."""
    wanted = fn.search_terms_of(task, QUERY_TERMS)
    best = terms.where(F.col("term").isin(wanted)).groupBy("group_id").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("best_matches"))
    weak = ~((F.lit(len(wanted)) >= 3) & (3 * F.col("best_matches") >= 2 * len(wanted)))
    return best.select(F.lit(len(wanted)).cast("long").alias("n_terms"), "best_matches", weak.alias("is_weak"))


def repeated_severe(groups: DataFrame, limit: int = 8) -> DataFrame:
    return bounded(severe(groups).where("repeat_count > 1").select(*CARD), [F.desc("repeat_count"), F.asc("group_id")], limit)


def severe_by_time(groups: DataFrame, limit: int, newest: bool = True) -> DataFrame:
    way = F.desc if newest else F.asc
    return bounded(severe(groups).select(*CARD), [way("last_timestamp_millis"), way("group_id")], limit)


def severe_from_anchor(groups: DataFrame, anchor_ms: int, limit: int) -> DataFrame:
    return bounded(severe(groups).where(F.col("last_timestamp_millis") >= anchor_ms).select(*CARD), [F.asc("last_timestamp_millis"), F.asc("group_id")], limit)


def service_directory(groups: DataFrame, after_service: str | None = None, limit: int = 32) -> DataFrame:
    """A page of services with severe groups, each with its oldest group's first and newest group's last record."""
    summary = severe_service_summary(groups)
    if after_service is not None:
        summary = summary.where(F.col("service") > after_service)
    page = bounded(summary, [F.asc("service")], limit).withColumnRenamed("truncated", "has_more")
    oldest = groups.select(F.col("group_id").alias("oldest_group_id"), F.col("first_native_id").alias("oldest_native_id"))
    newest = groups.select(F.col("group_id").alias("newest_group_id"), F.col("last_native_id").alias("newest_native_id"))
    return page.join(oldest, "oldest_group_id").join(newest, "newest_group_id").select("service", "group_count", "oldest_native_id", "newest_native_id", "has_more")


def first_of_each(ranked: DataFrame, key: str, order: list[Column], limit: int) -> DataFrame:
    """Ordered union: each key where it comes first, at most ``limit`` keys, with ``rank``. For few rows."""
    once = ranked.withColumn("_ll_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_ll_n = 1").drop("_ll_n")
    return once.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long")).where(F.col("rank") <= limit)


def service_interleave(groups: DataFrame, service: str, limit: int) -> DataFrame:
    """One service's severe groups, oldest and newest in turn."""
    own = severe(groups).where(F.col("service") == service).select(*CARD)
    ends = (limit + 1) // 2
    sides = [severe_by_time(own, ends, newest).select(*CARD, F.col("rank").alias("position"), F.lit(int(newest)).alias("stream")) for newest in (False, True)]
    total = own.agg((F.count(F.lit(1)) > limit).alias("truncated"))
    picked = first_of_each(sides[0].unionByName(sides[1]), "group_id", [F.col("position"), F.col("stream")], limit)
    return picked.join(F.broadcast(total)).select("rank", *CARD, "truncated")  # one row beside at most ``limit``


def service_representatives(groups: DataFrame, services: int) -> DataFrame:
    """Oldest and newest severe group of the rarest and of the commonest services, in that order."""
    summary = severe_service_summary(groups)
    rare = bounded(summary, [F.asc("group_count"), F.asc("service")], (services + 1) // 2).withColumn("phase", F.lit(0))
    parts = [rare]
    if services // 2:
        parts.append(bounded(summary, [F.desc("group_count"), F.desc("service")], services // 2).withColumn("phase", F.lit(1)))
    both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    ends = both.select("phase", F.col("rank").alias("position"), F.posexplode(F.array("oldest_group_id", "newest_group_id")).alias("stream", "group_id"))
    picked = first_of_each(ends, "group_id", [F.col("phase"), F.col("position"), F.col("stream")], 2 * services)
    return picked.select("group_id", "rank").join(groups.select(*CARD), "group_id").select("rank", *CARD)


def candidate_representatives(candidates: DataFrame, limit: int = 16) -> DataFrame:
    """Per source and named service the gravest, then rarest candidate; services with few candidates first."""
    grave = F.least(role_rank(), F.lit(3)).alias("r")
    named = candidates.where("service <> '' and service <> 'unknown'")
    best = named.groupBy("source_id", "service").agg(F.count(F.lit(1)).alias("n_candidates"), F.min(F.struct(grave, "repeat_count", "group_id")).alias("b"))
    chosen = best.select("source_id", "service", "n_candidates", F.col("b.group_id").alias("group_id"))
    return bounded(chosen, [F.asc("n_candidates"), F.asc("source_id"), F.asc("service")], limit)


def priority_fallback(groups: DataFrame, limit: int) -> DataFrame:
    """Severe groups where no terms guide the search: all of them newest first if they fit, else a spread over time and services.

    Service representatives come first; then the oldest, the newest and eight
    interior anchors take turns; then more of the newest. The groups are read
    twice, however many streams there are: once by service, and once for the
    first rows after each anchor and the newest; all else works on those few.
    """
    card = F.struct("last_timestamp_millis", "group_id", *[c for c in CARD if c not in ("last_timestamp_millis", "group_id")])
    ends_of = severe(groups).groupBy("service").agg(F.count(F.lit(1)).alias("group_count"), F.min(card).alias("oldest"), F.max(card).alias("newest"))
    by_service = cut(ends_of)  # one row per service
    n, low, high = by_service.agg(F.sum("group_count"), F.min("oldest.last_timestamp_millis"), F.max("newest.last_timestamp_millis")).first()
    rows = severe(groups).select(*CARD)
    newest = severe_by_time(rows, limit + 1)
    if (n or 0) <= limit or limit == 1:
        return newest.where(F.col("rank") <= limit).select("rank", *CARD, F.lit((n or 0) > limit).alias("truncated"))
    ends = max(limit // 3, 1)
    per_anchor = -(-max(0, limit - 2 * ends) // len(ANCHOR_PARTS))
    anchors = [low + (high - low) * part // 9 for part in ANCHOR_PARTS]
    # a stream from an anchor is the first rows of the segment it begins, and of the next ones where that holds too few
    segment = sum((F.when(F.col("last_timestamp_millis") >= a, 1).otherwise(0) for a in sorted(set(anchors))), F.lit(0))
    turn = F.row_number().over(Window.partitionBy("_ll_segment").orderBy("last_timestamp_millis", "group_id"))
    heads = rows.withColumn("_ll_segment", segment).withColumn("_ll_turn", turn).where(F.col("_ll_turn") <= max(ends, per_anchor)).select(*CARD)
    few = cut(heads.unionByName(newest.select(*CARD)).dropDuplicates(["group_id"]))  # at most 9 * ends + limit + 1 rows

    def stream(part: DataFrame, newest_first: bool, most: int, phase: int, number: int) -> DataFrame:
        return severe_by_time(part, most, newest_first).select(*CARD, F.lit(phase).alias("phase"), F.col("rank").alias("position"), F.lit(number).alias("stream"))

    services = min(32, max(1, limit // 8))
    rare = bounded(by_service, [F.asc("group_count"), F.asc("service")], (services + 1) // 2).withColumn("side", F.lit(0))
    common = bounded(by_service, [F.desc("group_count"), F.desc("service")], services // 2).withColumn("side", F.lit(1)) if services // 2 else rare.limit(0)
    chosen = rare.unionByName(common).select((F.col("side") * services + F.col("rank")).alias("position"), F.posexplode(F.array("oldest", "newest")).alias("stream", "card"))
    parts = [chosen.select("card.*", F.lit(0).alias("phase"), (2 * F.col("position") + F.col("stream")).cast("long").alias("position"), F.lit(0).alias("stream"))]
    parts += [stream(few, False, ends, 1, 0), stream(few, True, ends, 1, 1)]
    if per_anchor:
        parts += [stream(few.where(F.col("last_timestamp_millis") >= a), False, per_anchor, 1, i) for i, a in enumerate(anchors, 2)]
    parts.append(stream(few, True, limit + 1, 2, 0).where(F.col("position") > ends))
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    return first_of_each(union, "group_id", [F.col("phase"), F.col("position"), F.col("stream")], limit).select("rank", *CARD, F.lit(True).alias("truncated"))


def directory_expansion(groups: DataFrame, pick: Callable[[list[dict]], Sequence[str]], page: int = 32, pages: int = 4, picks: int = 4, most: int = 64) -> DataFrame:
    """Groups of services a picker chooses from the directory, page after page.

    Each page offers ``page`` services; of each the picker may take ``picks``.
    The picked services' groups come interleaved, ``most`` in all.
    """
    after, chosen = None, []
    for _ in range(pages):
        offered = [r.asDict() for r in service_directory(groups, after, page).orderBy("service").collect()]
        if not offered:
            break
        names = {x["service"] for x in offered}
        taken = list(pick(offered))
        if len(taken) > picks or not names.issuperset(taken):
            raise ValueError("a picker must name offered services, at most as many as asked")
        chosen += [x for x in taken if x not in chosen]
        if not offered[0]["has_more"]:
            break
        after = offered[-1]["service"]
    if not chosen:
        return groups.select(*CARD).limit(0).withColumn("rank", F.lit(0))
    each = max(1, most // len(chosen))
    union = None
    for i, name in enumerate(chosen):
        part = service_interleave(groups, name, min(64, each)).select(*CARD, F.col("rank").alias("position"), F.lit(i).alias("stream"))
        union = part if union is None else union.unionByName(part)
    return first_of_each(union, "group_id", [F.col("position"), F.col("stream")], most).select("rank", *CARD)


def graph_neighbours(groups: DataFrame, edges: DataFrame, seeds: Sequence[str], limit: int = 64) -> DataFrame:
    """Groups of services one edge away from the seed services, seeds left out."""
    out = edges.where(F.col("source_service").isin(*seeds)).select(F.col("target_service").alias("service"))
    into = edges.where(F.col("target_service").isin(*seeds)).select(F.col("source_service").alias("service"))
    near = out.union(into).distinct().where(~F.col("service").isin(*seeds))
    cards = groups.select(*CARD).join(near, "service", "left_semi")
    order = [role_rank().asc(), F.desc("last_timestamp_millis"), F.desc("group_id")]
    return bounded(cards, order, limit).select("rank", *CARD, "truncated")


def merged_candidates(lists: Sequence[DataFrame]) -> DataFrame:
    """Several ranked lists as one: first of the first list, the second list, the rest; each group once. Few rows."""
    head, *others = lists
    parts = [head.select(*CARD, F.when(F.col("rank") == 1, 0).otherwise(2).alias("phase"), F.col("rank").alias("position"))]
    parts += [x.select(*CARD, F.lit(1).alias("phase"), (F.col("rank") + 1000 * i).alias("position")) for i, x in enumerate(others)]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    return first_of_each(union, "group_id", [F.col("phase"), F.col("position")], 1 << 30).select("rank", *CARD)


# --- records ---


def page_after(rows: DataFrame, keys: Sequence[str], after: Sequence | None, limit: int) -> DataFrame:
    """The next rows in the order of ``keys`` (unique), at most ``limit``, with ``has_more``; the last row's keys are the next cursor."""
    rest = rows
    if after is not None:
        types = dict(rows.dtypes)
        rest = rest.where(F.struct(*keys) > F.struct(*[F.lit(v).cast(types[k]).alias(k) for k, v in zip(keys, after)]))
    page = bounded(rest, [F.asc(k) for k in keys], limit)
    return page.withColumnRenamed("truncated", "has_more").drop("rank")


def record_of(records: DataFrame, native_id: str) -> DataFrame:
    """The record of an id, or no row; the condition reaches the scan."""
    return records.where(F.col("native_id") == native_id)


def record_page(records: DataFrame, after: tuple[int, str] | None, limit: int, max_bytes: int) -> DataFrame:
    """Next records in (time, id) order, at most ``limit``, stopping before the byte budget would be passed; ``has_more`` says whether any follow.

    A first record that alone passes the budget gives no rows.
    """
    sized = records.select("ts_ms", "native_id", F.octet_length("raw").cast("long").alias("n_bytes"))
    page = page_after(sized, ["ts_ms", "native_id"], after, limit)
    used = F.sum("n_bytes").over(Window.orderBy("ts_ms", "native_id").rowsBetween(Window.unboundedPreceding, 0))
    over = F.max(F.col("used_bytes") > max_bytes).over(Window.partitionBy(F.lit(0)))
    return page.withColumn("used_bytes", used).withColumn("has_more", F.col("has_more") | over).where(F.col("used_bytes") <= max_bytes)


def record_samples(records: DataFrame, n: int) -> DataFrame:
    """Head and tail bytes of each record and its length."""
    raw = F.encode("raw", "UTF-8") if dict(records.dtypes)["raw"] == "string" else F.col("raw")
    return records.select("native_id", F.substring(raw, 1, n).alias("prefix"), F.substring(raw, -n, n).alias("suffix"), F.octet_length(raw).cast("long").alias("n_bytes"))


def nearby_records(records: DataFrame, native_id: str, before: int, after: int, max_bytes: int) -> DataFrame:
    """Records around an anchor in (time, id) order.

    One byte budget: the anchor, then the ones before it from the nearest on,
    then the ones after it. A side stops at the first record that doesn't fit.
    ``before_truncated`` and ``after_truncated`` say whether a side has more.
    No rows if the anchor is unknown; ValueError if it alone passes the budget.
    """
    sized = records.select("ts_ms", "native_id", F.octet_length("raw").cast("long").alias("n_bytes"))
    anchor = sized.where(F.col("native_id") == native_id).orderBy("ts_ms").first()
    if anchor is None:
        return sized.limit(0).withColumns({"offset": F.lit(0).cast("long"), "before_truncated": F.lit(False), "after_truncated": F.lit(False)})
    if anchor["n_bytes"] > max_bytes:
        raise ValueError("the anchor alone passes the byte budget")
    here = F.struct(F.lit(anchor["ts_ms"]).alias("ts_ms"), F.lit(native_id).alias("native_id"))
    at = F.struct("ts_ms", "native_id")

    def side(rows: DataFrame, n: int, order: list[Column], sign: int) -> DataFrame:
        w = Window.orderBy(*order)
        few = rows.orderBy(*order).limit(n + 1)
        numbered = few.withColumn("offset", sign * F.row_number().over(w).cast("long")).withColumn("used", F.sum("n_bytes").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        return numbered.withColumn("side", F.lit(sign)).withColumn("near", F.abs("offset") <= n)

    left = max_bytes - anchor["n_bytes"]
    earlier = side(sized.where(at < here), before, [F.desc("ts_ms"), F.desc("native_id")], -1)
    later = side(sized.where(at > here), after, [F.asc("ts_ms"), F.asc("native_id")], 1)
    own = sized.where((F.col("native_id") == native_id) & (F.col("ts_ms") == anchor["ts_ms"])).withColumns({"offset": F.lit(0).cast("long"), "used": F.lit(0).cast("long"), "side": F.lit(0), "near": F.lit(True)})
    few = earlier.unionByName(own).unionByName(later)  # at most before + after + 3 rows
    whole = Window.partitionBy(F.lit(0))
    spent = F.coalesce(F.max(F.when((F.col("side") < 0) & F.col("near") & (F.col("used") <= left), F.col("used"))).over(whole), F.lit(0))
    few = few.withColumn("spent", spent)
    few = few.withColumn("fits", F.col("near") & (F.col("used") + F.when(F.col("side") > 0, F.col("spent")).otherwise(0) <= left))
    flag = {name: F.coalesce(F.max((F.col("side") == sign) & ~F.col("fits")).over(whole), F.lit(False)) for name, sign in (("before_truncated", -1), ("after_truncated", 1))}
    return few.withColumns(flag).where("fits").select("ts_ms", "native_id", "n_bytes", "offset", *flag)


def missing_members(records: DataFrame, indexed: DataFrame) -> DataFrame:
    """Records that no group holds yet."""
    return records.join(indexed.select("native_id"), "native_id", "left_anti")


def insert_outcome(stored: DataFrame, arriving: DataFrame) -> DataFrame:
    """Per arriving record ``outcome``: new, duplicate (same time and bytes) or conflict."""
    old = stored.select("native_id", F.col("ts_ms").alias("old_ms"), F.col("raw").alias("old_raw"))
    joined = arriving.join(old, "native_id", "left")
    same = (F.col("old_ms") == F.col("ts_ms")) & (F.col("old_raw") == F.col("raw"))
    return joined.withColumn("outcome", F.when(F.col("old_ms").isNull(), "new").when(same, "duplicate").otherwise("conflict")).drop("old_ms", "old_raw")


# --- feedback ---


def feedback_standing(observations: DataFrame, members: DataFrame, baseline: DataFrame | None = None, positives: int = 3) -> DataFrame:
    """Per group distinct positive nonces, negatives, and whether it may be promoted: enough positives, no negative, not in the baseline."""
    joined = observations.join(members, "native_id")
    standing = joined.groupBy("group_id").agg(
        F.countDistinct(F.when(F.col("verdict") == 1, F.col("nonce"))).alias("n_positive"), F.sum(F.when(F.col("verdict") == -1, 1).otherwise(0)).alias("n_negative")
    )
    ok = (F.col("n_positive") >= positives) & (F.col("n_negative") == 0)
    if baseline is None:
        return standing.withColumn("eligible", ok)
    known = baseline.select("group_id").distinct().withColumn("in_baseline", F.lit(True))
    return standing.join(known, "group_id", "left").withColumn("eligible", ok & F.col("in_baseline").isNull()).drop("in_baseline")


def shadow_bonus(labels: DataFrame, members: DataFrame, label_terms: DataFrame, task: str, most: int = 4, most_rows: int = 4096) -> DataFrame:
    """Groups with labels of cases that share a term with the task: bonus is the number of positive cases, up to ``most``, if at least two and no negative.

    No group gets a bonus if the task matches more than ``most_rows`` label rows.
    """
    wanted = fn.search_terms_of(task, QUERY_TERMS)
    cases = label_terms.where(F.col("term").isin(wanted)).select("case_id").distinct()
    hits = labels.join(cases, "case_id", "left_semi").join(members, "native_id").select("group_id", "case_id", "label").distinct()
    too_many = hits.limit(most_rows + 1).agg((F.count(F.lit(1)) > most_rows).alias("too_many"))
    hits = hits.join(F.broadcast(too_many)).where("not too_many")  # one row
    counted = hits.groupBy("group_id").agg(F.countDistinct(F.when(F.col("label") == 1, F.col("case_id"))).alias("n_positive"), F.countDistinct(F.when(F.col("label") == -1, F.col("case_id"))).alias("n_negative"))
    return counted.where("n_positive >= 2 and n_negative = 0").select("group_id", F.least("n_positive", F.lit(most)).alias("bonus"))


def promoted_groups(promotions: DataFrame, members: DataFrame) -> DataFrame:
    """Distinct groups that hold a promoted record. promotions and members: native_id; members: group_id."""
    return members.join(promotions.select("native_id"), "native_id", "left_semi").select("group_id").distinct()


def labels_digest(labels: DataFrame, members: DataFrame, groups: DataFrame) -> DataFrame:
    """One row: number of labels and a digest of them with the groups they fall in; it changes with any label, and with any regrouping.

    labels: case_id, native_id (unique together), label. Each label is
    digested where it is; the digests of a case are digested in order, then those of all cases,
    so only a short digest per case meets in one task.
    """
    of = members.join(groups.select("group_id", "service", "role", "fingerprint"), "group_id", "left")
    full = labels.join(of, "native_id", "left")
    text = lambda c: F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("n"))
    own = F.sha2(F.concat_ws("\x1f", *[text(c) for c in ("case_id", "native_id", "label", "group_id", "service", "role", "fingerprint")]), 256)
    cases = full.groupBy("case_id").agg(F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("native_id", own.alias("d")))), lambda x: x["d"]), ""), 256).alias("d"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("case_id", "d"))), lambda x: x["d"]), "")
    return cases.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_labels"), F.sha2(joined, 256).alias("digest"))
