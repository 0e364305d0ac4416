"""Operators over a global order without a window in one task: as-of and interval joins, ranks, allocation by levels.

Rows are sorted over Spark's ranges, so a key with a third of all rows lies in many tasks; what one range owes to the
ones before it (a last value, a count, a sum) is handed over in a table of one row per range or per group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..registry import query, table
from ..tables import in_ranges, running

# ------------------------------------------------------------------ as-of join


def as_of_join(left: DataFrame, right: DataFrame, key: str, at: str, values: list[str]) -> DataFrame:
    """``left`` with ``values`` of the last row of ``right`` of the same key and at or before its time; nulls where there is none.

    Both have ``key`` and ``at``. Of right rows at one time the one with the greatest values counts; a row of either
    side without key or time meets none. The two are sorted together and each left row takes the last right row before
    it in its range; a range hands its last right row on, with its key, so that a key may go on over many ranges.
    """
    mine = [c for c in left.columns]
    order = F.struct(*[F.col(c) for c in values])
    both = left.select(*[F.col(c) for c in mine], F.lit(1).alias("_side"), F.lit(None).cast(right.select(order.alias("v")).schema["v"].dataType).alias("_v"))
    known = right.where(F.col(key).isNotNull() & F.col(at).isNotNull())
    kinds = dict(left.dtypes)
    names = {key: F.col(key).cast(kinds[key]).alias(key), at: F.col(at).cast(kinds[at]).alias(at)}
    theirs = known.select(*[names.get(c, F.lit(None).cast(kinds[c]).alias(c)) for c in mine], F.lit(0).alias("_side"), order.alias("_v"))
    placed = in_ranges(both.unionByName(theirs).withColumn("_salt", F.monotonically_increasing_id()), *[F.col(c).asc_nulls_first() for c in (key, at, "_side", "_v", "_salt")])
    carried = F.when(F.col("_side") == 0, F.struct(F.col(key).alias("k"), F.col("_v").alias("v")))
    ends = placed.groupBy("_part").agg(F.max_by(carried, F.when(F.col("_side") == 0, F.col("_at"))).alias("_end"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    handed = ends.select("_part", F.last("_end", ignorenulls=True).over(earlier).alias("_handed"))  # one row per partition
    inner = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    last = F.coalesce(F.last(carried, ignorenulls=True).over(inner), F.col("_handed"))
    found = placed.join(F.broadcast(handed), "_part").withColumn("_last", last).where("_side = 1")
    fits = (F.col("_last.k") == F.col(key)) & F.col(at).isNotNull()
    return found.select(*mine, *[F.when(fits, F.col(f"_last.v.{c}")).alias(c) for c in values])


def _prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part's unit price as of each order's day: the versions that an order's time is held against."""
    lines = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    return lines.select(F.col("l_suppkey").alias("supplier"), F.col("l_shipdate").alias("day"), F.col("l_partkey").alias("part"), F.floor(F.col("l_extendedprice") * 100 + 0.5).cast("long").alias("cents"))


@query("as_of_price", """
WITH p AS (SELECT l_suppkey AS supplier, l_shipdate AS day, max(struct_pack(cents := floor(l_extendedprice * 100 + 0.5)::BIGINT, part := l_partkey)) AS v FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL),
o AS (SELECT l_orderkey, l_linenumber, l_suppkey AS supplier, l_shipdate AS day FROM lineitem)
SELECT o.l_orderkey, o.l_linenumber, o.supplier, o.day, p.v.cents AS cents, p.v.part AS part FROM o ASOF LEFT JOIN p ON o.supplier = p.supplier AND o.day >= p.day
""")
def as_of_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line with the last price that its supplier took back a part at, as of its day."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("supplier"), F.col("l_shipdate").alias("day"))
    return as_of_join(lines, _prices(spark, sf_dir), "supplier", "day", ["cents", "part"])


# ------------------------------------------------------------- interval join


def interval_join(points: DataFrame, spans: DataFrame, key: str, at: str, begin: str, end: str, width: int) -> DataFrame:
    """Pairs of a point and a span of the same key with ``begin`` <= ``at`` < ``end``; all three in microseconds.

    Time is cut into buckets of ``width`` that join the key, so that a busy key is many. A span longer than eight
    buckets is split over a ladder of widths, each eight times the one before, at most eight pieces on each step and
    side; a point looks one bucket up on every step that has spans. Spans are half open and empty ones meet nothing.
    """
    least, most = spans.agg(F.min(begin), F.max(end)).first()
    steps, size = [width], (most or 0) - (least or 0)
    while steps[-1] * 8 < size:
        steps.append(steps[-1] * 8)
    level = F.lit(len(steps) - 1)
    for i in range(len(steps) - 2, -1, -1):
        level = F.when(F.col(end) - F.col(begin) <= steps[i] * 8, i).otherwise(level)
    step = F.element_at(F.array(*[F.lit(s) for s in steps]), F.col("_level") + 1)
    cut = spans.where(F.col(begin) < F.col(end)).withColumn("_level", level).withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(begin) / step), F.floor((F.col(end) - 1) / step))))
    probes = points.withColumn("_look", F.explode(F.array(*[F.struct(F.lit(i).alias("level"), F.floor(F.col(at) / s).alias("bucket")) for i, s in enumerate(steps)])))
    probes = probes.withColumn("_level", F.col("_look.level")).withColumn("_bucket", F.col("_look.bucket")).drop("_look")
    return probes.join(cut, [key, "_level", "_bucket"]).where((F.col(begin) <= F.col(at)) & (F.col(at) < F.col(end))).drop("_level", "_bucket")


@query("interval_versions", """
WITH s AS (SELECT user_id, event_id AS version, ts AS begun, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ended FROM events WHERE event_type = 'signup'),
p AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'purchase')
SELECT p.event_id, s.version FROM p JOIN s ON p.user_id = s.user_id AND p.ts >= s.begun AND p.ts < s.ended
""")
def interval_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases with the version of their user that was in force then; versions last until the next one."""
    e = table(spark, sf_dir, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))
    ended = F.lead("t").over(Window.partitionBy("user_id").orderBy("t", "event_id"))
    versions = e.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("version"), F.col("t").alias("begun"), ended.alias("ended")).where("ended IS NOT NULL")
    points = e.where("event_type = 'purchase'").select("user_id", "event_id", "t")
    return interval_join(points, versions, "user_id", "t", "begun", "ended", 3_600_000_000).select("event_id", "version")


# --------------------------------------------------------------------- ranks


def ranks(df: DataFrame, within: list[str], order: list[tuple[str, bool]], tiles: int | None = None) -> DataFrame:
    """``df`` with rank, dense_rank, percent_rank, cume_dist within groups, as SQL's windows give them; ``ntile`` if asked for.

    ``order`` has columns and whether they descend; nulls come last. Equal keys are counted first, so that ties and
    groups of any size meet as counts; the different keys are numbered and their counts added up over ranges. Rows then
    get their key's numbers by a join that adaptive execution splits where a key is frequent. ``ntile`` divides rows, so
    its order must have no ties within a group. Nulls in ``within`` are a group.
    """
    keys = [c for c, _ in order]
    counted = df.groupBy(*within, *keys).agg(F.count(F.lit(1)).alias("_n"))
    sort = [F.col(c).asc_nulls_first() for c in within] + [F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_last() for c, down in order]
    placed = running(counted, sort, {"_rows_before": "_n"}, "_keys_before")
    groups = placed.groupBy(*[F.col(c).alias(f"_g_{c}") for c in within]).agg(F.min("_keys_before").alias("_first_key"), F.min("_rows_before").alias("_first_row"), F.sum("_n").alias("_all"))
    if within:
        k = placed.join(groups, [F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in within])
    else:
        k = placed.crossJoin(F.broadcast(groups))  # one row
    rank = F.col("_rows_before") - F.col("_first_row") + 1
    numbers = {
        "rank": rank,
        "dense_rank": F.col("_keys_before") - F.col("_first_key") + 1,
        "percent_rank": F.when(F.col("_all") > 1, (rank - 1) / (F.col("_all") - 1)).otherwise(0.0),
        "cume_dist": (rank - 1 + F.col("_n")) / F.col("_all"),
    }
    if tiles:
        large, wide = F.floor(F.col("_all") / tiles) + 1, F.col("_all") % tiles  # the first ``wide`` tiles hold one row more
        i = rank - 1
        numbers["ntile"] = F.when(i < large * wide, F.floor(i / large)).otherwise(wide + F.floor((i - large * wide) / F.greatest(large - 1, F.lit(1)))) + 1
    mine = [F.col(c).alias(f"_o_{c}") for c in (*within, *keys)]
    k = k.select(*mine, *[c.alias(name) for name, c in numbers.items()])
    return df.join(k, [F.col(c).eqNullSafe(F.col(f"_o_{c}")) for c in (*within, *keys)]).select(*df.columns, *numbers)


def tiled(df: DataFrame, order: list[tuple[str, bool]], tiles: int) -> DataFrame:
    """``df`` with place, its row number from 1 in ``order``, and tile, its ntile: each row has a place of its own, rows of equal keys in any order.

    Rows are sorted over ranges, equal keys in as many as they need; the first tiles hold one row more where they are uneven.
    """
    sort = [F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_last() for c, down in order]
    n = F.col("place") - 1
    placed = running(df.withColumn("_salt", F.monotonically_increasing_id()), [*sort, F.col("_salt").asc()], {}, "_row")
    total = placed.agg(F.count(F.lit(1)).alias("_all"))  # one row
    large, wide = F.floor(F.col("_all") / tiles) + 1, F.col("_all") % tiles
    tile = F.when(n < large * wide, F.floor(n / large)).otherwise(wide + F.floor((n - large * wide) / F.greatest(large - 1, F.lit(1)))) + 1
    return placed.crossJoin(F.broadcast(total)).withColumn("place", F.col("_row") + 1).select(*df.columns, "place", tile.alias("tile"))


@query("price_ranks", """
SELECT l_orderkey, l_linenumber, rank() OVER w AS rank, dense_rank() OVER w AS dense_rank, round(percent_rank() OVER w, 9) AS percent_rank, round(cume_dist() OVER w, 9) AS cume_dist
FROM lineitem WINDOW w AS (PARTITION BY l_returnflag ORDER BY l_quantity DESC, l_shipdate)
""")
def price_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines ranked by quantity and day within their flag, of which one has half of all rows."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity", "l_shipdate")
    r = ranks(lines, ["l_returnflag"], [("l_quantity", True), ("l_shipdate", False)])
    return r.select("l_orderkey", "l_linenumber", "rank", "dense_rank", F.round("percent_rank", 9).alias("percent_rank"), F.round("cume_dist", 9).alias("cume_dist"))


@query("price_tiles", """
SELECT l_orderkey, l_linenumber, row_number() OVER w AS place, ntile(100) OVER w AS tile FROM lineitem WINDOW w AS (ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber)
""")
def price_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines numbered and cut into hundredths by price, over the whole table."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return tiled(lines, [("l_extendedprice", True), ("l_orderkey", False), ("l_linenumber", False)], 100).drop("l_extendedprice")


# ---------------------------------------------------------------- allocation


def water_level(needs: DataFrame, groups: list[str], name: str, need: str, capacity: str, budget: int | str) -> DataFrame:
    """Integer shares of a budget that leave the largest unmet need as small as it can be, within capacities.

    A name gets the part of its need above a level, at most its capacity, and the level is where the shares add up to
    the budget: found by sorting, without a loop. The share as a function of the level falls by one a unit between
    need - capacity and need, so the sum's slope changes at these ends alone: they are sorted, and running sums of slope
    and value over the sorted ends give the segment that crosses the budget. Units that the level's floor leaves over go
    to names in the order of ``name`` among those still below need and capacity. Groups are independent; ``budget`` is
    one number or a column of the needs.
    """
    share = F.least(F.col(need), F.col(capacity)).cast("long")
    n = needs.select(*groups, name, F.col(need).cast("long").alias("_need"), F.greatest(share, F.lit(0)).alias("_most"), F.lit(budget).cast("long").alias("_budget") if isinstance(budget, int) else F.col(budget).cast("long").alias("_budget")).where("_need > 0 AND _most > 0")
    # going down from the highest need, slope +1 at need, -1 at need - most
    ends = n.select(*groups, "_budget", F.explode(F.array(F.struct(F.col("_need").alias("at"), F.lit(1).alias("d")), F.struct((F.col("_need") - F.col("_most")).alias("at"), F.lit(-1).alias("d")))).alias("e"))
    steps = ends.groupBy(*groups, F.col("e.at").alias("at")).agg(F.sum("e.d").alias("d"), F.max("_budget").alias("_budget"))
    steps = steps.withColumn("weighted", F.col("at") * F.col("d"))
    placed = running(steps, [F.col(c).asc_nulls_first() for c in groups] + [F.col("at").desc()], {"slope": "d", "sum": "weighted"})
    # each group's slopes add up to 0, so sums over the groups before leave a slope of 0 and a fixed weight
    own = placed.groupBy(*[F.col(c).alias(f"_g_{c}") for c in groups]).agg(F.min_by("sum", "row_number").alias("_base"))
    p = placed.join(own, [F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in groups]) if groups else placed.crossJoin(F.broadcast(own))
    given = (F.col("sum") - F.col("_base")) - F.col("slope") * F.col("at")  # what a level at this end gives out
    crossed = p.withColumn("_given", given).where("_given <= _budget")
    last = crossed.groupBy(*groups).agg(F.max_by(F.struct("at", "_given", (F.col("slope") + F.col("d")).alias("slope"), "_budget"), F.struct("row_number")).alias("s"))
    # below that end every unit of level gives ``slope``: whole units first
    down = F.when(F.col("s.slope") > 0, F.floor((F.col("s._budget") - F.col("s._given")) / F.col("s.slope"))).otherwise(0)
    level = last.select(*[F.col(c).alias(f"_g_{c}") for c in groups], (F.col("s.at") - down).alias("_level"), (F.col("s._budget") - F.col("s._given") - down * F.col("s.slope")).alias("_left"))
    q = n.join(level, [F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in groups]) if groups else n.crossJoin(F.broadcast(level))
    q = q.withColumn("share", F.least(F.greatest(F.col("_need") - F.col("_level"), F.lit(0)), F.col("_most")))
    more = ((F.col("share") < F.col("_most")) & (F.col("_need") - F.col("share") >= F.col("_level")) & (F.col("_left") > 0)).cast("long")
    ranked = running(q.withColumn("_more", more), [F.col(c).asc_nulls_first() for c in (*groups, name)], {"_earlier": "_more"})
    base = ranked.groupBy(*[F.col(c).alias(f"_b_{c}") for c in groups]).agg(F.min("_earlier").alias("_base"))
    r = ranked.join(base, [F.col(c).eqNullSafe(F.col(f"_b_{c}")) for c in groups]) if groups else ranked.crossJoin(F.broadcast(base))
    extra = F.when((F.col("_more") == 1) & (F.col("_earlier") - F.col("_base") < F.col("_left")), 1).otherwise(0)
    return r.select(*groups, name, (F.col("share") + extra).cast("long").alias("share"))


def interleaved(shares: DataFrame, groups: list[str], name: str) -> DataFrame:
    """One row a slot, the names taking turns: the first slot of every name, then the second, each round in the order of names; ``slot`` from 1.

    A slot's place is a rank by (round, name), so no queue is walked.
    """
    slots = shares.where("share > 0").withColumn("round", F.explode(F.sequence(F.lit(1), F.col("share"))))
    numbered = running(slots.drop("share"), [F.col(c).asc_nulls_first() for c in groups] + [F.col("round").asc(), F.col(name).asc()], {}, "_place")
    firsts = numbered.groupBy(*[F.col(c).alias(f"_g_{c}") for c in groups]).agg(F.min("_place").alias("_first"))
    k = numbered.join(firsts, [F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in groups]) if groups else numbered.crossJoin(F.broadcast(firsts))
    return k.select(*groups, name, "round", (F.col("_place") - F.col("_first") + 1).alias("slot"))


@query("slot_allocation", """
WITH RECURSIVE t AS (SELECT lang, source, count(*) FILTER (WHERE length(text) < 800) AS deficit, greatest(1, count(*) FILTER (WHERE length(text) >= 400)) AS room FROM documents GROUP BY ALL),
b AS (SELECT lang, floor(sum(deficit) / 2)::BIGINT AS budget FROM t GROUP BY lang),
lv AS (SELECT lang, max(deficit) AS level FROM t GROUP BY lang UNION ALL SELECT lang, level - 1 FROM lv WHERE level > 0),
g AS (SELECT lv.lang, lv.level, sum(least(greatest(deficit - level, 0), room)) AS given FROM lv JOIN t ON t.lang IS NOT DISTINCT FROM lv.lang GROUP BY ALL),
c AS (SELECT g.lang, min(level) AS level FROM g JOIN b ON b.lang IS NOT DISTINCT FROM g.lang WHERE given <= budget GROUP BY g.lang),
s AS (SELECT t.lang, source, deficit, room, level, least(greatest(deficit - level, 0), room) AS share, budget FROM t JOIN c ON c.lang IS NOT DISTINCT FROM t.lang JOIN b ON b.lang IS NOT DISTINCT FROM t.lang WHERE deficit > 0),
m AS (SELECT *, share < least(deficit, room) AND deficit - share >= level AS more, budget - sum(share) OVER (PARTITION BY lang) AS rest FROM s),
f AS (SELECT lang, source, (share + CASE WHEN more AND row_number() OVER (PARTITION BY lang, more ORDER BY source) <= rest THEN 1 ELSE 0 END)::BIGINT AS share FROM m),
x AS (SELECT lang, source, unnest(generate_series(1, share)) AS round FROM f)
SELECT lang, source, round, row_number() OVER (PARTITION BY lang ORDER BY round, source) AS slot FROM x
""")
def slot_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of each language's missing documents (short ones) is given to sources by the level of their deficits, within what they can take, and dealt out in turns."""
    d = table(spark, sf_dir, "documents")
    length = F.char_length("text")
    t = d.groupBy("lang", "source").agg(F.count_if(length < 800).alias("deficit"), F.greatest(F.count_if(length >= 400), F.lit(1)).alias("room"))
    budget = t.groupBy(F.col("lang").alias("_l")).agg(F.floor(F.sum("deficit") / 2).cast("long").alias("budget"))
    needs = t.join(budget, F.col("lang").eqNullSafe(F.col("_l"))).drop("_l")
    return interleaved(water_level(needs, ["lang"], "source", "deficit", "room", "budget"), ["lang"], "source")
