"""Point-in-time feature table: what was known of a client at the time of each of its sales, over windows that end there.

Everything that is counted is a point of a client: when it happened (``at``), from
when on it can be known (``ready``, never before ``at``) and what it adds. A window
of d days at time t takes the points with t - d < at and ready <= t.

All points of a client have places in order of ``at``. Over the places stands a
merge-sort tree: dyadic blocks of 2^LEAF places and of 2^STRIDE times as many at each
level above, every block's points in order of ``ready`` with running sums and the
latest click so far. A window is a range of places; it is cut into a few blocks of
each level and the two lowest blocks in which it begins and ends, whose points are
looked at one by one. In every other block the probe is looked up by its time.

Places and running sums come from one job, ``running``: rows are dealt by ranges
of their keys and order, so that a key of any size is spread over as many tasks as
it needs and a lookup is a place in the same order; every task adds up its own
rows, and what a key had in the tasks before is added afterwards: a row per
task. Nothing else is broadcast, and no client, sale, item or block is gathered.

Distinct items add up as well: in order of ``ready``, a line whose ``at`` is later
than any before of its item stands for the item from then on, and adds 1 at its
own ``at``; the line that stood for it till then is taken back by -1 at its own.

Lines of one sale that are known from the same time on are one point. Levels are
only made for clients that a window needs them for: a client of few points has
none, one of n points at most (log2(n) - LEAF) / STRIDE.

Defined cases: rows without a client or time of event count nowhere, and a sale
without them is not answered; what has no arrival (or, for lines, shipping) time
is never known, though a sale without arrival makes labels; a null sale_id has
offset 0 and no lines; values that are null or not a number count 0 cents; equal
clicks count once, sales and lines each time; every row of a sale is answered;
other columns are only compared, for equal clicks; empty tables give 0, or an
empty result where there are no sales. Click ids are above -2^63.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Steps

#: Days of the windows, minutes until an arrival can be used, days of the label, seconds over which probes are spread.
WINDOWS, LAG, AHEAD, SPREAD = (2, 14), 240, 7, 259_200
#: Places of a lowest block, and blocks of one level in one of the next, as powers of two.
LEAF, STRIDE = 5, 2
DAY = 86_400_000_000
CLICK, PURCHASE, SALE, LINE = range(4)
NONE, NEVER = -(2**63), 2**62

POINT = ["client", "at", "mark", "tie", "kind", "n", "cents", "items", "ready"]


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970 of a timestamp; one without a zone is UTC, whatever the session's zone."""
    c = F.col(f"`{name}`")
    if not isinstance(df.schema[name].dataType, T.TimestampNTZType):
        return F.unix_micros(c)
    day = F.unix_date(c.cast("date")).cast("long") * DAY
    return day + (F.hour(c) * 3600 + F.minute(c) * 60).cast("long") * 1_000_000 + (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("long")


def cents(value: Column) -> Column:
    x = value.cast("double")
    return F.when(F.isnan(x), F.lit(0)).otherwise(F.coalesce(F.floor(100 * x + 0.5), F.lit(0))).cast("long")


#: A column of numbers made from the columns of a batch, which it asks for by name.
Made = Callable[[Callable[[str], np.ndarray]], np.ndarray]


def running(
    steps: Steps, rows: DataFrame, keys: Sequence[str], order: Sequence[str], sums: Mapping[str, Made], top: Mapping[str, Made] = {}, keep: str = "true", name: str = "running"
) -> DataFrame:
    """rows with the sums so far of what ``sums`` makes of them and, of the row with the greatest first value of ``top`` so far, all values of ``top``.

    "So far" goes through the rows of one combination of keys in the given order,
    the row itself included: the columns so_far_<name>. before_<name> is the
    greatest first value of the rows before. Keys, order and values are whole
    numbers without nulls; NONE is less than any. Keys may have any number of rows.
    Rows for which the condition ``keep`` does not hold are left out of the answer.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names, lead = rows.columns, next(iter(top), None)
    dealt = rows.repartitionByRange(parts, *keys, *order).sortWithinPartitions(*keys, *order)
    more = [f"so_far_{c}" for c in [*sums, *top]] + ([f"before_{lead}"] if top else [])
    fields = [*rows.schema.fields, *[T.StructField(c, T.LongType()) for c in more]]
    fields += [T.StructField("task", T.IntegerType()), T.StructField("open", T.BooleanType()), T.StructField("edge", T.IntegerType())]
    added, tops = list(sums.values()), list(top.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, first, last = TaskContext.get().partitionId(), None, None
        total, best, held = np.zeros(len(added), np.int64), [NONE] * len(tops), None

        def told(arrays: list, edge: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*arrays, pa.array(edge)], [f.name for f in fields])

        for b in batches:
            n = b.num_rows
            if not n:
                continue
            if held:
                yield told(*held)
            column = lambda c: b.column(names.index(c)).to_numpy(zero_copy_only=False).astype(np.int64)  # noqa: E731, B023
            k = [column(c) for c in keys]
            now = tuple(int(x[0]) for x in k)
            new = np.zeros(n, bool)
            for x in k:
                new[1:] |= x[1:] != x[:-1]
            new[0] = now != last
            edge = np.zeros(n, np.int32)
            if first is None:
                first, edge[0] = now, 1
            group, starts = np.cumsum(new), np.flatnonzero(new)
            out = []
            for i, made in enumerate(added):
                s = np.cumsum(made(column))
                less = np.concatenate([[total[i]], np.where(starts > 0, -s[starts - 1], 0)])
                out.append(s + less[group])
                total[i] = out[-1][-1]
            if tops:
                m = [made(column) for made in tops]
                if not new[0] and best[0] > m[0][0]:
                    for x, y in zip(m, best):
                        x[0] = y
                step, before = 1, np.full(n, NONE)
                while step < n:
                    at = step + np.flatnonzero((group[step:] == group[:-step]) & (m[0][:-step] > m[0][step:]))
                    for x, y in [(x, x[at - step]) for x in m]:
                        x[at] = y
                    step *= 2
                before[1:] = np.where(new[1:], NONE, m[0][:-1])
                before[0] = NONE if new[0] else best[0]
                best = [int(x[-1]) for x in m]
                out += [*m, before]
            last = tuple(int(x[-1]) for x in k)
            opened = np.ones(n, bool)
            for x, y in zip(k, first):
                opened &= x == y
            held = ([*b.columns, *map(pa.array, out), pa.array(np.full(n, task, np.int32)), pa.array(opened)], edge)
        if held:
            held[1][-1] += 2
            yield told(*held)

    summary = steps.written(dealt.mapInArrow(run, T.StructType(fields)).filter(f"({keep}) OR edge > 0"), name)
    ends = summary.filter("edge > 0")
    heads = ends.filter("edge != 2").select(*keys, F.col("task").alias("into"))
    tails = ends.filter("edge != 1").select(*keys, F.col("task").alias("out"), *[c for c in more if c.startswith("so_far_")])
    bests = F.max(F.struct(*[F.col(f"so_far_{c}").alias(c) for c in top])) if top else F.lit(None)
    carried = heads.join(tails, list(keys)).filter("out < into").groupBy("into").agg(*[F.sum(f"so_far_{c}").alias(f"carry_{c}") for c in sums], bests.alias("carry_top"))
    carried = steps.written(carried, f"{name}-carried")  # a row per task at most
    met = summary.filter(keep).join(F.broadcast(carried), (F.col("task") == F.col("into")) & F.col("open"), "left")
    out = [*names, *[(F.col(f"so_far_{c}") + F.coalesce(f"carry_{c}", F.lit(0))).alias(f"so_far_{c}") for c in sums]]
    if top:
        later = F.coalesce(F.col(f"carry_top.{lead}") > F.col(f"so_far_{lead}"), F.lit(False))
        out += [F.when(later, F.col(f"carry_top.{c}")).otherwise(F.col(f"so_far_{c}")).alias(f"so_far_{c}") for c in top]
        out += [F.greatest(f"before_{lead}", f"carry_top.{lead}").alias(f"before_{lead}")]
    return met.select(*out)


def _point(kind: Column, tie: Column, ready: Column, n: Column | None = None, cents: Column | None = None, items: Column | None = None) -> list[Column]:
    n, cents, items = (F.lit(default) if c is None else c for c, default in ((n, 1), (cents, 0), (items, 0)))
    mark = F.when(kind <= PURCHASE, 1).otherwise(0)
    types = {"mark": "int", "kind": "int", "n": "int", "items": "int"}
    said = {"client": F.col("client"), "at": F.col("at"), "mark": mark, "tie": tie, "kind": kind, "n": n, "cents": cents, "items": items, "ready": ready}
    return [said[c].cast(types.get(c, "long")).alias(c) for c in POINT]


def click_points(clicks: DataFrame) -> DataFrame:
    """A point for each different click."""
    once = clicks.filter("client_id IS NOT NULL AND ts IS NOT NULL AND arrived_at IS NOT NULL").distinct()
    known = once.select(
        F.col("client_id").alias("client"), micros(clicks, "ts").alias("at"), (micros(clicks, "arrived_at") + LAG * 60_000_000).alias("known"),
        F.when(F.col("kind") == "purchase", PURCHASE).otherwise(CLICK).alias("kind"), "click_id", "value",
    )
    return known.select(*_point(F.col("kind"), F.coalesce("click_id", F.lit(NONE)), F.greatest("known", "at"), cents=cents(F.col("value"))))


def timed_sales(sales: DataFrame) -> DataFrame:
    """sale_id, client, at, known (null without an arrival), total of the sales that have a client and a time."""
    return sales.filter("client_id IS NOT NULL AND sold_at IS NOT NULL").select(
        "sale_id", F.col("client_id").alias("client"), micros(sales, "sold_at").alias("at"), (micros(sales, "arrived_at") + LAG * 60_000_000).alias("known"), "total"
    )


def line_points(steps: Steps, timed: DataFrame, lines: DataFrame) -> DataFrame:
    """A point for each line of the sales, with the items that it begins to stand for, and one for each that it takes the place of."""
    shipped = lines.filter("sale_id IS NOT NULL AND shipped_at IS NOT NULL").select(
        F.col("sale_id").alias("of"), F.col("item_id").cast("long").alias("item"), micros(lines, "shipped_at").alias("shipped"), cents(F.col("amount")).alias("cents")
    )
    met = shipped.join(timed.filter("known IS NOT NULL").select("sale_id", "client", "at", "known").hint("merge"), F.col("of") == F.col("sale_id"))
    each = met.select("client", "item", "at", F.greatest("known", "shipped", "at").alias("ready"), "cents", F.xxhash64("of", "item", "cents", "shipped", F.monotonically_increasing_id()).alias("tie"))
    each = steps.written(each, "lines")
    stood = running(steps, each.filter("item IS NOT NULL"), ("client", "item"), ("ready", "at", "tie"), {}, {"at": lambda c: c("at")}, name="lines-by-item")
    begins = F.col("at") > F.col("before_at")
    own = F.struct(F.col("at"), F.lit(1).alias("n"), F.col("cents"), begins.cast("int").alias("items"))
    taken = F.struct(F.col("before_at").alias("at"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("cents"), F.lit(-1).alias("items"))
    told = stood.select("client", "ready", F.explode(F.when(begins & (F.col("before_at") > NONE), F.array(own, taken)).otherwise(F.array(own))).alias("p"))
    plain = each.filter("item IS NULL").select("client", "ready", F.struct("at", F.lit(1).alias("n"), "cents", F.lit(0).alias("items")).alias("p"))
    spread = told.unionByName(plain).select("client", "ready", "p.*")
    summed = spread.groupBy("client", "at", "ready").agg(*[F.sum(c).alias(c) for c in ("n", "cents", "items")])
    return summed.select(*_point(F.lit(LINE), F.col("ready"), F.col("ready"), F.col("n"), F.col("cents"), F.col("items")))


#: The columns of the answer: of which kinds of points they add up which column.
MEASURES = {
    "n_clicks": ((CLICK, PURCHASE), "n"), "n_purchases": ((PURCHASE,), "n"), "click_cents": ((CLICK, PURCHASE), "cents"),
    "n_sales": ((SALE,), "n"), "sale_cents": ((SALE,), "cents"), "n_lines": ((LINE,), "n"), "n_items": ((LINE,), "items"), "line_cents": ((LINE,), "cents"),
}


def features(clicks: DataFrame, sales: DataFrame, lines: DataFrame, windows: Sequence[int] = WINDOWS) -> DataFrame:
    """A row for every sale with a client and a time, and every window: see the module."""
    steps = Steps(sales.sparkSession)
    timed = steps.written(timed_sales(sales).withColumn("rid", F.monotonically_increasing_id()), "sales")
    known = F.when(F.col("known").isNull(), F.lit(NEVER)).otherwise(F.greatest("known", "at"))
    points = click_points(clicks).unionByName(timed.select(*_point(F.lit(SALE), F.col("rid"), known, cents=cents(F.col("total"))))).unionByName(line_points(steps, timed, lines))
    points = steps.written(points, "points")

    t = F.col("at") + F.pmod(F.crc32(F.coalesce(F.col("sale_id").cast("string"), F.lit("")).cast("binary")), F.lit(SPREAD)) * 1_000_000
    bounds = [-d * DAY for d in windows] + [0, AHEAD * DAY]
    asked = timed.select("client", "rid", "sale_id", t.alias("t")).select("client", "rid", "sale_id", "t", F.posexplode(F.array(*[F.lit(b).cast("long") for b in bounds])).alias("kind", "shift"))
    # A bound is a row among the points: its number and sale stand where a point has its tie and cents.
    asked = asked.select("client", (F.col("t") + F.col("shift")).alias("at"), F.lit(2).alias("mark"), F.col("rid").alias("tie"), "kind", F.lit(0).alias("n"), F.col("sale_id").alias("cents"), F.lit(0).alias("items"), "t")
    rows = points.unionByName(asked.withColumnRenamed("t", "ready"))
    counted = {"point": lambda c: (c("mark") < 2).astype(np.int64), "sale": lambda c: ((c("mark") == 0) & (c("kind") == SALE)).astype(np.int64)}
    placed = running(steps, rows, ("client",), ("at", "mark", "tie"), counted, name="places")
    places = placed.filter("mark < 2").select(
        "client", (F.col("so_far_point") - 1).alias("pos"), "ready", "kind", "n", "cents", "items", F.when(F.col("kind") <= PURCHASE, F.col("tie")).otherwise(F.lit(NONE)).alias("click_id")
    )
    places = steps.written(places, "points-placed")
    at = lambda k, c: F.max(F.when(F.col("kind") == k, F.col(c)))
    k = len(windows)
    probes = placed.filter("mark = 2").groupBy(F.col("tie").alias("rid")).agg(
        F.max("client").alias("client"), F.max("cents").alias("sale_id"), F.max("ready").alias("t"), *[at(i, "so_far_point").alias(f"lo{i}") for i in range(k)],
        at(k, "so_far_point").alias("hi"), (at(k + 1, "so_far_sale") > at(k, "so_far_sale")).alias("label"),
    )
    probes = steps.written(probes, "probes")
    each = probes.select("rid", "client", "sale_id", "t", "hi", "label", F.explode(F.array(*[F.struct(F.lit(d).alias("d"), F.col(f"lo{i}").alias("lo")) for i, d in enumerate(windows)])).alias("w"))
    each = each.select("rid", "client", "sale_id", "t", "hi", "label", "w.d", "w.lo", F.shiftright(F.col("w.lo"), LEAF).alias("first"), F.shiftright(F.col("hi") - 1, LEAF).alias("last"))

    found = _in_leaves(places, each.filter("lo < hi")).unionByName(_in_blocks(steps, places, each.filter("first + 1 < last")))
    nothing = each.select("rid", "d", "sale_id", "t", "label", *[F.lit(0).cast("long").alias(c) for c in MEASURES], F.lit(NONE).alias("top"), F.lit(NONE).alias("click_id"))
    every = nothing.unionByName(found, allowMissingColumns=True)
    summed = every.groupBy("rid", "d").agg(
        F.max("sale_id").alias("sale_id"), F.max("t").alias("t_us"), F.max("label").alias("label"), *[F.sum(c).alias(c) for c in MEASURES],
        F.max(F.struct("top", "click_id")).alias("last"),
    )
    last = F.when(F.col("last.click_id") != NONE, F.col("last.click_id")).alias("last_click_id")
    out = steps.written(summed.select("sale_id", "d", "t_us", "label", "n_clicks", "n_purchases", "click_cents", last, "n_sales", "sale_cents", "n_lines", "n_items", "line_cents"), "features")
    steps.over(out)
    return out


def _in_leaves(places: DataFrame, each: DataFrame) -> DataFrame:
    """rid, d, MEASURES, top, click_id: what the windows hold in the lowest blocks in which they begin and end."""
    ends = each.select("rid", "d", "client", "t", "lo", "hi", F.explode(F.array_distinct(F.array("first", "last"))).alias("leaf"))
    there = places.select(F.col("client").alias("of"), F.shiftright("pos", LEAF).alias("block"), "pos", "ready", "kind", "n", "cents", "items", "click_id")
    inside = (F.col("pos") >= F.col("lo")) & (F.col("pos") < F.col("hi")) & (F.col("ready") <= F.col("t"))
    met = ends.join(there.hint("merge"), (F.col("client") == F.col("of")) & (F.col("leaf") == F.col("block")) & inside)
    adds = {c: F.when(F.col("kind").isin(*kinds), F.col(of)).otherwise(F.lit(0)).cast("long") for c, (kinds, of) in MEASURES.items()}
    lead = F.struct(F.when(F.col("kind") <= PURCHASE, F.col("pos")).otherwise(F.lit(NONE)).alias("top"), "click_id")
    summed = met.groupBy("rid", "d").agg(*[F.sum(adds[c]).alias(c) for c in MEASURES], F.max(lead).alias("lead"))
    return summed.select("rid", "d", *MEASURES, "lead.top", "lead.click_id")


def _in_blocks(steps: Steps, places: DataFrame, each: DataFrame) -> DataFrame:
    """The same in all blocks between."""
    levels = each.withColumn("level", F.explode(F.sequence(F.lit(0), F.floor(F.log2(F.col("last") - F.col("first") - 1) / STRIDE).cast("int"))))
    wide = 1 << STRIDE
    cut = levels.withColumn("low", F.expr(f"shiftright(first + shiftleft(1L, {STRIDE} * level), {STRIDE} * level)")).withColumn("high", F.expr(f"shiftright(last, {STRIDE} * level)"))
    cut = cut.filter("low < high").withColumn("up", F.shiftright(F.col("low") + wide - 1, STRIDE) * wide).withColumn("down", F.shiftright("high", STRIDE) * wide)
    low, high, up, down = map(F.col, ("low", "high", "up", "down"))
    # Where the next level takes a part, the blocks before and after it; else all, which are no more.
    sides = [F.when(low + k < up, low + k) for k in range(wide - 1)] + [F.when(high - 1 - k >= down, high - 1 - k) for k in range(wide - 1)]
    taken = F.array(*[F.when(up < down, side).otherwise(F.when(low + k < high, low + k)) for k, side in enumerate(sides)])
    probed = steps.written(cut.select("rid", "d", "client", "t", "level", F.explode(taken).alias("block")).filter("block IS NOT NULL"), "probed")
    needed = steps.written(probed.groupBy("client").agg(F.max("level").alias("levels")), "levels")
    filed = places.join(needed.hint("merge"), "client").withColumn("level", F.explode(F.sequence(F.lit(0), F.col("levels")))).select(
        "client", "level", F.expr(f"shiftright(pos, {LEAF} + {STRIDE} * level)").alias("block"), "ready", F.col("pos").alias("tie"), "kind", "n", "cents", "items", "click_id"
    )
    # A probe stands after all points of its time; its number is told from their places, and its days from their kinds.
    asks = probed.select(
        "client", "level", "block", F.col("t").alias("ready"), (F.col("rid") + NEVER).alias("tie"), (-F.col("d")).alias("kind"),
        F.lit(0).alias("n"), F.lit(0).cast("long").alias("cents"), F.lit(0).alias("items"), F.lit(NONE).alias("click_id"),
    )
    sums = {c: (lambda col, kinds=kinds, of=of: np.where(np.isin(col("kind"), kinds), col(of), 0)) for c, (kinds, of) in MEASURES.items()}
    top = {"top": lambda c: np.where((c("kind") >= CLICK) & (c("kind") <= PURCHASE), c("tie"), NONE), "click_id": lambda c: c("click_id").copy()}
    looked = running(steps, filed.unionByName(asks), ("client", "level", "block"), ("ready", "tie"), sums, top, keep="kind < 0", name="blocks")
    return looked.select(
        (F.col("tie") - NEVER).alias("rid"), (-F.col("kind")).alias("d"), *[F.col(f"so_far_{c}").alias(c) for c in MEASURES], F.col("so_far_top").alias("top"), F.col("so_far_click_id").alias("click_id")
    )


#: The same in DuckDB's SQL: every window by a join.
SQL = f"""
    WITH RECURSIVE steps(i, c, k) AS (
        SELECT range, range, 0 FROM range(256)
        UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8),
    crcs AS (SELECT list(c ORDER BY i) AS tab FROM steps WHERE k = 8),
    numbered AS (SELECT row_number() OVER () AS r, * FROM sales),
    probes AS (
        SELECT r, sale_id, client_id,
               epoch_us(sold_at) + 1000000 * (xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(sale_id::VARCHAR, ''), ''), lambda x: ascii(x)::BIGINT)),
                   lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]))) % {SPREAD}) AS t
        FROM numbered, crcs WHERE client_id IS NOT NULL AND sold_at IS NOT NULL),
    each AS (SELECT p.*, d FROM probes p, (VALUES (2), (14)) v(d)),
    c AS (SELECT client_id, click_id, kind, value, epoch_us(ts) AS ts, epoch_us(arrived_at) + {LAG * 60_000_000} AS known FROM (SELECT DISTINCT * FROM clicks)),
    s AS (SELECT sale_id, client_id, total, epoch_us(sold_at) AS sold, epoch_us(arrived_at) + {LAG * 60_000_000} AS known FROM sales),
    by_click AS (
        SELECT r, d, count(*) AS n_clicks, count(*) FILTER (kind = 'purchase') AS n_purchases, sum(coalesce(floor(100 * value + 0.5), 0))::BIGINT AS click_cents,
               first(click_id ORDER BY ts DESC, click_id DESC NULLS LAST) AS last_click_id
        FROM each p JOIN c ON p.client_id = c.client_id AND c.ts > t - d * {DAY} AND c.ts <= t AND c.known <= t GROUP BY r, d),
    held AS (SELECT r, d, t, s.sale_id, s.total FROM each p JOIN s ON p.client_id = s.client_id AND s.sold > t - d * {DAY} AND s.sold <= t AND s.known <= t),
    by_sale AS (SELECT r, d, count(*) AS n_sales, sum(coalesce(floor(100 * total + 0.5), 0))::BIGINT AS sale_cents FROM held GROUP BY r, d),
    by_line AS (
        SELECT r, d, count(*) AS n_lines, count(DISTINCT item_id) AS n_items, sum(coalesce(floor(100 * amount + 0.5), 0))::BIGINT AS line_cents
        FROM held h JOIN sale_lines l ON h.sale_id = l.sale_id AND epoch_us(l.shipped_at) <= t GROUP BY r, d),
    ahead AS (SELECT DISTINCT r FROM probes p JOIN s ON p.client_id = s.client_id AND s.sold > t AND s.sold <= t + {AHEAD} * {DAY})
    SELECT p.sale_id, p.d::INTEGER AS d, p.t AS t_us, a.r IS NOT NULL AS label,
           coalesce(n_clicks, 0) AS n_clicks, coalesce(n_purchases, 0) AS n_purchases, coalesce(click_cents, 0) AS click_cents, last_click_id,
           coalesce(n_sales, 0) AS n_sales, coalesce(sale_cents, 0) AS sale_cents,
           coalesce(n_lines, 0) AS n_lines, coalesce(n_items, 0) AS n_items, coalesce(line_cents, 0) AS line_cents
    FROM each p LEFT JOIN by_click k ON p.r = k.r AND p.d = k.d LEFT JOIN by_sale b ON p.r = b.r AND p.d = b.d
         LEFT JOIN by_line l ON p.r = l.r AND p.d = l.d LEFT JOIN ahead a ON p.r = a.r"""
