"""Incremental view maintenance by presence bitmasks: one pass gives a joined and grouped view after each of many batches.

A row carries a mask with one bit for each batch after which it is present. A joined row is present when all its parts
are, so joins AND the masks, and rows of an empty mask go at once. Sums, counts and minima are taken under each bit; a
group's ids OR their masks first, so that distinct counts per batch are sums of bits of one row for each id.

Nothing that grows with the input is broadcast, sent to the driver or handled by one task: joins are merge joins of plain
shuffles, which adaptive execution splits where a key is common; groups and ids are summed up before they are shuffled.
The joined rows are written once to the shared folder and read by each aggregation.

Cases: a row without a batch of insertion is there from the start, one without a batch of deletion stays; a row deleted
before it is inserted, or in the same batch, is never there; null join keys meet nothing; repeated rows all count, in joins
too; null values of a measure are left out of its sum and minimum (null if there are none), null ids are not counted; rows
with a null group key drop out; a group without rows in a batch has no row for that batch; empty tables give no rows; other
columns are ignored, whatever their names. At most 62 batches fit into a mask, more are an error.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import quoted, table, tidy, written

MASK, MOST = "mask", 62


def presence(inserted: Column, deleted: Column, batches: int) -> Column:
    """The mask of a row that batch `inserted` brings and batch `deleted` takes away (null: never)."""
    if not 0 < batches <= MOST:
        raise ValueError(f"{batches} batches don't fit into a mask: from 1 to {MOST}")
    within = lambda c, default: F.least(F.greatest(F.coalesce(c, F.lit(default)), F.lit(0)), F.lit(batches)).cast("int")
    low, high = within(inserted, 0), within(deleted, batches)
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), c)
    return F.when(low < high, bit(high) - bit(low)).otherwise(F.lit(0).cast("long"))


def bit(mask: str | Column, batch: int) -> Column:
    return F.shiftright(mask, batch).bitwiseAND(F.lit(1)) == 1


def met(left: DataFrame, right: DataFrame, on: Sequence[tuple[str, str]]) -> DataFrame:
    """The inner join of two masked tables on pairs of columns; their other columns must have different names."""
    l, r = left.where(" and ".join(f"{a} is not null" for a, _ in on)), right.where(" and ".join(f"{b} is not null" for _, b in on)).withColumnRenamed(MASK, "right_mask")
    same = reduce(lambda x, y: x & y, [l[a] == r[b] for a, b in on])
    both = l.join(r.hint("merge"), same).withColumn(MASK, F.col(MASK).bitwiseAND(F.col("right_mask")))
    gone = {b for a, b in on} - {a for a, _ in on}
    return both.where(f"{MASK} <> 0").drop("right_mask", *gone, *[r[b] for a, b in on if a == b])


def per_batch(rows: DataFrame, keys: Sequence[str], batches: int, sums: Mapping[str, str], minima: Mapping[str, str], distinct: Mapping[str, str], count: str = "n_rows") -> DataFrame:
    """(batch, keys, count, sums, minima, distinct counts) of the groups that have rows after each batch.

    sums, minima and distinct name a result by the column it is made of. Distinct counts meet the sums by the groups'
    own partitioning, without another shuffle.
    """
    rows = rows.where(" and ".join(f"{k} is not null" for k in keys))
    aggs = []
    for b in range(batches):
        here = bit(MASK, b)
        aggs.append(F.count_if(here).alias(f"{count}_{b}"))
        aggs += [F.sum(F.when(here, F.col(c))).alias(f"{n}_{b}") for n, c in sums.items()]
        aggs += [F.min(F.when(here, F.col(c))).alias(f"{n}_{b}") for n, c in minima.items()]
    out = rows.groupBy(*keys).agg(*aggs)
    for n, c in distinct.items():
        ids = rows.where(f"{c} is not null").groupBy(*keys, c).agg(F.bit_or(MASK).alias("seen"))
        out = out.join(ids.groupBy(*keys).agg(*[F.count_if(bit("seen", b)).alias(f"{n}_{b}") for b in range(batches)]).hint("merge"), list(keys), "left")
    whole = {count, *distinct}
    names = [count, *sums, *minima, *distinct]
    states = [F.struct(F.lit(b).alias("batch"), *[(F.coalesce(f"{n}_{b}", F.lit(0).cast("long")) if n in whole else F.col(f"{n}_{b}")).alias(n) for n in names]) for b in range(batches)]
    return out.select(*keys, F.inline(F.array(*states))).where(f"{count} > 0").select("batch", *keys, *names)


#: A nation table of more rows than this is joined like any other table.
NATIONS = 4096


def shop_view(lines: DataFrame, sales: DataFrame, clients: DataFrame, vendors: DataFrame, nations: DataFrame) -> DataFrame:
    """(region, part, client, item, revenue, mask) of the lines whose client and vendor are of one nation.

    lines, sales and clients carry masks; vendors and nations are always there.
    """
    few = nations.limit(NATIONS + 1).count() <= NATIONS
    small = (lambda df: F.broadcast(df)) if few else (lambda df: df.hint("merge"))
    regions = nations.select(F.col("n_nationkey").cast("long").alias("nation"), F.col("n_regionkey").cast("int").alias("region")).where("region is not null and nation is not null")
    from_nation = clients.select("client", "nation", F.col(MASK)).join(small(regions), "nation")
    sold = met(sales, from_nation.withColumnRenamed("client", "its_client"), [("client", "its_client")])
    bought = met(lines, sold.withColumnRenamed("sale", "its_sale"), [("sale", "its_sale")])
    all_bits = F.lit((1 << MOST) - 1).alias(MASK)
    known = vendors.join(small(regions.select("nation")), "nation").select(F.col("vendor").alias("its_vendor"), F.col("nation").alias("its_nation"), all_bits)
    return met(bought, known, [("vendor", "its_vendor"), ("nation", "its_nation")]).select("region", F.col("vendor").alias("part"), "client", "item", "revenue", MASK)


@tidy
def view_after_batches(lines: DataFrame, sales: DataFrame, clients: DataFrame, vendors: DataFrame, nations: DataFrame, batches: int) -> DataFrame:
    """The view of shop_view(), grouped by region and part, after each batch."""
    rows = written(shop_view(lines, sales, clients, vendors, nations), "view")
    out = per_batch(rows, ["region", "part"], batches, {"revenue": "revenue"}, {"min_revenue": "revenue"}, {"n_clients": "client", "n_items": "item"}, "n_lines")
    return out.select("batch", "region", "part", "n_lines", "revenue", "min_revenue", "n_clients", "n_items")


def drawn(mark: str, columns: Sequence[str], batches: int) -> Column:
    """The mask of a row by the digits of a checksum of its key: a row is inserted by the first, deleted by the second, if that is later."""
    key = F.concat(F.lit(mark), *[p for i, c in enumerate(columns) for p in ([F.lit(":")] if i else []) + [quoted(c).cast("string")]])
    h = F.crc32(key.cast("binary"))
    first, second = h % batches, F.floor(h / batches) % batches
    moved = first < second
    return presence(F.when(moved, first), F.when(moved, second), batches).alias(MASK)


def op11_view_maintenance(spark, sf_dir):
    """Revenue by client's region and vendor after each of three batches."""
    batches = 3
    lines, sales, clients, vendors, nations = (table(spark, sf_dir, n) for n in ("sale_lines", "sales", "clients", "vendors", "nation"))
    cents, off = F.floor(100 * F.col("amount") + 0.5), F.floor(100 * F.col("discount") + 0.5)
    return view_after_batches(
        lines.where("amount is not null").select(F.col("sale_id").alias("sale"), F.col("vendor_id").alias("vendor"), F.col("item_id").alias("item"), (cents * (100 - off)).alias("revenue"), drawn("l", ["sale_id", "line_no"], batches)),
        sales.select(F.col("sale_id").alias("sale"), F.col("client_id").alias("client"), drawn("s", ["sale_id"], batches)),
        clients.select(F.col("client_id").alias("client"), F.col("nation_id").cast("long").alias("nation"), drawn("c", ["client_id"], batches)),
        vendors.select(F.col("vendor_id").alias("vendor"), F.col("nation_id").cast("long").alias("nation")),
        nations,
        batches,
    )


SQL = r"""
WITH t AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc),
l AS (SELECT *, 'l' || sale_id || ':' || line_no AS k FROM sale_lines WHERE amount IS NOT NULL AND vendor_id IS NOT NULL),
s AS (SELECT *, 's' || sale_id AS k FROM sales), c AS (SELECT *, 'c' || client_id AS k FROM clients),
keys AS (SELECT k FROM l UNION SELECT k FROM s UNION SELECT k FROM c),
h AS (SELECT k, xor(list_reduce(list_concat([4294967295], list_transform(string_split(k, ''), lambda x: ord(x)::BIGINT)), lambda a, x: xor(a >> 8, crc[(xor(a, x) & 255) + 1])), 4294967295) AS h FROM keys, t),
there AS (SELECT k, batch FROM (SELECT k, h % 3 AS a, h // 3 % 3 AS d FROM h), range(3) r(batch) WHERE a >= d OR batch >= a AND batch < d)
SELECT x.batch::INTEGER AS batch, n.n_regionkey::INTEGER AS region, l.vendor_id AS part, count(*) AS n_lines,
  sum(floor(100 * amount + 0.5)::BIGINT * (100 - floor(100 * discount + 0.5)::BIGINT))::BIGINT AS revenue, min(floor(100 * amount + 0.5)::BIGINT * (100 - floor(100 * discount + 0.5)::BIGINT)) AS min_revenue,
  count(DISTINCT c.client_id) AS n_clients, count(DISTINCT l.item_id) AS n_items
FROM l JOIN there x ON x.k = l.k JOIN s ON s.sale_id = l.sale_id JOIN there y ON y.k = s.k AND y.batch = x.batch JOIN c ON c.client_id = s.client_id JOIN there z ON z.k = c.k AND z.batch = x.batch
JOIN vendors v ON v.vendor_id = l.vendor_id AND v.nation_id = c.nation_id JOIN nation n ON n.n_nationkey = c.nation_id WHERE n.n_regionkey IS NOT NULL GROUP BY ALL
"""
