"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

A run of ``part_rows`` rows of an input file is a partition. How many rows each partition sends to each shard is drawn
exactly, as a table with given row and column sums has it under a uniform permutation: the partitions are
halved again and again, and what the left half sends to each shard is a multivariate hypergeometric draw
from what the whole sends (conditional draws, each by inversion over its normalised weights). Beyond
``GROUP_PARTS`` partitions, they are dealt into groups by hash, the matrix of the groups is drawn first, and each
group is halved by itself, so that no row or task holds more than a group. No row of data is touched by this. Then
every row is permuted within its partition, takes its place in its shard and is permuted again within the shard,
both by keyed bijections that need no sort. Only the last step exchanges rows.

Positions come from the file and the row's place in it (``_metadata``), which do not depend on splits or
retries. Inputs that are more than a choice of columns of whole files are first written to the shared folder.

Rows with equal texts are rows like any other and may part: a uniform shuffle with exact sizes cannot hold them
together.

Defined cases: nulls, ties, very long texts and repeated rows are rows like any other; an empty table gives no rows;
shards may be empty; input columns named shard or slot give way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import extended, hidden, revealed, save, without

#: Draws that a broadcast matrix may hold (16 bytes each); with more, the matrix is joined by a shuffle.
BROADCAST_CELLS = 2_000_000
#: Partitions that are halved together at most; with more, groups of about half as many are drawn first.
GROUP_PARTS = 1024


def _hypergeometric(good: str, bad: str, n: str, u: str) -> str:
    """SQL for a draw: how many of ``n`` rows taken from ``good + bad`` are good. Weights outside 12 deviations (below 1e-30) count as none."""
    ratio = "((p.g - k + 1D) * (p.n - k + 1D) / (k * (p.b - p.n + k + 0D)))"
    return f"""
transform(transform(array(struct(cast({good} as long) as g, cast({bad} as long) as b, cast({n} as long) as n, {u} as u)), p ->
  struct(p.g as g, p.b as b, p.n as n, p.u as u,
    greatest(0L, p.n - p.b, cast(floor((p.n + 1D) * (p.g + 1D) / (p.g + p.b + 2D)) as long) - 30L
      - cast(12 * sqrt(p.n * (p.g / greatest(p.g + p.b, 1D)) * (p.b / greatest(p.g + p.b, 1D)) * ((p.g + p.b - p.n) / greatest(p.g + p.b - 1D, 1D))) as long)) as lo,
    least(p.n, p.g, cast(floor((p.n + 1D) * (p.g + 1D) / (p.g + p.b + 2D)) as long) + 30L
      + cast(12 * sqrt(p.n * (p.g / greatest(p.g + p.b, 1D)) * (p.b / greatest(p.g + p.b, 1D)) * ((p.g + p.b - p.n) / greatest(p.g + p.b - 1D, 1D))) as long)) as hi)), p ->
  if(p.hi <= p.lo, p.lo,
    transform(array(aggregate(sequence(p.lo + 1, p.hi), struct(1D as w, 1D as t),
        (a, k) -> struct(a.w * {ratio} as w, a.t + a.w * {ratio} as t), a -> a.t)), t ->
      aggregate(sequence(p.lo + 1, p.hi), struct(1D as w, 1D as c, p.lo as k),
        (a, k) -> if(a.c >= p.u * t, a, struct(a.w * {ratio} as w, a.c + a.w * {ratio} as c, k as k)), a -> a.k))[0]))[0]"""


def _split(seed: int) -> str:
    """SQL for what a node's left half sends to each shard: ``caps`` are the node's column sums, ``left_n`` the rows of its left half."""
    u = f"((pmod(xxhash64({seed}L, salt, depth, node, cast(q.j as long)), 9007199254740992L) + 0.5D) / 9007199254740992D)"
    draw = _hypergeometric("q.c", "(a.rest - q.c)", "a.n", u)
    return f"""
aggregate(transform(caps, (c, j) -> struct(c as c, j as j)),
  struct(left_n as n, aggregate(caps, 0L, (x, y) -> x + y) as rest, cast(array() as array<bigint>) as got),
  (a, cj) -> transform(transform(array(struct(cj.c as c, cj.j as j)), q -> struct(q.c as c, {draw} as k)),
    x -> struct(a.n - x.k as n, a.rest - x.c as rest, concat(a.got, array(x.k)) as got))[0],
  a -> a.got)"""


def matrix(counts: DataFrame, shards: int, seed: int, level: int = 0) -> DataFrame:
    """Rows per partition (``part``, ``rows``) -> ``part`` with ``sends`` (rows to each shard), ``starts`` (its first place in each) and ``sizes`` (of the shards).

    Shard sizes differ by one row at most. The column sums and row sums of ``sends`` are exact. ``part`` may be any column that sorts.
    """
    n, total = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("rows"), F.lit(0))).first()
    sizes = f"transform(sequence(0, {shards} - 1), j -> {total}L div {shards} + if(j < {total}L % {shards}, 1L, 0L))"
    held = F.array_sort(F.collect_list(F.struct("part", "rows"))).alias("parts")
    if n <= GROUP_PARTS:
        most = n
        tree = counts.agg(held).select(F.lit(level).cast("long").alias("salt"), "parts", F.expr(sizes).alias("caps"), F.expr(f"transform(sequence(1, {shards}), j -> 0L)").alias("starts"))
    else:
        group = F.pmod(F.xxhash64("part", F.lit(level)), F.lit(2 * n // GROUP_PARTS))
        grouped = save(counts.withColumn("g", group).groupBy("g").agg(held, F.sum("rows").alias("rows")), "groups")
        upper = matrix(grouped.select(F.col("g").alias("part"), "rows"), shards, seed, level + 1)
        most = grouped.agg(F.max(F.size("parts"))).first()[0]
        tree = grouped.join(upper.withColumnRenamed("part", "g"), "g").select(F.xxhash64("g", F.lit(level)).alias("salt"), "parts", F.col("sends").alias("caps"), "starts")
        tree = save(tree, "group-matrix")
    tree = tree.select("*", F.lit(0).cast("long").alias("node"))
    for depth in range(max(0, (most - 1).bit_length())):
        half = "(size(parts) + 1) div 2"
        tree = tree.select("*", F.lit(depth).cast("long").alias("depth"), F.expr(f"aggregate(slice(parts, 1, {half}), 0L, (a, x) -> a + x.rows)").alias("left_n"))
        tree = tree.select("salt", "node", "parts", "caps", "starts", F.expr(f"if(size(parts) < 2, caps, {_split(seed)})").alias("sent"))
        tree = tree.select(
            "salt",
            F.expr(f"""inline(filter(array(
                struct(node * 2 as node, slice(parts, 1, {half}) as parts, sent as caps, starts as starts),
                struct(node * 2 + 1 as node, slice(parts, {half} + 1, greatest(size(parts), 1)) as parts,
                    zip_with(caps, sent, (a, b) -> a - b) as caps, zip_with(starts, sent, (a, b) -> a + b) as starts)), x -> size(x.parts) > 0))"""),
        )
    return tree.where("size(parts) = 1").select(F.expr("parts[0].part").alias("part"), F.col("caps").alias("sends"), "starts", F.expr(sizes).alias("sizes"))


def permuted(x: str, size: str, key: str) -> str:
    """SQL for a keyed bijection of ``x`` on 0 .. ``size`` - 1.

    Four rounds of modular addition on a grid of a x b >= size cells permute the grid; a cell beyond the
    size is sent on until it falls inside. Fewer than a = ceil(sqrt(size)) cells are beyond, so 32 steps
    are enough for certain up to 1,024 rows and fail with a chance below 1e-48 above; then the query fails.
    """
    h = lambda v, r: f"pmod(xxhash64(p.key, {r}, {v}), {'p.a' if r % 2 else 'p.b'})"
    step = "v"
    for r in (1, 2, 3, 4):
        step = f"transform(array({step}), v -> " + (f"struct((v.l + {h('v.r', r)}) % p.a as l, v.r as r)" if r % 2 else f"struct(v.l as l, (v.r + {h('v.l', r)}) % p.b as r)") + ")[0]"
    return f"""
transform(transform(array(struct(cast({x} as long) as x, cast({size} as long) as m, {key} as key,
    greatest(cast(ceil(sqrt(cast({size} as double))) as long), 1L) as a)), p -> struct(p.x as x, p.m as m, p.key as key, p.a as a, greatest((p.m + p.a - 1) div p.a, 1L) as b)), p ->
  aggregate(sequence(1, 32), struct(p.x as x, false as done), (s, i) -> if(s.done, s,
    transform(array(struct(s.x div p.b as l, s.x % p.b as r)), v -> transform(array({step}), y -> struct(y.l * p.b + y.r as x, y.l * p.b + y.r < p.m as done))[0])[0]),
    s -> if(s.done, s.x, cast(raise_error('a place was not found in 32 steps: take another seed') as bigint))))[0]"""


def shard(docs: DataFrame, shards: int = 16, seed: int = 20240607, part_rows: int = 16_384, block_rows: int = 1024, exchange: bool = True) -> DataFrame:
    """``docs`` with ``shard`` (0 to ``shards`` - 1) and ``slot`` (gapless from 0 in each shard), dealt out in blocks of ``block_rows`` slots."""
    if shards < 1 or part_rows < 1:
        raise ValueError("shards and part_rows must be 1 or more")
    plain = _plain(docs)
    docs, names = hidden(without(docs, ["shard", "slot"]))

    def placed(df):
        row = F.col("_metadata.row_index")
        return df.select(*[F.col(f"`{c}`") for c in df.columns], F.struct(F.col("_metadata.file_path").alias("file"), F.expr(f"_metadata.row_index div {part_rows}").alias("run")).alias("_part"), F.pmod(row, F.lit(part_rows)).alias("_row"))

    def counted(df):
        return save(placed(df).groupBy("_part").agg(F.count(F.lit(1)).alias("rows")), "parts")

    if not plain:
        docs = save(docs, "shard-input")
    counts = counted(docs)
    parts = counts.count()
    sent = save(matrix(counts.select(F.col("_part").alias("part"), "rows"), shards, seed), "matrix")
    side = sent.select(F.col("part").alias("_part"), "sends", "starts", "sizes")
    joined = placed(docs).join(F.broadcast(side) if parts * shards <= BROADCAST_CELLS else side, "_part")
    local = permuted("_row", "aggregate(sends, 0L, (a, x) -> a + x)", f"xxhash64({seed}L, _part)")
    rows = joined.select("*", F.expr(local).alias("_at"))
    # the shard whose run of places holds _at, and the place in it
    rows = rows.select("*", F.expr("""aggregate(sends, struct(_at as left, 0 as j, false as done),
        (a, x) -> if(a.done, a, if(a.left < x, struct(a.left as left, a.j as j, true as done), struct(a.left - x as left, a.j + 1 as j, false as done))))""").alias("_to"))
    rows = rows.select("*", F.col("_to.j").alias("shard"), F.expr("starts[_to.j] + _to.left").alias("_place"))
    rows = rows.select(*[F.col(f"`{c}`") for c in docs.columns], "shard", F.expr(permuted("_place", "sizes[shard]", f"xxhash64({seed + 1}L, shard)")).alias("slot"))
    if not exchange:
        return revealed(rows, names, "shard", "slot")
    block = F.expr(f"slot div {block_rows}")
    return revealed(rows.repartition(F.col("shard"), block).sortWithinPartitions("shard", "slot"), names, "shard", "slot")


def _plain(docs: DataFrame) -> bool:
    """Whether ``docs`` is a choice of columns of whole Parquet files and no more, so that places in files are those of all rows."""
    plan = docs._jdf.queryExecution().analyzed()
    if "_metadata" in docs.columns or not docs.inputFiles() or not plan.deterministic():
        return False
    while plan.children().size() == 1 and plan.nodeName() in ("Project", "SubqueryAlias"):
        plan = plan.children().apply(0)
    return plan.getClass().getSimpleName() == "LogicalRelation" and "parquet" in plan.toString()
