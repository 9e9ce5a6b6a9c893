"""N-gram Jaccard join: size-aware, heavy and light.

A document's set holds its distinct shingles of ``shingle`` words (ASCII white space
divides words, A-Z are lower-cased).  Two sets A and B link when
``den * |A & B| >= num * |A | B|``.  Documents with equal sets are one node throughout, so
copies never multiply.

1. *Order.*  All shingles stand in one global order: first those whose name falls in a fixed
   share of all names, rare before common by their exact counts, then the rest.  Only the
   fixed share is counted (a small set adds what its prefix needs of the rest).  Two sets
   that link share at least ``need = ceil(num/den * max(|A|, |B|))`` shingles, hence at least
   k of the first ``n - ceil(num * n / den) + k`` of each.  Shingles of one set only fill
   prefixes first and match nothing, so most documents have no keys at all.
2. *Light sets*, of at most ``x`` shingles, enumerate all subsets of the fixed size 2 of
   their prefix for k = 2: two light sets that link share a subset.
3. *Heavy sets*, above ``x``, and sets large enough to link with one, are entered in the
   inverted lists of their prefix shingles (k = 1), which are scanned.  ``x`` is where the
   cost of subsets below and of scanned list entries above, summed over all sets, is least.
4. *Hubs.*  A subset or list that several sets share has a hub, its least set.  Every set is
   verified exactly against one hub, that of most of its keys; a hub with many sets is sent to
   many tasks.  Links contract sets to trees, and keys whose sets stand in one tree are done.
5. *The rest.*  Sets that share a key which is not done are in one group.  Sets outside a group's
   largest tree are decided against each other and against that tree, by scanning inverted
   lists of shingles; sets within the tree never meet again.  Blocks of ``GROUP`` sets (fewer where
   sets are large) bound a task, and each pair of blocks is a task of its own, so no pair is
   lost.  Only links that join two parts of a task's forest are emitted.
6. Components of the links give each document's class.

Defined results: null, empty and white-space texts have the empty set and link with
nothing; a text of fewer words than ``shingle`` has one shingle of all its words; rows that
repeat an id are one node whose links are those of all its rows, with a row each in the
result, of which those with an empty set have their own id as component; a null id is never linked and its component is null; texts of any length are taken whole;
only the key and the text are read, so other columns may have any name.
Shingles have 64-bit names.  A set's name has 64 bits too, and a second one tells whether it
names different sets; those go by their second name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnlight.llm.components import components
from tarnlight.llm.shared import StepTables, pair_name, utf8, width

GROUP = 1_024
#: Blocks that a group has at least, where its blocks keep an eighth of ``GROUP``: so many that tasks spread.
SPREAD = 16
#: Sets that meet their hub in one task.
PART = 256
SIZES = 4_096

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def word_names(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh3_64_intdigest

    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))


def shingle_set(text: bytes | None, shingle: int) -> np.ndarray:
    """Sorted distinct 64-bit names of a text's shingles."""
    words = (text or b"").translate(_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    names = word_names(words)
    size = min(shingle, len(words))
    out = names[: len(names) - size + 1]
    for j in range(1, size):
        out = pair_name(out, names[j : len(names) - size + 1 + j])
    return np.unique(out)


def required(n: int | np.ndarray, num: int, den: int):
    """Shingles that a set of n shares at least with any set that it links with."""
    return -(-num * n // den)


# --- step 1: sets, and the shingles that may stand in prefixes -------------------


def counted_share(num: int, den: int) -> float:
    """The share of names that is counted: twice what a prefix needs."""
    return min(1.0, 2 * (den - num) / den)


def head_of(names: np.ndarray, num: int, den: int) -> tuple[np.ndarray, int]:
    """(names that may stand in the prefix, how many of them are counted ones) of a sorted set.

    Counted names are the smallest; a set with too few of them adds the next smallest.
    """
    n = len(names)
    counted = int(np.searchsorted(names, np.uint64(min(counted_share(num, den) * 2.0**64, 2.0**64 - 2048))))
    longest = min(n, n - int(required(n, num, den)) + 2)
    return names[: max(counted, longest)], counted


TOKENS = "doc {kind}, sid bigint, other bigint, n bigint, m int, token bigint, place int"


def set_names(names: np.ndarray, bits: int = 64) -> tuple[int, int]:
    """The name of a set (of ``bits`` bits) and its second name."""
    from xxhash import xxh3_64_intdigest

    packed = names.tobytes()
    return xxh3_64_intdigest(packed) & (1 << bits) - 1, xxh3_64_intdigest(packed, 1)


def _tokens(docs: DataFrame, shingle: int, num: int, den: int, bits: int, second: bool = False) -> DataFrame:
    """A row (doc, sid, other, n, m) for each document and a row (sid, token, place) for each name in its head.

    ``sid`` names the set and ``other`` is its second name (with ``second`` the other way round, and on
    every row); ``m`` counts the counted names; ``place`` is -1 for those, else the place among the added ones.
    """
    names = ("doc", "sid", "other", "n", "m", "token", "place")

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            cells = utf8(batch.column(1))
            kind = batch.column(0).type
            for at in range(0, len(cells), 512):
                own = batch.column(0).slice(at, 512)
                sids, sizes, counted, heads = [], [], [], []
                for cell in cells[at : at + 512]:
                    found = shingle_set(cell, shingle)
                    head, m = head_of(found, num, den)
                    sids.append(set_names(found, bits)[:: -1 if second else 1])
                    sizes.append(len(found))
                    counted.append(m)
                    heads.append(head if len(found) > 1 else head[:0])  # one shingle links with its equals only
                sid, other = np.array(sids, np.uint64).view(np.int64).T
                count = len(own)
                yield pa.RecordBatch.from_arrays([own, pa.array(sid), pa.array(other), pa.array(sizes, pa.int64()), pa.array(counted, pa.int32()), pa.nulls(count, pa.int64()), pa.nulls(count, pa.int32())], names=names)
                some = own.is_valid().to_numpy(zero_copy_only=False)
                heads = [h if ok else h[:0] for h, ok in zip(heads, some)]
                lengths = [len(h) for h in heads]
                total = sum(lengths)
                if total:
                    place = np.concatenate([np.maximum(np.arange(k) - m, -1) for k, m in zip(lengths, counted)]).astype(np.int32)
                    others = pa.array(np.repeat(other, lengths)) if second else pa.nulls(total, pa.int64())
                    columns = [pa.nulls(total, kind), pa.array(np.repeat(sid, lengths)), others, pa.nulls(total, pa.int64()), pa.nulls(total, pa.int32()), pa.array(np.concatenate(heads).view(np.int64)), pa.array(place)]
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, TOKENS.format(kind=docs.schema["doc"].dataType.simpleString()))


def _named(own: DataFrame, tables: StepTables, shingle: int, num: int, den: int, bits: int) -> tuple[DataFrame, DataFrame, list[str], DataFrame | None]:
    """(nodes, tokens, tables to drop, clashes): no two sets have one name; ``clashes`` holds the names that different sets had, if any."""
    rows, path = tables.write(_tokens(own, shingle, num, den, bits))
    nodes = tables.keep(rows.filter("token IS NULL").select("doc", "n", "sid", "m", "other"))
    tokens = rows.filter("token IS NOT NULL").select("sid", "token", "place")
    clashes = tables.keep(nodes.groupBy("sid").agg(F.min("other").alias("lo"), F.max("other").alias("hi")).filter("lo <> hi").select("sid"))
    if clashes.isEmpty():
        return nodes, tokens, [path], None
    docs = nodes.join(clashes, "sid", "left_semi").select("doc").distinct()
    again, again_path = tables.write(_tokens(own.join(docs, own.doc.eqNullSafe(docs.doc), "left_semi"), shingle, num, den, bits, second=True))
    again = again.join(clashes.withColumnRenamed("sid", "other"), "other", "left_semi")
    nodes = tables.keep(nodes.join(clashes, "sid", "left_anti").select("doc", "n", "sid", "m").unionByName(again.filter("token IS NULL").select("doc", "n", "sid", "m")))
    tokens = tokens.join(clashes, "sid", "left_anti").unionByName(again.filter("token IS NOT NULL").select("sid", "token", "place"))
    return nodes, tokens, [path, again_path], clashes


def _heads(tokens: DataFrame, nodes: DataFrame, tables: StepTables, num: int, den: int) -> DataFrame:
    """(sid, n, pairs, singles): the shared names in each set's prefixes for k = 2 and k = 1, in the global order.

    Counts are summed on the map side before they meet; a name that very many sets share is
    joined by a key that Spark may split, and no group is ever held by name.
    """
    shared = tables.keep(tokens.groupBy("token").agg(F.count("*").alias("df"), F.min("sid").alias("lo"), F.max("sid").alias("hi")).filter("lo <> hi").select("token", "df"))
    cell = F.struct("place", F.when(F.col("place") < 0, F.col("df")).otherwise(0).alias("rank"), "token", "df")
    cells = tokens.join(shared, "token").select("sid", cell.alias("cell")).groupBy("sid").agg(F.sort_array(F.collect_set("cell")).alias("cells"))
    out = cells.join(nodes.groupBy("sid").agg(F.first("n").alias("n"), F.first("m").alias("m")), "sid")
    counted = F.filter("cells", lambda x: x.place < 0)
    out = out.withColumns({"counted": counted, "added": F.filter("cells", lambda x: x.place >= 0)})
    alone = F.col("m") - F.size("counted")  # names of this set only
    base = F.col("n") - F.ceil(F.col("n") * num / F.lit(den)).cast("int")

    def prefix(k: int) -> Column:
        length = F.least(base + k, F.col("n")).cast("int")
        return F.concat(F.slice("counted", F.lit(1), F.greatest(length - alone, F.lit(0)).cast("int")), F.filter("added", lambda x: x.place < length - F.col("m")))

    return tables.keep(out.select("sid", "n", prefix(2).alias("pairs"), prefix(1).alias("singles")))


# --- step 2: the boundary and the keys ----------------------------------------


def light_limit(costs: list[tuple[int, float, float]]) -> int:
    """The largest light size, from (size, cost as light, cost as heavy): where light costs below and heavy costs above are least."""
    at, below, above = 0, 0.0, sum(h for _, _, h in costs)
    best = above
    for size, light, heavy in sorted(costs):
        below, above = below + light, above - heavy
        if below + above <= best:
            best, at = below + above, size
    return at


def _costs(heads: DataFrame) -> list[tuple[int, float, float]]:
    """Subsets of, and list entries scanned for, the sets of each size; sizes above ``SIZES`` are one."""
    subsets = F.size("pairs") * (F.size("pairs") - 1) / 2
    scanned = F.aggregate("singles", F.lit(0).cast("double"), lambda a, x: a + x.df)
    rows = heads.groupBy(F.least("n", F.lit(SIZES)).alias("n")).agg(F.sum(subsets).alias("l"), F.sum(scanned).alias("h")).collect()
    return [(r["n"], r["l"], r["h"]) for r in rows]


def _keys(heads: DataFrame, limit: int, num: int, den: int) -> DataFrame:
    """(key, sid): subsets of light sets, list entries of sets that may meet a heavy one."""
    places = F.sequence(F.lit(0), F.size("pairs") - 1)
    two = F.flatten(F.transform(F.when(F.size("pairs") > 1, places), lambda i: F.transform(F.slice("pairs", i + 2, F.size("pairs")), lambda y: F.xxhash64(F.get("pairs", i).token, y.token))))
    one = F.transform("singles", lambda x: F.xxhash64(x.token))
    none = F.expr("cast(array() as array<bigint>)")
    light = F.when((F.col("n") <= limit) & (F.size("pairs") > 1), two)
    heavy = F.when(F.col("n") * den >= num * (limit + 1), one)
    return heads.select("sid", F.explode(F.concat(F.coalesce(light, none), F.coalesce(heavy, none))).alias("key"))


# --- step 4: sets against their hubs -------------------------------------------


def _packed_sets(docs: DataFrame, shingle: int, bits: int, clashes: DataFrame | None) -> DataFrame:
    """(sid, set) of documents, a row for each set: its name, and its sorted shingle names, packed."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            cells = utf8(batch.column(1))
            for at in range(0, len(cells), 512):
                found = [shingle_set(c, shingle) for c in cells[at : at + 512]]
                sid, other = np.array([set_names(x, bits) for x in found], np.uint64).view(np.int64).T
                yield pa.RecordBatch.from_arrays([pa.array(sid), pa.array(other), pa.array([x.tobytes() for x in found], pa.binary())], names=["sid", "other", "set"])

    out = docs.mapInArrow(run, "sid bigint, other bigint, set binary")
    if clashes is not None:
        known = clashes.withColumn("clash", F.lit(True))
        out = out.join(known, "sid", "left").withColumn("sid", F.when(F.col("clash"), F.col("other")).otherwise(F.col("sid")))
    return out.select("sid", "set").dropDuplicates(["sid"])


def _fetch(work: DataFrame, own: DataFrame, real: DataFrame, shingle: int, bits: int, clashes: DataFrame | None) -> DataFrame:
    """``work`` with the packed set of each row's ``sid``; each set is made once, from one document."""
    wanted = work.select("sid").distinct().join(real.groupBy("sid").agg(F.min("doc").alias("doc")), "sid")
    # A sort-merge join at every size: the list of wanted documents grows with the input.
    docs = own.join(wanted.select("doc").distinct().hint("merge"), "doc", "left_semi")
    return work.join(_packed_sets(docs, shingle, bits, clashes), "sid")


def _runs_of(key: tuple[int, ...], solve) -> object:
    """A mapInArrow function: gathers neighbouring rows with equal ``key`` columns and yields ``solve``'s links of each run as (a, b)."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        current = None

        def links() -> Iterator[pa.RecordBatch]:
            found = solve(held) if len(held) > 1 else []
            if found:
                a, b = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in source:
            last = batch.num_columns - 1
            for row in zip(*[utf8(batch.column(i)) if i == last else batch.column(i).to_pylist() for i in range(last + 1)]):
                name = tuple(row[i] for i in key)
                if name != current:
                    yield from links()
                    held, current = [], name
                held.append(row)
        if held:
            yield from links()

    return run


def star_links(hub: np.ndarray, sets: list[np.ndarray], num: int, den: int) -> list[int]:
    """Which of ``sets`` link with ``hub``."""
    out = []
    for i, one in enumerate(sets):
        shared = int((hub[np.minimum(np.searchsorted(hub, one), len(hub) - 1)] == one).sum())
        if den * shared >= num * (len(hub) + len(one) - shared):
            out.append(i)
    return out


def _star_tasks(entries: DataFrame, part: int) -> DataFrame:
    """(hub, part, member, sid): each set with the hub of most of its keys, hubs once for each part of their sets."""
    met = entries.filter("sid <> hub").groupBy("sid", "hub").agg(F.count("*").alias("c"))
    stars = met.groupBy("sid").agg(F.max_by("hub", F.struct("c", "hub")).alias("hub"))
    parts = stars.groupBy("hub").agg(F.ceil(F.count("*") / part).cast("int").alias("parts"))
    members = stars.join(parts, "hub").select("hub", F.pmod(F.xxhash64("sid"), "parts").cast("int").alias("part"), F.lit(1).alias("member"), "sid")
    return members.unionByName(parts.select("hub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("member"), F.col("hub").alias("sid")))


def _decide_stars(tasks: DataFrame, num: int, den: int) -> DataFrame:
    def solve(rows: list[tuple]) -> list[tuple[int, int]]:
        if rows[0][2]:  # no hub: its part holds no other set
            return []
        sets = [np.frombuffer(r[4], np.uint64) for r in rows]
        return [(rows[0][3], rows[1 + i][3]) for i in star_links(sets[0], sets[1:], num, den)]

    return tasks.select("hub", "part", "member", "sid", "set").mapInArrow(_runs_of((0, 1), solve), "a bigint, b bigint")


# --- step 5: exact decision within a group ------------------------------------


def group_links(sets: list[np.ndarray], num: int, den: int, split: int | None = None, trees: list[int] | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links among ``sets``; with ``split``, of those between ``sets[:split]`` and the rest.

    ``trees`` tells which sets are known to stand in one tree.  Scans inverted lists: the
    lists of a set's shingles are counted at once, which decides all its pairs.  Sets outside the
    largest tree are scanned first; when all that are left unscanned stand in one tree, every
    pair of different trees has been decided.
    """
    count = len(sets)
    lengths = np.array([len(s) for s in sets], np.int64)
    every = np.concatenate(sets)
    order = np.argsort(every, kind="stable")
    lists, owner = every[order], np.repeat(np.arange(count), lengths)[order]
    starts = np.flatnonzero(np.r_[True, lists[1:] != lists[:-1]])
    stops = np.r_[starts[1:], len(lists)]
    values = lists[starts]
    tree = np.arange(count) if trees is None else np.unique(trees, return_inverse=True)[1]
    waiting = np.ones(count, bool)
    side = np.arange(count) < (count if split is None else split)
    links = []
    while True:
        largest = np.bincount(tree).argmax()
        rest = np.flatnonzero(waiting & (tree != largest))
        if not len(rest):
            return links
        for i in rest if len(links) else rest[:1]:
            waiting[i] = False
            at = np.searchsorted(values, sets[i])
            first, size = starts[at], stops[at] - starts[at]
            total = int(size.sum())
            if total == lengths[i]:
                continue
            spread = np.repeat(first - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(total)
            shared = np.bincount(owner[spread], minlength=count)
            linked = (den * shared >= num * (lengths[i] + lengths - shared)) & (tree != tree[i])
            if split is not None:
                linked &= side != side[i]
            for j in np.flatnonzero(linked):
                if tree[i] != tree[j]:
                    tree[tree == tree[j]] = tree[i]
                    links.append((int(i), int(j)))


def _group_tasks(members: DataFrame, group_size: int) -> DataFrame:
    """(group, left, right, block, tree, sid): a row for each task that a set of ``members`` (sid, tree, group, n) takes part in.

    The sets outside a group's largest tree fill blocks 0 to s - 1, the others s to s + r - 1; tasks
    are all pairs of blocks of which one at least is of the former.
    """

    def blocks(mine: Column) -> Column:
        count = F.count_if(mine)
        spread = F.least(F.lit(SPREAD), count / F.lit(group_size / 8))
        return F.ceil(F.greatest(count / group_size, spread, F.sum(F.when(mine, F.col("n"))) / (group_size * 512))).cast("int")

    trees = members.groupBy("group", "tree").agg(F.count("*").alias("c"))
    main = trees.groupBy("group").agg(F.max_by("tree", F.struct("c", "tree")).alias("main"))
    sided = members.join(main, "group").withColumn("aside", F.col("tree") != F.col("main"))
    sizes = sided.groupBy("group").agg(blocks(F.col("aside")).alias("s"), blocks(~F.col("aside")).alias("r"))
    out = sided.join(sizes, "group").withColumn("block", F.when(F.col("aside"), F.pmod(F.xxhash64("sid"), "s")).otherwise(F.col("s") + F.pmod(F.xxhash64("sid"), "r")).cast("int"))
    last = F.when(F.col("aside"), F.col("s") + F.col("r")).otherwise(F.col("s")) - 1
    out = out.withColumn("other", F.explode(F.sequence(F.lit(0), last.cast("int"))))
    return out.select("group", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"), "block", "tree", "sid")


def _decide_groups(tasks: DataFrame, num: int, den: int) -> DataFrame:
    def solve(rows: list[tuple]) -> list[tuple[int, int]]:
        left, right = rows[0][1], rows[0][2]
        split = None if left == right else sum(r[3] == left for r in rows)
        if split == 0 or split == len(rows):
            return []
        sets = [np.frombuffer(r[6], np.uint64) for r in rows]
        return [(rows[i][5], rows[j][5]) for i, j in group_links(sets, num, den, split, [r[4] for r in rows])]

    return tasks.select("group", "left", "right", "block", "tree", "sid", "set").mapInArrow(_runs_of((0, 1, 2), solve), "a bigint, b bigint")


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, num: int = 8, den: int = 10, group_size: int = GROUP, part: int = PART, limit: int | None = None, bits: int = 64) -> DataFrame:
    """(key, n_shingles, component_id): a row for each row of ``docs``.

    ``component_id`` is the smallest key reachable by links.  ``limit`` fixes the light
    boundary instead of the cost model, and ``bits`` the length of set names (both for tests).
    """
    if not den < 2 * num <= 2 * den:
        raise ValueError("the threshold must be above 1/2 and at most 1")
    own = docs.select(F.col(key).alias("doc"), F.col(text).alias("text"))
    tables, partitions = StepTables(own, "jaccard"), width(docs.sparkSession)
    nodes, tokens, done, clashes = _named(own, tables, shingle, num, den, bits)
    real = nodes.filter("n > 0 AND doc IS NOT NULL")
    heads = _heads(tokens, real, tables, num, den)
    for path in done:
        tables.drop(path)
    if limit is None:
        limit = light_limit(_costs(heads))

    keys = _keys(heads, limit, num, den)
    met = keys.groupBy("key").agg(F.min("sid").alias("hub"), F.max("sid").alias("top")).filter("hub <> top").select("key", "hub")
    entries = tables.keep(keys.join(met, "key"))
    stars = _fetch(tables.keep(_star_tasks(entries, part)), own, real, shingle, bits, clashes)
    stars = stars.repartition(partitions, "hub", "part").sortWithinPartitions("hub", "part", "member", "sid")
    links = tables.keep(_decide_stars(stars, num, den))

    trees = tables.keep(components(links, tables))
    placed = entries.join(trees, F.col("sid") == F.col("node"), "left").select("key", "sid", F.coalesce("component", "sid").alias("tree"))
    least = placed.groupBy("key").agg(F.min("tree").alias("least"), F.max("tree").alias("top")).filter("least <> top").select("key", "least")
    rest = tables.keep(placed.join(least, "key").select("sid", "tree", "least").distinct())
    several = real.groupBy("doc").agg(F.min("sid").alias("b"), F.max("sid").alias("top")).filter("b <> top").select("doc", "b")
    # Rows of one id tie their sets together.
    ties = tables.keep(real.join(several, "doc").filter("sid <> b").select(F.col("sid").alias("a"), "b"))
    if not rest.isEmpty():
        joined = rest.filter("tree <> least").select(F.col("tree").alias("a"), F.col("least").alias("b")).distinct()
        groups = components(joined, tables).withColumnRenamed("node", "tree").withColumnRenamed("component", "group")
        members = rest.select("sid", "tree").distinct().join(groups, "tree").join(real.groupBy("sid").agg(F.first("n").alias("n")), "sid")
        work = _fetch(tables.keep(_group_tasks(tables.keep(members), group_size)), own, real, shingle, bits, clashes)
        work = work.repartition(partitions, "group", "left", "right").sortWithinPartitions("group", "left", "right", F.col("block") != F.col("left"), "sid")
        links = links.unionByName(tables.keep(_decide_groups(work, num, den)))
        trees = components(links.unionByName(ties), tables)
    elif not ties.isEmpty():
        trees = components(links.unionByName(ties), tables)

    linked = real.join(trees.withColumnRenamed("node", "sid"), "sid", "left").select("sid", "doc", F.coalesce("component", "sid").alias("tree"))
    lowest = linked.groupBy("tree").agg(F.min("doc").alias("component_id"))
    classes = linked.select("sid", "tree").distinct().join(lowest, "tree").select("sid", "component_id")
    out = nodes.join(classes, "sid", "left")
    component = F.when(F.col("doc").isNotNull(), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc")))
    return out.select(F.col("doc").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id")).coalesce(tables.parts)


def brute_force(docs: list[tuple], shingle: int = 3, num: int = 90, den: int = 100) -> list[tuple]:
    """All pairs of a small table, by string shingles; for tests."""
    sets = []
    for doc, text in docs:
        words = ("" if text is None else text).encode().translate(_LOWER).split()
        size = min(shingle, len(words))
        sets.append({tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if words else set())
    label = {doc: doc for doc, _ in docs if doc is not None}
    changed = True
    while changed:
        changed = False
        for i, (a, _) in enumerate(docs):
            for j, (b, _) in enumerate(docs[:i]):
                if sets[i] and sets[j] and a is not None and b is not None and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]) and label[a] != label[b]:
                    low = min(label[a], label[b])
                    label[a] = label[b] = low
                    changed = True
    return [(doc, len(s), label.get(doc) if s else doc) for (doc, _), s in zip(docs, sets)]
