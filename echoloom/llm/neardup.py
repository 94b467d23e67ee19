"""Near-duplicate documents by MinHash with tensored banding, links confirmed on full shingle sets.

Two small collections of ``halves`` half keys are computed, each key from ``width`` MinHash values. The keys of
the ``halves ** 2`` hash tables are all pairs of one half key of either collection, so 2 * halves * width hash
functions serve tables that would need halves ** 2 * 2 * width. With similarity s a pair shares a table with
probability (1 - (1 - s**width) ** halves) ** 2; the defaults give 0.9995 at 0.8 and nearly 1 above 0.85.

Candidates are representatives that share a table key, so a half key of either collection; every one is decided.

The stages, none of which makes all pairs of a group:

1. Equal shingle sets become one class with the smallest id as representative (counted in part before the shuffle).
2. Half keys of the first collection that only one representative has can't collide; the rest are paired with
   those of the second collection.
3. Every table's bucket has one leader, and each representative is compared with ``tried`` of the leaders that it
   meets: those that a 128-bit sketch takes for the nearest. Links make components.
4. Candidates of different components are left. Two sets of the threshold's similarity share one of their first
   shingles in any order of all shingles, if as many are taken as may lack in the other set, and one more. The order
   takes shingles that one component alone has, which can't be shared with another, and then rare ones before common ones. Sets
   whose first shingles are all their component's own are done. A shingle that few sets begin with gives pairs, which
   are candidates if they share half keys of both collections. Sets that begin with a shingle of many sets meet by
   their first half keys, whatever the size of the bucket: all rows outside a bucket's largest component against all of its
   rows, in blocks of bounded rows and shingles, by matrix products that give all intersections at once; links count
   where a half key of the second collection is shared as well. Rows of the largest component aren't compared with each
   other. So texts that are similar below the threshold, by their own or rare shingles, cost what they are long, however
   many they are; only sets whose first shingles are common to many, but not linked, are compared in blocks.

Keys that many rows share (leaders, components, copies) meet what is known of them in salted joins: the one row of a
key is copied to ``SALTS`` tasks. Hot table keys and shingles, of which there can be few, are broadcast. Links and
components stay in tables; loops write each round to the shared folder and drop the one before.

Null and empty texts have no shingles and are linked with nothing. Rows with one id are one document, with the links
of all its texts. Rows with a null id keep a null component and are kept. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_stored, map_texts, operator, store

_MIX = np.uint64(0x9E3779B97F4A7C15)
SALTS = 16


def words_of(text: str | None) -> list[bytes]:
    """Words between the bytes 0x20 and 0x09-0x0D, with A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct ``size``-word shingles; fewer words are one shingle."""
    words = words_of(text)
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(h) - size + 1)
    out = np.full(n, len(h) if len(h) < size else size, np.uint64)
    for k in range(min(size, len(h))):
        out = (out ^ h[k : k + n]) * _MIX
        out ^= out >> np.uint64(29)
    return np.unique(out)


class Signer:
    """Half keys and a 128-bit sketch of a shingle set."""

    def __init__(self, halves: int, width: int, seed: int = 11) -> None:
        self.halves, self.width = halves, width
        n = 2 * halves * width
        rng = np.random.default_rng(seed)
        self.a = rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 1 << 63, n, np.uint64)

    def minima(self, s: np.ndarray) -> np.ndarray:
        low = np.full(len(self.a), np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(s), 512):
            np.minimum(low, (s[at : at + 512, None] * self.a + self.b).min(0), out=low)
        return low

    def sign(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low = self.minima(s).reshape(2 * self.halves, self.width)
        key = np.zeros(2 * self.halves, np.uint64)
        for k in range(self.width):
            key = (key ^ low[:, k]) * _MIX
            key ^= key >> np.uint64(31)
        bits = ((low.ravel()[np.arange(128) % low.size] >> np.uint64(17)) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(63)
        words = np.packbits(bits.astype(np.uint8)).view(np.int64)
        return key.view(np.int64), words


def looked_up(rows: DataFrame, key: str, table: DataFrame, table_key: str, salts: int = SALTS, how: str = "inner") -> DataFrame:
    """Rows with the one row of ``table`` that has their key; many rows of one key are spread over ``salts`` tasks.

    The copies are shuffled at any size: broadcast, they would weigh on the driver.
    """
    salt = F.pmod(F.xxhash64(*rows.columns), F.lit(salts))
    copies = table.withColumn("__salt_2", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
    salted = rows.withColumn("__salt", salt)
    copies = copies.hint("merge")
    return salted.join(copies, (salted[key] == copies[table_key]) & (F.col("__salt") == F.col("__salt_2")), how).drop("__salt", "__salt_2")


def connected(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Components of undirected links: node, component (its smallest node). Smallest labels spread to neighbours
    and labels jump to their own label's label, so long chains take logarithmic rounds."""
    spark = links.sparkSession
    both = links.select(F.col(a).alias("u"), F.col(b).alias("v"))
    both, links_at = store(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    label, at = store(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("component")))
    while True:
        seen = looked_up(both, "v", label, "node").groupBy("u").agg(F.min("component").alias("near"))
        spread = label.join(seen, label["node"] == seen["u"]).select("node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        # the old label's node may be told of a smaller one as well (hooking), then every label jumps
        hook = spread.groupBy(F.col("old").alias("root")).agg(F.min("component").alias("hooked"))
        spread = looked_up(spread, "old", hook, "root").select("node", "old", F.least("component", "hooked").alias("component"))
        jump = spread.select(F.col("node").alias("at"), F.col("component").alias("further"))
        new, new_at = store(looked_up(spread, "component", jump, "at").select("node", "old", F.least("component", "further").alias("component")))
        drop_stored(spark, at)
        at, label = new_at, new.select("node", "component")
        if not new.filter(F.col("old") != F.col("component")).limit(1).count():
            drop_stored(spark, links_at)
            return label


def _confirmed(pairs: DataFrame, sets: DataFrame, num: int, den: int, together: int = 1024) -> DataFrame:
    """Of pairs (a, b) of representatives those with den * intersection >= num * union of their full sets.

    A representative that is ``b`` in many pairs has its set copied once for about each ``together`` of them.
    """
    parts = cut(pairs.groupBy(F.col("b").alias("of")).agg(F.ceil(F.count("*") / together).alias("parts")))
    dealt = looked_up(pairs.select("a", "b"), "b", parts, "of").select("a", "b", F.pmod(F.xxhash64("a"), "parts").alias("part"))
    left = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("sa"))
    each = parts.select("of", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"))
    right = each.join(sets, F.col("of") == F.col("rep")).select(F.col("of").alias("b"), "part", F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    found = dealt.join(left, "a").join(right, ["b", "part"])
    return found.filter(den * both >= num * (F.size("sa") + F.size("sb") - both)).select("a", "b")


def block_links(component: np.ndarray, minor: np.ndarray, sets: list[np.ndarray], second: np.ndarray, num: int, den: int, width: int = 2048) -> list[tuple[int, int]]:
    """Links between minor rows and any rows of other components that share a half key of the ``second`` collection (a
    row of keys a set), for a later check on full sets.

    Of clear links (half a percent above the threshold) a spanning forest is given, and all of those within half a
    percent of it between trees, since shortened hashes may shift these. All intersections come from products of 0/1
    matrices, over a bounded part of the shingles at a time.
    """
    names, root = np.unique(component, return_inverse=True)
    few = np.flatnonzero(minor)
    if len(names) < 2 or not len(few):
        return []
    sets = [np.unique(s) for s in sets]
    n = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), n)
    shingle, at, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = seen[at] > 1  # the others are in no intersection
    order = np.argsort(at[shared], kind="stable")
    owner, at = owner[shared][order], at[shared][order]
    new = np.cumsum(np.append(0, np.diff(at) > 0)) if len(at) else at
    both = np.zeros((len(few), len(sets)), np.float32)
    for low in range(0, int(new[-1]) + 1 if len(new) else 0, width):
        a, b = np.searchsorted(new, (low, low + width))
        part = np.zeros((len(sets), width), np.float32)
        part[owner[a:b], new[a:b] - low] = 1
        both += part[few] @ part.T
    size = n.astype(np.float32)
    union = size[few][:, None] + size[None, :] - both
    apart = root[few][:, None] != root[None, :]
    clear = (den * both >= 1.005 * num * union) & apart
    close = (den * both >= 0.995 * num * union) & apart & ~clear

    def candidates(which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i, j = np.nonzero(which)
        met = np.zeros(len(i), bool)
        for k in range(second.shape[1]):
            met |= second[few[i], k] == second[j, k]
        return i[met], j[met]

    i, j = candidates(clear)
    parent = list(range(len(names)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for x, y in zip(few[i].tolist(), j.tolist(), strict=True):
        p, q = find(root[x]), find(root[y])
        if p != q:
            parent[max(p, q)] = min(p, q)
            out.append((x, y))
    i, j = candidates(close)
    return out + [(x, y) for x, y in zip(few[i].tolist(), j.tolist(), strict=True) if find(root[x]) != find(root[y])]


@operator
def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, num: int = 80, den: int = 100, halves: int = 16, width: int = 4, tried: int = 2, together: int = 64, block_rows: int = 512, block_shingles: int = 500_000
) -> DataFrame:
    """Per row: id, n_shingles, component_id (smallest id reachable over links), kept (it is its own component)."""
    spark = docs.sparkSession
    text = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").alias("text"))

    def make():
        signer = Signer(halves, width)

        def f(x):
            out = {"id": x["id"], "n": [], "f0": [], "f1": [], "k": [], "s0": [], "s1": []}
            for t in x["text"]:
                s = shingle_set(t, shingle)
                digest = xxhash.xxh3_128_digest(s.tobytes())
                out["n"].append(len(s))
                out["f0"].append(int.from_bytes(digest[:8], "big", signed=True))
                out["f1"].append(int.from_bytes(digest[8:], "big", signed=True))
                keys, bits = signer.sign(s) if len(s) else ([], (0, 0))
                out["k"].append(list(map(int, keys)))
                out["s0"].append(int(bits[0]))
                out["s1"].append(int(bits[1]))
            return out

        return f

    signed, signed_at = store(map_texts(text, ["id", "text"], make, "id bigint, n int, f0 bigint, f1 bigint, k array<bigint>, s0 bigint, s1 bigint"))
    full = signed.filter((F.col("n") > 0) & F.col("id").isNotNull())
    by_set = full.groupBy("f0", "f1").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("k").alias("k"), F.first("s0").alias("s0"), F.first("s1").alias("s1"))
    reps, reps_at = store(by_set)

    # 2. first half keys that several representatives have
    first = reps.select("rep", F.posexplode(F.slice("k", 1, halves)).alias("slot", "value"))
    shared = first.groupBy("slot", "value").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).filter("lo < hi").select("slot", "value")
    alive = first.join(shared, ["slot", "value"]).groupBy("rep").agg(F.collect_list(F.xxhash64("slot", "value")).alias("first"))  # at most ``halves`` each
    tabled = reps.select("rep", "n", "s0", "s1", F.slice("k", halves + 1, halves).alias("second")).join(alive, "rep")
    tabled, tabled_at = store(tabled)

    def keyed(rows: DataFrame) -> DataFrame:
        one = rows.select("rep", "second", F.explode("first").alias("one"))
        return one.select("rep", "one", F.posexplode("second").alias("j", "two")).select("rep", F.xxhash64("one", "j", "two").alias("key"))

    ids = tabled.select(F.col("rep").alias("id"))

    def make_sets():
        return lambda x: {"rep": x["id"], "shingles": [shingle_set(t, shingle).view(np.int64) for t in x["text"]]}

    sets, sets_at = store(map_texts(text.join(ids, "id", "left_semi"), ["id", "text"], make_sets, "rep bigint, shingles array<bigint>"))

    # bits of equal MinHash values agree, others by half: mean mismatches 64 * (1 - s); 4 deviations of the binomial at the threshold
    miss = 0.5 * (1 - num / den)
    most = int(128 * miss + 4 * (128 * miss * (1 - miss)) ** 0.5) + 1
    apart = F.bit_count(F.col("s0").bitwiseXOR(F.col("s0_2"))) + F.bit_count(F.col("s1").bitwiseXOR(F.col("s1_2")))
    near_enough = (den * F.least("n", "n_2") >= num * F.greatest("n", "n_2")) & (apart <= most)

    # 3. the leader of a bucket is the representative with the smallest hash, which is one to one
    keys = keyed(tabled)
    lead = keys.groupBy(F.col("key").alias("of_key")).agg(F.min(F.xxhash64("rep")).alias("lead"), F.min("rep").alias("lo"), F.max("rep").alias("hi"), F.count("*").alias("m")).filter("lo < hi")
    lead = cut(lead.select("of_key", "lead", "m"))
    # keys with more than a 2,000th of all rows, so less than 2,000 of them, meet their leader by a broadcast
    edge = tabled.select(F.sum(F.size("first") * halves)).first()[0] or 0
    hot, usual = lead.filter(F.col("m") > edge / 2000), lead.filter(F.col("m") <= edge / 2000)
    here = F.col("key") == F.col("of_key")
    rest = keys.join(F.broadcast(hot.select("of_key")), here, "left_anti").join(usual, here)
    met = rest.unionByName(keys.join(F.broadcast(hot), here)).filter(F.xxhash64("rep") != F.col("lead")).select("rep", "lead").distinct()
    sketch = tabled.select("rep", "n", "s0", "s1")
    leaders = sketch.select(F.xxhash64("rep").alias("lead_2"), *(F.col(c).alias(f"{c}_2") for c in sketch.columns)).join(lead.select(F.col("lead").alias("lead_2")).distinct(), "lead_2", "left_semi")
    near = looked_up(met.join(sketch, "rep"), "lead", leaders, "lead_2").filter(near_enough)
    nearest = F.array_sort(F.collect_set(F.struct(apart.alias("apart"), F.col("rep_2").alias("b"))))  # at most one a table
    best = cut(near.groupBy(F.col("rep").alias("a")).agg(F.slice(nearest, 1, tried).alias("near")).select("a", F.explode("near.b").alias("b")))
    nodes = connected(_confirmed(best, sets, num, den))
    component = tabled.select("rep", "n", "first", "second").join(nodes, F.col("rep") == F.col("node"), "left").select("rep", "n", "first", "second", F.coalesce("component", "rep").alias("component"))

    # 4. what is left: rows of different components that share a first half key ...
    halves_of = component.select("rep", "n", "component", "first", F.transform("second", lambda v, j: F.xxhash64(j, v)).alias("second"))
    halves_of, halves_at = store(halves_of)
    left = halves_of.select("rep", "n", "component", F.explode("first").alias("one"))
    several = left.groupBy(F.col("one").alias("of_one")).agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("of_one")
    open_reps, open_at = store(looked_up(left, "one", several, "of_one").select("rep", "n", "component").distinct())
    # ... and their first shingles: of those that several components have, what is left of the number after the component's own
    shingles = open_reps.join(sets.withColumnRenamed("rep", "of"), F.col("rep") == F.col("of")).select("rep", "n", "component", F.explode("shingles").alias("shingle"))
    shingles, shingles_at = store(shingles)
    shared = shingles.groupBy("shingle").agg(F.count("*").alias("m"), F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select(F.col("shingle").alias("of_shingle"), "m")
    shared, shared_at = store(shared)
    edge = (shared.agg(F.sum("m")).first()[0] or 0) / 2000  # less than 2,000 shingles have more rows
    here = F.col("shingle") == F.col("of_shingle")
    hot, usual = F.broadcast(shared.filter(F.col("m") > edge)), shared.filter(F.col("m") <= edge)
    rest = shingles.join(hot.select("of_shingle"), here, "left_anti").join(usual, here)
    met = rest.unionByName(shingles.join(hot, here)).groupBy("rep", "n", "component").agg(F.array_sort(F.collect_list(F.struct("m", "shingle"))).alias("shared"))  # a set's own
    begin = F.col("n") - F.ceil(F.col("n") * num / den) + 1 - (F.col("n") - F.size("shared"))
    begun = met.withColumn("begin", begin.cast("int")).filter("begin > 0").select("rep", "n", "component", F.explode(F.slice("shared", F.lit(1), F.col("begin"))).alias("x")).select("rep", "n", "component", "x.shingle")
    begun, begun_at = store(begun)
    held = begun.groupBy("shingle").agg(F.count("*").alias("m"), F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi")
    one = F.struct("rep", "n", "component")
    few_rows = begun.join(held.filter(F.col("m") <= together).select("shingle"), "shingle").groupBy("shingle").agg(F.collect_list(one).alias("xs"))  # at most ``together``
    pairs = few_rows.select(F.explode("xs").alias("x"), "xs").select("x", F.explode("xs").alias("y")).filter("x.rep < y.rep AND x.component <> y.component")
    pairs = pairs.filter(den * F.least("x.n", "y.n") >= num * F.greatest("x.n", "y.n")).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct()
    keys_of = lambda side: halves_of.select(F.col("rep").alias(side), F.col("first").alias(f"first_{side}"), F.col("second").alias(f"second_{side}"))
    pairs = pairs.join(keys_of("a"), "a").join(keys_of("b"), "b").filter(F.arrays_overlap("first_a", "first_b") & F.arrays_overlap("second_a", "second_b")).select("a", "b")
    by_pairs = _confirmed(cut(pairs), sets, num, den)
    many_rows = begun.join(held.filter(F.col("m") > together).select(F.col("shingle").alias("of_shingle")), here).select("rep").distinct()
    left = cut(halves_of.join(many_rows, "rep").select("rep", "n", "component", "second", F.explode("first").alias("one")))
    parts = left.groupBy("one", "component").agg(F.count("*").alias("m"), F.sum("n").alias("total"))
    mixed = parts.groupBy(F.col("one").alias("of_one")).agg(F.max(F.struct("m", "component", "total")).alias("major"), F.sum("m").alias("m"), F.sum("total").alias("total"), F.count("*").alias("parts")).filter("parts > 1")

    def blocks(m, total):
        return F.greatest(F.ceil(m / block_rows), F.ceil(total / block_shingles), F.lit(1))

    few, many = blocks(F.col("m") - F.col("major.m"), F.col("total") - F.col("major.total")), blocks(F.col("major.m"), F.col("major.total"))
    mixed = mixed.select("of_one", F.col("major.component").alias("major"), few.alias("few"), many.alias("many"))
    dealt = looked_up(left, "one", mixed, "of_one").withColumn("minor", F.col("component") != F.col("major"))
    mine = F.pmod(F.xxhash64("rep"), F.when(F.col("minor"), F.col("few")).otherwise(F.col("many")))
    # block i of the minor rows meets each block of the major ones, numbered from ``few`` on, and each later one of its own
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0).cast("bigint"), n - 1)).otherwise(F.array().cast("array<bigint>"))
    others = F.filter(upto(F.col("few") + F.col("many")), lambda k: k != F.col("mine"))
    meetings = F.when(F.col("minor"), F.transform(others, lambda k: F.struct(F.least("mine", k).alias("lo"), F.greatest("mine", k).alias("hi"))))
    meetings = meetings.otherwise(F.transform(upto(F.col("few")), lambda k: F.struct(k.alias("lo"), (F.col("mine") + F.col("few")).alias("hi"))))
    dealt = dealt.withColumn("mine", mine).select("rep", "component", "minor", "second", "one", F.explode(meetings).alias("meeting")).select("rep", "component", "minor", "second", "one", "meeting.lo", "meeting.hi")
    # 31 bits of each shingle's hash: they can only add to an intersection, and what they link is confirmed on full sets
    short = sets.select("rep", F.transform("shingles", lambda x: x.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")).alias("shingles"))
    dealt = dealt.join(short, "rep")

    def linked(group: pa.Table) -> pa.Table:
        rep, minor = group.column("rep").to_numpy(), group.column("minor").to_numpy()
        second = np.stack([x.values.to_numpy() for x in group.column("second")])
        found = block_links(group.column("component").to_numpy(), minor, [x.values.to_numpy() for x in group.column("shingles")], second, num, den)
        return pa.table({"a": pa.array(rep[[i for i, _ in found]] if found else [], pa.int64()), "b": pa.array(rep[[j for _, j in found]] if found else [], pa.int64())})

    by_blocks = _confirmed(cut(dealt.groupBy("one", "lo", "hi").applyInArrow(linked, "a bigint, b bigint").distinct()), sets, num, den)
    late = by_pairs.unionByName(by_blocks)
    # the late links join components, so only these are connected again
    of_node = nodes.select(F.col("node").alias("at"), F.col("component").alias("root"))
    ends = late.join(of_node, F.col("a") == F.col("at"), "left").select(F.coalesce("root", "a").alias("a"), "b")
    ends = ends.join(of_node, F.col("b") == F.col("at"), "left").select("a", F.coalesce("root", "b").alias("b")).filter("a <> b")
    joined = connected(ends).select(F.col("node").alias("root_2"), F.col("component").alias("further"))
    of_rep = nodes.unionByName(joined.select(F.col("root_2").alias("node"), F.col("root_2").alias("component"))).distinct()
    nodes = cut(looked_up(of_rep, "component", joined, "root_2", how="left").select("node", F.coalesce("further", "component").alias("component")))

    # sets of several documents or with links; any other document is a component of its own
    known = reps.select("f0", "f1", "rep", "copies").join(nodes, F.col("rep") == F.col("node"), "left").filter((F.col("copies") > 1) | F.col("node").isNotNull())
    known = known.select(F.struct("f0", "f1").alias("set"), F.coalesce("component", "rep").alias("component"))
    out = looked_up(signed.select("id", "n", F.struct("f0", "f1").alias("of")), "of", known, "set", how="left")
    component_id = F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.coalesce("component", "id")).otherwise(F.col("id"))
    result = cut(out.select(F.col("id").alias(id_col), F.col("n").cast("bigint").alias("n_shingles"), component_id.alias("component_id")))
    for path in (signed_at, reps_at, tabled_at, sets_at, halves_at, open_at, shingles_at, shared_at, begun_at):
        drop_stored(spark, path)
    return result.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


@operator
def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of documents that are their component's smallest id, one row of each text of an id; rows without an id stay."""
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, shingle=shingle, num=num, den=den)
    own = "__near"
    while any(c.startswith(own) for c in docs.columns):
        own += "_"
    of, gone, row = (f"{own}_{x}" for x in ("of", "gone", "row"))
    keyed = docs.withColumn(of, F.col(f"`{id_col}`").cast("bigint"))
    dropped = found.filter(~F.col("kept")).select(F.col(id_col).alias(gone)).distinct()
    left = keyed.join(dropped, F.col(of) == F.col(gone), "left_anti")
    if keyed.filter(F.col(of).isNotNull()).groupBy(of).count().filter("count > 1").limit(1).count():
        # rows without an id differ in a number of their own
        number = F.when(F.col(of).isNull(), F.monotonically_increasing_id()).otherwise(F.xxhash64(F.col(f"`{text_col}`")))
        left = left.withColumn(row, number).dropDuplicates([of, row]).drop(row)
    return left.drop(of)
