"""Near duplicates by HyperMinHash: registers, banding, collision-corrected estimates, full verification.

One hash per shingle fills a document's registers: its low bits pick the register, and of
the least rest that falls there the register keeps the number of leading zeros and the
next ``mantissa`` bits, 16 bits together. Empty registers borrow from others picked by
their own fixed sequence, so that two sets' registers agree with a probability of their
Jaccard similarity at any set size. Bands of equal registers bring candidates together.

Documents with equal sets form one class from the start. Classes that share a band are
connected to the band's least class only (never all pairs), and the connected parts of
that graph are found by star steps. A part that fits one block is compared as a whole.
Larger parts mostly chain classes that are not alike, so only classes with a common band
meet there: those of one lead together, small leads dealt into blocks, large ones first
against the lead itself, and then only classes that these links have not connected yet.
In a comparison the estimate, corrected for registers that agree by chance, drops pairs of
large sets that are far from the limit, the rest is compared on the full sets. Blocks
return spanning links, not pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonolith.llm import scratch
from sonolith.llm.graph import components
from sonolith.llm.words import WORD_BASES, Windows, Words, mix, signed, slices


@dataclass(frozen=True)
class MinHashOptions:
    """Links hold from ``percent`` / 100 on. 32 bands of 4 registers miss a pair of similarity
    0.75 with a probability of 5e-6. The estimate drops pairs ``margin`` (five standard
    deviations) below the limit, and only where both sets have ``estimate_from`` shingles.
    A block has about ``block_sets`` sets or ``block_shingles`` shingles, whichever is less, one
    of a part larger than that ``large_sets``: what is in many blocks is copied to each."""

    shingle: int = 5
    percent: int = 75
    bands: int = 32
    rows: int = 4
    mantissa: int = 10
    margin: float = 0.2
    estimate_from: int = 256
    block_sets: int = 256
    block_shingles: int = 400_000
    star_leads: int = 6
    large_sets: int = 1024

    @property
    def registers(self) -> int:
        return self.bands * self.rows

    @property
    def least_set(self) -> int:
        """Different sets can be linked only if neither is smaller: one of u - 1 within one of u has (u - 1) / u."""
        return -(-100 // (100 - self.percent)) - 1 if self.percent < 100 else 1 << 62


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document, ascending, and the offsets of the documents.

    A document with fewer than ``k`` words has its whole sequence as the only shingle."""
    h = words.hashes()
    n = np.diff(words.first)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    doc = np.repeat(np.arange(len(n)), count)
    start = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count) + words.first[doc]
    length = np.minimum(k, n[doc])
    s = mix(Windows(h, WORD_BASES[0]).of(start, start + length) + length.astype(np.uint64))
    order = np.lexsort((s, doc))
    doc, s = doc[order], s[order]
    fresh = np.ones(len(s), dtype=bool)
    fresh[1:] = (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])
    doc, s = doc[fresh], s[fresh]
    return s, np.searchsorted(doc, np.arange(len(n) + 1))


def _leading_zeros(x: np.ndarray, bits: int) -> np.ndarray:
    """Of ``bits``-bit values."""
    n = np.full(len(x), bits, dtype=np.int64)
    have = x > 0
    top = np.floor(np.log2(x[have].astype(np.float64))).astype(np.int64)
    v = x[have]
    top -= (v >> top.astype(np.uint64)) == 0  # rounded up to the next power
    top += (v >> np.minimum(top + 1, 63).astype(np.uint64)) > 0
    n[have] = bits - 1 - top
    return n


def sketches(s: np.ndarray, offs: np.ndarray, o: MinHashOptions) -> np.ndarray:
    """HyperMinHash registers, one row of ``o.registers`` 16-bit values per document (0: an empty set)."""
    m, docs = o.registers, len(offs) - 1
    low = np.full(docs * m, np.uint64(1 << 63), dtype=np.uint64)
    doc = np.repeat(np.arange(docs), np.diff(offs))
    mixed = mix(s ^ np.uint64(0x2545F4914F6CDD1D))
    np.minimum.at(low, doc * m + (mixed % np.uint64(m)).astype(np.int64), (mixed // np.uint64(m)) >> np.uint64(8))
    zeros = 56 - int(np.log2(m))  # bits of the rest
    full = low != np.uint64(1 << 63)
    lead = np.minimum(_leading_zeros(np.where(full, low, 0), zeros), 62)
    shift = zeros - lead - 1 - o.mantissa
    rest = np.where(shift >= 0, low >> np.maximum(shift, 0).astype(np.uint64), low << np.maximum(-shift, 0).astype(np.uint64))
    reg = (((lead + 1) << o.mantissa) | (rest.astype(np.int64) & ((1 << o.mantissa) - 1))).reshape(docs, m)
    full = full.reshape(docs, m)
    reg[~full] = 0
    doc, empty = np.nonzero(~full & full.any(axis=1)[:, None])
    every, step = np.arange(m) * 65_537, 0
    while len(doc):  # each empty register follows its own fixed sequence to a full one
        step += 1
        pick = (mix((every + step).astype(np.uint64)) % np.uint64(m)).astype(np.int64)[empty]
        hit = full[doc, pick]
        reg[doc[hit], empty[hit]] = reg[doc[hit], pick[hit]]
        doc, empty = doc[~hit], empty[~hit]
    return reg.astype(np.uint16)


def chance(size_a: np.ndarray, size_b: np.ndarray, o: MinHashOptions) -> np.ndarray:
    """Probability that a register of two disjoint sets agrees all the same.

    With n hashes in a register the least one has z leading zeros with probability
    (1 - 2^-(z+1))^n - (1 - 2^-z)^n, and the mantissa agrees in one of 2^mantissa cases."""
    none_below = 1 - 2.0 ** -np.arange(61, dtype=np.float64)

    def zeros(size: np.ndarray) -> np.ndarray:
        return np.diff(none_below[None, :] ** np.maximum(size / o.registers, 1.0)[:, None], axis=1)

    return (zeros(size_a) @ zeros(size_b).T) / (1 << o.mantissa)


def estimate(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, o: MinHashOptions) -> np.ndarray:
    """Jaccard estimates of all rows of ``a`` with all of ``b``: agreeing registers, less those by chance."""
    share = np.empty((len(a), len(b)))
    for i in range(len(a)):
        share[i] = (b == a[i]).mean(axis=1)
    by_chance = chance(size_a, size_b, o)
    return np.clip((share - by_chance) / (1 - by_chance), 0, 1)


def _sign(batches: Iterator[pa.RecordBatch], o: MinHashOptions) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i, j, words in slices(b.column("text"), lower=True):
            s, offs = shingles(words, o.shingle)
            n = np.diff(offs)
            cid = _class_ids(s, offs)
            regs = sketches(s, offs, o)
            grouped = regs.reshape(j - i, o.bands, o.rows).astype(np.uint64)
            keys = np.repeat(np.arange(o.bands, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15), j - i, axis=0)
            for r in range(o.rows):
                keys = mix(keys ^ (grouped[:, :, r] + np.uint64(1 + r)))
            keys[n == 0] = 0
            flat = pa.array(signed(keys.reshape(-1)))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (j - i + 1) * o.bands, o.bands, dtype=np.int32)), flat)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i), b.column("th").slice(i, j - i), pa.array(n.astype(np.int64)), pa.array(signed(cid), mask=n == 0), lists], names=["doc_id", "th", "n_shingles", "cid", "bands"])


def _class_ids(s: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each whole set."""
    weighted = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(s + np.uint64(0x632BE59BD9B4E019)), dtype=np.uint64)])
    return mix(weighted[offs[1:]] - weighted[offs[:-1]] + (np.diff(offs).astype(np.uint64) << np.uint64(1)))


def _overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of ``a`` with all of ``b``."""
    if len(a) == 1 and len(b) == 1:
        return np.array([[len(np.intersect1d(a[0], b[0], assume_unique=True))]])
    ids, inv = np.unique(np.concatenate([*a, *b]), return_inverse=True)
    cut = sum(map(len, a))
    both = (np.bincount(inv[:cut], minlength=len(ids)) > 0) & (np.bincount(inv[cut:], minlength=len(ids)) > 0)
    rank = np.cumsum(both) - 1
    row_a, row_b = np.repeat(np.arange(len(a)), list(map(len, a))), np.repeat(np.arange(len(b)), list(map(len, b)))
    col_a, col_b = inv[:cut], inv[cut:]
    row_a, col_a = row_a[both[col_a]], rank[col_a[both[col_a]]]
    row_b, col_b = row_b[both[col_b]], rank[col_b[both[col_b]]]
    total, width = np.zeros((len(a), len(b)), dtype=np.float32), 4096
    order_a, order_b = np.argsort(col_a, kind="stable"), np.argsort(col_b, kind="stable")
    row_a, col_a, row_b, col_b = row_a[order_a], col_a[order_a], row_b[order_b], col_b[order_b]
    for lo in range(0, int(both.sum()), width):
        left, right = np.zeros((len(a), width), dtype=np.float32), np.zeros((len(b), width), dtype=np.float32)
        i, j = np.searchsorted(col_a, [lo, lo + width])
        left[row_a[i:j], col_a[i:j] - lo] = 1
        i, j = np.searchsorted(col_b, [lo, lo + width])
        right[row_b[i:j], col_b[i:j] - lo] = 1
        total += left @ right.T
    return total.astype(np.int64)


def _link(pdf: pd.DataFrame, o: MinHashOptions) -> pd.DataFrame:
    """Spanning links among the verified links of one block, or of one pair of blocks."""
    sets: dict[int, np.ndarray] = {}
    regs: dict[int, np.ndarray] = {}
    for _, _, words in slices(pa.array(pdf["text"], pa.large_string()), lower=True):
        s, offs = shingles(words, o.shingle)
        ids, n = signed(_class_ids(s, offs)).tolist(), np.diff(offs)
        large = np.flatnonzero(n >= o.estimate_from)  # no estimate is made of others
        sk = sketches(s[np.repeat(n >= o.estimate_from, n)], np.concatenate([[0], np.cumsum(n[large])]), o)
        regs |= {ids[d]: r for d, r in zip(large.tolist(), sk, strict=True)}
        sets |= {c: s[offs[d] : offs[d + 1]] for d, c in enumerate(ids)}
    sides = [[c for c in dict.fromkeys(pdf["cid"][pdf["side"] == side].tolist()) if c in sets] for side in (0, 1)]
    left, right = sides[0], sides[1] or sides[0]
    if not left:
        return pd.DataFrame({"a": [], "b": []}, dtype="int64")
    na, nb = np.array([len(sets[c]) for c in left]), np.array([len(sets[c]) for c in right])
    near = np.ones((len(left), len(right)), dtype=bool)
    i, j = np.flatnonzero(na >= o.estimate_from), np.flatnonzero(nb >= o.estimate_from)
    if len(i) and len(j):
        near[np.ix_(i, j)] = estimate(np.array([regs[left[d]] for d in i]), np.array([regs[right[d]] for d in j]), na[i], nb[j], o) >= o.percent / 100 - o.margin
    near &= 100 * np.minimum(na[:, None], nb[None, :]) >= o.percent * np.maximum(na[:, None], nb[None, :])
    near &= np.array(left)[:, None] != np.array(right)[None, :]
    rows, cols = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
    if not len(rows):
        return pd.DataFrame({"a": [], "b": []}, dtype="int64")
    inter = _overlaps([sets[left[i]] for i in rows], [sets[right[j]] for j in cols])
    union = na[rows][:, None] + nb[cols][None, :] - inter
    linked = (100 * inter >= o.percent * union) & near[np.ix_(rows, cols)]
    return spanning([left[i] for i in rows], [right[j] for j in cols], linked)


def spanning(left: list[int], right: list[int], linked: np.ndarray) -> pd.DataFrame:
    """As few of the links as connect the same nodes."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    links = []
    for i, j in zip(*np.nonzero(linked), strict=True):
        x, y = find(left[i]), find(right[j])
        if x != y:
            root[max(x, y)] = min(x, y)
            links.append((x, y))
    return pd.DataFrame(links, columns=["a", "b"]).astype("int64")


def block_meetings(near: DataFrame, classes: DataFrame, sets: int, members: int) -> DataFrame:
    """Deal the classes of each candidate part into blocks, and let every two blocks meet once.

    ``near``: node, component. ``classes``: cid, n (size of the set), other columns. A block
    has about ``sets`` sets or ``members`` members, whichever is less. Returns component, x, y
    (blocks), side (0 or 1) and the columns of ``classes``."""
    parts = near.join(classes, near["node"] == classes["cid"]).drop("node")
    sizes = parts.groupBy("component").agg(F.ceil(F.greatest(F.count(F.lit(1)) / sets, F.sum("n") / members)).cast("int").alias("blocks"))
    placed = parts.join(sizes, "component").withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    meets = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return meets.select("component", *classes.columns, F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), (F.col("block") > F.col("other")).cast("int").alias("side"))


def _blocks(n: str, members: str, sets: int, shingles: int):
    return F.greatest(F.lit(1), F.ceil(F.greatest(F.col(n) / sets, F.col(members) / shingles))).cast("int")


def _unlike(rows: DataFrame, by: list[str]) -> DataFrame:
    """Per group of ``by``: g (rows), gn (sum of ``n``), w (ordered pairs of rows whose labels differ; no label is like no other)."""
    one = rows.groupBy(*by, "label", F.when(F.col("label").isNull(), F.col("cid")).alias("own")).agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("mn"))
    m = F.col("m").cast("double")
    return one.groupBy(*by).agg(F.sum("m").alias("g"), F.sum("mn").alias("gn"), (F.pow(F.sum(m), F.lit(2)) - F.sum(m * m)).alias("w"))


def unlike_meetings(items: DataFrame, sets: int, members: int) -> DataFrame:
    """Deal the rows of each group into blocks, and let every two blocks meet once, unless all their rows have one label.

    ``items``: kind, component (together the group), cid, n, label. A label of half a block or more has blocks of its
    own, others are mixed. Returns kind, component, x, y (blocks), side (0 or 1) and cid."""
    group = ["kind", "component"]
    labels = items.where("label is not null").groupBy(*group, "label").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("mn"))
    own = labels.where((2 * F.col("m") >= sets) | (2 * F.col("mn") >= members)).select(*group, "label", F.col("label").alias("own"), _blocks("m", "mn", sets, members).alias("own_blocks"))
    dealt = items.join(own, [*group, "label"], "left")
    mixed = dealt.where("own is null").groupBy(*group).agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("mn")).select(*group, _blocks("m", "mn", sets, members).alias("mixed_blocks"))
    within = F.when(F.col("own").isNull(), F.pmod(F.xxhash64(F.coalesce("label", "cid")), F.col("mixed_blocks"))).otherwise(F.pmod(F.xxhash64("cid"), F.col("own_blocks")))
    placed = scratch.save(dealt.join(mixed, group, "left").select(*group, "cid", "own", F.xxhash64("own", within.cast("long")).alias("block")), "placed")
    blocks = placed.select(*group, "block", "own").distinct()
    pairs = blocks.withColumnsRenamed({"block": "x", "own": "own_x"}).join(blocks.withColumnsRenamed({"block": "y", "own": "own_y"}), group)
    pairs = pairs.where("x <= y and not coalesce(own_x = own_y, false)").select(*group, "x", "y")
    at = [*group, "x", "y", F.lit(0).alias("side"), "cid"], [*group, "x", "y", F.lit(1).alias("side"), "cid"]
    left = placed.withColumnRenamed("block", "x").join(pairs, [*group, "x"]).select(*at[0])
    return left.unionByName(placed.withColumnRenamed("block", "y").join(pairs.where("x != y"), [*group, "y"]).select(*at[1]))


def _large_parts(parts: DataFrame, star: DataFrame, verify: Callable[[DataFrame], DataFrame], o: MinHashOptions) -> tuple[DataFrame, DataFrame]:
    """Links and further meetings of parts larger than a block.

    ``parts``: component, cid, n; ``star``: cid, lead for every class and the lead of each of its bands. Two classes
    with a common band have that band's lead in common; classes that have none meet only where a part as a whole asks
    for no more comparisons than its leads do."""
    sets, members = o.large_sets, o.block_shingles
    led = scratch.save(star.join(parts, "cid").select("component", "lead", "cid", "n").distinct(), "led")
    sizes = led.groupBy("lead").agg(F.count(F.lit(1)).alias("g"), F.sum("n").alias("gn"))
    wide = sizes.where((F.col("g") > sets) | (F.col("gn") > members))
    # only to save comparisons: the widest leads of a class link it to what is like them
    widest = led.where("cid != lead").join(wide, "lead").groupBy("cid").agg(F.slice(F.sort_array(F.collect_list(F.struct("g", "lead", "gn")), asc=False), 1, o.star_leads).alias("to"))
    rays = widest.select("cid", F.explode("to").alias("to")).select("cid", "to.lead", F.pmod(F.xxhash64("cid"), _blocks("to.g", "to.gn", sets, members)).cast("long").alias("y"))
    first = rays.select("lead", "y", F.lit(1).alias("side"), "cid").unionByName(rays.select("lead", "y", F.lit(0).alias("side"), F.col("lead").alias("cid")).distinct())
    links = verify(first.select(F.lit(0).alias("kind"), F.col("lead").alias("component"), F.lit(0).cast("long").alias("x"), "y", "side", "cid"))
    label = components(links, "a", "b").select(F.col("node").alias("cid"), F.col("component").alias("label"))
    led = scratch.save(led.join(label, "cid", "left"), "led")
    parts = parts.join(label, "cid", "left")
    by_lead = scratch.save(_unlike(led, ["component", "lead"]).where("w > 0"), "leads")
    whole = _unlike(parts, ["component"]).select("component", F.col("w").alias("whole_w"))
    dense = by_lead.groupBy("component").agg(F.sum("w").alias("w")).join(whole, "component").where("whole_w <= w").select("component")
    leads = by_lead.join(dense, "component", "left_anti")
    is_wide = (F.col("g") > sets) | (F.col("gn") > members)
    few = leads.where(~is_wide).agg(F.sum("g"), F.sum("gn")).first()
    bins = max(1, -(-2 * (few[0] or 0) // sets), -(-2 * (few[1] or 0) // members))
    row = ["cid", "n", "label"]
    sparse = led.join(leads.select("lead", is_wide.alias("wide")), "lead")
    items = parts.join(dense, "component").select(F.lit(0).alias("kind"), "component", *row)
    items = items.unionByName(sparse.where("wide").select(F.lit(1).alias("kind"), F.col("lead").alias("component"), *row))
    items = items.unionByName(sparse.where("not wide").select(F.lit(2).alias("kind"), F.pmod(F.xxhash64("lead"), F.lit(bins)).alias("component"), *row).distinct())
    return links, unlike_meetings(items, sets, members)


def near_duplicates(docs: DataFrame, options: MinHashOptions | None = None) -> DataFrame:
    """Groups of documents whose sets of word shingles (lower case) are linked, directly or through others.

    ``docs`` needs doc_id and text; other columns are ignored. Returns one row per input row:
    doc_id, th (xxhash64 of the text), n_shingles, component (a key of the group; null: an empty
    set), component_id (least doc_id reachable), kept (doc_id = component_id).
    Null texts and texts without a word have an empty set and are linked with nothing. A null
    doc_id is never the least one unless the whole group has no other; repeated rows share a
    class. An empty table gives no rows. Classes are told apart by 64-bit hashes of their sets.
    """
    o = options or MinHashOptions()
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("th"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _sign(batches, o)

    signed_docs = scratch.save(rows.mapInArrow(sign, f"doc_id {id_type}, th long, n_shingles long, cid long, bands array<long>"), "signed")
    classes = signed_docs.where("cid is not null").groupBy("cid").agg(F.min("doc_id").alias("first_id"), F.max("n_shingles").alias("n"))
    # equal sets have equal bands: those of each class' first row
    first = (signed_docs["cid"] == classes["cid"]) & signed_docs["doc_id"].eqNullSafe(classes["first_id"])
    heads = scratch.save(signed_docs.where(F.col("n_shingles") >= o.least_set).join(classes, first, "left_semi").select("cid", "doc_id", "th", "bands"), "heads")
    members = heads.select("cid", F.explode("bands").alias("band"))
    shared = members.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("cid").alias("lead")).where("n > 1").select("band", "lead")
    star = scratch.save(members.join(shared, "band").select("cid", "lead").distinct(), "star")
    near = components(star.where("cid != lead"), "cid", "lead").withColumnRenamed("node", "cid")
    parts = scratch.save(near.join(classes.select("cid", "n"), "cid").select("component", "cid", "n"), "parts")
    sizes = parts.groupBy("component").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("cn"))
    large = sizes.where((F.col("c") > o.block_sets) | (F.col("cn") > o.block_shingles)).select("component")
    sized = parts.join(large.withColumn("large", F.lit(True)), "component", "left")
    named = sized.join(heads, "cid").groupBy("component", "cid", "large", "doc_id").agg(F.min("th").alias("th")).withColumn("key", F.xxhash64("doc_id", "th"))
    rows = docs.select(F.col("doc_id").alias("k1"), F.xxhash64("text").alias("k2"), "text").withColumn("key", F.xxhash64("k1", "k2"))
    found = rows.join(named, "key").where(F.col("k1").eqNullSafe(F.col("doc_id")) & (F.col("k2") == F.col("th")))
    texts = scratch.save(found.dropDuplicates(["key", "cid"]).select("component", "cid", "large", "text"), "texts")

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        return _link(pdf, o)

    def verify(blocks: DataFrame) -> DataFrame:
        """``blocks``: kind, component, x, y (together the block), side, cid, text."""
        return scratch.save(blocks.groupBy("kind", "component", "x", "y").applyInPandas(link, "a long, b long"), "links")

    once = F.lit(0).cast("long")
    blocks = texts.where("large is null").select(F.lit(3).alias("kind"), "component", once.alias("x"), once.alias("y"), F.lit(0).alias("side"), "cid", "text")
    if large.isEmpty():
        links = verify(blocks)
    else:
        of_large = texts.where("large").select("cid", "text")
        links, more = _large_parts(parts.join(large, "component"), star, lambda meets: verify(meets.join(of_large, "cid").select(blocks.columns)), o)
        links = links.unionByName(verify(blocks.unionByName(more.join(of_large, "cid").select(blocks.columns))))
    groups = components(links, "a", "b")
    least = groups.join(classes, groups["node"] == classes["cid"]).groupBy("component").agg(F.min("first_id").alias("component_id"))
    by_class = classes.select("cid", "first_id").join(groups.withColumnRenamed("node", "cid"), "cid", "left").join(least, "component", "left").select("cid", F.coalesce("component", "cid").alias("component"), F.coalesce("component_id", "first_id").alias("component_id"))
    out = signed_docs.select("doc_id", "th", "n_shingles", "cid").join(by_class, "cid", "left")
    comp = F.when(F.col("cid").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "th", "n_shingles", "component", comp.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
