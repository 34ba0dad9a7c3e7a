"""Near-duplicate groups by b-bit MinHash, confirmed on full shingle sets.

Texts of the same words are one node. Each node keeps the minima of 256 permutations only as
their lowest two bits, packed in eight longs, beside the hashes of 42 bands of six whole minima.
Nodes that share a band are candidates. Their similarity is first estimated from the count of
equal 2-bit fields, corrected for chance collisions (1 in 4); what may reach the threshold is
confirmed on the full sets.

No bucket is expanded into its pairs. Every node is first held against one leader of its
buckets; confirmed links are joined into components. Where a bucket's members then still lie
in several components, the nodes outside its largest one are held against another member of
that, a few times over. What remains is compared across components only, in blocks of bounded
size that give back links alone, so that no link between different components is lost: a pair
inside one component needs no further link to be in the same group. Rows of a hot bucket or
group are dealt over several tasks wherever they meet a fact about it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapidary.llm.components import connected_components
from lapidary.llm.hot import dealt, hot_keys, spread
from lapidary.llm.resident import release, trim
from lapidary.llm.scratch import Scratch, small_batches
from lapidary.llm.words import Words, mix, pieces

PERMUTATIONS, BITS, BAND_ROWS, BANDS = 256, 2, 6, 42
#: fixed odd multipliers and addends of the permutations of 32-bit values
_rng = np.random.Generator(np.random.PCG64(20240229))
_A = _rng.integers(0, 1 << 31, PERMUTATIONS, np.uint32)[:, None] * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 1 << 32, PERMUTATIONS, np.uint32)[:, None]
_PLACE = _rng.integers(0, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(words: Words, k: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the k-word shingles of each text; fewer words are one shingle."""
    with np.errstate(over="ignore"):
        h = words.hashes()
        n = max(0, len(h) - k + 1)
        rolled = np.zeros(n, np.uint64)
        for j in range(k):
            rolled += h[j : j + n] * _PLACE[j]
        rolled = mix(rolled)
        out = []
        for lo, hi in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist(), strict=True):
            if hi - lo >= k:
                out.append(np.unique(rolled[lo : hi - k + 1]))
            elif hi > lo:
                own = (h[lo:hi] * _PLACE[: hi - lo]).sum(dtype=np.uint64) + np.uint64(hi - lo)
                out.append(mix(np.array([own], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
        return out


def minima(hashes: np.ndarray) -> np.ndarray:
    """The 256 minima of a set of hashes; the set is taken in blocks that fit the cache."""
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.full(PERMUTATIONS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 1024):
        block = _A * low[None, at : at + 1024]
        block += _B
        np.minimum(out, block.min(axis=1), out=out)
    return out


def pack_bits(low: np.ndarray) -> np.ndarray:
    """Two low bits of each of 256 minima in eight signed longs."""
    fields = (low & np.uint32(3)).astype(np.uint64).reshape(8, 32)
    return np.bitwise_or.reduce(fields << (np.arange(32, dtype=np.uint64) * np.uint64(2)), axis=1).view(np.int64)


def band_hashes(low: np.ndarray) -> np.ndarray:
    rows = low[: BANDS * BAND_ROWS].reshape(BANDS, BAND_ROWS).astype(np.uint64)
    with np.errstate(over="ignore"):
        value = (rows * _PLACE[:BAND_ROWS]).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * _PLACE[20]
        return mix(value).view(np.int64)


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """Per row of ``doc_id, text``: set size, key of the word sequence, packed signature and bands."""
    schema = "doc_id long, n_shingles long, key1 long, key2 long, sig binary, bands array<long>"

    def sign(batches):
        release()
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, words in pieces(batch.column(1), fold=True):
                sets = shingle_sets(words, k)
                with np.errstate(over="ignore"):
                    h = words.hashes()
                    place = np.arange(len(h), dtype=np.uint64)
                    keys = []
                    for salt in (3, 11):  # two sums over the words, each position with its own multiplier
                        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h ^ _PLACE[salt]) * (np.uint64(2) * place + _PLACE[salt + 1]))])
                        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h ^ _PLACE[salt]))])
                        first = words.bounds[:-1]
                        own = total[words.bounds[1:]] - total[first] - (sums[words.bounds[1:]] - sums[first]) * (np.uint64(2) * first.astype(np.uint64))
                        keys.append(mix(own + np.diff(words.bounds).astype(np.uint64) * _PLACE[salt + 2]).view(np.int64))
                sig, bands = [], []
                for own in sets:
                    if len(own):
                        low = minima(own)
                        sig.append(pack_bits(low).tobytes())
                        bands.append(band_hashes(low))
                    else:
                        sig.append(None)
                        bands.append(None)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys[0]), pa.array(keys[1]), pa.array(sig, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                    ["doc_id", "n_shingles", "key1", "key2", "sig", "bands"],
                )
        trim()

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(sign, schema)


def _longs(column: str, prefix: str) -> list:
    """The eight longs of a packed signature as columns."""
    return [F.conv(F.hex(F.substring(column, 8 * i + 1, 8)), 16, -10).cast("long").alias(f"{prefix}{i}") for i in range(8)]


def _estimate(left: str, right: str):
    """Similarity from the count of equal 2-bit fields, corrected for those equal by chance."""
    differ = F.lit(0)
    for i in range(8):
        x = F.col(f"{left}{i}").bitwiseXOR(F.col(f"{right}{i}"))
        differ = differ + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555)))
    chance = 1 / 2**BITS
    return (1 - differ / PERMUTATIONS - chance) / (1 - chance)


def _linked(p: np.ndarray, q: np.ndarray, threshold: int) -> bool:
    """100 * intersection >= threshold * union, of sorted distinct hashes."""
    small, large = (p, q) if len(p) < len(q) else (q, p)
    if not len(small):
        return False
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    both = int((large[at] == small).sum())
    return 100 * both >= threshold * (len(p) + len(q) - both)


def _grams(column) -> list[np.ndarray]:
    return [np.frombuffer(v.as_buffer(), np.uint64) for v in column]


class _Links:
    """Confirms candidate pairs of nodes on their full sets, which are made once."""

    def __init__(self, docs: DataFrame, nodes: DataFrame, wanted: DataFrame, k: int, threshold: int, slack: float, scratch: Scratch):
        self.threshold, self.slack, self.scratch = threshold, slack, scratch
        self.sigs = nodes.select("node", F.col("n_shingles").alias("n"), *_longs("sig", "s"))

        def sets(batches):
            release()
            for batch in batches:
                for lo, hi, words in pieces(batch.column(1), fold=True):
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array([s.tobytes() for s in shingle_sets(words, k)], pa.binary())], ["node", "grams"])
            trim()

        # a merge join at every size, so that no side has to fit in memory
        texts = docs.select(F.col("doc_id").cast("long"), "text").hint("merge").join(wanted.select(F.col("node").alias("doc_id")), "doc_id", "left_semi")
        self.full = scratch.keep(texts.mapInArrow(sets, "node long, grams binary"), "sets")

    def possible(self, pairs: DataFrame) -> DataFrame:
        """Pairs ``x, y`` whose sizes and estimate leave room for the threshold."""
        for side in ("x", "y"):
            own = self.sigs.select(F.col("node").alias(side), F.col("n").alias(f"n{side}"), *(F.col(f"s{i}").alias(f"{side}{i}") for i in range(8)))
            pairs = pairs.join(own, side)
        sizes = 100 * F.least("nx", "ny") >= self.threshold * F.greatest("nx", "ny")
        return pairs.where(sizes & (_estimate("x", "y") >= self.threshold / 100 - self.slack)).select("x", "y")

    def confirmed(self, pairs: DataFrame, name: str) -> DataFrame:
        """The pairs with 100 * intersection >= threshold * union, as edges ``a, b``."""
        threshold = self.threshold

        def hold(batches):
            for batch in batches:
                x, y = batch.column(0), batch.column(1)
                keep = [_linked(p, q, threshold) for p, q in zip(_grams(batch.column(2)), _grams(batch.column(3)), strict=True)]
                keep = pa.array(keep, pa.bool_())
                yield pa.RecordBatch.from_arrays([x.filter(keep), y.filter(keep)], ["a", "b"])

        joined = pairs.distinct().join(self.full.select(F.col("node").alias("x"), F.col("grams").alias("gx")), "x")
        joined = joined.join(self.full.select(F.col("node").alias("y"), F.col("grams").alias("gy")), "y").select("x", "y", "gx", "gy")
        return self.scratch.keep(joined.mapInArrow(hold, "a long, b long"), f"{name}_edges")


def _compare(table: pa.Table, threshold: int, slack: float) -> pa.Table:
    """Links between the two sides of one block, skipping pairs that links found here already join."""
    cols = {name: table.column(name).combine_chunks() for name in ("outer", "node", "label", "n", "sig", "grams", "main")}
    outer = cols["outer"].to_numpy(zero_copy_only=False)
    node, label, n, main = (cols[c].to_numpy(zero_copy_only=False) for c in ("node", "label", "n", "main"))
    sig = np.frombuffer(b"".join(cols["sig"].to_pylist()), np.uint64).reshape(-1, 8)
    left, right = np.flatnonzero(outer), np.flatnonzero(~outer)
    chance = 1 / 2**BITS
    found: list[tuple[float, int, int]] = []
    for i in left:
        x = sig[right] ^ sig[i]
        differ = np.bitwise_count((x | (x >> np.uint64(1))) & np.uint64(0x5555555555555555)).sum(axis=1)
        likeness = (1 - differ / PERMUTATIONS - chance) / (1 - chance)
        fit = (likeness >= threshold / 100 - slack) & (100 * np.minimum(n[right], n[i]) >= threshold * np.maximum(n[right], n[i]))
        fit &= (label[right] != label[i]) & ((label[right] == main[i]) | (node[right] > node[i]))
        found += [(-likeness[k], int(i), int(right[k])) for k in np.flatnonzero(fit)]
    top: dict[int, int] = {}

    def root(v: int) -> int:
        while v in top:
            v = top[v]
        return v

    a, b = [], []
    for _, i, j in sorted(found):
        u, v = root(int(label[i])), root(int(label[j]))
        if u != v and _linked(*(np.frombuffer(cols["grams"][r].as_buffer(), np.uint64) for r in (i, j)), threshold):
            top[max(u, v)] = min(u, v)
            a.append(node[i])
            b.append(node[j])
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def near_duplicates(docs: DataFrame, k: int = 5, threshold: int = 80, slack: float = 0.15, rounds: int = 4, block_nodes: int = 512, block_bytes: int = 8 << 20) -> DataFrame:
    """Per row of ``doc_id, text``: ``doc_id, n_shingles, component_id, kept``.

    Words are runs of ``[^\\x20\\x09-\\x0D]`` with A-Z lower-cased. ``slack`` is how far the
    estimate may lie below ``threshold`` percent, five standard deviations. Null, empty
    and wordless texts have no set and no link. Rows of one id are one node. A null id takes
    part in no group: its component is null and it is kept. An empty table gives no row.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    signed = scratch.keep(signatures(docs, k), "signed")
    usable = signed.where("n_shingles > 0 and doc_id is not null")
    classes = usable.groupBy("key1", "key2").agg(F.min("doc_id").alias("node"))
    members = scratch.keep(
        usable.select("key1", "key2", "doc_id").distinct().join(classes, ["key1", "key2"]).select("doc_id", "node"), "members"
    )
    owners = usable.join(members.where("doc_id = node").select("doc_id").distinct(), "doc_id", "left_semi").dropDuplicates(["key1", "key2", "doc_id"])
    nodes = scratch.keep(owners.select(F.col("doc_id").alias("node"), "n_shingles", "sig", "bands"), "nodes")
    bands = nodes.select("node", F.explode("bands").alias("h"))
    shared = bands.groupBy("h").agg(F.min("node").alias("lead"), F.max("node").alias("last"), F.count("*").alias("n")).where("lead <> last")
    shared = scratch.keep(shared.select("h", "lead", "n"), "shared")
    hot = scratch.keep(hot_keys(shared, "h", BANDS * nodes.count()), "hot")
    buckets = scratch.keep(dealt(bands, hot, "h", "node").join(spread(shared, hot, "h"), ["h", "salt"]).select("h", "salt", "node", "lead"), "buckets")
    links = _Links(docs, nodes, buckets.select("node").distinct(), k, threshold, slack, scratch)
    same = members.where("doc_id <> node").select(F.col("node").alias("a"), F.col("doc_id").alias("b")).distinct()

    # each node against the smallest leader of its buckets
    first = buckets.where("node <> lead").groupBy(F.col("node").alias("y")).agg(F.min("lead").alias("x"))
    edges = links.confirmed(links.possible(first.select("x", "y")), "first")
    labels = connected_components(edges, scratch, "first")
    rest, before = None, None
    for turn in range(rounds):
        # buckets that hold several components, and the component with most members in each
        rows = buckets.join(labels, "node", "left").select("h", "salt", "node", F.coalesce("label", "node").alias("label"))
        several = rows.groupBy("h").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("h")
        rows = rows.join(spread(several, hot, "h"), ["h", "salt"])
        by_turn = F.struct(F.xxhash64("node", F.lit(turn)), "node")
        groups = rows.groupBy("h", "label").agg(F.count("*").alias("n"), F.min_by("node", by_turn).alias("lead"))
        mains = groups.groupBy("h").agg(F.max_by(F.struct("label", "lead"), F.struct("n", "label")).alias("main"))
        rest = scratch.keep(rows.join(spread(mains, hot, "h"), ["h", "salt"]).select("h", "salt", "node", "label", F.col("main.label").alias("main"), F.col("main.lead").alias("lead")), f"rest{turn}")
        open_rows = rest.where("label <> main").count()
        if before is not None and open_rows > 0.8 * before:
            break
        before = open_rows
        if not open_rows:
            break
        # each node of a smaller component against one member of the larger
        next_pairs = rest.where("label <> main").groupBy(F.col("node").alias("y")).agg(F.min_by("lead", F.xxhash64("lead", F.lit(turn))).alias("x"))
        edges = edges.union(links.confirmed(links.possible(next_pairs.select("x", "y")), f"turn{turn}"))
        labels = connected_components(edges, scratch, f"turn{turn}")
    else:
        rows = buckets.join(labels, "node", "left").select("h", "salt", "node", F.coalesce("label", "node").alias("label"))
        mains = rows.groupBy("h", "label").agg(F.count("*").alias("n")).groupBy("h").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.count("*").alias("parts"))
        rest = scratch.keep(rows.join(spread(mains.where("parts > 1"), hot, "h"), ["h", "salt"]).select("h", "salt", "node", "label", "main"), "rest")

    # What is left, across components only: nodes that unsettled buckets join are one group. Those
    # outside the group's largest component meet all of the group, block by block.
    lows = rest.groupBy("h").agg(F.min("node").alias("low"))
    hops = rest.join(spread(lows, hot, "h"), ["h", "salt"]).select(F.col("node").alias("a"), F.col("low").alias("b"))
    groups = connected_components(hops, scratch, "groups")
    parts = rest.select("node", "label").distinct().join(groups.withColumnRenamed("label", "g"), "node", "left").withColumn("g", F.coalesce("g", "node"))
    mains = parts.groupBy("g", "label").agg(F.count("*").alias("k")).groupBy("g").agg(F.max_by("label", F.struct("k", "label")).alias("main"), F.sum("k").alias("n"))
    mains = scratch.keep(mains, "mains")
    wide = scratch.keep(hot_keys(mains, "g", mains.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]), "wide")
    parts = dealt(parts, wide, "g", "node").join(spread(mains.drop("n"), wide, "g"), ["g", "salt"])
    parts = parts.join(nodes.select("node", F.col("n_shingles").alias("n"), "sig"), "node").join(links.full, "node")
    parts = scratch.keep(parts, "parts")
    blocks = lambda n, size: F.greatest(F.ceil(n / F.lit(block_nodes)), F.ceil(size / F.lit(block_bytes)), F.lit(1))
    outside = F.col("label") != F.col("main")
    size = F.octet_length("grams")
    cuts = parts.groupBy("g").agg(blocks(F.count_if(outside), F.sum(F.when(outside, size).otherwise(0))).alias("na"), blocks(F.count("*"), F.sum(size)).alias("nb"))
    cut = parts.join(spread(cuts, wide, "g"), ["g", "salt"]).withColumn("at", F.xxhash64("node"))
    columns = ["g", "ia", "ib", "outer", "node", "label", "n", "sig", "grams", "main"]
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n).cast("int") - 1))
    sides = [
        cut.where(outside).withColumns({"outer": F.lit(True), "ia": F.pmod("at", "na").cast("int")}).withColumn("ib", each("nb")).select(columns),
        cut.withColumns({"outer": F.lit(False), "ib": F.pmod("at", "nb").cast("int")}).withColumn("ia", each("na")).select(columns),
    ]
    across = sides[0].union(sides[1]).groupBy("g", "ia", "ib").applyInArrow(lambda t: _compare(t, threshold, slack), "a long, b long")
    edges = edges.union(scratch.keep(across, "across"))
    labels = connected_components(edges.union(same), scratch, "all")
    scratch.drop("buckets", "nodes", "sets", "members", "shared", "hot", "mains", "wide", "rest", "parts", *(f"rest{i}" for i in range(rounds)))

    out = signed.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("label", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
