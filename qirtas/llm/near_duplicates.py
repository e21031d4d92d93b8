"""Near-duplicate texts with small edits, by fingerprints in a Gray-order hierarchical index (problem 3).

Each text gets one-bit minwise hashes of its word shingles as a fingerprint. At a similarity of 0.55 one tree over one order of
the bits prunes nothing, so there are 48 tables, each with other minwise hashes (a band) as leading bits, all sorted by Gray
rank and cut into ranges. The upper nodes of a table fix the bits of its band, and differences on them are never allowed; the
lower ones fix shared bits of the fingerprint, whose differences add up to the bound. All pairs come from these trees
(gray_index), whatever the size of a node, and are then checked exactly.
"""

from __future__ import annotations

from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .common import map_batches, words
from .gray_index import gray_code, gray_rank, near_pairs

#: A pair with a Jaccard similarity s shares a band with probability 1 - (1 - s^3)^48, that is 0.9998 at 0.55 and 1 - 2e-15 at 0.8.
BANDS, ROWS = 48, 3
HASHES = BITS = 256
WORDS = BITS // 64
FINGER = [f"f{k}" for k in range(WORDS)]
#: A range of Gray ranks has so many leading bits in common.
RANGE_BITS = 16
#: Members of one node that are joined in one task; larger groups are cut into blocks, and each two blocks meet in a task.
BLOCK = 4096

_rng = np.random.default_rng(20240101)
_MULT = _rng.integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 2**63, HASHES, dtype=np.uint64)
_STEPS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)
_OFFSETS = _STEPS * np.arange(1, 6, dtype=np.uint64)


def hamming_bound(similarity: float, bits: int = BITS, sigmas: float = 3.9) -> int:
    """Distance that one-bit minwise hashes of texts of at least this similarity exceed with a chance below 5e-5."""
    p = (1 - similarity) / 2
    return int(np.ceil(bits * p + sigmas * np.sqrt(bits * p * (1 - p))))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def word_hashes(found: list[str], seen: dict[str, int]) -> np.ndarray:
    """64-bit hashes of words; `seen` keeps those of a task's frequent words and is emptied when it has grown large."""
    out = []
    for w in found:
        h = seen.get(w)
        if h is None:
            if len(seen) > 200_000:
                seen.clear()
            h = seen[w] = xxhash.xxh3_64_intdigest(w)
        out.append(h)
    return np.array(out, dtype=np.uint64)


def shingle_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of `size` words; fewer words than that make one shingle."""
    n = max(1, len(hashes) - size + 1)
    total = np.zeros(n, dtype=np.uint64)
    for k in range(min(size, len(hashes))):
        total += _mix(hashes[k : k + n] + _OFFSETS[k % 5]) * _STEPS[k % 5]
    return np.unique(_mix(total))


def sketch(shingles: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Gray ranks of the band patterns and the words of the fingerprint."""
    low = np.empty(HASHES, dtype=np.uint64)
    for at in range(0, len(low), 32):
        low[at : at + 32] = (shingles[None, :] * _MULT[at : at + 32, None] + _ADD[at : at + 32, None]).min(1)
    hashed = _mix(low)
    keys = np.arange(BANDS, dtype=np.uint64) * _STEPS[4]
    for k in range(ROWS):
        keys = _mix(keys ^ hashed[k : BANDS * ROWS : ROWS])
    bits = (hashed & np.uint64(1)).astype(np.uint8)
    keys = gray_rank(keys[:, None])[0]
    return keys, np.packbits(bits).view(">u8").astype(np.uint64).tolist()


def _prepare(df: DataFrame, id_col: str, text_col: str, size: int, min_words: int) -> DataFrame:
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")

    def make():
        seen: dict[str, int] = {}

        def step(batch):
            out = [[] for _ in range(5 + WORDS)]
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = words(text)
                if len(found) < max(1, min_words):
                    continue
                sh = shingle_hashes(word_hashes(found, seen), size)
                keys, f = sketch(sh)
                whole = _mix(sh)
                values = (i, int(whole.sum(dtype=np.uint64).astype(np.int64)), int(np.bitwise_xor.reduce(whole * _STEPS[0]).astype(np.int64)), np.unique(sh >> np.uint64(32)).astype(np.uint32).view(np.int32), keys.view(np.int64), *f)
                for column, v in zip(out, values):
                    column.append(v)
            return out[:5] + [np.array(f, dtype=np.uint64).view(np.int64) for f in out[5:]]

        return step

    return map_batches(texts, make, "id bigint, k0 bigint, k1 bigint, shingles array<int>, bands array<bigint>, " + ", ".join(f"{f} bigint" for f in FINGER))


def _joined(batches, most: int):
    """Candidate pairs from rows (key, bi, bj, own, id, *FINGER) that come sorted by (key, bi, bj), whole groups to a task."""

    def pairs(cols):
        key, bi, bj, own, ids, *finger = cols
        same = np.stack([gray_code(key.view(np.uint64)), (bi.astype(np.uint64) << np.uint64(32)) | bj.astype(np.uint64)], 1)
        i, j = near_pairs(np.stack(finger, 1).view(np.uint64), most, same)
        ok = ((bi[i] == bj[i]) | (own[i] != own[j])) & (ids[i] != ids[j])
        found = np.unique(np.stack([np.minimum(ids[i], ids[j])[ok], np.maximum(ids[i], ids[j])[ok]], 1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"]) if len(found) else None

    kept: list[list[np.ndarray]] = []
    for batch in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        kept.append(cols)
        # The last group may go on in the next batch.
        last = [c[-1] for c in cols[:3]]
        n = len(cols[0]) - 1
        while n >= 0 and all(c[n] == x for c, x in zip(cols[:3], last)):
            n -= 1
        if n < 0:
            continue
        whole = [np.concatenate(c) for c in zip(*kept)]
        cut = len(whole[0]) - (len(cols[0]) - n - 1)
        if (out := pairs([c[:cut] for c in whole])) is not None:
            yield out
        kept = [[c[cut:].copy() for c in whole]]
    if kept and len(kept[0][0]):
        if (out := pairs([np.concatenate(c) for c in zip(*kept)])) is not None:
            yield out


class NearDuplicates:
    """Near-duplicates of a table: copies collapse to a class with the least id as its representative, then classes are joined.

    Null ids, null texts and texts of fewer than `min_words` words take no part. A repeated row is in its class once.
    Equal texts, ties in similarity and an empty table need no special treatment; other columns are ignored.
    """

    def __init__(self, df: DataFrame, id_col: str = "id", text_col: str = "content_text", shingle: int = 5, similarity: float = 0.8, min_words: int = 1, block: int = BLOCK):
        self.similarity, self.block, self.most = similarity, block, hamming_bound(similarity)
        self.store = materialise(_prepare(df, id_col, text_col, shingle, min_words), "shingles")
        #: (id, rep) of the rows that are copies of an earlier one.
        least = self.store.groupBy("k0", "k1").agg(F.min("id").alias("rep"), F.count("*").alias("n")).where("n > 1").drop("n")
        self.copies = materialise(self.store.select("id", "k0", "k1").join(least, ["k0", "k1"]).where("id <> rep").select("id", "rep").distinct(), "copies")
        self._links: DataFrame | None = None

    def _candidates(self) -> DataFrame:
        """Pairs within the Hamming bound, from the Gray-order trees of all band tables.

        A tree's upper nodes fix the bits of its band; they are numbered by Gray rank. A node with one member has no pair, so
        nodes are counted first, from (rank, id) alone, and only members of others get their fingerprints and go to the
        tasks that hold the ranges of the rank.
        """
        heads = self.store.select("id", "bands", *FINGER).join(self.copies, "id", "left_anti")
        rows = heads.select(F.explode("bands").alias("key"), "id")
        # Counted before the shuffle; a hot node is a row here, and cut into parts below.
        nodes = materialise(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", F.ceil(F.col("n") / self.block).cast("int").alias("parts")), "gray-nodes")
        members = rows.join(nodes, "key").join(heads.select("id", *FINGER), "id")
        own = F.pmod(F.xxhash64("id"), "parts").cast("int")
        salted = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        salted = salted.select("key", F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"), "own", "id", *FINGER)
        # Ranks are spread evenly, so ranges of equal width are ranges of about equal size.
        ordered = salted.repartition(F.shiftrightunsigned("key", 64 - RANGE_BITS), "bi", "bj").sortWithinPartitions("key", "bi", "bj")
        most = self.most
        return ordered.mapInArrow(lambda batches: _joined(batches, most), "a bigint, b bigint").distinct()

    def links(self) -> DataFrame:
        """(a, b, similarity): pairs of different representatives with at least the wanted similarity, a < b."""
        if self._links is None:
            pairs = self._candidates()
            ends = pairs.select(F.explode(F.array("a", "b")).alias("id"), "a", "b")
            sets = self.store.select("id", "shingles").join(self.copies, "id", "left_anti").dropDuplicates(["id"])
            sides = ends.join(sets, "id").groupBy("a", "b").agg(F.min(F.struct((F.col("id") == F.col("b")).alias("second"), "shingles")).alias("x"), F.max(F.struct((F.col("id") == F.col("b")).alias("second"), "shingles")).alias("y"))
            common = F.size(F.array_intersect("x.shingles", "y.shingles"))
            share = sides.select("a", "b", common.alias("common"), (F.size("x.shingles") + F.size("y.shingles")).alias("both")).select("a", "b", (F.col("common") / (F.col("both") - F.col("common"))).alias("similarity"))
            self._links = materialise(share.where(F.col("similarity") >= self.similarity), "links")
        return self._links

    def classes(self) -> DataFrame:
        """(id, rep) of every row that takes part."""
        return self.store.select("id").distinct().join(self.copies, "id", "left").select("id", F.coalesce("rep", "id").alias("rep"))

    def documents(self) -> DataFrame:
        """(id, class_id, links): each row, its class of equal texts and the number of other classes it is linked to."""
        links = self.links()
        n = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
        return self.classes().join(n, "rep", "left").select("id", F.col("rep").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))

    def groups(self, rounds: int | None = None) -> DataFrame:
        """(id, group_id, size): connected groups of linked rows; group_id is the least id. Rows without a partner are left out.

        Alternates large-star and small-star steps on tables written each round, until no edge changes. With a limit of
        rounds, a RuntimeError says that edges still changed in the last one.
        """
        edges = self.links().select(F.col("b").alias("u"), F.col("a").alias("v"))
        for k in count():
            if k == rounds:
                raise RuntimeError(f"groups still change after {rounds} rounds")
            both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
            large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            down = large.unionByName(edges.select("u", "v")).where("u <> v").distinct()
            low = down.groupBy("u").agg(F.min("v").alias("m"))
            small = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
            new = materialise(small, f"stars-{k}")
            same = new.exceptAll(edges).isEmpty() and edges.exceptAll(new).isEmpty()
            edges = new
            if same:
                break
        roots = edges.groupBy("u").agg(F.min("v").alias("group_id"))
        member = roots.unionByName(roots.select(F.col("group_id").alias("u"), "group_id").distinct())
        paired = self.copies.select(F.col("rep").alias("u"), F.col("rep").alias("own")).distinct()
        rooted = member.join(paired, "u", "full").select("u", F.coalesce("group_id", "own").alias("group_id"))
        rows = self.classes().join(rooted, F.col("rep") == F.col("u")).select("id", "group_id")
        sizes = rows.groupBy("group_id").agg(F.count("*").alias("size"))
        return rows.join(sizes, "group_id").select("id", "group_id", "size")

    def pairs(self) -> DataFrame:
        """(id_a, id_b): every pair of rows, copies expanded. For results that must list them; else use links() and classes()."""
        links = self.links().select("a", "b")
        copies = self.copies
        # Of the representatives, only those that are linked or copied have partners.
        members = copies.unionByName(copies.select(F.col("rep").alias("id"), "rep").distinct())
        left = links.join(members.select(F.col("id").alias("id_a"), F.col("rep").alias("a")), "a", "left").select("b", F.coalesce("id_a", "a").alias("id_a"))
        both = left.join(members.select(F.col("id").alias("id_b"), F.col("rep").alias("b")), "b", "left").select("id_a", F.coalesce("id_b", "b").alias("id_b"))
        inside = members.select("rep", F.col("id").alias("id_a")).join(members.select("rep", F.col("id").alias("id_b")), "rep").where("id_a < id_b").select("id_a", "id_b")
        return both.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b")).unionByName(inside)
