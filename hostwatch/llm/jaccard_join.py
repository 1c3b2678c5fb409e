"""N-gram Jaccard join with skipping by set relations.

Sets are the distinct 5-word shingles of a document. Documents with equal sets form a class, and only classes are
compared. The join is exact:

1. Prefixes. Shingles have one order for all sets: rare ones by hash, then the frequent ones by count (counted in all
   documents; a bounded list, and any order gives the same result). Two sets that link share a shingle among the first
   n - ceil(0.8 n) + 1 of each. Every class posts those, with its size and their positions.
2. Index lists, one per shingle, are sorted by size. A pair is skipped by its place alone: sizes too far apart, the
   smaller set past its index prefix, or too few shingles left behind both positions.
3. Short lists give all their pairs. Long lists first give the pairs with four leaders (least hashes), so that a list
   of m near copies gives 4 m pairs and not m^2. Verified links make components.
4. Of a long list that still holds several components, all pairs between components follow. A set's answers are first
   derived from those of a highly similar set: overlaps with a leader L known for x and y bound the overlap of x and y,
   |xL| + |yL| - |L| <= |xy| <= |yL| + |x| - |xL|. Only pairs that the bounds leave open read the texts.

Verification meets in blocks of at most about 64 partners for a hub, with whole texts. Components come from rounds of
least labels. Nothing is capped: a long list only changes the order in which its pairs are looked at.

Null or blank text: empty set, linked with nothing, its own component. Null doc_ids are kept; they are the component's
id only where no other is. Empty table: empty result. Set digests have 64 bits in postings, words and shingles too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WORDS = 5
SHORT_LIST = 8
LEADERS = 4
PARTNERS = 64
#: Shingles at the end of the order: how often one task must see them, how many are kept, which lists are long anyway.
LOCAL_COUNT, FREQUENT, LONG = 3, 1 << 18, 256
FLUSH = 4_000_000
#: Odd multipliers of the shingle hash.
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)


class WordHashes(dict):
    """64-bit hashes of words, each computed once in a task."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1_000_000:
            self.clear()
        self[word] = value = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return value


def shingles(text: str | None, hashes: WordHashes, width: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; of fewer words, the whole sequence is one."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    own = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    count, used = max(1, len(own) - width + 1), min(width, len(own))
    out = np.full(count, used, np.uint64)
    for j in range(used):
        part = own[j:j + count]
        out = (out ^ (out >> np.uint64(31))) * np.uint64(MULTIPLIERS[j % 5]) + (part ^ (part >> np.uint64(29)))
    out ^= out >> np.uint64(32)
    out *= np.uint64(MULTIPLIERS[1])
    out ^= out >> np.uint64(29)
    return np.unique(out)


def digest(values: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(values.tobytes(), digest_size=8).digest(), "little", signed=True)


def text_hash():
    return F.xxhash64(common.text_of())


def scan_sets(docs: DataFrame) -> DataFrame:
    """doc_id, n, set_id, hash of every row; and rows token, count for shingles that one task saw often."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen, parts, held = WordHashes(), set(), [], 0
        for batch in batches:
            size, ids = [], []
            for text in batch.column("text").to_pylist():
                own = shingles(text, hashes)
                size.append(len(own))
                ids.append(digest(own) if len(own) else None)
                if len(own) and ids[-1] not in seen:
                    seen.add(ids[-1])
                    parts.append(own)
                    held += len(own)
            none = pa.nulls(len(size), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(ids, pa.int64()),
                                              batch.column("hash"), none, none], names)
            if held > FLUSH:
                yield often(parts)
                parts, held = [], 0
        if parts:
            yield often(parts)

    def often(parts: list[np.ndarray]) -> pa.RecordBatch:
        values, counts = np.unique(np.concatenate(parts), return_counts=True)
        keep = counts >= LOCAL_COUNT
        none = pa.nulls(int(keep.sum()), pa.int64())
        return pa.RecordBatch.from_arrays([none, none, none, none, pa.array(values[keep].view(np.int64)), pa.array(counts[keep], pa.int64())], names)

    names = ["doc_id", "n", "set_id", "hash", "token", "count"]
    return common.staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("hash"), "text").mapInArrow(
        scan, "doc_id long, n long, set_id long, hash long, token long, count long"), "sets")


def frequent_shingles(scanned: DataFrame, most: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """Tokens with the largest counts, at most ``most`` of them, in ascending order of count; and their counts."""
    counts = common.staged(scanned.filter(F.col("token").isNotNull()).groupBy("token").agg(F.sum("count").alias("count")), "frequent")
    step = F.floor(F.log2("count") * 4).cast("int")
    room, least = most, 1 << 30
    for row in sorted(counts.groupBy(step.alias("step")).count().collect(), key=lambda r: -r["step"]):
        room -= row["count"]
        if room < 0:
            break
        least = row["step"]
    table = counts.filter(step >= least).toArrow()
    tokens = table.column("token").to_numpy().astype(np.int64).view(np.uint64)
    n = table.column("count").to_numpy()
    order = np.lexsort((tokens, n))
    return tokens[order], n[order]


def post_prefixes(docs: DataFrame, tokens: np.ndarray, counts: np.ndarray) -> DataFrame:
    """token (in the common order), set_id, n, pos, long: prefix of every class, once per task."""
    by_value = np.argsort(tokens)
    sent = docs.sparkSession.sparkContext.broadcast((tokens[by_value], by_value.astype(np.uint64)))
    first_long = int(np.searchsorted(counts, LONG))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rank = sent.value
        hashes, seen, top = WordHashes(), set(), np.uint64(1 << 63)
        for batch in batches:
            out: list[tuple] = []
            for text in batch.column("text").to_pylist():
                own = shingles(text, hashes)
                if not len(own):
                    continue
                key = digest(own)
                if key in seen:
                    continue
                seen.add(key)
                order = own >> np.uint64(1)
                if len(known):
                    at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                    hit = known[at] == own
                    order[hit] = top + rank[at[hit]]
                n = len(own)
                prefix = n - (4 * n + 4) // 5 + 1
                # the hash halves: two shingles of one set may agree in order, which only adds candidates
                order = np.sort(np.partition(order, prefix - 1)[:prefix]) if prefix < n else np.sort(order)
                out.append((order, key, n))
            if out:
                size = np.array([len(x[0]) for x in out])
                order = np.concatenate([x[0] for x in out])
                yield pa.RecordBatch.from_arrays([
                    pa.array(order.view(np.int64)), pa.array(np.repeat(np.array([x[1] for x in out], np.int64), size)),
                    pa.array(np.repeat(np.array([x[2] for x in out], np.int32), size)),
                    pa.array((np.arange(len(order)) - np.repeat(np.cumsum(size) - size, size)).astype(np.int32)),
                    pa.array(order >= top + np.uint64(first_long))], ["token", "set_id", "n", "pos", "long"])

    return docs.select("text").mapInArrow(common.releasing(post), "token long, set_id long, n int, pos int, long boolean")


def may_link(n: np.ndarray, m: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether sets of n <= m shingles can link if the ones at positions i and j are the first that they share.

    Then all shared ones lie from there on. A pair that links passes at its first shared shingle, whatever it does at others.
    """
    least = -(-4 * (n + m) // 9)
    return (5 * n >= 4 * m) & (np.minimum(n - i, m - j) >= least)


def walk_lists(postings: DataFrame) -> DataFrame:
    """Pairs (set_id, other) of short lists; the postings of longer ones (other is null). Lists come sorted."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = None
        for batch in batches:
            now = [batch.column(c).to_numpy() for c in ("token", "n", "set_id", "pos")]
            if carry is not None:
                now = [np.concatenate(x) for x in zip(carry, now)]
            last = int(np.searchsorted(now[0], now[0][-1])) if len(now[0]) else 0
            carry = [x[last:] for x in now]
            if last:
                yield lists([x[:last] for x in now])
        if carry is not None and len(carry[0]):
            yield lists(carry)

    def lists(columns: list[np.ndarray]) -> pa.RecordBatch:
        token, n, key, pos = columns
        fresh = np.ones(len(token), bool)
        fresh[1:] = (token[1:] != token[:-1]) | (key[1:] != key[:-1])
        token, n, key, pos = (x[fresh] for x in (token, n, key, pos))
        _, start, size = np.unique(token, return_index=True, return_counts=True)
        size = np.repeat(size, size)
        found = []
        for d in range(1, SHORT_LIST):
            a = np.flatnonzero((size[:-d] <= SHORT_LIST) & (token[:-d] == token[d:])) if len(token) > d else np.empty(0, int)
            b = a + d
            ok = may_link(n[a].astype(np.int64), n[b].astype(np.int64), pos[a].astype(np.int64), pos[b].astype(np.int64))
            found.append((a[ok], b[ok]))
        a, b = (np.concatenate([x[k] for x in found]) for k in (0, 1))
        rest = np.flatnonzero(size > SHORT_LIST)
        own = np.concatenate((a, rest))
        other = pa.concat_arrays([pa.array(key[b]), pa.nulls(len(rest), pa.int64())])
        return pa.RecordBatch.from_arrays([pa.array(token[own]), pa.array(key[own]), pa.array(n[own]), pa.array(pos[own]), other],
                                          ["token", "set_id", "n", "pos", "other"])

    parts = int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = postings.repartition(parts, "token").sortWithinPartitions("token", "n", "set_id", "pos")
    return ordered.mapInArrow(common.releasing(walk), "token long, set_id long, n int, pos int, other long")


def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """hub, other, hub_n, other_n, shared for pairs (hub, other); sets come from the whole texts (set_id, text)."""
    pairs = common.staged(pairs.select("hub", "other").distinct(), "pairs")
    busy = common.small(pairs.groupBy("hub").agg(F.count(F.lit(1)).alias("partners")).filter(F.col("partners") > PARTNERS))
    blocks = F.coalesce(common.div(F.col("partners"), PARTNERS) + 1, F.lit(1))
    dealt = pairs.join(busy, "hub", "left").select("hub", "other", F.pmod(F.xxhash64("other"), blocks).alias("block"))
    others = dealt.join(texts.select(F.col("set_id").alias("other"), "text"), "other").select("hub", "block", "other", "text")
    hubs = dealt.select("hub", "block").distinct().join(texts.select(F.col("set_id").alias("hub"), "text"), "hub").select(
        "hub", "block", F.lit(None).cast("long").alias("other"), "text")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, at, own = WordHashes(), None, np.empty(0, np.uint64)
        for batch in batches:
            out = []
            for hub, other, text in zip(*(batch.column(c).to_pylist() for c in ("hub", "other", "text"))):
                now = shingles(text, hashes)
                if other is None:
                    at, own = hub, now
                    continue
                if at != hub:
                    raise RuntimeError("a block came without its hub")
                shared = int(np.isin(now, own, assume_unique=True).sum()) if len(now) < 20 else len(np.intersect1d(now, own, True))
                out.append((hub, other, len(own), len(now), shared))
            columns = list(zip(*out)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], ["hub", "other", "hub_n", "other_n", "shared"])

    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = hubs.unionByName(others).repartition(parts, "hub", "block").sortWithinPartitions("hub", "block", F.col("other").asc_nulls_first())
    return common.staged(met.mapInArrow(common.releasing(compare), "hub long, other long, hub_n long, other_n long, shared long"), "verified")


def linked(shared, n, m):
    return 100 * shared >= 80 * (n + m - shared)


def leader_pairs(lists: DataFrame) -> DataFrame:
    """Pairs of every set of a long list with the list's leaders.

    The shingle stands early in sets with few rare ones, which are nearest to what the list's sets have in common.
    """
    ranks = [F.xxhash64("set_id", F.lit(r)) for r in range(LEADERS)]
    leaders = lists.groupBy("token").agg(*[F.min(F.struct("pos", h.alias("h"), "set_id", "n")).alias(f"l{r}") for r, h in enumerate(ranks)])
    leaders = common.small(leaders.select("token", F.array_distinct(F.array(*[F.struct(
        F.col(f"l{r}.set_id").alias("id"), F.col(f"l{r}.n").alias("n")) for r in range(LEADERS)])).alias("leaders")))
    pairs = lists.join(leaders, "token").select("set_id", "n", F.explode("leaders").alias("leader"))
    n, m = F.least("n", "leader.n"), F.greatest("n", "leader.n")
    return pairs.filter((F.col("leader.id") != F.col("set_id")) & (5 * n >= 4 * m)).select(
        F.col("leader.id").alias("hub"), F.col("set_id").alias("other")).distinct()


def cross_pairs(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs of a long list between components: sets outside the list's largest component with all others."""
    lists = lists.join(labels.select(F.col("node").alias("set_id"), "label"), "set_id", "left").withColumn(
        "label", F.coalesce("label", "set_id"))
    sizes = lists.groupBy("token", "label").agg(F.count(F.lit(1)).alias("c"))
    mixed = common.small(sizes.groupBy("token").agg(F.max(F.struct("c", "label")).alias("most"), F.count(F.lit(1)).alias("kinds"))
                         .filter("kinds > 1").select("token", F.col("most.label").alias("most")))
    lists = common.staged(lists.join(mixed, "token"), "mixed-lists")
    few = common.small(lists.filter("label != most").select("token", *[F.col(c).alias(f"{c}_") for c in ("set_id", "n", "pos", "label")]))
    both = lists.join(few, "token").filter("label != label_ AND set_id != set_id_ AND (label = most OR set_id < set_id_)")
    n, m = F.least("n", "n_"), F.greatest("n", "n_")
    left = F.least(F.col("n") - F.col("pos"), F.col("n_") - F.col("pos_"))
    keep = (5 * n >= 4 * m) & (9 * left >= 4 * (n + m))
    return both.filter(keep).select(F.col("set_id_").alias("x"), F.col("n_").alias("x_n"), F.col("set_id").alias("y"),
                                    F.col("n").alias("y_n")).distinct()


def derived(pairs: DataFrame, verified: DataFrame) -> DataFrame:
    """Bounds on the overlap of x and y from their known overlaps with a common hub: least, most (null: none known)."""
    hub = verified.select("hub", "other", "hub_n", "shared")
    known = hub.unionByName(hub.select("hub", F.col("hub").alias("other"), "hub_n", F.col("hub_n").alias("shared")).distinct())
    x = known.select("hub", F.col("other").alias("x"), F.col("hub_n").alias("h"), F.col("shared").alias("xs"))
    y = known.select("hub", F.col("other").alias("y"), F.col("shared").alias("ys"))
    met = pairs.join(x, "x").join(y, ["hub", "y"])
    bounds = met.groupBy("x", "y").agg(
        F.max(F.col("xs") + F.col("ys") - F.col("h")).alias("least"),
        F.min(F.least(F.col("ys") + F.col("x_n") - F.col("xs"), F.col("xs") + F.col("y_n") - F.col("ys"))).alias("most"))
    return pairs.join(bounds, ["x", "y"], "left")


def link_classes(docs: DataFrame, scanned: DataFrame) -> DataFrame:
    """node, label of all classes that link with another."""
    tokens, counts = frequent_shingles(scanned)
    postings = common.staged(walk_or_keep(post_prefixes(docs, tokens, counts)), "lists")
    lists = postings.filter(F.col("other").isNull()).select("token", "set_id", "n", "pos")
    pairs = postings.filter(F.col("other").isNotNull()).select(F.col("set_id").alias("hub"), "other")
    pairs = common.staged(pairs.unionByName(leader_pairs(lists)).distinct(), "candidates")
    live = pairs.select(F.col("hub").alias("set_id")).unionByName(pairs.select(F.col("other").alias("set_id"))).unionByName(
        lists.select("set_id")).distinct()
    of_class = scanned.filter(F.col("set_id").isNotNull()).groupBy("set_id").agg(F.min(F.struct("doc_id", "hash")).alias("one"))
    wanted = common.small(of_class.join(live, "set_id").select("set_id", F.col("one.doc_id").alias("doc_id_"), F.col("one.hash").alias("hash_")),
                          1_000_000)
    rows = docs.select("doc_id", "text", text_hash().alias("hash"))
    texts = rows.join(wanted, (rows["hash"] == wanted["hash_"]) & rows["doc_id"].eqNullSafe(wanted["doc_id_"])).select("set_id", "text")
    texts = common.staged(texts, "texts")
    if texts.count() > wanted.count():
        texts = common.staged(texts.groupBy("set_id").agg(F.min("text").alias("text")), "texts")  # rows that are repeated whole
    verified = verify(pairs, texts)
    links = verified.filter(linked(F.col("shared"), F.col("hub_n"), F.col("other_n"))).select("hub", "other")
    labels = common.components(links, "hub", "other")
    open_pairs = common.staged(derived(cross_pairs(lists, labels), verified), "open-pairs")
    need = F.ceil(4 * (F.col("x_n") + F.col("y_n")) / 9)
    sure = open_pairs.filter(F.col("least") >= need).select(F.col("x").alias("hub"), F.col("y").alias("other"))
    asked = open_pairs.filter((F.col("least").isNull() | (F.col("least") < need)) & (F.col("most").isNull() | (F.col("most") >= need)))
    if open_pairs.limit(1).count() == 0:
        return labels
    more = verify(asked.select(F.col("x").alias("hub"), F.col("y").alias("other")), texts)
    more = more.filter(linked(F.col("shared"), F.col("hub_n"), F.col("other_n"))).select("hub", "other").unionByName(sure)
    return common.components(links.unionByName(more), "hub", "other")


def walk_or_keep(postings: DataFrame) -> DataFrame:
    """Lists known to be long stay spread as they are; the others are walked."""
    postings = common.staged(postings, "postings")
    long = postings.filter("long").select("token", "set_id", "n", "pos").distinct()
    return walk_lists(postings.filter(~F.col("long"))).unionByName(long.withColumn("other", F.lit(None).cast("long")))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, label, hash for every row of ``docs`` (doc_id, text).

    ``label`` tells components apart (null: empty set), ``hash`` is that of the text.
    """
    common.bounded_batches(docs.sparkSession)
    scanned = scan_sets(docs)
    rows = scanned.filter(F.col("token").isNull()).select("doc_id", "n", "set_id", "hash")
    labels = link_classes(docs, scanned)
    classes = rows.filter(F.col("set_id").isNotNull()).groupBy("set_id").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("rows"))
    classes = classes.join(labels.select(F.col("node").alias("set_id"), "label"), "set_id", "left").withColumn(
        "label", F.coalesce("label", "set_id"))
    classes = common.staged(classes, "classes")
    least = classes.groupBy("label").agg(F.min("first").alias("component_id"))
    table = common.staged(classes.join(least, "label").select("set_id", "rows", "component_id", "label"), "class-components")
    out = common.hot_join(rows.filter(F.col("set_id").isNotNull()), table, "set_id", "rows", rows.count(), ["component_id", "label"])
    empty = rows.filter(F.col("set_id").isNull()).select("*", F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("label"))
    return out.unionByName(empty).select("doc_id", F.col("n").alias("n_shingles"), "component_id", "label", "hash")


def keep_one(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` but those whose component keeps another one: the smallest doc_id stays, null after all others.

    Documents without words are in no component and stay. Of rows repeated whole (doc_id and text) one stays.
    """
    found = common.staged(near_duplicates(docs.select("doc_id", "text")).filter(F.col("label").isNotNull()), "components")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash")
    stays = found.groupBy("label").agg(F.min(rank).alias("stays"), F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    gone = common.staged(found.join(stays, "label").select("doc_id", "hash", (rank == F.col("stays")).alias("is_kept")), "grouped")
    lost = common.small(gone.filter(~F.col("is_kept")).select(F.col("doc_id").alias("lost_id_"), F.col("hash").alias("lost_hash_")).distinct(),
                        1_000_000)
    rows = docs.withColumn("hash_", text_hash())
    out = rows.join(lost, (rows["hash_"] == lost["lost_hash_"]) & rows["doc_id"].eqNullSafe(lost["lost_id_"]), "left_anti")
    again = gone.filter("is_kept").groupBy("doc_id", "hash").count().filter("count > 1").select(
        F.col("doc_id").alias("again_id_"), F.col("hash").alias("again_hash_"))
    again = common.small(again, 1_000_000)
    if again.limit(1).count():
        same = (out["hash_"] == again["again_hash_"]) & out["doc_id"].eqNullSafe(again["again_id_"])
        once = out.join(again, same, "left_semi").dropDuplicates(["doc_id", "hash_"])
        out = out.join(again, same, "left_anti").unionByName(once)
    return out.select(*docs.columns)


def op5_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """All documents with the size of their set and their component."""
    return near_duplicates(common.documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")
