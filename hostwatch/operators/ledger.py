"""Tamper-evident audit chains as table jobs.

A hash chain is sequential, so records are chained in blocks of a fixed number of
records: inside a block every record commits to the one before it; the heads of
the blocks form a chain of their own, block by block, until one block is left. A
run that fits one block is one plain chain. Appending folds bounded blocks in
parallel. Verifying checks every record, that numbers have no gap, and the stored
heads of the blocks, so an absent block is named whether it was first, last or
between others.
"""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import GENESIS
from ..functions.columns import floor_div
from ..functions.crypto import hmac_sha256_hex, pseudonym_plain
from .ordered import previous_row, row_numbers

BLOCK = 256
LEVEL_FIELDS = ["block_head", "source_block"]
_LEVELS = 4               # levels of block heads: 256^5 records
_FAN_LEVELS = 8           # Merkle levels folded per step: 256 leaves
ANCHOR_DOMAIN = b"hostwatch-checkpoint-anchor"

# Reasons of a failed check, as published.
OK, MISSING, UNSIGNED, BAD_SIGNATURE = "ok", "checkpoint-log-missing-or-empty", "checkpoint-unsigned", "checkpoint-signature-invalid"
CHAIN_BROKEN, LENGTH_MISMATCH, MISMATCH = "checkpoint-log-chain-broken", "last-checkpoint-length-mismatch", "chain-does-not-match-checkpoint"
TAMPERED, NO_CHAIN, OK_EMPTY = "chain-tampered", "no-chain", "ok-empty"


def _content_parts(fields: list[str]) -> tuple[Column, Column]:
    """Canonical JSON around ``prev``: keys sorted, no spaces, NULLs kept."""
    keep = {"ignoreNullFields": "false"}
    names = sorted([*fields, "seq"])
    before = [F.col(n) for n in names if n < "prev"]
    after = [F.col(n) for n in names if n > "prev"]
    head = F.to_json(F.struct(*before), keep) if before else F.lit("{}")
    tail = F.to_json(F.struct(*after), keep)
    opened = F.substring(head, F.lit(1), F.length(head) - 1)
    comma = "," if before else ""
    return (F.concat(opened, F.lit(f'{comma}"prev":"')), F.concat(F.lit('",'), F.substring(tail, F.lit(2), F.length(tail))))


def _record_hash(prev: Column, before: Column, after: Column) -> Column:
    return F.sha2(F.concat(prev, before, prev, after), 256)


def _block_start(chain: Column, block_no: Column) -> Column:
    """What the first record of a block commits to: zeros, or the block's own name."""
    return F.when(block_no == 0, F.lit(GENESIS)).otherwise(F.sha2(F.concat_ws(":", chain.cast("string"), block_no.cast("string")), 256))


def append_chain(records: DataFrame, chain: str, order: list[str], fields: list[str], key: bytes,
                 order_chunk: Column, heads: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """Chain the records of each ``chain`` key in ``order``.

    ``host`` is replaced by a keyed pseudonym. ``heads`` (chain, count, head) continues
    existing chains. Result: chain, block_no, seq, fields, prev, hash.
    """
    df = records.select(F.col(chain).alias("chain"), *fields, *[c for c in order if c not in fields])
    df = row_numbers(df, ["chain"], order_chunk, [F.col(c) for c in order], "_pos")
    if "host" in fields:
        df = df.withColumn("host", pseudonym_plain("host", key))
    if heads is None:
        df = df.withColumn("_count", F.lit(0).cast("long")).withColumn("_head", F.lit(GENESIS))
    else:
        known = heads.select(F.col("chain"), F.col("count").alias("_count"), F.col("head").alias("_head"))
        df = df.join(known, "chain", "left").fillna({"_count": 0, "_head": GENESIS})
    df = df.withColumn("seq", F.col("_pos") - 1 + F.col("_count")).withColumn("block_no", floor_div("seq", block))
    before, after = _content_parts(fields)
    # the block that is already part-filled goes on from the existing head
    continued = (F.col("_count") % block != 0) & (F.col("block_no") == floor_div("_count", block))
    df = df.withColumn("_start", F.when(continued, F.col("_head")).otherwise(
        _block_start(F.col("chain"), F.col("block_no"))))
    item = F.struct("seq", before.alias("before"), after.alias("after"),
                    F.struct(*fields).alias("content"))
    blocks = df.groupBy("chain", "block_no").agg(
        F.array_sort(F.collect_list(item)).alias("items"), F.first("_start").alias("start"))
    links = F.aggregate(
        "items", F.struct(F.col("start").alias("prev"), F.array().cast("array<struct<prev:string,hash:string>>").alias("out")),
        lambda acc, r: _fold_link(acc, r), lambda acc: acc["out"])
    linked = blocks.select("chain", "block_no", F.inline(F.arrays_zip("items", links.alias("link"))))
    return linked.select("chain", "block_no", "items.seq", "items.content.*", "link.prev", "link.hash")


def _fold_link(acc: Column, r: Column) -> Column:
    h = _record_hash(acc["prev"], r["before"], r["after"])
    link = F.struct(acc["prev"].alias("prev"), h.alias("hash"))
    return F.struct(h.alias("prev"), F.concat(acc["out"], F.array(link)).alias("out"))


def heads(chain: DataFrame) -> DataFrame:
    """(chain, count, head) of each chain, to continue it."""
    return chain.groupBy("chain").agg(F.count(F.lit(1)).alias("count"), F.max_by("hash", "seq").alias("head"))


def _row_faults(chain: DataFrame, fields: list[str], block: int) -> DataFrame:
    """(chain, _bad): sequence numbers of records that do not match their hash, their predecessor or their place."""
    before, after = _content_parts(fields)
    df = chain.withColumn("_block", floor_div("seq", block))
    w = Window.partitionBy("chain", "_block").orderBy("seq")
    at_start = F.col("seq") % block == 0
    expected = F.coalesce(F.lag("hash").over(w), F.when(at_start, _block_start(F.col("chain"), F.col("_block"))))
    missing = F.coalesce(F.lag("seq").over(w) + 1, F.col("_block") * block)
    df = df.withColumn("_expected", expected).withColumn("_missing", missing)
    good = (F.coalesce(F.col("prev") == F.col("_expected"), F.lit(False))
            & F.coalesce(F.col("hash") == _record_hash(F.col("prev"), before, after), F.lit(False)))
    # a gap is reported at the first number that is absent, a repeated number at itself
    bad = F.when(F.col("_missing") < F.col("seq"), F.col("_missing")).when(
        ~good | (F.col("_missing") > F.col("seq")), F.col("seq"))
    return df.select("chain", "_block", "seq", bad.alias("_bad"))


def _block_faults(rows: DataFrame, block: int) -> DataFrame:
    """(chain, _bad): first absent number where a block is missing or ends short of the next one."""
    blocks = rows.groupBy("chain", "_block").agg(F.max("seq").alias("_end"))
    # one row per block; the chain's blocks are cut into stretches so that no task orders all of them
    carried = previous_row(blocks, ["chain"], floor_div("_block", 1 << 14), ["_block"], ["_end"])
    first = F.coalesce(F.col("prev__end") + 1, F.lit(0).cast("long"))
    return carried.filter(first != F.col("_block") * block).select("chain", F.least(first, F.col("_block") * block).alias("_bad"))


def verify_chain(chain: DataFrame, fields: list[str], block: int = BLOCK, levels: DataFrame | None = None) -> DataFrame:
    """Per chain: record count and the first bad or absent sequence number (NULL when intact).

    Every chain must number its records 0, 1, 2, ... without a gap. ``levels`` (see ``head_levels``) tells as well
    what is missing at the end: each recorded block head must be the hash of that block's last record.
    """
    rows = _row_faults(chain, fields, block)
    faults = rows.select("chain", "_bad").filter(F.col("_bad").isNotNull()).unionByName(_block_faults(rows, block))
    counts = chain.groupBy("chain").agg(F.count(F.lit(1)).alias("n_records"))
    if levels is not None:
        faults = faults.unionByName(_head_faults(chain, levels, block))
        counts = levels.select("chain").distinct().join(counts, "chain", "full").fillna({"n_records": 0})
    worst = faults.groupBy("chain").agg(F.min("_bad").alias("first_bad"))
    return counts.join(worst, "chain", "left").select("chain", "n_records", "first_bad")


def _head_faults(chain: DataFrame, levels: DataFrame, block: int) -> DataFrame:
    """(chain, _bad): start of every block whose recorded head is not found, at any level, as record numbers."""
    heads_now = block_heads(chain, block).select("chain", F.lit(1).alias("level"), F.col("block_no").alias("source_block"), "block_head")
    heads_up = block_heads(levels.select(F.struct("chain", "level").alias("chain"), "block_no", "seq", "hash"), block).select(
        "chain.chain", (F.col("chain.level") + 1).alias("level"), F.col("block_no").alias("source_block"), "block_head")
    found = heads_now.unionByName(heads_up).withColumnRenamed("block_head", "_now")
    wide = levels.join(found, ["chain", "level", "source_block"], "left")
    lost = wide.filter(~F.col("block_head").eqNullSafe(F.col("_now"))).select(
        "chain", (F.col("source_block") * F.pow(F.lit(float(block)), F.col("level")).cast("long")).alias("_bad"))
    own = None
    for level in range(1, _LEVELS + 1):
        part = _row_faults(levels.filter(F.col("level") == level), LEVEL_FIELDS, block).filter(F.col("_bad").isNotNull()).select(
            "chain", (F.col("_bad") * F.lit(block ** level)).cast("long").alias("_bad"))
        own = part if own is None else own.unionByName(part)
    return lost.unionByName(own)


def leaf_hash(line: Column) -> Column:
    return F.sha2(F.concat(F.lit(bytearray(b"\0")), line.cast("binary")), 256)


def _parent_level(nodes: Column) -> Column:
    pairs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / 2).cast("int"))
    node = F.lit(bytearray(b"\1"))
    # an odd level pairs its last node with itself
    at = lambda i: F.unhex(F.get(nodes, F.least(i, F.size(nodes) - 1)))
    return F.transform(pairs, lambda i: F.sha2(F.concat(node, at(i * 2), at(i * 2 + 1)), 256))


def merkle_root(leaves: DataFrame, chain: str = "chain") -> DataFrame:
    """Root per chain over (chain, idx, leaf); each step folds 256 neighbours into one node.

    Steps are log_256 of the longest chain; only that length comes to the driver.
    """
    sizes = leaves.groupBy(chain).agg(F.count(F.lit(1)).alias("_m"))
    longest = sizes.agg(F.max("_m")).first()[0] or 0
    df = leaves.join(sizes, chain).select(chain, "idx", F.col("leaf").alias("node"), "_m")
    fan = 1 << _FAN_LEVELS
    while longest > 1:
        groups = df.groupBy(chain, floor_div("idx", fan).alias("idx")).agg(
            F.transform(F.array_sort(F.collect_list(F.struct("idx", "node"))), lambda s: s["node"]).alias("nodes"),
            F.first("_m").alias("_m"))
        state = F.aggregate(
            F.sequence(F.lit(1), F.lit(_FAN_LEVELS)),
            F.struct(F.col("nodes").alias("nodes"), F.col("_m").alias("m")),
            lambda acc, _: F.struct(
                F.when(acc["m"] > 1, _parent_level(acc["nodes"])).otherwise(acc["nodes"]).alias("nodes"),
                F.floor((acc["m"] + 1) / 2).alias("m")))
        df = groups.withColumn("_s", state).select(
            chain, "idx", F.get("_s.nodes", F.lit(0)).alias("node"), F.col("_s.m").alias("_m"))
        longest = -(-longest // fan)
    return df.select(chain, F.col("node").alias("merkle_root"))


def record_lines(chain: DataFrame, fields: list[str]) -> DataFrame:
    """(chain, idx, leaf): one Merkle leaf per full record, its hash included."""
    before, after = _content_parts(fields)
    line = F.concat(before, F.col("prev"), after, F.col("hash"))
    return chain.select("chain", F.col("seq").alias("idx"), leaf_hash(line).alias("leaf"))


def anchor_key(key: bytes) -> bytes:
    """Checkpoint signatures use a derived key, never the pseudonym key itself."""
    return hmac.new(key, ANCHOR_DOMAIN, hashlib.sha256).digest()


def _signature(key: bytes) -> Column:
    body = F.to_json(F.struct("chain", "cp_no", "count", "head", "merkle_root", "prev_sig"))
    return hmac_sha256_hex(anchor_key(key), body)


def checkpoint(chain: DataFrame, fields: list[str], key: bytes, log: DataFrame | None = None) -> DataFrame:
    """One signed checkpoint per chain: head, count, Merkle root, previous signature."""
    if not key:
        raise ValueError("ledger key must be non-empty")
    now = heads(chain).join(merkle_root(record_lines(chain, fields)), "chain")
    if log is None:
        now = now.withColumn("cp_no", F.lit(0).cast("long")).withColumn("prev_sig", F.lit(GENESIS))
    else:
        last = log.groupBy("chain").agg((F.max("cp_no") + 1).alias("cp_no"), F.max_by("sig", "cp_no").alias("prev_sig"))
        now = now.join(last, "chain", "left").fillna({"cp_no": 0, "prev_sig": GENESIS})
    return now.select("chain", "cp_no", "count", "head", "merkle_root", "prev_sig").withColumn("sig", _signature(key))


def check_anchor(chain: DataFrame, log: DataFrame, fields: list[str], key: bytes,
                 chains: DataFrame | None = None) -> DataFrame:
    """(chain, anchor_reason): every checkpoint line must be signed and linked, the last must match."""
    w = Window.partitionBy("chain").orderBy("cp_no")
    line = (F.when(F.col("sig").isNull(), UNSIGNED).when(F.col("sig") != _signature(key), BAD_SIGNATURE)
            .when(F.col("prev_sig") != F.coalesce(F.lag("sig").over(w), F.lit(GENESIS)), CHAIN_BROKEN))
    lines = log.withColumn("_bad", line).groupBy("chain").agg(
        F.min_by("_bad", F.when(F.col("_bad").isNotNull(), F.col("cp_no"))).alias("_line"),
        F.max_by(F.struct("count", "head", "merkle_root"), "cp_no").alias("_last"))
    now = heads(chain).join(merkle_root(record_lines(chain, fields)), "chain")
    every = (chains or now.select("chain").unionByName(lines.select("chain"))).select("chain").distinct()
    both = every.join(now, "chain", "left").join(lines, "chain", "left")
    reason = (
        F.when(F.col("_last").isNull(), MISSING).when(F.col("_line").isNotNull(), F.col("_line"))
        .when(F.col("_last.count") != F.coalesce("count", F.lit(0)), LENGTH_MISMATCH)
        .when((F.col("_last.head") == F.col("head")) & (F.col("_last.merkle_root") == F.col("merkle_root")), OK)
        .otherwise(MISMATCH))
    return both.select("chain", reason.alias("anchor_reason"))


def ledger_status(chain: DataFrame, log: DataFrame, fields: list[str], key: bytes, block: int = BLOCK,
                  chains: DataFrame | None = None, levels: DataFrame | None = None) -> DataFrame:
    """Per chain: records, verified, first bad record, anchored, overall reason.

    A chain without records and without a checkpoint is a failure, not a pass.
    """
    anchor = check_anchor(chain, log, fields, key, chains)
    out = anchor.join(verify_chain(chain, fields, block, levels), "chain", "left").fillna({"n_records": 0})
    n, bad = F.col("n_records"), F.col("first_bad")
    reason = (F.when(bad.isNotNull(), TAMPERED)
              .when((n == 0) & (F.col("anchor_reason") == MISSING), NO_CHAIN)
              .when((n == 0) & (F.col("anchor_reason") == OK), OK_EMPTY).otherwise(F.col("anchor_reason")))
    return out.select("chain", "n_records", (bad.isNull() & (n > 0)).cast("int").alias("verified"), "first_bad",
                      (F.col("anchor_reason") == OK).cast("int").alias("anchored"), reason.alias("reason"))


def block_heads(chain: DataFrame, block: int = BLOCK) -> DataFrame:
    """Heads of the blocks as records of the next chain level (chain, block_head)."""
    return chain.groupBy("chain", "block_no").agg(F.max_by("hash", "seq").alias("block_head"))


def head_levels(chain: DataFrame, key: bytes, block: int = BLOCK) -> DataFrame:
    """The chain of block heads, the chain of its heads, ... until one block is left; at least one level.

    level, chain, block_no, seq, source_block, block_head, prev, hash: kept beside the chain, one row per block.
    Only the number of blocks of the longest chain comes to the driver.
    """
    longest = chain.agg(F.max("block_no")).first()[0] or 0
    out, current, level = None, chain, 0
    while level == 0 or longest > 0:
        level += 1
        if level > _LEVELS:
            raise ValueError(f"chain needs more than {_LEVELS} levels; take larger blocks")
        up = block_heads(current, block).withColumn("source_block", F.col("block_no"))
        current = append_chain(up, "chain", ["source_block"], LEVEL_FIELDS, key, floor_div("source_block", 1 << 16), block=block)
        part = current.withColumn("level", F.lit(level))
        out = part if out is None else out.unionByName(part)
        longest //= block
    return out
