from __future__ import annotations

import hashlib
import hmac
import json

import pytest
from pyspark.sql import functions as F

from hostwatch.functions import crypto
from hostwatch.functions.columns import floor_div
from hostwatch.operators import ledger as lg

KEY = b"test-key"
FIELDS = ["host", "stage", "window_start"]
BLOCK = 4


def records(spark, n=10, start=0, chain="r1"):
    return spark.createDataFrame([(chain, f"10.0.0.{i % 3}", None if i % 4 == 0 else "recon", i * 5) for i in range(start, start + n)],
                                 "run string, host string, stage string, window_start long")


def chained(spark, df, heads=None):
    return lg.append_chain(df, "run", ["window_start"], FIELDS, KEY, floor_div("window_start", 20), heads, BLOCK)


def test_chain_matches_hashlib(spark):
    got = sorted(chained(spark, records(spark)).collect(), key=lambda r: r.seq)
    prev = None
    for r in got:
        if r.seq % BLOCK == 0:
            prev = "0" * 64 if r.seq == 0 else hashlib.sha256(f"r1:{r.seq // BLOCK}".encode()).hexdigest()
        host = hmac.new(KEY, f"10.0.0.{r.seq % 3}".encode(), hashlib.sha256).hexdigest()[:16]
        content = {"host": host, "stage": r.stage, "window_start": r.window_start, "seq": r.seq, "prev": prev}
        text = json.dumps(content, sort_keys=True, separators=(",", ":"))
        assert (r.host, r.prev) == (host, prev)
        prev = hashlib.sha256((prev + text).encode()).hexdigest()
        assert r.hash == prev


def test_append_in_two_runs_equals_one(spark):
    whole = {r.seq: r.hash for r in chained(spark, records(spark, 10)).collect()}
    first = chained(spark, records(spark, 6))
    second = chained(spark, records(spark, 4, start=6), lg.heads(first))
    both = {r.seq: r.hash for r in first.unionByName(second).collect()}
    assert both == whole


@pytest.fixture(scope="module")
def chain(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("chain"))
    chained(spark, records(spark, 11).unionByName(records(spark, 3, chain="r2"))).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def bad(chain):
    return {r.chain: r.first_bad for r in lg.verify_chain(chain, FIELDS, BLOCK).collect()}


def test_verify_finds_the_first_bad_record(chain):
    assert bad(chain) == {"r1": None, "r2": None}
    hit = (F.col("seq") == 6) & (F.col("chain") == "r1")
    assert bad(chain.withColumn("stage", F.when(hit, "x").otherwise(F.col("stage"))))["r1"] == 6
    assert bad(chain.withColumn("hash", F.when(hit, "0").otherwise(F.col("hash"))))["r1"] == 6
    assert bad(chain.filter(~hit))["r1"] == 6
    assert bad(chain.withColumn("hash", F.when(hit, None).otherwise(F.col("hash"))))["r1"] == 6


def python_root(leaves):
    h = lambda p, *parts: hashlib.sha256(p + b"".join(parts)).hexdigest()
    level = [h(b"\0", x.encode()) for x in leaves]
    while len(level) > 1:
        level += level[-1:] * (len(level) % 2)
        level = [h(b"\1", bytes.fromhex(a), bytes.fromhex(b)) for a, b in zip(level[::2], level[1::2])]
    return level[0]


@pytest.mark.parametrize("sizes", [(1, 2, 3, 5), (256, 257), (600, 7)])
def test_merkle_root(spark, sizes):
    rows = [(f"c{n}", i, f"leaf{i}") for n in sizes for i in range(n)]
    df = spark.createDataFrame(rows, "chain string, idx long, text string")
    got = {r.chain: r.merkle_root for r in lg.merkle_root(df.select("chain", "idx", lg.leaf_hash(F.col("text")).alias("leaf"))).collect()}
    assert got == {f"c{n}": python_root([f"leaf{i}" for i in range(n)]) for n in sizes}


def anchor(chain, log, key=KEY, **kw):
    return {r.chain: r.anchor_reason for r in lg.check_anchor(chain, log, FIELDS, key, **kw).collect()}


def test_anchor_reasons(spark, chain):
    one = lg.checkpoint(chain.filter("seq < 3"), FIELDS, KEY)
    both = one.unionByName(lg.checkpoint(chain, FIELDS, KEY, one))
    log = spark.createDataFrame(both.collect(), one.schema)
    assert anchor(chain, log) == {"r1": lg.OK, "r2": lg.OK}
    assert anchor(chain, log, b"other")["r1"] == lg.BAD_SIGNATURE
    assert anchor(chain, log.withColumn("sig", F.lit(None).cast("string")))["r1"] == lg.UNSIGNED
    assert anchor(chain, log.filter("cp_no = 1"))["r1"] == lg.CHAIN_BROKEN
    assert anchor(chain.filter("seq < 8"), log)["r1"] == lg.LENGTH_MISMATCH
    assert anchor(chain, log.filter("chain = 'r2'"))["r1"] == lg.MISSING
    rewritten = chained(spark, records(spark, 11).withColumn("stage", F.lit("impact")))
    assert anchor(rewritten, log)["r1"] == lg.MISMATCH
    # truncating both files together cannot be seen from inside
    assert anchor(chain.filter("seq < 3"), log.filter("cp_no = 0"))["r1"] == lg.OK


def test_empty_ledger_is_a_failure(spark, chain):
    log = lg.checkpoint(chain, FIELDS, KEY)
    names = spark.createDataFrame([("r1",), ("r9",)], "chain string")
    got = {r.chain: (r.n_records, r.verified, r.reason) for r in
           lg.ledger_status(chain, log, FIELDS, KEY, BLOCK, names).collect()}
    assert got == {"r1": (11, 1, lg.OK), "r9": (0, 0, lg.NO_CHAIN)}


def test_block_levels_end_in_one_block(spark, chain):
    levels = lg.head_levels(chain, KEY, BLOCK)
    assert {r.level for r in levels.select("level").distinct().collect()} == {1}
    assert {r.chain: r.first_bad for r in lg.verify_chain(levels, lg.LEVEL_FIELDS, BLOCK).collect()} == {"r1": None, "r2": None}


def test_absent_blocks_are_named(spark, chain):
    from pyspark.sql import functions as F
    levels = lg.head_levels(chain, KEY, BLOCK)

    def first_bad(copy, heads=levels):
        return {r.chain: r.first_bad for r in lg.verify_chain(copy, FIELDS, BLOCK, heads).collect()}["r1"]

    last = chain.filter("chain = 'r1'").agg(F.max("block_no")).first()[0]
    assert first_bad(chain) is None
    assert first_bad(chain.filter("block_no <> 1")) == BLOCK and first_bad(chain.filter("block_no <> 1"), None) == BLOCK
    assert first_bad(chain.filter("block_no <> 0"), None) == 0 and first_bad(chain.filter("seq <> 2"), None) == 2
    assert first_bad(chain.filter(F.col("block_no") != last)) == last * BLOCK
    assert first_bad(chain.filter("chain <> 'r1'")) == 0


def test_keys(spark):
    df = spark.createDataFrame([("10.1.2.3",)], "ip string")
    digest = hmac.new(b"k" * 70, b"node:10.1.2.3", hashlib.sha256).hexdigest()
    assert df.select(crypto.pseudonym("ip", b"k" * 70)).first()[0] == digest[:16]
    b = hmac.new(b"k", b"net24:10.1.2", hashlib.sha256).digest()
    assert df.select(crypto.net24_bucket("ip", b"k")).first()[0] == int.from_bytes(b[:4], "big") % 256
    train, test = (df.select(crypto.pseudonym("ip", b"k", True, s)).first()[0] for s in ("train", "test"))
    assert train != test
    with pytest.raises(RuntimeError):
        crypto.key_from_env(crypto.PSEUDONYM_KEY_VAR, {})
    with pytest.raises(ValueError):
        crypto.hmac_sha256_hex(b"", "ip")
