from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession
    session = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "4")
               .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
               .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "6g")
               .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).getOrCreate())
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


PACKET_SCHEMA = ("packet_no long, ts_us long, src_ip long, dst_ip long, src_port int, dst_port int, protocol int, ttl int, "
                 "tcp_win int, is_frag int, payload_len long, is_retrans int, syn int, ack int, fin int, rst int, psh int, "
                 "urg int, seq long")


def packet(no, t_us, src=1, dst=2, sport=1000, dport=80, proto=6, ttl=64, win=8192, frag=0, size=0, retr=0, syn=0,
           ack=0, fin=0, rst=0, psh=0, urg=0, seq=0):
    return (no, t_us, src, dst, sport, dport, proto, ttl, win, frag, size, retr, syn, ack, fin, rst, psh, urg, seq)


def packets(spark, rows):
    return spark.createDataFrame(rows, PACKET_SCHEMA)


def by_key(df, *keys):
    return {tuple(r[k] for k in keys): r.asDict() for r in df.collect()}
