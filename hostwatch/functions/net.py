"""IPv4 helpers. Addresses travel as LONG and become text only at the edge."""

from __future__ import annotations

import ipaddress
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import INTERNAL_NETWORKS
from .columns import as_col


def ip_to_text(ip: str | Column) -> Column:
    ip = as_col(ip)
    return F.concat_ws(".", *[
        F.shiftright(ip, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)
    ])


def text_to_ip(text: str | Column) -> Column:
    parts = F.split(as_col(text), r"\.")
    return reduce(
        lambda acc, i: acc * F.lit(256) + parts[i].cast("long"), range(1, 4), parts[0].cast("long")
    )


def is_internal(ip: str | Column, networks=INTERNAL_NETWORKS) -> Column:
    """True when the LONG address lies in any of the CIDR blocks."""
    ip = as_col(ip)
    tests = []
    for cidr in networks:
        net = ipaddress.ip_network(cidr)
        tests.append(ip.bitwiseAND(F.lit(int(net.netmask))) == F.lit(int(net.network_address)))
    return reduce(lambda a, b: a | b, tests)


def looks_like_ip(text: str | Column) -> Column:
    """True for a literal IPv4 or IPv6 address."""
    text = as_col(text)
    octet = r"(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
    return text.rlike(rf"^{octet}(\.{octet}){{3}}$") | text.rlike(r"^[0-9A-Fa-f:]*:[0-9A-Fa-f:.]*$")


def is_server_port(port: str | Column, ports) -> Column:
    return as_col(port).isin([int(p) for p in ports])
