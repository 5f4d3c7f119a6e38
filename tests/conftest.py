from __future__ import annotations

import datetime as dt
import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from nightjar import schemas  # noqa: E402
from nightjar.session import build_session  # noqa: E402

AS_OF = dt.datetime(2026, 8, 15, 12, 0, 0)


@pytest.fixture(scope="session")
def spark():
    ckpt = tempfile.mkdtemp(prefix="nightjar-test-ckpt-")
    s = build_session("local[4]", app="nightjar-tests", shuffle_partitions=4,
                      extra={"spark.checkpoint.dir": ckpt, "spark.driver.memory": "4g"})
    yield s


def ago(**kw) -> dt.datetime:
    return AS_OF - dt.timedelta(**kw)


def dns_rows(spark, rows):
    """dns_query rows from dicts, with the same defaults as a resolver log:
    reason Filtered* when blocked, status NXDOMAIN when blocked."""
    out = []
    for r in rows:
        blocked = r.get("blocked", False)
        out.append((
            r["ts"], r.get("client", "10.0.0.2"), r.get("client_name"), r["qname"], r.get("qtype", "A"),
            "FilteredBlackList" if blocked else "NotFilteredNotFound", blocked,
            r.get("status", "NXDOMAIN" if blocked else "NOERROR"), None, None, None,
            r.get("registrable_domain", r["qname"]),
            _dec(r.get("label_entropy", 0.0)), r.get("run_key", "r1")))
    return spark.createDataFrame(out, schemas.DNS_QUERY)


def _dec(x):
    from decimal import Decimal
    return Decimal(str(x)).quantize(Decimal("0.00000000000001"))


def domain_rows(spark, rows):
    out = [(r["domain"], r["first_seen"], r.get("last_seen", r["first_seen"]),
            r.get("query_count", 1), r.get("blocked_count", 0)) for r in rows]
    return spark.createDataFrame(out, schemas.DNS_DOMAIN)


def known_bad_rows(spark, rows):
    return spark.createDataFrame([(d, s, AS_OF) for d, s in rows], schemas.KNOWN_BAD)
