import math
import os
import random
import sys
from datetime import datetime, timedelta

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from barloom.schemas import BARS  # noqa: E402
from barloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "barloom-tests")
    session.conf.set("spark.sql.shuffle.partitions", "3")
    # small data and many distinct plans: compiling them would take most of the time
    session.conf.set("spark.sql.adaptive.enabled", "false")
    session.conf.set("spark.sql.codegen.wholeStage", "false")
    session.conf.set("spark.sql.codegen.factoryMode", "NO_CODEGEN")
    yield session


def walk_bars(n: int, symbols=("AAA",), start=datetime(2020, 1, 1), interval="1d", basis="raw"):
    """One bar per calendar day of a seeded random walk whose drift turns now and then."""
    rows = []
    for symbol in symbols:
        draw = random.Random(f"{symbol}/{interval}")
        price, drift = 50.0 + draw.random() * 100, 0.004
        for day in range(n):
            if draw.random() < 0.06:
                drift = -drift
            before, price = price, price * math.exp(drift + draw.gauss(0, 0.012))
            opened = before * math.exp(draw.gauss(0, 0.003))
            high, low = max(opened, price) * (1 + draw.random() * 0.01), min(opened, price) * (1 - draw.random() * 0.01)
            volume = float(draw.randrange(500, 5000))
            rows.append((symbol, interval, "test", basis, start + timedelta(days=day), opened, high, low, price, volume))
    return rows


def bars_frame(spark, rows):
    return spark.createDataFrame(rows, BARS)


def closes_frame(spark, closes, symbol="AAA"):
    """Bars whose four prices follow the closes."""
    rows = []
    for i, c in enumerate(closes):
        rows.append((symbol, "1d", "test", "raw", datetime(2024, 1, 1) + timedelta(days=i), c, c, c, c, 1000.0))
    return bars_frame(spark, rows)


@pytest.fixture
def frames(spark):
    return lambda rows: bars_frame(spark, rows)
