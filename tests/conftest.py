import datetime as dt
import itertools
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from lapsewise.functions.months import key_plus
from lapsewise.plans.inputs import Inputs
from lapsewise.session import local_session
from lapsewise.spec import RetentionSpec

FILL_SCHEMA = (
    "entity_id long, fill_date date, fill_month date, fill_yyyymm int, product_key long, "
    "product_code string, chain string, channel string, outlet_class string, days_supply int, "
    "supplier_id int, state string, is_maintenance int, is_bridge_error int"
)
PRODUCT_SCHEMA = (
    "prod_id int, pack_cd int, market string, market_desc string, prod_desc string, "
    "special_flag string"
)


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "4g", {"spark.sql.shuffle.partitions": "4"})
    yield session
    session.stop()


@pytest.fixture
def spec():
    return RetentionSpec()


def fill(entity=1, month=201501, day=1, **other):
    """One fill as a dict; a retail fill of product 1001 at the first own chain."""
    row = {
        "entity_id": entity,
        "fill_date": dt.date(month // 100, month % 100, day),
        "fill_month": dt.date(month // 100, month % 100, 1),
        "fill_yyyymm": month,
        "product_key": 1001,
        "product_code": "1001",
        "chain": "032",
        "channel": "RETAIL",
        "outlet_class": "CHAIN",
        "days_supply": 30,
        "supplier_id": 1,
        "state": "TX",
        "is_maintenance": 1,
        "is_bridge_error": 0,
    }
    unknown = set(other) - set(row)
    assert not unknown, unknown
    return {**row, **other}


def months(first, count):
    return [key_plus(first, n) for n in range(count)]


def fills_frame(spark, rows):
    columns = [c.split()[0] for c in FILL_SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(r[c] for c in columns) for r in rows], FILL_SCHEMA)


def make_inputs(spark, rows, exclusion=(), products=None, market_codes=("2001",)):
    """Products: 1001 in 31100, 2001 in the listed market, 3001 in none."""
    fills = fills_frame(spark, rows)
    products = products or [
        (1, 1, "31100", "MARKET ONE", "one", None),
        (2, 1, None, None, "two", "0"),
        (3, 1, None, None, "three", None),
    ]
    bridge = [(str(p * 1000 + k).zfill(12), p, k) for p, k, *_ in products]
    return Inputs(
        fills=fills,
        history=fills,
        products=spark.createDataFrame(products, PRODUCT_SCHEMA),
        bridge=spark.createDataFrame(bridge, "ndc_cd string, prod_id int, pack_cd int"),
        market_codes=spark.createDataFrame([(c,) for c in market_codes], "ndc string"),
        exclusion_codes=spark.createDataFrame([(c,) for c in exclusion], "ndc string"),
    )


def flat(*groups):
    return list(itertools.chain.from_iterable(groups))


def rows(df, *columns):
    """Rows as a sorted list of tuples."""
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=repr)
