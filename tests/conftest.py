import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from check_oracles import session  # noqa: E402

from skuforge import rules  # noqa: E402
from skuforge.plans.pipeline import run  # noqa: E402
from skuforge.plans.results import written  # noqa: E402

GOLDEN = ("PDSH4816AF", "PDSH4816AF Dishwasher SS - Display Only", "-- Unbranded --", "-- No Unilog Brand --", "-- No DIB Brand --",
          "Appliance Dealers Cooperative (APPDE)")


def feed_row(mpn, desc, maker="Hunter Fan Company", e1="", unilog="", dib=""):
    return (mpn, desc, e1, unilog, dib, maker)


# name -> feed row
CASES = {
    "golden": GOLDEN,
    "belt": feed_row("DCB1", 'Diablo 1/2"x18" Sanding Belt', "Freud Inc (2435)"),
    "coupling": feed_row("QQ1", "3/8 CPLG BRS 150# FNPT Coupling"),
    "rod": feed_row("QQ2", 'Steel Rod 5/16" x 36"'),
    "spindle": feed_row("QQ3", "Oliver Shaper 1-1/4 Spindle"),
    "decimals": feed_row("QQ4", '0.375" x 2.5" Bar'),
    "half": feed_row("QQ5", '0.5" ID Ring'),
    "disc": feed_row("49-94-0013", '5"x.045"x7/8" Metal Cut Off Disc 10pk', "Milwaukee Accessory (4031)"),
    "flap": feed_row("QQ6", '4-1/2"x7/8" Flap Disc 80 Grit'),
    "unknown": feed_row("ZZ-1", "Widget", "Acme Supply"),
    "masked": feed_row("QQ7", "Plain thing", "Acme Supply", e1="Bosch", unilog="-- No Unilog Brand --"),
    "fuzzy": feed_row("QQ8", "Plain thing", "Mirka Abrasive Inc"),
    "class": feed_row("QQ9", "Hex Bolt 1/2-13 GRADE 5 #8 x 3\" Zinc"),
    "gauge": feed_row("QQ10", "Drywall Screw #8 Phillips Bugle x 2in black phosphate"),
    "open_head": feed_row("QQ11", "Ratchet open head pin detent"),
    "trex_fitting": feed_row("QQ12", "Trex steel coupling 1x6-16' fascia"),
    "star": feed_row("A*B~C D", "Bosch drill"),
    "tabs": feed_row(" QQ13\t", "\tGas range \n", " Acme "),
    "blank_mpn": feed_row("  ", "Widget"),
    "blank_desc": feed_row("QQ14", "\t"),
    "blank_maker": feed_row("QQ15", "Widget", None),
    "all_blank": (None, None, None, None, None, None),
}


@pytest.fixture(scope="session")
def spark():
    s = session(4)
    yield s


@pytest.fixture(scope="session")
def results(spark):
    rows = [(i + 1, *row) for i, row in enumerate(CASES.values())]
    feed = spark.createDataFrame(rows, "row_id long, " + ", ".join(f"{c} string" for c in rules.REQUIRED_COLUMNS))
    return written(run(feed), "case-results")


@pytest.fixture(scope="session")
def by_name(results):
    rows = {r["row_id"]: r for r in results.collect()}
    return {name: rows[i + 1] for i, name in enumerate(CASES)}
