"""Records across byte ranges, against Python's reader over the whole file."""

import csv
import io
import random

import pytest

from skuforge import rules
from skuforge.sources import records
from skuforge.sources.feed import FeedError

HEAD = list(rules.REQUIRED_COLUMNS)


def quoted(cells):
    out = io.StringIO()
    csv.writer(out, lineterminator="").writerow(cells)
    return out.getvalue()


def some_records(seed, n):
    r = random.Random(seed)
    words = ["", "drill", '5" pipe', "a,b", "line\nbreak", '"quoted"', "é", "x" * 30, "two\n\nbreaks,\"and\"", " "]
    return [[f"M{seed}-{i}", *[r.choice(words) for _ in range(5)]] for i in range(n)]


def expected(text):
    """(cells, problem) of all records but the header, by the reader of the standard library."""
    rows = list(csv.reader(io.StringIO(text)))[1:]
    return [(tuple((r + [""] * 6)[:6]), None if len(r) == 6 else f"{len(r)} cells, expected 6") for r in rows if r]


def read(spark, path):
    rows = sorted(records.read_records(spark, path).collect(), key=lambda r: r["row_id"])
    assert [r["row_id"] for r in rows] == list(range(1, len(rows) + 1))
    assert all((r["record"] is None) == (r["problem"] is None) for r in rows)
    return [(tuple(r[c] for c in HEAD), r["problem"]) for r in rows]


@pytest.fixture()
def ranges(spark):
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = {k: spark.conf.get(k) for k in keys}

    def of(size):
        for k in keys:
            spark.conf.set(k, str(size))

    yield of
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("size", [61, 200, 5000, 1 << 27])
def test_records_equal_the_whole_file_reader(spark, ranges, tmp_path, size):
    ranges(size)
    want = []
    for k in range(3):
        body = "\n".join(quoted(r) for r in some_records(k, 40))
        text = ("﻿" if k == 1 else "") + ",".join(HEAD) + "\n" + body + "\n\n5\" x 3\", inch \"mark\" , a,b,c,d\nshort,one\nlong" + ",x" * 8 + "\n"
        (tmp_path / f"{k}.csv").write_text(text, encoding="utf-8")
        want += expected(text.lstrip("﻿"))
    assert any(p for _, p in want) and any("\n" in "".join(c) for c, _ in want)
    assert read(spark, str(tmp_path)) == want


@pytest.mark.parametrize("size", [40, 1 << 27])
def test_an_open_quote_takes_no_other_line(spark, ranges, tmp_path, size):
    ranges(size)
    good = [f"M{i},d{i},,,,maker" for i in range(30)]
    # an open cell that a later quote ends is one record, as for every reader; one that nothing ends is a fault of its own line
    lines = [",".join(HEAD), *good[:10], '"A\nB",two lines,,,,maker', *good[10:20], 'bad,"open cell,,,,maker', *good[20:25], "x,5' tile,,,,maker", *good[25:]]
    (tmp_path / "a.csv").write_text("\n".join(lines) + "\n")
    got = read(spark, str(tmp_path))
    assert [c[0] for c, _ in got] == [*[f"M{i}" for i in range(10)], "A\nB", *[f"M{i}" for i in range(10, 20)], "bad", *[f"M{i}" for i in range(20, 25)], "x", *[f"M{i}" for i in range(25, 30)]]
    assert [(c[0], p) for c, p in got if p] == [("bad", records.UNBALANCED)]


def test_columns_by_name_and_unfit_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text(",".join(HEAD) + "\n" + ",".join("abcdef") + "\n")
    (tmp_path / "b.csv").write_text("\n" + ",".join(h.upper() for h in reversed(HEAD)) + ",Extra\n" + ",".join("fedcba") + ",x\n")
    assert read(spark, str(tmp_path)) == [(tuple("abcdef"), None)] * 2
    rows = records.read_records(spark, str(tmp_path))
    assert records.error_records(rows).count() == 0 and records.sound_records(rows).columns == ["row_id", *rules.FEED_COLUMNS]
    (tmp_path / "c.csv").write_text("Mfg_Part_Num,Part_Desc\n1,2\n")
    with pytest.raises(FeedError, match="missing columns"):
        records.read_records(spark, str(tmp_path))
    (tmp_path / "c.csv").write_text(",".join([*HEAD, "part_desc"]) + "\n")
    with pytest.raises(FeedError, match="duplicate columns"):
        records.read_records(spark, str(tmp_path))
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "e.csv").write_text("\n \n")
    with pytest.raises(FeedError, match="empty"):
        records.read_records(spark, str(tmp_path / "d"))
