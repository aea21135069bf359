from __future__ import annotations

import io

import pytest
from pyspark.sql import functions as F

from stridewell.config import CHANNELS
from stridewell.session import ship_package
from stridewell.sources import recordings
from stridewell.sources import recordings_format as rf

COLUMNS = ["code", "subj", "trial", "label", *CHANNELS]


def write(root, code, name, header, rows, end="\n", last=True):
    folder = root / code
    folder.mkdir(exist_ok=True)
    (folder / name).write_bytes((end.join([header, *rows]) + (end if last else "")).encode())


@pytest.fixture
def root(tmp_path):
    write(tmp_path, "WAL", "WAL_3_1_annotated.csv", "label,acc_x,acc_y", ["WAL,1.5,2", "STD,9,9", "WAL,,4", ",5,5", "WAL,x,6"])
    write(tmp_path, "WAL", "WAL_4_1_annotated.csv", "acc_y,extra,label", ["7,x,WAL"])
    write(tmp_path, "WAL", "WAL_5_annotated.csv", "label,acc_x", ["WAL,1"])
    write(tmp_path, "WAL", "WAL_6_1_annotated.csv", "acc_x,acc_y", ["1,2"])
    write(tmp_path, "WAL", "WAL_7_1.csv", "label,acc_x", ["WAL,1"])
    write(tmp_path, "WAL", "WAL_8_2_annotated.csv", "label,acc_x,gyro_z", [f"{'WAL' if i % 3 else 'SIT'},{i}.25,-{i}" for i in range(400)], last=False)
    write(tmp_path, "WAL", "WAL_9_1_annotated.csv", '"label","acc_x"', ['"WAL","1"', 'WAL, 2.5 '], end="\r\n")
    write(tmp_path, "STD", "STD_1_1_annotated.csv", "label,acc_x", ["STD,1"])
    write(tmp_path, "SIT", "SIT_1_1_annotated.csv", "label,acc_x", [])
    write(tmp_path, "CHU", "CHU_x_1_annotated.csv", "label,acc_x", ["CHU,1"])
    return tmp_path


def rows(df):
    return sorted((tuple(r) for r in df.select(COLUMNS).collect()), key=str)


def test_rows_equal_those_of_the_reader_by_groups(spark, root):
    codes = ["WAL", "STD", "SIT", "JOG"]
    want = rows(recordings.read_recordings(spark, str(root), codes))
    assert len(want) > 250 and rows(rf.load(spark, str(root), codes)) == want


@pytest.mark.parametrize("options", [{"rangeBytes": 1, "tasks": 3}, {"rangeBytes": 7}, {"rangeBytes": 100, "tasks": 1}, {"tasks": 40}])
def test_ranges_and_tasks_change_nothing(spark, root, options):
    codes = ["WAL", "STD"] if options.get("rangeBytes", 9) > 1 else ["STD"]
    want = rf.load(spark, str(root), codes)
    got = rf.load(spark, str(root), codes, **options)
    key = ["rec", "idx"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert got.select(*key).distinct().count() == got.count()


def test_rows_of_a_file_are_in_its_order(spark, root):
    out = rf.load(spark, str(root), ["WAL"], rangeBytes=64).filter("subj = 8").orderBy("idx")
    assert [r.acc_x for r in out.collect()] == [i + 0.25 for i in range(400) if i % 3]


def test_uri_and_all_labels(spark, root):
    out = rf.load(spark, f"file://{root}", ["WAL"], labels="all").filter("subj = 3").orderBy("idx")
    assert [(r.label, r.acc_x, r.acc_y, r.gyro_x) for r in out.collect()] == [("WAL", 1.5, 2, 0), ("STD", 9, 9, 0), ("WAL", None, 4, 0), (None, 5, 5, 0), ("WAL", None, 6, 0)]


def test_directories_that_a_filter_leaves_out_are_not_opened(spark, root):
    """CHU has a file whose subject is no number, which raises when its directory is listed."""
    everything = rf.load(spark, str(root))
    with pytest.raises(Exception, match="invalid literal"):
        everything.collect()
    assert everything.filter("code = 'STD'").count() == 1
    assert everything.filter(F.col("code").isin("STD", "SIT") & (F.col("subj") > 0)).count() == 1
    assert everything.filter("code = 'STD' and code = 'WAL'").count() == 0


def test_filters_choose_tasks():
    from pyspark.sql.datasource import EqualTo, GreaterThan, In

    reader = rf.RecordingsReader("/r", ["WAL", "STD", "SIT"], ["acc_x"], 2, 100, True)
    rest = GreaterThan(("subj",), 1)
    assert list(reader.pushFilters([In(("code",), ["STD", "SIT", "no"]), rest, EqualTo(("code",), "STD")])) == [rest]
    assert [(p.code, p.at, p.of) for p in reader.partitions()] == [("STD", 0, 2), ("STD", 1, 2)]


def test_no_directories(spark, tmp_path):
    assert rf.load(spark, str(tmp_path), ["WAL"]).count() == 0
    with pytest.raises(Exception, match="labels"):
        rf.load(spark, str(tmp_path), ["WAL"], labels="some").count()


@pytest.mark.parametrize("size", [1, 2, 3, 5, 8, 1000])
@pytest.mark.parametrize("text", [b"h\na\nbb\n\nccc\n", b"h\na\nbb\n\nccc", b"h\n", b"h", b"\n\n", b"h\r\nabc\r\n\r\nd"])
def test_each_line_is_in_one_range(size, text):
    f = io.BytesIO(text)
    _, first = rf.header_of(f)
    got = []
    for start in range(0, max(len(text), 1), size):
        if start + size > first:
            for at, block in rf.blocks_of(f, max(start, first), start + size, size):
                assert text[at : at + len(block)] == block
                got.append((at, block))
    assert b"".join(b for _, b in sorted(got)) == text[first:]
    assert len(got) == len(set(got))


def test_uneven_rows():
    starts, t = rf.table_of(b'1,2\n\n"a,b",4,5\n6\n', ["x", "y"], ["y", "x"])
    assert starts.tolist() == [0, 5, 15] and t.to_pydict() == {"y": ["2", "4", None], "x": ["1", "a,b", "6"]}


def test_windows_of_a_format(spark, root):
    from stridewell.operators import signal

    ship_package(spark)
    w = signal.windows_of_rows(signal.resampled_rows(rf.load(spark, str(root), ["WAL"]), ["code", "subj", "rec"], ["idx"], CHANNELS, 4.0), ["code", "subj", "rec"])
    out = w.collect()
    assert [(r.subj, r.widx, len(r.x), len(r.x[0])) for r in out] == [(8, 0, 6, 50)]
