import csv
import io
import random

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gaugewright.sources import delimited, observations


def plain(text):
    """Header and rows as the csv module has them: short rows filled with None, cells beyond the header dropped."""
    every = [r for r in csv.reader(io.StringIO(text, newline="")) if r]
    names, rows = every[0], every[1:]
    return names, [tuple((r + [None] * len(names))[: len(names)]) for r in rows]


def scanned(spark, path):
    data = observations.read(spark, path)
    rows = data.rows.orderBy(*data.order).collect()
    return data, [tuple(r[f"c{i}"] for i in range(len(data.names))) for r in rows]


def text_of(seed, n=400):
    r = random.Random(seed)
    cell = lambda: r.choice(["", "1.5", "plain", '"a,b"', '"two\nlines"', '"with ""quotes"""', '"three\n\nlong, lines\n"', 'mid"quote', '"open"tail', '"\r\nx"', "é\U0001f600", '"' + "long " * 60 + '\n"'])
    out = ['a,"b\nc",d']
    for _ in range(n):
        out.append(",".join(cell() for _ in range(r.choice((3, 3, 3, 1, 2, 5)))))
        if r.random() < 0.05:
            out.append("")
    return r.choice(("\n", "\r\n")).join(out) + r.choice(("", "\n"))


@pytest.mark.parametrize("seed", range(3))
def test_blocks_cut_within_quotes(spark, tmp_path, seed):
    text = text_of(seed)
    (at := tmp_path / "data.csv").write_text(text, newline="")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("500", "1m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            data, rows = scanned(spark, at)
            assert (data.names, rows) == plain(text), size
            if size == "500":
                assert data.rows.rdd.getNumPartitions() > 15
                last = data.rows.orderBy(*[c.desc() for c in data.order]).limit(1)
                assert list(data.numbered(data.rows, last).values()) == [len(rows) + 1]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_absent_and_empty_cells(spark, tmp_path):
    (at := tmp_path / "data.csv").write_text('a,b\n1,\n2\n"",x,y\n\n3,""\n')
    assert scanned(spark, at)[1] == [("1", ""), ("2", None), ("", "x"), ("3", "")]
    (tmp_path / "empty.csv").write_text("")
    assert observations.read(spark, tmp_path / "empty.csv").names == []
    (tmp_path / "head.csv").write_text("a,b")
    assert scanned(spark, tmp_path / "head.csv")[1] == []
    (tmp_path / "open.csv").write_text('a,b\n1,"never\nclosed')
    assert scanned(spark, tmp_path / "open.csv")[1] == [("1", "never\nclosed")]


def test_folder_of_files(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.csv").write_text(f'a,b\n{i},"x\ny"\n{i},z\n')
    data, rows = scanned(spark, tmp_path)
    assert data.names == ["a", "b"] and rows == [(str(i), c) for i in range(3) for c in ("x\ny", "z")]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet='a,"\r', max_size=8), min_size=1, max_size=6))
def test_states_are_those_of_the_csv_module(lines):
    inside, at = False, 0
    for i, line in enumerate(lines):
        inside = delimited.ends_inside(line, inside)
        if not inside:
            text = "\n".join(lines[at : i + 1]) + "\n"
            # one record more begins here if the text so far is complete
            assert len(list(csv.reader(io.StringIO(text + "mark\n", newline="")))) == len(list(csv.reader(io.StringIO(text, newline="")))) + 1
            at = i + 1
    if inside:
        text = "\n".join(lines[at:]) + "\n"
        assert len(list(csv.reader(io.StringIO(text + "mark\n", newline="")))) == len(list(csv.reader(io.StringIO(text, newline=""))))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet='a,"\ré', max_size=8), min_size=1, max_size=9), st.booleans())
def test_states_of_whole_batches_are_those_of_single_lines(lines, inside):
    found = delimited.Quotes(delimited.Lines.of(pa.array(["x", *lines]).slice(1))).ends(inside)
    for line, ends in zip(lines, found, strict=True):
        inside = delimited.ends_inside(line, inside)
        assert inside == ends


def test_well_formed_lines_are_not_read_letter_by_letter(monkeypatch):
    lines = delimited.Lines.of(pa.array([t for i in range(5000) for t in (f'{i},"""a"",', f'{i}",b')]))
    single, calls = delimited.ends_inside, []
    monkeypatch.setattr(delimited, "ends_inside", lambda *a: calls.append(a) or single(*a))
    quotes = delimited.Quotes(lines)
    assert quotes.ends(False).tolist() == [True, False] * 5000
    assert not calls
    assert quotes.ends(True)[1:].tolist() == quotes.ends(False)[1:].tolist()
    assert len(calls) < 10  # until the wrong state has become the right one


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.text(alphabet='a,"\r\n é\ufeff', max_size=6), min_size=1, max_size=3), min_size=1, max_size=4), st.booleans())
def test_cells_are_those_of_the_csv_module(rows, raw):
    out = io.StringIO(newline="")
    csv.writer(out, lineterminator="\n").writerows(rows)
    text = "".join(",".join(r) + "\n" for r in rows) if raw else out.getvalue()
    inside = False
    for line in text[:-1].split("\n"):
        inside = delimited.ends_inside(line, inside)
    if inside:
        return
    for n in {len(rows[0]), 2}:
        found = [c.to_pylist() for c in delimited.columns(text.encode(), n)]
        every = [r for r in csv.reader(io.StringIO(text, newline="")) if r]
        assert found == [[r[i] if i < len(r) else None for r in every] for i in range(n)]


def test_files_of_one_block_each_need_no_look_at_quotes(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.csv").write_text(f'a,b\n{i},"x\ny"\n{i},"never\nclosed')
    blocks = delimited.scan(spark, str(tmp_path))
    assert [starts for _, _, starts in blocks.files] == [[0]] * 3
    assert delimited._begun_inside(None, blocks) is None  # no line is read
    data, rows = scanned(spark, tmp_path)
    assert rows == [(str(i), c) for i in range(3) for c in ("x\ny", "never\nclosed")]
    assert [r[0] for r in data.rows.select(delimited.FILE).distinct().orderBy(delimited.FILE).collect()] == [0, 1, 2]  # numbers, no paths


def test_first_violations_are_listed_from_the_leading_blocks(spark, tmp_path):
    from gaugewright.operators import validity
    from gaugewright.plans import catalogue

    for i in range(4):
        lines = [f"{i},click,{v},{10 * i + j},{10 * i + j},50" for j, v in enumerate((9, 1, 9) if i else (9, 9, 9))]
        (tmp_path / f"{i}.csv").write_text("\n".join(["user_id,event_type,value,sensor_t,reference_t,force", *lines]) + "\n")
    data, bundle = observations.read(spark, tmp_path), catalogue.events_bundle()
    blocks = validity.summary(validity.row_checks(data, bundle))
    assert [b["invalid"] for b in blocks] == [0, 1, 1, 1] and validity.summed(blocks)["rows"] == 12
    assert validity.leading(data, blocks, 2).rows.count() == 9  # the blocks before the first violation too: rows count from there
    assert validity.leading(data, blocks, 4).rows.count() == 12
    assert [v.row_number for v in validity.evaluate(data, bundle).violations] == [6, 9, 12]
