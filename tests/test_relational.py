import io

import pytest

from tessella.errors import TypeMismatch, UnknownColumn
from tessella.operators import relational, text_sink
from tessella.operators.frame import CHAR, INT_MIN, INTEGER, Cursor, Frame, Register


@pytest.fixture
def left(spark):
    return Frame.of(spark.createDataFrame([(0, "", 1), (1, "x", 2), (1, "y", 3)], "id int, name string, n int"))


@pytest.fixture
def right(spark):
    return Frame.of(spark.createDataFrame([(1, "p", 1), (1, "q", 2), (9, "r", 3)], "id bigint, name string, ref int"))


def rows(frame):
    return sorted(frame.rows())


def test_join_keeps_duplicates_and_left_key(left, right):
    joined = relational.hash_join(left, right, "id", "id")
    assert joined.names == ("id", "name", "n", "name", "ref")
    assert len(rows(joined)) == 4
    assert joined.to_df().columns == ["id", "name", "n", "name", "ref"]


def test_join_with_other_key_name_keeps_clashing_columns(left, right):
    joined = relational.hash_join(left, right, "n", "ref")
    assert joined.names == ("id", "name", "n", "id", "name")
    assert rows(joined)[0] == (0, "", 1, 1, "p")


def test_empty_probe_side_gives_nothing(left, right):
    nothing = relational.select_equal(right, "name", "absent")
    assert rows(relational.hash_join(left, nothing, "id", "id")) == []
    empty = Frame(right.df.limit(0), right.names)
    assert rows(relational.hash_join(left, empty, "id", "id")) == []
    assert rows(relational.hash_join(left, empty, "name", "name")) == []


def test_build_side_can_be_asked_for(left, right):
    joined = relational.hash_join(left, right, "id", "id", build="left")
    assert len(rows(joined)) == 4


def test_types_are_checked_before_running(left, right):
    with pytest.raises(TypeMismatch):
        relational.select_equal(left, "id", "1")
    with pytest.raises(TypeMismatch):
        relational.select_equal(left, "name", 1)
    with pytest.raises(TypeMismatch):
        relational.select_equal(left, "id", True)
    with pytest.raises(TypeMismatch):
        relational.hash_join(left, right, "id", "name")
    with pytest.raises(UnknownColumn):
        relational.select_equal(left, "nope", 1)
    with pytest.raises(UnknownColumn):
        relational.hash_join(left, right, "nope", "id")


def test_strings_are_not_padded(spark):
    frame = Frame.of(spark.createDataFrame([("ab",), ("ab  ",), ("AB",)], "s string"))
    assert rows(relational.select_equal(frame, "s", "ab")) == [("ab",)]


def test_unsigned_constants_are_narrowed(spark):
    frame = Frame.of(spark.createDataFrame([(-1,), (1,)], "v int"))
    assert rows(relational.select_equal(frame, "v", 2**32 - 1)) == [(-1,)]
    wide = Frame.of(spark.createDataFrame([(-1,), (2**32 - 1,)], "v bigint"))
    assert rows(relational.select_equal(wide, "v", 2**32 - 1)) == [(2**32 - 1,)]


def test_projection_by_position_and_name(left, right):
    assert rows(relational.project_positions(left, [2, 0, 2]))[0] == (1, 0, 1)
    with pytest.raises(UnknownColumn):
        relational.project_positions(left, [3])
    joined = relational.hash_join(left, right, "id", "id")
    both = relational.project_names(joined, ["name", "id"])
    assert both.names == ("name", "name", "id")
    with pytest.raises(UnknownColumn):
        relational.project_names(left, ["id", "nope"])
    assert relational.project_names(left, ["nope", "id"], strict=False).names == ("id",)


def test_first_column_of_a_name_is_filtered(left, right):
    joined = relational.hash_join(left, right, "id", "id")
    assert {r[1] for r in relational.select_equal(joined, "name", "x").rows()} == {"x"}


def test_print_separates_repeated_columns(left):
    out = io.StringIO()
    frame = relational.project_positions(left, [0, 1, 0])
    assert text_sink.print_text(frame, out) is frame
    assert out.getvalue().splitlines() == ["id, name, id", "0, , 0", "1, x, 1", "1, y, 1"]


def test_cursor_and_registers(left):
    cursor = Cursor(left)
    cursor.open()
    assert cursor.next()
    first = cursor.output()
    assert [r.name for r in first] == ["id", "name", "n"]
    assert first[0].integer == 0 and first[0].string == ""
    assert first[1].integer == INT_MIN and first[1].tag == CHAR
    while cursor.next():
        pass
    assert not cursor.next()
    cursor.close()
    assert Register("a", INTEGER, 1) == Register("b", INTEGER, 1) != Register("a", CHAR, "1")
    with pytest.raises(RuntimeError):
        cursor.next()


def test_columns_equal(left):
    assert [r.equal for r in relational.columns_equal(left, "id", "n").collect()] == [False, False, False]
    assert [r.equal for r in relational.columns_equal(left, "id", "name").collect()] == [False, False, False]


def test_nulls_in_every_operator(spark):
    """Never selected or joined, always kept by scans and projections, empty in the text sink."""
    frame = Frame.of(spark.createDataFrame([(None, "x", None), (1, None, 1), (1, "x", 2), (None, None, None)], "id int, name string, n int"))
    assert len(list(relational.select_equal(frame, "id", 1).rows())) == 2
    assert len(list(relational.select_equal(frame, "name", "x").rows())) == 2 and len(rows(relational.select_equal(frame, "name", ""))) == 0
    assert sorted(map(str, relational.project_positions(frame, [0, 0]).rows())) == ["(1, 1)", "(1, 1)", "(None, None)", "(None, None)"]
    assert len(list(relational.hash_join(frame, frame, "id", "id").rows())) == 4
    assert len(list(relational.hash_join(frame, frame, "name", "name").rows())) == 4
    assert sorted(str(r.equal) for r in relational.columns_equal(frame, "id", "n").collect()) == ["False", "None", "None", "True"]
    assert sorted(r.line for r in text_sink.lines(frame).collect()) == [", , ", ", x, ", "1, , 1", "1, x, 2"]
    cursor = Cursor(relational.select_equal(frame, "n", 1))
    cursor.open()
    assert cursor.next() and cursor.output()[1].value is None
    empty = Frame(frame.df.limit(0), frame.names)
    assert rows(relational.select_equal(empty, "id", 1)) == rows(relational.hash_join(empty, frame, "id", "id")) == rows(relational.project_names(empty, ["n"])) == []
