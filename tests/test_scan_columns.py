"""The scan of stretches reads its columns through arrays."""
import pyarrow as pa

from gazeloom.operators.segmentation import _peaks, _values

PEAK = pa.list_(pa.struct([("frame", pa.int32()), ("ft", pa.float64()), ("gap", pa.float64())]))


def test_peaks_of_whole_and_sliced_batches():
    rows = [[], [(3, 0.5, None)], [(4, 0.25, 0.1), (5, 0.75, -0.5)], [], [(9, 1.0, 0.0)]]
    column = pa.array([[dict(zip(("frame", "ft", "gap"), p)) for p in row] for row in rows], PEAK)
    assert list(_peaks(column)) == rows
    assert list(_peaks(column.slice(2, 2))) == rows[2:4]
    assert list(_peaks(column.slice(4))) == rows[4:]
    assert list(_peaks(pa.array([[], []], PEAK))) == [[], []]


def test_values_with_and_without_nulls():
    for values, kind in (([3, 1, 2], pa.int64()), ([1, None, 3], pa.int64()), (["a", None, "b", "a"], pa.string()), ([None, None], pa.string()), ([1.5, None], pa.float64())):
        column = pa.array(values, kind)
        assert _values(column) == values and _values(column.slice(1)) == values[1:]
