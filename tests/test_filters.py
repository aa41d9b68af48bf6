import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cairn.plans.filters import Filter, FilterError
from cairn.schema import selected


def parsed(text, strict=True):
    return Filter.parse(text, strict)


def test_tokens():
    f = parsed("-drop_noise -keep_class 2 6 -keep_z_above -1.5 -keep_every_nth 3 -keep_random_fraction 0.5 -keep_voxel 2")
    assert f.predicates == (("drop_noise", ()), ("keep_class", ([2, 6],)), ("keep_z_above", (-1.5,)))
    assert (f.every_nth, f.random_fraction, f.voxel) == (3, 0.5, 2.0)
    assert parsed("") == parsed(None) == Filter()
    assert parsed("-keep_voxel 1 -keep_voxel 5").voxel == 1


@pytest.mark.parametrize("text", ["-keep_class", "-keep_class -keep_first", "-what", "stray", "-keep_z_above x", "-keep_every_nth 0", "-keep_random_fraction 2", "-keep_intensity_above 1.5", "-keep_z_below nan"])
def test_unclear_strings_are_errors(text):
    with pytest.raises(FilterError):
        parsed(text)
    assert parsed(text, strict=False) is not None


@pytest.mark.parametrize("text", ["-keep_voxel -1", "-keep_voxel 0", "-keep_voxel x", "-keep_voxel"])
def test_voxel_sizes_are_positive(text):
    for strict in (True, False):
        with pytest.raises(FilterError, match="positive numeric"):
            parsed(text, strict)


def test_predicates_on_missing_columns_are_passed_over(spark):
    df = spark.createDataFrame([(1.0,), (3.0,)], "Z double")
    assert parsed("-keep_ground -keep_z_above 2").where(df).count() == 1


def test_order_of_tokens_does_not_matter(spark):
    df = spark.createDataFrame([(k % 20, k % 5, float(k)) for k in range(200)], "Classification int, ReturnNumber int, Z double")
    a, b = "-drop_noise -keep_first -keep_z_below 100", "-keep_z_below 100 -keep_first -drop_noise"
    assert parsed(a).where(df).collect() == parsed(b).where(df).collect()


COLUMNS = ["X", "Y", "Z", "Intensity", "Classification", "R", "G", "B", "extra"]


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="xyzicrnapsuRN*?", max_size=6))
def test_select_letters(letters):
    got = selected(letters, COLUMNS)
    assert got[:3] == ["X", "Y", "Z"] and got[-1] == "extra"
    everything = not letters or "*" in letters
    assert ("Intensity" in got) == (everything or "i" in letters)
    assert ("R" in got) == ("B" in got) == (everything or "R" in letters)
    assert got == [c for c in COLUMNS if c in got]
