import pyarrow as pa
import pytest

from veldra.operators.packed import split_packed, term_pattern, value_lists

TERMS = ["fish & chips", "mac and cheese", "salt, pepper, lime", "farm - to - fork", "hot|cold", "grandma's kitchen", "soup; salad; bar", "half + half", "pan y vino", "tex-mex", "soup"]
CASES = {
    "": [], " ": [], "-": [], ";": [], "[]": [], '""': [], ", ,": [], "pizza": ["pizza"], "sushi;;thai": ["sushi", "thai"], '"peruvian ""old town"" style"': ['peruvian "old town" style'],
    'vegan, "sushi ""old town"" style"': ["vegan", 'sushi "old town" style'], '"burger ""deluxe"""': ['burger "deluxe"'], "half \\+ half + sushi": ["half + half", "sushi"], "grandma's kitchen;x": ["grandma's kitchen", "x"],
    "'grandma''s kitchen','y'": ["grandma's kitchen", "y"], "tex-mex; pan - asian": ["tex-mex", "pan", "asian"], "farm - to - fork - Sushi": ["farm - to - fork", "Sushi"], "FISH & CHIPS & thai": ["FISH & CHIPS", "thai"],
    '["a, b", "c"]': ["a, b", "c"], '{x,"dim sum"}': ["x", "dim sum"], "a, b, and c": ["a", "b", "c"], "sandy y andy": ["sandy", "andy"], '"pizza, sushi': ['"pizza', "sushi"], "麺、寿司，x；y・z": ["麺", "寿司", "x", "y", "z"],
    "a \nb\r\nc": ["a", "b", "c"], '"麺; mild"': ["麺; mild"], "a\\": ["a\\"], "salt\\, pepper\\, lime、dim sum": ["salt, pepper, lime", "dim sum"], '"grandma\'s kitchen" und z': ["grandma's kitchen", "z"], "L'Ami; d'Or": ["L'Ami", "d'Or"],
    '"a"," "': ["a"], "soup; salad; bar; x": ["soup; salad; bar", "x"], 'tapas\t"hot|cold"\n"a;b"': ["tapas", "hot|cold", "a;b"], "a;a;a": ["a", "a", "a"], "x et y": ["x", "y"],
}


@pytest.mark.parametrize("field", CASES)
def test_values(field):
    assert value_lists(pa.array([field]), term_pattern(TERMS)).to_pylist() == [CASES[field]]


def test_rows_do_not_touch():
    """The result of a row does not depend on its neighbours."""
    fields = [*CASES, *reversed(CASES)]
    assert value_lists(pa.array(fields), term_pattern(TERMS)).to_pylist() == [CASES[f] for f in fields]


def test_long_field_and_no_terms():
    assert value_lists(pa.array(["ab;" * 50_000])).to_pylist() == [["ab"] * 50_000]


def test_operator(spark):
    rows = [(1, "b; a", "x"), (2, None, "x"), (1, "b; a", "x"), (None, "c", None), (3, "", "y")]
    df = spark.createDataFrame(rows, "rec_id bigint, cuisine string, pos string")
    terms = spark.createDataFrame([(None,), ("a, b",)], "term string")
    got = sorted(map(tuple, split_packed(df, terms).collect()), key=str)
    assert got == sorted([(1, 0, "b"), (1, 1, "a")] * 2 + [(None, 0, "c")], key=str)
    empty = split_packed(df.limit(0), terms.limit(0))
    assert empty.columns == ["rec_id", "pos", "cuisine_value"] and empty.count() == 0
