import pytest

from ashlar.functions.text import ALPHABET
from ashlar.operators import distribution, synth
from ashlar.operators.profile import fit

MEANS, VARIANCES = [1.2, 3.4, 5.6], [7.8, 9.10, 11.12]


def test_moments_and_shape(spark):
    made = synth.generate(spark, 10_000, MEANS, VARIANCES, seed=11, partitions=4)
    assert made.columns == synth.layout(3) and made.count() == 10_000
    for r in synth.verify(made, MEANS, VARIANCES).collect():
        assert abs(r.mean_error) < 4
        assert r.variance == pytest.approx(r.spec_variance, rel=4 * (2 / 10_000) ** 0.5)
    for r in distribution.ks_normal(made, ["num_0", "num_1", "num_2"]).collect():
        assert r.p_value > 0.001


def test_labels(spark):
    rows = synth.generate(spark, 500, MEANS, VARIANCES).collect()
    lengths = set()
    for r in rows:
        assert len(r.label_0) == 13
        lengths |= {len(r.label_1), len(r.label_2)}
        for text in (r.label_0, r.label_1, r.label_2):
            assert set(text) <= set(ALPHABET) and text[0].isalpha()
    assert lengths == set(range(4, 14))
    assert len({r.label_0 for r in rows}) == 500


def test_same_rows_at_any_parallelism(spark):
    sets = [
        sorted(map(tuple, synth.generate(spark, 300, MEANS, VARIANCES, 2, partitions=p).collect())) for p in (1, 4, 16)
    ]
    assert sets[0] == sets[1] == sets[2]


def test_one_column_still_gets_a_number(spark):
    row = synth.generate(spark, 1, [5.0], [0.0]).first()
    assert row.num_0 == 5.0 and len(row.label_0) == 13


def test_types_are_found_again(spark):
    stats = fit(synth.generate(spark, 200, MEANS, VARIANCES))
    assert [s.inferred_type for s in stats.values()] == ["String", "Double"] * 3


def test_specification_is_checked(spark):
    with pytest.raises(ValueError):
        synth.generate(spark, 5, [1.0], [1.0, 2.0])
    with pytest.raises(ValueError):
        synth.check_spec(3, [1.0], [1.0])
    with pytest.raises(ValueError):
        synth.generate(spark, 5, [1.0], [1.0], id_lengths=(5, 4))
    assert synth.split_spec(2, [1.0, 2.0, 3.0, 4.0]) == ([1.0, 2.0], [3.0, 4.0])


def test_long_labels(spark):
    rows = synth.generate(spark, 400, [1.0, 2.0], [1.0, 1.0], id_lengths=(11, 30), label_lengths=(16, 16)).collect()
    assert {len(r.label_0) for r in rows} == set(range(11, 31))
    assert {len(r.label_1) for r in rows} == {16}
    assert len({r.label_0[16:] for r in rows if len(r.label_0) == 30}) > 1
