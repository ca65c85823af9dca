import pytest

from toolloom.plans import end_to_end

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("samples", [lambda s: end_to_end.defect_samples(s, SF)[0], lambda s: end_to_end.transactional_samples(s, SF), lambda s: end_to_end.read_only_samples(s, SF), lambda s: end_to_end.subscribers(s, SF)])
def test_samples_made_of_a_small_file_are_not_one_task(spark, samples):
    assert samples(spark).rdd.getNumPartitions() >= 8
