"""Tail probabilities against tabulated values."""

import math

import pytest

from kithmesh.functions import dist


@pytest.mark.parametrize(
    "got,want",
    [
        (dist.chi2_sf(3.841458820694124, 1), 0.05),
        (dist.chi2_sf(18.307038053275146, 10), 0.05),
        (dist.t_sf(2.2281388519649385, 10), 0.025),
        (dist.t_sf(-1.0, 1), 0.75),
        (dist.f_sf(4.102821015, 2, 10), 0.05),
        (dist.normal_cdf(1.959963984540054), 0.975),
        (dist.normal_quantile(0.975), 1.959963984540054),
        (dist.signed_rank_sf(15, 5), 1 / 32),
        (dist.signed_rank_sf(0, 5), 1.0),
    ],
)
def test_tails(got, want):
    assert math.isclose(got, want, rel_tol=1e-7)
