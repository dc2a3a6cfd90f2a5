import pytest

from lossgrid.sources.settings import settings


def test_paths():
    s = settings("s3://b/root/", {"policies": "p", "matrix": " "}, {"LOSSGRID_POLICIES": "/no", "LOSSGRID_MATRIX": "file:///m.json", "LOSSGRID_INDEX": " "})
    assert (s.path("policies"), s.path("matrix"), s.path("index"), s.path("triage")) == ("s3://b/root/p", "file:///m.json", "s3://b/root/index", "s3://b/root/output/triage")
    assert s.of_claim("intake", "F-1") == "s3://b/root/output/intake/F-1"
    with pytest.raises(KeyError):
        s.path("other")
