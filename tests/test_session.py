from types import SimpleNamespace

import pytest

from logtarn.session import work_area


def fake(folder, master):
    conf = SimpleNamespace(get=lambda key, default: folder)
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master))


def test_work_area_lies_in_the_shared_folder():
    first = work_area(fake("s3a://shared/", "yarn"), "x")
    assert first.startswith("s3a://shared/x-")
    assert first != work_area(fake("s3a://shared/", "yarn"), "x")


def test_only_a_local_session_may_use_a_folder_of_its_own():
    assert "/x-" in work_area(fake(None, "local[2]"), "x")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        work_area(fake(None, "yarn"), "x")
