import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from shieldline.session import local_session
    s = local_session("*", shuffle_partitions=8, app="shieldline-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def pack(spark):
    from shieldline.functions.rules import RulePack
    from shieldline.sources.rules_source import rules_source
    return RulePack.from_df(rules_source(spark))


@pytest.fixture(scope="session")
def screen(spark, pack):
    from shieldline.operators.screen import screen_prompts

    def _screen(texts, **kw):
        df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "prompt_id string, text string")
        kw.setdefault("logged_at", "2024-01-31 00:00:00")
        rows = screen_prompts(df, pack, **kw).collect()
        return sorted(rows, key=lambda r: int(r.prompt_id))
    return _screen
