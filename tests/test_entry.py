import re

import __spark_entry__ as E


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() >= 0 and "browse_delay" in df.columns


def test_query_keys_follow_ids():
    for k in E.queries():
        assert k[0] in "spjawofetukmgln" and k[1:3].isdigit() or re.match(r"op\d+_\w+$|pipeline$", k)
