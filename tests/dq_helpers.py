"""Helpers shared by the tests outside ``tests/llm`` (never imported from a conftest, whose name is not unique)."""

SF_SMALL = "/root/testdata/sf0.001"


def as_dict(profile_df):
    return {(r["column"], r["metric"]): r["value"] for r in profile_df.collect()}
