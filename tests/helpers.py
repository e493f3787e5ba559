"""Plain helpers of the tests; a conftest holds fixtures only, as several folders have one."""

SMALL = "/root/testdata/sf0.001"


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
