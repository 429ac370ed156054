"""Shared by the tests."""


def compare(df, con, sql):
    """Whole results, order aside."""
    columns = sorted(df.columns)
    rel = con.sql(sql)
    assert sorted(rel.columns) == columns
    got = sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
    want = sorted(con.sql(f"select {', '.join(columns)} from ({sql.strip()})").fetchall(), key=repr)
    assert got == want
    return len(got)
