"""Hard rows and comparisons shared by the tests of this folder."""

import duckdb

LONG = " ".join(f"w{i % 977}x{i}" for i in range(20000))
HARD = [
    (1, "Alpha beta gamma delta epsilon zeta eta theta.\nAlpha beta gamma delta epsilon zeta eta theta.\nfooter line here", "en", "a"),
    (2, "Alpha beta gamma delta epsilon zeta eta theta.\nAlpha beta gamma delta epsilon zeta eta theta.\nfooter line here", "en", "a"),
    (2, "Alpha beta gamma delta epsilon zeta eta theta.\nAlpha beta gamma delta epsilon zeta eta theta.\nfooter line here", "en", "a"),
    (3, None, "en", "a"), (4, "", None, None), (5, " \n\t ", "en", "b"), (None, "one two three", "en", "b"),
    (7, "one", "en", None), (8, "один два три ÉÀ ß 漢字 'S Σ <|endoftext|> x", "de", "a"), (9, LONG, "en", "a"), (10, LONG + " tail", "en", "a"),
    (11, "footer line here\n\nother", "en", "a"), (12, "the the the the the the", "en", "b"),
]
DOCS = "doc_id long, text string, lang string, source string"


def with_tables(spark, **frames):
    """A DuckDB connection that sees the frames under the names of the given tables."""
    con = duckdb.connect()
    for name, df in frames.items():
        con.register(f"{name}_", df.toArrow())
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM {name}_")
    return con


def same_rows(df, con, sql):
    columns = sorted(df.columns)

    def plain(v):
        return v if v is None or isinstance(v, (str, bool)) else str(v) if isinstance(v, (list, tuple, dict)) else float(v)

    got = sorted(([plain(r[c]) for c in columns] for r in df.collect()), key=repr)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == columns
    assert got == sorted(([plain(r[names.index(c)]) for c in columns] for r in cur.fetchall()), key=repr)
