"""The SQL of the queries gives their rows."""

import math

import duckdb
import pandas as pd
import pytest

from tidewell.llm import oracles, queries, quotes

SF = "/root/testdata/sf0.001"


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return round(v, 5) if isinstance(v, float) else v


def same(df, con, sql):
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    cols = sorted(df.columns)
    ours = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    theirs = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in got.fetchall()), key=repr)
    assert sorted(names) == cols and ours == theirs and ours


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations", "pages", "items", "sale_lines"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    same(queries.QUERIES[name](spark, SF), con, queries.ORACLE[name])


def test_quotation_sql_on_quotes(spark):
    rows = [(1, 0, "user", "Where is the old mill?\nI cannot find it."), (1, 1, "assistant", "> Where is  the old MILL?\nBehind the weir."), (1, 2, "user", ">> Where is the old mill?\n> Behind the weir.\nThanks a lot!"), (1, 3, None, ">> Behind the weir.\n> never said so\nWhich one?"), (2, 0, "user", "")]
    con = duckdb.connect()
    con.register("conversations", pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]))
    df = quotes.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).drop("own")
    same(df, con, oracles.QUOTATION)


def test_quotation_sql_on_generated_conversations(spark):
    """Conversations that quote whole messages, parts, single and short lines, nested and edited."""
    import random

    pick, rows = random.Random(12), []
    for conv in range(60):
        said = []
        for turn in range(pick.randrange(1, 9)):
            quoted = []
            for _ in range(pick.randrange(3) if said else 0):
                lines = pick.choice(said).split("\n")
                a = pick.randrange(len(lines))
                part = lines[a : a + pick.randrange(1, 5)] if pick.random() < 0.6 else lines
                quoted += ["> " * pick.randrange(1, 3) + (x.upper() if pick.random() < 0.3 else x) for x in part] + [""] * pick.randrange(2)
            own = [" ".join(pick.choices(["yes", "no", "why?", "the mill", "is  shut", "since May", "a weir"], k=pick.randrange(1, 4))) for _ in range(pick.randrange(1, 4))]
            said.append("\n".join([*quoted, *own]))
            rows.append((conv, turn, pick.choice(["user", "assistant"]), said[-1]))
    con = duckdb.connect()
    con.register("conversations", pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]))
    df = quotes.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).drop("own")
    assert df.where("reply_to is not null").count() > 60 and df.where("depth > 1").count() > 20
    same(df, con, oracles.QUOTATION)
