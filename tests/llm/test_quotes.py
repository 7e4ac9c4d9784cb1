"""Quotation linking on hand-made conversations and against a plain restatement."""

import random
import re

from pyspark.sql import functions as F

from tidewell.llm import quotes, queries

SF = "/root/testdata/sf0.01"
FIELDS = ("conv_id", "turn", "n_quotes", "deepest", "reply_to", "thread", "depth", "own")


def brute(rows):
    norm = lambda t: " ".join(t.lower().split())
    cut = []
    for conv, turn, role, text in rows:
        lines = []
        for x in (text or "").split("\n"):
            m = re.match(r"((?:[ \t]*>)+)[ \t]?", x)
            lines.append((m[1].count(">"), x[m.end() :]) if m else (0, x))
        runs = []
        for level, x in lines:
            if runs and runs[-1][0] == level:
                runs[-1][1].append(x)
            else:
                runs.append((level, [x]))
        cut.append((conv, turn, "\n".join(x for level, x in lines if not level), [r for r in runs if r[0]]))
    first = {}
    for conv, turn, own, _ in cut:
        if conv is not None and turn is not None:
            for k in {norm(own), *map(norm, own.split("\n"))}:
                if len(k) >= 8:
                    first[conv, k] = min(first.get((conv, k), turn), turn)
    parent = {}
    for conv, turn, _, runs in cut:
        for level, xs in runs:
            for rank, k in enumerate((norm("\n".join(xs)), norm(next((x for x in xs if x.strip()), "")))):
                at = first.get((conv, k))
                if conv is not None and turn is not None and len(k) >= 8 and at is not None and at < turn:
                    parent[conv, turn] = min(parent.get((conv, turn), (99,)), (level, rank, -at))
    out = []
    for conv, turn, own, runs in cut:
        thread, depth = turn, 0
        while (conv, thread) in parent:
            thread, depth = -parent[conv, thread][2], depth + 1
        own_parent = -parent[conv, turn][2] if (conv, turn) in parent else None
        out.append((conv, turn, len(runs), max([r[0] for r in runs], default=0), own_parent, thread, depth, own))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r[f] for f in FIELDS) for r in df.collect()), key=repr)


def test_nested_quotes(spark):
    rows = [
        (1, 0, "user", "Where is the old mill?\nI cannot find it."),
        (1, 1, "assistant", "> Where is  the old MILL?\nBehind the weir."),
        (1, 2, "user", ">> Where is the old mill?\n> Behind the weir.\nThanks a lot!\n\n> I cannot find it.\nFound."),
        (1, 3, "user", ">> Behind the weir.\n> never said so\nWhich one?"),
        (1, 4, "assistant", "No quotes here, just text."),
        (2, 1, "user", "> Where is the old mill?\nother conversation"),
        (2, 0, None, None), (2, None, "user", "> something"), (None, 5, "user", "> Behind the weir."), (3, 0, "user", ">"), (3, 1, "user", ""), (1, 2, "user", "a second row of turn two"),
    ]
    df = quotes.link(spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, level string"))
    assert got(df) == brute(rows)
    by = {(r.conv_id, r.turn, r.n_quotes): r for r in df.collect()}
    assert by[1, 1, 1].reply_to == 0 and by[1, 2, 3].reply_to == 1 and by[1, 2, 3].depth == 2 and by[1, 3, 2].reply_to == 1
    assert by[1, 2, 3].message == "<|user|>\nThanks a lot!\n\nFound.<|end|>\n"


def test_random_conversations(spark):
    pick, rows = random.Random(12), []
    for conv in range(12):
        said = []
        for turn in range(25):
            own = [f"{pick.choice(['Stone', 'water', 'WEIR'])} number {pick.randrange(40)} " + "long words " * pick.randrange(3) for _ in range(pick.randrange(1, 4))]
            lines = []
            for _ in range(pick.randrange(3)):
                if said:
                    lines += ["> " + x for x in pick.choice(said)]
                lines += [pick.choice(own)]
            rows.append((conv, turn, "user", "\n".join(lines + own)))
            said.append(lines + own)
    assert got(quotes.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))) == brute(rows)


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    df = queries.op8_quotation_linking(spark, SF)
    assert df.count() == len(rows) and got(quotes.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))) == brute(rows)
    assert quotes.link(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_parts_of_messages(spark):
    rows = [
        (1, 0, "user", "Good morning,\nnothing new\nhere"), (1, 1, "user", "Good morning,\nthe mill is shut\nsince last May\nas they say"),
        (1, 2, "user", "> Good morning,\n> the mill is shut\n> since last May\nreally?"), (1, 3, "user", "> somebody wrote:\n> the mill is shut\n> since last May\nso it is"), (1, 4, "user", "> somebody wrote:\n> never said so\nwho?"), (1, 5, "user", "> since last May\n> since last May\ntwice"),
    ]
    by = {r.turn: r.reply_to for r in quotes.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert by == {0: None, 1: None, 2: 1, 3: 1, 4: None, 5: 1}


def test_short_messages(spark):
    rows = [(1, 0, "user", "Why?"), (1, 1, "user", "今天天气很好。"), (1, 2, "user", "> Why?\nWho knows."), (1, 3, "user", "> 今天天气很好。\nno"), (1, 4, "user", "> \n>\nnothing quoted")]
    by = {r.turn: r.reply_to for r in quotes.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert by == {0: None, 1: None, 2: 0, 3: 1, 4: None}


def test_longest_stretch_wins(spark):
    rows = [
        (1, 0, "user", "Thanks\nthe bridge"), (1, 1, "user", "the mill\nwas old"), (1, 2, "user", "Thanks\nthe mill\n\nwas old\nand shut\nthe bridge"),
        (1, 3, "user", "> Thanks\n> the mill\n> was old\n> and shut (edited)\nyes"), (1, 4, "user", "> and shut\n> the bridge\n> is new\nno"), (1, 5, "user", "> is new\n> the bridge\nno"),
    ]
    by = {r.turn: r.reply_to for r in quotes.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert by == {0: None, 1: None, 2: None, 3: 2, 4: 2, 5: 0}


def test_hot_line_in_one_conversation(spark):
    """Every message has the line that every second one quotes with an edited line: no pairs of messages are made."""
    n = 20_000
    text = F.when(F.col("id") % 2 == 0, F.concat(F.lit("Thanks\nnote "), F.col("id").cast("string"))).otherwise(F.concat(F.lit("> Thanks\n> edited "), F.col("id").cast("string"), F.lit("\nThanks")))
    out = quotes.link(spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), text.alias("text")))
    assert out.where("reply_to = 0 and depth = 1 and thread = 0").count() == n // 2 and out.where("reply_to is null").count() == n // 2


def test_attributions_and_positions(spark):
    rows = [
        (1, 0, "a", "Where is it?\nWe wrote:"), (1, 1, "b", "On Monday Ann wrote:\n> Where is it?\n> We wrote:\nHere.\nHe wrote:\nnothing"), (1, 2, "c", "Something else."),
        (1, 3, "a", "Ann schrieb : \n>> Where is it?\n> Here.\n> He wrote:\n> nothing\nThanks"), (1, 3, "d", "twice"), (1, None, "e", "none"), (None, 4, "f", "none"), (2, 0, "a", "Ann wrote:"),
    ]
    got = {(r.conv_id, r.turn, r.role): (r.own, r.position, r.thread) for r in quotes.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {
        (1, 0, "a"): ("Where is it?\nWe wrote:", 1, 0), (1, 1, "b"): ("Here.\nHe wrote:\nnothing", 2, 0), (1, 3, "a"): ("Thanks", 3, 0), (1, 3, "d"): ("twice", 3, 0), (1, 2, "c"): ("Something else.", 5, 2),
        (1, None, "e"): ("none", None, None), (None, 4, "f"): ("none", None, 4), (2, 0, "a"): ("Ann wrote:", 1, 0),
    }


def test_the_query_links_at_every_level(spark):
    from tidewell.llm import queries

    rows = queries.op8_quotation_linking(spark, "/root/testdata/sf0.001").collect()
    assert {r.deepest for r in rows} == {0, 1, 2} and max(r.depth for r in rows) > 3
    linked = [r for r in rows if r.reply_to is not None]
    assert len(linked) > 0.6 * len(rows) and {r.turn % 3 for r in linked} == {0, 1, 2} and not any("somebody wrote" in r.message for r in rows)
