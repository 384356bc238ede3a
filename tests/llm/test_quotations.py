import time

from bankspark.llm.quotations import link_quotations, passage_origins

A = "Could you explain how the index works?\nI read the paper twice."
B = "It sorts all suffixes of the text.\n\nThen it keeps samples of them."


def run(spark, rows):
    d = spark.createDataFrame([(*r, 1, "q") for r in rows], "conv_id long, turn long, role string, text string, depth int, own string")
    return sorted((tuple(r) for r in link_quotations(d).collect()), key=repr)


def test_replies_and_threads(spark):
    rows = [
        (1, 0, "user", A),
        (1, 1, "assistant", B),
        (1, 2, "user", "> it SORTS all suffixes of the text.\n>\n> Then it keeps samples of them.\n\nHow many samples?"),
        (1, 3, "assistant", "On Monday the user wrote:\n> > Then it keeps samples of them.\n> How many samples?\nEvery sixteenth."),
        (1, 4, "user", ">I read the paper twice.\nWhich paper was that?"),
        (1, 5, "user", "> never written by anyone here at all\nno link"),
        (1, 6, "user", "no quote"),
        (2, 0, "user", "> Every sixteenth.\nother conversation"),
    ]
    got = run(spark, rows)
    assert [(r[0], r[1], *r[4:]) for r in got] == [
        (1, 0, 0, None, 0, 0), (1, 1, 0, None, 1, 0), (1, 2, 1, 1, 1, 1), (1, 3, 2, 2, 1, 2), (1, 4, 1, 0, 0, 1), (1, 5, 1, None, 5, 0),
        (1, 6, 0, None, 6, 0), (2, 0, 1, None, 0, 0)]
    assert [r[3] for r in got] == [A, B, "How many samples?", "Every sixteenth.", "Which paper was that?", "no link", "no quote", "other conversation"]


def test_long_chain(spark):
    rows = [(7, 0, "user", "message number 0 has words")] + [
        (7, k, "user", f"> message number {k - 1} has words\nmessage number {k} has words") for k in range(1, 40)]
    got = {r[1]: r for r in run(spark, rows)}
    assert all(got[k][5:] == (k - 1, 0, k) for k in range(1, 40))


def test_edges(spark):
    rows = [(None, 0, "user", A), (None, 1, "user", "> " + A.split("\n")[0] + "\nx"), (1, None, "user", "> " + B), (1, 0, None, None), (1, 1, "user", ""),
            (1, 2, "user", ">"), (1, 2, "user", ">"), (1, 3, "user", ">>> only a quote of something"), (1, 4, "user", "x" * 200000), (1, 5, "user", "> " + "x" * 200000 + "\nyes"),
            (1, 5, "user", "> " + "x" * 200000 + "\nyes"), (1, 6, "user", "\n".join(["> deep " + str(i) for i in range(5000)]) + "\nend"), (1, 7, "u", "a > b")]
    got = run(spark, rows)
    assert len(got) == len(rows)
    by = {(r[0], r[1]): r for r in got}
    assert by[(1, 5)][3:] == ("yes", 1, 4, 4, 1) and by[(1, 6)][3:] == ("end", 1, None, 6, 0) and by[(1, 7)][3:5] == ("a > b", 0)
    assert by[(1, 0)][3] is None and by[(1, 2)][3:5] == ("", 1) and by[(1, 3)][3:5] == ("", 1) and by[(1, None)][6] is None
    assert run(spark, []) == []


def test_nested_passages(spark):
    first, second = "How does the index find a phrase?", "It walks the text from the back."
    rows = [
        (1, 0, "user", first), (1, 1, "assistant", second),
        (1, 2, "user", f">> {first}\nonly a nested quotation"),
        (1, 3, "user", f"> never written by anyone here\n>> {second}\n>>> {first}\nthe shallowest that is found"),
        (1, 4, "user", f">> {first}\n> {second}\ndepth one goes first"),
    ]
    got = {r[1]: r for r in run(spark, rows)}
    assert [got[k][5:] for k in (2, 3, 4)] == [(0, 0, 1), (1, 1, 1), (1, 1, 1)]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = sorted((r.turn, r.depth, r.text, r.origin) for r in passage_origins(d).collect() if r.origin is not None)
    assert found == [(2, 2, first, 0), (3, 2, second, 1), (3, 3, first, 0), (4, 1, second, 1), (4, 2, first, 0)]


def test_short_lines(spark):
    rows = [
        (1, 0, "user", "Hello there\nYes, please\nBy Monday would suit me well"),
        (1, 1, "user", "Thanks\nand now something else entirely"),
        (1, 2, "user", "> yes please\none short line of three"),
        (1, 3, "user", "> Hello there\n>\n> Yes, please\nmore short lines"),
        (1, 4, "user", "> By Monday would suit me well\n> Thanks\n> more short lines\na long line goes first"),
        (1, 5, "user", "Yes, please"),
        (1, 6, "user", "> Yes, please\nits whole writer goes first"),
        (1, 7, "user", "> Thanks\n> Hello there\nlatest of equal ones"),
        (1, 8, "user", "> ...\nnothing"),
    ]
    got = {r[1]: r[5] for r in run(spark, rows)}
    assert got == {0: None, 1: None, 2: 0, 3: 0, 4: 0, 5: None, 6: 5, 7: 1, 8: None}


def test_a_megabyte_of_blank_lines(spark):
    n = 1_000_000
    rows = [
        (1, 0, "user", "one line of several words" + "\n" * n + "and another one at the end"), (1, 1, "user", "> one line of several words" + "\n" * n + "x"),
        (1, 2, "user", " " * n + "> and another one at the end\n" + " " * n), (1, 3, "user", "\n" * n), (1, 4, "user", "wrote:  " * (n // 8)),
    ]
    started = time.perf_counter()
    got = run(spark, rows)
    assert time.perf_counter() - started < 90
    assert [r[4:] for r in got] == [(0, None, 0, 0), (1, 0, 0, 1), (1, 0, 0, 1), (0, None, 3, 0), (0, None, 4, 0)]
    assert [r[3] for r in got][1:4] == ["x", "", "\n" * n]
