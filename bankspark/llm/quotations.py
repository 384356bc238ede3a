"""Chat formatting by quotation linking, in DataFrame functions only.

Lines that start with ``>`` are quotations, as deep as they have markers. Runs of lines of equal
depth are passages. Quoted passages and their lines are normalised and hashed, and joined to the
messages of the same conversation that first wrote them; a message replies to the writer of what it
quotes at the shallowest depth that has one. Messages lose their quotations and get the thread they belong to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bankspark.session import cut_lineage

MARKS = r"^\s*>[>\s]*"
#: Whether some line has marks; white space is looked at from line ends only, once.
QUOTES = r"(?:^|\n)[ \t\x0B\f\r]*+>"
#: Lines of fewer words say little: what they match ranks after all other matches.
LINE_WORDS = 4
#: Ranks of what is compared: short lines, long lines, whole passages.
SHORT, LONG, WHOLE = 0, 1, 2


def normalised(text: Column) -> Column:
    """Lower case, letters and digits only, single spaces."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def _hash(text: Column) -> Column:
    return F.sha2(normalised(text), 256)


def passages(messages: DataFrame) -> DataFrame:
    """(message, run, depth, text) per run of lines of equal quote depth of each quoting message.

    ``messages``: (message, text). An attribution line ("... wrote:") directly before a quotation is
    dropped. Lines are compared within their own message only.
    """
    lines = messages.select("message", F.posexplode(F.split("text", r"\r?\n", -1)).alias("line", "raw"))
    marked = lines.select(
        "message", "line", F.length(F.regexp_replace(F.regexp_extract("raw", MARKS, 0), "[^>]", "")).alias("depth"),
        F.regexp_replace("raw", MARKS, "").alias("raw"),
    )
    order = Window.partitionBy("message").orderBy("line")
    stepped = (
        marked.withColumn("next", F.lead("depth").over(order))
        .where(~((F.coalesce("next", F.lit(0)) > F.col("depth")) & F.col("raw").rlike(r"(?i)\bwrote:\s*$")))
        .withColumn("run", F.sum(F.when(F.col("depth") == F.lag("depth").over(order), 0).otherwise(1)).over(order))
    )
    return stepped.groupBy("message", "run", "depth").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "raw"))), lambda x: x["raw"]), "\n").alias("text")
    )


def _units(rows: DataFrame) -> DataFrame:
    """``rows`` exploded to (hash, rank): the passage itself and each of its lines that is not blank."""
    unit = lambda text, rank: F.struct(_hash(text).alias("hash"), rank.alias("rank"))
    whole = F.filter(F.array("body"), lambda x: normalised(x) != "")
    lines = F.filter(F.split("body", "\n", -1), lambda x: normalised(x) != "")
    rank = lambda x: F.when(F.size(F.split(normalised(x), " ")) >= LINE_WORDS, LONG).otherwise(SHORT)
    units = F.concat(F.transform(whole, lambda x: unit(x, F.lit(WHOLE))), F.transform(lines, lambda x: unit(x, rank(x))))
    return rows.withColumn("unit", F.explode(units))


def link_quotations(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, n_quoted, reply_to, root_turn, depth) per row of ``messages``.

    ``text`` has no quotations (null stays null); ``n_quoted`` counts quoted passages; ``reply_to`` is
    the turn, earlier in the same conversation, that first wrote what the message quotes, at the
    shallowest depth where there is one: the writer of a whole passage goes first, then of most long
    lines, then of most lines under ``LINE_WORDS`` words, then the latest; null if there is none at
    any depth. ``root_turn`` is where following
    ``reply_to`` ends (the turn itself without one), ``depth`` the number of steps. Conversations are read in the order (conv_id, root_turn, turn).
    Messages without conversation or turn are never linked. Equal rows are returned as often as they
    occur; other rows with the same conversation and turn count as one turn, whose reply is the
    earliest of theirs. Other columns are ignored; an empty table gives an empty result.
    """
    keyed, quotes, quoting, runs, own = _parts(messages)
    quoted = runs.where("depth > 0").groupBy("message").agg(F.count("*").alias("n_quoted"))
    threads = _follow(cut_lineage(
        _origins(keyed, quotes, quoting, runs, own, "message", "depth")
        .groupBy("conv_id", "turn", "message").agg(F.min(F.struct("depth", "origin")).alias("first"))
        .groupBy("conv_id", "turn").agg(F.min("first.origin").alias("reply_to"))
    ))

    return (
        keyed.join(own, "message", "left").join(quoted, "message", "left").join(threads, ["conv_id", "turn"], "left").select(
            "conv_id", "turn", "role",
            F.when(F.col("n_quoted") > 0, F.coalesce("own", F.lit(""))).otherwise(F.col("text")).alias("text"),
            F.coalesce("n_quoted", F.lit(0).cast("long")).alias("n_quoted"), "reply_to",
            F.coalesce("root_turn", "turn").alias("root_turn"), F.coalesce("depth", F.lit(0).cast("long")).alias("depth"),
        )
    )


def passage_origins(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, run, depth, text, origin) per quoted passage of ``messages``, however deep.

    ``origin`` is the turn that first wrote the passage, found as in ``link_quotations``; null if
    there is none. Equal messages count once.
    """
    keyed, quotes, quoting, runs, own = _parts(messages)
    found = _origins(keyed, quotes, quoting, runs, own, "message", "run").select("message", "run", "origin")
    return runs.where("depth > 0").join(found, ["message", "run"], "left").select("conv_id", "turn", "run", "depth", "text", "origin")


def _parts(messages: DataFrame) -> tuple[DataFrame, Column, DataFrame, DataFrame, DataFrame]:
    """Messages with their key, which of them quote, these once each, their runs, and their own text."""
    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), "text")
    keyed = rows.withColumn("message", F.sha2(F.concat_ws("|", F.coalesce(F.col("conv_id").cast("string"), F.lit("-")), F.coalesce(F.col("turn").cast("string"), F.lit("-")), F.col("text")), 256))
    quotes = F.coalesce(F.col("text").rlike(QUOTES), F.lit(False))
    quoting = keyed.where(quotes).select("message", "conv_id", "turn", "text").dropDuplicates(["message"])
    runs = cut_lineage(passages(quoting.select("message", "text")).join(quoting.select("message", "conv_id", "turn"), "message"))
    own = runs.where("depth = 0").groupBy("message").agg(
        F.btrim(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run", "text"))), lambda x: x["text"]), "\n"), F.lit(" \t\n\x0b\f\r")
        ).alias("own")
    )
    return keyed, quotes, quoting, runs, own


def _origins(keyed: DataFrame, quotes: Column, quoting: DataFrame, runs: DataFrame, own: DataFrame, *unit: str) -> DataFrame:
    """(conv_id, turn, *unit, origin): who first wrote what is quoted in each ``unit`` of columns of ``runs``."""
    # Who first wrote what: message bodies, their runs of own lines, and all their lines.
    there = "conv_id is not null and turn is not null"
    asked = cut_lineage(
        _units(runs.where(f"depth > 0 and {there}").select("conv_id", "turn", *unit, F.col("text").alias("body")))
        .select("conv_id", "turn", *unit, "unit.hash", "unit.rank").distinct()
    )
    bodies = keyed.where(there).where(~quotes & F.col("text").isNotNull()).select("conv_id", "turn", F.col("text").alias("body"))
    bodies = bodies.join(asked.select("conv_id").distinct(), "conv_id", "left_semi")
    bodies = bodies.unionByName(runs.where(f"depth = 0 and {there}").select("conv_id", "turn", F.col("text").alias("body")))
    bodies = bodies.unionByName(own.join(quoting.where(there), "message").select("conv_id", "turn", F.col("own").alias("body")))
    written = _units(bodies).select("conv_id", "turn", "unit.hash", "unit.rank").groupBy("conv_id", "hash").agg(
        F.min(F.when(F.col("rank") > SHORT, F.col("turn"))).alias("origin"), F.min(F.when(F.col("rank") == SHORT, F.col("turn"))).alias("short")
    )
    match = lambda origin, rank: F.struct(origin.alias("origin"), rank.alias("rank"))
    found = (
        asked.join(written, ["conv_id", "hash"])
        .withColumn("match", F.explode(F.array(
            match(F.when(F.col("rank") > SHORT, F.col("origin")).otherwise(F.least("origin", "short")), F.col("rank")),
            match(F.when(F.col("rank") == WHOLE, F.col("short")), F.lit(SHORT)),
        )))
        .select("conv_id", "turn", *unit, "hash", "match.origin", "match.rank").where("origin < turn").distinct()
    )
    best = F.struct("whole", "long_lines", "short_lines", "origin")
    return (
        found.groupBy("conv_id", "turn", *unit, "origin").agg(
            F.max(F.col("rank") == WHOLE).alias("whole"), F.count_if(F.col("rank") > SHORT).alias("long_lines"),
            F.count_if(F.col("rank") == SHORT).alias("short_lines"),
        )
        .groupBy("conv_id", "turn", *unit).agg(F.max(best).alias("best"))
        .select("conv_id", "turn", *unit, "best.origin")
    )


def _follow(replies: DataFrame) -> DataFrame:
    """(conv_id, turn, reply_to, root_turn, depth): each pass doubles the steps that are followed."""
    state = replies.select("conv_id", "turn", "reply_to", F.col("reply_to").alias("root_turn"), F.lit(1).cast("long").alias("depth"))
    while True:
        further = state.select("conv_id", F.col("turn").alias("root_turn"), F.col("root_turn").alias("next"), F.col("depth").alias("more"))
        joined = cut_lineage(state.join(further, ["conv_id", "root_turn"], "left"))
        state = joined.select("conv_id", "turn", "reply_to", F.coalesce("next", "root_turn").alias("root_turn"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"))
        if joined.where("next is not null").isEmpty():
            return state
