r"""Chat formatting (5): quotation linking.

Method: the lines of a message are parsed for quote marks (``>``, nested by
repetition).  Runs of lines of one level are passages; a line such as ``On ... wrote:``
before a deeper level is that passage's attribution and goes with it.  Passages and every
message's own words are cut in wholes, paragraphs and lines (blank ones are left out),
normalised (lower case, blanks collapsed) and hashed; a passage links by its whole, else
by its paragraphs, else by its lines, to a message with a whole, paragraph or line of that
hash: one of the same conversation before it if there is any, else the first such message
of another conversation.  Where pieces of a passage lead to several messages, the one with
most of its characters is taken, then the latest (in the corpus: the first).  A message
replies to the message that its first linked level-1 passage quotes.  Without a link it replies to the previous turn.  Reply chains are
followed by pointer doubling, and each conversation is returned in reply order:
thread by thread (``root_turn``), by depth, then by turn (``position`` counts from 1), with quotes removed.

A piece offers one message: the nearest earlier one of its conversation that has it, found by a
merge of the hash's messages and quotes in turn order, else the corpus's first one elsewhere.
So a passage that is said and quoted very often costs its rows, never their pairs.  Turns are
merged, numbered and chained over range partitions (``carried``), which split a conversation
or a hash that holds a third of all rows.

Defined cases: a null text has no lines; a message that is only quotes has an empty body;
a message never links to itself or to a later turn of its conversation; turns may have gaps:
the previous turn is the next smaller one that is there; very long texts are parsed whole; a turn that is
given twice counts once (the text that sorts first; the other rows are returned with the same links);
a null conv_id or turn gives no links and no position; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, carried, documents

ATTRIBUTION = r"(?i)^\s*(on\b.*\bwrote|.{1,80}\bwrote|.{1,80}\bsaid)\s*:\s*$"
MARKS = r"^((?:[ \t]*>)+)[ \t]?"


def lines_of(text: Column) -> Column:
    """array<struct<level, line>> of a text."""
    def parse(line: Column) -> Column:
        marks = F.regexp_extract(line, MARKS, 1)
        return F.struct(F.length(F.regexp_replace(marks, "[^>]", "")).alias("level"), F.regexp_replace(line, MARKS, "").alias("line"))

    return F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|\r|\n"), parse)


def normalise(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def pieces(text: Column) -> Column:
    """array<struct<grain, size, h>>: hashes of the whole (0), each paragraph (1) and each line (2) that isn't blank."""
    def cut(parts: Column, grain: int) -> Column:
        plain = F.array_distinct(F.filter(F.transform(parts, normalise), lambda x: x != ""))
        return F.transform(plain, lambda x: F.struct(F.lit(grain).alias("grain"), F.length(x).cast("long").alias("size"),
                                                     F.unhex(F.sha2(x.cast("binary"), 256)).alias("h")))

    return F.concat(cut(F.array(text), 0), cut(F.split(text, "\n[ \t]*\n"), 1), cut(F.split(text, "\n"), 2))


def parse_messages(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                   text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, body, passages): passages are array<struct<level, text>>."""
    rows = messages.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
                           F.col(role_col).alias("role"), lines_of(F.col(text_col)).alias("lines"))
    n = F.size("lines")

    def attribution(x: Column, i: Column) -> Column:
        return (i + 1 < n) & F.coalesce(F.get("lines", i + 1)["level"] > x["level"], F.lit(False)) & x["line"].rlike(ATTRIBUTION)

    def own(x: Column, i: Column) -> Column:
        return (x["level"] == 0) & ~attribution(x, i)

    body = F.regexp_replace(F.array_join(F.transform(F.filter("lines", own), lambda x: x["line"]), "\n"), r"^\s+|\s+$", "")
    said = F.filter("lines", lambda x, i: (x["level"] == 0) | ~attribution(x, i))
    rows = rows.select("conv_id", "turn", "role", body.alias("body"), F.when(F.exists("lines", lambda x: x["level"] > 0), said).alias("said"))
    # runs of one level, by the places where it changes
    size = F.size("said")
    level = F.transform("said", lambda x: x["level"])
    rows = rows.select("conv_id", "turn", "role", "body", "said", level.alias("level"))
    edges = F.filter(F.sequence(F.lit(0), size), lambda i: (i == 0) | (i == size) | (F.get("level", i) != F.get("level", i - 1)))
    rows = rows.select("conv_id", "turn", "role", "body", "said", "level", F.when(size > 0, edges).alias("edges"))

    def run(start: Column, i: Column) -> Column:
        lines = F.slice("said", start + 1, F.get("edges", i + 1) - start)
        return F.struct(F.get("level", start).alias("level"), F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("text"))

    runs = F.transform(F.slice("edges", F.lit(1), F.greatest(F.size("edges") - 1, F.lit(0))), run)
    none = F.expr("cast(array() as array<struct<level:int,text:string>>)")
    return rows.select("conv_id", "turn", "role", "body", F.coalesce(F.filter(runs, lambda x: x["level"] > 0), none).alias("passages"))


def link_quotes(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                text_col: str = "text") -> DataFrame:
    """One row per message: conv_id, turn, role, body, n_quotes, n_linked, parent_conv, parent_turn, root_turn, depth, position."""
    ws = Workspace(messages.sparkSession, "quotes")
    parsed = ws.save(parse_messages(messages, conv_col, turn_col, role_col, text_col), "parsed")
    once = parsed.where("conv_id IS NOT NULL AND turn IS NOT NULL").groupBy("conv_id", "turn").agg(
        F.min(F.struct("body", "passages")).alias("m"))
    once = ws.save(once.select("conv_id", "turn", "m.body", "m.passages"), "once")

    quotes = once.select("conv_id", "turn", F.posexplode("passages").alias("place", "q"))
    quotes = ws.save(quotes.select("conv_id", "turn", "place", F.col("q.level").alias("level"), pieces(F.col("q.text")).alias("pieces")), "quotes")
    parts = ws.save(quotes.select("conv_id", "turn", "place", F.inline("pieces")).groupBy("conv_id", "turn", "place", "h").agg(
        F.min("grain").alias("grain"), F.max("size").alias("size")), "parts")
    wanted = ws.save(parts.select("h").distinct(), "wanted")
    original = once.where("body <> ''").select("conv_id", "turn", F.explode(F.array_distinct(F.transform(pieces(F.col("body")), lambda x: x["h"]))).alias("h"))
    original = ws.save(original.join(wanted, "h", "left_semi"), "original") if not wanted.isEmpty() else \
        ws.save(original.where("false"), "original")
    # the nearest earlier message of the same conversation: quotes come before messages of the same turn
    said = original.select("h", "conv_id", "turn", F.lit(1).alias("kind"), F.col("turn").alias("said"), F.lit(0).alias("place"), F.lit(0).alias("grain"), F.lit(0).cast("long").alias("size"))
    asked = parts.select("h", "conv_id", "turn", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("said"), "place", "grain", "size")
    merged = carried(ws, said.unionByName(asked), ["h", "conv_id"], ["turn", "kind"], "said", "merged")
    near = merged.where("kind = 0 AND __before IS NOT NULL").groupBy("conv_id", "turn", "place", "grain", F.col("__before").alias("to_turn")).agg(F.sum("size").alias("size"))
    near = near.select("conv_id", "turn", "place", F.struct("grain", F.lit(0).alias("far"), (-F.col("size")).alias("size"), F.lit(0).cast("long").alias("c"),
                       (-F.col("to_turn")).alias("t"), F.struct("conv_id", F.col("to_turn").alias("turn")).alias("to")).alias("rank"))
    # the corpus's first message, and the first of any other conversation for quotes of that one
    firsts = ws.save(original.groupBy("h").agg(F.min(F.struct("conv_id", "turn")).alias("first")), "firsts")
    seconds = original.join(firsts, "h").where("conv_id <> first.conv_id").groupBy("h").agg(F.min(F.struct("conv_id", "turn")).alias("second"))
    far = ws.save(firsts.join(ws.save(seconds, "seconds"), "h", "left"), "far")
    far = parts.join(far, "h").select("conv_id", "turn", "place", "grain", "size",
                                      F.when(F.col("first.conv_id") == F.col("conv_id"), F.col("second")).otherwise(F.col("first")).alias("to"))
    far = far.where("to IS NOT NULL").groupBy("conv_id", "turn", "place", "grain", "to").agg(F.sum("size").alias("size"))
    far = far.select("conv_id", "turn", "place", F.struct("grain", F.lit(1).alias("far"), (-F.col("size")).alias("size"), F.col("to.conv_id").alias("c"),
                     F.col("to.turn").alias("t"), "to").alias("rank"))
    chosen = ws.save(near.unionByName(far).groupBy("conv_id", "turn", "place").agg(F.min("rank").alias("rank")), "chosen")
    linked = quotes.join(chosen, ["conv_id", "turn", "place"], "left").select("conv_id", "turn", "place", "level", F.col("rank.to").alias("to"))
    best = F.min(F.when(F.col("to").isNotNull(), F.struct("level", "place", "to"))).alias("best")
    links = linked.groupBy("conv_id", "turn").agg(best, F.count(F.lit(1)).alias("n_quotes"), F.count("to").alias("n_linked"))
    links = ws.save(links.select("conv_id", "turn", F.col("best.to").alias("to"), "n_quotes", "n_linked"), "links")

    keys = carried(ws, once.select("conv_id", "turn", F.col("turn").alias("said")), ["conv_id"], ["turn"], "said", "keys")
    nodes = keys.select("conv_id", "turn", F.col("__before").alias("previous")).join(links, ["conv_id", "turn"], "left")
    previous = F.when(F.col("previous").isNotNull(), F.struct("conv_id", F.col("previous").alias("turn")))
    nodes = ws.save(nodes.select("conv_id", "turn", F.coalesce("n_quotes", F.lit(0)).cast("long").alias("n_quotes"),
                                 F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
                                 F.when(F.col("to").isNotNull(), F.col("to")).otherwise(previous).alias("parent")), "nodes")
    threads = _threads(ws, nodes)
    order = threads.select("conv_id", "turn", "root", "depth")
    order = carried(ws, order, ["conv_id"], ["root", "depth", "turn"], "turn", "order").select("conv_id", "turn", F.col("__n").alias("position"))
    threads = threads.join(order, ["conv_id", "turn"])
    out = parsed.select("conv_id", "turn", "role", "body").join(threads, ["conv_id", "turn"], "left")
    return out.select("conv_id", "turn", "role", "body", F.coalesce("n_quotes", F.lit(0)).alias("n_quotes"),
                      F.coalesce("n_linked", F.lit(0)).alias("n_linked"), F.col("parent.conv_id").alias("parent_conv"),
                      F.col("parent.turn").alias("parent_turn"), F.coalesce("root", "turn").alias("root_turn"),
                      F.coalesce("depth", F.lit(0)).alias("depth"), "position")


def _threads(ws: Workspace, nodes: DataFrame) -> DataFrame:
    """nodes with root (the thread's first turn in the conversation) and depth.

    Only parents in the same conversation are followed; they are earlier turns, so
    there is no cycle.  Each round doubles the length of chain that is known, and only
    messages whose thread's first turn isn't known yet take part.
    """
    inside = F.col("parent.conv_id") == F.col("conv_id")
    state = nodes.select("conv_id", "turn", F.when(inside, F.col("parent.turn")).otherwise(F.col("turn")).alias("root"),
                         F.when(inside, 1).otherwise(0).cast("long").alias("depth"), F.coalesce(~inside, F.lit(True)).alias("known"))
    done = [ws.save(state.where("known"), "known-0")]
    todo = ws.save(state.where("NOT known"), "todo-0")
    k = 0
    while not todo.isEmpty():
        everyone = todo
        for part in done:
            everyone = everyone.unionByName(part)
        at = everyone.select("conv_id", F.col("turn").alias("root"), F.col("root").alias("root2"), F.col("depth").alias("depth2"),
                             F.col("known").alias("known2"))
        moved = todo.join(at, ["conv_id", "root"]).select("conv_id", "turn", F.col("root2").alias("root"),
                                                          (F.col("depth") + F.col("depth2")).alias("depth"), F.col("known2").alias("known"))
        k += 1
        moved = ws.save(moved, f"moved-{k}")
        done.append(moved.where("known"))
        todo = moved.where("NOT known")
    result = done[0]
    for part in done[1:]:
        result = result.unionByName(part)
    return nodes.join(result.drop("known"), ["conv_id", "turn"])


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_quotes(documents(spark, sf_dir, "conversations"))
