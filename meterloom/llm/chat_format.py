"""Conversations from reply trees, formatted with a chat template and a loss mask over the replies.

Only DataFrame functions: the best child of every node is a grouped maximum; the path of best children
from every root is found by pointer jumping, an iterative self-join in which each round doubles how far a
node sees up its tree, so a tree of depth ``D`` takes ``log2(D)`` rounds and each round only joins nodes not
yet placed. Each chosen path is one conversation, formatted from its turns in order.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch

# Fixed values of the template (Llama-2 chat markers; other roles get a marker of their own):
#   user       <s>[INST] {text} [/INST]
#   assistant   {text} </s>                      (a space before and after the text)
#   system     <<SYS>>\n{text}\n<</SYS>>\n\n
#   other      <<ROLE:{role}>>\n{text}\n<</ROLE>>\n\n
# Control strings escaped inside texts: <s> </s> [INST] [/INST] <<SYS>> <</SYS>> <<ROLE: <</ROLE>>
USER = ("<s>[INST] ", " [/INST]")
ASSISTANT = (" ", " </s>")
SYSTEM = ("<<SYS>>\n", "\n<</SYS>>\n\n")
OTHER = ("<<ROLE:", ">>\n", "\n<</ROLE>>\n\n")
#: The first character of a control string is followed by a backslash; backslashes are doubled before.
_CONTROL = r"([<\[])(?=/?s>|/?INST\]|</?SYS>>|</?ROLE[:>])"
#: One turn of a formatted conversation, as written by ``_piece``.
_TURN = r"(?s)<s>\[INST\] .*? \[/INST\]| .*? </s>|<<SYS>>\n.*?\n<</SYS>>\n\n|<<ROLE:.*?>>\n.*?\n<</ROLE>>\n\n"


def escape(text: Column) -> Column:
    """Reversible: every backslash doubled, then a backslash after the first character of each control string."""
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), _CONTROL, r"$1\\")


def unescape(text: Column) -> Column:
    """The inverse of ``escape``: a backslash and the character after it become that character."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _piece(role: Column, text: Column) -> tuple[Column, Column, Column]:
    """The turn as formatted, the characters before its text, and the text's length where the loss mask covers it."""
    body = escape(text)
    other_head = F.concat(F.lit(OTHER[0]), F.regexp_replace(escape(role), ">", r"\\>"), F.lit(OTHER[1]))
    head = F.when(role == "user", USER[0]).when(role == "assistant", ASSISTANT[0]).when(role == "system", SYSTEM[0]).otherwise(other_head)
    tail = F.when(role == "user", USER[1]).when(role == "assistant", ASSISTANT[1]).when(role == "system", SYSTEM[1]).otherwise(OTHER[2])
    return F.concat(head, body, tail), F.char_length(head), F.when(role == "assistant", F.char_length(body))


def best_children(nodes: DataFrame) -> DataFrame:
    """``conv, parent, node``: of each node's children the one of highest score (null lowest), ties to the smaller id.

    A grouped maximum, so a parent with very many children is reduced before its rows meet.
    """
    c = F.col
    rank = F.struct(c("score").isNotNull().alias("a"), c("score").alias("b"), (-c("node")).alias("c"), c("node").alias("n"))
    best = nodes.where(c("parent").isNotNull()).groupBy("conv", "nul", "parent").agg(F.max(rank).alias("best"))
    return best.select("conv", "nul", "parent", c("best.n").alias("node"))


def chosen_paths(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """``conv, node, root, depth``: the nodes on the path of best children from each root, with their depth.

    ``nodes`` has ``conv, nul, node, parent, score`` (``nul``: ``conv`` stands for a null one), ``node`` unique within ``conv``. Roots are nodes without a
    parent or whose parent is not in their ``conv``. Each round joins the nodes not yet placed with the
    node their pointer names: a placed one places them, another is jumped over. Nodes under a cycle of
    parent links reach no root and are left out.
    """
    c = F.col
    on = ["conv", "nul", "node"]
    known = nodes.select("conv", "nul", c("node").alias("parent"), F.lit(True).alias("there"))
    linked = nodes.join(known, ["conv", "nul", "parent"], "left").withColumn("parent", F.when(c("there"), c("parent")))
    chosen = best_children(linked).withColumn("chosen", F.lit(True))
    state = linked.join(chosen, ["conv", "nul", "parent", "node"], "left").select(
        *on, c("parent").alias("up"), F.lit(1).cast("bigint").alias("dist"), F.coalesce(c("chosen"), c("parent").isNull()).alias("ok")
    )
    state = scratch.keep(state)
    placed = [scratch.keep(state.where(c("up").isNull()).select(*on, c("node").alias("root"), F.lit(0).cast("bigint").alias("depth"), "ok"))]
    active = state.where(c("up").isNotNull())
    rounds = math.ceil(math.log2(max(2, state.count()))) + 1
    for _ in range(rounds):
        if active.isEmpty():
            break
        done = placed[0]
        for more in placed[1:]:
            done = done.unionByName(more)
        there = done.select("conv", "nul", c("node").alias("up"), c("root").alias("r"), c("depth").alias("d"), c("ok").alias("o"))
        ahead = active.select("conv", "nul", c("node").alias("up"), c("up").alias("u2"), c("dist").alias("d2"), c("ok").alias("o2"))
        met = active.join(there, ["conv", "nul", "up"], "left").join(ahead, ["conv", "nul", "up"], "left")
        now = scratch.keep(
            met.select(
                *on,
                F.when(c("r").isNull(), c("u2")).alias("up"),
                F.when(c("r").isNotNull(), c("r")).alias("root"),
                F.when(c("r").isNotNull(), c("dist") + c("d")).otherwise(c("dist") + c("d2")).alias("dist"),
                (c("ok") & F.coalesce(c("o"), c("o2"))).alias("ok"),
                (c("u2").isNull() & c("r").isNull()).alias("lost"),
            )
        )
        placed.append(scratch.keep(now.where(c("root").isNotNull()).select(*on, "root", c("dist").alias("depth"), "ok")))
        active = now.where(c("root").isNull() & ~c("lost")).select(*on, "up", "dist", "ok")
    found = placed[0]
    for more in placed[1:]:
        found = found.unionByName(more)
    return found.where("ok").drop("ok")


def format_conversations(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """``conv, root, n_turns, formatted, loss_mask``: one row per root, written to the shared folder.

    ``turns`` has ``conv, node, parent, score, role, text``; null role or text is taken as empty. The
    conversation is the chosen path from the root (see ``chosen_paths``), its turns in depth order.
    ``loss_mask`` holds ``start, length`` in code points of ``formatted`` for each assistant text, in order.
    """
    c = F.col
    turns = turns.withColumn("nul", c("conv").isNull()).withColumn("conv", F.coalesce("conv", F.lit(0)))
    path = chosen_paths(turns.select("conv", "nul", "node", "parent", "score"), scratch)
    rows = path.join(turns.select("conv", "nul", "node", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")), ["conv", "nul", "node"])
    piece, head, loss = _piece(c("role"), c("text"))
    rows = rows.select("conv", "nul", "root", "depth", piece.alias("piece"), head.alias("head"), loss.alias("loss"))
    before = Window.partitionBy("conv", "nul", "root").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("at", F.coalesce(F.sum(F.char_length("piece")).over(before), F.lit(0)) + c("head"))
    parts = F.array_sort(F.collect_list(F.struct("depth", "piece", "at", "loss")))
    out = rows.groupBy("conv", "nul", "root").agg(parts.alias("parts")).select(
        F.when(~c("nul"), c("conv")).alias("conv"),
        "root",
        F.size("parts").cast("bigint").alias("n_turns"),
        F.array_join(F.transform("parts", lambda p: p["piece"]), "").alias("formatted"),
        F.transform(F.filter("parts", lambda p: p["loss"].isNotNull()), lambda p: F.struct(p["at"].cast("int").alias("start"), p["loss"].cast("int").alias("length"))).alias(
            "loss_mask"
        ),
    )
    return scratch.keep(out)


def read_back(formatted: DataFrame) -> DataFrame:
    """``conv, root, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars`` parsed from the written rows.

    Turns are cut from the text by the template's markers and unescaped; ``turns_sha256`` hashes
    ``role \\n text \\n`` of each; the loss text is what the mask covers, unescaped, in order.
    """
    c = F.col
    turns = F.regexp_extract_all("formatted", F.lit(_TURN), 0)

    def role(t: Column) -> Column:
        other = unescape(F.regexp_extract(t, r"(?s)^<<ROLE:(.*?)>>\n", 1))
        return F.when(t.startswith(USER[0]), "user").when(t.startswith(SYSTEM[0]), "system").when(t.startswith(ASSISTANT[0]), "assistant").otherwise(other)

    def text(t: Column) -> Column:
        inner = (
            F.when(t.startswith(USER[0]), F.regexp_extract(t, r"(?s)^<s>\[INST\] (.*) \[/INST\]$", 1))
            .when(t.startswith(SYSTEM[0]), F.regexp_extract(t, r"(?s)^<<SYS>>\n(.*)\n<</SYS>>\n\n$", 1))
            .when(t.startswith(ASSISTANT[0]), F.regexp_extract(t, r"(?s)^ (.*) </s>$", 1))
            .otherwise(F.regexp_extract(t, r"(?s)^<<ROLE:.*?>>\n(.*)\n<</ROLE>>\n\n$", 1))
        )
        return unescape(inner)

    lines = F.array_join(F.transform(turns, lambda t: F.concat(role(t), F.lit("\n"), text(t), F.lit("\n"))), "")
    loss = F.array_join(F.transform("loss_mask", lambda m: unescape(F.substring(c("formatted"), m["start"] + 1, m["length"]))), "")
    return formatted.select(
        "conv",
        "root",
        F.size(turns).cast("bigint").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.char_length(loss).cast("bigint").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("bigint").alias("formatted_chars"),
    )


def conversation_tree(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv, node, parent, score, role, text`` of a table of turns: each turn replies to the one before it.

    Turns are ordered by ``turn`` (null first), equal turns by role and text (null first), and numbered from 0
    within their conversation; repeated rows are consecutive turns. A null ``conv`` is a conversation of its own.
    """
    c = F.col
    df = rows.select(c(conv).cast("bigint").alias("conv"), c(turn).alias("turn"), c(role).cast("string").alias("role"), c(text).cast("string").alias("text"))
    order = Window.partitionBy("conv").orderBy(c("turn").asc_nulls_first(), c("role").asc_nulls_first(), c("text").asc_nulls_first())
    numbered = df.withColumn("node", (F.row_number().over(order) - 1).cast("bigint"))
    return numbered.select("conv", "node", F.when(c("node") > 0, c("node") - 1).alias("parent"), F.lit(0.0).alias("score"), "role", "text")
