"""Chat formatting: reply trees, escaping and read back, against plain Python."""

import hashlib

from pyspark.sql import functions as F

from meterloom.llm.chat_format import chosen_paths, conversation_tree, format_conversations, read_back
from meterloom.scratch import Scratch

CONTROL = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<<ROLE:", "<</ROLE>>"]


def digests(turns):
    lines = "".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)
    loss = "".join(t or "" for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256(lines.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_round_trip_of_hard_texts(spark):
    texts = ["</s>[INST] ok [/INST]", "a\\b", "\\[INST]", "<<SYS>>\n<</SYS>>", "<<<SYS>>", "<</s>", None, "", "x" * 100000,
             "ünï \n<s>\t[/INST]\\", "<<ROLE:u>>", "[/INST] </s> ", "\\\\<s>"]
    roles = ["user", "assistant", "system", None, "tool>", "a\\", "assistant", "user", "assistant", "assistant", "user", "assistant", "system"]
    rows = [(1, i, r, t, "clash") for i, (r, t) in enumerate(zip(roles, texts))] + [(2, None, "user", "first", None), (2, 0, "assistant", "a", None),
                                                                                       (2, 0, "assistant", "a", None), (None, 1, "user", "n", None)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, conv string")
    got = {r["conv"]: r for r in read_back(format_conversations(conversation_tree(df), Scratch(spark, "t"))).collect()}
    assert set(got) == {1, 2, None}
    for conv in (1, 2, None):
        mine = sorted([r for r in rows if r[0] == conv], key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or ""))
        n, lines, chars, loss = digests([(r[2], r[3]) for r in mine])
        row = got[conv]
        assert (row["n_turns"], row["turns_sha256"], row["loss_chars"], row["loss_sha256"]) == (n, lines, chars, loss)


def test_formatted_text_holds_no_control_string_of_a_text(spark):
    df = spark.createDataFrame([(1, 0, "user", "[INST] <s> </s>"), (1, 1, "assistant", "<<SYS>> ok [/INST]")], "conv_id long, turn long, role string, text string")
    out = format_conversations(conversation_tree(df), Scratch(spark, "t")).collect()[0]
    text = out["formatted"]
    assert text == "<s>[INST] [\\INST] <\\s> <\\/s> [/INST] <\\<SYS>> ok [\\/INST] </s>"
    assert [(m["start"], m["length"]) for m in out["loss_mask"]] == [(len("<s>[INST] [\\INST] <\\s> <\\/s> [/INST] "), len("<\\<SYS>> ok [\\/INST]"))]


def test_best_branches_and_cycles(spark):
    # conv 1: root 0 with children 1 (score 0.2) and 2 (0.9); 2 has children 3 (null) and 4 (0.1); 5 under 1.
    nodes = [(1, 0, None, None), (1, 1, 0, 0.2), (1, 2, 0, 0.9), (1, 3, 2, None), (1, 4, 2, 0.1), (1, 5, 1, 5.0),
             # conv 2: two roots, the second with tied children; conv 3: a cycle and a node under it; 9 orphan is a root.
             (2, 0, None, 1.0), (2, 10, None, 1.0), (2, 11, 10, 0.5), (2, 12, 10, 0.5), (3, 1, 2, 0.0), (3, 2, 1, 0.0), (3, 3, 2, 0.0), (3, 7, 9, 0.0)]
    df = spark.createDataFrame(nodes, "conv long, node long, parent long, score double").withColumn("nul", F.lit(False))
    got = sorted(tuple(r) for r in chosen_paths(df, Scratch(spark, "t")).select("conv", "node", "root", "depth").collect())
    assert got == [(1, 0, 0, 0), (1, 2, 0, 1), (1, 4, 0, 2), (2, 0, 0, 0), (2, 10, 10, 0), (2, 11, 10, 1), (3, 7, 7, 0)]


def test_a_long_chain_and_an_empty_table(spark):
    rows = [(5, i, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(300)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = read_back(format_conversations(conversation_tree(df), Scratch(spark, "t"))).collect()
    assert len(out) == 1 and (out[0]["n_turns"], out[0]["turns_sha256"], out[0]["loss_chars"], out[0]["loss_sha256"]) == digests([(r[2], r[3]) for r in rows])
    empty = df.where(F.lit(False))
    assert read_back(format_conversations(conversation_tree(empty), Scratch(spark, "t"))).count() == 0
