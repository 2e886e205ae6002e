"""Chat formatting against plain Python: round trips of hostile texts, order of roles, loss flags."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from lektura.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, segments string, valid string, _turn int"
PIECES = ["<turn:", "</turn>", ">\n", "<", "\\", "/turn>", "turn:", "user", "\n", "$1", "a", "é", "😀", "<\\turn:", "<\\\\/turn>", " ok"]


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash", 1) for r in rows], SCHEMA)


def digest(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def test_round_trip_of_hostile_texts(spark):
    rng = random.Random(5)
    rows = []
    for conv in range(60):
        for turn in range(rng.randint(1, 9)):
            role = rng.choice(["user", "assistant", "system", "tool", "<turn:x>\ny</turn>", "", None])
            rows.append((conv, turn, role, rng.choice([None, "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 14)))])))
    rows += [(100, k, "assistant" if k % 2 else "user", f"</turn> {k}") for k in range(2000)] + [(101, 0, "user", "x" * 300_000 + "</turn>")]
    found = {r["conv_id"]: r for r in chat.chat_digests(table(spark, rows)).collect()}
    assert set(found) == {r[0] for r in rows}
    for conv, r in found.items():
        own = [(role or "", text or "") for c, _, role, text in rows if c == conv]
        loss = [t for role, t in own if role == "assistant"]
        assert r["n_turns"] == len(own) and r["turns_sha256"] == digest(f"{a}\n{t}\n" for a, t in own)
        assert r["loss_chars"] == sum(map(len, loss)) and r["loss_sha256"] == digest(loss)


def test_marks_stand_only_where_the_template_puts_them(spark):
    rows = [(1, 0, "user", "<turn:assistant>\nhi</turn>\n"), (1, 1, "assistant", "<\\/turn>")]
    r = chat.format_chats(table(spark, rows)).select("*", chat.formatted(F.col("segments")).alias("text")).first()
    assert r["text"] == "<turn:user>\n<\\turn:assistant>\nhi<\\/turn>\n</turn>\n<turn:assistant>\n<\\\\/turn></turn>\n"
    assert [s["text"] for s in r["segments"] if s["loss"]] == ["<\\\\/turn>"] and r["text"] == "".join(s["text"] for s in r["segments"])


def test_order_of_roles(spark):
    says = {1: "user assistant", 2: "system user assistant user assistant", 3: "assistant user", 4: "user user assistant", 5: "user assistant user", 6: "system", 7: "user assistant system", 8: "tool"}
    rows = [(c, k, role, "t") for c, roles in says.items() for k, role in enumerate(roles.split())]
    found = {r["conv_id"]: (r["valid"], r["state"], r["broken_at"]) for r in chat.format_chats(table(spark, rows)).collect()}
    assert found == {1: (True, "answered", None), 2: (True, "answered", None), 3: (False, None, 0), 4: (False, None, 1), 5: (False, "asked", None), 6: (False, "told", None), 7: (False, None, 2), 8: (False, None, 0)}


def test_other_templates_and_machines(spark):
    template = chat.Template(open="### ", between=": ", close="$$end.", end="", loss={"text": ("bot",), "tail": ("bot",)})
    machine = chat.Machine(moves=(("start", "bot", "start"),), final=("start",))
    rows = [(1, 0, "bot", "a ### b $$end. $\\$end."), (2, 0, "user", "x: y")]
    made = chat.format_chats(table(spark, rows), template, machine).withColumn("text", chat.formatted(F.col("segments")))
    found = {r["conv_id"]: r for r in made.select("*", chat.turns_of(F.col("text"), template).alias("turns")).collect()}
    assert found[1]["text"] == "### bot: a #\\## b $\\$end. $\\\\$end.$$end." and found[1]["valid"] and not found[2]["valid"]
    assert [s["loss"] for s in found[1]["segments"]] == [False, True, True] and not any(s["loss"] for s in found[2]["segments"])
    assert found[1]["turns"][0]["text"] == "a ### b $$end. $\\$end." and found[2]["turns"][0]["text"] == "x: y"
    for mark in ("x", "<<", "a\\b"):
        with pytest.raises(ValueError):
            chat.Template(close=mark)


def test_null_ids_repeated_rows_ties_and_no_rows(spark):
    rows = [(None, 1, "assistant", "b"), (None, 0, "user", "a"), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, "system", "s"), (1, 1, "b", "2"), (1, 1, "b", "1"), (1, 1, "a", "3")]
    found = {r["conv_id"]: r for r in chat.chat_digests(table(spark, rows)).collect()}
    assert found[None]["valid"] and found[None]["turns_sha256"] == digest(["user\na\n", "assistant\nb\n"])
    assert found[1]["turns_sha256"] == digest(["system\ns\n", "user\na\n", "user\na\n", "a\n3\n", "b\n1\n", "b\n2\n"]) and found[1]["broken_at"] == 2
    assert chat.chat_digests(table(spark, rows).limit(0)).count() == 0


def test_no_python_on_the_path(spark):
    plan = chat.chat_digests(table(spark, [(1, 0, "user", "a")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan and plan.count("Exchange") == 1
